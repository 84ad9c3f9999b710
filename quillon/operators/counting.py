"""How often forms occur in texts, at word borders and without overlap.

A list of forms of up to ``LIST_BYTES`` is an automaton that reads each text once (``quillon.operators.automata``);
its size is measured before it goes to the workers. Of a longer list, whatever its length,

* A, one word run: equals a whole run of the text, so runs are counted and joined by equality;
* B, several runs that start and end with a word and can't overlap themselves: equals a sequence of
  runs; sequences of as many runs are joined by equality;
* C, all others, with signs around them, signs alone, or that overlap themselves: these are dealt into lists of about
  ``LIST_BYTES``, each an automaton of its own.

Both ways give the same rows. A text is cut into runs once, and no row carries more of it than a form's runs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon import storage
from quillon.functions import text as T
from quillon.operators import automata

#: UTF-8 bytes of forms in one automaton: about 60 MB in a worker.
LIST_BYTES = 1 << 20


def routed(forms: DataFrame, form: str = "form") -> DataFrame:
    """``forms`` with the normalised form (_form), its class and number of runs."""
    out = forms.withColumn("_form", T.strip(T.normalize(form))).filter("_form <> ''").withColumn("_parts", T.all_runs("_form"))
    n = F.size("_parts")
    starts, ends = F.rlike("_form", F.lit(f"^{T.WORD}")), F.rlike("_form", F.lit(f"{T.WORD}$"))
    overlap = F.exists(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda k: (k % 2 == 0) & (k < n) & (F.slice("_parts", k + 1, F.greatest(n - k, F.lit(1))) == F.slice("_parts", F.lit(1), F.greatest(n - k, F.lit(1)))))
    kind = F.when(starts & ends, F.when(n == 1, "A").when(~overlap, "B").otherwise("C")).otherwise("C")
    return out.withColumns({"_class": kind, "_runs": n}).drop("_parts")


def sequences(r, m: int):
    """The texts of all ``m`` runs that begin and end with a word, of the array of runs ``r``, in order."""
    first = F.when(F.rlike(F.coalesce(F.get(r, F.lit(0)), F.lit("")), F.lit(f"^{T.WORD}")), 0).otherwise(1)
    last = F.size(r) - m
    at = F.when(last >= first, F.sequence(first, last, F.lit(2))).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: F.concat(*[F.get(r, i + k) for k in range(m)]))


def _lists(forms: DataFrame, within: list[str]) -> dict[tuple, list[str]]:
    """Forms by the values of ``within``, on the driver; for lists of a checked size."""
    out: dict[tuple, list[str]] = {}
    for r in forms.select(*within, "_form").collect():
        out.setdefault(tuple(r)[:-1], []).append(r[-1])
    return out


def _bytes(forms: DataFrame) -> int:
    return forms.agg(F.sum(F.octet_length("_form") + 8)).first()[0] or 0


def count_forms(texts: DataFrame, forms: DataFrame, keys: list[str], text: str = "text", within: list[str] | None = None, list_bytes: int | None = None) -> DataFrame:
    """(keys, [within], form, n) for forms (form, [within]) that occur in ``texts`` (keys, [within], normalised text).

    ``within`` names columns that text and form must share; null is shared with nothing. Texts with equal keys are counted together.
    """
    within, limit = within or [], LIST_BYTES if list_bytes is None else list_bytes
    f = storage.stored(routed(forms).dropna(subset=within).select(*within, "_form", "_class", "_runs").distinct(), "forms")
    texts = texts.select(*keys, *within, F.col(text).alias("_text"))
    by = [*within, "_form"]
    if _bytes(f) <= limit:
        out = automata.count(texts, _lists(f, within), keys, within)
        return out.withColumnRenamed("_form", "form")
    count = F.count(F.lit(1)).alias("n")
    runs = texts.select(*keys, *within, T.all_runs("_text").alias("_r"))
    parts = []
    for kind, m in sorted((r[0], r[1]) for r in f.filter("_class <> 'C'").select("_class", "_runs").distinct().collect()):
        found = T.runs("_text") if kind == "A" else sequences(F.col("_r"), m)
        each = (texts if kind == "A" else runs).select(*keys, *within, F.explode(found).alias("_form")).groupBy(*keys, *by).agg(count)
        parts.append(each.join(f.filter((F.col("_class") == kind) & (F.col("_runs") == m)).select(*by), by, "left_semi"))
    others = f.filter("_class = 'C'")
    lists = -(-_bytes(others) // max(limit // 2, 1))  # half full, since hashes deal them
    for k in range(lists):
        mine = others.filter(F.pmod(F.xxhash64("_form"), F.lit(lists)) == k)
        parts.append(automata.count(texts, _lists(mine, within), keys, within))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.withColumnRenamed("_form", "form")


def sides(pairs: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """(pair_id, side, keep, raw, text): the source and the edited text of each pair, normalised."""
    keep = keep or []
    both = F.explode(F.array(F.struct(F.lit("before").alias("side"), F.col("source_text").alias("raw")), F.struct(F.lit("after").alias("side"), F.col("edited_text").alias("raw"))))
    return pairs.select("pair_id", *keep, both.alias("x")).select("pair_id", *keep, "x.side", F.coalesce("x.raw", F.lit("")).alias("raw"), T.normalize("x.raw").alias("text"))


def before_after(counts: DataFrame, by: list[str]) -> DataFrame:
    """Counts (side, n) as columns before and after."""
    of = lambda s: F.sum(F.when(F.col("side") == s, F.col("n")).otherwise(0)).cast("long").alias(s)
    return counts.groupBy(*by).agg(of("before"), of("after"))
