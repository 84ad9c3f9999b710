"""Lexical audit of (source, edited) text pairs against group, depth, phrase and word targets.

Every step maps tables to tables with pair_id in the key, so one pair and millions run alike.
Targets carry a ``scope`` column that pairs share (a language, a project); a single audit has one.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass
from itertools import groupby, islice
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import IntegerType, LongType, StringType, StructType

from quillon import storage
from quillon.functions import text as T
from quillon.operators import counting


#: Pairs whose tokens are Python objects at a time; rows of a batch of results.
ROWS, BATCH = 50, 10_000


@dataclass
class AuditConfig:
    """Options of an audit; the limit of ranked groups is held to 140..150 unless told otherwise."""

    breadth_limit: int = 150
    enforce_limit_range: bool = True
    scope: str = "scope"

    def __post_init__(self):
        if self.enforce_limit_range and not 140 <= self.breadth_limit <= 150:
            raise ValueError("breadth_limit must lie in 140..150")


def _counts(pairs: DataFrame, items: DataFrame, by: list[str], scope: str) -> DataFrame:
    """(pair_id, scope, by, before, after) for the items (scope, by, forms) that occur in a text of their scope."""
    forms = items.select(scope, *by, F.explode(F.array_distinct(F.transform("forms", lambda f: T.strip(T.normalize(f))))).alias("form")).filter("form <> ''")
    forms = storage.stored(forms, "forms")
    found = counting.count_forms(counting.sides(pairs, [scope]), forms.select(scope, "form").distinct(), ["pair_id", "side"], within=[scope])
    return counting.before_after(found.join(forms, [scope, "form"]), ["pair_id", scope, *by])


def _item_counts(pairs: DataFrame, items: DataFrame, key: str, scope: str, counts: DataFrame | None = None) -> DataFrame:
    """(pair_id, scope, key, before, after) for every item of the pair's scope; items: (scope, key, forms)."""
    items = items.select(scope, key, "forms") if counts is None else items.select(scope, key)
    if counts is None:
        items = storage.stored(items, "items")
        counts = _counts(pairs, items, [key], scope)
    grid = pairs.select("pair_id", scope).join(items.select(scope, key), scope)
    return grid.join(counts, ["pair_id", scope, key], "left").fillna(0, ["before", "after"])


def counted_groups(pairs: DataFrame, groups: DataFrame, scope: str = "scope") -> DataFrame:
    """(pair_id, scope, breadth_rank, before, after) of the groups that occur, stored for several uses."""
    return storage.stored(_counts(pairs, groups.select(scope, "breadth_rank", "forms"), ["breadth_rank"], scope), "counted")


def unit_counts(pairs: DataFrame, units: DataFrame, scope: str = "scope") -> DataFrame:
    """(pair_id, scope, unit, before, after) of each row of ``pairs`` and each unit (scope, unit, forms) of its scope, zeros too."""
    grid = pairs.select("pair_id", scope).join(units.select(scope, "unit"), scope)
    return grid.join(_counts(pairs, units, ["unit"], scope), ["pair_id", scope, "unit"], "left").fillna(0, ["before", "after"])


def group_status(median="median", before="before", after="after"):
    m, b, a = F.col(median), F.col(before), F.col(after)
    with_median = F.when(a > m, "over").when(a == m, "at").otherwise("under")
    without = F.when(F.greatest(F.lit(0), a - b) > 1, "breadth-over").when(a > 0, "covered").otherwise("uncovered")
    return F.when(m > 0, with_median).otherwise(without)


def group_rows(pairs: DataFrame, groups: DataFrame, scope: str = "scope", counts: DataFrame | None = None) -> DataFrame:
    """Groups (scope, breadth_rank, word, forms, median, analyzer_current) with before, after, status per pair.

    Also the remainder to the median and the group's class if the groups have one. ``counts``: (pair_id,
    scope, breadth_rank, before, after), if they are known.
    """
    return _grouped(_item_counts(pairs, groups, "breadth_rank", scope, counts).join(groups.drop("forms"), [scope, "breadth_rank"]))


def _grouped(rows: DataFrame) -> DataFrame:
    return rows.withColumn("status", group_status()).withColumn("free", F.greatest(F.lit(0.0), F.col("median") - F.col("after")))


def depth_target(delta="delta", maximum="maximum", repeats="repeats", before="before"):
    """(synchronized, target): the count a depth row asks for, null if none."""
    d, m, r, b = F.col(delta), F.col(maximum), F.col(repeats), F.col(before)
    sync = F.coalesce(b == r, F.lit(False))
    cut = F.when(sync & m.isNotNull(), m).otherwise(F.greatest(F.lit(0.0), b - F.abs(d)))
    return sync, F.when(d < 0, cut).when(m.isNotNull() & (b > m), m)


def counted_depth(pairs: DataFrame, depth: DataFrame, scope: str = "scope", counts: DataFrame | None = None) -> DataFrame:
    """Depth rows (scope, row_ix, word, forms, repeats, minimum, maximum, delta) with before and after."""
    return _item_counts(pairs, depth, "row_ix", scope, counts).join(depth.drop("forms"), [scope, "row_ix"])


def depth_rows(counted: DataFrame) -> DataFrame:
    sync, target = depth_target()
    out = counted.withColumns({"synchronized": sync, "target": target}).filter("target is not null")
    return out.withColumn("status", F.when(F.col("after") == F.col("target"), "at").when(F.col("after") > F.col("target"), "above").otherwise("below"))


def minimum_rows(counted: DataFrame, relevant: DataFrame | None = None, scope: str = "scope") -> DataFrame:
    """Rows with a positive minimum; with a list ``relevant`` (scope, key) only its words."""
    out = counted.filter("minimum > 0")
    if relevant is not None:
        out = out.withColumn("key", T.normalize_header("word")).join(relevant.select(scope, "key").distinct(), [scope, "key"], "left_semi").drop("key")
    return out.withColumn("status", F.when(F.col("after") >= F.col("minimum"), "at-least").otherwise("below"))


def _single(items: DataFrame, form: str) -> DataFrame:
    return items.withColumn("forms", F.array(form))


def phrase_rows(pairs: DataFrame, phrases: DataFrame, scope: str = "scope", counts: DataFrame | None = None) -> DataFrame:
    """Phrases (scope, row_ix, phrase, median, ...) that occur on a side, with their status."""
    return _phrased(_item_counts(pairs, _single(phrases, "phrase"), "row_ix", scope, counts).filter("before > 0 or after > 0").join(phrases, [scope, "row_ix"]))


def _phrased(rows: DataFrame) -> DataFrame:
    return rows.withColumn("status", F.when(F.col("after") > F.col("median"), "over").when(F.col("after") == F.col("median"), "at").otherwise("under"))


def irrelevant_rows(pairs: DataFrame, forms: DataFrame, scope: str = "scope", counts: DataFrame | None = None) -> DataFrame:
    """Unwanted forms (scope, row_ix, form, reported_current, target) with their status."""
    return _unwanted(_item_counts(pairs, _single(forms, "form"), "row_ix", scope, counts).join(forms, [scope, "row_ix"]))


def _unwanted(rows: DataFrame) -> DataFrame:
    return rows.withColumn("status", F.when(F.col("after") <= F.col("target"), "at").otherwise("above"))


def width_rows(pairs: DataFrame, words: DataFrame, scope: str = "scope", counts: DataFrame | None = None) -> DataFrame:
    return _widths(_item_counts(pairs, _single(words, "word"), "row_ix", scope, counts).join(words, [scope, "row_ix"]))


def _widths(rows: DataFrame) -> DataFrame:
    return rows.withColumn("status", F.when(F.col("after") > 0, "covered").otherwise("uncovered"))


def coverage(rows: DataFrame, by: list[str], prefix: str = "", when=None) -> list:
    """Aggregates of width and depth over group rows; ``when`` restricts them to some rows."""
    on = F.lit(True) if when is None else when
    n, m = F.count_if(on), on & (F.col("median") > 0)
    share = lambda side: F.coalesce(F.count_if(on & (F.col(side) > 0)) / F.nullif(n, F.lit(0)), F.lit(0.0)).alias(f"{prefix}width_{side}")
    deep = lambda side: F.coalesce(F.sum(F.when(m, F.least(F.col(side).cast("double"), F.col("median")))) / F.sum(F.when(m, F.col("median"))), F.lit(0.0)).alias(f"{prefix}depth_{side}")
    return [
        n.alias(f"{prefix}groups"),
        F.count_if(m).alias(f"{prefix}median_groups"),
        F.count_if(on & (F.col("before") > 0)).alias(f"{prefix}covered_before"),
        F.count_if(on & (F.col("after") > 0)).alias(f"{prefix}covered_after"),
        share("before"),
        share("after"),
        deep("before"),
        deep("after"),
    ]


def _gained(rows, sizes):
    """(pair_id, size, pattern, before, after) of the n-grams gained by two or more; rows (pair_id, before, after) of one pair_id adjoin."""
    for pair, same in groupby(rows, key=itemgetter(0)):
        counts = [(Counter(), Counter()) for _ in sizes]
        for _, *texts in same:
            for n, sides in zip(sizes, counts, strict=True):
                for t, count in zip(texts, sides, strict=True):
                    count.update(t if n == 1 else zip(*[t[k:] for k in range(n)], strict=False))
        for n, (before, after) in zip(sizes, counts, strict=True):
            for gram, m in after.items():
                if m >= 2 and m - before[gram] >= 2:
                    yield pair, n, gram if n == 1 else " ".join(gram), before[gram], m


def introduced_patterns(pairs: DataFrame, sizes=(1, 2, 3)) -> DataFrame:
    """(pair_id, size, pattern, before, after, added): token n-grams that the edited text gained.

    Of one token: no digits, no function words, three or more uses and two more than before; of
    more: two uses and two more. N-grams cross the ends of sentences. Texts of one pair_id come together and are
    counted where they are, so no n-gram is shuffled and a task holds the counts of one pair; tasks grow in number with the texts.
    """
    storage.ship(pairs.sparkSession)
    schema = StructType([pairs.schema["pair_id"]]).add("size", IntegerType()).add("pattern", StringType()).add("before", LongType()).add("after", LongType())

    def work(batches):
        lists = ((c.to_pylist() for c in b.slice(lo, ROWS).columns) for b in batches for lo in range(0, b.num_rows, ROWS))
        found = _gained((row for columns in lists for row in zip(*columns, strict=True)), sizes)
        while part := list(islice(found, BATCH)):
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*part, strict=True), to_arrow_schema(schema), strict=True)], names=schema.names)

    together = storage.dealt(pairs.select("pair_id", "source_text", "edited_text"), "pair_id", ["source_text", "edited_text"])
    tokens = together.select("pair_id", *[T.tokens(T.normalize(c)).alias(c) for c in ("source_text", "edited_text")])
    out = tokens.mapInArrow(work, schema).withColumn("added", F.col("after") - F.col("before"))
    one = (F.col("after") >= 3) & ~T.is_digits("pattern") & ~F.col("pattern").isin(*T.FUNCTION_WORDS)
    return out.filter(F.when(F.col("size") == 1, one).otherwise(F.lit(True)))


def introduced(pairs: DataFrame, n: int) -> DataFrame:
    """(pair_id, pattern, before, after, added): the introduced patterns of ``n`` tokens."""
    return introduced_patterns(pairs, (n,)).drop("size")


def fact_diff(pairs: DataFrame, decimal_aware: bool = False, keep: list | None = None) -> DataFrame:
    """(pair_id, missing, added): sorted fact tokens of one side only; ``keep`` names further columns."""
    a, b = T.fact_tokens("source_text", decimal_aware), T.fact_tokens("edited_text", decimal_aware)
    both = pairs.select("pair_id", *(keep or []), a.alias("a"), b.alias("b"))
    return both.select("pair_id", *both.columns[1:-2], F.array_sort(F.array_except("a", "b")).alias("missing"), F.array_sort(F.array_except("b", "a")).alias("added"))


def warnings(groups: DataFrame, depth: DataFrame | None = None, irrelevant: DataFrame | None = None, unmatched: DataFrame | None = None) -> DataFrame:
    """(pair_id, kind_ord, row_ord, warning): what tables and texts don't agree on.

    groups: rows with analyzer_current; depth: rows kept by their target; irrelevant: rows with
    reported_current; unmatched: (pair_id, key) of relevant words without a group.
    """
    num = lambda c: T.clean_number(F.col(c).cast("double"))
    parts = [groups.filter("analyzer_current is not null and analyzer_current <> before").select("pair_id", F.lit(1).alias("kind_ord"), F.col("breadth_rank").cast("long").alias("row_ord"), F.concat(F.lit("LSI "), "word", F.lit(": файл="), F.col("before").cast("string"), F.lit(", анализатор="), num("analyzer_current")).alias("warning"))]
    if depth is not None:
        parts.append(depth.filter("not synchronized").select("pair_id", F.lit(2).alias("kind_ord"), F.col("row_ix").cast("long").alias("row_ord"), F.concat(F.lit("Глубина "), "word", F.lit(": таблица несинхронна с исходным текстом")).alias("warning")))
    if irrelevant is not None:
        parts.append(irrelevant.filter("reported_current is not null and reported_current <> before").select("pair_id", F.lit(3).alias("kind_ord"), F.col("row_ix").cast("long").alias("row_ord"), F.concat(F.lit("Нерелевантное "), "form", F.lit(": файл="), F.col("before").cast("string"), F.lit(", анализатор="), F.col("reported_current").cast("string")).alias("warning")))
    if unmatched is not None:
        parts.append(unmatched.select("pair_id", F.lit(4).alias("kind_ord"), F.lit(0).cast("long").alias("row_ord"), F.concat(F.lit("Релевантная группа не найдена в первых строках: "), "key").alias("warning")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def unmatched_relevant(groups: DataFrame, relevant: DataFrame, scope: str = "scope") -> DataFrame:
    """(scope, key) of relevant words that no group has."""
    return relevant.select(scope, "key").distinct().join(groups.select(scope, T.normalize_header("word").alias("key")), [scope, "key"], "left_anti")


def verdict():
    """Whether a summary row breaks a binding limit; minimum, introduced patterns and warnings don't bind."""
    limits = ["lsi_over", "breadth_over", "negative_above", "irrelevant_above", "edited_yo", "missing_fact_tokens", "added_fact_tokens"]
    out = F.lit(False)
    for c in limits:
        out = out | (F.coalesce(F.col(c), F.lit(0)) > 0)
    return out


def audit(pairs: DataFrame, groups: DataFrame, depth=None, phrases=None, irrelevant=None, width=None, relevant=None, letters: str = "Ёё", scope: str = "scope", config: AuditConfig | None = None) -> dict[str, DataFrame]:
    """All result tables of an audit by name; summary has one row per pair."""
    config = config or AuditConfig(enforce_limit_range=False)
    groups = groups.filter(F.col("breadth_rank") <= config.breadth_limit)
    # All lists of targets are counted together, and forms that several items share once; a pair's counts of all of them are stored once.
    lists = {"groups": groups, "depth": depth, "phrases": phrases and _single(phrases, "phrase"), "irrelevant": irrelevant and _single(irrelevant, "form"), "width": width and _single(width, "word")}
    base = storage.shared_dir(pairs.sparkSession)
    tables = {k: storage.stored(df.withColumn("forms", F.coalesce("forms", F.array().cast("array<string>"))), k, base) for k, df in lists.items() if df is not None}
    every = None
    for df in tables.values():
        part = df.select(scope, "forms")
        every = part if every is None else every.unionByName(part)
    units = storage.stored(every.distinct().withColumn("unit", F.monotonically_increasing_id()), "units", base)
    grid = storage.stored(unit_counts(pairs, units, scope), "grid", base)
    if relevant is not None:
        relevant = storage.stored(relevant.select(scope, "key").distinct(), "relevant", base)

    def rows_of(k: str, key: str) -> DataFrame:
        """The items of a list with before and after for each pair; words are compared with the relevant ones in the list, not in its rows."""
        t = tables[k].join(units, [scope, "forms"]).drop("forms")
        if relevant is not None and k in ("groups", "depth"):
            t = t.withColumn("_key", T.normalize_header("word")).join(relevant.select(scope, F.col("key").alias("_key"), F.lit(True).alias("_relevant")), [scope, "_key"], "left")
            t = t.withColumn("_relevant", F.coalesce("_relevant", F.lit(False))).drop("_key")
        t = storage.stored(t, f"{k}_units", base)
        return grid.join(t, [scope, "unit"]).select(scope, key, "pair_id", "before", "after", *[c for c in t.columns if c not in (scope, key, "unit")])

    g = _grouped(rows_of("groups", "breadth_rank"))
    out = {"groups": g.drop("_relevant")}
    aggs = [*coverage(g, ["pair_id"], "raw_"), F.count_if(F.col("status") == "over").alias("lsi_over"), F.count_if(F.col("status") == "breadth-over").alias("breadth_over")]
    if relevant is not None:
        aggs += coverage(g, ["pair_id"], "filtered_", F.col("_relevant"))

    # Every other table adds rows (pair_id, name of a counter), which are counted in one aggregate.
    counted: list[tuple[DataFrame, dict]] = []

    def add(name: str, rows: DataFrame, **counters):
        out[name] = rows
        counted.append((rows, counters))

    is_ = lambda s: F.col("status") == s
    each = F.lit(True)
    if depth is not None:
        rows = rows_of("depth", "row_ix")
        add("depth", depth_rows(rows.drop("_relevant")), negative_groups=each, negative_above=is_("above"))
        add("minimum", minimum_rows(rows if relevant is None else rows.filter("_relevant")).drop("_relevant"), minimum_groups=each, minimum_below=is_("below"))
    if phrases is not None:
        out["phrases"] = _phrased(rows_of("phrases", "row_ix").filter("before > 0 or after > 0"))
    if irrelevant is not None:
        add("irrelevant", _unwanted(rows_of("irrelevant", "row_ix")), irrelevant_groups=each, irrelevant_above=is_("above"))
    if width is not None:
        add("width", _widths(rows_of("width", "row_ix")), width_words=each, width_covered_before=F.col("before") > 0, width_covered_after=F.col("after") > 0)
    patterns = storage.stored(introduced_patterns(pairs), "introduced", base)
    for n, name in ((1, "tokens"), (2, "bigrams"), (3, "trigrams")):
        add(name, patterns.filter(F.col("size") == n).drop("size"), **{"introduced_token_flags" if n == 1 else "introduced_frame_flags": each})
    lost = None if relevant is None else pairs.select("pair_id", scope).join(unmatched_relevant(tables["groups"], relevant, scope), scope).select("pair_id", "key")
    add("warnings", warnings(out["groups"], out.get("depth"), out.get("irrelevant"), lost), warnings=each)

    letter_counts = [T.letter_count("source_text", letters).alias("source_yo"), T.letter_count("edited_text", letters).alias("edited_yo")]
    facts = storage.stored(fact_diff(pairs, keep=[scope, *letter_counts]), "facts", base)
    out["facts"] = facts.select("pair_id", "missing", "added")
    long = None
    for rows, counters in counted:
        names = F.array_compact(F.array(*[F.when(F.coalesce(on, F.lit(False)), F.lit(k)) for k, on in counters.items()]))
        part = rows.select("pair_id", F.explode(names).alias("counter"))
        long = part if long is None else long.unionByName(part)
    names = ("negative_groups", "negative_above", "minimum_groups", "minimum_below", "irrelevant_groups", "irrelevant_above", "width_words", "width_covered_before", "width_covered_after", "introduced_token_flags", "introduced_frame_flags", "warnings")
    sums = long.groupBy("pair_id").agg(*[F.count_if(F.col("counter") == k).alias(k) for k in names])
    total = facts.select("pair_id", scope, F.size("missing").cast("long").alias("missing_fact_tokens"), F.size("added").cast("long").alias("added_fact_tokens"), "source_yo", "edited_yo")
    total = total.join(g.groupBy("pair_id").agg(*aggs), "pair_id", "left").join(sums, "pair_id", "left").fillna(0, list(names))
    out["summary"] = storage.stored(total.withColumn("failed", verdict()), "summary", base)  # reports show it in several lines
    return out


def sync_checks(depth: DataFrame, groups: DataFrame | None = None, scope: str = "scope") -> DataFrame:
    """(scope, word, check): depth rows whose repeats and delta don't give the maximum, and words with another median in the group table."""
    first = depth.filter((F.col("repeats") + F.col("delta")) != F.col("maximum")).select(scope, "word", F.lit("repeats + delta differs from maximum").alias("check"))
    if groups is None or "median" not in depth.columns:
        return first
    other = groups.select(scope, T.normalize_header("word").alias("key"), F.col("median").alias("_other"))
    differ = depth.withColumn("key", T.normalize_header("word")).join(other, [scope, "key"]).filter("median <> _other")
    return first.unionByName(differ.select(scope, "word", F.lit("median differs between tables").alias("check")))
