"""Mixing sources to target weights by iterative proportional fitting, in DataFrame operations only.

Tokens are summed by cell (source, language, topic). Raking finds factors a(source) * b(language) *
c(topic) for the cells so that the token shares of every source, language and topic meet their
targets; by default a target is the observed share to a power below one, which lifts what is rare.
A document's draw is a hash of its doc_id, so runs and retries agree.

A document of a cell is kept with probability min(1, d(source) * e(language) * f(topic)): the
factors are raked on the tokens that the bound leaves, so that the expected tokens of every source,
language and topic meet their targets and those of all the wanted share. A group whose target
exceeds the tokens it has is kept whole, and the other targets of its kind share what it can't
give in their proportions. Where the targets of two kinds can't be met together, the last round
stays. The SQL reaches the same probabilities by mending one kind after the other, starting at 1.

Cells are pre-aggregated, so a source that holds a third of all rows is one row for each language
and topic after the first step. Cells of one source form one row; a raking round is one scan of
these rows that returns one sum for each (language, topic). Only those sums and the factors of
languages and topics are held by the driver: both are code lists (topics below, languages by their code,
``MOST_LANGS`` at most, which is checked). Sources stay in the table.

A topic is the form of the text: 'lists' (a bar in every 200 characters), 'figures' (a digit in
every 60), 'letters' (an at sign or a link) or 'prose'. Null source or language is the group ''.
Null text has no tokens; documents without tokens get their cell's probability if it has tokens,
else 0. A null doc_id draws as the text 'null'. Repeated rows draw alike. Texts are counted whole, however
long. An empty table gives no rows. Columns of
the result's names (_source, _lang, _topic, _tokens, _weight, _probability, _kept) are replaced.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared

ROUNDS = 20
#: Steps of the bounded raking in SQL, each over one kind.
SQL_STEPS = 300
#: Rounds of bounded raking at most, and the largest relative error of a group at which they end.
BOUNDED_ROUNDS, BOUNDED_ERROR = 60, 1e-11
POWERS = {"source": 0.5, "lang": 0.7, "topic": 0.8}
SHARE = 0.6
#: Cells up to which their table is broadcast (each under 200 bytes); beyond it the join shuffles.
BROADCAST_CELLS = 100_000
#: Languages that the driver may hold; a column with more isn't a code list, and that is an error.
MOST_LANGS = 10_000


def topic(text):
    n = F.length(text)
    bars = n - F.length(F.replace(text, F.lit("|"), F.lit("")))
    digits = F.regexp_count(text, F.lit("[0-9]"))
    return (
        F.when(bars * 200 >= F.greatest(n, F.lit(1)), F.lit("lists"))
        .when(digits * 60 >= F.greatest(n, F.lit(1)), F.lit("figures"))
        .when(F.contains(text, F.lit("@")) | F.contains(text, F.lit("http")), F.lit("letters"))
        .otherwise(F.lit("prose"))
    )


def described(docs: DataFrame) -> DataFrame:
    """``docs`` with _source, _lang, _topic and _tokens."""
    return docs.withColumns(
        {
            "_source": F.coalesce(F.col("source").cast("string"), F.lit("")),
            "_lang": F.coalesce(F.col("lang").cast("string"), F.lit("")),
            "_topic": topic(F.coalesce("text", F.lit(""))),
            "_tokens": F.regexp_count(F.coalesce("text", F.lit("")), F.lit(shared.WORD)).cast("long"),
        }
    )


def _lookup(values: dict, key):
    """values[key] as an expression over a code list."""
    return F.create_map(*[x for k, v in values.items() for x in (F.lit(k), F.lit(float(v)))])[key]


def _shares(totals: dict, power: float) -> dict:
    tempered = {k: float(v) ** power for k, v in sorted(totals.items()) if v > 0}
    all_ = sum(tempered.values())
    return {k: v / all_ for k, v in tempered.items()}


def _reachable(totals: dict, goals: dict, wanted: float) -> dict:
    """min(total, level * goal) of each group, with the level at which they sum to ``wanted``."""
    level, full = wanted, None
    while full != (now := {k for k in goals if level * goals[k] >= totals[k]}) and len(now) < len(goals):
        full = now
        level = (wanted - sum(totals[k] for k in full)) / sum(v for k, v in goals.items() if k not in full)
    return {k: min(float(totals[k]), level * goals[k]) for k in goals}


def _bounded(rows: DataFrame, base: str, langs: dict, topics: dict, source_goal, wanted: float) -> DataFrame:
    """_source, _lang, _topic, _probability: factors raked under the bound of 1; ``langs`` and ``topics`` are tokens to expect."""
    goal, level, full = source_goal, wanted, -1
    while True:
        over = goal * level >= F.col("tokens")
        n, kept, rest = rows.agg(F.count_if(over), F.sum(F.when(over, F.col("tokens")).otherwise(0)), F.sum(F.when(over, 0.0).otherwise(goal))).first()
        if n == full or not rest:
            break
        full, level = n, (wanted - kept) / rest
    aims = shared.stored(rows.withColumn("aim", F.least(F.col("tokens").cast("double"), goal * level)), "aims", base)
    e, f = dict.fromkeys(langs, 1.0), dict.fromkeys(topics, 1.0)

    def factored():
        """The cells by falling factor, and the source's own factor: those that it lifts to 1 are taken off one by one."""
        falling = F.array_sort(F.transform("cells", lambda x: F.struct((-_lookup(e, x._lang) * _lookup(f, x._topic)).alias("v"), x._lang.alias("_lang"), x._topic.alias("_topic"), x.m.alias("m"))))
        start = F.struct(F.lit(0.0).alias("full"), F.aggregate("falling", F.lit(0.0), lambda acc, x: acc - x.m * x.v).alias("rest"))
        step = lambda acc, x: F.when((F.col("aim") - acc.full) * -x.v >= acc.rest, F.struct((acc.full + x.m).alias("full"), (acc.rest + x.m * x.v).alias("rest"))).otherwise(acc)
        whole = F.col("aim") >= F.col("tokens")
        d = F.when(whole, F.lit(-1.0) / F.element_at("falling", -1).v).otherwise((F.col("aim") - F.col("s").full) / F.col("s").rest)
        solved = aims.withColumn("falling", falling).withColumn("s", F.when(~whole, F.aggregate("falling", start, step))).withColumn("d", d)
        return solved.select("_source", "d", F.inline("falling")).withColumn("u", -F.col("d") * F.col("v"))

    sums = []

    def miss(aims_of, k, by=lambda r: 1.0) -> dict:
        """By group of kind ``k`` the error of its tokens and the factor that would mend it, once ``by`` has scaled the cells."""
        out = {}
        for g, aim in aims_of.items():
            full, rest = sum(r.full for r in sums if r[k] == g), sum(r.rest * by(r) for r in sums if r[k] == g)
            mend = (aim - full) / rest if rest > 0 and aim > full else aim / (full + rest)
            out[g] = abs(full + rest - aim) / aim, min(10.0, max(0.1, mend))
        return out

    for _ in range(BOUNDED_ROUNDS):
        cut = F.col("u") >= 1
        sums = factored().groupBy("_lang", "_topic").agg(F.sum(F.when(cut, F.col("m")).otherwise(0)).alias("full"), F.sum(F.when(cut, 0.0).otherwise(F.col("u") * F.col("m"))).alias("rest")).collect()
        by_lang, by_topic = miss(langs, "_lang"), miss(topics, "_topic")
        if max(x for x, _ in (*by_lang.values(), *by_topic.values())) < BOUNDED_ERROR:
            break
        by_topic = miss(topics, "_topic", lambda r: by_lang[r._lang][1])
        for factors, found in ((e, by_lang), (f, by_topic)):
            for g, (_, mend) in found.items():
                factors[g] = min(1e100, max(1e-100, factors[g] * mend))
    return factored().select("_source", "_lang", "_topic", F.least(F.lit(1.0), F.col("u")).alias("_probability"))


def probabilities(docs: DataFrame, share: float = SHARE, powers: dict | None = None, rounds: int = ROUNDS) -> DataFrame:
    """_source, _lang, _topic, _weight (raked share over observed share), _probability of every cell."""
    powers = powers or POWERS
    base = shared.shared_dir(docs.sparkSession)
    cells = described(docs.select("text", "source", "lang")).groupBy("_source", "_lang", "_topic").agg(F.sum("_tokens").alias("m"))
    cells = shared.stored(cells, "cells", base)
    rows = cells.filter("m > 0").groupBy("_source").agg(F.sum("m").alias("tokens"), F.collect_list(F.struct("_lang", "_topic", "m")).alias("cells"))
    rows = shared.stored(rows, "sources", base)
    if cells.select("_lang").distinct().count() > MOST_LANGS:
        raise ValueError(f"lang holds more than {MOST_LANGS} values")
    of = lambda k: {r[0]: r[1] for r in cells.groupBy(k).agg(F.sum("m")).collect()}
    by_lang, by_topic = of("_lang"), of("_topic")
    langs, topics = _shares(by_lang, powers["lang"]), _shares(by_topic, powers["topic"])
    total, tempered = rows.agg(F.sum("tokens"), F.sum(F.pow(F.col("tokens").cast("double"), F.lit(powers["source"])))).first()
    if not total:
        return cells.select("_source", "_lang", "_topic", F.lit(0.0).alias("_weight"), F.lit(0.0).alias("_probability"))
    target = F.pow(F.col("tokens").cast("double"), F.lit(powers["source"])) / F.lit(tempered)
    b, c = dict.fromkeys(langs, 1.0), dict.fromkeys(topics, 1.0)

    def factored(b, c):
        fit = F.aggregate("cells", F.lit(0.0), lambda acc, x: acc + x.m * _lookup(b, x._lang) * _lookup(c, x._topic))
        return rows.withColumn("a", target / fit)

    for _ in range(rounds):
        sums = factored(b, c).select("a", F.inline("cells")).groupBy("_lang", "_topic").agg(F.sum(F.col("a") * F.col("m")).alias("g")).collect()
        for k in b:
            b[k] = langs[k] / sum(r.g * c[r._topic] for r in sums if r._lang == k)
        for k in c:
            c[k] = topics[k] / sum(r.g * b[r._lang] for r in sums if r._topic == k)
    weight = F.col("a") * _lookup(b, F.col("_lang")) * _lookup(c, F.col("_topic")) * F.lit(float(total))
    fitted = factored(b, c).select("_source", "a", F.inline("cells")).select("_source", "_lang", "_topic", "m", weight.alias("_weight"))
    fitted = shared.stored(fitted, "fitted", base)
    drawn = _bounded(rows, base, _reachable(by_lang, langs, share * total), _reachable(by_topic, topics, share * total), target, share * total)
    return fitted.select("_source", "_lang", "_topic", "_weight").join(drawn, ["_source", "_lang", "_topic"])


def draw(doc_id):
    """A number in [0, 1) that depends on the doc_id alone."""
    return F.conv(F.substring(F.md5(F.concat(F.lit("mix:"), F.coalesce(doc_id.cast("string"), F.lit("null")))), 1, 8), 16, 10).cast("long") / F.lit(float(2**32))


def mixed(docs: DataFrame, share: float = SHARE, powers: dict | None = None) -> DataFrame:
    """``docs`` with _source, _lang, _topic, _tokens, _weight, _probability and _kept."""
    cells = shared.stored(probabilities(docs, share, powers), "probabilities", shared.shared_dir(docs.sparkSession))
    if cells.count() <= BROADCAST_CELLS:
        cells = F.broadcast(cells)
    rows = described(docs.drop("_weight", "_probability", "_kept")).join(cells, ["_source", "_lang", "_topic"], "left").fillna(0.0, ["_weight", "_probability"])
    return rows.withColumn("_kept", draw(F.col("doc_id")) < F.col("_probability"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    r = mixed(docs)
    return r.select(
        "doc_id", F.col("_source").alias("source"), F.col("_lang").alias("lang"), F.col("_topic").alias("topic"), F.col("_tokens").alias("n_tokens"),
        F.round("_weight", 6).alias("weight"), F.round("_probability", 6).alias("probability"), F.col("_kept").alias("kept"),
    )


def sql(share: float = SHARE, powers: dict | None = None, rounds: int = ROUNDS) -> str:
    powers = powers or POWERS
    out = [
        r"""WITH RECURSIVE d AS (SELECT doc_id, coalesce(source, '') AS source, coalesce(lang, '') AS lang, coalesce(text, '') AS text FROM documents),
t AS (SELECT doc_id, source, lang, CAST(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS BIGINT) AS n,
  CASE WHEN (length(text) - length(replace(text, '|', ''))) * 200 >= greatest(length(text), 1) THEN 'lists'
    WHEN (length(text) - length(regexp_replace(text, '[0-9]', '', 'g'))) * 60 >= greatest(length(text), 1) THEN 'figures'
    WHEN contains(text, '@') OR contains(text, 'http') THEN 'letters' ELSE 'prose' END AS topic FROM d),
c AS (SELECT source, lang, topic, CAST(sum(n) AS DOUBLE) AS m FROM t GROUP BY ALL HAVING sum(n) > 0),
"""
    ]
    for k, p in powers.items():
        out.append(f"g_{k} AS (SELECT {k}, pow(sum(m), {p}) / sum(pow(sum(m), {p})) OVER () AS goal FROM c GROUP BY {k}),\n")
    out.append("r0 AS (SELECT c.*, gs.goal AS gs, gl.goal AS gl, gt.goal AS gt, m AS w FROM c JOIN g_source gs USING (source) JOIN g_lang gl USING (lang) JOIN g_topic gt USING (topic)),\n")
    step = 0
    for i in range(rounds + 1):
        for k, goal in (("source", "gs"), ("lang", "gl"), ("topic", "gt"))[: 3 if i < rounds else 1]:
            step += 1
            out.append(f"r{step} AS MATERIALIZED (SELECT * EXCLUDE w, w * {goal} / sum(w) OVER (PARTITION BY {k}) AS w FROM r{step - 1}),\n")
    out.append(f"f AS (SELECT *, w / m * (SELECT sum(m) FROM c) AS x FROM r{step}), want AS (SELECT {share} * sum(m) AS v FROM c),\n")
    for k in powers:  # groups in the order in which they would be kept whole, and the level of the others
        out.append(
            f"""t_{k} AS (SELECT {k}, goal, sum(m) AS tokens FROM c JOIN g_{k} USING ({k}) GROUP BY ALL),
o_{k} AS (SELECT *, tokens / goal AS ends, ((SELECT v FROM want) - (sum(tokens) OVER w - tokens)) / (1 - sum(goal) OVER w + goal) AS level FROM t_{k} WINDOW w AS (ORDER BY tokens / goal, {k})),
aim_{k} AS (SELECT {k}, least(tokens, goal * coalesce((SELECT arg_min(level, ends) FROM o_{k} WHERE level <= ends), tokens / goal)) AS a_{k} FROM t_{k}),
"""
        )
    out.append(
        f"""b AS (SELECT 0 AS step, source, lang, topic, m, x, a_source, a_lang, a_topic, 1.0::DOUBLE AS u FROM f JOIN aim_source USING (source) JOIN aim_lang USING (lang) JOIN aim_topic USING (topic)
UNION ALL SELECT step + 1, source, lang, topic, m, x, a_source, a_lang, a_topic, u * least(10, greatest(0.1, CASE WHEN rest > 0 AND aim > done THEN (aim - done) / rest ELSE aim / (done + rest) END))
  FROM (SELECT *, CASE step % 3 WHEN 0 THEN a_source WHEN 1 THEN a_lang ELSE a_topic END AS aim, sum(CASE WHEN u >= 1 THEN m ELSE 0 END) OVER g AS done, sum(CASE WHEN u >= 1 THEN 0 ELSE u * m END) OVER g AS rest
    FROM b WHERE step < {SQL_STEPS} WINDOW g AS (PARTITION BY CASE step % 3 WHEN 0 THEN source WHEN 1 THEN lang ELSE topic END))),
p AS (SELECT source, lang, topic, x, least(1.0, u) AS p FROM b WHERE step = {SQL_STEPS})
SELECT doc_id, source, lang, topic, n AS n_tokens, coalesce(round(x, 6), 0) AS weight, coalesce(round(p, 6), 0) AS probability,
  CAST('0x' || substr(md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 8) AS BIGINT) / 4294967296.0 < coalesce(p, 0) AS kept
FROM t LEFT JOIN p USING (source, lang, topic)"""
    )
    return "".join(out)
