"""Catalogue queries of duplicates, comparable rows, phrases, paths, intervals and committed reports, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillon import sinks, storage
from quillon.functions import text as T
from quillon.operators import audit, content, similar, statistics, targets
from quillon.plans import fixtures as X
from quillon.plans.fixtures import NORM, load
from quillon.plans.queries import TOKEN, audited, docs, query
from quillon.plans.sources_reports import REPORT, USERS, users
from quillon.sinks import committed

# Fingerprints by counting bits, and all pairs of different fingerprints compared.
PRINTS = f"""t AS (SELECT doc_id, regexp_extract_all({NORM.format('text')}, '{TOKEN}', 1) AS t FROM documents),
g AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(t) > 1 THEN list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1]) ELSE t END) AS f FROM t),
h AS (SELECT doc_id, ('0x' || substr(md5(f), 1, 16))::UBIGINT AS h FROM g), z AS (SELECT doc_id, count(*) AS n FROM h GROUP BY 1),
b AS (SELECT doc_id, bit, sum((h >> bit::UBIGINT) & 1) AS ones FROM h, (SELECT unnest(range(64)) AS bit) GROUP BY ALL),
p AS (SELECT doc_id, sum(CASE WHEN ones * 2 > n THEN 1::UBIGINT << bit::UBIGINT ELSE 0 END)::UBIGINT AS print FROM b JOIN z USING (doc_id) GROUP BY doc_id),
c AS (SELECT print, min(doc_id) AS class_id, count(*) AS copies FROM p GROUP BY 1),
l AS (SELECT a.print AS x, b.print AS y, a.class_id AS cx, b.class_id AS cy, bit_count(xor(a.print, b.print)::BIT)::INTEGER AS distance FROM c a, c b WHERE a.print <> b.print AND bit_count(xor(a.print, b.print)::BIT) <= {similar.BITS})"""


@query("q78_probable_duplicates", f"WITH {PRINTS}, n AS (SELECT x, count(*) AS links FROM l GROUP BY 1) SELECT doc_id, class_id, copies, coalesce(links, 0) AS links FROM p JOIN c USING (print) LEFT JOIN n ON x = print")
def q78(spark, sf):
    return similar.duplicates(docs(spark, sf), "doc_id", "text")


@query("q79_close_fingerprints", f"WITH {PRINTS} SELECT least(cx, cy) AS a, greatest(cx, cy) AS b, distance FROM l WHERE cx < cy")
def q79(spark, sf):
    prints = storage.stored(similar.fingerprints(docs(spark, sf), "doc_id", "text"), "prints")
    ids = prints.groupBy("fingerprint").agg(F.min("doc_id").alias("id"))
    named = lambda c: ids.select(F.col("fingerprint").alias(c), F.col("id").alias(f"{c}_id"))
    pairs = similar.close_pairs(prints).join(named("a"), "a").join(named("b"), "b")
    return pairs.select(F.least("a_id", "b_id").alias("a"), F.greatest("a_id", "b_id").alias("b"), "distance")


@query(
    "q80_comparable_peers",
    """SELECT o.o_orderkey, count(p.o_orderkey) AS peers FROM orders o LEFT JOIN orders p ON p.o_orderpriority = o.o_orderpriority AND p.o_orderkey <> o.o_orderkey AND o.o_totalprice > 0 AND p.o_totalprice > 0
AND abs(date_diff('day', CAST(o.o_orderdate AS DATE), CAST(p.o_orderdate AS DATE))) <= 30 AND p.o_totalprice <= o.o_totalprice * 2 AND o.o_totalprice <= p.o_totalprice * 2 GROUP BY 1""",
)
def q80(spark, sf):
    o = load(spark, sf, "orders").select("o_orderkey", "o_orderpriority", "o_orderdate", F.col("o_totalprice").cast("double").alias("o_totalprice"))
    return statistics.peers(o, "o_orderkey", ["o_orderpriority"], "o_orderdate", "o_totalprice")


_CELL = lambda o, e: f"CASE WHEN {o} > 0 THEN ({o}) * ln(({o}) / ({e})) ELSE 0 END"


@query(
    "q81_collocations",
    f"""WITH t AS (SELECT doc_id, lang, regexp_extract_all({NORM.format('text')}, '{TOKEN}', 1) AS t FROM documents), p AS (SELECT doc_id, lang, t[i] AS x, t[i + 1] AS y FROM (SELECT *, unnest(range(1, len(t))) AS i FROM t)),
n AS (SELECT lang, x, y, count(*) AS n, count(DISTINCT doc_id) AS docs FROM p GROUP BY ALL),
m AS (SELECT *, sum(n) OVER (PARTITION BY lang, x)::DOUBLE AS nx, sum(n) OVER (PARTITION BY lang, y)::DOUBLE AS ny, sum(n) OVER (PARTITION BY lang)::DOUBLE AS a FROM n),
s AS (SELECT lang, x || ' ' || y AS theme, n, docs, round(2 * ({_CELL('n', 'nx * ny / a')} + {_CELL('nx - n', 'nx * (a - ny) / a')} + {_CELL('ny - n', '(a - nx) * ny / a')} + {_CELL('a - nx - ny + n', '(a - nx) * (a - ny) / a')}), 2) AS llr
  FROM m WHERE n >= 5 AND n > nx * ny / a AND NOT regexp_matches(x, '^\\p{{Nd}}+$') AND NOT regexp_matches(y, '^\\p{{Nd}}+$'))
SELECT *, row_number() OVER (PARTITION BY lang ORDER BY docs DESC, n DESC, theme) AS place FROM s WHERE llr >= 10.83 QUALIFY place <= 50""",
)
def q81(spark, sf):
    return statistics.collocations(docs(spark, sf), "lang", "text")


STEPS = ["view", "click", "purchase"]


@query(
    "q82_decision_paths",
    """WITH e AS (SELECT user_id AS buyer, event_type, ts, event_id FROM events),
a AS (SELECT buyer, min((ts, event_id)) FILTER (WHERE event_type = 'view') AS t1 FROM e GROUP BY 1),
b AS (SELECT a.buyer, t1, min((ts, event_id)) FILTER (WHERE event_type = 'click' AND (ts, event_id) > t1) AS t2, count(*) FILTER (WHERE event_type = 'click' AND NOT coalesce((ts, event_id) > t1, false)) AS e2 FROM a JOIN e ON e.buyer = a.buyer GROUP BY a.buyer, t1),
c AS (SELECT b.buyer, t1, t2, e2, min((ts, event_id)) FILTER (WHERE event_type = 'purchase' AND (ts, event_id) > t2) AS t3, count(*) FILTER (WHERE event_type = 'purchase' AND NOT coalesce((ts, event_id) > t2, false)) AS e3 FROM b JOIN e ON e.buyer = b.buyer GROUP BY b.buyer, t1, t2, e2)
SELECT buyer, CASE WHEN t3 IS NOT NULL THEN 3 WHEN t2 IS NOT NULL THEN 2 WHEN t1 IS NOT NULL THEN 1 ELSE 0 END::BIGINT AS completed,
  concat_ws(',', floor((epoch_us(t2[1]) - epoch_us(t1[1])) / 1000000)::BIGINT, floor((epoch_us(t3[1]) - epoch_us(t2[1])) / 1000000)::BIGINT) AS seconds, e2 + e3 AS out_of_order FROM c""",
)
def q82(spark, sf):
    e = load(spark, sf, "events").withColumnRenamed("user_id", "buyer")
    return statistics.decision_path(e, "buyer", STEPS, "event_type", "ts", "event_id").withColumn("seconds", F.array_join(F.col("seconds").cast("array<string>"), ","))


_U = lambda parts: f"('0x' || substr(sha256({parts}), 1, 8))::BIGINT / 4294967296.0"


@query(
    "q83_contrast_intervals",
    f"""WITH {USERS}, r AS (SELECT user_id % 7 AS feature, floor({_U("'block7:' || user_id")} * 256)::BIGINT AS block, stratum FROM s WHERE stratum <> 'middle'),
c AS (SELECT feature, block, count(*) FILTER (WHERE stratum = 'top') AS s, count(*) FILTER (WHERE stratum = 'bottom') AS w FROM r GROUP BY ALL),
d AS (SELECT draw, block, {_U("'draw7:' || draw || ':' || block")} AS u FROM (SELECT unnest(range(200)) AS draw), (SELECT unnest(range(256)) AS block)),
k AS (SELECT draw, block, {" + ".join(f"(u >= {p})::INT" for p in statistics.POISSON)} AS times FROM d),
p AS (SELECT draw, feature, sum(s * times) AS s, sum(w * times) AS w FROM c JOIN k USING (block) WHERE times > 0 GROUP BY ALL),
a AS (SELECT draw, sum(s) AS s, sum(w) AS w FROM p GROUP BY 1),
l AS (SELECT feature, (p.s::DOUBLE * a.w::DOUBLE) / nullif(p.w::DOUBLE * a.s::DOUBLE, 0) AS lift FROM p JOIN a USING (draw)),
i AS (SELECT feature, list(lift ORDER BY lift) FILTER (WHERE lift IS NOT NULL) AS x, count(*) FILTER (WHERE lift <= 1) AS below, count(*) FILTER (WHERE lift >= 1) AS above, count(lift) AS n FROM l GROUP BY 1),
v AS (SELECT feature, x[greatest(ceil(len(x) * 0.025)::INT, 1)] AS low, x[greatest(ceil(len(x) * 0.975)::INT, 1)] AS high, round(CASE WHEN n > 0 THEN least(1.0, 2 * least(below, above)::DOUBLE / n) ELSE 1.0 END, 9) AS p FROM i),
q AS (SELECT feature, low, high, p, min(least(1.0, p * m / upto)) OVER (ORDER BY p DESC RANGE UNBOUNDED PRECEDING) AS q FROM (SELECT *, count(*) OVER () AS m, count(*) OVER (ORDER BY p RANGE UNBOUNDED PRECEDING) AS upto FROM v)),
x AS (SELECT feature, sum(s)::BIGINT AS strong, sum(w)::BIGINT AS weak FROM c GROUP BY 1)
SELECT feature, strong, weak, (strong::DOUBLE * sum(weak) OVER ()::DOUBLE) / nullif(weak::DOUBLE * sum(strong) OVER ()::DOUBLE, 0) AS lift, low, high, q, strong < 10 OR weak < 10 AS limited FROM x LEFT JOIN q USING (feature)""",
)
def q83(spark, sf):
    s = content.strata(users(spark, sf), ["g"], [F.desc("n"), F.asc("user_id")]).withColumn("feature", F.col("user_id") % 7)
    return statistics.contrast_intervals(s, "user_id", "feature")


@query("q84_committed_report", REPORT)
def q84(spark, sf):
    """The report's lines written under one commit and read back."""
    p, g = audited(spark, sf)
    tables = audit.audit(p, g, depth=X.depth(g), relevant=X.relevant(g), letters="éÉ")
    folder = storage.shared_dir(spark)
    committed.write(sinks.report(tables), sinks.exit_codes(tables["summary"]), folder)
    return committed.read(spark, folder)[0]


@query(
    "q85_concepts_of_brands",
    """WITH s AS (SELECT p_brand AS concept, p_partkey % 9 AS criterion, max(p_size % 6) AS score FROM part GROUP BY ALL), t AS (SELECT concept, CAST(sum(score) AS BIGINT) AS total, bool_or(criterion IN (2, 5) AND score = 0) AS stopped, count(*) AS criteria FROM s GROUP BY 1),
r AS (SELECT *, row_number() OVER (PARTITION BY stopped ORDER BY total DESC, concept) AS p FROM t) SELECT concept, total, stopped, criteria, CASE WHEN stopped OR p > 3 THEN 'out' WHEN p = 1 THEN 'main' ELSE 'reserve' END AS role, criteria = 9 AS complete FROM r""",
)
def q85(spark, sf):
    s = load(spark, sf, "part").groupBy(F.col("p_brand").alias("concept"), (F.col("p_partkey") % 9).alias("criterion")).agg(F.max(F.col("p_size") % 6).alias("score"))
    return content.concept_scores(s.withColumn("is_stop", F.col("criterion").isin(2, 5)))


@query(
    "q86_supplemented_groups",
    """WITH g AS (SELECT p_brand AS scope, lower(p_name) AS key, min(p_partkey) AS k FROM part WHERE p_partkey % 2 = 1 GROUP BY ALL), w AS (SELECT g.*, p_name AS word, row_number() OVER (PARTITION BY scope ORDER BY k) AS breadth_rank FROM g JOIN part ON p_partkey = k),
d AS (SELECT p_brand AS scope, lower(p_name) AS key, arg_max(p_type || '; X' || p_size, p_partkey) AS more FROM part WHERE p_partkey % 2 = 0 GROUP BY ALL)
SELECT scope, CAST(breadth_rank AS INTEGER) AS breadth_rank, word, array_to_string(list_sort(list_distinct(list_transform(list_concat([word], CASE WHEN more IS NULL THEN [] ELSE string_split(more, '; ') END), lambda x: lower(x)))), ',') AS forms FROM w LEFT JOIN d USING (scope, key) WHERE breadth_rank <= 12""",
)
def q86(spark, sf):
    """Odd parts are a brand's groups, even ones its depth rows, whose forms join the group of the same word."""
    p = load(spark, sf, "part").select(F.col("p_brand").alias("scope"), F.col("p_partkey").alias("row_ix"), F.col("p_name").alias("word"), "p_type", "p_size")
    g = p.filter("row_ix % 2 = 1").select("scope", "row_ix", "word", F.array("word").alias("forms"))
    d = p.filter("row_ix % 2 = 0").select("scope", "row_ix", F.upper("word").alias("word"), T.split_forms(F.concat("p_type", F.lit("; X"), F.col("p_size").cast("string"))).alias("forms"))
    out = targets.supplemented(targets.ranked(g, 12, ["scope"]), d, ["scope"])
    return out.select("scope", "breadth_rank", "word", F.array_join("forms", ",").alias("forms"))


@query("q87_test_plan_sizes", "SELECT o_custkey, count(*) AS n, count(*) BETWEEN 8 AND 12 AS fits FROM orders GROUP BY 1")
def q87(spark, sf):
    return content.plan_sizes(load(spark, sf, "orders"), "o_custkey")
