"""Catalogue queries of workbooks, charsets, reports and the procedures' tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillon import sinks, storage
from quillon.functions import text as T
from quillon.operators import audit, content, targets
from quillon.plans import fixtures as X
from quillon.plans.fixtures import BASE, load
from quillon.plans.queries import RUN, SUMMARY, answers, audited, docs, query
from quillon.plans.queries import _summary as summary
from quillon.sources import texts, xlsx


def cells(spark, sf, order="workbook"):
    """Stored, since sheets are found, checked and read by several jobs."""
    return storage.stored(xlsx.from_binary(X.workbooks(load(spark, sf, "part")), order), "cells")


PARTS = "b AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS row_ix FROM part)"
_head = lambda names: "[" + ", ".join(f"'{n}'" for n in names) + "]"
CELLS = f"""{PARTS}, v AS (
SELECT p_brand AS file, 0 AS sheet_ix, row_ix, unnest([p_type, NULL, p_size || ',0']) AS value, unnest([false, false, false]) AS is_num, unnest(range(3)) AS col_ix FROM b
UNION ALL SELECT p_brand, 1, row_ix, unnest([' ' || p_name, CASE WHEN p_size % 3 <> 0 THEN CAST(p_size AS VARCHAR) END, CAST(p_size AS VARCHAR), CAST(CAST(floor(p_retailprice) AS BIGINT) AS VARCHAR)]), unnest([false, true, true, true]), unnest(range(4)) FROM b
UNION ALL SELECT p_brand, 2, row_ix, unnest([CASE WHEN p_partkey % 4 <> 0 THEN p_name ELSE '' END, p_type || '; a' || (p_partkey % 5) || ', A' || (p_partkey % 5), CAST(p_partkey % 5 AS VARCHAR), CAST(p_partkey % 3 AS VARCHAR), CAST(p_partkey % 7 AS VARCHAR), CAST(-(p_partkey % 2) AS VARCHAR)]), unnest([false, false, true, true, true, true]), unnest(range(6)) FROM b
UNION ALL SELECT p_brand, 3, row_ix, unnest([p_name, CASE WHEN p_size % 4 <> 0 THEN CASE WHEN p_size % 2 = 0 THEN CAST(p_size // 2 AS VARCHAR) ELSE (p_size // 2) || '.5' END END, CAST(p_partkey AS VARCHAR)]), unnest([false, true, true]), unnest(range(3)) FROM b
UNION ALL SELECT p_brand, s, 0, unnest(h), false, unnest(range(len(h))) FROM (SELECT DISTINCT p_brand FROM part), (VALUES (0, {_head(X.GROUP_HEAD[:3])}), (1, {_head(X.GROUP_HEAD)}), (2, {_head(X.DEPTH_HEAD)}), (3, {_head(X.PHRASE_HEAD)})) t(s, h)),
cells AS (SELECT file, CAST(sheet_ix AS INTEGER) AS sheet_ix, ['Все формы', 'Сводим формы', 'Глубина', 'N-граммы'][sheet_ix + 1] AS sheet, CAST(row_ix AS INTEGER) AS row_ix, CAST(col_ix AS INTEGER) AS col_ix, chr(CAST(65 + col_ix AS INTEGER)) || (row_ix + 1) AS ref, value, is_num FROM v WHERE value IS NOT NULL)"""


def files(spark, sf, order="workbook"):
    """The cells of the brands' workbooks, written as files and read through the data source; a file is named after its brand."""
    folder = storage.shared_dir(spark)
    xlsx.written(X.workbooks(load(spark, sf, "part")), folder)
    xlsx.register(spark)
    return spark.read.format("xlsx_cells").option("order", order).load(folder).withColumn("path", F.col("file")).withColumn("file", F.regexp_extract("file", r"([^/]+)\.xlsx$", 1))


@query("q42_workbook_cells", f"WITH {CELLS} SELECT * FROM cells")
def q42(spark, sf):
    return files(spark, sf).select("file", "sheet_ix", "sheet", "row_ix", "col_ix", "ref", "value", "is_num")


@query("q77_workbook_pushdown", f"WITH {CELLS} SELECT file, row_ix, ref, value FROM cells WHERE sheet = 'Глубина' AND col_ix IN (0, 2)")
def q77(spark, sf):
    """Two columns of one sheet: other sheets aren't opened, other cells not made."""
    return files(spark, sf).filter("sheet = 'Глубина' and col_ix in (0, 2)").select("file", "row_ix", "ref", "value")


@query(
    "q43_workbook_groups",
    f"""WITH {PARTS}, f AS (SELECT p_brand AS file, p_name AS word, min(p_partkey) AS k FROM b GROUP BY ALL), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY file ORDER BY k) AS INTEGER) AS breadth_rank FROM f)
SELECT r.file, breadth_rank, any_value(r.word) AS word, array_to_string(list_sort(list_distinct(list_concat([lower(any_value(r.word))], list(lower(o.p_type))))), '|') AS forms, CAST(CASE WHEN any_value(b.p_size) % 3 <> 0 THEN any_value(b.p_size) END AS DOUBLE) AS median, floor(any_value(b.p_retailprice)) AS analyzer_current
FROM r JOIN b ON b.p_partkey = k JOIN b o ON o.p_brand = file AND o.p_size = b.p_size WHERE breadth_rank <= 12 GROUP BY r.file, breadth_rank""",
)
def q43(spark, sf):
    g = targets.group_table(cells(spark, sf), limit=12)
    return g.withColumn("forms", F.array_join("forms", "|"))


@query(
    "q44_workbook_depth",
    f"""WITH {PARTS} SELECT p_brand AS file, CAST(row_ix AS INTEGER) AS row_ix, p_name AS word, array_to_string(list_sort(list_distinct([lower(p_name), lower(p_type), 'a' || (p_partkey % 5)])), '|') AS forms,
CAST(p_partkey % 5 AS DOUBLE) AS repeats, CAST(p_partkey % 3 AS DOUBLE) AS minimum, CAST(p_partkey % 7 AS DOUBLE) AS maximum, CAST(-(p_partkey % 2) AS DOUBLE) AS delta FROM b WHERE p_partkey % 4 <> 0""",
)
def q44(spark, sf):
    return targets.depth_table(cells(spark, sf)).withColumn("forms", F.array_join("forms", "|"))


@query("q45_workbook_phrases", f"WITH {PARTS} SELECT p_brand AS file, CAST(row_ix AS INTEGER) AS row_ix, p_name AS phrase, p_size / 2.0::DOUBLE AS median, CAST(p_partkey AS DOUBLE) AS analyzer_current FROM b WHERE p_size % 4 <> 0")
def q45(spark, sf):
    return targets.phrase_table(cells(spark, sf))


@query(
    "q46_workbook_dump",
    f"""WITH {CELLS} SELECT file, sheet_ix, row_ix, string_agg(ref || '=' || value, chr(9) ORDER BY col_ix) AS line FROM cells GROUP BY ALL
UNION ALL SELECT DISTINCT file, sheet_ix, -1, 'SHEET ' || sheet || ' (xl/worksheets/sheet' || (sheet_ix + 1) || '.xml)' FROM cells UNION ALL SELECT DISTINCT file, -1, -1, 'FILE ' || file FROM cells""",
)
def q46(spark, sf):
    return xlsx.dump(cells(spark, sf, "part"))


GREETING = "Привет, ёж № "


@query("q47_charset_fallback", f"SELECT c_custkey, '{GREETING}' || c_name AS text FROM customer")
def q47(spark, sf):
    """Names as bytes: UTF-8, UTF-8 with a byte order mark, and the Cyrillic code page in turn."""
    text = F.concat(F.lit(GREETING), "c_name")
    letters = "".join(sorted({c for c in GREETING if ord(c) > 127}))
    cyrillic = F.encode(F.translate(text, letters, letters.encode("cp1251").decode("latin-1")), "ISO-8859-1")
    plain = F.encode(text, "UTF-8")
    k = F.col("c_custkey") % 3
    rows = load(spark, sf, "customer").select("c_custkey", F.when(k == 0, plain).when(k == 1, F.concat(F.lit(b"\xef\xbb\xbf"), plain)).otherwise(cyrillic).alias("content"))
    return rows.select("c_custkey", texts.decoded("content").alias("text"))


def _number_sql(c: str) -> str:
    return f"CASE WHEN {c} IS NULL THEN 'None' WHEN {c} = floor({c}) THEN CAST(CAST({c} AS BIGINT) AS VARCHAR) ELSE CAST({c} AS VARCHAR) END"


def _ratio_sql(c: str) -> str:
    return f"regexp_replace(printf('%.4f', round_even({c}, 4)), '(\\.\\d+?)0+$', '\\1')"


_PAIR = lambda k, a, b, f=lambda c: c: f"'{k}=' || {f(a)} || '->' || {f(b)}"
_LINE = lambda *p: " || chr(9) || ".join(p)
REPORT = f"""{SUMMARY},
wr AS (SELECT pair_id, 1000000000 + breadth_rank AS row_ord, 'LSI ' || word || ': файл=' || before || ', анализатор=1' AS warning FROM st WHERE analyzer_current IS NOT NULL AND analyzer_current <> before
  UNION ALL SELECT pair_id, 2000000000 + breadth_rank, 'Глубина ' || word || ': таблица несинхронна с исходным текстом' FROM dr WHERE NOT synchronized
  UNION ALL SELECT pair_id, 4000000000, 'Релевантная группа не найдена в первых строках: ~missing' FROM pairs),
lines AS (
SELECT pair_id, 0 AS section_ord, 0 AS row_ord, {_LINE("'SUMMARY'", "'lsi_groups=' || raw_groups", "'lsi_over=' || lsi_over", "'breadth_over=' || breadth_over", _PAIR("covered", "raw_covered_before", "raw_covered_after"), _PAIR("width", "raw_width_before", "raw_width_after", _ratio_sql), _PAIR("depth", "raw_depth_before", "raw_depth_after", _ratio_sql), "'negative_groups=' || negative_groups", "'negative_above=' || negative_above", "'minimum_below=' || minimum_below", "'irrelevant_above=0'", "'width_words=0->0/0'", "'introduced_flags=' || introduced_token_flags", "'frame_flags=' || introduced_frame_flags", _PAIR("yo", "source_yo", "edited_yo"), "'facts_missing=' || missing_fact_tokens", "'facts_added=' || added_fact_tokens", "'warnings=' || warnings")} AS line FROM summary
UNION ALL SELECT pair_id, 1, 0, {_LINE("'FILTERED'", "'groups=' || filtered_groups", _PAIR("covered", "filtered_covered_before", "filtered_covered_after"), _PAIR("width", "filtered_width_before", "filtered_width_after", _ratio_sql), _PAIR("depth", "filtered_depth_before", "filtered_depth_after", _ratio_sql))} FROM summary
UNION ALL SELECT pair_id, h.k, -1, replace(h.line, '~', chr(9)) FROM summary, (VALUES {", ".join(f"({k}, '{v.replace(chr(9), '~')}')" for k, v in sinks.HEADINGS.items())}) h(k, line)
UNION ALL SELECT pair_id, 2, breadth_rank, {_LINE("'LSI'", "word", _number_sql("median"), "before", "after", "status")} FROM st WHERE before <> after OR status IN ('over', 'breadth-over')
UNION ALL SELECT pair_id, 3, breadth_rank, {_LINE("'DEPTH'", "word", _number_sql("target"), "before", "after", "status", "synchronized")} FROM dr
UNION ALL SELECT pair_id, 4, breadth_rank, {_LINE("'MINIMUM'", "word", _number_sql("minimum"), "before", "after", "CASE WHEN after >= minimum THEN 'at-least' ELSE 'below' END")} FROM dep WHERE breadth_rank % 2 = 1 AND (before <> after OR after < minimum)
UNION ALL SELECT pair_id, 7, generate_subscripts(missing, 1) - 1, 'FACT' || chr(9) || 'missing' || chr(9) || unnest(missing) FROM fd
UNION ALL SELECT pair_id, 8, generate_subscripts(added, 1) - 1, 'FACT' || chr(9) || 'added' || chr(9) || unnest(added) FROM fd
UNION ALL SELECT pair_id, 9, row_ord, 'WARNING' || chr(9) || warning FROM wr
UNION ALL SELECT pair_id, 9 + k, row_number() OVER (PARTITION BY k, pair_id ORDER BY added DESC, after DESC, pattern), {_LINE("'INTRODUCED'", "['tokens', 'bigrams', 'trigrams'][k]", "pattern", "before", "after", "'+' || added")}
  FROM (SELECT 1 AS k, * FROM i1 UNION ALL SELECT 2, * FROM i2 UNION ALL SELECT 3, * FROM i3))
SELECT pair_id, CAST(section_ord AS INTEGER) AS section_ord, CAST(row_ord AS BIGINT) AS row_ord, line FROM lines"""


@query("q50_report_lines", REPORT)
def q50(spark, sf):
    p, g = audited(spark, sf)
    return sinks.report(audit.audit(p, g, depth=X.depth(g), relevant=X.relevant(g), letters="éÉ"))


@query("q51_json_rows", """SELECT conv_id, to_json({'conv_id': conv_id, 'user': count(*) FILTER (WHERE role = 'user'), 'assistant': count(*) FILTER (WHERE role = 'assistant'), 'first': min(CASE WHEN role = 'user' THEN turn END)}) AS json FROM conversations GROUP BY conv_id""")
def q51(spark, sf):
    c = load(spark, sf, "conversations")
    first = c.groupBy("conv_id").agg(F.min(F.when(F.col("role") == "user", F.col("turn"))).alias("first"))
    return sinks.as_json(content.class_mix(c, ["conv_id"], "role", ["user", "assistant"]).join(first, "conv_id"), "conv_id")


@query("q52_exit_codes", f"{SUMMARY} SELECT pair_id, CAST(lsi_over > 0 OR breadth_over > 0 OR negative_above > 0 OR edited_yo > 0 OR missing_fact_tokens > 0 OR added_fact_tokens > 0 AS INTEGER) AS code FROM summary")
def q52(spark, sf):
    return sinks.exit_codes(summary(spark, sf))


@query(
    "q53_error_records",
    """SELECT page_id, CASE page_id % 5 WHEN 0 THEN to_json({'ok': false, 'error': {'type': 'missing_api_key', 'message': 'the key isn''t set; no request was made'}})
WHEN 1 THEN to_json({'ok': false, 'error': {'type': 'network_error', 'message': 'timed out'}})
WHEN 2 THEN to_json({'ok': false, 'error': {'type': 'http_error', 'message': 'The service returned HTTP 503.', 'status': 503, 'response': 'busy'}})
WHEN 3 THEN to_json({'ok': true, 'answer': NULL, 'sources': [], 'meta': {'id': NULL, 'model': NULL, 'created': NULL, 'usage': NULL}}) ELSE to_json({'ok': false, 'error': {'type': 'invalid_json', 'message': 'the response is not a JSON object'}}) END AS json,
CAST(CASE page_id % 5 WHEN 0 THEN 2 WHEN 3 THEN 0 ELSE 1 END AS INTEGER) AS code FROM pages""",
)
def q53(spark, sf):
    k = F.col("page_id") % 5
    raw = load(spark, sf, "pages").select("page_id", (k != 0).alias("has_key"), F.when(k == 1, "timed out").alias("network_error"), F.when(k == 2, 503).when(k > 2, 200).alias("status"), F.when(k == 2, "busy").when(k == 3, '{"choices":[]}').when(k == 4, "[1]").alias("json"))
    a = texts.answers(raw)
    return sinks.answer_json(a, keep=["page_id"])


USERS = "u AS (SELECT user_id, count(*) AS n, count(*) % 3 AS g, min(ts) AS ts FROM events GROUP BY user_id), s AS (SELECT *, CASE ntile(3) OVER (PARTITION BY g ORDER BY n DESC, user_id) WHEN 1 THEN 'top' WHEN 2 THEN 'middle' ELSE 'bottom' END AS stratum FROM u)"


def users(spark, sf):
    u = load(spark, sf, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("ts"))
    return u.withColumn("g", F.col("n") % 3)


@query("q54_stratified_sample", f"WITH {USERS} SELECT user_id, g, stratum, CAST(row_number() OVER (PARTITION BY g, stratum ORDER BY n DESC, user_id) AS INTEGER) AS place FROM s QUALIFY place <= 4")
def q54(spark, sf):
    return content.stratified_sample(users(spark, sf), ["g"], [F.desc("n"), F.asc("user_id")], 4).select("user_id", "g", "stratum", "place")


@query("q55_feature_contrast", f"WITH {USERS}, c AS (SELECT user_id % 4 AS feature, count(*) FILTER (WHERE stratum = 'top') AS strong, count(*) FILTER (WHERE stratum = 'bottom') AS weak FROM s GROUP BY 1) SELECT feature, strong, weak, (strong / sum(strong) OVER ()) / nullif(weak / sum(weak) OVER (), 0) AS lift, 'observed' AS status FROM c")
def q55(spark, sf):
    s = content.strata(users(spark, sf), ["g"], [F.desc("n"), F.asc("user_id")])
    return content.contrast(s.withColumn("feature", F.col("user_id") % 4), "feature")


CLAIMS = "c AS (SELECT source, lang, count(DISTINCT quality) > 1 AS conflict, count(*) AS n, bool_or(toxic = 1) AS flagged, count(DISTINCT doc_id % 5) AS independent FROM labels JOIN documents USING (doc_id) GROUP BY ALL)"


def claims(spark, sf):
    c = load(spark, sf, "labels").join(docs(spark, sf).select("doc_id", "source", "lang"), "doc_id")
    return c.groupBy("source", "lang").agg((F.countDistinct("quality") > 1).alias("conflict"), F.count(F.lit(1)).alias("n"), F.bool_or(F.col("toxic") == 1).alias("flagged"), F.countDistinct(F.col("doc_id") % 5).alias("independent"))


@query(
    "q56_evidence_and_confidence",
    f"""WITH {CLAIMS} SELECT source, lang, CASE WHEN conflict THEN 'conflicting' WHEN flagged AND independent >= 2 THEN 'confirmed' WHEN independent >= 2 THEN 'observed' WHEN independent = 1 THEN 'reported' ELSE 'hypothesis' END AS status,
CASE WHEN independent >= 3 AND n >= 10 THEN 'high' WHEN independent >= 2 AND n >= 3 THEN 'medium' ELSE 'low' END AS confidence FROM c""",
)
def q56(spark, sf):
    c = claims(spark, sf)
    return c.select("source", "lang", content.evidence_status(F.col("independent"), F.col("flagged"), F.col("conflict")).alias("status"), content.confidence(F.col("independent"), F.col("n")).alias("confidence"))


@query("q57_signal_layers", "SELECT event_id, CASE WHEN event_type = 'error' THEN 'platform' WHEN event_type IN ('view', 'click') THEN 'sample' ELSE 'assumption' END AS layer FROM events")
def q57(spark, sf):
    kind = F.when(F.col("event_type") == "error", "rules").when(F.col("event_type") == "view", "post").when(F.col("event_type") == "click", "metric").otherwise(F.col("event_type"))
    return content.layered(load(spark, sf, "events").withColumn("kind", kind), "kind").select("event_id", "layer")


@query(
    "q58_test_plan",
    """WITH l AS (SELECT *, lag(o_orderstatus) OVER w AS s, lag(o_orderpriority) OVER w AS p, row_number() OVER w AS k FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey))
SELECT o_orderkey, CASE WHEN k = 1 THEN 0 ELSE CAST(s IS DISTINCT FROM o_orderstatus AS BIGINT) + CAST(p IS DISTINCT FROM o_orderpriority AS BIGINT) END AS changed, k = 1 OR (s IS DISTINCT FROM o_orderstatus) <> (p IS DISTINCT FROM o_orderpriority) AS valid FROM l""",
)
def q58(spark, sf):
    return content.changed_one(load(spark, sf, "orders"), "o_custkey", "o_orderkey", ["o_orderstatus", "o_orderpriority"]).select("o_orderkey", "changed", "valid")


MATRIX = "m AS (SELECT p_partkey, CASE WHEN p_size % 5 <> 0 THEN p_name END AS name, CASE WHEN p_size % 3 <> 0 THEN p_type ELSE ' ' END AS type, CASE WHEN p_size % 7 <> 0 THEN p_size END AS size FROM part WHERE p_partkey % 10 <> 3)"


def matrix(spark, sf):
    s = F.col("p_size")
    return load(spark, sf, "part").filter("p_partkey % 10 <> 3").select("p_partkey", F.when(s % 5 != 0, F.col("p_name")).alias("name"), F.when(s % 3 != 0, F.col("p_type")).otherwise(" ").alias("type"), F.when(s % 7 != 0, s).alias("size"))


@query(
    "q59_coverage_matrix",
    f"""WITH {MATRIX}, f AS (SELECT p_partkey, [coalesce(trim(name), '') <> '', coalesce(trim(type), '') <> '', size IS NOT NULL] AS has FROM (SELECT p_partkey FROM part) LEFT JOIN m USING (p_partkey))
SELECT p_partkey, CAST(len(list_filter(has, lambda x: x)) AS BIGINT) AS filled, array_to_string(list_filter([CASE WHEN NOT has[1] THEN 'name' END, CASE WHEN NOT has[2] THEN 'type' END, CASE WHEN NOT has[3] THEN 'size' END], lambda x: x IS NOT NULL), ',') AS missing, has[1] AND has[2] AND has[3] AS complete FROM f""",
)
def q59(spark, sf):
    out = content.coverage_matrix(matrix(spark, sf), "p_partkey", ["name", "type", "size"], load(spark, sf, "part"))
    return out.withColumn("missing", F.array_join("missing", ","))


@query(
    "q60_feature_table",
    f"""WITH {MATRIX}, l AS (SELECT p_partkey, unnest(['name', 'type', 'size']) AS feature, unnest([name, nullif(trim(type), ''), CAST(size AS VARCHAR)]) AS value FROM m)
SELECT p_partkey, feature, value, CASE WHEN value IS NULL THEN 'not coded' WHEN feature = 'type' AND value NOT IN ('ECONOMY', 'STANDARD') THEN 'unknown value' ELSE 'coded' END AS status FROM l""",
)
def q60(spark, sf):
    return content.feature_table(matrix(spark, sf), "p_partkey", {"name": None, "type": ["ECONOMY", "STANDARD"], "size": None})


SUPPLIERS = "s AS (SELECT s_suppkey, s_acctbal >= 5000 AS claimed, s_suppkey % 3 <> 0 AS confirmed, (s_nationkey % 10) / 10.0::DOUBLE AS share, s_nationkey % 4 <> 0 AS affects, s_suppkey % 4 AS n FROM supplier)"


@query(
    "q61_classes",
    f"""WITH {SUPPLIERS} SELECT s_suppkey, CASE WHEN NOT affects THEN 'no effect' WHEN n < 2 THEN 'unproven' WHEN share >= 0.5 THEN 'table stakes' ELSE 'differentiator' END AS differentiator,
CASE WHEN NOT claimed AND confirmed THEN 'unclaimed strength' WHEN NOT claimed THEN 'absent' WHEN NOT confirmed THEN 'unsupported claim' WHEN NOT affects THEN 'irrelevant' WHEN share >= 0.5 THEN 'category norm' ELSE 'confirmed advantage' END AS advantage FROM s""",
)
def q61(spark, sf):
    k, share, affects = F.col("s_suppkey"), (F.col("s_nationkey") % 10) / F.lit(10.0), F.col("s_nationkey") % 4 != 0
    both = content.differentiator_class(affects, share, k % 4), content.advantage_class(F.col("s_acctbal") >= 5000, k % 3 != 0, share, affects)
    return load(spark, sf, "supplier").select("s_suppkey", both[0].alias("differentiator"), both[1].alias("advantage"))


@query(
    "q62_review_profile",
    f"""WITH r AS (SELECT source, doc_id, text, lang, trim(lower(coalesce(text, ''))) AS low, list_sort(list_distinct(regexp_extract_all({X.NORM.format('text')}, '([\\p{{L}}\\p{{N}}_](?:[\\p{{L}}\\p{{N}}_-]*[\\p{{L}}\\p{{N}}_])?)', 1))) AS t FROM documents),
h AS (SELECT source, theme, count(*) AS n FROM r, (VALUES ('articles', ['the', 'der', 'le']), ('links', ['and', 'und'])) w(theme, words) WHERE list_has_any(t, words) GROUP BY ALL),
g AS (SELECT source, string_agg(theme || '=' || n, ',' ORDER BY theme) AS themes FROM h GROUP BY 1), l AS (SELECT source, lang, count(*) AS n FROM r GROUP BY ALL), m AS (SELECT source, string_agg(lang || '=' || n, ',' ORDER BY lang) AS stages FROM l GROUP BY 1)
SELECT source, count(*) AS n, min(doc_id) AS first, max(doc_id) AS last, count(*) - count(DISTINCT regexp_replace(low, '\\s+', ' ', 'g')) AS repeats, count(*) - count(DISTINCT array_to_string(t, ' ')) AS near_copies, themes, stages FROM r LEFT JOIN g USING (source) LEFT JOIN m USING (source) GROUP BY ALL""",
)
def q62(spark, sf):
    words = spark.createDataFrame([("articles", w) for w in ("the", "der", "le")] + [("links", w) for w in ("and", "und")], "theme string, word string")
    shown = lambda c: F.array_join(F.transform(F.array_sort(F.map_entries(c)), lambda e: F.concat(e.key, F.lit("="), e.value.cast("string"))), ",").alias(c)
    out = content.review_profile(docs(spark, sf), ["source"], "text", "doc_id", words, "lang")
    return out.select("source", "n", "first", "last", "repeats", "near_copies", shown("themes"), shown("stages"))


@query(
    "q63_search_gate",
    """WITH a AS (SELECT page_id, url, page_id % 5 >= 3 AS failed, page_id % 5 < 3 AS said FROM pages), g AS (SELECT page_id, failed, NOT said OR NOT contains(lower(url), 'example') AS other_brand, NOT said OR NOT regexp_matches(lower(url), '^https?://([^/]*\\.)?(example\\.com)(/|$)') AS no_primary_source,
  CASE WHEN said AND contains(lower(url), 'page') THEN '' ELSE 'page' END || CASE WHEN said AND contains(lower(url), 'http') THEN '' ELSE '|http' END AS lost, page_id % 7 = 0 AS contradicted FROM a)
SELECT page_id, failed, other_brand, no_primary_source, ltrim(lost, '|') AS missing_categories, contradicted, ltrim(lost, '|') = 'page|http' AS too_little, NOT failed AND NOT other_brand AND NOT no_primary_source AND NOT contradicted AND lost = '' AS sufficient FROM g""",
)
def q63(spark, sf):
    p = load(spark, sf, "pages")
    a = texts.answers(answers(p))
    wrong = p.filter("page_id % 7 = 0").select(F.col("page_id").alias("key"))
    out = content.search_gate(a, ["page", "http"], "Example", ["example.com"], wrong)
    return out.select(F.col("key").alias("page_id"), "failed", "other_brand", "no_primary_source", F.array_join("missing_categories", "|").alias("missing_categories"), "contradicted", "too_little", "sufficient")


@query("q64_cover_text", f"SELECT p_partkey, len(regexp_extract_all(lower(p_name || CASE WHEN p_size % 3 = 0 THEN '' ELSE ' ' || p_type || ' of ' || p_brand || ', ' || p_size END), '{RUN}')) BETWEEN 2 AND 5 AS fits FROM part")
def q64(spark, sf):
    text = F.concat("p_name", F.when(F.col("p_size") % 3 == 0, "").otherwise(F.concat(F.lit(" "), "p_type", F.lit(" of "), "p_brand", F.lit(", "), F.col("p_size").cast("string"))))
    return load(spark, sf, "part").select("p_partkey", content.cover_text_fits(T.tokens(T.normalize(text))).alias("fits"))


@query("q65_complete_chain", "WITH h AS (SELECT user_id, list_distinct(list(event_type)) AS have FROM events GROUP BY 1) SELECT user_id, array_to_string(list_filter(['signup', 'view', 'click', 'purchase'], lambda x: NOT list_contains(have, x)), ',') AS missing, list_has_all(have, ['signup', 'view', 'click', 'purchase']) AS complete FROM h")
def q65(spark, sf):
    out = content.complete_chain(load(spark, sf, "events"), "user_id", ["signup", "view", "click", "purchase"], "event_type")
    return out.withColumn("missing", F.array_join("missing", ","))


@query("q66_sample_sizes", "SELECT lang, source, count(*) AS n, count(*) < 50 AS limited FROM documents GROUP BY ALL")
def q66(spark, sf):
    return content.enough(docs(spark, sf), ["lang", "source"])


@query("q67_usage_totals", "SELECT CAST(0 AS BIGINT) AS prompt_tokens, CAST(0 AS BIGINT) AS completion_tokens, CAST(sum(page_id * 2) FILTER (WHERE page_id % 5 < 3) AS BIGINT) AS total_tokens FROM pages")
def q67(spark, sf):
    return content.usage_totals(texts.answers(answers(load(spark, sf, "pages"))))


@query(
    "q68_aligned_claims",
    """WITH s AS (SELECT l_partkey, count(*) FILTER (WHERE l_returnflag <> 'R') AS agree, count(*) FILTER (WHERE l_returnflag = 'R') AS contradict, count(DISTINCT l_suppkey) AS competitors FROM lineitem GROUP BY 1)
SELECT p_partkey, coalesce(agree, 0) AS agree, coalesce(contradict, 0) AS contradict, coalesce(competitors, 0) AS competitors, coalesce(contradict > agree, false) AS gap FROM part LEFT JOIN s ON l_partkey = p_partkey""",
)
def q68(spark, sf):
    li = load(spark, sf, "lineitem").select(F.col("l_partkey").alias("p_partkey"), (F.col("l_returnflag") != "R").alias("agrees"), F.col("l_suppkey").alias("name"))
    return content.aligned_claims(load(spark, sf, "part").select("p_partkey"), li, li, "p_partkey")


@query("q69_comparable_periods", "SELECT o_orderkey, CAST(date_trunc('month', o_orderdate) AS DATE) AS period, CASE WHEN o_totalprice > 0 THEN CAST(floor(log2(o_totalprice)) AS BIGINT) ELSE -1 END AS audience_power, count(*) OVER (PARTITION BY o_orderpriority, period, audience_power) AS peers FROM orders")
def q69(spark, sf):
    return content.comparable(load(spark, sf, "orders"), ["o_orderpriority"], "o_orderdate", "o_totalprice").select("o_orderkey", "period", "audience_power", "peers")


@query(
    "q70_claim_cards",
    """SELECT CASE WHEN doc_id % 11 <> 0 THEN lang END AS claim, ['confirmed', 'rumour', 'reported', ''][doc_id % 4 + 1] AS status, source, ['high', 'sure', NULL][doc_id % 3 + 1] AS confidence,
array_to_string(list_filter([CASE WHEN doc_id % 11 = 0 THEN 'no claim' END, CASE WHEN doc_id % 4 = 3 THEN 'no status' END, CASE WHEN coalesce(trim(source), '') = '' THEN 'no source' END, CASE WHEN doc_id % 4 = 1 THEN 'unknown status' END, CASE WHEN doc_id % 3 = 1 THEN 'unknown confidence' END], lambda x: x IS NOT NULL), ',') AS problems FROM documents""",
)
def q70(spark, sf):
    k = F.col("doc_id")
    rows = docs(spark, sf).select(
        F.when(k % 11 != 0, F.col("lang")).alias("claim"), F.get(F.array(*map(F.lit, ("confirmed", "rumour", "reported", ""))), (k % 4).cast("int")).alias("status"), "source",
        F.when(k % 3 == 0, "high").when(k % 3 == 1, "sure").alias("confidence"), F.lit("yesterday").alias("date"),
    )
    return content.claim_cards(rows).select("claim", "status", "source", "confidence", F.array_join("problems", ",").alias("problems"))


@query(
    "q71_sync_checks",
    f"""{BASE}, d AS (SELECT scope, breadth_rank, word, CASE WHEN breadth_rank % 3 = 0 THEN 2.0 ELSE 1.0 END AS repeats, median AS maximum, CASE WHEN breadth_rank % 2 = 0 THEN -1.0 END AS delta, median + CASE WHEN breadth_rank % 6 = 1 THEN 1 ELSE 0 END AS median FROM groups WHERE median IS NOT NULL)
SELECT scope, word, 'repeats + delta differs from maximum' AS "check" FROM d WHERE repeats + delta <> maximum UNION ALL SELECT d.scope, d.word, 'median differs between tables' FROM d JOIN groups g USING (scope, word) WHERE d.median <> g.median""",
)
def q71(spark, sf):
    g = audited(spark, sf)[1]
    d = X.depth(g).withColumn("median", F.col("maximum") + F.when(F.col("row_ix") % 6 == 1, 1).otherwise(0))
    return audit.sync_checks(d, g)


@query("q72_checked_totals", "WITH h AS (SELECT p_brand, count(*) AS n FROM part GROUP BY 1), g AS (SELECT p_brand, n + CASE WHEN n % 3 = 0 THEN 1 ELSE 0 END AS given FROM h WHERE p_brand <> 'Brand#1' UNION ALL SELECT 'Brand#none', 5) SELECT p_brand, n, given, coalesce(n = given, false) AS agrees FROM h FULL JOIN g USING (p_brand)")
def q72(spark, sf):
    have = content.shares(load(spark, sf, "part"), "p_brand")
    given = have.filter("p_brand <> 'Brand#1'").select("p_brand", F.when(F.col("n") % 3 == 0, F.col("n") + 1).otherwise(F.col("n")).alias("n")).unionByName(spark.createDataFrame([("Brand#none", 5)], "p_brand string, n long"))
    return content.check_totals(have, given, "p_brand")


@query(
    "q73_brief_lines",
    """WITH n AS (SELECT c_mktsegment, count(*) AS n FROM customer GROUP BY 1), s AS (SELECT r_regionkey, replace(r_name, 'A', '|') AS r_name FROM region)
SELECT 1 AS section_ord, x.k AS row_ord, x.line FROM (VALUES (-5, ''), (-4, '## Segments'), (-3, ''), (-2, '| c_mktsegment | n |'), (-1, '|---|---|')) x(k, line) UNION ALL SELECT 1, row_number() OVER (ORDER BY n DESC, c_mktsegment) - 1, '| ' || c_mktsegment || ' | ' || n || ' |' FROM n
UNION ALL SELECT 2, x.k, x.line FROM (VALUES (-5, ''), (-4, '## Regions'), (-3, ''), (-2, '| r_regionkey | r_name |'), (-1, '|---|---|')) x(k, line) UNION ALL SELECT 2, row_number() OVER (ORDER BY r_regionkey) - 1, '| ' || r_regionkey || ' | ' || replace(r_name, '|', '\\|') || ' |' FROM s""",
)
def q73(spark, sf):
    n = load(spark, sf, "customer").groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("n"))
    r = load(spark, sf, "region").select("r_regionkey", F.replace("r_name", F.lit("A"), F.lit("|")).alias("r_name"))
    return sinks.brief({"Segments": n, "Regions": r}, {"Segments": [F.desc("n"), F.asc("c_mktsegment")]})


@query(
    "q74_routes_with_overrides",
    """SELECT doc_id, coalesce(CASE WHEN doc_id % 13 = 0 THEN 'standard' END, CASE WHEN doc_id % 7 = 0 THEN 'complex' WHEN n_chars > 6000 THEN 'complex' WHEN doc_id % 3 = 0 THEN 'simple' WHEN doc_id % 3 = 1 THEN 'standard' WHEN n_chars <= 2500 THEN 'simple' ELSE 'standard' END) AS route FROM documents""",
)
def q74(spark, sf):
    k = F.col("doc_id")
    kind = F.when(k % 3 == 0, "translation").when(k % 3 == 1, "comparison")
    return docs(spark, sf).select("doc_id", T.route_by_length("n_chars", kind=kind, quality_first=k % 7 == 0, asked=F.when(k % 13 == 0, "standard")).alias("route"))
