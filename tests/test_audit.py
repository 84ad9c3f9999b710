import json
import re

import pytest
from pyspark.sql import functions as F

from quillon import sinks, storage
from quillon.functions import text as T
from quillon.operators import audit, content
from quillon.plans import fixtures
from quillon.sinks import committed
from quillon.streaming import audit_stream, pairs_from_files, without_repeats

PAIR = "pair_id long, scope string, source_text string, edited_text string"


@pytest.mark.parametrize("median,before,after,want", [(2.0, 0, 3, "over"), (2.0, 0, 2, "at"), (2.0, 0, 0, "under"), (0.0, 1, 3, "breadth-over"), (None, 0, 1, "covered"), (None, 2, 0, "uncovered"), (None, 5, 5, "covered")])
def test_group_status(spark, median, before, after, want):
    df = spark.createDataFrame([(median, before, after)], "median double, before long, after long")
    assert df.select(audit.group_status()).first()[0] == want


@pytest.mark.parametrize(
    "delta,maximum,repeats,before,want",
    [(-2.0, 3.0, 5.0, 5, (True, 3.0)), (-2.0, 3.0, 5.0, 4, (False, 2.0)), (-2.0, None, 5.0, 5, (True, 3.0)), (-9.0, None, None, 4, (False, 0.0)), (None, 3.0, None, 5, (False, 3.0)), (0.0, 3.0, None, 3, (False, None))],
)
def test_depth_target(spark, delta, maximum, repeats, before, want):
    df = spark.createDataFrame([(delta, maximum, repeats, before)], "delta double, maximum double, repeats double, before long")
    assert tuple(df.select(*audit.depth_target()).first()) == want


def test_coverage(spark):
    rows = spark.createDataFrame([(2.0, 0, 5), (4.0, 0, 1), *[(None, 0, 0)] * 30], "median double, before long, after long")
    r = rows.agg(*audit.coverage(None, [])).first()
    assert (r.groups, r.median_groups, r.covered_after, r.width_before, r.width_after, r.depth_after) == (32, 2, 2, 0.0, 2 / 32, 0.5)
    e = rows.filter("false").agg(*audit.coverage(None, [])).first()
    assert (e.width_before, e.depth_before) == (0.0, 0.0)


def test_introduced(spark):
    p = spark.createDataFrame([(1, "s", "a b", "красный красный красный"), (2, "s", "x x", "x x x"), (3, "s", "", "12 12 12 и и и и"), (4, "s", None, None)], PAIR)
    assert [tuple(r) for r in audit.introduced(p, 1).collect()] == [(1, "красный", 0, 3, 3)]
    assert {(r.pair_id, r.pattern, r.added) for r in audit.introduced(p, 2).collect()} == {(1, "красный красный", 2), (3, "12 12", 2), (3, "и и", 3)}
    assert {(r.pair_id, r.pattern) for r in audit.introduced(p, 3).collect()} == {(3, "и и и")}


def test_facts(spark):
    p = spark.createDataFrame([(1, "s", "12,5 см и 50%", "13 см и 50%"), (2, "s", None, "7 ₽")], PAIR)
    assert [(r.missing, r.added) for r in audit.fact_diff(p).orderBy("pair_id").collect()] == [(["12", "5"], ["13"]), ([], ["7", "₽"])]


def small(spark):
    pairs = spark.createDataFrame([(1, "s", "Душ душа. Кран 5", "Душ душ душ душ кран. Ёлка 6"), (2, "s", "душ", "душ")], PAIR)
    groups = spark.createDataFrame([("s", 1, "душ", ["душ", "душа"], 2.0, 7.0), ("s", 2, "кран", ["кран"], None, None), ("s", 3, "нет", ["нет"], 1.0, None)], "scope string, breadth_rank int, word string, forms array<string>, median double, analyzer_current double")
    depth = spark.createDataFrame([("s", 1, "душ", ["душ"], 1.0, 1.0, 2.0, None), ("s", 2, "кран", ["кран"], 1.0, 2.0, 3.0, -1.0)], "scope string, row_ix int, word string, forms array<string>, repeats double, minimum double, maximum double, delta double")
    phrases = spark.createDataFrame([("s", 1, "душ душ", 1.0), ("s", 2, "никогда", 1.0)], "scope string, row_ix int, phrase string, median double")
    unwanted = spark.createDataFrame([("s", 1, "ёлка", 1, 0)], "scope string, row_ix int, form string, reported_current int, target int")
    width = spark.createDataFrame([("s", 1, "кран"), ("s", 2, "ничего")], "scope string, row_ix int, word string")
    relevant = spark.createDataFrame([("s", "душ"), ("s", "пропало")], "scope string, key string")
    return pairs, dict(groups=groups, depth=depth, phrases=phrases, irrelevant=unwanted, width=width, relevant=relevant)


def test_whole_audit(spark):
    pairs, targets = small(spark)
    out = audit.audit(pairs, **targets)
    s = {r.pair_id: r.asDict() for r in out["summary"].collect()}
    assert (s[1]["lsi_over"], s[1]["raw_groups"], s[1]["filtered_groups"], s[1]["edited_yo"], s[1]["missing_fact_tokens"], s[1]["irrelevant_above"], s[1]["failed"]) == (1, 3, 1, 1, 1, 1, True)
    assert (s[1]["raw_depth_before"], s[1]["raw_depth_after"]) == (2 / 3, 2 / 3)
    assert s[2]["failed"] is False and s[2]["missing_fact_tokens"] == 0 and s[2]["introduced_token_flags"] == 0
    assert {(r.word, r.status) for r in out["minimum"].filter("pair_id = 1").collect()} == {("душ", "at-least")}
    said = [r.warning for r in out["warnings"].filter("pair_id = 1").orderBy("kind_ord", "row_ord").collect()]
    assert said == ["LSI душ: файл=2, анализатор=7", "Нерелевантное ёлка: файл=0, анализатор=1", "Релевантная группа не найдена в первых строках: пропало"]
    lines = [r.line for r in sinks.report(out).filter("pair_id = 1").orderBy("section_ord", "row_ord").collect()]
    assert lines[0].startswith("SUMMARY\tlsi_groups=3\tlsi_over=1\tbreadth_over=0\tcovered=2->2\twidth=0.6667->0.6667\tdepth=0.6667->0.6667")
    assert "LSI\tдуш\t2\t2\t4\tover" in lines and "FACT\tmissing\t5" in lines and "INTRODUCED\ttokens\tдуш\t1\t4\t+3" in lines
    assert {r.pair_id: r.code for r in sinks.exit_codes(out["summary"]).collect()} == {1: 1, 2: 0}
    got = json.loads(sinks.nested_json({k: out[k] for k in ("summary", "groups", "facts")}).filter("pair_id = 1").first().json)
    assert got["summary"]["lsi_over"] == 1 and len(got["groups"]) == 3


def test_text_against_itself(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(20)
    pairs = docs.select(F.col("doc_id").alias("pair_id"), F.col("lang").alias("scope"), F.col("text").alias("source_text"), F.col("text").alias("edited_text"))
    g = fixtures.groups(docs, 20)
    rows = audit.group_rows(pairs, g)
    assert rows.filter("before <> after").count() == 0
    assert audit.introduced(pairs, 1).count() == 0 and audit.fact_diff(pairs).filter("size(missing) + size(added) > 0").count() == 0
    c = rows.groupBy("pair_id").agg(*audit.coverage(None, [])).collect()
    assert all(0 <= r.width_after <= 1 and 0 <= r.depth_after <= 1 for r in c)


def test_words_of_an_edited_text_in_another_language_count(spark):
    """A run that only a text of another language has belongs to the stem's group of the source's language."""
    head = "station statio " + "x" * fixtures.KEY
    docs = spark.createDataFrame([(1, head + " one", "en"), (2, head + " stationär statten stationär", "de"), (3, "statut", "de")], "doc_id long, text string, lang string")
    g = fixtures.groups(docs, 20)
    got = {(r.scope, r.word): (r.forms, r.median) for r in g.collect()}
    assert got["en", "statio"] == (["statio", "station", "stationär", "statten"], 2.0) and got["de", "stationär"] == (["statio", "station", "stationär", "statten", "statut"], 3.0)
    rows = audit.group_rows(fixtures.pairs(docs), g).filter("word = 'statio'").collect()
    assert [(r.pair_id, r.scope, r.before, r.after) for r in rows] == [(2, "en", 2, 5)]


def test_warnings_count_the_texts_once(spark, monkeypatch):
    from quillon import catalogue

    calls, count = [], audit._counts
    monkeypatch.setattr(audit, "_counts", lambda *a: calls.append(1) or count(*a))
    catalogue.queries()["q16_warnings"](spark, "/root/testdata/sf0.001")
    assert len(calls) == 1


def test_verdict(spark):
    names = ["lsi_over", "breadth_over", "negative_above", "irrelevant_above", "edited_yo", "missing_fact_tokens", "added_fact_tokens", "minimum_below"]
    df = spark.createDataFrame([tuple(int(k == j) * 3 for k in range(8)) for j in range(8)], ", ".join(f"{n} long" for n in names))
    assert [r[0] for r in df.select(audit.verdict()).collect()] == [True] * 7 + [False]


def test_streamed_audit(spark, tmp_path):
    pairs, targets = small(spark)
    pairs.write.json(str(tmp_path / "in"))
    q = audit_stream(pairs_from_files(spark, str(tmp_path / "in")), {"groups": targets["groups"]}, str(tmp_path / "out"), str(tmp_path / "ck"))
    q.awaitTermination(120)
    assert {r.pair_id: r.lsi_over for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {1: 1, 2: 0}


def test_repeated_requests(spark, tmp_path):
    made = [(1, "a", "2024-01-01 00:00:00"), (2, "a", "2024-01-01 00:14:00"), (3, "a", "2024-01-01 00:40:00"), (4, "b", "2024-01-01 00:14:00")]
    df = spark.createDataFrame(made, "id int, k string, t string").withColumn("ts", F.col("t").cast("timestamp"))
    assert {r.id: r.reused for r in content.repeated_requests(df.select("id", "k", "ts"), ["k"], "ts").collect()} == {1: False, 2: True, 3: False, 4: False}
    df.filter("id <> 3").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = without_repeats(stream, ["k"], "ts").writeStream.format("memory").queryName("kept").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(r.k for r in spark.table("kept").collect()) == ["a", "b"]


def test_content_rules(spark):
    m = spark.createDataFrame([("a", "x", None), ("b", "x", "y")], "c string, p string, q string")
    wanted = spark.createDataFrame([("a",), ("b",), ("z",)], "c string")
    assert {r.c: (r.filled, r.missing, r.complete) for r in content.coverage_matrix(m, "c", ["p", "q"], wanted).collect()} == {"a": (1, ["q"], False), "b": (2, [], True), "z": (0, ["p", "q"], False)}
    plan = spark.createDataFrame([("s", 1, "a", "b"), ("s", 2, "a", "c"), ("s", 3, "x", "y")], "s string, k int, p string, q string")
    assert [(r.changed, r.valid) for r in content.changed_one(plan, "s", "k", ["p", "q"]).orderBy("k").collect()] == [(0, True), (1, True), (2, False)]
    one = spark.range(1)
    pick = lambda c: one.select(c).first()[0]
    n = F.lit
    assert [pick(content.evidence_status(n(a), n(b), n(c))) for a, b, c in ((2, True, False), (2, False, False), (1, True, False), (0, False, False), (5, True, True))] == ["confirmed", "observed", "reported", "hypothesis", "conflicting"]
    assert [pick(content.confidence(n(a), n(b))) for a, b in ((3, 10), (2, 3), (1, 99))] == list(content.CONFIDENCE)
    assert pick(content.differentiator_class(n(True), n(0.1), n(5))) == "differentiator"
    assert pick(content.advantage_class(n(True), n(True), n(0.1), n(True))) == "confirmed advantage"
    assert pick(content.cover_text_fits(F.array(n("a"), n("b")))) is True
    e = spark.createDataFrame([("f", "top"), ("f", "top"), ("g", "bottom"), ("f", "bottom")], "feature string, stratum string")
    assert {r.feature: r.lift for r in content.contrast(e, "feature").collect()} == {"f": 2.0, "g": 0.0}
    assert content.enough(e, ["feature"], 2).filter("limited").count() == 1
    r = content.rates(spark.createDataFrame([("a", 0, 1), ("b", 500, 2)], "k string, v int, c int"), ["k"], "v", ["c"]).collect()
    assert {x.k: x.c_rate for x in r} == {"a": None, "b": 4.0}


ANSWERS = [
    (1, '{"id":"a","model":"m","created":7,"choices":[{"message":{"content":"text one"}}],"search_results":[{"title":"t1","url":"u1"},{"url":"u1"},{"url":""},"x",{"url":"u2","date":"2024-01-01"}],"citations":["u2","u3",5],"usage":{"total_tokens":9}}'),
    (2, '{"choices":[]}'),
    (3, "not json"),
]


def test_answers(spark):
    from quillon import sinks
    from quillon.sources import texts

    a = texts.answers(spark.createDataFrame(ANSWERS, "key int, json string"))
    first = a.filter("key = 1").first()
    assert [(s.url, s.source) for s in first.sources] == [("u1", None), ("u2", None), ("u3", "citation")] and first.sources[0].title == "t1"
    gate = {r.key: (r.sufficient, r.failed, r.no_primary_source, r.missing_categories) for r in content.search_gate(a, ["Text"]).collect()}
    assert gate == {1: (True, False, False, []), 2: (False, True, True, ["Text"]), 3: (False, True, True, ["Text"])}
    assert not content.search_gate(a, ["Text"], "Other").filter("key = 1").first().sufficient
    assert content.usage_totals(a).first().total_tokens == 9
    assert [r.code for r in sinks.answer_json(a, keep=["key"]).orderBy("key").collect()] == [0, 0, 1]
    failed = spark.createDataFrame([(1, "", 429, None, True), (2, None, None, None, False), (3, None, None, "timed out", True)], "key int, json string, status int, network_error string, has_key boolean")
    got = [json.loads(r.json)["error"]["type"] for r in sinks.answer_json(texts.answers(failed), keep=["key"]).orderBy("key").collect()]
    assert got == ["http_error", "missing_api_key", "network_error"]


def test_missing_category_and_totals(spark):
    have = content.shares(spark.createDataFrame([("a",), ("a",), ("b",)], "c string"), "c")
    want = spark.createDataFrame([("a",), ("z",)], "c string")
    assert sorted(map(tuple, content.gaps(have, want, "c").collect())) == [("b", "not wanted"), ("z", "missing")]
    given = spark.createDataFrame([("a", 2), ("z", 1)], "c string, n long")
    assert {r.c: (r.n, r.given, r.agrees) for r in content.check_totals(have, given, "c").collect()} == {"a": (2, 2, True), "b": (1, None, False), "z": (None, 1, False)}


def test_themes_rank_like_a_window(spark):
    import random

    r = random.Random(4)
    rows = [(r.choice("ab"), "".join(r.choices("xyz", k=r.randrange(1, 5)))) for _ in range(900)]
    got = {(x.c, x.theme): (x.n, x.place) for x in content.themes(spark.createDataFrame(rows, "c string, theme string"), "c", "theme", 2).collect()}
    want = {}
    for c in "ab":
        n = {}
        for k, t in rows:
            n[t] = n.get(t, 0) + (k == c)
        for place, (t, x) in enumerate(sorted(((t, x) for t, x in n.items() if x >= 2), key=lambda e: (-e[1], e[0])), 1):
            want[c, t] = (x, place)
    assert got == want


def test_introduced_patterns_are_counted_where_the_texts_are(spark, monkeypatch):
    """No n-gram is shuffled; rows that share a pair_id, null too, are one pair wherever they lie; tasks grow in number with the texts."""
    rows = [(1, "", "a b"), (2, "x x", "x x x x"), (1, None, "a b"), (None, "", "c d"), (None, "", "c d")]
    p = spark.createDataFrame(rows, "pair_id long, source_text string, edited_text string").repartition(4)
    monkeypatch.setattr(storage, "SHARE", 1)
    out = audit.introduced_patterns(p, (1, 2))
    assert {tuple(r) for r in out.collect()} == {(2, 2, "x x", 1, 3, 2), (2, 1, "x", 2, 4, 2), (1, 2, "a b", 0, 2, 2), (None, 2, "c d", 0, 2, 2)}
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" not in plan and "Generate" not in plan and out.rdd.getNumPartitions() > 4


def test_pairs_are_found_without_their_texts(spark, monkeypatch):
    """Keys are grouped by digests of texts; no text is an aggregate, which would be sorted whole."""
    plans, whole = {}, storage.stored
    monkeypatch.setattr(storage, "stored", lambda df, name, base=None: plans.setdefault(name, df._jdf.queryExecution().executedPlan().toString()) and whole(df, name, base))
    head = "k" * fixtures.KEY
    rows = [(3, head + "b", "en"), (1, head + "a", "en"), (2, head + "a", "de"), (4, "short", "en"), (5, "l" * fixtures.KEY, "en"), (6, "l" * fixtures.KEY, "en"), (7, None, "en")]
    got = fixtures.pairs(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert {tuple(r) for r in got.collect()} == {(3, "en", head + "a", head + "b"), (2, "en", head + "a", head + "a")}
    assert "min(text" not in plans["first"] and "SortAggregate" not in plans["first"]


def test_a_report_works_out_nothing_twice(spark, tmp_path, monkeypatch):
    """Facts, counts and the summary are stored, items with equal forms are counted once, and lines are made once before they are dealt out."""
    plans, whole = {}, storage.stored
    monkeypatch.setattr(storage, "stored", lambda df, name, base=None: plans.setdefault(name, []).append(df._jdf.queryExecution().optimizedPlan().toString()) or whole(df, name, base))
    pairs, targets = small(spark)
    targets["depth"] = targets["depth"].withColumn("forms", F.when(F.col("row_ix") == 2, F.array(F.lit("кран"))).otherwise(F.array(F.lit("душ"), F.lit("душа"))))
    out = audit.audit(pairs, **targets)
    assert all(len(plans[name]) == 1 for name in ("facts", "grid", "units", "summary"))
    assert "₽" not in sinks.report(out)._jdf.queryExecution().optimizedPlan().toString()  # no text is searched for facts
    both = {r.row_ix: (r.before, r.after) for r in out["minimum"].select("row_ix", "before", "after", "pair_id").unionByName(out["depth"].select("row_ix", "before", "after", "pair_id")).filter("pair_id = 1").collect()}
    assert both == {1: (2, 4), 2: (1, 1)}
    committed.write(sinks.report(out), sinks.exit_codes(out["summary"]), f"file://{tmp_path}/report")
    lines, code = committed.read(spark, f"file://{tmp_path}/report")
    assert len(plans["lines"]) == 1 and code == 1
    assert lines.filter("pair_id = 1 and section_ord = 0").first().line.startswith("SUMMARY\tlsi_groups=3\tlsi_over=1\t")


def test_facts_are_found_past_what_lies_between(spark):
    """Words, signs and digits of other scripts beside tokens, and a text too long for a token to be tried at each letter."""
    rows = [("ab1c-2 x%₽9 яя٣б é5 a-1 1२x", ["%", "1", "2x", "5", "9", "ab1c-2", "яя٣б", "₽"])]
    got = spark.createDataFrame([(t,) for t, _ in rows], "t string").select(T.fact_tokens("t")).collect()
    found = re.findall(r"[a-zA-Zа-яА-Я]*\d+[a-zA-Zа-яА-Я0-9-]*|[%₽]", rows[0][0])
    assert got[0][0] == sorted(set(found))
    long = spark.range(1).select(F.concat(F.repeat(F.lit("a"), 300_000), F.lit("% "), F.repeat(F.lit("b. "), 100_000), F.lit("c7")).alias("t"))
    assert long.select(T.fact_tokens("t")).first()[0] == ["%", "c7"] and long.select(T.fact_tokens("t", True)).first()[0] == ["%", "c7"]


def test_runs_of_a_document_are_counted_in_one_pass(spark, monkeypatch):
    """Rows of one language and doc_id are one document, wherever they lie; null keys and texts, texts without words and repeated ones count too."""
    monkeypatch.setattr(fixtures, "DOCS", 2)
    monkeypatch.setattr(storage, "SHARE", 1)
    rows = [(1, "en", "sunny sun"), (1, "en", "sunny day"), (1, "de", "sunny"), (2, "en", "sunnier sunnier"), (3, "en", None), (4, "en", "..."), (None, "en", "sunny"), (None, "en", "sunny"), (5, None, "day"), (6, "en", "day day day"), (7, "en", "sunn")]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    got = fixtures.run_counts(docs).collect()
    runs, often, ends = {}, {}, {}
    for r in got:
        if r.run is not None:
            runs[r.scope, r.run] = runs.get((r.scope, r.run), 0) + r.n
        elif r.docs is not None:
            often[r.scope, r.link, r.n] = often.get((r.scope, r.link, r.n), 0) + r.docs
        else:
            ends[r.scope, r.doc_id, r.link] = ends.get((r.scope, r.doc_id, r.link), 0) + r.n
    for (s, _, link), n in ends.items():
        often[s, link, n] = often.get((s, link, n), 0) + 1
    assert runs == {("en", "sunny"): 4, ("en", "sun"): 1, ("en", "day"): 4, ("de", "sunny"): 1, ("en", "sunnier"): 2, (None, "day"): 1, ("en", "sunn"): 1}
    assert often == {("en", "sunn", 2): 3, ("en", "sun", 1): 1, ("en", "day", 1): 1, ("de", "sunn", 1): 1, (None, "day", 1): 1, ("en", "day", 3): 1, ("en", "sunn", 1): 1}
    g = {(r.scope, r.word): (r.median, r.forms) for r in fixtures.groups(docs).collect()}
    assert g["en", "sunny"] == (2.0, ["sunn", "sunnier", "sunny"])
