import json
import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.operators import content, similar, statistics, targets
from quillon.sinks import committed


def test_close_pairs_are_all_pairs_within_the_distance(spark):
    rng = random.Random(4)
    base = [rng.getrandbits(64) for _ in range(60)]
    prints = {b ^ sum(1 << k for k in rng.sample(range(64), rng.randrange(6))) for b in base for _ in range(6)}
    signed = sorted(p - (1 << 64) if p >> 63 else p for p in prints)
    want = {(a, b, ((a ^ b) & (1 << 64) - 1).bit_count()) for i, a in enumerate(signed) for b in signed[i + 1 :] if ((a ^ b) & (1 << 64) - 1).bit_count() <= 3}
    got = [tuple(r) for r in similar.close_pairs(spark.createDataFrame([(p,) for p in signed], "fingerprint long")).collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 100


def test_fingerprints_are_never_broadcast_with_their_choices(spark, tmp_path):
    """A table of fingerprints below the limit of broadcasts is twenty times as many rows once each has its choices."""
    path = f"{tmp_path}/prints"
    spark.range(1000).select(F.xxhash64("id").alias("fingerprint")).write.parquet(path)
    plan = similar.close_pairs(spark.read.parquet(path))._jdf.queryExecution().toString()
    assert "SortMergeJoin" in plan and "BroadcastExchange" not in plan


def test_duplicates_of_reviews(spark):
    words = [f"w{k}" for k in range(6000)]
    text = " ".join(words)
    rows = [(1, text), (2, text.upper()), (3, " ".join([*words[:3000], "other", *words[3000:]])), (4, " ".join(f"v{k}" for k in range(300))), (5, None), (6, " ,"), (7, "one"), (8, "One"), (9, " ".join(reversed(words)))]
    df = spark.createDataFrame(rows, "id long, text string")
    got = {r.id: (r.class_id, r.copies, r.links) for r in similar.duplicates(df, "id", "text").collect()}
    assert got[1] == got[2] and got[1][0] == 1 and (got[3][0] == 1 or got[3][2] == got[1][2] == 1) and got[4] == (4, 1, 0) and got[7] == got[8] == (7, 2, 0) and got[9][2] == 0 and set(got) == {1, 2, 3, 4, 7, 8, 9}
    assert similar.duplicates(df.filter("id > 100"), "id", "text").collect() == []


def test_peers_against_all_pairs(spark):
    rng = random.Random(2)
    day = datetime(2024, 1, 1)
    rows = [(k, rng.choice("ab"), day + timedelta(days=rng.randrange(120)), float(rng.choice([0, 1, 1023, 1024, 2048, 2049, 3000, rng.random() * 5000])) or None) for k in range(250)]
    df = spark.createDataFrame(rows, "k int, g string, ts timestamp, size double")
    got = {r.k: r.peers for r in statistics.peers(df, "k", ["g"], "ts", "size").collect()}
    near = lambda a, b: a[0] != b[0] and a[1] == b[1] and a[3] and b[3] and abs((a[2] - b[2]).days) <= 30 and max(a[3], b[3]) <= 2 * min(a[3], b[3])
    assert got == {a[0]: sum(bool(near(a, b)) for b in rows) for a in rows}


def test_peers_of_a_hot_cell_are_counted_and_not_paired(spark):
    """All rows in one cell, over several ranges of a sweep and many blocks; rows that share a key aren't peers of each other."""
    day = datetime(2024, 1, 1)
    df = spark.range(6000).select(F.when(F.col("id") < 2, 0).otherwise(F.col("id")).alias("k"), F.lit("a").alias("g"), F.lit(day).alias("ts"), (1000 + F.col("id") * 0.5).alias("size"))
    out = statistics.peers(df, "k", ["g"], "ts", "size")
    assert "_size_left" not in out._jdf.queryExecution().toString()
    sizes = [1000 + k * 0.5 for k in range(6000)]
    upto = lambda s: min(int((2 * s - 1000) * 2) + 1, 6000) - max(int(-(-(s / 2 - 1000) * 2 // 1)), 0)
    got = {r.k: r.peers for r in out.collect()}
    assert all(got[k] == upto(sizes[k]) - 1 for k in range(2, 6000)) and got[0] == upto(sizes[0]) + upto(sizes[1]) - 4


def test_paths_and_steps_out_of_order(spark):
    t = lambda n: datetime(2024, 1, 1) + timedelta(seconds=n)
    rows = [("a", "x", t(0), 1), ("a", "y", t(5), 2), ("a", "z", t(9), 3), ("b", "y", t(0), 4), ("b", "x", t(1), 5), ("b", "y", t(4), 6), ("c", "z", t(0), 7), ("c", "y", t(1), 8), ("d", "x", t(3), 9), ("d", "y", t(3), 10), ("e", "q", t(0), 11), (None, "x", t(0), 12)]
    df = spark.createDataFrame(rows, "k string, s string, ts timestamp, id int")
    got = {r.k: (r.completed, r.seconds, r.out_of_order) for r in statistics.decision_path(df, "k", ["x", "y", "z"], "s", "ts", "id").collect()}
    assert got == {"a": (3, [5, 4], 0), "b": (2, [3], 1), "c": (0, [], 2), "d": (2, [0], 0), "e": (0, [], 0), None: (1, [], 0)}


def test_collocations_beat_chance(spark):
    rng = random.Random(9)
    common = [f"c{k}" for k in range(20)]
    rows = [("x", " ".join(rng.choice(common) for _ in range(30)) + (" new york " if k % 2 else " york new ") + "и 5 и 5") for k in range(60)] + [("x", None), ("y", "")]
    got = statistics.collocations(spark.createDataFrame(rows, "corpus string, text string"), "corpus", "text").collect()
    top = {r.theme: (r.docs, r.n) for r in got}
    assert top["new york"] == (30, 30) and top["york new"] == (30, 30) and not any("5" in t or "и" in t.split() for t in top) and all(r.corpus == "x" for r in got)


def test_phrases_are_counted_once_and_stored(spark):
    """No step after the count reads or shuffles texts again."""
    out = statistics.collocations(spark.createDataFrame([("x", "a b a b a-b c " * 9), ("x", "a b")], "corpus string, text string"), "corpus", "text", score=-1e9)
    assert "regexp_extract_all" not in out._jdf.queryExecution().toString()
    assert {r.theme: (r.n, r.docs) for r in out.collect()}["a b"] == (19, 2)


def test_intervals_hold_what_differs(spark):
    """A feature of the strong rows alone stands out, one that is equally frequent doesn't, a rare one is flagged."""
    rng = np.random.default_rng(1)
    rows = [(k, s, f) for k in range(3000) for s in [("top", "bottom", "middle")[k % 3]] for f in [1 if s == "top" and rng.random() < 0.5 else int(rng.integers(2, 6))]] + [(10_000, "top", 9)]
    got = {r.f: r for r in statistics.contrast_intervals(spark.createDataFrame(rows, "k long, stratum string, f long"), "k", "f").collect()}
    assert got[1].limited and got[1].weak == 0 and got[9].limited and got[9].lift is None
    for f in (2, 3, 4, 5):
        assert not got[f].limited and got[f].low <= got[f].lift <= got[f].high and got[f].high < 1 and got[f].q < 0.05
    assert statistics.contrast_intervals(spark.createDataFrame([], "k long, stratum string, f long"), "k", "f").collect() == []


def test_plan_sizes(spark):
    df = spark.createDataFrame([(g, k) for g in (7, 8, 12, 13) for k in range(g)], "g int, k int")
    assert {r.g: r.fits for r in content.plan_sizes(df, "g").collect()} == {7: False, 8: True, 12: True, 13: False}


def test_a_report_is_whole_or_absent(spark, tmp_path):
    path = f"file://{tmp_path}/report"
    lines = spark.range(200).select((F.col("id") % 7).alias("pair_id"), (F.col("id") % 3).cast("int").alias("section_ord"), F.col("id").alias("row_ord"), F.concat(F.lit("line\t\n\"é "), F.col("id").cast("string")).alias("line"))
    codes = spark.createDataFrame([(1, 0), (2, 1)], "pair_id long, code int")
    bad = lines.repartition(4).withColumn("line", F.when(F.col("row_ord") == 150, F.raise_error(F.lit("killed"))).otherwise(F.col("line")))
    with pytest.raises(Exception, match="killed"):
        committed.write(bad, codes, path)
    assert committed.read(spark, path)[1] is None and committed.read(spark, path)[0].count() == 0
    committed.write(lines, codes, path)
    got, code = committed.read(spark, path)
    assert code == 1 and sorted(map(tuple, got.collect())) == sorted(map(tuple, lines.collect()))
    listed = json.loads((tmp_path / "report" / "report.json").read_text())
    rows = [json.loads(x) for p in listed["parts"] for x in (tmp_path / "report" / "parts" / p).read_text().splitlines()]
    assert [tuple(r.values())[:3] for r in rows] == sorted(tuple(r)[:3] for r in lines.collect()) and listed["lines"] == 200
    with pytest.raises(Exception, match="killed"):
        committed.write(bad, codes, path)
    assert committed.read(spark, path)[0].count() == 200
    committed.write(lines.filter("pair_id = 1"), codes.filter("code = 0"), path)
    assert committed.read(spark, path)[1] == 0 and committed.read(spark, path)[0].count() == lines.filter("pair_id = 1").count()
    assert len(list((tmp_path / "report" / "parts").iterdir())) <= len(json.loads((tmp_path / "report" / "report.json").read_text())["parts"]) + 8


def test_groups_take_in_the_forms_of_their_last_depth_row(spark):
    s = "scope string, row_ix int, word string, forms array<string>"
    g = [("s", 1, "Душ", ["душ", "душа"]), ("s", 2, "кран", ["кран"]), ("s", 3, "душ", ["душ"]), ("s", 4, "Ёмкость", ["ёмкость"])]
    d = [("s", 1, "душ", ["душем"]), ("s", 2, "ДУШ", ["душу", "душе"]), ("s", 3, "емкость", ["емкости"])]
    out = targets.supplemented(targets.ranked(spark.createDataFrame(g, s), 150, ["scope"]), spark.createDataFrame(d, s), ["scope"])
    got = {r.breadth_rank: (r.word, r.forms) for r in out.collect()}
    assert got == {1: ("Душ", ["душ", "душа", "душе", "душу"]), 2: ("кран", ["кран"]), 3: ("Ёмкость", ["емкости", "емкость"])}


def test_a_stop_criterion_at_zero_puts_a_concept_out(spark):
    scores = {"a": [5] * 9, "b": [5, 5, 0, 5, 5, 5, 5, 5, 5], "c": [4] * 9, "d": [3] * 8, "e": [1] * 9, "f": [0, 3, 1, 0, 3, 1, 3, 3, 3]}
    rows = [(c, k, v, k == 2) for c, vs in scores.items() for k, v in enumerate(vs)]
    got = {r.concept: (r.total, r.stopped, r.role, r.complete) for r in content.concept_scores(spark.createDataFrame(rows, "concept string, criterion int, score int, is_stop boolean")).collect()}
    assert got == {"a": (45, False, "main", True), "b": (40, True, "out", True), "c": (36, False, "reserve", True), "d": (24, False, "reserve", False), "e": (9, False, "out", True), "f": (17, False, "out", True)}
