import hashlib
import math
import re
import zlib

import pytest
from helpers_llm import LONG, duck, empty, odd, rows, saved, text
from pyspark.sql import functions as F

from quillon.llm import resampling


def words(t):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def runs(t, n):
    w = words(t)
    return [" ".join(w[p : p + k]) for k in range(1, n + 1) for p in range(len(w) - k + 1)]


def brute(docs, target, buckets=10_000, n=2, percent=25, least=20, seed=7):
    """(doc_id, n_features, weight, score, rank) of each document, from joined features."""
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = [0] * buckets, [0] * buckets
    for side, texts in ((s, [x for _, x in docs]), (t, target)):
        for x in texts:
            for f in runs(x, n):
                side[bucket(f)] += 1
    gain = [math.floor(1000 * math.log((b + 1) * (sum(s) + buckets) / ((a + 1) * (sum(t) + buckets)))) for a, b in zip(s, t, strict=True)]
    out = []
    for i, x in docs:
        g = [gain[bucket(f)] for f in runs(x, n)]
        w = sum(g) // len(g) if g else 0
        h = int(hashlib.sha256(f"{seed}:{'null' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(g), w, w + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), None, len(words(x)) >= least])
    may = sorted((r for r in out if r[5]), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for k, r in enumerate(may[: len(may) * percent // 100]):
        r[4] = k + 1
    return sorted((tuple(r[:5]) for r in out), key=repr)


TARGET = [text(5, 40), "Straße GROẞ 12 x", None, "", "alpha_beta gamma"]


@pytest.mark.parametrize("n,percent,least", [(2, 25, 20), (1, 50, 0), (4, 100, 3)])
def test_odd_rows_against_loops(spark, n, percent, least):
    docs, target = odd(spark), spark.createDataFrame([(x,) for x in TARGET], "text string")
    got = resampling.resample(docs.withColumn("Rank", F.lit("x")), resampling.fit(docs, target, 997, n), percent, least, length=n)
    assert set(got.columns) == {*docs.columns, *resampling.ADDED} - {"text"}
    mine = sorted((tuple(r) for r in got.select("doc_id", "n_features", "weight", "score", "rank").collect()), key=repr)
    assert mine == brute([(r.doc_id, r.text) for r in docs.collect()], TARGET, 997, n, percent, least)


def test_empty_tables(spark):
    target = spark.createDataFrame([(x,) for x in TARGET], "text string")
    assert resampling.resample(empty(spark), resampling.fit(empty(spark), target)).collect() == []
    got = resampling.resample(odd(spark), resampling.fit(odd(spark), target.filter("false")))
    assert got.filter("rank is not null").count() == got.filter("n_words >= 20").count() // 4


def test_stretches_change_nothing(monkeypatch):
    t = (LONG + " Ünï-code9" * 50).encode()
    whole = [x for f, _ in resampling.features(t, 3) for x in f]
    monkeypatch.setattr(resampling, "STRETCH", 61)
    assert [x for f, _ in resampling.features(t, 3) for x in f] == whole
    assert list(resampling.features(b"x" * 500, 2)) == [([], 0)] * 8 + [([zlib.crc32(b"x" * 500)], 1)]


def test_query_against_sql(spark, tmp_path):
    docs = odd(spark).filter("doc_id is not null").dropDuplicates(["doc_id"]).select("doc_id", "text")
    docs = docs.unionByName(spark.createDataFrame([(k, text(k % 50, 15 + k % 20)) for k in range(100, 300)], "doc_id long, text string"))
    folder = saved(docs, tmp_path)
    target = spark.createDataFrame([(k, x) for k, x in enumerate(TARGET)], "item_id long, text string")
    saved(target, tmp_path, "benchmark")
    assert rows(resampling.op13_resampling(spark, folder)) == duck(resampling.SQL, documents=docs, benchmark=target)


def test_draw_follows_the_target(spark):
    """Documents like the target are drawn far more often than their share."""
    docs = spark.createDataFrame([(k, " ".join(f"{'near' if k % 5 == 0 else 'far'}{(k * 31 + j * j) % 40}" for j in range(60))) for k in range(600)], "doc_id long, text string")
    target = docs.filter("doc_id % 5 = 0 and doc_id < 100").select("text")
    drawn = resampling.resample(docs, resampling.fit(docs, target)).filter("rank is not null")
    assert drawn.count() == 150 and drawn.filter("doc_id % 5 = 0").count() > 110
