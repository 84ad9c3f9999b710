"""Substring dedup: winnowed anchors seed the search, windows around them extend it both ways.

A repeat is a run of at least ``LENGTH`` words whose every window of ``LENGTH`` words also starts
in a document with a smaller doc_id. Each such window holds ``LENGTH - GRAM + 1`` word 5-grams;
its anchor is the smallest 5-gram hash among them (winnowing). Equal windows have equal anchors,
so a window can repeat only if its anchor is seen in two documents. The steps are

1. seeds: the anchors of every document, joined by hash; those in two documents or more stay;
2. extension: from each seed to both sides over all windows whose anchor it is; windows are
   compared by 96 bits over 128-bit hashes of their words, and the smallest doc_id of each is kept;
3. repeats: a document's windows that start earlier elsewhere are merged into maximal spans, and
   the words in them go.

No pair of documents is made: a seed or window names its smallest document only, so a passage in
every document costs one row for each block of documents. Documents are dealt into blocks by hash
(of ``BLOCK_BYTES`` of text at most on average, ``BLOCKS`` or more for each shuffle partition) and seeds and windows are reduced inside a block before
they are shuffled, so one hot passage sends one row per block. A row packs the block, a mark for two
documents of the block that share it, and 32 of a window's 96 bits into one number. The text is shuffled once
and this exchange is used by all three steps.

Null text has no words. A row with a null doc_id neither removes words nor loses any. Rows that
share a doc_id don't remove each other's words; repeated rows give repeated results. A long text is
one row of its block and taken whole. An empty table gives no rows. Other columns, whatever their
names, are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import shared

LENGTH = 13
GRAM = 5
BLOCKS, BLOCK_BYTES = 4, 32 << 20


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each run of ``w`` values."""
    have, out = 1, x
    while have * 2 <= w:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    return np.minimum(out[: len(x) - w + 1], out[w - have :]) if have < w else out


def window_anchors(h: np.ndarray, length: int) -> np.ndarray:
    """The anchor of each window of ``length`` words."""
    return sliding_min(shared.grams(h, GRAM), length - GRAM + 1)


def window_keys(h: np.ndarray, g: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of each window's words, 64 and 32 bits, from independent hashes of the words."""
    one = shared.grams(h, length, 0xD6E8FEB86659FD93)
    two = shared.grams(g, length, 0xA0761D6478BD642F)
    return one.view(np.int64), (two >> np.uint64(32)).astype(np.uint32).view(np.int32)


def covered(starts: np.ndarray, n: int, length: int) -> np.ndarray:
    """Which of ``n`` words lie in the windows that begin at ``starts``: merged maximal spans."""
    step = np.zeros(n + 1, np.int32)
    np.add.at(step, starts, 1)
    np.add.at(step, starts + length, -1)
    return np.cumsum(step[:n]) > 0


def _reduced(keys: list[np.ndarray], ids: np.ndarray) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Distinct keys with their smallest and largest id."""
    order = np.lexsort([ids, *keys[::-1]])
    keys, ids = [k[order] for k in keys], ids[order]
    new = np.ones(len(ids), bool)
    if len(ids):
        new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    at = np.flatnonzero(new)
    end = np.append(at[1:], len(ids)) - 1
    return [k[at] for k in keys], ids[at], ids[end]


def dedup(docs: DataFrame, length: int = LENGTH, keep_text: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 (and kept: the words left, joined by one space) of each row of ``docs`` (doc_id, text)."""
    if length < GRAM:
        raise ValueError(f"length must be {GRAM} or more")
    spark = docs.sparkSession
    shared.ship(spark)
    # The size of a block, which a worker holds, follows the input's bytes, not the number of partitions.
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-shared.sized(docs)[1] // (BLOCKS * BLOCK_BYTES)))
    rows = docs.select(
        F.pmod(F.xxhash64("doc_id", "text"), F.lit(n * BLOCKS)).cast("int").alias("block"),
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("text").cast("binary").alias("text"),
    ).repartition(n, "block")

    def seeds(batches):
        schema = pa.schema([("h", pa.int64()), ("x", pa.int64())])
        for batch in batches:
            hs, blocks, ids = [], [], []
            for b, i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                h = shared.word_hashes(t or b"")
                if i is None or len(h) < length:
                    continue
                m = window_anchors(h, length)
                m = m[np.append(True, m[1:] != m[:-1])]
                hs.append(m)
                blocks.append(np.full(len(m), b, np.int32))
                ids.append(np.full(len(m), i, np.int64))
            if hs:
                (b, h), lo, hi = _reduced([np.concatenate(blocks), np.concatenate(hs)], np.concatenate(ids))
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(b.astype(np.int64) << 1 | (lo < hi))], schema=schema)

    by = W.partitionBy("h")
    found = (
        rows.mapInArrow(seeds, "h long, x long")
        .repartition(n, "h")
        .select((F.col("x") / 2).cast("int").alias("block"), "h", (F.count(F.lit(1)).over(by) + F.max(F.col("x") % 2).over(by)).alias("seen"))
        .filter("seen > 1")
        .select("block", "h")
    )

    def extend(left: pa.Table, right: pa.Table) -> pa.Table:
        want = np.unique(right.column("h").to_numpy()).view(np.uint64)
        want.sort()
        ones, twos, ids = [], [], []
        for i, t in zip(left.column("doc_id").to_pylist(), left.column("text").to_pylist(), strict=True) if len(want) else ():
            h, g = shared.word_hashes(t or b"", 2)
            if i is None or len(h) < length:
                continue
            m = window_anchors(h, length)
            at = np.searchsorted(want, m)
            hit = want[np.minimum(at, len(want) - 1)] == m
            if hit.any():
                one, two = window_keys(h, g, length)
                ones.append(one[hit])
                twos.append(two[hit])
                ids.append(np.full(int(hit.sum()), i, np.int64))
        b = left.column("block")[0].as_py() if len(left) else 0
        if ones:
            (one, two), lo, hi = _reduced([np.concatenate(ones), np.concatenate(twos)], np.concatenate(ids))
        else:
            one, two, lo, hi = (np.empty(0, k) for k in (np.int64, np.int32, np.int64, np.int64))
        return pa.table({"w1": one, "x": two.astype(np.int64) << 32 | np.int64(b) << 1 | (lo < hi), "lo": lo})

    by = W.partitionBy("w1", F.shiftright("x", 32))
    windows = (
        rows.groupBy("block")
        .cogroup(found.groupBy("block"))
        .applyInArrow(extend, "w1 long, x long, lo long")
        .repartition(n, "w1")
        .select("w1", "x", "lo", F.min("lo").over(by).alias("first"))
        .filter("first < lo or x % 2 <> 0")
        .select(F.shiftright(F.col("x").bitwiseAND(2**32 - 1), 1).cast("int").alias("block"), "w1", "first")
    )

    def cut(left: pa.Table, right: pa.Table) -> pa.Table:
        # Inside one block 64 bits tell windows apart.
        one, first = right.column("w1").to_numpy(), right.column("first").to_numpy()
        order = np.argsort(one, kind="stable")
        one, first = one[order], first[order]
        out = {"doc_id": [], "n_words": [], "n_removed": [], "kept_sha256": []} | ({"kept": []} if keep_text else {})
        for i, t in zip(left.column("doc_id").to_pylist(), left.column("text").to_pylist(), strict=True):
            words = (t or b"").split()
            gone = None
            if i is not None and len(words) >= length and len(one):
                key = window_keys(*shared.word_hashes(t, 2), length)[0]
                at = np.minimum(np.searchsorted(one, key), len(one) - 1)
                starts = np.flatnonzero((one[at] == key) & (first[at] < i))
                if len(starts):
                    gone = covered(starts, len(words), length)
            kept = words if gone is None else [w for w, g in zip(words, gone.tolist(), strict=True) if not g]
            text = b" ".join(kept)
            out["doc_id"].append(i)
            out["n_words"].append(len(words))
            out["n_removed"].append(len(words) - len(kept))
            out["kept_sha256"].append(hashlib.sha256(text).hexdigest())
            if keep_text:
                out["kept"].append(text.decode("utf-8", "replace"))
        kinds = {"doc_id": pa.int64(), "n_words": pa.int64(), "n_removed": pa.int64(), "kept_sha256": pa.string(), "kept": pa.string()}
        return pa.table({k: pa.array(v, kinds[k]) for k, v in out.items()})

    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string" + (", kept string" if keep_text else "")
    return rows.groupBy("block").cogroup(windows.groupBy("block")).applyInArrow(cut, schema)


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


_WINDOW = " || ' ' || ".join(["w", *(f"lead(w, {k}) OVER o" for k in range(1, LENGTH))])
SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '{shared.WORD}') AS ws FROM documents),
w AS (SELECT r, doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM d),
k AS (SELECT r, doc_id, i, w, {_WINDOW} AS k FROM w WINDOW o AS (PARTITION BY r ORDER BY i)),
f AS (SELECT k, min(doc_id) AS first FROM k WHERE k IS NOT NULL AND doc_id IS NOT NULL GROUP BY k),
g AS (SELECT r, i, w, coalesce(bool_or(first < doc_id) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN {LENGTH - 1} PRECEDING AND CURRENT ROW), false) AS gone FROM k LEFT JOIN f USING (k)),
o AS (SELECT r, count(*) AS n, count(*) FILTER (WHERE gone) AS n_gone, sha256(coalesce(string_agg(w, ' ' ORDER BY i) FILTER (WHERE NOT gone), '')) AS sha FROM g GROUP BY r)
SELECT doc_id, coalesce(n, 0) AS n_words, coalesce(n_gone, 0) AS n_removed, coalesce(sha, sha256('')) AS kept_sha256 FROM d LEFT JOIN o USING (r)
"""
