"""Probable duplicates of short texts: SimHash fingerprints, and pairs of them that differ in few bits.

A text's features are its distinct pairs of neighbouring tokens (the token, if it has one). Each has 64 bits of an MD5 digest, and
the fingerprint has the bits that more than half of the features have. Texts with one fingerprint are a class.
Pairs of classes within ``bits`` bits are found for certain: fingerprints are cut into ``bits`` + 3 blocks, two that differ in
``bits`` bits agree in three of them at least, so they meet under one of the choices of three blocks, and the
distance is confirmed. A key is about half of a fingerprint, so few others meet there. Three bits of 64 are an edit of a few
pairs in a thousand; texts of a few dozen words that differ at all are mostly further apart.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon import storage
from quillon.functions import text as T

BITS = 3


def features(tokens: str):
    """Distinct pairs of neighbouring tokens of a column of tokens, or its one token."""
    t = F.col(tokens)
    pairs = F.transform(F.sequence(F.lit(0), F.greatest(F.size(t) - 2, F.lit(0))), lambda i: F.concat_ws(" ", F.get(t, i), F.get(t, i + 1)))
    return F.array_distinct(F.when(F.size(t) > 1, pairs).otherwise(t))


def fingerprints(rows: DataFrame, key: str, text: str) -> DataFrame:
    """(key, fingerprint) of the rows that have a token."""
    storage.ship(rows.sparkSession)
    digests = F.array_join(F.transform(features("_t"), lambda f: F.substring(F.md5(f), 1, 16)), "")
    hashed = rows.select(F.col(key).cast("long").alias("key"), T.tokens(T.normalize(text)).alias("_t")).select("key", F.unhex(digests).alias("digests"))

    def work(batches):
        for batch in batches:
            out = []
            for data in batch.column(1).to_pylist():
                each = np.unpackbits(np.frombuffer(data or b"", np.uint8).reshape(-1, 8), axis=1)
                out.append(int.from_bytes(np.packbits(each.sum(0) * 2 > len(each)).tobytes(), "big", signed=True) if len(each) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.int64())], names=["key", "fingerprint"])

    return hashed.mapInArrow(work, "key long, fingerprint long").filter("fingerprint is not null").withColumnRenamed("key", key)


def _keys(fingerprint, bits: int) -> list:
    """A mask and the bits under it for each choice of three blocks."""
    n = bits + 3
    cuts = [64 * k // n for k in range(n + 1)]
    masks = [((1 << (b - a)) - 1) << a for a, b in zip(cuts, cuts[1:], strict=False)]
    out = []
    for k, chosen in enumerate(combinations(masks, 3)):
        mask = sum(chosen)
        out.append(F.struct(F.lit(k).alias("choice"), fingerprint.bitwiseAND(F.lit(mask - (1 << 64) if mask >> 63 else mask)).alias("part")))
    return out


def close_pairs(prints: DataFrame, bits: int = BITS) -> DataFrame:
    """(a, b, distance) of different fingerprints within ``bits`` bits, a < b, each pair once; prints: (fingerprint)."""
    f = prints.select("fingerprint").distinct()
    posted = f.select("fingerprint", F.inline(F.array(*_keys(F.col("fingerprint"), bits))))
    a, b = posted.withColumnRenamed("fingerprint", "a"), posted.withColumnRenamed("fingerprint", "b")
    # a broadcast would be judged by the fingerprints' size, before each becomes a row for every choice
    met = a.hint("merge").join(b.hint("merge"), ["choice", "part"]).filter(F.col("a") < F.col("b"))
    distance = F.bit_count(F.col("a").bitwiseXOR(F.col("b")))
    near = met.select("a", "b", "choice", distance.alias("distance")).filter(F.col("distance") <= bits)
    # a pair that meets under several choices counts under the first: no shuffle is needed to tell
    first = None
    for k, (x, y) in enumerate(zip(_keys(F.col("a"), bits), _keys(F.col("b"), bits), strict=True)):
        same = x.part == y.part
        first = F.when(same, F.lit(k)) if first is None else first.when(same, F.lit(k))
    return near.filter(F.col("choice") == first).drop("choice")


def duplicates(rows: DataFrame, key: str, text: str, bits: int = BITS) -> DataFrame:
    """(key, class_id, copies, links): the least key with the same fingerprint, how many have it, and how many other fingerprints are close. Rows without tokens are left out."""
    prints = storage.stored(fingerprints(rows, key, text), "prints")
    classes = prints.groupBy("fingerprint").agg(F.min(key).alias("class_id"), F.count(F.lit(1)).alias("copies"))
    pairs = close_pairs(prints, bits)
    links = pairs.select(F.explode(F.array("a", "b")).alias("fingerprint")).groupBy("fingerprint").agg(F.count(F.lit(1)).alias("links"))
    return prints.join(classes.join(links, "fingerprint", "left"), "fingerprint").select(key, "class_id", "copies", F.coalesce("links", F.lit(0)).cast("long").alias("links"))
