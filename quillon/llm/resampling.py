"""Importance resampling towards a target distribution over hashed word features.

A text is lower-cased (A-Z only) and cut into words of ASCII letters, digits and any characters beyond
ASCII. Its features are all runs of 1 to n words, joined by a space, each hashed to a bucket by the
CRC-32 of its bytes. One scan of a text keeps, for the last n starts, the running state of zlib's
checksum in a ring: a word extends each state by a space and itself, opens a state of its own, and the
oldest leaves. So no feature is ever put together, and the ring is all that a text of any length needs.

Buckets are counted over all texts of both sides in the tasks that read them (one array a task, summed by bucket);
what comes to the driver is the table of buckets, whose size is a parameter. A document's weight is
the mean log ratio of its features' buckets, its score adds Gumbel noise from a hash of its id, and the highest
scores are a draw without replacement by importance. Places are found without a window over all
documents (``quillon.operators.ranks``).

Null and empty texts have no features, weight 0 and no place unless ``least_words`` is 0. Rows with a null doc_id are counted and
weighed like others; their noise is that of the id ``null``, and they come last among ties. Repeated rows are rows of their own,
which tie and get different places. Columns that the operator adds replace those of the same name.
"""

from __future__ import annotations

import math
from collections import deque
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructType

from quillon.operators import ranks

from . import shared

BUCKETS = 10_000
LENGTH = 2
SEED = 7
LEAST_WORDS = 20
PERCENT = 25
#: Bytes of a text that are cut into words at a time.
STRETCH = 1 << 20
#: Words of letters, digits and bytes beyond ASCII, lower-cased; all else parts them.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
ADDED = ("n_words", "n_features", "weight", "score", "rank")


def stretches(text: bytes):
    """Lists of a text's words, stretch by stretch; a word that reaches into the next stretch goes with that."""
    rest = b""
    for at in range(0, len(text), STRETCH):
        piece = rest + text[at : at + STRETCH].translate(_FOLD)
        cut = len(piece) if at + STRETCH >= len(text) else piece.rfind(b" ") + 1
        rest = piece[cut:]
        yield piece[:cut].split()


def features(text: bytes, length: int = LENGTH):
    """Lists of CRC-32 values of the runs of 1 to ``length`` words that end in each stretch of the text, with its number of words."""
    ring = deque(maxlen=max(length - 1, 1))
    for words in stretches(text):
        out = []
        put = out.append
        for word in words:
            if length > 1:
                more = b" " + word
                for k in range(len(ring)):
                    ring[k] = state = crc32(more, ring[k])
                    put(state)
            state = crc32(word)
            put(state)
            ring.append(state)
        yield out, len(words)


def _texts(rows: DataFrame) -> DataFrame:
    return rows.select(F.col("text").cast("string").cast("binary").alias("text"))


def bucket_counts(rows: DataFrame, side: str, buckets: int = BUCKETS, length: int = LENGTH) -> DataFrame:
    """(side, bucket, n): how many features of all texts of ``rows`` fall into each bucket."""
    shared.ship(rows.sparkSession)

    def work(batches):
        n = np.zeros(buckets, np.int64)
        for batch in (part for whole in batches for part in shared.parts(whole)):
            for text in batch.column(0).to_pylist():
                for states, _ in features(text or b"", length):
                    n += np.bincount(np.array(states, np.int64) % buckets, minlength=buckets)
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n[at])], names=["bucket", "n"])

    each = _texts(rows).mapInArrow(shared.tidy(work), "bucket long, n long")
    return each.groupBy("bucket").agg(F.sum("n").alias("n")).select(F.lit(side).alias("side"), "bucket", "n")


def gains(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 * ln) of how much likelier each bucket is in the target, both sides with one feature more in each bucket."""
    k = len(raw)
    ratio = (target + 1.0) * (raw.sum() + float(k)) / ((raw + 1.0) * (target.sum() + float(k)))
    return np.array([math.floor(1000 * math.log(r)) for r in ratio.tolist()], np.int64)


def fit(raw: DataFrame, target: DataFrame, buckets: int = BUCKETS, length: int = LENGTH) -> np.ndarray:
    """The gain of each bucket, from all texts of both tables."""
    both = bucket_counts(raw, "raw", buckets, length).unionByName(bucket_counts(target, "target", buckets, length))
    n = {"raw": np.zeros(buckets), "target": np.zeros(buckets)}
    for side, bucket, count in both.collect():  # at most 2 * buckets rows
        n[side][bucket] = count
    return gains(n["raw"], n["target"])


def weigh(docs: DataFrame, gain: np.ndarray, length: int = LENGTH) -> DataFrame:
    """``docs`` with n_words, n_features and weight."""
    shared.ship(docs.sparkSession)
    buckets = len(gain)
    low = {c.lower() for c in ADDED}
    docs = docs.select(*[c for c in docs.columns if c.lower() not in low])
    at = docs.columns.index("text")
    schema = StructType([*docs.schema.fields])
    for name in ADDED[:3]:
        schema = schema.add(name, LongType())

    def work(batches):
        for batch in (part for whole in batches for part in shared.parts(whole)):
            out = np.zeros((3, batch.num_rows), np.int64)
            for k, text in enumerate(batch.column(at).cast(pa.binary()).to_pylist()):
                words = size = total = 0
                for states, n in features(text or b"", length):
                    total += int(gain[np.array(states, np.int64) % buckets].sum())
                    words, size = words + n, size + len(states)
                out[:, k] = words, size, total // size if size else 0
            yield pa.RecordBatch.from_arrays([*batch.columns, *map(pa.array, out)], names=[*batch.schema.names, *ADDED[:3]])

    return docs.mapInArrow(shared.tidy(work), schema)


def noise(doc_id, seed: int = SEED):
    """Gumbel noise in thousandths, floored, from 32 bits of a hash of seed and id."""
    name = F.concat_ws(":", F.lit(str(seed)), F.coalesce(doc_id.cast("string"), F.lit("null")))
    h = F.conv(F.substring(F.sha2(name, 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")


def resample(docs: DataFrame, gain: np.ndarray, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED, length: int = LENGTH) -> DataFrame:
    """``docs`` without their text, with n_words, n_features, weight, score and rank (null if not drawn).

    Texts don't go into the sort: whoever wants them joins by doc_id.
    """
    weighed = weigh(docs, gain, length).drop("text").withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed))
    base = shared.shared_dir(docs.sparkSession)
    weighed = shared.stored(weighed, "weighed", base)
    may = F.col("n_words") >= least_words
    placed = ranks.ranked(weighed.filter(may), [], [F.desc("score"), F.asc_nulls_last("doc_id")], "rank", "__drawn_of")
    drawn = F.floor(F.col("__drawn_of") * percent / 100)
    placed = placed.withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank"))).drop("__drawn_of")
    return placed.unionByName(weighed.filter(~may).withColumn("rank", F.lit(None).cast("long")))


def op13_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    target = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("text")
    return resample(docs, fit(docs, target)).select("doc_id", "n_features", "weight", "score", "rank")


# A checksum's table and its fold over a feature's bytes; features that occur several times are hashed once.
SQL = r"""
WITH RECURSIVE c AS (SELECT range::BIGINT AS i, 0 AS k, range::BIGINT AS v FROM range(256)
  UNION ALL SELECT i, k + 1, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END FROM c WHERE k < 8),
tab AS (SELECT list(v ORDER BY i) AS t FROM c WHERE k = 8),
texts AS (SELECT 0 AS side, doc_id AS id, text FROM documents UNION ALL SELECT 1, item_id, text FROM benchmark),
w AS (SELECT side, id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x{00}-\x{2F}\x{3A}-\x{60}\x{7B}-\x{7F}]+') AS w FROM texts WHERE text IS NOT NULL),
f AS (SELECT side, id, unnest(w) AS f FROM w UNION ALL
  SELECT side, id, w[p] || ' ' || w[p + 1] FROM (SELECT side, id, w, unnest(range(1, len(w))) AS p FROM w)),
d AS (SELECT side, id, f, count(*) AS n FROM f GROUP BY ALL),
u AS (SELECT DISTINCT f FROM d),
b AS (SELECT f, list_transform(range(0, len(hex(encode(f))) // 2), lambda i: ('0x' || substr(hex(encode(f)), 2 * i + 1, 2))::BIGINT) AS bytes FROM u),
h AS (SELECT f, xor(list_reduce(bytes, lambda a, x: xor(a >> 8, t[(xor(a, x) & 255) + 1]), 4294967295::BIGINT), 4294967295) % 10000 AS bucket FROM b, tab),
n AS (SELECT bucket, coalesce(sum(n) FILTER (side = 0), 0)::DOUBLE AS s, coalesce(sum(n) FILTER (side = 1), 0)::DOUBLE AS t FROM d JOIN h USING (f) GROUP BY bucket),
tot AS (SELECT sum(s) AS s, sum(t) AS t FROM n),
g AS (SELECT n.bucket, floor(1000 * ln((n.t + 1) * (tot.s + 10000) / ((n.s + 1) * (tot.t + 10000))))::BIGINT AS gain FROM n, tot),
m AS (SELECT d.id, sum(d.n)::BIGINT AS n, floor(sum(d.n * g.gain)::DOUBLE / sum(d.n))::BIGINT AS weight FROM d JOIN h USING (f) JOIN g USING (bucket) WHERE side = 0 GROUP BY d.id),
e AS (SELECT doc_id, coalesce(m.n, 0) AS n_features, coalesce(m.weight, 0) AS weight, coalesce(len(w.w), 0) AS words,
  ('0x' || substr(sha256('7:' || doc_id), 1, 8))::BIGINT AS h
  FROM documents LEFT JOIN m ON m.id = doc_id LEFT JOIN w ON w.id = doc_id AND w.side = 0),
z AS (SELECT *, weight + floor(-1000 * ln(-ln((h + 0.5) / 4294967296)))::BIGINT AS score FROM e),
r AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, count(*) OVER () AS n FROM z WHERE words >= 20)
SELECT z.doc_id, z.n_features, z.weight, z.score, CASE WHEN r.rank <= 25 * r.n // 100 THEN r.rank END AS rank FROM z LEFT JOIN r USING (doc_id)
"""
