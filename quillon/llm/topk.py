"""Exact top-k by inner product: columnar branch-and-bound.

Vectors become integers floor(256 * x). Candidates lie in vertical layout: a block holds up to
``ROWS`` vectors as one matrix per ``DIMS`` dimensions. A query adds up its scores dimension block
by dimension block; after each, a candidate stays only if its partial score plus the largest
possible rest (product of the two remaining norms, rounded up) reaches the query's k-th best score
so far, and the survivors are compacted into smaller matrices. Ties are kept, so the bound drops
no row that could win by its smaller vec_id.

Queries are written once to the shared folder in blocks of ``QUERIES``; every task holds the
candidates of its input split and goes over the query blocks one at a time, so memory is bounded
by a split and one query block. A task returns at most k rows per query, block by block, and the
last step takes the k best of these. A query set is given (the rows whose vec_id is divisible by
``EVERY``); this isn't a join of all pairs.

Rows whose vec_id is null, or whose vector is null or empty or holds null or non-finite
components, take no part. Vectors are compared with queries of the same length only. A candidate
with the query's vec_id is the query's own row. Repeated candidate rows are separate candidates;
of repeated queries with one vec_id the smallest vector counts. Long vectors are taken whole, in blocks of
dimensions. An empty table gives no rows. Other columns, whatever their names, are not read.

Bounds are in double precision with room for its rounding; scores that this precision can't hold exactly
are computed anew in 64-bit integers for the candidates that the bounds leave. A score beyond 64 bits is an error.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import shared

EVERY, K = 50, 5
ROWS, DIMS, QUERIES = 8192, 16, 1024


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id and v (array of long) of the rows that take part."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = vectors.filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & (F.size("embedding") > 0))
    rows = rows.filter(F.coalesce(finite, F.lit(False)))
    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform("embedding", lambda x: F.floor(F.lit(256.0) * x.cast("double"))).alias("v"))


def _matrices(batch: pa.RecordBatch):
    """(ids, matrix) for each vector length in the batch."""
    ids = batch.column(0).to_numpy(zero_copy_only=False)
    v = batch.column(1)
    sizes = np.diff(v.offsets.to_numpy())
    flat = v.values.to_numpy(zero_copy_only=False)[v.offsets[0].as_py() : v.offsets[-1].as_py()]
    start = np.concatenate([[0], np.cumsum(sizes)])
    for d in np.unique(sizes):
        rows = np.flatnonzero(sizes == d)
        yield ids[rows], flat[start[rows][:, None] + np.arange(d)]


def rest_norms(m: np.ndarray, dims: int) -> list[np.ndarray]:
    """Norms of the components from each dimension block on."""
    return [np.sqrt((m[:, lo:] ** 2).sum(1)) for lo in range(0, m.shape[1], dims)] + [np.zeros(len(m))]


def best(q_ids, q, c_ids, c, k: int, floor: np.ndarray, dims: int = DIMS):
    """(query position, candidate position, score) of the k best candidates of each query, if at least ``floor``.

    ``q`` and ``c`` are whole numbers. Sums of products below 2 ** 53 are exact in double precision,
    whatever the order of additions; larger ones are bounded with ``slack`` and computed in integers at the end.
    """
    qi, ci = q, c
    q, c = q.astype(np.float64), c.astype(np.float64)
    qn, cn = rest_norms(q, dims), rest_norms(c, dims)
    largest = qn[0].max(initial=0) * cn[0].max(initial=0)  # no score, and no part of one, is larger
    exact = largest < 2.0**53
    if largest >= 2.0**63:
        raise ValueError("a score may exceed 64 bits")
    slack = 1e-6 if exact else 1e-12 * largest
    blocks = [np.ascontiguousarray(c[:, lo : lo + dims].T) for lo in range(0, c.shape[1], dims)]
    out = []
    # A first block for all queries at once, then each query on its own survivors.
    first = q[:, :dims] @ blocks[0]
    for i in range(len(q)):
        part, alive = first[i], None
        low = floor[i]
        if len(part) > k:
            # k candidates of high partial score, finished now, raise the bar for the others
            probe = np.argpartition(-part, 4 * k)[: 4 * k] if len(part) > 4 * k else np.arange(len(part))
            full = c[probe] @ q[i]
            full = full[c_ids[probe] != q_ids[i]]
            if len(full) >= k:
                low = max(low, np.partition(full, len(full) - k)[len(full) - k] - (0 if exact else slack))
        for b in range(1, len(blocks) + 1):
            rest = qn[b][i] * (cn[b] if alive is None else cn[b][alive]) if b < len(blocks) else 0.0
            keep = np.flatnonzero(part + rest * (1 + 1e-9) + slack >= low)
            alive, part = (keep if alive is None else alive[keep]), part[keep]
            if b == len(blocks) or not len(alive):
                break
            part = part + q[i, b * dims : (b + 1) * dims] @ blocks[b][:, alive]
        mine = c_ids[alive] != q_ids[i]
        alive, part = alive[mine], part[mine]
        part = part.astype(np.int64) if exact else ci[alive].astype(np.int64) @ qi[i].astype(np.int64)
        if len(alive) > k:
            order = np.lexsort([c_ids[alive], -part])[:k]
            alive, part = alive[order], part[order]
        out.append((np.full(len(alive), i), alive, part))
    return [np.concatenate(x) for x in zip(*out, strict=True)]


def nearest(vectors: DataFrame, every: int = EVERY, k: int = K) -> DataFrame:
    """query_id, rank, vec_id, score: the k best of each query row."""
    spark = vectors.sparkSession
    shared.ship(spark)
    rows = usable(vectors)
    folder = f"{shared.shared_dir(spark)}/queries"
    # repeated queries: one vector each; sorted files of bounded row groups are the query blocks
    queries = rows.filter(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("v").alias("v"))
    queries.write.option("parquet.block.row.count.limit", QUERIES).parquet(folder)

    def blocks():
        import pyarrow.parquet as pq
        from pyarrow import fs as pafs

        fs, path = shared.filesystem(folder)
        for f in sorted(x.path for x in fs.get_file_info(pafs.FileSelector(path)) if x.path.endswith(".parquet")):
            with fs.open_input_file(f) as file:
                for batch in pq.ParquetFile(file).iter_batches(QUERIES):
                    yield from _matrices(batch)

    def search(batches):
        # components of 16 bits, the usual case, wait in as many
        narrow = lambda m: m.astype(np.int16) if np.abs(m).max(initial=0) < 2**15 else m
        own = [(i[lo : lo + ROWS], narrow(m[lo : lo + ROWS])) for batch in batches for i, m in _matrices(batch) for lo in range(0, len(m), ROWS)]
        for q_ids, q in blocks() if own else ():
            top: list[list[tuple]] = [[] for _ in q_ids]
            for c_ids, c in own:
                if c.shape[1] != q.shape[1]:
                    continue
                floor = np.array([float(t[-1][0]) if len(t) >= k else -np.inf for t in top])
                qi, ci, s = best(q_ids, q, c_ids, c, k, floor)
                for x, y, z in zip(qi.tolist(), c_ids[ci].tolist(), s.tolist(), strict=True):
                    top[x].append((z, y))
                for x in np.unique(qi).tolist():
                    top[x] = sorted(top[x], key=lambda t: (-t[0], t[1]))[:k]
            flat = [(x, y, int(z)) for x, t in zip(q_ids.tolist(), top, strict=True) for z, y in t]
            yield pa.RecordBatch.from_arrays([pa.array([f[j] for f in flat], pa.int64()) for j in range(3)], names=["query_id", "vec_id", "score"])

    found = rows.mapInArrow(search, "query_id long, vec_id long, score long")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op9_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))


SQL = f"""
WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM e q JOIN e c ON q.vec_id % {EVERY} = 0 AND c.vec_id <> q.vec_id AND len(q.v) = len(c.v)),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= {K}
"""
