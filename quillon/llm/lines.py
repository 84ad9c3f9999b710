"""Line dedup over overlapping windows of three lines, in DataFrame operations only.

A text is split at line feeds. Each run of three consecutive lines is hashed to 128 bits (two
64-bit hashes), occurrences of equal windows anywhere are put in order (by doc_id, then by line),
and all but the first lose their lines: positions that later occurrences cover are merged into
spans, and the gaps between these spans stay. Windows are judged on the input.

Windows are counted with partial aggregation before they are shuffled, and only windows seen twice
or more join back, as plain equi-join rows that adaptive execution splits if one window is hot.

Columns n_lines and n_removed are replaced where they exist; all others stay, whatever their names.
Texts of fewer than three lines and null texts stay as they are. Rows with a null doc_id come last
in the order. Rows that repeat both doc_id and text count as one occurrence and get equal results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WINDOW = 3


def windows(docs: DataFrame) -> DataFrame:
    """doc_id, key (hash of the text), pos and two hashes of each window of ``docs``' texts."""
    n = F.size("lines")
    at = lambda i, k: F.col("lines")[i + k]
    each = F.transform(
        F.when(n >= WINDOW, F.sequence(F.lit(0), n - WINDOW)).otherwise(F.array().cast("array<int>")),
        lambda i: F.struct(
            i.alias("pos"),
            F.xxhash64(*[at(i, k) for k in range(WINDOW)]).alias("h1"),
            F.xxhash64(F.lit("again"), *[at(i, k) for k in reversed(range(WINDOW))]).alias("h2"),
        ),
    )
    rows = docs.filter("text is not null").select("doc_id", F.xxhash64("text").alias("key"), F.split("text", "\n", -1).alias("lines"))
    return rows.select("doc_id", "key", F.inline(each))


def later(docs: DataFrame) -> DataFrame:
    """doc_id, key and the sorted positions of windows that occur earlier."""
    w = windows(docs)
    place = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("doc_id"), F.col("pos").alias("pos"))
    first = w.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("seen"), F.min(place).alias("first")).filter("seen > 1").drop("seen")
    again = w.join(first, ["h1", "h2"]).filter(place > F.col("first"))
    return again.groupBy("doc_id", "key").agg(F.array_sort(F.collect_set("pos")).alias("gone"))


def dedup(docs: DataFrame) -> DataFrame:
    """``docs`` with text replaced by the lines kept, and n_lines and n_removed."""
    q = "__q"
    while any(c.lower().startswith(q) for c in docs.columns):
        q += "_"
    at_id, at_key, at_gone, at_lines, at_kept, at_text = (f"{q}_{x}" for x in ("id", "key", "gone", "lines", "kept", "text"))
    gone = later(docs.select("doc_id", "text")).select(F.col("doc_id").alias(at_id), F.col("key").alias(at_key), F.col("gone").alias(at_gone))
    rows = docs.join(gone, docs["doc_id"].eqNullSafe(F.col(at_id)) & (F.xxhash64(docs["text"]) == F.col(at_key)), "left")
    lines, n, m = F.split("text", "\n", -1), F.size(F.split("text", "\n", -1)), F.size(at_gone)
    start = lambda k: F.when(k == 0, F.lit(0)).otherwise(F.get(at_gone, k - 1) + WINDOW)
    stop = lambda k: F.coalesce(F.get(at_gone, k), F.size(at_lines))
    kept = F.flatten(F.transform(F.sequence(F.lit(0), m), lambda k: F.slice(at_lines, start(k) + 1, F.greatest(stop(k) - start(k), F.lit(0)))))
    rows = rows.withColumn(at_lines, F.when(F.col(at_gone).isNotNull(), lines)).withColumn(at_kept, F.when(F.col(at_gone).isNotNull(), kept))
    text = F.when(F.col(at_gone).isNull(), F.col("text")).otherwise(F.array_join(at_kept, "\n"))
    n_lines = F.when(F.col("text").isNull(), F.lit(0)).otherwise(n).cast("long")
    removed = F.when(F.col(at_gone).isNull(), F.lit(0)).otherwise(F.size(at_lines) - F.size(at_kept)).cast("long")
    return rows.withColumns({"n_lines": n_lines, "n_removed": removed, at_text: text}).drop("text", at_id, at_key, at_gone, at_lines, at_kept).withColumnRenamed(at_text, "text")


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return dedup(docs).select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


SQL = """
WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents),
e AS (SELECT doc_id, len(lines) AS n, unnest(lines) AS line, generate_subscripts(lines, 1) AS p FROM l WHERE lines IS NOT NULL),
w AS (SELECT doc_id, p, n, line, lead(line, 1) OVER d AS l2, lead(line, 2) OVER d AS l3 FROM e WINDOW d AS (PARTITION BY doc_id ORDER BY p)),
r AS (SELECT doc_id, p, row_number() OVER (PARTITION BY line, l2, l3 ORDER BY doc_id, p) AS k FROM w WHERE p + 2 <= n),
g AS (SELECT DISTINCT doc_id, p + o AS p FROM r, (SELECT unnest([0, 1, 2]) AS o) WHERE k > 1),
k AS (SELECT e.doc_id, count(*) AS n, string_agg(e.line, chr(10) ORDER BY e.p) AS text FROM e LEFT JOIN g ON e.doc_id = g.doc_id AND e.p = g.p WHERE g.p IS NULL GROUP BY e.doc_id)
SELECT l.doc_id, CAST(coalesce(len(l.lines), 0) AS BIGINT) AS n_lines,
  CAST(coalesce(len(l.lines), 0) - coalesce(k.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(k.text, '')) AS kept_sha256
FROM l LEFT JOIN k ON l.doc_id = k.doc_id
"""
