"""A training corpus in five stages, each written as Parquet and read again by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm import lines, mixing, near_dups, pieces, quality, shared

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")

#: The classifier and the mixing draw keep no SQL form of their results; tests compare with brute force.
ORACLE_SQL = None


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject; it is trained on this input.

    Null and empty texts and texts without words are rejected. Rows are judged by their text alone, so equal ones
    fare alike, and a null doc_id makes no difference but that it isn't in the sample for the fit.
    """
    model = quality.train(docs.select("doc_id", "text"))
    return quality.score(docs.select(*COLUMNS), model).filter("_keep").select(*COLUMNS)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later occurrences of three-line windows are cut; documents of which nothing is left go.

    Null and empty texts stay as they are. n_chars is set anew where lines were cut, and untouched elsewhere.
    """
    kept = lines.dedup(docs.select(*COLUMNS)).filter("n_removed = 0 or text <> ''")
    return kept.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (similarity of 0.8 or more) stays: the one of the smallest doc_id.

    A document is a pair of doc_id and text: rows that share a doc_id but not a text are compared like
    any others, and rows equal in both are one. A null doc_id comes after all others, ties go by a
    hash. Texts without words are near copies of nothing and stay, one row for each doc_id. The hash that
    stands for a document may be another's too; the two are then compared like any others, and go or stay with the better one.
    """
    rows = docs.select(*COLUMNS, F.xxhash64("doc_id", "text").alias("_row"))
    marks = near_dups.near_duplicates(rows.select(F.col("_row").alias("doc_id"), "text"), num=80, den=100, one_document=False)
    bare = F.when(F.col("root").isNull(), F.col("component_id")).alias("bare")
    groups = marks.select(F.col("doc_id").alias("_row"), "root", bare).distinct().join(rows.select("_row", "doc_id").distinct(), "_row")
    keep = groups.groupBy("root", "bare").agg(F.min_by("_row", F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "_row")).alias("_row")).select("_row")
    x = F.struct(*COLUMNS)
    kept = rows.join(keep, "_row", "left_semi")
    return kept.groupBy("_row", "doc_id", F.sha2("text", 256)).agg(F.min_by(x, x).alias("x")).select("x.*")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample by the probabilities that rake source, language and topic to their targets.

    Null source or language is a group of its own; documents without tokens share their cell's probability, or go
    if it has no tokens. Draws depend on the doc_id alone, so repeated rows fare alike.
    """
    return mixing.mixed(docs.select(*COLUMNS)).filter("_kept").select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_chars, n_ids and the ids of each document; null and empty texts have none, repeated rows equal ones."""
    made = pieces.encoded(docs.select(*COLUMNS))
    return made.select("doc_id", "lang", "source", "n_chars", F.size("ids").cast("long").alias("n_ids"), "ids")


STAGES = [
    ("quality", drop_low_quality),
    ("line dedup", drop_repeated_lines),
    ("near dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("sentencepiece", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    base, docs = shared.shared_dir(spark), spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = shared.stored(stage(spark, docs, sf_dir), f"stage_{k}", base)
    return docs
