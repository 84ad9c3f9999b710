"""Incremental forms: pairs that arrive are audited batch by batch; equal requests are dropped by watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from quillon.operators import audit

PAIRS = "pair_id long, scope string, source_text string, edited_text string"


def pairs_from_files(spark: SparkSession, folder: str) -> DataFrame:
    """A stream of pairs from JSON files as they come in."""
    return spark.readStream.schema(PAIRS).json(folder)


def audit_stream(pairs: DataFrame, targets: dict[str, DataFrame], path: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Audit each micro-batch and write its summary below ``path``, one folder for each batch.

    An audit needs its pair only, so batches are independent, and a batch that runs again overwrites its own folder.
    """

    def each(batch: DataFrame, number: int) -> None:
        audit.audit(batch, **targets)["summary"].write.mode("overwrite").parquet(f"{path}/batch={number}")

    return pairs.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def without_repeats(requests: DataFrame, key: list[str], ts: str, window: str = "15 minutes") -> DataFrame:
    """Requests without those that equal one within the window before; for streams (``content.repeated_requests`` does it for tables)."""
    return requests.withWatermark(ts, window).dropDuplicatesWithinWatermark(key)

