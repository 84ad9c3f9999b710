"""Requests that repeat within some minutes, as keyed state over a stream.

A request is judged when the watermark has passed it, so rows that arrive out of order, up to the delay, count as if
they had come in order, and the result equals that of the same rows as a table (``content.repeated_requests``).
Per key the state holds one timestamp and the requests that the watermark hasn't passed yet, which the
delay bounds, whatever number of requests the key has. Rows that come after the watermark are dropped, as in every
stateful operator of a stream; ``late`` in the query's progress counts them.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import BooleanType, LongType, StructType

from quillon import storage

#: What the last request that counts is: the one that opened the window, or the one before.
ANCHORS = ("first", "sliding")
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: A request in the state, and how many of them are one value of it.
REQUEST = np.dtype([("us", "<i8"), ("id", "<i8"), ("null", "?")])
PACK = 10_000
PROVIDER = "spark.sql.streaming.stateStore.providerClass"


def processor(minutes: int, anchor: str) -> StatefulProcessor:
    """The state of a key. The class is made here, so that it goes to the driver's own worker whole and not by its name."""
    window, slides = minutes * 60_000_000, anchor == "sliding"

    class Reuse(StatefulProcessor):
        """Pending requests wait for the watermark; a timer stands at the earliest of them."""

        def init(self, handle: StatefulProcessorHandle) -> None:
            self.handle = handle
            self.last = handle.getValueState("last", "us long")
            self.pending = handle.getListState("pending", "first long, rows binary")

        def _put(self, rows: np.ndarray) -> None:
            """Requests (us, id), packed: a call for each row would cost more than all else."""
            for k in range(0, len(rows), PACK):
                part = rows[k : k + PACK]
                self.pending.appendValue((int(part["us"].min()), part.tobytes()))

        def handleInputRows(self, key, rows, timerValues):
            first = None
            for pdf in rows:  # columns by place: the runner doesn't pass their names
                part = np.empty(len(pdf), REQUEST)
                part["us"], part["id"], part["null"] = pdf.iloc[:, -1], pdf.iloc[:, -2].fillna(0), pdf.iloc[:, -2].isna()
                if len(part):
                    self._put(part)
                    low = int(part["us"].min())
                    first = low if first is None else min(first, low)
            if first is not None:
                self._wait(first)
            return iter(())

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
            # rows up to here are complete: Spark drops what is not after the watermark
            done = timerValues.getCurrentWatermarkInMs() * 1000
            every = np.concatenate([np.empty(0, REQUEST), *[np.frombuffer(r[1], REQUEST) for r in self.pending.get()]])
            every.sort(order=["us", "id"])
            ready, rest = np.split(every, [np.searchsorted(every["us"], done, "right")])
            last = self.last.get()[0] if self.last.exists() else None
            reused = np.zeros(len(ready), bool)
            if len(ready):
                us = ready["us"]
                if slides:
                    reused[1:] = us[1:] - us[:-1] <= window
                    reused[0] = last is not None and us[0] <= last + window
                    last = int(us[-1])
                else:
                    k = 0
                    while k < len(us):  # from window to window
                        if last is None or us[k] > last + window:
                            last, k = int(us[k]), k + 1
                        stop = int(np.searchsorted(us, last + window, "right"))
                        reused[k:stop] = True
                        k = max(k, stop)
                self.last.update((last,))
            self.pending.clear()
            self._put(rest)
            if len(rest):
                self._wait(int(rest["us"][0]), expired=True)
            for k in range(0, len(ready), PACK):
                part = ready[k : k + PACK]
                yield pd.DataFrame({**{f"_k{i}": [x] * len(part) for i, x in enumerate(key)}, "_id": pd.Series(part["id"]).astype("Int64").mask(part["null"]), "reused": reused[k : k + PACK]})

        def _wait(self, us: int, expired: bool = False) -> None:
            """A timer at ``us``, unless an earlier one stands; one that has expired is still listed."""
            at = -(-us // 1000)
            for t in list(self.handle.listTimers()):
                if t <= at and not expired:
                    return
                self.handle.deleteTimer(t)
            self.handle.registerTimer(at)

        def close(self) -> None:
            pass

    return Reuse()


def reused(requests: DataFrame, key: list[str], ts: str, row: str, minutes: int = 15, anchor: str = "first", delay: str = "15 minutes") -> DataFrame:
    """(key, row, reused) of a stream of requests; ``row`` is a number that names a request and breaks ties of time."""
    if anchor not in ANCHORS:
        raise ValueError(f"anchor must be one of {ANCHORS}")
    storage.ship(requests.sparkSession)
    rows = requests.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(key)], F.col(ts).cast("timestamp").alias("_ts"), F.col(row).cast("long").alias("_id"))
    rows = rows.withWatermark("_ts", delay).withColumn("_us", F.unix_micros("_ts"))
    names = [f"_k{i}" for i in range(len(key))]
    schema = StructType([rows.schema[n] for n in names]).add("_id", LongType()).add("reused", BooleanType())
    out = rows.groupBy(*names).transformWithStateInPandas(statefulProcessor=processor(minutes, anchor), outputStructType=schema, outputMode="Append", timeMode="EventTime")
    return out.select(*[F.col(n).alias(k) for n, k in zip(names, key, strict=True)], F.col("_id").alias(row), "reused")


def start(result: DataFrame, path: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Append a stateful result to Parquet files below ``path``; timers need the RocksDB state store, set for this query alone."""
    conf = result.sparkSession.conf
    before = conf.get(PROVIDER, None)
    conf.set(PROVIDER, ROCKS)
    try:
        return result.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(**(trigger or {"availableNow": True})).start()
    finally:
        conf.unset(PROVIDER) if before is None else conf.set(PROVIDER, before)


def arrivals(rows: DataFrame, ts: str, arrived: Column, folder: str, slices: int):
    """Write ``rows`` below ``folder`` in ``slices`` steps of their arrival (a timestamp), then a row a year behind all others, with nulls.

    A generator that stops after each step, for replays of a table as a stream: the last row moves the
    watermark past everything. ``ts`` becomes a timestamp with time zone.
    """
    rows = rows.withColumn(ts, F.col(ts).cast("timestamp"))
    at = F.unix_micros(arrived.cast("timestamp"))
    low, high = rows.agg(F.min(at), F.max(at)).first()
    if low is None:
        return
    part = F.least(F.floor((at - low) * slices / (high - low + 1)), F.lit(slices - 1))
    for k in range(slices):
        rows.filter(part == k).write.mode("append").parquet(folder)
        yield k
    end = [F.timestamp_micros(F.lit(high + 365 * 86_400_000_000)) if c == ts else F.lit(None).cast(t) for c, t in rows.dtypes]
    rows.sparkSession.range(1).select(*[x.alias(c) for x, c in zip(end, rows.columns, strict=True)]).write.mode("append").parquet(folder)
    yield slices


def replayed(rows: DataFrame, ts: str, arrived: Column, key: list[str], row: str, slices: int = 4, **options) -> DataFrame:
    """The result of ``reused`` over a table's rows, in the order of their arrival.

    Each step is a run of its own, which goes on from the checkpoint of the one before, and one micro-batch, whatever its files.
    """
    spark, base = rows.sparkSession, storage.shared_dir(rows.sparkSession)
    schema = rows.withColumn(ts, F.col(ts).cast("timestamp")).schema
    out = None
    for _ in arrivals(rows, ts, arrived, f"{base}/in", slices):
        stream = reused(spark.readStream.schema(schema).parquet(f"{base}/in"), key, ts, row, **options)
        start(stream, f"{base}/out", f"{base}/state").awaitTermination()
        out = spark.read.schema(stream.schema).parquet(f"{base}/out").filter(F.col(row).isNotNull())
    return spark.createDataFrame([], StructType([schema[k] for k in key]).add(row, LongType()).add("reused", BooleanType())) if out is None else out
