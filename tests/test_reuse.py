import random
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from quillon.streaming import reuse

T0 = datetime(2024, 3, 1, tzinfo=timezone.utc)


def brute(rows, anchor, minutes=15):
    last, out = {}, {}
    for i, k, ts in sorted(rows, key=lambda r: (r[2], r[0])):
        out[i] = k in last and ts <= last[k] + timedelta(minutes=minutes)
        if anchor == "sliding" or not out[i]:
            last[k] = ts
    return out


def made(n=400, seed=1):
    rng = random.Random(seed)
    return [(i, rng.choice("abc"), T0 + timedelta(seconds=rng.randrange(0, 86_400, 97))) for i in range(n)]


@pytest.mark.parametrize("anchor", reuse.ANCHORS)
def test_steps_out_of_order_equal_the_table(spark, anchor):
    rows = made()
    df = spark.createDataFrame(rows, "id long, k string, ts timestamp")
    arrived = F.timestamp_micros(F.unix_micros("ts") + F.pmod(F.xxhash64("id"), F.lit(900)) * 1_000_000)
    got = reuse.replayed(df, "ts", arrived, ["k"], "id", slices=3, anchor=anchor)
    assert {r.id: r.reused for r in got.collect()} == brute(rows, anchor)


def test_a_stream_goes_on_from_its_checkpoint(spark, tmp_path):
    """Stopped after the first files, and once more in the midst: nothing is lost or judged twice. Rows behind the watermark are dropped."""
    rows = sorted(made(200, 2), key=lambda r: r[2])
    schema = "id long, k string, ts timestamp"
    folder, out, state = (str(tmp_path / x) for x in ("in", "out", "state"))

    def run(part):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(folder)
        stream = spark.readStream.schema(schema).parquet(folder)
        reuse.start(reuse.reused(stream, ["k"], "ts", "id", anchor="first", delay="5 minutes"), out, state).awaitTermination()
        return {r.id: r.reused for r in spark.read.parquet(out).collect()}

    first = run(rows[:120])
    edge = rows[119][2] - timedelta(minutes=5)
    assert set(first) == {r[0] for r in rows[:120] if r[2] <= edge}
    late = (999, "a", rows[60][2])
    run([*rows[120:], late])
    done = run([(1000, "z", rows[-1][2] + timedelta(days=1))])
    want = brute(rows, "first")
    assert {k: v for k, v in done.items() if k != 1000} == want and 999 not in done


def test_empty_tables_and_wrong_anchors(spark):
    df = spark.createDataFrame([], "id long, k string, ts timestamp")
    assert reuse.replayed(df, "ts", F.col("ts"), ["k"], "id").collect() == []
    with pytest.raises(ValueError):
        reuse.reused(df, ["k"], "ts", "id", anchor="last")


def test_pending_requests_are_packed():
    """Thousands of requests of a key are a few values of its state, not one each."""
    import pandas as pd

    class State:
        def __init__(self):
            self.values, self.calls, self.timers = [], 0, set()

        def appendValue(self, v):
            self.values.append(v)
            self.calls += 1

        def get(self):
            return iter(list(self.values)) if self.values else None

        def exists(self):
            return bool(self.values)

        def update(self, v):
            self.values = [v]

        def clear(self):
            self.values = []

    last, pending, timers = State(), State(), set()

    class Handle:
        getValueState = staticmethod(lambda *a: type("V", (), {"exists": lambda s: bool(last.values), "get": lambda s: last.values[0], "update": lambda s, v: last.update(v)})())
        getListState = staticmethod(lambda *a: pending)
        listTimers = staticmethod(lambda: iter(sorted(timers)))
        deleteTimer = staticmethod(timers.discard)
        registerTimer = staticmethod(timers.add)

    p = reuse.processor(15, "first")
    p.init(Handle)
    us = [k * 60_000_000 for k in range(25_000)]
    list(p.handleInputRows(("a",), iter([pd.DataFrame({"_k0": "a", "_ts": us, "_id": range(25_000), "_us": us})]), None))
    assert pending.calls <= 3 and timers == {0}
    at = type("T", (), {"getCurrentWatermarkInMs": lambda s: 60_000 * 20_000})()
    out = pd.concat(p.handleExpiredTimer(("a",), at, None))
    assert out["_id"].tolist() == list(range(20_001)) and out["reused"].tolist() == [k % 16 != 0 for k in range(20_001)]
    assert timers == {60_000 * 20_001} and pending.calls <= 4
