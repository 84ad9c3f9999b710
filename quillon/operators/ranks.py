"""Places in an order, and parts of groups by place, where no task sees a whole group.

Rows are dealt by ranges of (group, order), so a group of any size lies in as many partitions as it
needs; a row's place is its place inside the partition and group plus what the partitions before
hold of the group. Only these counts, one row for each partition and group, meet in a window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillon import storage


def _fresh(name: str, taken: list[str]) -> str:
    low = {c.lower() for c in taken}
    while name in low:
        name += "_"
    return name


def ranked(rows: DataFrame, by: list[str], order: list, name: str = "place", size: str | None = None) -> DataFrame:
    """``rows`` with their place (from 1) in ``order`` within the group ``by``; with ``size`` also the group's size.

    Null is a group like others. Rows that tie get different places, the same ones whenever a task is
    repeated: each row is numbered in a stored table first, and the number comes last in the order,
    so equal rows are dealt to several partitions too. Columns ``name`` and ``size`` are replaced.
    """
    rows = rows.drop(name, *([size] if size else []))
    taken = [*rows.columns, name, size or ""]
    tie, at, part, n, shift, whole = (_fresh(f"__{x}", taken) for x in ("tie", "at", "part", "n", "shift", "whole"))
    base = storage.shared_dir(rows.sparkSession)
    numbered = storage.stored(rows.withColumn(tie, F.monotonically_increasing_id()), "numbered", base)
    keys = [*by, *order, tie]
    # an id is the partition's number, shifted by 33 bits, and the place inside it
    dealt = numbered.repartitionByRange(*keys).sortWithinPartitions(*keys).drop(tie).withColumn(at, F.monotonically_increasing_id())
    dealt = storage.stored(dealt, "dealt", base).withColumn(part, F.shiftright(at, 33))
    counts = dealt.groupBy(part, *by).agg(F.count(F.lit(1)).alias(n), F.min(at).alias(shift))
    group = W.partitionBy(*by) if by else W.partitionBy(F.lit(0))
    before = F.coalesce(F.sum(n).over(group.orderBy(part).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select(F.col(part).alias(f"{part}r"), *[F.col(b).alias(f"{part}r{k}") for k, b in enumerate(by)], (before - F.col(shift) + 1).alias(shift), F.sum(n).over(group).alias(whole))
    on = F.col(part) == F.col(f"{part}r")
    for k, b in enumerate(by):
        on = on & dealt[b].eqNullSafe(F.col(f"{part}r{k}"))
    out = dealt.join(counts, on).withColumn(name, F.col(at) + F.col(shift))
    out = out.withColumn(size, F.col(whole)) if size else out
    return out.select(*rows.columns, name, *([size] if size else []))


def tile(place: Column, size: Column, n: int) -> Column:
    """Which of ``n`` parts of nearly equal size, from 1, a place lies in; the first parts are the larger ones."""
    least, larger = F.floor(size / n), size % n
    head = larger * (least + 1)
    return F.when(place <= head, F.floor((place - 1) / (least + 1))).otherwise(larger + F.floor((place - 1 - head) / F.greatest(least, F.lit(1)))) + 1


def tile_start(part: Column, size: Column, n: int) -> Column:
    """The first place of a part."""
    return (part - 1) * F.floor(size / n) + F.least(part - 1, size % n) + 1
