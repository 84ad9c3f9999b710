"""Statistics that the content procedures ask for: comparable publications, phrases as themes, decision paths, contrasts with intervals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillon import storage
from quillon.functions import text as T


#: Rows of a sweep that are compared with each other at a time.
BLOCK = 1024


def peers(rows: DataFrame, key: str, by: list[str], ts: str, audience: str, ratio: float = 2.0, days: int = 30) -> DataFrame:
    """(key, peers): how many other rows of the same ``by`` have an audience within ``ratio`` and lie within ``days`` days.

    Nothing is paired: the peers of a row are the rows of audiences up to the upper bound less those below the lower one, each
    within the days, and both are counted by a sweep in the order of audience. A sweep holds how many rows
    it has passed by day; it is cut into ranges of equal size, and a range begins with the sums by day of those before it, so
    no task has a whole group. Rows alike in all three are one with a weight. Rows without a positive audience, a date,
    a key or one of ``by`` have none. A ``ratio`` below 1 fits nothing.
    """
    day = F.unix_date(F.col(ts).cast("date"))
    r = rows.select(F.col(key).alias("_key"), *by, day.alias("_day"), F.col(audience).cast("double").alias("_size")).filter("_size > 0 and _day is not null").dropna(subset=["_key", *by])
    base = storage.shared_dir(rows.sparkSession)
    same = [*by, "_day", "_size"]
    points = r.groupBy(*same).agg(F.count(F.lit(1)).alias("_w")).withColumn("_id", F.monotonically_increasing_id())
    points = storage.stored(points, "points", base)
    n = _within(points, by, ratio, days, base) if ratio >= 1 else points.select("_id", F.col("_w").alias("_n"))
    near = r.join(points.join(n, "_id").select(*same, "_n"), same).select("_key", "_n", "_day", "_size", *by)
    # a row counts itself, and the rows that have its key
    found = near.groupBy("_key").agg(F.sum("_n").alias("_n"), F.count(F.lit(1)).alias("_rows"))
    several = near.join(found.filter("_rows > 1").select("_key"), "_key", "left_semi")
    x, y = several.alias("x"), several.alias("y")
    alike = (F.col("x._key") == F.col("y._key")) & (F.abs(F.col("x._day") - F.col("y._day")) <= days) & (F.col("x._size") <= F.col("y._size") * ratio) & (F.col("y._size") <= F.col("x._size") * ratio)
    for c in by:
        alike = alike & (F.col(f"x.{c}") == F.col(f"y.{c}"))
    own = x.join(y, alike).groupBy(F.col("x._key").alias("_key")).agg(F.count(F.lit(1)).alias("_own"))
    found = found.join(own, "_key", "left").select("_key", (F.col("_n") - F.coalesce("_own", "_rows")).alias("peers"))
    return rows.select(key).join(found, F.col(key) == F.col("_key"), "left").select(key, F.coalesce("peers", F.lit(0)).cast("long").alias("peers"))


def _within(points: DataFrame, by: list[str], ratio: float, days: int, base: str) -> DataFrame:
    """(_id, _n): the weight within ``ratio`` and ``days`` of each of the points (by, _day, _size, _w, _id), its own included."""
    storage.ship(points.sparkSession)
    size, event = F.col("_size"), lambda at, kind, side, sign: F.struct(at.alias("_at"), F.lit(kind).alias("_kind"), F.lit(side).alias("_side"), F.lit(sign).alias("_sign"))
    # below: audiences whose multiple doesn't reach the row's; upto: those that don't exceed the row's multiple
    events = F.array(event(size, 0, "below", -1), event(size * ratio, 1, "below", 0), event(size, 1, "upto", 0), event(size * ratio, 2, "upto", 1))
    every = points.select(*by, "_day", "_w", "_id", F.inline(events)).select(F.to_json(F.struct(*by, "_side")).alias("_g"), "_at", "_kind", "_sign", "_day", "_w", "_id")
    order = ["_g", "_at", "_kind"]
    swept = storage.stored(every.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "swept", base)
    heads = swept.groupBy("_part").agg(F.min("_g").alias("_g"))
    sums = swept.filter("_sign = 0").groupBy("_g", "_part", "_day").agg(F.sum("_w").alias("_w"))
    before = heads.alias("h").join(sums.alias("s"), (F.col("h._g") == F.col("s._g")) & (F.col("s._part") < F.col("h._part"))).groupBy("h._part", "h._g", "s._day").agg(F.sum("s._w").alias("_w"))
    before = before.select("_g", F.lit(float("-inf")).alias("_at"), F.lit(0).alias("_kind"), F.lit(0).alias("_sign"), "_day", "_w", F.lit(None).cast("long").alias("_id"), "_part")
    low, high = points.agg(F.min("_day"), F.max("_day")).first()
    if low is None:
        return points.select("_id", F.col("_w").alias("_n"))
    both = swept.unionByName(before).repartition("_part").sortWithinPartitions("_part", *order)

    def work(batches):
        import numpy as np
        import pyarrow as pa

        group, passed = None, None
        for batch in batches:
            names = [(p, g) for p, g in zip(batch.column("_part").to_pylist(), batch.column("_g").to_pylist(), strict=True)]
            day, weight, sign = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("_day", "_w", "_sign"))
            cuts = [0, *[k for k in range(1, len(names)) if names[k] != names[k - 1]], len(names)]
            out = np.zeros(len(names), np.int64)
            for start, stop in zip(cuts, cuts[1:], strict=False):
                if start == stop:
                    continue
                if names[start] != group:
                    group, passed = names[start], np.zeros(high - low + 1, np.int64)
                for lo in range(start, stop, BLOCK):
                    k = slice(lo, min(lo + BLOCK, stop))
                    d, w, s = day[k], weight[k], sign[k]
                    asks, has = np.flatnonzero(s), np.flatnonzero(s == 0)
                    upto = np.concatenate([[0], np.cumsum(passed)])
                    at = d[asks].astype(np.int64) - low
                    n = upto[np.minimum(at + days + 1, len(passed))] - upto[np.maximum(at - days, 0)]
                    close = (np.abs(d[asks][:, None] - d[has][None, :]) <= days) & (has[None, :] < asks[:, None])
                    out[lo + asks] = s[asks] * (n + close @ w[has])
                    np.add.at(passed, d[has] - low, w[has])
            asked = pa.array(sign != 0)
            yield pa.RecordBatch.from_arrays([batch.column("_id").filter(asked), pa.array(out).filter(asked)], names=["_id", "_n"])

    return both.mapInArrow(work, "_id long, _n long").groupBy("_id").agg(F.sum("_n").alias("_n"))


def collocations(rows: DataFrame, corpus: str, text: str, k: int = 50, least: int = 5, score: float = 10.83) -> DataFrame:
    """(corpus, theme, n, docs, llr, place): phrases of two neighbouring tokens that occur together more than chance has it.

    Scored by the log-likelihood ratio of the phrase's two-by-two table of neighbours in the corpus; phrases of fewer than
    ``least`` uses or below ``score`` (one chance in a thousand) don't count, nor do those with a function word or a number. The first
    ``k`` by the number of texts, not of uses, are kept.
    """
    t = rows.select(F.col(corpus).alias("corpus"), T.tokens(T.normalize(text)).alias("t")).filter(F.size("t") > 1)
    # tokens hold no space; equal phrases of a text stand side by side, the first of them counts the text, so no row needs its text's number
    phrases = F.transform(F.sequence(F.lit(0), F.size("t") - 2), lambda i: F.concat(F.get("t", i), F.lit(" "), F.get("t", i + 1)))
    t = t.select("corpus", F.sort_array(phrases).alias("p"))
    each = F.transform("p", lambda x, i: F.struct(x.alias("theme"), F.when((i > 0) & (F.get("p", i - 1) == x), 0).otherwise(1).alias("new")))
    n = t.select("corpus", F.inline(each)).groupBy("corpus", "theme").agg(F.count(F.lit(1)).alias("n"), F.sum("new").alias("docs"))
    n = storage.stored(n, "phrases").withColumns({"x": F.substring_index("theme", " ", 1), "y": F.substring_index("theme", " ", -1)})
    first = n.groupBy("corpus", "x").agg(F.sum("n").alias("nx"))
    second = n.groupBy("corpus", "y").agg(F.sum("n").alias("ny"))
    total = n.groupBy("corpus").agg(F.sum("n").alias("all"))
    word = lambda c: ~T.is_digits(c) & ~F.col(c).isin(*T.FUNCTION_WORDS)
    kept = n.filter((F.col("n") >= least) & word("x") & word("y")).join(first, ["corpus", "x"]).join(second, ["corpus", "y"]).join(total, "corpus")
    a, nx, ny, all_ = (F.col(c).cast("double") for c in ("n", "nx", "ny", "all"))
    cell = lambda o, e: F.when(o > 0, o * F.log(o / e)).otherwise(0.0)
    llr = 2 * (cell(a, nx * ny / all_) + cell(nx - a, nx * (all_ - ny) / all_) + cell(ny - a, (all_ - nx) * ny / all_) + cell(all_ - nx - ny + a, (all_ - nx) * (all_ - ny) / all_))
    scored = kept.select("corpus", "theme", "n", "docs", F.round(llr, 2).alias("llr"), (a > nx * ny / all_).alias("more")).filter((F.col("llr") >= score) & F.col("more")).drop("more")
    place = F.row_number().over(W.partitionBy("corpus").orderBy(F.desc("docs"), F.desc("n"), F.asc("theme"))).cast("long")
    return scored.withColumn("place", place).filter(F.col("place") <= k).withColumnRenamed("corpus", corpus)


def decision_path(events: DataFrame, key: str, steps: list[str], step: str, ts: str, tie: str) -> DataFrame:
    """(key, completed, seconds, out_of_order): how far each key goes through ``steps`` in their order.

    A step is completed by its first event after the step before; ``seconds`` has the whole seconds from one completed step to the next.
    ``out_of_order`` counts events of a step that came before its turn. One aggregate for each step with
    partial results, so a key may have any number of events; events of other steps are only read.
    """
    at = F.struct(F.unix_micros(F.col(ts).cast("timestamp")).alias("us"), F.col(tie).alias("tie"))
    e = events.select(F.col(key).alias("_key"), F.col(step).alias("_step"), at.alias("_at"))
    state = e.select("_key").distinct()
    early = F.lit(0).cast("long")
    for k, name in enumerate(steps):
        mine = e.filter(F.col("_step") == name).select("_key", "_at")
        if k == 0:
            found = mine.groupBy("_key").agg(F.min("_at").alias("_at0"), F.lit(0).cast("long").alias("_early0"))
        else:
            before = state.select(F.col("_key").alias("_k"), F.col(f"_at{k - 1}").alias("_before"))
            joined = mine.join(before, F.col("_key").eqNullSafe(F.col("_k")))
            on_time = F.coalesce(F.col("_at") > F.col("_before"), F.lit(False))
            found = joined.groupBy("_key").agg(F.min(F.when(on_time, F.col("_at"))).alias(f"_at{k}"), F.count_if(~on_time).alias(f"_early{k}"))
        found = found.withColumnRenamed("_key", f"_k{k}")
        state = state.join(found, F.col("_key").eqNullSafe(F.col(f"_k{k}")), "left").drop(f"_k{k}")
        early = early + F.coalesce(f"_early{k}", F.lit(0))
    times = F.array_compact(F.array(*[F.col(f"_at{k}.us") for k in range(len(steps))]))
    seconds = F.transform(F.sequence(F.lit(1), F.greatest(F.size(times) - 1, F.lit(1))), lambda i: F.floor((F.get(times, i) - F.get(times, i - 1)) / 1_000_000))
    seconds = F.when(F.size(times) > 1, seconds).otherwise(F.array().cast("array<bigint>"))
    return state.select(F.col("_key").alias(key), F.size(times).cast("long").alias("completed"), seconds.alias("seconds"), early.alias("out_of_order"))


#: Chances of at most 0, 1, ... of a Poisson variable with mean 1.
POISSON = (0.36787944, 0.73575888, 0.91969860, 0.98101184, 0.99634015, 0.99940582, 0.99991676)


def uniform(*parts):
    """A number in [0, 1) from 32 bits of a hash of columns joined by colons."""
    return F.conv(F.substring(F.sha2(F.concat_ws(":", *parts), 256), 1, 8), 16, 10).cast("double") / 4294967296.0


def contrast_intervals(rows: DataFrame, key: str, feature: str, stratum: str = "stratum", strong: str = "top", weak: str = "bottom", draws: int = 200, blocks: int = 256, least: int = 10, seed: int = 7) -> DataFrame:
    """(feature, strong, weak, lift, low, high, q, limited): the lift of ``content.contrast`` with its interval, and a false-discovery rate over all features.

    A Poisson bootstrap: rows fall into ``blocks`` by a hash of their key, each draw weighs blocks with numbers from a hash, so what is
    repeated is a count for each (feature, block) and not a row, whatever the number of rows. low and high hold 95 % of the draws,
    q corrects (Benjamini, Hochberg) the share of draws on the other side of 1. ``limited`` marks features with fewer than ``least`` rows on a side.
    """
    on = F.col(stratum)
    block = F.floor(uniform(F.lit(f"block{seed}"), F.col(key).cast("string")) * blocks)
    counted = rows.filter(on.isin(strong, weak)).groupBy(F.col(feature).alias("_f"), block.alias("_block")).agg(F.count_if(on == strong).alias("s"), F.count_if(on == weak).alias("w"))
    each = rows.sparkSession.range(draws).select(F.col("id").alias("draw"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("_block"))
    u = uniform(F.lit(f"draw{seed}"), F.col("draw").cast("string"), F.col("_block").cast("string"))
    weight = sum((F.when(u >= p, 1).otherwise(0) for p in POISSON), F.lit(0))
    weights = each.select("draw", "_block", weight.alias("times")).filter("times > 0")
    drawn = counted.join(F.broadcast(weights), "_block")  # draws * blocks rows at most
    per = drawn.groupBy("draw", "_f").agg(F.sum(F.col("s") * F.col("times")).alias("s"), F.sum(F.col("w") * F.col("times")).alias("w"))
    whole = per.groupBy("draw").agg(F.sum("s").alias("_s"), F.sum("w").alias("_w"))
    ratio = lambda s, w, a, b: F.try_divide(F.col(s).cast("double") * F.col(b).cast("double"), F.col(w).cast("double") * F.col(a).cast("double"))
    lifts = per.join(F.broadcast(whole), "draw").select("_f", ratio("s", "w", "_s", "_w").alias("lift"))  # draws rows
    rank = lambda share: F.get(F.col("_lifts"), F.greatest(F.ceil(F.size("_lifts") * share) - 1, F.lit(0)).cast("int"))
    spread = lifts.groupBy("_f").agg(F.array_sort(F.collect_list("lift")).alias("_lifts"), F.count_if(F.col("lift") <= 1).alias("_below"), F.count_if(F.col("lift") >= 1).alias("_above"), F.count("lift").alias("_n"))  # draws values a feature
    chance = F.when(F.col("_n") > 0, F.least(F.lit(1.0), 2 * F.least(F.col("_below"), F.col("_above")) / F.col("_n"))).otherwise(F.lit(1.0))
    spread = spread.select("_f", rank(0.025).alias("low"), rank(0.975).alias("high"), F.round(chance, 9).alias("_p"))
    exact = counted.groupBy("_f").agg(F.sum("s").alias("strong"), F.sum("w").alias("weak"))
    sums = exact.agg(F.sum("strong").alias("_s"), F.sum("weak").alias("_w"), F.count(F.lit(1)).alias("_m"))
    # shares of draws have few values, so the correction orders values and not features
    values = spread.groupBy("_p").agg(F.count(F.lit(1)).alias("_c")).join(F.broadcast(sums.select("_m")))  # one row
    upto = values.withColumn("_rank", F.sum("_c").over(W.orderBy("_p")))
    corrected = upto.withColumn("q", F.min(F.least(F.lit(1.0), F.col("_p") * F.col("_m") / F.col("_rank"))).over(W.orderBy(F.desc("_p")))).select("_p", "q")
    out = exact.join(F.broadcast(sums)).withColumnRenamed("_f", "_g").join(spread, F.col("_g").eqNullSafe(F.col("_f")), "left").join(corrected, "_p", "left")
    return out.select(F.col("_g").alias(feature), "strong", "weak", ratio("strong", "weak", "_s", "_w").alias("lift"), "low", "high", "q", ((F.col("strong") < least) | (F.col("weak") < least)).alias("limited"))
