from pyspark.sql import functions as F

from quillon.operators import content, ranks


def test_places_equal_a_window(spark):
    rows = [(None if k % 7 == 0 else k % 3, (k * 37) % 11, k) for k in range(500)] + [(1, 5, 0)] * 200
    df = spark.createDataFrame(rows, "g int, v int, k int")
    got = ranks.ranked(df, ["g"], [F.desc("v"), F.asc("k")], "place", "size").collect()
    assert len(got) == len(rows)
    groups = {}
    for r in got:
        groups.setdefault(r.g, []).append(r)
    for g, own in groups.items():
        assert sorted(r.place for r in own) == list(range(1, len(own) + 1)) and {r["size"] for r in own} == {len(own)}
        assert [(r.v, r.k) for r in sorted(own, key=lambda r: r.place)] == sorted([(v, k) for x, v, k in rows if x == g], key=lambda t: (-t[0], t[1]))


def test_places_of_all_rows_of_equal_rows_and_of_none(spark):
    same = spark.createDataFrame([(1, "x")] * 300, "place int, __tie string")
    assert sorted(r.place for r in ranks.ranked(same, [], [F.asc("__tie")]).collect()) == list(range(1, 301))
    assert ranks.ranked(same.filter("false"), ["__tie"], [F.asc("place")], "nr").collect() == []


def test_tiles_are_those_of_ntile(spark):
    df = spark.createDataFrame([(g, k) for g in range(9) for k in range(g)], "g int, k int")
    df = df.select("g", (F.col("k") + 1).alias("p"), F.expr("ntile(4) over (partition by g order by k)").alias("want"), ranks.tile(F.col("k") + 1, F.col("g"), 4).alias("got"))
    assert all(r.want == r.got for r in df.collect())
    starts = df.groupBy("g", "got").agg(F.min("p").alias("p")).withColumn("start", ranks.tile_start(F.col("got"), F.col("g"), 4))
    assert all(r.p == r.start for r in starts.collect())


def test_precedence_takes_the_newest_of_the_best_tier(spark):
    rows = [("a", "x", 2, "2024-01-02", 1), ("a", "y", 1, "2024-01-01", 2), ("a", "y", 1, None, 0), ("a", "z", 1, "2024-01-01", 1), ("b", "x", 3, "2024-01-01", 9), ("b", "x", 3, "2024-01-01", 4)]
    df = spark.createDataFrame(rows, "claim string, value string, tier int, day string, src int").withColumn("day", F.to_date("day"))
    got = {r.claim: (r.value, r.src, r.conflict) for r in content.precedence(df, ["claim"], "value", "tier", "day", "src").collect()}
    assert got == {"a": ("z", 1, True), "b": ("x", 4, False)}
