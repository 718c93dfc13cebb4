from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestrata.operators import inventory, ranking


def test_places_of_a_skewed_table(spark):
    df = spark.range(3000, numPartitions=5).select((F.col("id") % 3 * (F.col("id") % 7)).alias("k"), F.when(F.col("id") % 11 == 0, None).otherwise(F.col("id")).alias("v"), F.lit("x").alias("place_"))
    got = ranking.ranked(df, [F.col("k").desc(), "v"]).collect()
    assert sorted(r.place for r in got) == list(range(1, 3001))
    by = sorted(got, key=lambda r: r.place)
    key = lambda r: (-r.k, r.v is not None, r.v or 0)
    assert [key(r) for r in by] == sorted(map(key, by))
    same = spark.range(100).select(F.lit(1).alias("a"))
    assert sorted(r.place for r in ranking.ranked(same, ["a"]).collect()) == list(range(1, 101)) and ranking.ranked(same.limit(0), ["a"]).count() == 0


def test_dense_ranks_and_running_sums(spark):
    df = spark.createDataFrame([("b",), ("a",), (None,), ("b",), ("c",)], "v string")
    assert sorted(map(repr, (tuple(r) for r in ranking.dense_ranked(df, "v").collect()))) == ["('a', 1)", "('b', 2)", "('b', 2)", "('c', 3)", "(None, None)"]
    rows = spark.range(4000).select(F.when(F.col("id") % 4 == 3, "small").otherwise("hot").alias("g"), "id", (F.col("id") % 5 - 2).alias("v"))
    got = ranking.running_sum(rows, ["g"], ["id"], "v")
    want = rows.withColumn("w", F.sum("v").over(W.partitionBy("g").orderBy("id")))
    assert got.join(want, ["g", "id", "v"]).where("running <> w").isEmpty() and got.count() == 4000


def test_deep_pages_equal_near_ones(spark):
    df = spark.range(500).select((F.col("id") * 7 % 500).alias("a"))
    for offset, limit in ((0, 10), (490, 10), (480, 30), (600, 5), (123, 17)):
        near, deep = (sorted(map(tuple, inventory.page(df, ["a"], limit, offset, near=n).collect())) for n in (10_000, 0))
        assert near == deep and len(near) == max(0, min(limit, 500 - offset))
