from __future__ import annotations

from pyspark.sql import functions as F

from areascreen.operators import skew


def test_salted_join_equals_plain_join_with_a_hot_key(spark, monkeypatch):
    monkeypatch.setattr(skew, "HOT_ROWS", 10)
    left = spark.createDataFrame([(i, "hot" if i % 3 == 0 else f"k{i % 40}") for i in range(600)], "id int, k string")
    right = spark.createDataFrame([("hot", 1), ("hot", 2), ("k1", 3), ("k999", 4)], "k string, v int")
    hot = skew.hot_keys(left, ["k"], share=0.05).collect()
    assert [r["k"] for r in hot] == ["hot"] and hot[0]["_salts"] > 1
    for how in ("inner", "left"):
        got = skew.salted_join(left, right, ["k"], spread=["id"], how=how, share=0.05)
        expected = left.join(right, "k", how)
        assert sorted(map(str, got.select("id", "k", "v").collect())) == sorted(map(str, expected.select("id", "k", "v").collect()))


def test_a_key_hot_on_both_sides_is_split_both_ways(spark, monkeypatch):
    monkeypatch.setattr(skew, "HOT_ROWS", 10)
    left = spark.createDataFrame([(i, "hot" if i % 2 else f"k{i % 40}") for i in range(400)], "id int, k string")
    right = spark.createDataFrame([(i, "hot" if i % 2 else f"k{i % 30}") for i in range(300)] + [(0, None)], "v int, k string")
    got = skew.salted_join(left, right, ["k"], spread=["id"], share=0.05)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "_side" in plan and "_salt" in plan
    expected = left.join(right, "k")
    assert got.columns == expected.columns
    assert sorted(map(str, got.collect())) == sorted(map(str, expected.collect()))
    odd = skew.salted_join(left, right, ["k"], spread=["id"], share=0.05, condition=F.col("v") > F.col("id"))
    assert odd.count() == expected.filter("v > id").count()
    outer = skew.salted_join(left, right, ["k"], spread=["id"], share=0.05, how="left")
    assert outer.count() == left.join(right, "k", "left").count()


def test_no_piece_of_a_key_hot_on_both_sides_grows_with_it(spark, monkeypatch):
    monkeypatch.setattr(skew, "HOT_ROWS", 50)
    for rows in (1000, 4000):
        left = spark.range(rows).select(F.col("id"), F.when(F.col("id") % 2 == 0, 0).otherwise(F.col("id")).alias("k"))
        right = left.withColumnRenamed("id", "v")
        seen = []
        joined = type(left).join

        def spy(self, other, on=None, how=None):
            if isinstance(on, list) and "_side" in on:
                seen.append((self, other))
            return joined(self, other, on, how)

        with monkeypatch.context() as patched:
            patched.setattr(type(left), "join", spy)
            skew.salted_join(left, right, ["k"], spread=["id"], share=1 / 64)
        for side in seen[0]:
            assert side.groupBy("k", "_salt", "_side").count().agg(F.max("count")).first()[0] < 3 * max(50, rows / 64)


def test_known_hot_keys_spare_the_count(spark, monkeypatch):
    left = spark.range(100).select(F.col("id"), (F.col("id") % 3).alias("k"))
    right = spark.range(3).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    known = spark.createDataFrame([(0, 4)], "k long, _salts int")
    monkeypatch.setattr(skew, "hot_keys", None)
    got = skew.salted_join(left, right, ["k"], spread=["id"], found=known)
    assert sorted(map(str, got.collect())) == sorted(map(str, left.join(right, "k").collect()))


def test_first_by_takes_the_least_row_per_key(spark):
    df = spark.createDataFrame([("a", 2, "x"), ("a", 1, "y"), ("b", 5, "z")], "k string, seq int, v string")
    got = sorted(tuple(r) for r in skew.first_by(df, ["k"], ["seq"], count="n").select("k", "seq", "v", "n").collect())
    assert got == [("a", 1, "y", 2), ("b", 5, "z", 1)]


def test_rows_exploded_from_a_small_table_are_not_broadcast(spark):
    from areascreen.operators.geometry import grid

    spots = spark.range(1_000).select((F.col("id") % 50).alias("k"), (F.col("id") * 37 % 4000).cast("double").alias("x"), (F.col("id") * 91 % 4000).cast("double").alias("y"))
    points = spark.range(12_000).select((F.col("id") * 53 % 4001).cast("double").alias("x"), (F.col("id") * 97 % 3989).cast("double").alias("y"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", 300_000)  # the centres fit, their 25 cells each do not
    try:
        near = grid.distances_within(spots, points, 100.0, key="k")
        near.collect()
        plan = near._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "BroadcastHashJoin" not in plan and "SortMergeJoin" in plan
    # The pairs themselves are not shuffled: no exchange above the join.
    assert "Exchange" not in plan.split("SortMergeJoin")[0]
    every = spots.select("k", F.col("x").alias("u"), F.col("y").alias("v")).distinct().crossJoin(points)
    d2 = (F.col("x") - F.col("u")) ** 2 + (F.col("y") - F.col("v")) ** 2
    expected = every.groupBy("k", "x", "y").agg(F.sqrt(F.min(d2)).alias("distance")).filter("distance <= 100")
    assert sorted(map(tuple, near.select("k", "x", "y", "distance").collect())) == sorted(map(tuple, expected.collect()))
