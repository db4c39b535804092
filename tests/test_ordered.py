"""Sliced scans must equal plain windows, also with empty slices and one hot group."""

import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from pressline.functions import ordered


def make(spark, n=400):
    rng = random.Random(3)
    rows = []
    for i in range(n):
        key = "hot" if rng.random() < 0.7 else rng.choice("abc")
        rows.append((key, rng.randrange(0, 50_000), i, rng.choice(["x", "y", None]), rng.randrange(5)))
    return spark.createDataFrame(rows, "k string, t long, f long, v string, n long")


def same(a, b):
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_previous_row(spark):
    df = make(spark)
    got = ordered.previous_row(df, ["k"], ["t", "f"], ordered.time_slices("t", [500, 5000]), ["v", "f"])
    w = Window.partitionBy("k").orderBy("t", "f")
    same(got, df.withColumns({"prev_v": F.lag("v").over(w), "prev_f": F.lag("f").over(w)}))


def test_running_sums_and_row_numbers(spark):
    df = make(spark)
    slices = ordered.time_slices("t", [300, 6000])
    got = ordered.running_sums(df, ["k"], ["t", "f"], slices, {"s": F.col("n"), "rn": F.lit(1).cast("long")})
    w = Window.partitionBy("k").orderBy("t", "f").rowsBetween(Window.unboundedPreceding, 0)
    same(got, df.withColumns({"s": F.sum("n").over(w), "rn": F.count(F.lit(1)).over(w)}))
    no_key = ordered.row_numbers(df, [], ["t", "f"], slices)
    assert sorted(r.rn for r in no_key.collect()) == list(range(1, df.count() + 1))


def test_last_seen(spark):
    df = make(spark)
    mark = F.when(F.col("n") == 3, F.col("f"))
    got = ordered.last_seen(df, ["k"], ["t", "f"], ordered.time_slices("t", [300, 6000]), mark, "s")
    w = Window.partitionBy("k").orderBy("t", "f").rowsBetween(Window.unboundedPreceding, -1)
    same(got, df.withColumn("s", F.last(mark, ignorenulls=True).over(w)))


def test_recent_rows(spark):
    df = make(spark)
    aggs = {"c": F.count_if(F.col("v") == "x"), "m": F.max("n")}
    got = ordered.recent_rows(df, ["k"], ["t", "f"], ordered.time_slices("t", [300, 6000]), 7, aggs, block=16)
    w = Window.partitionBy("k").orderBy("t", "f").rowsBetween(-7, -1)
    same(got, df.withColumns({n: a.over(w) for n, a in aggs.items()}))


def test_exact_quantiles(spark):
    df = make(spark).withColumn("x", (F.col("t") - 20_000) / 7.0)
    probs = {"q0": 0.0, "q25": 0.25, "q5": 0.5, "q95": 0.95, "q1": 1.0}
    got = {r.k: r for r in ordered.exact_quantiles(df, ["k"], "x", probs).collect()}
    for r in df.groupBy("k").agg(*[F.percentile("x", F.lit(p)).alias(n) for n, p in probs.items()]).collect():
        for n in probs:
            assert abs(got[r.k][n] - r[n]) < 1e-9


def test_value_slices_follow_the_data(spark):
    n = 20_000
    narrow = spark.range(n).select(F.lit("a").alias("k"), (1000 + F.col("id") * 10 / n).alias("v"))
    scores = spark.range(n).select(F.lit("b").alias("k"), (0.001 + F.col("id") * 1e-9).alias("v"))
    far = spark.createDataFrame([("c", 1e12), ("c", -1e12), (None, 1.0)], "k string, v double")
    df = narrow.unionByName(scores).unionByName(narrow.withColumn("k", F.lit("c"))).unionByName(far)
    out = ordered.with_value_slice(df, ["k"], "v", "s")
    sizes = out.groupBy("k", "s").count().groupBy("k").agg(F.max("count").alias("most"), F.avg("count").alias("mean"))
    found = {r["k"]: r for r in sizes.collect()}
    assert len(found) == 4 and all(found[k]["most"] <= 2 * found[k]["mean"] + 1 for k in "ab")
    assert found["c"]["most"] <= n / 32  # beside far outliers only the outermost part is one slice
    assert out.count() == df.count()
    w = Window.partitionBy("k").orderBy("v")
    assert out.withColumn("back", F.lag("s").over(w) > F.col("s")).where("back").isEmpty()
