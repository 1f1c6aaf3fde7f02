"""Sums that do not depend on the order of the rows."""

from pyspark.sql import functions as F

from tidemark.functions.numeric import steady_avg, steady_sum


def test_steady_sum(spark):
    values = {
        "up": [0.1, 0.2, 0.3], "down": [0.3, 0.2, 0.1], "huge": [1e30, 1.0], "nan": [float("nan"), 1.0], "none": [None, None],
        "gap": [None, 2.5], "full": [9e17, 9e17, 9e17],
    }
    rows = spark.createDataFrame([(k, v) for k, vs in values.items() for v in vs], "k string, v double").coalesce(1)
    plain = {r.k: r.s for r in rows.groupBy("k").agg(F.sum("v").alias("s")).collect()}
    assert plain["up"] != plain["down"]
    got = {r.k: (r.s, r.a) for r in rows.groupBy("k").agg(steady_sum(F.col("v")).alias("s"), steady_avg(F.col("v")).alias("a")).collect()}
    assert got["up"] == got["down"] == (0.6, 0.6 / 3)
    assert got["huge"] == (1e30, 5e29) and got["none"] == (None, None) and got["gap"] == (2.5, 2.5)
    assert got["nan"][0] != got["nan"][0] and got["full"] == (2.7e18, 9e17)
