import datetime as dt

from pyspark.sql import functions as F

from tidemark.operators.asof import asof_rate
from tidemark.operators.calendar import Calendar, cover_anchors
from tidemark.operators.ingest import convert_to_numeraire
from tidemark.sources.tables import change_counts, first_per_key, upsert, write_by_year

D = dt.date


def test_upsert_is_idempotent_and_overwrites(spark):
    old = spark.createDataFrame([("a", 1, 1.0), ("b", 1, 2.0)], "k string, t int, v double")
    new = spark.createDataFrame([("b", 1, 5.0), ("c", 1, 6.0)], "k string, t int, v double")
    once = upsert(old, new, ["k", "t"])
    twice = upsert(once, new, ["k", "t"])
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, twice.collect())) == [("a", 1, 1.0), ("b", 1, 5.0), ("c", 1, 6.0)]
    assert {r["action"]: r["n"] for r in change_counts(old, new, ["k", "t"]).collect()} == {"kept": 1, "updated": 1, "inserted": 1}
    repeat = {r["action"]: r["n"] for r in change_counts(once, new, ["k", "t"]).collect()}
    assert repeat == {"kept": 1, "unchanged": 2}


def test_first_per_key_keeps_the_lowest_id(spark):
    df = spark.createDataFrame([("a", 3, 1.0), ("a", 1, 2.0), ("a", 2, 3.0)], "k string, id int, v double")
    assert [tuple(r) for r in first_per_key(df, ["k"], "id").select("k", "id", "v").collect()] == [("a", 1, 2.0)]


def test_dynamic_year_overwrite_keeps_other_years(spark, tmp_path):
    rows = [("a", D(2020, 5, 1), 1.0), ("a", D(2021, 5, 1), 2.0)]
    write_by_year(spark.createDataFrame(rows, "symbol string, ts date, v double"), str(tmp_path / "t"))
    write_by_year(spark.createDataFrame([("a", D(2021, 5, 1), 9.0)], "symbol string, ts date, v double"), str(tmp_path / "t"))
    assert sorted(r["v"] for r in spark.read.parquet(str(tmp_path / "t")).collect()) == [1.0, 9.0]


def test_rate_policies(spark):
    rates = spark.createDataFrame([(D(2020, 1, 10), 1.0), (D(2020, 1, 20), 2.0)], "ts date, close double")
    times = spark.createDataFrame([(D(2020, 1, 5),), (D(2020, 1, 15),), (D(2020, 2, 1),)], "ts date")
    strict = {r["ts"].isoformat(): r["rate"] for r in asof_rate(times, rates).collect()}
    clamp = {r["ts"].isoformat(): r["rate"] for r in asof_rate(times, rates, policy="clamp").collect()}
    assert strict == {"2020-01-05": None, "2020-01-15": 1.0, "2020-02-01": 2.0}
    assert clamp["2020-01-05"] == 1.0


def test_cover_is_the_asof_join_for_every_frequency(spark):
    days = [D(2020, 1, 1), D(2020, 1, 9), D(2020, 3, 2), D(2020, 8, 30), D(2021, 2, 3)]
    rows = spark.createDataFrame([("a", d) for d in days], "symbol string, ts date")
    for frequency in ("weekly", "monthly", "quarterly"):
        cal = Calendar.between(frequency, D(2020, 1, 5), D(2021, 4, 1))
        anchors = [r["anchor"] for r in cal.frame(spark).orderBy("anchor").collect()]
        got = {r["anchor"]: r["ts"] for r in cover_anchors(rows, cal, ["symbol"]).collect()}
        assert got == {a: max(d for d in days if d <= a) for a in anchors}


def test_quarterly_anchors_follow_the_start_month():
    assert Calendar.between("quarterly", D(2020, 2, 1), D(2021, 1, 1)).first == D(2020, 2, 1)
    assert Calendar.between("quarterly", D(2020, 2, 2), D(2021, 1, 1)).first == D(2020, 5, 1)


def test_conversion_uses_conservative_bounds(spark):
    candle = spark.createDataFrame([("x", D(2020, 1, 1), 10.0, 12.0, 8.0, 11.0, 100.0)], "symbol string, ts date, open double, high double, low double, close double, volume double")
    rates = spark.createDataFrame([(D(2020, 1, 1), 50.0, 40.0, 45.0), (D(2020, 1, 2), 0.0, 1.0, 1.0)], "ts date, high double, low double, close double")
    row = convert_to_numeraire(candle, rates).first()
    assert (row["open"], row["high"], row["low"], row["close"], row["volume"]) == (10 / 45, 12 / 40, 8 / 50, 11 / 45, 1100 / 45)


def test_threshold_alerts_rearm(spark):
    from tidemark.operators.signals import threshold_alerts

    path = [30.0, 18.0, 15.0, 25.0, 19.0, 20.0]
    rows = [("a", D(2020, 1, i + 1), d) for i, d in enumerate(path)] + [("b", D(2020, 1, 1), 5.0)]
    distances = spark.createDataFrame(rows, "symbol string, ts date, distance double")
    watch = spark.createDataFrame([("a", 20.0), ("b", None)], "symbol string, threshold_pct double")
    got = sorted((r["symbol"], r["ts"].day) for r in threshold_alerts(distances, watch).collect())
    assert got == [("a", 2), ("a", 5), ("b", 1)]
    assert distances.filter(F.col("distance") < 0).count() == 0
