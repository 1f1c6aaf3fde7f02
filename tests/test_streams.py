"""Streams over several micro-batches with late and out-of-order rows."""

import datetime as dt
import random

from pyspark.sql import functions as F

from tidemark.operators.signals import threshold_alerts
from tidemark.sources.store import ChangeLog
from tidemark.streaming import jobs

T = dt.datetime


def test_alerts_do_not_depend_on_the_order_of_batches(spark, tmp_path):
    rng = random.Random(1)
    rows = [(s, T(2020, 1, 1) + dt.timedelta(days=k), round(rng.uniform(0, 40), 3)) for s in "abc" for k in range(40)]
    watch = spark.createDataFrame([("a", 20.0), ("b", None)], "symbol string, threshold_pct double")
    schema = "symbol string, ts timestamp, distance double"
    want = threshold_alerts(spark.createDataFrame(rows, schema), watch, 10.0).collect()
    before = spark.conf.get(jobs.STATE_STORE[0])
    session = jobs.stateful_session(spark)
    known = session.createDataFrame([("a", 20.0), ("b", None)], "symbol string, threshold_pct double")
    rng.shuffle(rows)
    landing, out, checkpoint = (str(tmp_path / n) for n in ("in", "out", "checkpoint"))
    seen = []
    for part in (rows[:40], rows[40:80], rows[80:], [("beat", T(2021, 1, 1), None)]):
        spark.createDataFrame(part, schema).write.mode("append").parquet(landing)
        feed = session.readStream.schema(schema).option("maxFilesPerTrigger", 2).parquet(landing)
        jobs.run_available(jobs.alert_stream(feed, known, 10.0, "60 days"), out, checkpoint)
        seen.append(spark.read.schema(jobs.ALERT_SCHEMA).parquet(out).count())
    got = spark.read.schema(jobs.ALERT_SCHEMA).parquet(out).collect()
    assert seen[:3] == [0, 0, 0]  # nothing fires before the watermark has passed it
    assert sorted(map(str, got)) == sorted(map(str, want)) and want
    assert spark.conf.get(jobs.STATE_STORE[0]) == before


def test_alerts_fire_as_the_watermark_passes_and_keep_the_last_distance(spark, tmp_path):
    session = jobs.stateful_session(spark)
    known = session.createDataFrame([("a", 20.0)], "symbol string, threshold_pct double")
    schema, day = "symbol string, ts timestamp, distance double", lambda k: T(2020, 1, 1) + dt.timedelta(days=k)
    landing, out, checkpoint = (str(tmp_path / n) for n in ("in", "out", "checkpoint"))
    seen = []
    for part in ([("a", day(2), 15.0), ("a", day(0), 30.0)], [("a", day(1), 10.0), ("a", day(9), 12.0)], [("beat", day(30), 0.0)], [("a", day(40), 25.0), ("a", day(41), 5.0), ("beat", day(90), 0.0)]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(landing)
        jobs.run_available(jobs.alert_stream(session.readStream.schema(schema).parquet(landing), known, 10.0, "5 days"), out, checkpoint)
        seen.append(sorted((r.ts - day(0)).days for r in spark.read.schema(jobs.ALERT_SCHEMA).parquet(out).collect()))
    assert seen[-1] == [1, 41] and seen[0] == []


def test_candles_of_late_trades_over_many_batches(spark, tmp_path):
    rng = random.Random(2)
    rows = [(rng.choice("xy"), T(2024, 1, 1) + dt.timedelta(minutes=rng.randrange(4 * 1440)), rng.random(), 1.0, k) for k in range(400)]
    ticks = spark.createDataFrame(rows, "symbol string, ts timestamp, price double, size double, seq long")
    landing, checkpoint, log = str(tmp_path / "in"), str(tmp_path / "checkpoint"), ChangeLog(str(tmp_path / "candles"))
    batches = []
    for part in (rows[:150], rows[150:300], rows[300:]):
        spark.createDataFrame(part, ticks.schema).repartition(2).write.mode("append").parquet(landing)
        feed = spark.readStream.schema(ticks.schema).option("maxFilesPerTrigger", 1).parquet(landing)
        sink = log.sink(every=4)
        jobs.run_available(jobs.candle_stream(feed, "10 days"), log.path, checkpoint, "update", lambda b, k: (batches.append(k), sink(b, k)))
    assert len(batches) >= 6
    want = ticks.groupBy("symbol", F.to_date("ts").alias("ts")).agg(
        F.min_by("price", F.struct("ts", "seq")).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"),
        F.max_by("price", F.struct("ts", "seq")).alias("close"), F.sum("size").alias("volume"),
    )
    assert sorted(map(str, log.read(spark).select(*want.columns).collect())) == sorted(map(str, want.collect()))
