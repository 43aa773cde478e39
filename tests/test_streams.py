"""Streams against their batch twins: points out of order, resets, late rows, sessions and sliding windows."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from termlake.streaming import events as E

START = datetime.datetime(2024, 1, 1, tzinfo=datetime.UTC)
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@pytest.fixture
def rocks(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, ROCKS)
    yield spark
    spark.conf.set(name, before)


def at(seconds):
    return START + datetime.timedelta(seconds=seconds)


def run(spark, batches, schema, build, folder):
    """All rows that a stream over the batches, one file each in their order, has appended when none is left."""
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"file://{folder}/in/batch={i}")
        stream = spark.readStream.schema(schema).parquet(f"file://{folder}/in/batch=*")
        query = build(stream).writeStream.format("parquet").option("path", f"file://{folder}/out").option("checkpointLocation", f"file://{folder}/state").trigger(availableNow=True).start()
        assert query.awaitTermination(240)
    return spark.read.parquet(f"file://{folder}/out")


def test_increments_of_a_stream(rocks, tmp_path):
    rnd, points, schema = random.Random(3), [], "series string, ts timestamp, value double"
    for series in "abc":
        total = 0.0
        for i in range(40):
            total = rnd.uniform(0, 3) if rnd.random() < 0.1 else total + rnd.randrange(5)
            points.append((series, at(i * 60 + rnd.randrange(50)), total))
    order = sorted(points, key=lambda p: (p[1] - START).total_seconds() + rnd.uniform(0, 900))  # late by a quarter of an hour at most
    last = [("end", at(86_400), 0.0)]
    batches = [order[:30], order[30:70], order[70:], last, [("end", at(86_401), 0.0), ("a", at(10), 99.0)]]  # the last one is beyond the watermark
    out = run(rocks, batches, schema, lambda s: E.increments_stream(s, "20 minutes"), tmp_path)
    key = lambda df: sorted((r["series"], r["ts"], r["value"], round(r["increment"], 9)) for r in df.where("series <> 'end'").collect())
    assert key(out) == key(E.increments(rocks.createDataFrame(points, schema)))


def test_a_silent_series_leaves_the_state(rocks, tmp_path):
    schema = "series string, ts timestamp, value double"
    batches = [[("a", at(0), 5.0), ("b", at(0), 5.0)], [("b", at(3000), 7.0)], [("b", at(6000), 8.0)], [("b", at(9000), 9.0)], [("a", at(9100), 9.0)], [("b", at(20000), 9.0)], [("b", at(20001), 9.0)]]
    out = run(rocks, batches, schema, lambda s: E.increments_stream(s, "1 minute", keep_seconds=3600), tmp_path)
    assert [(r["value"], r["increment"]) for r in out.where("series = 'a'").orderBy("ts").collect()] == [(5.0, 0.0), (9.0, 0.0)]
    assert [r["increment"] for r in out.where("series = 'b' and ts < '2024-01-01 05:00:00'").orderBy("ts").collect()] == [0.0, 2.0, 1.0, 1.0]


def test_sessions_and_sliding_windows_of_a_stream(spark, tmp_path):
    rnd, schema = random.Random(5), "event_id bigint, ts timestamp, user_id bigint, event_type string"
    rows = [(i, at(rnd.randrange(0, 40_000)), rnd.randrange(5), rnd.choice("xy")) for i in range(300)] + [(900, at(50_000), 1, "x"), (901, at(51_800), 1, "x"), (902, at(53_601), 1, "x")]
    order = sorted(rows, key=lambda r: (r[1] - START).total_seconds() + rnd.uniform(0, 1500))
    last = [(999, at(200_000), 99, "z")]
    batches = [order[:100], order[100:220], order[220:], last, [(1000, at(200_001), 99, "z"), (5, at(5), 1, "x")]]
    batch = spark.createDataFrame(rows, schema)
    out = run(spark, batches, schema, lambda s: E.sessions_stream(s, 1800, "30 minutes"), tmp_path / "a")
    key = lambda df: sorted(tuple(r) for r in df.select("user_id", "session_start", "n").where("user_id < 99").collect())
    assert key(out) == key(E.sessions(batch)) and (1, at(50_000).replace(tzinfo=None), 2) in key(out)
    out = run(spark, batches, schema, lambda s: E.sliding_stream(s, ["event_type"], late="30 minutes"), tmp_path / "b")
    key = lambda df: sorted(tuple(r) for r in df.select("start", "event_type", "n").where(F.col("event_type") != "z").collect())
    assert key(out) == key(E.sliding(batch, ["event_type"]))
