"""What folds read and shuffle: forms without a join, pieces without a second copy of their values, payloads once for gauges and sums."""

import datetime

from pyspark.sql import functions as F

from termlake.operators import gaps, telemetry


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def misses(spark, rows):
    at = datetime.datetime(2026, 1, 1)
    made = [(surface, None, source, "t", locator, None, at, gaps.ADD_LABEL, None, None, "r") for surface, source, locator in rows]
    return spark.createDataFrame(made, gaps.MISS)


def test_forms_meet_no_keys(spark):
    counted = gaps.forms(misses(spark, [("Pumps", "document", "d1"), ("Pumps", "document", "d2"), ("pump", "chat", "c1")]))
    assert "Join" not in plan(counted)
    assert sorted((r["gap_key"], r["surface"], r["n"]) for r in counted.collect()) == [("pump", "Pumps", 2), ("pump", "pump", 1)]


def test_pieces_do_not_depend_on_the_order_of_rows(spark):
    rows = [("pump", "a", "place"), ("pump", "b", "place")]
    found = [gaps.pieces(gaps.keyed(misses(spark, x)).coalesce(1)).collect() for x in (rows, rows[::-1])]
    assert found[0] == found[1] and [r["source"] for r in found[0]] == ["b"] and found[0][0].asDict().keys() == {"gap_key", "evidence_id", *gaps.PLACE}


def test_points_read_payloads_once(spark):
    text = """{"resourceMetrics": [{"scopeMetrics": [{"metrics": [{"name": "g", "gauge": {"dataPoints": [{"asDouble": 1.5}]}}, {"name": "none"},
      {"name": "s", "sum": {"isMonotonic": true, "dataPoints": [{"asInt": "2"}, {"asInt": "3"}]}}]}]}]}"""
    points = telemetry.points(spark.createDataFrame([(text,)], "x string").select(telemetry.parse_payloads(F.col("x")).alias("p")).select("p.*"))
    assert "Union" not in plan(points)
    assert sorted((r["metric"], r["kind"], r["monotonic"], r["value"]) for r in points.collect()) == [("g", "gauge", False, 1.5), ("s", "sum", True, 2.0), ("s", "sum", True, 3.0)]


def test_sources_are_counted_before_forms_are_normalised(spark):
    rows = misses(spark, [("Pumps", "document", "d1"), ("Pumps", "document", "d2"), ("pump", "document", "d2"), ("pump", "chat", "c1")])
    assert sorted(map(tuple, gaps.source_counts(rows).collect())) == [("pump", "chat", 1), ("pump", "document", 3)]
