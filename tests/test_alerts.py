"""Alerts over restarts, silence by timer and by gap."""

import datetime as dt

from seriesloom.streaming.alerts import stream_alerts

START = dt.datetime(2024, 1, 1)
SCHEMA = "ts timestamp_ntz, kind string, value double"


def rows_at(kind, hours):
    return [(START + dt.timedelta(hours=h, minutes=m), kind, v) for h, v in hours for m in (5, 40)]


def test_alerts_over_restarts(spark, tmp_path):
    def feed(rows):
        if rows:
            spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(SCHEMA).parquet(f"{tmp_path}/in")
        stream_alerts(stream, "ts", "kind", "value", 50.0, f"{tmp_path}/out", f"{tmp_path}/state", silence_hours=6).awaitTermination()
        found = spark.read.schema("kind string, hour timestamp, alert string, value double").parquet(f"{tmp_path}/out/alerts").collect()
        return sorted((r.kind, int((r.hour.replace(tzinfo=None) - START).total_seconds() // 3600), r.alert) for r in found)

    steady = lambda a, b: rows_at("b", [(h, 10.0) for h in range(a, b)])
    first = feed(rows_at("a", [(0, 10.0), (1, 60.0), (2, 70.0)]) + steady(0, 5) + rows_at(None, [(1, 99.0)]) + rows_at("c", [(2, None)]))
    assert first == [("a", 1, "raised")]
    # the restart knows that a is above already
    second = feed(rows_at("a", [(5, 80.0), (6, 20.0)]) + steady(5, 10))
    assert second == [("a", 1, "raised"), ("a", 6, "cleared")]
    assert feed([]) == second
    # a falls silent; the timer fires as time goes on with the rows of b
    third = feed(steady(10, 30))
    fourth = feed(steady(30, 60))
    assert [r for r in fourth if r[2] == "silent" and r[0] == "a"] == [("a", 6, "silent")]
    assert set(second) <= set(third) <= set(fourth) and not any(r[0] in ("b", "c") for r in fourth)
    # it comes back above the threshold, and then over a gap: it starts anew
    fifth = feed(rows_at("a", [(61, 90.0), (70, 90.0)]) + steady(60, 75))
    assert [r for r in fifth if r not in fourth] == [("a", 61, "raised"), ("a", 61, "silent"), ("a", 70, "raised")]
