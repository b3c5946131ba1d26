"""Streams over a folder of events."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from lodeworks.streaming import events


def write(spark, path, rows):
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").coalesce(1).write.mode("append").parquet(path)


def row(i, minutes, user=1, kind="view"):
    return (i, datetime(2024, 1, 1) + timedelta(minutes=minutes), user, kind, 1.0, "{}")


def test_counts_and_late_events(spark, tmp_path):
    path = str(tmp_path / "in")
    write(spark, path, [row(1, 0), row(2, 30), row(3, 5 * 24 * 60)])
    events.drain(events.windowed_counts(events.read_events(spark, path)), "c1", "complete")
    assert sorted(r.n for r in spark.table("c1").collect()) == [1, 2]


def test_sessions(spark, tmp_path):
    path = str(tmp_path / "in")
    write(spark, path, [row(1, 0), row(2, 10), row(3, 100), row(4, 0, user=2)])
    events.drain(events.sessions(events.read_events(spark, path)), "s1", "complete")
    assert sorted((r.user_id, r.n) for r in spark.table("s1").collect()) == [(1, 1), (1, 2), (2, 1)]


def test_stream_stream_interval_join(spark, tmp_path):
    path = str(tmp_path / "in")
    write(spark, path, [row(1, 0), row(2, 60, kind="purchase"), row(3, 1000, kind="purchase")])
    e = events.read_events(spark, path)
    events.drain(events.runs_before_release(e.where(F.col("event_type") == "view"), e.where(F.col("event_type") == "purchase")), "j1")
    assert [tuple(r) for r in spark.table("j1").collect()] == [(1, 1, 2)]


def test_foreach_batch_keeps_an_output_up_to_date(spark, tmp_path):
    path, out = str(tmp_path / "in"), str(tmp_path / "out")
    write(spark, path, [row(1, 0)])
    events.drain(events.read_events(spark, path), "x", each=lambda d, i: d.write.mode("append").parquet(out), checkpoint=str(tmp_path / "cp"))
    write(spark, path, [row(2, 1)])
    events.drain(events.read_events(spark, path), "x", each=lambda d, i: d.write.mode("append").parquet(out), checkpoint=str(tmp_path / "cp"))
    assert spark.read.parquet(out).count() == 2
