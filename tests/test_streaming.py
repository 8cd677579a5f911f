"""Streams to the end over small files."""

from __future__ import annotations

import datetime as dt

from hushgrid.streaming import flows

T0 = dt.datetime(2024, 1, 1)


def drain(spark, df, name, mode="append"):
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).start()
    q.processAllAvailable()
    q.processAllAvailable()
    q.stop()
    return spark.sql(f"SELECT * FROM {name}").collect()


def source(spark, path, batches, schema):
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(path))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(path))


def test_retention(spark, tmp_path):
    schema = "job_id string, created_at timestamp, ttl_s bigint"
    rows = [[("a", T0, 60)], [("b", T0 + dt.timedelta(hours=2), 60)], [("a", T0 + dt.timedelta(hours=3), 60)]]
    got = drain(spark, flows.retention(source(spark, tmp_path / "r", rows, schema)), "retention_out")
    assert [r.job_id for r in got].count("a") == 1 and all(r.receipt for r in got)


def test_ledger_stream(spark, tmp_path):
    schema = "job_id string, ts timestamp, event_type string, details string"
    rows = [[("a", T0, "X", "1"), ("a", T0 + dt.timedelta(seconds=1), "Y", "2")], [("a", T0 + dt.timedelta(seconds=2), "Z", "3")]]
    got = sorted(drain(spark, flows.ledger(source(spark, tmp_path / "l", rows, schema)), "ledger_out"), key=lambda r: r.sequence)
    assert [r.sequence for r in got] == [1, 2, 3] and [r.prev_hash for r in got[1:]] == [r.event_hash for r in got[:-1]]


def test_windows_stream(spark, tmp_path):
    schema = "event_id bigint, ts timestamp, user_id bigint, event_type string, value double"
    rows = [[(k, T0 + dt.timedelta(minutes=k), 1, "v", 1.0) for k in range(20)], [(99, T0 + dt.timedelta(hours=5), 1, "v", 1.0)], [(100, T0, 1, "v", 1.0)]]
    got = drain(spark, flows.tumbling(source(spark, tmp_path / "w", rows, schema)), "tumbling_out")
    assert sum(r.n for r in got) == 20  # the late row does not count


def test_life(spark):
    df = spark.createDataFrame([("a", 1, "CREATED"), ("a", 2, "UPLOADED"), ("a", 3, "VERIFIED_SAFE")], "job_id string, ts int, state string")
    assert [r.state for r in flows.bad_transitions(df).collect()] == ["VERIFIED_SAFE"]
