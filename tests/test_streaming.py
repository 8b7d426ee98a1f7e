"""Streaming forms against their batch forms."""

import json
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from tallyspark.streaming import ordered
from tallyspark.streaming import runs as S


def test_latest_wins_across_batches(spark, tmp_path):
    source, table, mark = (str(tmp_path / n) for n in ("in", "table", "mark"))
    schema = "run_id string, v int"
    for k, rows in enumerate(([("a", 1), ("b", 1)], [("b", 2), ("c", 2)])):
        (tmp_path / "in").mkdir(exist_ok=True)
        (tmp_path / "in" / f"{k}.json").write_text(
            "\n".join(json.dumps(dict(zip(("run_id", "v"), r, strict=True))) for r in rows)
        )
        S.keep_latest(S.record_stream(spark, source, schema), table, mark).awaitTermination(60)
    assert {r.run_id: r.v for r in S.current(spark, table).collect()} == {"a": 1, "b": 2, "c": 2}


def test_latch(spark):
    t = datetime(2024, 1, 1)
    rows = [
        ("b", t + timedelta(minutes=i), r) for i, r in enumerate(
            [None, "server_overloaded", "usage_limit_exceeded", None, "rate_limit_exceeded"]
        )
    ]
    e = spark.createDataFrame(rows, "batch string, at timestamp, reason string")
    got = [(r.reason, r.admitted) for r in S.latch_batch(e).orderBy("at").collect()]
    assert got == [
        (None, True),
        ("server_overloaded", True),
        ("usage_limit_exceeded", True),
        ("usage_limit_exceeded", False),
        ("usage_limit_exceeded", False),
    ]


def streamed(spark, folder, schema, batches, make):
    """Rows that a stream tells of batches of JSON lines, each taken by a run of its own."""
    source, out, mark = (str(folder / n) for n in ("in", "out", "mark"))
    (folder / "in").mkdir()
    for k, rows in enumerate(batches):
        (folder / "in" / f"{k}.json").write_text("\n".join(map(json.dumps, rows)))
        told = make(spark.readStream.schema(schema).json(source))
        query = told.writeStream.format("parquet").option("path", out).option("checkpointLocation", mark)
        query.trigger(availableNow=True).start().awaitTermination(120)
    return [tuple(r) for r in spark.read.schema(told.schema).parquet(out).collect()]


def test_a_late_stop_refuses_rows_that_came_before_it(spark, tmp_path):
    row = lambda i, at, reason=None, b="b": {"batch": b, "id": i, "at": f"2024-01-01 {at}", "reason": reason}
    batches = [
        [row(1, "10:00:00"), row(3, "10:20:00"), row(4, "10:25:00", "rate_limit_exceeded"), row(9, "10:00:00", b=None)],
        [row(2, "10:10:00", "usage_limit_exceeded"), row(5, "10:10:00")],
        [row(6, "15:00:00"), row(7, "09:00:00"), row(0, "23:00:00", b="end")],
    ]
    make = lambda s: ordered.latched(s, delay="30 minutes")
    got = streamed(spark, tmp_path, "batch string, id int, at timestamp, reason string", batches, make)
    stop = "usage_limit_exceeded"
    assert {r for r in got if r[0] == "b"} == {
        ("b", 1, None, True),
        ("b", 2, stop, True),
        ("b", 5, None, True),  # at the time of the stop
        ("b", 3, stop, False),
        ("b", 4, stop, False),
        ("b", 6, stop, False),
    }  # row 7 is later than the delay allows: dropped
    assert (None, 9, None, True) in got and len(got) == 7


def test_stale_readings_and_budgets(spark, tmp_path):
    read = lambda a, at, v: {"account": a, "observed_at": f"2024-01-01 {at}", "reading": v}
    batches = [
        [read("x", "10:00:00", 1), read("x", "11:00:00", 3), read("y", "10:00:00", 5)],
        [read("x", "10:35:00", 2), read("y", "10:29:59", 6)],
        [read("end", "20:00:00", 0)],
    ]
    (tmp_path / "a").mkdir()
    got = streamed(
        spark,
        tmp_path / "a",
        "account string, observed_at timestamp, reading double",
        batches,
        lambda s: ordered.stale_readings(s, delay="2 hours"),
    )
    told = {(a, f"{at:%H:%M:%S}", v, f"{stale:%H:%M:%S}") for a, at, v, stale in got}
    assert told == {("x", "10:00:00", 1.0, "10:30:00"), ("x", "11:00:00", 3.0, "11:30:00"), ("y", "10:29:59", 6.0, "10:59:59")}
    row = lambda i, at, status: {"item": "i", "id": i, "at": f"2024-01-01 {at}", "status": status}
    batches = [[row(1, "10:00:00", "error"), row(3, "10:20:00", "error")], [row(2, "10:10:00", "ok"), row(4, "20:00:00", None)]]
    (tmp_path / "b").mkdir()
    got = streamed(
        spark,
        tmp_path / "b",
        "item string, id int, at timestamp, status string",
        batches,
        lambda s: ordered.budgeted(s, "item", 3, delay="1 hour"),
    )
    assert set(got) == {("i", 1, 1, True), ("i", 2, 2, True), ("i", 3, None, False)}


def test_budget_and_fresh(spark):
    rows = spark.createDataFrame(
        [("a", "error"), ("a", "error"), ("b", "ok"), ("c", "error")], "item string, status string"
    )
    assert {r.item: r.may_retry for r in S.budget(rows, "item", 2).collect()} == {"a": False, "b": False, "c": True}
    t = datetime(2024, 1, 1, 1)
    reads = spark.createDataFrame([(t,), (t - timedelta(minutes=31),)], "observed_at timestamp")
    assert S.fresh(reads, t).count() == 1


def test_unfinished(spark):
    a = spark.createDataFrame([("x",), ("y",)], "run_id string")
    assert [r.run_id for r in S.unfinished(a, a.where(F.col("run_id") == "x")).collect()] == ["y"]
