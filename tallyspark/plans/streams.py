"""Queries of streams that count in event-time order over the events, in two batches with late rows in the second.

The first batch holds the events before the middle of the time but for some of its last day, which come late; the second
the rest, and a row far in the future that lets the watermark pass all others.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.streaming import ordered

from .registry import query, table
from .scratch import new_folder

LATE = "2 days"
#: The key of the row that ends a stream.
END = -1


def _in_two(rows: DataFrame, at: str, ident: str, ends: dict[str, str]) -> list[DataFrame]:
    """The two batches; `ends` gives the columns of the last row as SQL."""
    low, high = rows.agg(F.min(at), F.max(at)).first()
    cut = F.lit(low + (high - low) / 2)
    late = (F.col(at) >= cut - F.expr("INTERVAL 1 DAY")) & (F.col(ident) % 7 == 0)
    first = (F.col(at) < cut) & ~late
    last = rows.sparkSession.range(1).select(
        *[F.expr(ends.get(f.name, "NULL")).cast(f.dataType).alias(f.name) for f in rows.schema if f.name != at],
        (F.lit(high) + F.expr("INTERVAL 60 DAYS")).cast(rows.schema[at].dataType).alias(at),
    )
    return [rows.where(first), rows.where(~first).unionByName(last)]


def _streamed(spark: SparkSession, batches: list[list[DataFrame]], make) -> DataFrame:
    """What the stream `make(*sources)` tells of all batches; each is written and then taken by a run of its own, which
    goes on from the checkpoint of the one before."""
    folders = [new_folder(spark, "stream-in") for _ in batches[0]]
    out, mark = new_folder(spark, "stream-out"), new_folder(spark, "stream-mark")
    for batch in batches:
        for df, folder in zip(batch, folders, strict=True):
            df.write.mode("append").parquet(folder)
        sources = [
            spark.readStream.schema(df.schema).parquet(f) for df, f in zip(batch, folders, strict=True)
        ]
        told = make(*sources)
        told.writeStream.format("parquet").option("path", out).option("checkpointLocation", mark).trigger(
            availableNow=True
        ).start().awaitTermination()
    return spark.read.schema(told.schema).parquet(out)


def _plain_time(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in columns})


@query("""
WITH r AS (
  SELECT user_id AS batch, event_id AS id, ts,
    CASE WHEN event_type = 'error' AND event_id % 3 = 0 THEN 'usage_limit_exceeded'
      WHEN event_type = 'error' THEN 'server_overloaded' END AS reason
  FROM events),
f AS (SELECT batch, min(ts) AS stop FROM r WHERE reason = 'usage_limit_exceeded' GROUP BY batch)
SELECT batch, id, CASE WHEN ts > stop THEN 'usage_limit_exceeded' ELSE reason END AS reason,
  stop IS NULL OR ts <= stop AS admitted
FROM r LEFT JOIN f USING (batch)
""")
def latched_stream(spark, sf_dir):
    """Admissions of each user as a stream: the first stopping reason stays, also if it comes late."""
    error = F.col("event_type") == "error"
    e = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("batch"),
        F.col("event_id").alias("id"),
        F.col("ts").cast("timestamp").alias("at"),
        F.when(error & (F.col("event_id") % 3 == 0), "usage_limit_exceeded").when(error, "server_overloaded").alias("reason"),
    )
    parts = _in_two(e, "at", "id", {"batch": str(END), "id": str(END)})
    told = _streamed(spark, [[p] for p in parts], lambda s: ordered.latched(s, delay=LATE))
    return told.where(F.col("batch") != END)


@query("""
WITH r AS (
  SELECT user_id AS account, ts AS observed_at, value AS reading,
    lead(ts) OVER (PARTITION BY user_id ORDER BY ts) AS newer
  FROM events)
SELECT account, observed_at, reading, observed_at + INTERVAL 600 MINUTES AS stale_at
FROM r WHERE newer IS NULL OR newer > observed_at + INTERVAL 600 MINUTES
""")
def stale_stream(spark, sf_dir):
    """Readings of each account as a stream: those that nothing newer follows for ten hours, told by event-time timers."""
    e = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("account"), "event_id", F.col("ts").cast("timestamp").alias("observed_at"), F.col("value").alias("reading")
    )
    parts = _in_two(e, "observed_at", "event_id", {"account": str(END)})
    told = _streamed(
        spark, [[p] for p in parts], lambda s: ordered.stale_readings(s, bound_minutes=600, delay=LATE)
    )
    return _plain_time(told.where(F.col("account") != END), "observed_at", "stale_at")


@query("""
WITH r AS (
  SELECT user_id AS item, event_id AS id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n,
    event_type = 'signup' AND value > 485 AS ok
  FROM events),
d AS (SELECT item, min(n) FILTER (WHERE ok) AS done FROM r GROUP BY item)
SELECT item, id, n <= 20 AND n <= coalesce(done, n) AS admitted, CASE WHEN n <= 20 AND n <= coalesce(done, n) THEN n ELSE 0 END AS attempt
FROM r JOIN d USING (item)
""")
def budget_stream(spark, sf_dir):
    """Attempts of each item as a stream: twenty at most, none after a success."""
    ok = (F.col("event_type") == "signup") & (F.col("value") > 485)
    e = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("item"),
        F.col("event_id").alias("id"),
        F.col("ts").cast("timestamp").alias("at"),
        F.when(ok, "ok").otherwise("error").alias("status"),
    )
    parts = _in_two(e, "at", "id", {"item": str(END), "id": str(END)})
    told = _streamed(spark, [[p] for p in parts], lambda s: ordered.budgeted(s, "item", 20, delay=LATE))
    return told.where(F.col("item") != END).withColumn("attempt", F.coalesce("attempt", F.lit(0)))


@query("""
SELECT event_id AS run_id, ts AS dispatched_at,
  CASE WHEN event_id % 3 <> 0 AND event_id % 100 <= 60 THEN ts + to_minutes(CAST(event_id % 100 AS INTEGER)) END AS recorded_at
FROM events WHERE event_type IN ('signup', 'purchase')
""")
def reconciled_stream(spark, sf_dir):
    """Dispatched runs and their records as two streams: a record of a later batch settles a run, none within the hour
    leaves it open."""
    e = table(spark, sf_dir, "events").where("event_type IN ('signup', 'purchase')").select(
        F.col("event_id").alias("run_id"), F.col("ts").cast("timestamp").alias("dispatched_at")
    )
    later = F.col("dispatched_at") + F.make_dt_interval(F.lit(0), F.lit(0), (F.col("run_id") % 100).cast("int"))
    records = e.where("run_id % 3 <> 0").select("run_id", later.alias("recorded_at"))
    runs = _in_two(e, "dispatched_at", "run_id", {"run_id": str(END)})
    settled = _in_two(records.withColumn("turn", F.col("run_id") + 3), "recorded_at", "turn", {"run_id": str(END - 1)})
    settled = [x.drop("turn") for x in settled]
    told = _streamed(
        spark,
        list(map(list, zip(runs, settled, strict=True))),
        lambda a, b: ordered.reconciled(a, b, within="60 minutes", delay=LATE),
    )
    told = told.where(F.col("run_id") >= 0).select("run_id", "dispatched_at", "recorded_at")
    return _plain_time(told, "dispatched_at", "recorded_at")
