"""Run records as a stream, latest wins; stops, freshness, budgets and interrupted runs over finished data (as streams: `ordered`)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.operators.extraction import stops
from tallyspark.operators.runs import latest_records
from tallyspark.plans.scratch import children, delete

FRESH = "30 minutes"


def record_stream(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A growing ledger of JSON lines; the checkpoint of the query remembers which files were taken."""
    return spark.readStream.schema(schema).json(path)


#: Hash buckets of a table that `keep_latest` fills.
BUCKETS = 64


def keep_latest(stream: DataFrame, table: str, checkpoint: str, key: str = "run_id", buckets: int = BUCKETS):
    """Each batch replaces the rows of its keys in a table; returns the query.

    The table is cut into hash buckets. A batch rewrites only the buckets that its keys fall into, as files of its own,
    and then writes a manifest of where each bucket is: a failed batch leaves the old state in place, and one that comes
    again finds its manifest. Files that neither this manifest nor the one before names are deleted.
    """

    def merge(batch: DataFrame, n: int) -> None:
        spark = batch.sparkSession
        done = manifests(spark, table)
        if n in done:  # the batch was merged, but its end was not noted
            return
        known = manifest(spark, table, done[-1]) if done else {}
        rows = batch.withColumn("_bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")).persist()
        touched = sorted(r[0] for r in rows.select("_bucket").distinct().collect())  # `buckets` numbers at most
        old = [f"{table}/data/{known[b]}/_bucket={b}" for b in touched if b in known]
        if old:
            before = spark.read.schema(batch.schema).parquet(*old).withColumn(
                "_bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")
            )
            merged = latest_records(before, rows, key=key)
        else:
            merged = latest_records(rows, key=key)
        merged.repartition(
            max(1, len(touched)), "_bucket"
        ).write.mode("overwrite").partitionBy("_bucket").parquet(f"{table}/data/{n}")
        rows.unpersist()
        now = known | dict.fromkeys(touched, n)
        spark.createDataFrame(
            sorted(now.items()), "bucket int, version long"
        ).coalesce(1).write.mode("overwrite").parquet(f"{table}/manifest/{n}")
        used = {str(v) for v in (*now.values(), *known.values())}
        for name in children(spark, f"{table}/data"):
            if name not in used and name.isdigit():
                delete(spark, f"{table}/data/{name}")
        for old_n in done[:-1]:
            delete(spark, f"{table}/manifest/{old_n}")

    return stream.writeStream.foreachBatch(merge).option(
        "checkpointLocation", checkpoint
    ).trigger(availableNow=True).start()


def manifests(spark: SparkSession, table: str) -> list[int]:
    """Numbers of the batches whose manifest is complete."""
    found = (int(n) for n in children(spark, f"{table}/manifest") if n.isdigit())
    return sorted(n for n in found if "_SUCCESS" in children(spark, f"{table}/manifest/{n}"))


def manifest(spark: SparkSession, table: str, n: int) -> dict[int, int]:
    """Where each bucket is: bucket -> batch that wrote it."""
    return {
        r.bucket: r.version for r in spark.read.schema(
            "bucket int, version long"
        ).parquet(f"{table}/manifest/{n}").collect()
    }


def current(spark: SparkSession, table: str) -> DataFrame | None:
    """The present state of a table that `keep_latest` fills; None before the first batch."""
    done = manifests(spark, table)
    places = manifest(spark, table, done[-1]) if done else {}
    return spark.read.parquet(*[f"{table}/data/{v}/_bucket={b}" for b, v in sorted(places.items())]) if places else None


def latch_batch(events: DataFrame, key: str = "batch") -> DataFrame:
    """`ordered.latched` over finished data: rows after the first stopping reason are refused."""
    first = events.where(stops(F.col("reason"))).groupBy(key).agg(
        F.min("at").alias("_at"), F.min_by("reason", "at").alias("_why")
    )
    late = F.coalesce(F.col("at") > F.col("_at"), F.lit(False))
    return events.join(first, key, "left").select(
        key, "at", F.when(late, F.col("_why")).otherwise(F.col("reason")).alias("reason"), (~late).alias("admitted")
    )


def fresh(readings: DataFrame, now, bound: str = FRESH, at: str = "observed_at") -> DataFrame:
    """Readings not older than the bound. `now` is a column or a time."""
    return readings.where(F.col(at) >= F.lit(now) - F.expr(f"INTERVAL {bound}"))


def budget(attempts: DataFrame, key: str, most: int) -> DataFrame:
    """Attempts numbered per item; those past the budget are refused ."""
    per = attempts.groupBy(key).agg(
        F.count(F.lit(1)).alias("attempts"), F.bool_or(F.col("status") == "ok").alias("done")
    )
    return per.withColumn("may_retry", ~F.coalesce("done", F.lit(False)) & (F.col("attempts") < most))


def unfinished(stream: DataFrame, records: DataFrame, key: str = "run_id") -> DataFrame:
    """Dispatched runs of a stream that the table of records lacks (stream-static anti-join as a left join)."""
    have = records.select(F.col(key).alias("_k")).distinct()
    return stream.join(have, stream[key] == F.col("_k"), "left").where("_k IS NULL").drop("_k")


def sessions(events: DataFrame, key: str, at: str, gap: str) -> DataFrame:
    """Session windows of a key (an addition: there is no such operator elsewhere)."""
    return events.groupBy(key, F.session_window(at, gap)).agg(F.count(F.lit(1)).alias("events"))
