"""Structured Streaming jobs: pull-request gate, subscription changes, sliding quota, usage counters.

Every job is a transformation from a streaming DataFrame plus ``run_to_table``, which drains what
is available into a Parquet table with its own checkpoint. State is bounded by the watermark.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.content import has_diff_tokens
from ..operators.reporting import latest_per_key, profile_update, usage_class
from ..session import is_landed, remove


#: Where a gated event goes; each route has its own table.
GATE_ROUTES = ("blocked", "review")


def stream_table(spark: SparkSession, folder: str, name: str, schema) -> DataFrame:
    """The files of a table as a stream, whether the table is one file or a folder of parts."""
    # a pattern, also in place of the one file, as a stream takes a plain path for a folder
    return spark.readStream.schema(schema).parquet(f"{folder}/{name}*")


def run_to_table(stream: DataFrame, path: str) -> DataFrame:
    """Process everything available, append it to the table at ``path`` and return that table."""
    query = (
        stream.writeStream.format("parquet").outputMode("append")
        .option("path", f"{path}/data").option("checkpointLocation", f"{path}/state")
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{path}/data")


def pr_event_gate(events: DataFrame) -> DataFrame:
    """Opened or updated pull requests with their route: ``blocked`` when the diff holds a token, else ``review``."""
    wanted = (F.col("event") == "pull_request") & F.col("action").isin("opened", "synchronize")
    return events.filter(wanted).withColumn(
        "route", F.when(has_diff_tokens(F.col("diff")), "blocked").otherwise("review"))


def write_route(batch: DataFrame, number: int, path: str) -> None:
    """Write a batch of gated events to the table of each route, under the batch's number, in place of what is there."""
    batch.persist()
    for route in GATE_ROUTES:
        rows = batch.filter(F.col("route") == route).drop("route")
        rows.write.mode("overwrite").parquet(f"{path}/{route}/batch={number}")
    batch.unpersist()


def run_gate(gated: DataFrame, path: str) -> dict[str, DataFrame]:
    """Process the gated events available and return the table of each route, ``blocked`` and ``review``.

    A batch that is repeated after a failure, also one between the two tables, replaces its own rows in both. Before
    the first event the tables are empty.
    """
    spark = gated.sparkSession
    query = (
        gated.writeStream.outputMode("append").foreachBatch(lambda batch, number: write_route(batch, number, path))
        .option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    )
    query.awaitTermination()
    schema = T.StructType([f for f in gated.schema.fields if f.name != "route"])
    kept = T.StructType([*schema.fields, T.StructField("batch", T.LongType())])
    tables = {}
    for route in GATE_ROUTES:
        # a part without rows, so that the table is there before any batch
        spark.createDataFrame([], schema).write.mode("overwrite").parquet(f"{path}/{route}/batch=-1")
        tables[route] = spark.read.schema(kept).parquet(f"{path}/{route}").drop("batch")
    return tables


def subscription_updates(events: DataFrame, watermark: str = "1 hour") -> DataFrame:
    """Profile changes, each event id once; ``reporting.profile_state`` over the table is the current state."""
    return profile_update(events.withWatermark("ts", watermark).dropDuplicatesWithinWatermark(["event_id"])).select(
        "event_id", "user_id", "plan_tier", "subscription_status", "ts")


def keep_updates(stream: DataFrame, path: str, keys: list[str]) -> DataFrame:
    """Process everything available in update mode and return the table of the latest value per key.

    Every batch writes the keys that it changed under its number, and a batch that is repeated after a failure replaces
    its own rows; so groups are in the table from their first row on, also those that no watermark has closed yet.
    """
    spark = stream.sparkSession

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/data/batch={number}")

    query = (
        stream.writeStream.outputMode("update").foreachBatch(write)
        .option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    )
    query.awaitTermination()
    table = spark.read.schema(T.StructType([*stream.schema.fields, T.StructField("batch", T.LongType())])).parquet(f"{path}/data")
    return latest_per_key(table, keys, ["batch"]).select(*stream.columns)


def hourly_counts(events: DataFrame, watermark: str = "10 minutes") -> DataFrame:
    """(user_id, hour, n): events per key and hour, the partial sums of sliding windows."""
    return (
        events.withWatermark("ts", watermark).groupBy("user_id", F.window("ts", "1 hour").alias("w"))
        .agg(F.count(F.lit(1)).alias("n")).select("user_id", F.col("w.start").alias("hour"), "n")
    )


def sliding_quota(hours: DataFrame, n: int, span_hours: int = 24) -> DataFrame:
    """Counts per key and window of ``span_hours``, sliding by an hour, with whether they exceed ``n``.

    An hour's count, not its events, goes into the windows that hold it.
    """
    starts = F.sequence(F.col("hour") - F.make_dt_interval(hours=F.lit(span_hours - 1)), F.col("hour"), F.expr("INTERVAL 1 HOUR"))
    return (
        hours.select("user_id", F.explode(starts).alias("window_start"), "n")
        .groupBy("user_id", "window_start").agg(F.sum("n").alias("n_in_window"))
        .select("user_id", "window_start", (F.col("window_start") + F.make_dt_interval(hours=F.lit(span_hours))).alias("window_end"),
                "n_in_window", (F.col("n_in_window") > n).alias("exceeded"))
    )


def usage_counters(events: DataFrame, watermark: str = "10 minutes") -> DataFrame:
    """Daily usage per user and kind."""
    return (
        events.withWatermark("ts", watermark)
        .groupBy("user_id", usage_class(F.col("kind")).alias("kind"), F.window("ts", "1 day").alias("w"))
        .agg(F.count(F.lit(1)).alias("n"))
        .select("user_id", F.to_date("w.start").alias("day"), "kind", "n")
    )


def keep_profile_state(updates: DataFrame, path: str) -> DataFrame:
    """Process the updates available and return the current (user_id, plan_tier, subscription_status, ts, event_id).

    Each batch is upserted by user into the next version of the state table; the last two versions stay, so a batch
    that is repeated after a failure starts again from the version before it.
    """
    spark = updates.sparkSession

    def version(number: int) -> str:
        return f"{path}/version={number}"

    def upsert(batch: DataFrame, number: int) -> None:
        rows = batch.select(*updates.columns)
        if number > 0 and is_landed(spark, version(number - 1)):
            rows = rows.unionByName(spark.read.schema(updates.schema).parquet(version(number - 1)))
        latest_per_key(rows, ["user_id"], ["ts", "event_id"]).select(*updates.columns).write.mode("overwrite").parquet(version(number))
        if number > 1:
            remove(spark, version(number - 2))

    query = (
        updates.writeStream.outputMode("append").foreachBatch(upsert)
        .option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    )
    query.awaitTermination()
    state = spark.read.schema(T.StructType([*updates.schema.fields, T.StructField("version", T.LongType())])).option("basePath", path).parquet(f"{path}/version=*")
    newest = state.agg(F.max("version")).first()[0]
    return state.filter(F.col("version") == newest).select(*updates.columns)
