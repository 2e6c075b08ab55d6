"""Streams of telemetry, books and conversations."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery


def read_events(spark: SparkSession, folder: str, schema: str, per_trigger: int = 64) -> DataFrame:
    """Parquet files as a stream. Timestamps without a zone become event times in the session's zone."""
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(folder)
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def tumbling_spend(events: DataFrame, delay: str = "48 hours", width: str = "1 day") -> DataFrame:
    """Spend a window and stage; state goes once the watermark has passed."""
    return events.withWatermark("ts", delay).groupBy(F.window("ts", width), "stage").agg(F.sum("cost").alias("spend"), F.count("*").alias("n")).select(F.col("window.start").alias("start"), "stage", "spend", "n")


def sessions(events: DataFrame, user: str = "user_id", gap: str = "30 minutes", delay: str = "1 hour") -> DataFrame:
    """Conversation sessions: turns of a user with no longer gap between them."""
    grouped = events.withWatermark("ts", delay) if events.isStreaming else events
    return grouped.groupBy(user, F.session_window("ts", gap)).agg(F.count("*").alias("turns"), F.max("value").alias("peak")).select(user, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "turns", "peak")


def run_available(stream: DataFrame, folder: str, checkpoint: str) -> DataFrame:
    """Drive what is there into a Parquet table that executors write, each row once even if a run is repeated, and read that table."""
    query = stream.writeStream.format("parquet").outputMode("append").option("path", folder).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(folder)


def on_late_books(stream: DataFrame, recompute: Callable[[DataFrame], None], checkpoint: str) -> StreamingQuery:
    """Each micro-batch of new books leads to a recomputation of derived tables from all books; nothing is accumulated, so the order of arrival doesn't matter."""
    query = stream.writeStream.foreachBatch(lambda batch, _: recompute(batch)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def carried_scope(turns: DataFrame, thread: str, at: str, scope: str) -> DataFrame:
    """A turn without a scope of its own has that of the turns before it."""
    from fablespark.operators.chapters import carry_forward

    return carry_forward(turns, [thread], at, scope, "carried_scope")


def expired(threads: DataFrame, now: str, hours: int = 24) -> DataFrame:
    """Paused threads past their time to live."""
    return threads.filter(F.col("updated_at") < F.lit(now).cast("timestamp") - F.expr(f"INTERVAL {hours} HOURS"))


def pending_threads(tasks: DataFrame, resolutions: DataFrame) -> DataFrame:
    """Threads that still wait: tasks without a resolution. State is a table, so a restart resumes from it."""
    return tasks.join(resolutions.select("task_id").distinct(), "task_id", "left_anti")
