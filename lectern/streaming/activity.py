"""Streaming forms of the activity reports."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def read_events(spark: SparkSession, folder: str, schema: StructType, files_per_batch: int = 1) -> DataFrame:
    """Events that arrive as Parquet files; the time is cast, since watermarks need a time zone."""
    raw = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)
    return raw.withColumn("ts", F.col("ts").cast("timestamp"))


def tumbling(events: DataFrame, every: str = "1 day", late: str = "2 hours") -> DataFrame:
    return events.withWatermark("ts", late).groupBy(F.window("ts", every), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def sliding(events: DataFrame, size: str = "1 day", step: str = "6 hours", late: str = "2 hours") -> DataFrame:
    return events.withWatermark("ts", late).groupBy(F.window("ts", size, step), "event_type").agg(F.count("*").alias("n"))


def sessions(events: DataFrame, gap: str = "6 hours", late: str = "2 hours") -> DataFrame:
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n"))


def without_repeats(events: DataFrame, late: str = "2 hours") -> DataFrame:
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])


def merge_usage(old: DataFrame, new: DataFrame) -> DataFrame:
    """Out-of-order tolerant upsert by session: earliest start, latest update, a completed session stays completed."""
    n = new.groupBy("session_id").agg(F.min("started").alias("started"), F.max("updated").alias("updated"), F.max("n_events").alias("n_events"), F.max((F.col("status") == "completed").cast("int")).alias("done"))
    o = old.select("session_id", F.col("started").alias("o_started"), F.col("updated").alias("o_updated"), F.col("n_events").alias("o_n"), (F.col("status") == "completed").cast("int").alias("o_done"))
    return o.join(n, "session_id", "full_outer").select(
        "session_id", F.least("started", "o_started").alias("started"), F.greatest("updated", "o_updated").alias("updated"), F.greatest("n_events", "o_n").alias("n_events"),
        F.when(F.greatest("done", "o_done") == 1, "completed").otherwise("started").alias("status"),
    )


def upsert_to(spark: SparkSession, folder: str) -> Callable[[DataFrame, int], None]:
    """A foreachBatch sink: each batch writes a new version, so a repeated batch changes nothing."""

    def sink(batch: DataFrame, number: int) -> None:
        before = spark.read.parquet(f"{folder}/v{number - 1}") if number else batch.limit(0)
        merge_usage(before, batch).write.mode("overwrite").parquet(f"{folder}/v{number}")

    return sink
