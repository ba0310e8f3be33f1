"""Review decisions and usage, derived from an append-only log of events."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Which decision each type of event stands for.
DECISIONS = {"click": "keep", "view": "ignore", "purchase": "redact", "signup": "change", "logout": "reset"}
IDLE_SECONDS = 21_600


def events(raw: DataFrame) -> DataFrame:
    """Events with a time-zoned timestamp, so that watermarks can use it."""
    return raw.withColumn("ts", F.col("ts").cast("timestamp"))


def latest(rows: DataFrame) -> DataFrame:
    """The latest event of every user and type; of equal times the one with the least id."""
    best = F.struct(F.col("ts"), (-F.col("event_id")).alias("back"))
    return rows.groupBy("user_id", "event_type").agg(F.max_by("event_id", best).alias("event_id"), F.max("ts").alias("ts"))


def with_gaps(rows: DataFrame) -> DataFrame:
    """Every event with the seconds since the one before of the same user."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return rows.withColumn("gap", (F.unix_micros("ts") - F.unix_micros(F.lag("ts").over(order))) / 1e6)


def pace(rows: DataFrame, ceiling: float = IDLE_SECONDS, least: int = 3) -> DataFrame:
    """Median of the gaps in (0, ceiling] of every user with at least ``least`` of them."""
    gaps = with_gaps(rows).filter((F.col("gap") > 0) & (F.col("gap") <= ceiling))
    return gaps.groupBy("user_id").agg(F.count("*").alias("n_gaps"), F.median("gap").alias("median_gap")).filter(F.col("n_gaps") >= least)


def sessions(rows: DataFrame, idle: float = IDLE_SECONDS) -> DataFrame:
    """Runs of a user's events whose gaps are at most ``idle`` seconds."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    start = F.when(F.col("gap").isNull() | (F.col("gap") > idle), 1).otherwise(0)
    marked = with_gaps(rows).withColumn("session", F.sum(start).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy("user_id", "session").agg(F.count("*").alias("n_events"), F.min("ts").alias("started"), F.max("ts").alias("ended"))


def runs(rows: DataFrame) -> DataFrame:
    """Gaps and islands: maximal runs of one event type in a user's log."""
    all_, same = Window.partitionBy("user_id").orderBy("ts", "event_id"), Window.partitionBy("user_id", "event_type").orderBy("ts", "event_id")
    island = F.row_number().over(all_) - F.row_number().over(same)
    return rows.withColumn("island", island).groupBy("user_id", "event_type", "island").agg(F.count("*").alias("n"), F.min("event_id").alias("first_id"))


def usage_by_user(rows: DataFrame) -> DataFrame:
    """Counts, totals and active days of every user."""
    return rows.groupBy("user_id").agg(
        F.count("*").alias("n_events"), F.count_if(F.col("event_type") == "purchase").alias("n_purchase"),
        F.round(F.sum("value"), 4).alias("total_value"), F.countDistinct(F.date_trunc("day", "ts")).alias("active_days"), F.max("ts").alias("last_seen"),
    )
