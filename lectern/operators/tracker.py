"""What a session's decisions came to: gestures, occurrences that needed none of their own, time, and the payload of a usage report."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.operators import commands, review, workflow

#: Commands whose writes are one gesture together.
BATCHES = (*commands.GROUP, commands.BULK, commands.IMPORT)
#: Fixed value: longer pauses between two decisions, in seconds, are none of work.
IDLE = 120
#: Decisions and how a report calls their counts.
COUNTS = {"Rename": "change_count", "Ignore": "ignore_count", "Keep": "keep_count", "Redact": "redact_count"}


def credited(done: DataFrame) -> DataFrame:
    """``(session_id, seq, kind, candidate_key)``: the decisions of ``commands.writes`` as gestures, a batch closed by its command."""
    made = done.filter(F.col("applied") & (F.col("write") != "reset"))
    batch = F.col("type").isin(*BATCHES)
    each = made.select("session_id", F.col("seq").alias("s"), F.col("item").alias("i"), F.when(batch, "batched").otherwise("decided").alias("kind"), F.col("candidate_id").alias("candidate_key"))
    ends = commands.results(done.filter(batch)).filter("ok").select("session_id", F.col("seq").alias("s"), F.lit(2**31 - 1).alias("i"), F.lit("anchor").alias("kind"), F.lit(None).cast("string").alias("candidate_key"))
    # one number for each event: commands in order, and inside a command its writes before its end
    return each.unionByName(ends).select("session_id", (F.col("s") * F.lit(1 << 32) + F.col("i")).alias("seq"), "kind", "candidate_key")


def figures(done: DataFrame, occurrences: DataFrame, resolved: DataFrame, times: DataFrame) -> DataFrame:
    """Per session: made, covered, avoided, percent, and the time that was avoided as value and unit (null where no pace is known).

    ``occurrences(session_id, candidate_id, n)`` counts what candidates cover,
    ``resolved(session_id, candidate_id)`` are those settled now, ``times(session_id, seq, ts)`` when commands came.  Made are the gestures
    that first settled a candidate that is resolved now; the pace is the median
    time between decisions taken one by one.
    """
    made = workflow.settling(credited(done), resolved.withColumnRenamed("candidate_id", "candidate_key"))
    covered = resolved.distinct().join(occurrences, ["session_id", "candidate_id"]).groupBy("session_id").agg(F.sum("n").alias("covered"))
    single = done.filter(F.col("applied") & (F.col("write") == "set") & ~F.col("type").isin(*BATCHES)).select("session_id", "seq").join(times, ["session_id", "seq"])
    pace = review.pace(single.select(F.col("session_id").alias("user_id"), F.col("seq").alias("event_id"), "ts"), ceiling=IDLE).select(F.col("user_id").alias("session_id"), F.col("median_gap").alias("pace"))
    rows = done.select("session_id").distinct().join(made, "session_id", "left").join(covered, "session_id", "left").join(pace, "session_id", "left")
    rows = rows.withColumn("made", F.coalesce("made", F.lit(0))).withColumn("covered", F.coalesce("covered", F.lit(0)))
    avoided = F.greatest(F.col("covered") - F.col("made"), F.lit(0))
    saved = workflow.time_saved(F.col("avoided"), F.col("pace"))
    return rows.withColumn("avoided", avoided).select(
        "session_id", "made", "covered", "avoided", F.when(F.col("covered") > 0, 100.0 * F.col("avoided") / F.col("covered")).otherwise(0.0).alias("percent"), "pace", saved["value"].alias("saved"), saved["unit"].alias("unit"),
    )


def payloads(done: DataFrame, sizes: DataFrame, tracked: DataFrame, now: DataFrame | None = None) -> DataFrame:
    """One usage report a session: counts of decisions, items and occurrences, gestures, and whether every item is decided.

    ``sizes(session_id, items, occurrences)`` is what a session's document
    holds; a session without a document reports nothing.  ``now`` are the
    decisions of ``done``, where they are at hand.
    """
    now = commands.decisions(done) if now is None else now
    counts = now.groupBy("session_id").agg(*[F.count_if(F.col("decision") == d).alias(c) for d, c in COUNTS.items()], F.count("*").alias("decided"))
    rows = sizes.join(done.select("session_id").distinct(), "session_id", "left_semi").join(counts, "session_id", "left").join(tracked.select("session_id", "made", "avoided"), "session_id", "left")
    filled = rows.fillna(0, [*COUNTS.values(), "decided", "made", "avoided"])
    return filled.select(
        "session_id", *COUNTS.values(), F.col("made").alias("decisions_made"), F.col("avoided").alias("decisions_avoided"), F.col("items").alias("review_item_count"), F.col("occurrences").alias("occurrence_count"),
        F.when(F.col("decided") >= F.col("items"), "completed").otherwise("incomplete").alias("completion_status"),
    )
