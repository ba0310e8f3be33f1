"""Streams of decisions: the latest of each candidate, remembered ones applied on arrival, and folds of commands."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Commands that set a decision, and what they set.
SETS = {"redact": "Redact", "rename": "Rename", "keep": "Keep", "ignore": "Ignore"}
STATE = "decided map<string,string>, applied long, skipped long"
OUT = "session_id string, n_decided long, applied long, skipped long"


def latest(events: DataFrame) -> DataFrame:
    """The latest decision of every candidate of ``(candidate_key, decision, ts, event_id)``; of equal times the least event. Update mode."""
    return events.groupBy("candidate_key").agg(F.max_by(F.struct("decision", "event_id"), F.struct("ts", -F.col("event_id"))).alias("d"), F.max("ts").alias("ts")).select("candidate_key", "d.decision", "d.event_id", "ts")


def remembered(candidates: DataFrame, memory: DataFrame) -> DataFrame:
    """Arriving candidates with the decision that memory holds for exactly their key: a join of a stream with a table."""
    return candidates.join(memory.select("candidate_key", "decision"), "candidate_key", "left")


def answered(asked: DataFrame, done: DataFrame, within: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Pairs of an ``asked(key, asked_at)`` and a ``done(key, done_at)`` that follows within a time: two streams, state bounded by watermarks."""
    a, d = asked.withWatermark("asked_at", late), done.withWatermark("done_at", late).withColumnRenamed("key", "done_key")
    return a.join(d, (F.col("key") == F.col("done_key")) & (F.col("done_at") >= F.col("asked_at")) & (F.col("done_at") <= F.col("asked_at") + F.expr(f"interval {within}"))).drop("done_key")


def fold(commands: DataFrame) -> DataFrame:
    """Every session's state after its commands ``(session_id, seq, kind, candidate_key)``, update mode.

    redact, rename, keep and ignore set a decision; import-* sets one only where
    none is; reset takes it back.  What changes nothing counts as skipped.
    Commands of one batch are applied in order of seq.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        decided, applied, skipped = state.get if state.exists else ({}, 0, 0)
        decided = dict(decided)
        for kind, candidate in pd.concat(batches).sort_values("seq")[["kind", "candidate_key"]].itertuples(index=False):
            imported = kind.startswith("import-")
            new = SETS.get(kind.removeprefix("import-"))
            old = decided.get(candidate)
            if kind == "reset" and old is not None:
                del decided[candidate]
            elif new is not None and new != old and not (imported and old is not None):
                decided[candidate] = new
            else:
                skipped += 1
                continue
            applied += 1
        state.update((decided, applied, skipped))
        yield pd.DataFrame({"session_id": [key[0]], "n_decided": [len(decided)], "applied": [applied], "skipped": [skipped]})

    return commands.groupBy("session_id").applyInPandasWithState(step, OUT, STATE, "update", "NoTimeout")
