"""Audit rows, decision and metric records of a review, as DataFrames and files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

AUDIT_COLUMNS = ("doc_id", "candidate_key", "detected_type", "decision", "replacement", "occurrence_id", "block_order")
BUCKETS = ("high", "medium", "low")
#: Decisions and the counters they go to.
COUNTERS = (("Redact", "redacted"), ("Rename", "renamed"), ("Keep", "kept"), ("Not sensitive", "wrong_match"), ("Review", "review"))


def audit_rows(candidates: DataFrame, occurrences: DataFrame, decisions: DataFrame) -> DataFrame:
    """One row per occurrence with its candidate's decision; a candidate without any gives one row with blanks."""
    keys = ["doc_id", "candidate_key"]
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    rows = candidates.join(decisions.select(*keys, "decision", "replacement"), keys, "left").join(occurrences.select(*keys, "occurrence_id", "block_order"), keys, "left")
    return rows.withColumn("decision", F.coalesce("decision", F.lit("Undecided"))).select("doc_id", *[blank(c) for c in AUDIT_COLUMNS[1:]])


def write_audit(rows: DataFrame, folder: str) -> None:
    rows.write.mode("overwrite").option("header", True).option("quoteAll", True).option("escape", '"').csv(folder)


def decision_records(decisions: DataFrame, version: int = 1) -> DataFrame:
    """``(doc_id, json)``: the decisions of every document in order of their keys."""
    each = F.array_sort(F.collect_list(F.struct("candidate_key", "decision", "replacement")))
    return decisions.groupBy("doc_id").agg(F.to_json(F.struct(F.lit(version).alias("version"), F.col("doc_id"), each.alias("decisions"))).alias("json"))


def read_decisions(records: DataFrame, version: int = 1) -> tuple[DataFrame, DataFrame]:
    """Rows of saved records ``(json)``, and the records that aren't of this version or shape with the reason."""
    shape = "version int, doc_id long, decisions array<struct<candidate_key:string,decision:string,replacement:string>>"
    parsed = records.select("json", F.from_json("json", shape).alias("r"))
    why = F.when(F.col("r.version").isNull(), "not a record").when(F.col("r.version") != version, "unknown version").when(F.col("r.doc_id").isNull() | F.col("r.decisions").isNull(), "incomplete")
    judged = parsed.withColumn("problem", why)
    good = judged.filter("problem is null").select("r.doc_id", F.explode("r.decisions").alias("d")).select("doc_id", "d.*").filter("candidate_key is not null")
    return good, judged.filter("problem is not null").select("json", "problem")


def metrics(rows: DataFrame, *keys: str) -> DataFrame:
    """Counts and shares of ``(.., confidence, decision)``: one row per key, or one in all."""
    n = F.count("*")
    counts = [F.count_if(F.col("decision") == d).alias(name) for d, name in COUNTERS]
    undecided = F.count_if(F.col("decision").isNull() | (F.col("decision") == "Undecided")).alias("undecided")
    percent = lambda d, name: F.coalesce(F.bround(F.try_divide(F.count_if(F.col("decision") == d) * 100.0, n), 2), F.lit(0.0)).alias(f"percent_{name}")
    return rows.groupBy(*keys).agg(
        n.alias("total"), *[F.count_if(F.col("confidence") == b).alias(b) for b in BUCKETS], *counts, undecided, *[percent(d, name) for d, name in COUNTERS[:4]],
    )


def detector_table(rows: DataFrame) -> DataFrame:
    """Detectors by confidence."""
    return rows.groupBy(F.coalesce("detected_type", F.lit("unknown")).alias("detector")).agg(*[F.count_if(F.col("confidence") == b).alias(b) for b in BUCKETS])


def recent(sessions: DataFrame, keep: int = 10, owner: str = "owner") -> DataFrame:
    """The latest saved sessions of every owner; the rest are to be deleted."""
    from pyspark.sql import Window

    by = Window.partitionBy(owner).orderBy(F.desc_nulls_last("saved_at"), "session_id")
    return sessions.withColumn("place", F.row_number().over(by)).filter(F.col("place") <= keep).drop("place")


def put(old: DataFrame, new: DataFrame, *keys: str, at: str = "at") -> DataFrame:
    """The later row of every key; of equal times the old one."""
    rows = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    rest: list[Column] = [F.col(c) for c in old.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(F.col(at), -F.col("_new"))).alias("r")).select(*keys, "r.*").select(*old.columns)


#: Decisions that a report counts, in their order.
AUDITED = ("Keep", "Rename", "Redact", "Ignore", "Undecided")
REPORT_VERSION = 1


def audit_report(sessions: DataFrame, candidates: DataFrame, decisions: DataFrame, groups: DataFrame, stamps: DataFrame, links: DataFrame, checks: DataFrame) -> DataFrame:
    """The complete report of every session as one record: its columns, and ``report``, all of it as JSON.

    ``sessions(session_id, doc_id, file_name, created_at, updated_at)``;
    ``candidates(session_id, candidate_id, detected_type, display_value, n_occurrences)``;
    ``decisions(session_id, candidate_id, decision, replacement, source)``;
    ``groups(session_id, group_id, canonical_name, members)``, ``stamps(session_id, group_id, decision)``
    and ``links(session_id, candidate_id, group_id)`` as the command fold gives
    them; ``checks(session_id, doc_id, passed, problems)`` is the verification of
    the output, and one of another document counts as none and is told.

    A candidate is resolved if it has a decision or a group with it is stamped.
    Sessions without candidates have empty lists.  One row holds one session,
    so a report is as large as its document has candidates.
    """
    covered = groups.join(stamps.select("session_id", "group_id"), ["session_id", "group_id"]).select("session_id", F.explode("members").alias("candidate_id")).distinct().withColumn("covered", F.lit(True))
    rows = candidates.join(decisions.select("session_id", "candidate_id", "decision", "replacement", "source"), ["session_id", "candidate_id"], "left").join(covered, ["session_id", "candidate_id"], "left")
    rows = rows.withColumn("resolved", F.col("decision").isNotNull() | F.coalesce("covered", F.lit(False))).withColumn("decision", F.coalesce("decision", F.lit("Undecided")))
    item = F.struct("candidate_id", "detected_type", "display_value", "n_occurrences", "decision", "replacement", "source", F.when(F.col("resolved"), "resolved").otherwise("unresolved").alias("status"))
    listed = rows.groupBy("session_id").agg(
        F.array_sort(F.collect_list(item)).alias("candidates"), F.count("*").alias("total"), F.count_if(~F.col("resolved")).alias("unresolved"), *[F.count_if(F.col("decision") == d).alias(d.lower()) for d in AUDITED]
    )
    grouped = groups.join(stamps.select("session_id", "group_id", F.col("decision").alias("stamp")), ["session_id", "group_id"], "left").groupBy("session_id").agg(
        F.array_sort(F.collect_list(F.struct("group_id", "canonical_name", "members", F.coalesce("stamp", F.lit("Undecided")).alias("decision")))).alias("groups"), F.count("stamp").alias("groups_decided")
    )
    linked = links.groupBy("session_id").agg(F.array_sort(F.collect_list(F.struct("candidate_id", "group_id"))).alias("links"))
    seen = sessions.join(checks.select("session_id", F.col("doc_id").alias("checked_doc"), "passed", "problems"), "session_id", "left")
    mine = F.col("checked_doc").isNotNull() & (F.col("checked_doc") == F.col("doc_id"))
    out = seen.join(listed, "session_id", "left").join(grouped, "session_id", "left").join(linked, "session_id", "left")
    empty = lambda name, kind: F.coalesce(name, F.array().cast(kind.dataType))
    counts = [d.lower() for d in AUDITED]
    out = out.fillna(0, ["total", "unresolved", "groups_decided", *counts]).select(
        "session_id", "doc_id", "file_name", "created_at", "updated_at", "total", *counts, "unresolved", "groups_decided", F.when(mine, F.col("passed")).alias("passed"), F.when(mine, F.col("problems")).alias("problems"),
        (F.col("checked_doc").isNotNull() & ~mine).alias("mismatched"), F.coalesce(mine & F.col("passed"), F.lit(False)).alias("ready"),
        empty("candidates", listed.schema["candidates"]).alias("candidates"), empty("groups", grouped.schema["groups"]).alias("groups"), empty("links", linked.schema["links"]).alias("links"),
    ).withColumn("outstanding", (F.col("unresolved") > 0) | ~F.col("ready"))
    return out.withColumn("report", F.to_json(F.struct(F.lit(REPORT_VERSION).alias("version"), *out.columns), {"ignoreNullFields": "false"}))
