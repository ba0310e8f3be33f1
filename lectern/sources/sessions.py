"""Saved review sessions: JSON of several versions, checked, brought forward step by step, and read as rows."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The version that this reads; older ones need a step, newer ones are refused.
VERSION = 2
# Required fields of a session, by what they hold.
STRINGS = ("sessionId", "documentId", "createdAt", "updatedAt")
OBJECTS = ("candidateDecisions", "groupDecisions", "ambiguityResolutions", "entityRegistry")
ARRAYS = ("processingRevisions", "events")
PRESENT = ("activeNotQuite",)

#: A step takes the JSON text of one version and gives that of the next.
Step = Callable[[Column], Column]
#: None is built in: a session of version 1 has no confirmed entities, and making some up would claim decisions that nobody took.
STEPS: Mapping[int, Step] = {}

DECISIONS = "map<string,struct<candidateId:string,decision:string,replacement:string,source:string,decidedAt:string,rationale:string>>"
EVENTS = "array<struct<id:string,kind:string,at:string,payload:map<string,string>>>"


def _kind(v: Column, field: str) -> Column:
    """What a field of a variant holds: a type's name, ``VOID`` for JSON's null, null where it is missing."""
    return F.schema_of_variant(F.try_variant_get(v, f"$.{field}", "variant"))


def _object(v: Column, path: str) -> Column:
    """Whether an object stands there, without the schema of all that it holds."""
    return F.try_variant_get(v, path, "map<string,variant>").isNotNull()


def _array(v: Column, path: str) -> Column:
    return F.try_variant_get(v, path, "array<variant>").isNotNull()


def _once(**columns: Column) -> Column:
    """Columns that are computed once a row: a generator, as a plain column would be repeated in every filter and condition on it."""
    return F.inline_outer(F.array(F.struct(*[c.alias(k) for k, c in columns.items()])))


def _numeric(kind: Column) -> Column:
    return kind.rlike("^(BIGINT|DOUBLE|DECIMAL|FLOAT)")


def judged(texts: DataFrame, steps: Mapping[int, Step] | None = None) -> DataFrame:
    """``texts(value)`` with ``session`` (the text of the current version), ``migrated`` and ``problem`` (null where it is whole)."""
    steps = STEPS if steps is None else steps
    rows = texts.select("*", _once(v=F.try_parse_json("value")))
    shape = F.when(F.col("v").isNull(), "not valid JSON").when(~_object(F.col("v"), "$") & ~_array(F.col("v"), "$"), "expected a JSON object")
    number = F.when(_numeric(_kind(F.col("v"), "schemaVersion")), F.try_variant_get("v", "$.schemaVersion", "double"))
    # whole numbers are told without a fraction
    told = F.when(number == F.floor(number), F.floor(number).cast("string")).otherwise(number.cast("string"))
    oldest = min([VERSION, *steps])
    rows = rows.withColumn("version", number).withColumn("problem", F.coalesce(
        shape, F.when(number.isNull(), "missing or non-numeric schemaVersion -- not a recognized ReviewSession save file"),
        F.when(number > VERSION, F.concat(F.lit("schemaVersion "), told, F.lit(" is newer than this build supports ("), F.lit(str(VERSION)), F.lit(") -- refusing to guess at an unknown future format"))),
        F.when(~number.isin(*[float(k) for k in range(oldest, VERSION + 1) if k == VERSION or k in steps]), F.concat(F.lit("unrecognized schemaVersion "), told, F.lit(" -- no migration path implemented"))),
    )).withColumn("session", F.when(F.col("problem").isNull(), F.col("value")))
    for k in range(oldest, VERSION):
        if k in steps:  # a session climbs the steps from its own version on
            rows = rows.withColumn("session", F.when(F.col("version") <= k, steps[k](F.col("session"))).otherwise(F.col("session")))
    # a text of the current version is parsed already
    rows = rows.select("*", _once(s=F.when(F.col("version") < VERSION, F.try_parse_json("session")).otherwise(F.col("v"))))
    s = F.col("s")
    checks = [F.when(~F.coalesce(_kind(s, f) == "STRING", F.lit(False)), f"missing or non-string required field: {f}") for f in STRINGS]
    checks += [F.when(~_object(s, f"$.{f}"), f"missing or malformed required field: {f}") for f in OBJECTS]
    checks += [F.when(~_array(s, f"$.{f}"), f"missing or malformed required field: {f}") for f in ARRAYS]
    checks += [F.when(F.try_variant_get(s, f"$.{f}", "variant").isNull(), f"missing required field: {f}") for f in PRESENT]
    found = F.coalesce("problem", *checks)
    out = rows.select(*texts.columns, "session", F.coalesce(F.col("version") < VERSION, F.lit(False)).alias("migrated"), _once(found=found))
    return out.select(*texts.columns, F.when(F.col("found").isNull(), F.col("session")).alias("session"), "migrated", F.col("found").alias("problem"))


def read_sessions(texts: DataFrame, steps: Mapping[int, Step] | None = None) -> tuple[DataFrame, DataFrame]:
    """Sessions of JSON texts ``(value)`` and the rejected texts ``(value, problem)``.

    A null or empty text is no JSON.  Sessions keep their text, for what the
    columns leave out; steps of later versions are given as ``steps``.
    """
    rows = judged(texts, steps)
    shape = f"sessionId string, documentId string, createdAt string, updatedAt string, candidateDecisions {DECISIONS}, events {EVENTS}"
    good = rows.filter("problem IS NULL").withColumn("r", F.from_json("session", shape))
    sessions = good.select(
        F.col("r.sessionId").alias("session_id"), F.col("r.documentId").alias("doc_id"), F.col("r.createdAt").alias("created_at"), F.col("r.updatedAt").alias("updated_at"),
        F.col("r.candidateDecisions").alias("decisions"), F.col("r.events").alias("events"), "migrated", "session",
    )
    return sessions, rows.filter("problem IS NOT NULL").select("value", "problem")


def session_decisions(sessions: DataFrame) -> DataFrame:
    """One row for each decision of each session; the key stands for a decision without its candidate."""
    each = sessions.select("session_id", "doc_id", F.explode("decisions").alias("k", "d"))
    return each.select("session_id", "doc_id", F.coalesce("d.candidateId", "k").alias("candidate_id"), "d.decision", "d.replacement", F.coalesce("d.source", F.lit("reviewer")).alias("source"), F.col("d.decidedAt").alias("decided_at"))
