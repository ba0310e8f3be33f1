"""Review commands folded into decisions, groups, dismissals and entities, as windows over single writes.

A command is expanded into the writes that it asks for, one a candidate, with
whatever its context says about it (``expanded``; streams use the same).  What
depends on earlier commands is then looked up: the group that is open for
refinement, whether a candidate has a decision, whether a proposal is dismissed.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.sources.shared import written

# Kinds of commands, by what they do.
SINGLE = {"keepCandidate": "Keep", "renameCandidate": "Rename", "redactCandidate": "Redact", "ignoreCandidate": "Ignore"}
GROUP = {"confirmGroup": "Keep", "redactGroup": "Redact", "ignoreGroup": "Ignore", "flattenGroup": "Rename"}
MEMBER = "applyNotQuiteMember"
OPENED = ("enterNotQuite", "completeNotQuite", "exitNotQuite", MEMBER)
IMPORT, BULK, RESET, LINK, ACCEPTED = "applyDecisionReuse", "bulkApplyDecision", "resetDecisions", "linkAmbiguousCandidate", "suggestionsAccepted"
DISMISS, RESTORE = "dismissRelationship", "restoreRelationship"
#: What a group counts as after a command for all its members.
STAMPS = {"confirmGroup": "Confirmed", "redactGroup": "Confirmed", "ignoreGroup": "Confirmed", "flattenGroup": "Refined", "completeNotQuite": "Refined"}
#: The last event of a command; those without one log only what they write.
CLOSING = {
    "enterNotQuite": "not-quite-entered", MEMBER: "not-quite-member-applied", "completeNotQuite": "not-quite-completed", "exitNotQuite": "not-quite-exited",
    "confirmGroup": "group-decided", "redactGroup": "group-decided", "ignoreGroup": "group-decided", "flattenGroup": "group-decided", IMPORT: "decisions-imported",
    BULK: "bulk-decided", RESET: "decisions-reset", LINK: "ambiguity-resolved", ACCEPTED: "suggestions-accepted", DISMISS: "relationship-dismissed", RESTORE: "relationship-restored",
}
#: Why commands fail.
BLANK = "replacement text cannot be blank"
NO_BULK, NO_RESET = "no candidates selected for bulk action", "no decisions selected for reset"
NONE_EXIST, NONE_DECIDED = "none of the selected candidates exist in this document -- no decisions applied", "none of the selected candidates currently have decisions to reset"
NO_DISMISS, NO_RESTORE, NOT_DISMISSED = "a relationship proposal has no members -- nothing to dismiss", "a relationship proposal has no members -- nothing to restore", "relationship proposal is not marked unrelated"
OPEN_HERE, OPEN_THERE, OPEN_BULK = "Not Quite is already open for this group", "another Not Quite group is already open; exit it first", "Not Quite is open for this group; exit or complete it first"

COMMANDS = (
    "session_id string, seq long, type string, candidate_id string, group_id string, decision string, replacement string, candidate_ids array<string>, "
    "proposals array<struct<candidate_id:string,decision:string,replacement:string>>, proposal_id string, reset_ids array<string>"
)


def _in(kinds) -> Column:
    return F.col("type").isin(*kinds)


def _mapped(kinds: dict[str, str]) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for pair in kinds.items() for x in pair]), F.col("type"))


def expanded(commands: DataFrame, candidates: DataFrame, groups: DataFrame, options: DataFrame) -> DataFrame:
    """One row for each write of a command ``(COMMANDS)``, and one (``item`` null) for a command without any.

    ``seq`` numbers the commands of a session; other columns are ignored.
    ``candidates(session_id, candidate_id)``, ``groups(session_id, group_id,
    canonical_name, members)`` and ``options(session_id, candidate_id,
    group_ids)`` are what the session's document holds.  ``fault`` is why a
    command fails whatever came before it, ``late`` why it fails unless the
    open group stops it first.  Works on streams of commands as well.
    """
    held = groups.select(F.col("session_id").alias("gs"), F.col("group_id").alias("g"), "canonical_name", "members")
    trimmed = lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+$", "")
    wants = F.when(_in(SINGLE), _mapped(SINGLE)).when(_in(GROUP), _mapped(GROUP)).when(F.col("type") == LINK, "Keep").otherwise(F.col("decision"))
    empty = F.size(F.coalesce("candidate_ids", F.array().cast("array<string>"))) == 0
    # a command takes along only what its kind reads
    c = commands.select(
        "session_id", "seq", "type", "candidate_id", "group_id", "proposal_id", wants.alias("wants"), F.when(wants.isin("Rename", "Redact"), trimmed("replacement")).alias("text"), empty.alias("empty"),
        F.when(_in([BULK, RESET]), F.col("candidate_ids")).when(F.col("type") == RESTORE, F.col("reset_ids")).alias("ids"), F.when(F.col("type") == IMPORT, F.col("proposals")).alias("proposals"),
    )
    c = c.join(held, [F.col("session_id") == F.col("gs"), F.col("group_id") == F.col("g")], "left")
    wants, text, flat = F.col("wants"), F.col("text"), F.col("flat")
    # columns, so that they aren't worked out anew for each write
    c = c.withColumn("flat", F.when(F.col("type") == "flattenGroup", trimmed("canonical_name"))).withColumn("put", F.when(F.col("type") == "flattenGroup", flat).otherwise(text))
    put = F.col("put")
    blank = F.when(F.col("type") == "flattenGroup", F.coalesce(flat, F.lit("")) == "").when(_in([*SINGLE, *GROUP, MEMBER, BULK]), ((wants == "Rename") & (F.coalesce(text, F.lit("")) == "")) | ((wants == "Redact") & (text == "")))
    one = lambda id_, decision, replacement: F.struct(id_.alias("candidate_id"), decision.alias("decision"), replacement.alias("replacement"))
    many = lambda ids: F.transform(ids, lambda x: one(x, wants, put))
    none = F.lit(None).cast("array<struct<candidate_id:string,decision:string,replacement:string>>")
    writes = (
        F.when(_in([*SINGLE, MEMBER, LINK]), F.array(one(F.col("candidate_id"), wants, put))).when(_in(GROUP), many(F.col("members")))
        .when(_in([BULK, RESET, RESTORE]), many(F.col("ids"))).when(F.col("type") == IMPORT, F.col("proposals")).otherwise(none)
    )
    no_group = F.concat(F.lit("no such entity group: "), F.coalesce("group_id", F.lit("")))
    fault = (
        F.when(_in([*GROUP, "enterNotQuite"]) & F.col("g").isNull(), no_group).when((F.col("type") == BULK) & F.col("empty"), NO_BULK).when((F.col("type") == RESET) & F.col("empty"), NO_RESET)
        .when((F.col("type") == DISMISS) & F.col("empty"), NO_DISMISS).when((F.col("type") == RESTORE) & F.col("empty"), NO_RESTORE)
    )
    id_ = F.coalesce("candidate_id", F.lit(""))
    outside = (F.col("type") == MEMBER) & ~F.coalesce(F.array_contains("members", F.col("candidate_id")), F.lit(False))
    late = F.when(F.col("outside"), F.concat(id_, F.lit(" is not a member of Not Quite group "), "group_id")).when(F.col("absent"), F.concat(F.lit("no such candidate: "), id_)).when(
        (F.col("type") == LINK) & F.col("o").isNull(), F.concat(id_, F.lit(" is not a currently-proposed ambiguity"))
    ).when(
        (F.col("type") == LINK) & ~F.array_contains("group_ids", F.col("group_id")), F.concat("group_id", F.lit(" is not one of "), id_, F.lit("'s proposed entity options"))
    ).when(F.col("blank"), F.when((F.col("type") == "flattenGroup"), F.concat(F.lit("group "), "group_id", F.lit("'s canonical name is blank; cannot flatten"))).otherwise(BLANK))
    # what a group's members and name decide is decided before the writes are dealt, which would else carry them
    judged = c.select("session_id", "seq", "type", "candidate_id", "group_id", "proposal_id", fault.alias("fault"), outside.alias("outside"), blank.alias("blank"), F.posexplode_outer(writes).alias("item", "w"))
    rows = judged.withColumn("to", F.col("w.candidate_id"))
    # a link writes to its own candidate, so options are looked up where candidates are
    offered = options.select(F.col("session_id").alias("os"), F.col("candidate_id").alias("o"), "group_ids")
    known = candidates.select(F.col("session_id").alias("s"), F.col("candidate_id").alias("k")).join(offered, [F.col("s") == F.col("os"), F.col("k") == F.col("o")], "left")
    rows = rows.join(known, [F.col("session_id") == F.col("s"), F.col("to") == F.col("k")], "left")
    rows = rows.withColumn("absent", _in([*SINGLE, MEMBER, LINK]) & F.col("k").isNull()).withColumn("late", late)
    write = F.when(_in([RESET, RESTORE]), "reset").when(F.col("type") == IMPORT, "import").otherwise("set")
    anchor = F.when(_in([*GROUP, MEMBER, LINK]), F.col("group_id")).otherwise(F.col("to"))
    return rows.select(
        "session_id", "seq", "type", "group_id", "proposal_id", "item", F.col("to").alias("candidate_id"), "w.decision", "w.replacement",
        F.when(F.col("item").isNotNull(), write).alias("write"), anchor.alias("anchor"), F.col("k").isNotNull().alias("known"), "fault", "late",
    )


def stopped(kind: str, group: str | None, open_group: str | None) -> str | None:
    """Why the open group stops a command, if it does."""
    if kind == "enterNotQuite":
        return None if open_group is None else OPEN_HERE if open_group == group else OPEN_THERE
    if kind in OPENED:
        return None if open_group is not None and open_group == group else f"no open Not Quite group matching {group}"
    return OPEN_BULK if kind in GROUP and open_group is not None and open_group == group else None


def opened_after(kind: str, group: str | None, open_group: str | None) -> str | None:
    """The open group after a command that succeeded."""
    return group if kind == "enterNotQuite" else None if kind == "exitNotQuite" else open_group


def _walked(heads: DataFrame) -> DataFrame:
    """Per command why the open group stops it, read in order of each session as a sorted stream."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        session, open_group = None, None
        for b in batches:
            out = []
            for s, kind, group, fault in zip(b["session_id"], b["type"], b["group_id"], b["fault"], strict=True):
                if s != session:
                    session, open_group = s, None
                why = stopped(kind, group, open_group) if fault is None else None
                if fault is None and why is None:
                    open_group = opened_after(kind, group, open_group)
                out.append(why)
            yield pd.DataFrame({"session_id": b["session_id"], "seq": b["seq"], "stop": pd.Series(out, dtype=object, index=b.index)})

    dealt = heads.filter(_in([*GROUP, *OPENED])).select("session_id", "seq", "type", "group_id", "fault").repartition("session_id").sortWithinPartitions("session_id", "seq")
    return dealt.mapInPandas(run, "session_id string, seq long, stop string")


def writes(rows: DataFrame) -> DataFrame:
    """``expanded`` rows with ``why`` (null: the command is carried out so far) and ``applied``.

    A set is always applied, an import only where the candidate has no
    decision, a reset only where it has one; unknown candidates are skipped.
    After a set or an import there is a decision, after a reset there is none,
    so the write before tells.  So it does for dismissed proposals.  The rows
    are written to the shared folder, as they are read for all of these.
    """
    rows, _ = written(rows)
    heads = rows.filter("item IS NULL OR item = 0")
    dismissed = F.lag("type").over(Window.partitionBy("session_id", "proposal_id").orderBy("seq"))
    restored = heads.filter(_in([DISMISS, RESTORE]) & F.col("fault").isNull()).select("session_id", "seq", "type", dismissed.alias("before"))
    missing = restored.filter((F.col("type") == RESTORE) & ~F.coalesce(F.col("before") == DISMISS, F.lit(False))).select("session_id", "seq", F.lit(NOT_DISMISSED).alias("stop"))
    checked = rows.join(_walked(heads).filter("stop IS NOT NULL").unionByName(missing), ["session_id", "seq"], "left").withColumn("why", F.coalesce("fault", "stop", "late"))
    live = F.col("why").isNull() & F.col("known") & F.col("write").isNotNull()
    had = F.lag("write").over(Window.partitionBy("session_id", "candidate_id", live).orderBy("seq", "item"))
    decided = F.coalesce(had != "reset", F.lit(False))
    return checked.withColumn("applied", live & ((F.col("write") == "set") | ((F.col("write") == "import") & ~decided) | ((F.col("write") == "reset") & decided))).drop("stop")


def results(done: DataFrame) -> DataFrame:
    """Per command: ok, reason, and how many of its writes were applied and skipped; ``done`` as from ``writes``."""
    counted = done.groupBy("session_id", "seq").agg(
        F.first("type").alias("type"), F.first("why").alias("why"), F.count("item").alias("n"), F.sum(F.col("applied").cast("long")).alias("applied")
    )
    nothing = (F.col("why").isNull()) & (F.col("applied") == 0)
    reason = F.coalesce("why", F.when(nothing & (F.col("type") == BULK), NONE_EXIST).when(nothing & (F.col("type") == RESET), NONE_DECIDED))
    return counted.withColumn("reason", reason).select(
        "session_id", "seq", "type", F.col("reason").isNull().alias("ok"), "reason", "applied", F.when(F.col("reason").isNull(), F.col("n") - F.col("applied")).otherwise(0).alias("skipped")
    )


def decisions(done: DataFrame) -> DataFrame:
    """The current decision of every candidate that has one: that of its last applied write, unless it was a reset."""
    last = F.max_by(F.struct("write", "decision", "replacement", "seq"), F.struct("seq", "item"))
    kept = done.filter("applied").groupBy("session_id", "candidate_id").agg(last.alias("x")).filter("x.write <> 'reset'")
    return kept.select("session_id", "candidate_id", "x.decision", "x.replacement", F.when(F.col("x.write") == "import", "imported").otherwise("reviewer").alias("source"), F.col("x.seq").alias("seq"))


def group_decisions(done: DataFrame) -> DataFrame:
    """What groups were last stamped as."""
    stamped = done.filter(_in(STAMPS) & F.col("why").isNull() & ~F.coalesce(F.col("item") > 0, F.lit(False)))
    return stamped.groupBy("session_id", "group_id").agg(F.max_by(_mapped(STAMPS), "seq").alias("decision"), F.max("seq").alias("seq"))


def dismissals(done: DataFrame) -> DataFrame:
    """Proposals that are marked unrelated."""
    marked = done.filter(_in([DISMISS, RESTORE]) & F.col("why").isNull())
    return marked.groupBy("session_id", "proposal_id").agg(F.max_by("type", "seq").alias("last"), F.max("seq").alias("seq")).filter(F.col("last") == DISMISS).drop("last")


def links(done: DataFrame) -> DataFrame:
    """The group that an ambiguous candidate was last linked to."""
    linked = done.filter((F.col("type") == LINK) & F.col("why").isNull())
    return linked.groupBy("session_id", "candidate_id").agg(F.max_by("group_id", "seq").alias("group_id"), F.max("seq").alias("seq"))


def events(done: DataFrame) -> DataFrame:
    """The log: one event for each applied write of commands that log them, and a closing one; numbered by session."""
    ok = results(done).filter("ok").select("session_id", "seq", "type")
    each = done.filter(F.col("applied") & (F.col("type") != MEMBER)).select(
        "session_id", "seq", "item", F.when(F.col("write") == "reset", "candidate-reset").otherwise("candidate-decided").alias("kind"), "candidate_id"
    )
    closing = ok.filter(_in(CLOSING)).select("session_id", "seq", F.lit(2**31 - 1).alias("item"), _mapped(CLOSING).alias("kind"), F.lit(None).cast("string").alias("candidate_id"))
    number = F.row_number().over(Window.partitionBy("session_id").orderBy("seq", "item"))
    return each.unionByName(closing).select("session_id", number.alias("number"), "seq", "kind", "candidate_id")


def _moves(done: DataFrame) -> DataFrame:
    """Every time that a candidate joins (+1) or leaves (-1) the entity of an anchor, with the anchor's members after it."""
    to = F.when((F.col("write") != "reset") & (F.col("decision") != "Ignore"), F.col("anchor"))
    before = F.lag(to).over(Window.partitionBy("session_id", "candidate_id").orderBy("seq", "item"))
    moved = done.filter("applied").select("session_id", "seq", "item", "candidate_id", to.alias("to"), before.alias("from")).filter("NOT (to <=> from)")
    each = moved.select("session_id", "seq", "item", "candidate_id", F.explode(F.array(F.struct(F.col("from").alias("anchor"), F.lit(-1).alias("step")), F.struct(F.col("to").alias("anchor"), F.lit(1).alias("step")))).alias("x"))
    so_far = Window.partitionBy("session_id", "anchor").orderBy("seq", "item").rowsBetween(Window.unboundedPreceding, 0)
    return each.select("session_id", "seq", "item", "candidate_id", "x.*").filter("anchor IS NOT NULL").withColumn("members", F.sum("step").over(so_far))


def entities(done: DataFrame) -> DataFrame:
    """The registry: entity_id, anchor, members in the order in which they joined, and the command that confirmed it.

    A candidate belongs to one entity at most: to that of its anchor (its
    group, or itself), as long as its decision is neither Ignore nor reset.  An
    entity is minted when its anchor gets a first member and is gone when the
    last one leaves; numbers count all that were ever minted in a session.
    """
    moves = _moves(done)
    minted = moves.filter("step = 1 AND members = 1").withColumn("entity_id", F.concat(F.lit("entity-"), F.row_number().over(Window.partitionBy("session_id").orderBy("seq", "item"))))
    current = minted.groupBy("session_id", "anchor").agg(F.max_by(F.struct("entity_id", "seq"), F.struct("seq", "item")).alias("e"))
    last = moves.groupBy("session_id", "anchor", "candidate_id").agg(F.max_by(F.struct("step", "seq", "item"), F.struct("seq", "item")).alias("x")).filter("x.step = 1")
    held = last.groupBy("session_id", "anchor").agg(F.array_sort(F.collect_list(F.struct("x.seq", "x.item", "candidate_id"))).alias("m"))
    return held.join(current, ["session_id", "anchor"]).select("session_id", "e.entity_id", "anchor", F.transform("m", lambda x: x["candidate_id"]).alias("members"), F.col("e.seq").alias("confirmed"))
