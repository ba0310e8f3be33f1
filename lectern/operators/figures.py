"""Figures of a review: tallies, roll-ups, views, orders, provenance and what is sent about usage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions.text import squeeze

#: A likelihood from here is high.
HIGH = 90
#: A pause between two traced events from here is slow, in milliseconds.
SLOW_MS = 250
#: Orders of groups.
GROUP_ORDERS = ("confidence-desc", "confidence-asc", "member-count-desc", "member-count-asc", "alphabetical")


def group_order(name: str) -> list[Column]:
    """Sort columns of ``(group_id, confidence, n_members, canonical_name)``; all end on the group's id."""
    first = {
        "confidence-desc": F.desc("confidence"), "confidence-asc": F.asc("confidence"), "member-count-desc": F.desc("n_members"),
        "member-count-asc": F.asc("n_members"), "alphabetical": F.asc("canonical_name"),
    }[name]
    return [first, F.asc("group_id")]


def group_list_order() -> list[Column]:
    """Larger groups first, then surer ones, then by name."""
    return [F.desc("n_members"), F.desc("confidence"), F.asc("canonical_name"), F.asc("group_id")]


def merged_units(rows: DataFrame, *keys: str) -> DataFrame:
    """Per key the distinct members of ``rows(place, members)`` in order of first appearance."""
    lists = F.transform(F.array_sort(F.collect_list(F.struct("place", "members"))), lambda x: x["members"])
    return rows.groupBy(*keys).agg(F.array_distinct(F.flatten(lists)).alias("members"))


def tally(events: DataFrame, *keys: str) -> DataFrame:
    """Events, users and values by kind, with those that carry a value of their own."""
    return events.groupBy(*keys).agg(
        F.count("*").alias("n"), F.countDistinct("user_id").alias("n_users"), F.count_if(F.col("value") >= 100).alias("n_large"),
        F.round(F.sum(F.when(F.col("value") >= 100, F.col("value")).otherwise(0.0)), 2).alias("large_value"),
    )


def rolled_up(rows: DataFrame) -> DataFrame:
    """Per document and normal value of ``rows(doc_id, display_value, n_occurrences, score, rules)``: sum, best score and its spelling, all rules."""
    return rows.groupBy("doc_id", F.lower(squeeze(F.col("display_value"))).alias("value")).agg(
        F.sum("n_occurrences").alias("n_occurrences"), F.max("score").alias("score"),
        F.max_by("display_value", F.struct("score", "n_occurrences", "display_value")).alias("display_value"), F.count("*").alias("n_candidates"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("rules")))).alias("rules"),
    )


def primary_rule(rules: Column, priorities: dict[str, int]) -> Column:
    """The rule with the least priority, then name; rules without one come last."""
    known = F.create_map(*[F.lit(x) for pair in priorities.items() for x in pair])
    rank = lambda r: F.coalesce(F.element_at(known, r), F.lit(999))
    return F.get(F.array_sort(F.transform(rules, lambda r: F.struct(rank(r).alias("rank"), r.alias("rule")))), F.lit(0))["rule"]


def strongest_reasons(rows: DataFrame, *keys: str) -> DataFrame:
    """Each description once with its greatest weight, heaviest first."""
    each = rows.groupBy(*keys, "description").agg(F.max("weight").alias("weight"))
    order = F.array_sort(F.collect_list(F.struct((-F.col("weight")).alias("back"), "description")))
    return each.groupBy(*keys).agg(F.transform(order, lambda x: x["description"]).alias("reasons"), F.max("weight").alias("weight"))


def top(values: Column, k: int) -> Column:
    """The first ``k`` of an array of structs in descending order of their fields."""
    return F.slice(F.sort_array(values, asc=False), F.lit(1), F.lit(k))


def completion(done: Column, all_: Column) -> Column:
    """``(percent, state)``: whole percents of what is done."""
    share = F.when(all_ > 0, F.round(done * 100.0 / all_)).otherwise(F.lit(0.0)).cast("int")
    return F.struct(share.alias("percent"), F.when(share >= 100, "complete").when(share > 0, "started").otherwise("new").alias("state"))


def slow_seams(events: DataFrame, key: str, slow_ms: int = SLOW_MS) -> DataFrame:
    """Per key and site: writes, and how many came after a pause of ``slow_ms`` or more; ``events`` has ts, event_id and site."""
    gap = (F.unix_micros("ts") - F.lag(F.unix_micros("ts")).over(Window.partitionBy(key).orderBy("ts", "event_id"))) / 1000
    return events.withColumn("gap", gap).groupBy("site").agg(F.count("*").alias("n_writes"), F.count_if(F.col("gap") >= slow_ms).alias("n_slow"), F.max("gap").alias("longest_ms"))


def narrowed(facts: DataFrame, state: str = "total", category: str | None = None, context: str = "all") -> DataFrame:
    """``facts`` of a view: by status, category, and how often or likely a candidate is."""
    contexts = {
        "all": F.lit(True), "single-occurrence": F.col("n_occurrences") == 1, "multiple-occurrences": F.col("n_occurrences") > 1,
        "high-likelihood": F.coalesce("likelihood", F.lit(0)) >= HIGH,
    }
    if state != "total":
        facts = facts.filter(F.col("status") == state)
    if category is not None:
        facts = facts.filter(F.array_contains("categories", category))
    return facts.filter(contexts[context])


def scope(artifact: Column, selected: Column, focused: Column, widened: Column, items: Column, artifacts: Column) -> Column:
    """``(source, units)`` that a gesture is about: an artifact, else the selection, else the focused item, else all that is left."""
    kinds = lambda axis, ids: F.transform(ids, lambda x: F.concat(F.lit(f"{axis}:"), x))
    return (
        F.when(artifact.isNotNull(), F.struct(F.lit("artifact-focus").alias("source"), kinds("artifact", F.array(artifact)).alias("units")))
        .when(F.size(selected) > 0, F.struct(F.lit("selection").alias("source"), kinds("item", selected).alias("units")))
        .when(~widened & focused.isNotNull(), F.struct(F.lit("item-focus").alias("source"), kinds("item", F.array(focused)).alias("units")))
        .otherwise(F.struct(F.lit("stage-remainder").alias("source"), F.concat(kinds("item", items), kinds("artifact", artifacts)).alias("units")))
    )


def recent_of(sessions: DataFrame, owner: int | None, limit: int, archived: bool = False) -> DataFrame:
    """An owner's latest sessions; those without an owner belong to nobody signed in."""
    mine = sessions.filter(F.col("owner").eqNullSafe(F.lit(owner)))
    return (mine if archived else mine.filter(F.col("archived_at").isNull())).orderBy(F.desc("updated_at"), "session_id").limit(limit)


def with_archived(sessions: DataFrame, changes: DataFrame) -> DataFrame:
    """Sessions after ``changes(session_id, at, action)``: deleted ones go, archived ones get a time, restored ones lose it; the latest counts.

    Of changes at one time a deletion counts before a restoration, and that before an archiving.
    """
    rank = F.when(F.col("action") == "delete", 2).when(F.col("action") == "restore", 1).otherwise(0)
    last = changes.groupBy("session_id").agg(F.max_by(F.struct("action", "at"), F.struct("at", rank)).alias("last"))
    met = sessions.join(last, "session_id", "left").filter(F.coalesce(F.col("last.action"), F.lit("")) != "delete")
    at = F.when(F.col("last.action") == "archive", F.col("last.at")).when(F.col("last.action") == "restore", F.lit(None).cast("timestamp")).otherwise(F.col("archived_at"))
    return met.withColumn("archived_at", at).drop("last")


def status(decision: Column, earlier: Column, score: Column) -> Column:
    """Where a candidate stands: decided before, unlikely, or to be reviewed."""
    return F.when(decision.isNotNull() | earlier, "resolved").when(score < 25, "unlikely").otherwise("to_review")


def wide(decisions: DataFrame, *kinds: str) -> DataFrame:
    """A column of its own for each kind of decision."""
    return decisions.select("*", *[F.coalesce(F.col("decision") == k, F.lit(False)).alias(k.lower()) for k in kinds])


def provenance(events: DataFrame, *keys: str) -> DataFrame:
    """Who decided: a reviewer, an import, or a reviewer after an import; ``events`` has at, source and decision."""
    each = events.groupBy(*keys).agg(
        F.bool_or(F.col("source") == "import").alias("ever_imported"), F.max_by(F.struct("source", "decision"), F.struct("at", "source", "decision")).alias("last")
    )
    how = F.when(~F.col("ever_imported"), "reviewer").when(F.col("last.source") == "import", "imported").otherwise("imported-then-overridden")
    return each.select(*keys, "ever_imported", F.col("last.decision").alias("decision"), how.alias("provenance"))


def live_confidence(score: Column, decided: Column) -> Column:
    """``(current, prior)``: 100 for what is decided, and the score before where it differs."""
    return F.struct(F.when(decided, F.lit(100)).otherwise(score).alias("current"), F.when(decided & (score != 100), score).alias("prior"))


def group_confidence(members: DataFrame, *keys: str) -> DataFrame:
    """A group's confidence: 0.65 of the least member's and 0.35 of the mean, half to even; decided members count as 100."""
    shown = F.when(F.col("decided"), F.lit(100)).otherwise(F.col("score"))
    mix = lambda x: F.bround(0.65 * F.min(x) + 0.35 * F.avg(x)).cast("int")
    return members.groupBy(*keys).agg(mix(shown).alias("current"), mix(F.col("score")).alias("prior"), F.count("*").alias("n_members"))


def memory(decisions: DataFrame, owner: str = "doc_id") -> DataFrame:
    """What later documents can use again: decided candidates by type and value, the latest of each."""
    good = decisions.filter(F.col("decision").isNotNull())
    return good.groupBy(owner, "detected_type", F.lower(squeeze(F.col("display_value"))).alias("value")).agg(F.max_by("decision", F.struct("at", "decision")).alias("decision"), F.max("at").alias("at"))


def long_form(rows: DataFrame, keys: list[str], sections: dict[str, list[str]]) -> DataFrame:
    """``(keys, section, metric, value)``: a row for each figure."""
    each = [F.struct(F.lit(s).alias("section"), F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for s, names in sections.items() for m in names]
    return rows.select(*keys, F.explode(F.array(*each)).alias("x")).select(*keys, "x.section", "x.metric", "x.value")


def witnesses(singles: DataFrame, names: DataFrame) -> DataFrame:
    """Single words that a full name of their document holds, with the first such name; ``names`` has doc_id, sequence, display_value."""
    words = names.select("doc_id", "sequence", "display_value", F.explode(F.array_distinct(F.split(F.lower(F.trim("display_value")), r"\s+"))).alias("word"))
    first = words.groupBy("doc_id", "word").agg(F.min_by("display_value", F.struct("sequence", "display_value")).alias("witness"), F.count("*").alias("n_witnesses"))
    return singles.join(first, (singles["doc_id"] == first["doc_id"]) & (F.lower(singles["display_value"]) == first["word"])).select(
        singles["doc_id"], singles["display_value"], "witness", "n_witnesses"
    )


def routed(candidates: DataFrame, grouped: DataFrame, ambiguous: DataFrame) -> DataFrame:
    """``candidates`` with their route: into a group, to an ambiguity, or what is left."""
    g = grouped.select("candidate_key", F.lit(True).alias("in_group")).distinct()
    a = ambiguous.select("candidate_key", F.lit(True).alias("in_doubt")).distinct()
    met = candidates.join(g, "candidate_key", "left").join(a, "candidate_key", "left")
    return met.withColumn("route", F.when(F.col("in_group"), "group").when(F.col("in_doubt"), "ambiguous").otherwise("remainder")).drop("in_group", "in_doubt")


def ignored(rows: DataFrame) -> DataFrame:
    """The report of ignored items: text, type, occurrences, documents."""
    return rows.filter("decision = 'Ignore'").groupBy("display_value", "detected_type").agg(F.sum("n_occurrences").alias("n_occurrences"), F.countDistinct("doc_id").alias("n_docs"))


def before_and_after(before: DataFrame, after: DataFrame, *keys: str) -> DataFrame:
    """Rows of each key before and after a clean-up, and how many went."""
    b, a = (x.groupBy(*keys).agg(F.count("*").alias(name)) for x, name in ((before, "n_before"), (after, "n_after")))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return b.join(a, list(keys), "full_outer").select(*keys, zero("n_before").alias("n_before"), zero("n_after").alias("n_after"), (zero("n_before") - zero("n_after")).alias("n_removed"))


def split_shapes(splits: DataFrame) -> DataFrame:
    """How often each shape of a split was proposed and taken; ``splits`` has shape (sizes of parts) and accepted."""
    return splits.groupBy(F.array_join("shape", "-").alias("shape")).agg(F.count("*").alias("n"), F.count_if("accepted").alias("n_accepted"))
