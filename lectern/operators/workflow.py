"""The review of candidates: decisions with precedence, credit and reuse; search, presets and orders; queues and coverage.

``facts`` are rows ``(doc_id, candidate_key, display_value, detected_type, n_occurrences,
likelihood, decision, replacement, ambiguous, categories, necessity)``; decision is null
while a candidate is unreviewed.  Decisions are Redact, Rename, Keep and Ignore.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.operators.evidence import could_reach
from lectern.operators.resolve import ratio
from lectern.sources.shared import written

#: Decisions from the strongest to the weakest.
PRECEDENCE = ("Redact", "Rename", "Keep", "Ignore")
#: Evidence categories of organizations, and the likelihood that counts as high.
ORGANIZATION_CATEGORIES = ("department-organization", "institution-acronym", "institution-term", "organization-suffix")
HIGH = 90
#: Reuse by similarity needs this ratio, and this lead over the second best.
SIMILAR, LEAD = 0.9, 0.05
#: Rows of a zone, and of a chunk that retires together.
ZONE, CHUNK = 24, 12
#: Units of saved time with their seconds, and the value from which the next one is told.
LADDER = (("minutes", 60, 60), ("hours", 3600, 24), ("days", 86400, 7), ("weeks", 604800, 52), ("years", 31536000, None))

# -- search, presets, orders ------------------------------------------------


def found_by(query: str) -> Column:
    """Whether the words of a row, joined by spaces, contain the query, whatever the case."""
    if not query.strip():
        return F.lit(True)
    state = F.coalesce("decision", F.lit("unreviewed"))
    likely = F.concat(F.col("likelihood").cast("string"), F.lit("%"))
    words = F.concat_ws(" ", "display_value", F.coalesce("replacement", F.lit("")), "detected_type", state, likely, F.when(F.col("ambiguous"), "ambiguous ambiguity"), F.array_join("categories", " "))
    return F.lower(words).contains(query.strip().lower())


def preset(name: str) -> Column:
    """The predicate of a preset; never null."""
    known = {
        "unreviewed": lambda: F.col("decision").isNull(), "high-confidence": lambda: F.coalesce("likelihood", F.lit(0)) >= HIGH,
        "ambiguous": lambda: F.coalesce("ambiguous", F.lit(False)), "people": lambda: F.col("detected_type").eqNullSafe("person"),
        "organizations": lambda: F.coalesce(F.arrays_overlap("categories", F.array(*map(F.lit, ORGANIZATION_CATEGORIES))), F.lit(False)),
        "ignored": lambda: F.col("decision").eqNullSafe("Ignore"), "renamed": lambda: F.col("decision").eqNullSafe("Rename"),
        "redacted": lambda: F.col("decision").eqNullSafe("Redact"), "unlikely": lambda: F.col("necessity").eqNullSafe("unlikely"),
    }
    return known[name]()


def order(name: str) -> list[Column]:
    """Sort keys of an order; the last is always the candidate's key, and a missing likelihood sorts as -1."""
    likelihood, tie = F.coalesce("likelihood", F.lit(-1)), [F.col("doc_id"), F.col("candidate_key")]
    return {
        "confidence-desc": [likelihood.desc()], "confidence-asc": [likelihood.asc()],
        "occurrence-count-desc": [F.desc("n_occurrences")], "occurrence-count-asc": [F.asc("n_occurrences")],
        "alphabetical": [F.col("display_value")], "review-state": [F.col("decision").isNotNull(), F.col("display_value")],
        "entity-type": [F.col("detected_type"), F.col("display_value")],
    }[name] + tie


def shown(facts: DataFrame, query: str = "", presets: Iterable[str] = ()) -> DataFrame:
    """Rows that fit the query and every preset; unlikely ones only if asked for."""
    presets = list(presets)
    rows = facts if "unlikely" in presets else facts.filter(~preset("unlikely"))
    return rows.filter(reduce(lambda a, b: a & b, map(preset, presets), found_by(query)))


# -- decisions --------------------------------------------------------------


def decision_rank(decision: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, PRECEDENCE)), decision)


def dominant(decisions: DataFrame, *keys: str) -> DataFrame:
    """The strongest decision of every key, and the weaker ones in order; null and none for keys without any."""
    ranked = F.array_sort(F.collect_set(F.when(decision_rank(F.col("decision")) > 0, F.struct(decision_rank(F.col("decision")).alias("r"), "decision"))))
    rows = decisions.groupBy(*keys).agg(ranked.alias("all"))
    return rows.select(*keys, F.get("all", F.lit(0))["decision"].alias("dominant"), F.transform(F.slice("all", 2, len(PRECEDENCE)), lambda x: x["decision"]).alias("additional"))


def group_state(members: DataFrame, *keys: str) -> DataFrame:
    """undecided, uniform or mixed: whether a group's members share one decision."""
    decided, kinds = F.count("decision"), F.count_distinct("decision")
    state = F.when(decided == 0, "undecided").when((decided == F.count("*")) & (kinds == 1), "uniform").otherwise("needs-attention")
    return members.groupBy(*keys).agg(state.alias("state"), F.count("*").alias("n_members"), decided.alias("n_decided"))


def settling(events: DataFrame, resolved: DataFrame) -> DataFrame:
    """``(session_id, made)``: gestures that first settled a candidate that is resolved now; sessions without any have no row.

    ``events`` are ``(session_id, seq, kind, candidate_key)`` with kind one of decided (by
    itself), batched (as part of a batch) or anchor (the end of a batch; the rest of a
    session is one batch more).  A gesture counts if it is the first of any of its candidates.
    """
    ahead = Window.partitionBy("session_id").orderBy("seq").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    marked = events.withColumn("batch", F.count_if(F.col("kind") == "anchor").over(ahead))
    # a batch is credited at its anchor: its time is that of the anchor, the end for the last one
    close = F.max(F.when(F.col("kind") == "anchor", F.col("seq"))).over(Window.partitionBy("session_id", "batch"))
    own = F.col("kind") == "decided"
    timed = marked.withColumn("close", close).filter(F.col("kind") != "anchor").select(
        "session_id", "candidate_key", F.when(own, F.struct(F.lit(0).alias("last"), F.col("seq").alias("at"), F.lit(0).alias("b"))).otherwise(
            F.struct(F.col("close").isNull().cast("int").alias("last"), F.coalesce("close", F.lit(0)).alias("at"), F.lit(1).alias("b"))).alias("gesture"),
    )
    live = timed.join(resolved.select("session_id", "candidate_key").distinct(), ["session_id", "candidate_key"], "left_semi")
    first = live.groupBy("session_id", "candidate_key").agg(F.min("gesture").alias("gesture"))
    return first.groupBy("session_id").agg(F.count_distinct("gesture").alias("made"))


def gestures(events: DataFrame, resolved: DataFrame) -> DataFrame:
    """``settling`` with a row for every session of the events."""
    made = settling(events, resolved)
    return events.select("session_id").distinct().join(made, "session_id", "left").select("session_id", F.coalesce("made", F.lit(0)).alias("made"))


def time_saved(avoided: Column, seconds: Column) -> Column:
    """``(value, unit)`` of saved time: the first unit in which the rounded value stays below the next one; null if nothing is known or saved."""
    total = avoided * seconds
    value = lambda s: F.floor(total / s * 10 + 0.5) / 10
    out = F.when((avoided <= 0) | avoided.isNull() | seconds.isNull(), None)
    for unit, each, most in LADDER:
        step = F.struct(value(each).alias("value"), F.lit(unit).alias("unit"))
        out = out.when(value(each) < most, step) if most else out.otherwise(step)
    return out


def reduction(units: DataFrame, *keys: str) -> DataFrame:
    """Distinct units and occurrences of ``(.., unit, occurrence_id)``, the decisions they avoid and their share."""
    n = units.groupBy(*keys).agg(F.count_distinct("unit").alias("n_units"), F.count_distinct("occurrence_id").alias("n_occurrences"))
    avoided = F.greatest(F.col("n_occurrences") - F.col("n_units"), F.lit(0))
    return n.withColumn("avoided", avoided).withColumn("percent", F.coalesce(F.try_divide(100.0 * avoided, F.col("n_occurrences")), F.lit(0.0)))


# -- queues -----------------------------------------------------------------


def zone(cells: DataFrame, group: str, rhythm: str = "compacting", size: int = ZONE, chunk: int = CHUNK) -> DataFrame:
    """``cells(group, seq, resolved)`` with ``place`` (from 1) and ``active``.

    compacting: rows up to the ``size``-th unresolved one, in order.  conveyor:
    chunks of rows; those all resolved go to the end, the first ``size`` of the
    rest are active.  rolling: unresolved rows first, ``size`` of them active.
    """
    by = Window.partitionBy(group)
    rows = cells.withColumn("resolved", F.coalesce("resolved", F.lit(False))).withColumn("rn", F.row_number().over(by.orderBy("seq")))
    if rhythm == "compacting":
        before = F.count_if(~F.col("resolved")).over(by.orderBy("seq").rowsBetween(Window.unboundedPreceding, -1))
        return rows.select(group, "seq", "resolved", F.col("rn").alias("place"), (before < size).alias("active"))
    if rhythm == "rolling":
        last = F.col("resolved")
    elif rhythm == "conveyor":
        last = F.min(F.col("resolved").cast("int")).over(Window.partitionBy(group, F.floor((F.col("rn") - 1) / chunk))) == 1
    else:
        raise ValueError(f"unknown rhythm {rhythm!r}")
    rows = rows.withColumn("last", last)
    placed = rows.withColumn("place", F.row_number().over(by.orderBy("last", "rn")))
    return placed.select(group, "seq", "resolved", "place", (~F.col("last") & (F.col("place") <= size)).alias("active"))


def next_open(cells: DataFrame, group: str) -> DataFrame:
    """Every row with the next and the last unresolved ``seq`` after and before it."""
    by = Window.partitionBy(group).orderBy("seq")
    open_ = F.when(~F.coalesce("resolved", F.lit(False)), F.col("seq"))
    return cells.withColumn("next_open", F.min(open_).over(by.rowsBetween(1, Window.unboundedFollowing))).withColumn(
        "last_open", F.max(open_).over(by.rowsBetween(Window.unboundedPreceding, -1))
    )


# -- coverage ---------------------------------------------------------------


def coverage(occurrences: DataFrame, decisions: DataFrame, members: DataFrame, group_decisions: DataFrame) -> DataFrame:
    """Every candidate with its occurrences, how many a decision covers, and a status.

    An occurrence is covered by a decision on its candidate or on a group that
    holds the candidate: ``decisions(doc_id, candidate_key)``, ``members(doc_id,
    group_id, candidate_key)``, ``group_decisions(doc_id, group_id)``, and by
    one on the occurrence itself if ``decisions`` has an occurrence_id.
    """
    keys = ["doc_id", "candidate_key"]
    whole = decisions.filter("occurrence_id is null") if "occurrence_id" in decisions.columns else decisions
    named = whole.select(*keys).unionByName(members.join(group_decisions.select("doc_id", "group_id"), ["doc_id", "group_id"], "left_semi").select(*keys)).distinct()
    rows = occurrences.select(*keys, "occurrence_id").join(named.withColumn("by_candidate", F.lit(1)), keys, "left").withColumn("one", F.lit(0))
    if "occurrence_id" in decisions.columns:
        single = decisions.filter("occurrence_id is not null").select("occurrence_id").distinct().withColumn("by_one", F.lit(1))
        rows = rows.join(single, "occurrence_id", "left").withColumn("one", F.coalesce("by_one", F.lit(0)))
    n = rows.groupBy(*keys).agg(F.count("*").alias("n_occurrences"), F.sum(F.greatest(F.coalesce("by_candidate", F.lit(0)), "one")).alias("n_covered"))
    status = F.when(F.col("n_covered") == F.col("n_occurrences"), "resolved").when(F.col("n_covered") > 0, "partial").otherwise("unresolved")
    return n.withColumn("status", status)


def reuse(candidates: DataFrame, members: DataFrame, known: DataFrame) -> DataFrame:
    """Decisions of the past for candidates ``(doc_id, candidate_key)``: ``(.., tier, decision, replacement, confidence, source_key)``.

    ``known`` is ``(candidate_key, decision, replacement)``, one row a key.  Tiers,
    each for what the one before left: the same key; a group member whose exact
    matches all agree; the most similar key of the same type, if similar enough
    and well ahead of the second.  A key is compared once for all documents that have it.
    """
    keys = ["doc_id", "candidate_key"]
    known = known.filter("decision <> 'Undecided'").select("candidate_key", "decision", F.coalesce("replacement", F.lit("")).alias("replacement"))
    # what several tiers read is written once
    known, _ = written(known)
    exact, _ = written(candidates.select(*keys).distinct().join(known, "candidate_key").select(*keys, "decision", "replacement", F.col("candidate_key").alias("source_key")))
    agreed = members.join(exact, keys).groupBy("doc_id", "group_id").agg(
        F.count_distinct(F.struct("decision", "replacement")).alias("n"), F.min(F.struct("source_key", "decision", "replacement")).alias("s")
    ).filter("n = 1")
    rest, _ = written(candidates.select(*keys).distinct().join(exact, keys, "left_anti"))
    alias = rest.join(members, keys).join(agreed, ["doc_id", "group_id"]).groupBy(*keys).agg(F.min("s").alias("s")).select(*keys, "s.decision", "s.replacement", "s.source_key")
    alias, _ = written(alias)
    rest, _ = written(rest.join(alias, keys, "left_anti"))
    wanted, _ = written(rest.select("candidate_key").distinct())
    tier = lambda df, name, sure: df.withColumn("tier", F.lit(name)).withColumn("confidence", sure)
    like = rest.join(similar_keys(wanted, known), "candidate_key")
    return (
        tier(exact, "exact-key", F.lit(100)).unionByName(tier(alias, "grouped-alias", F.lit(90)))
        .unionByName(tier(like, "similarity-threshold", F.floor(F.col("ratio") * 100 + 0.5).cast("int")).drop("ratio"))
    )


def similar_keys(wanted: DataFrame, known: DataFrame) -> DataFrame:
    """The best known key of every wanted one: ratio at least SIMILAR, and LEAD ahead of the second best.

    Only a second best of at least ``SIMILAR - LEAD`` can spoil a lead, so pairs
    below that are left out.  The rest meet in a pair of letters: see ``_prefix``.
    """
    least = SIMILAR - LEAD
    split = lambda df, p: df.select(
        "*", F.split_part("candidate_key", F.lit(":"), F.lit(1)).alias("type"), F.expr("substring(candidate_key, instr(candidate_key, ':') + 1)").alias(f"{p}_text")
    )
    a, b = split(wanted, "a"), split(known, "b").withColumnRenamed("candidate_key", "source_key")
    ga, gb = _letter_pairs(a, "candidate_key", "a_text"), _letter_pairs(b, "source_key", "b_text")
    often = gb.groupBy("type", "gram").agg(F.count("*").alias("often"))
    met = _prefix(ga, "candidate_key", often, least).join(_prefix(gb, "source_key", often, least), ["type", "gram"]).select("candidate_key", "source_key").distinct()
    near = met.join(a.select("candidate_key", "a_text"), "candidate_key").join(b.select("source_key", "b_text", "decision", "replacement"), "source_key")
    scored = near.filter(could_reach(F.col("a_text"), F.col("b_text"), least)).withColumn("ratio", ratio(F.col("a_text"), F.col("b_text"))).filter(F.col("ratio") > least - 1e-9)
    by = Window.partitionBy("candidate_key").orderBy(F.desc("ratio"), "source_key")
    ranked = scored.withColumn("second", F.lead("ratio").over(by)).withColumn("place", F.row_number().over(by))
    good = (F.col("place") == 1) & (F.col("ratio") >= SIMILAR) & (F.col("second").isNull() | (F.col("ratio") - F.col("second") >= LEAD))
    return ranked.filter(good).select("candidate_key", "source_key", "decision", "replacement", "ratio")


def _letter_pairs(rows: DataFrame, key: str, text: str) -> DataFrame:
    """``(type, key, n, gram)``: neighbouring letters of a text, the i-th repeat of a pair numbered, so that sets count repeats."""
    pairs = F.transform(F.sequence(F.lit(1), F.length(text) - 1), lambda i: F.substring(text, i, F.lit(2)))
    each = rows.filter(F.length(text) >= 2).select("type", key, F.length(text).alias("n"), F.explode(pairs).alias("pair")).groupBy("type", key, "n", "pair").agg(F.count("*").alias("times"))
    return each.select("type", key, "n", F.explode(F.transform(F.sequence(F.lit(1), F.col("times").cast("int")), lambda i: F.concat("pair", i.cast("string")))).alias("gram"))


def _prefix(grams: DataFrame, key: str, often: DataFrame, least: float) -> DataFrame:
    """The rarest pairs of letters of every text, enough that similar texts share one.

    Texts of a and b letters and ratio at least r match in ``r (a + b) / 2``
    letters, in runs parted by at most ``(1 - r)(a + b)`` others, so they share
    ``(1.5 r - 1)(a + b) - 1`` pairs at least.  As ``b >= a r / (2 - r)``, that is
    ``s = (1.5 r - 1) * 2a / (2 - r) - 1``; of a - 1 pairs the rarest ``a - s``
    hold a shared one, whichever it is.
    """
    shared = F.greatest(F.ceil((1.5 * least - 1) * 2 / (2 - least) * F.col("n") - 1 - 1e-9), F.lit(1))
    by = Window.partitionBy("type", key).orderBy(F.coalesce("often", F.lit(0)), "gram")
    rows = grams.join(often, ["type", "gram"], "left").withColumn("place", F.row_number().over(by))
    return rows.filter(F.col("place") <= F.col("n") - shared).select("type", key, "gram")
