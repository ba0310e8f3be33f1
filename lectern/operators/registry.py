"""Registries as data: detectors of relationships, providers of relations, weights and lexicons as tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.operators import resolve

#: A detector takes scored candidates and gives ``(doc_id, kind, members, detail)``, one row for each relationship.
Detector = Callable[[DataFrame], DataFrame]
DETECTORS: dict[str, Detector] = {}


def detector(name: str) -> Callable[[Detector], Detector]:
    """Registers a detector under a name; a later one of the same name takes its place."""

    def put(f: Detector) -> Detector:
        DETECTORS[name] = f
        return f

    return put


@detector("identifier-pattern")
def _patterns(scored: DataFrame) -> DataFrame:
    return resolve.identifier_patterns(scored).select("doc_id", "kind", "members", F.col("signature").alias("detail"))


@detector("truncated-variant")
def _truncated(scored: DataFrame) -> DataFrame:
    return resolve.truncated_variants(scored).select("doc_id", F.lit("truncated-variant").alias("kind"), F.array("key", "long_key").alias("members"), F.col("long_key").alias("detail"))


@detector("acronym-expansion")
def _acronyms(scored: DataFrame) -> DataFrame:
    short = scored.filter(F.col("display_value").rlike("^[A-Z]{2,}$")).select("doc_id", F.col("display_value").alias("acronym"), F.col("candidate_key").alias("key"))
    full = scored.select("doc_id", F.col("candidate_key").alias("long_key"), resolve.acronym_of(F.col("display_value")).alias("acronym")).filter("acronym IS NOT NULL AND NOT long_key IS NULL")
    met = short.join(full, ["doc_id", "acronym"]).filter("key <> long_key")
    return met.select("doc_id", F.lit("acronym-expansion").alias("kind"), F.array("key", "long_key").alias("members"), F.col("acronym").alias("detail"))


def relationships(scored: DataFrame, names: list[str] | None = None) -> DataFrame:
    """``(doc_id, detector, kind, members, detail, proposal_id)`` of all registered detectors, or of those named; an unknown name raises."""
    chosen = list(DETECTORS) if names is None else names
    if unknown := [n for n in chosen if n not in DETECTORS]:
        raise KeyError(f"no detector {', '.join(unknown)}")
    out = None
    for name in chosen:
        found = DETECTORS[name](scored).select("doc_id", F.lit(name).alias("detector"), "kind", "members", "detail")
        out = found if out is None else out.unionByName(found)
    if out is None:
        raise ValueError("no detector is named")
    return out.withColumn("proposal_id", F.concat_ws(":", "kind", F.sha2(F.to_json("members"), 256)))


def relations_of(terms: DataFrame, relations: DataFrame) -> DataFrame:
    """What providers know of each distinct ``term``: ``(term, provider, domain, related, strength, label, place)``, strongest first.

    ``relations(provider, domain, a, b, strength, label)`` hold both ways; of
    repeated ones of a provider the strongest counts, and no term is related to itself.
    """
    from pyspark.sql import Window

    both = relations.unionByName(relations.select("provider", "domain", F.col("b").alias("a"), F.col("a").alias("b"), "strength", "label")).filter("a <> b")
    best = both.groupBy("provider", "domain", F.col("a").alias("term"), F.col("b").alias("related")).agg(F.max_by(F.struct("strength", "label"), F.struct("strength", "label")).alias("s"))
    place = F.row_number().over(Window.partitionBy("provider", "term").orderBy(F.desc("s.strength"), "related"))
    return terms.select("term").distinct().join(best, "term").select("term", "provider", "domain", "related", "s.strength", "s.label", place.alias("place"))


def strength_between(pairs: DataFrame, relations: DataFrame) -> DataFrame:
    """``pairs(x, y)`` with the strength of each provider that relates the two, either way round."""
    key = lambda a, b: (F.least(a, b).alias("u"), F.greatest(a, b).alias("v"))
    held = relations.filter("a <> b").select("provider", *key("a", "b"), "strength").groupBy("provider", "u", "v").agg(F.max("strength").alias("strength"))
    return pairs.select("x", "y", *key("x", "y")).join(held, ["u", "v"]).select("x", "y", "provider", "strength")


def under_profiles(rows: DataFrame, weights: DataFrame, bands: DataFrame, base: int = 35, least: int = 1, most: int = 99) -> DataFrame:
    """``rows``, which have ``rules``, once for every profile, with ``profile``, ``score`` and ``quality``; see ``profiled``.

    A profile's weights and bands come to the rows as one small table, so that
    rows are neither shuffled nor sorted.
    """
    profiles = weights.select("profile").unionByName(bands.select("profile")).distinct()
    names = [r.profile for r in profiles.orderBy("profile").limit(MOST_PROFILES + 1).collect()]
    if len(names) > MOST_PROFILES:
        raise ValueError(f"more than {MOST_PROFILES} profiles")
    weighed = weights.filter("rule IS NOT NULL").groupBy("profile", "rule").agg(F.sum("weight").alias("weight")).groupBy("profile").agg(F.map_from_entries(F.collect_list(F.struct("rule", "weight"))).alias("weights"))
    steps = bands.groupBy("profile").agg(F.array_sort(F.collect_list(F.struct("least", "quality"))).alias("steps"))
    held = profiles.join(weighed, "profile", "left").join(steps, "profile", "left").select("profile", F.coalesce("weights", F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<bigint>"))).alias("weights"), "steps")
    every = rows.withColumn("profile", F.explode(F.array(*map(F.lit, names)) if names else F.array().cast("array<string>"))).join(F.broadcast(held), "profile")
    rules = F.filter(F.array_distinct(F.coalesce("rules", F.array().cast("array<string>"))), lambda r: r.isNotNull())
    points = F.aggregate(rules, F.lit(0).cast("long"), lambda n, r: n + F.coalesce(F.try_element_at(F.col("weights"), r), F.lit(0)))
    scored = every.withColumn("score", F.least(F.lit(most), F.greatest(F.lit(least), base + points)).cast("int"))
    reached = F.filter("steps", lambda s: s["least"] <= F.col("score"))
    return scored.withColumn("quality", F.when(F.size(F.coalesce(reached, F.array().cast(scored.schema["steps"].dataType))) > 0, F.element_at(reached, -1)["quality"])).drop("weights", "steps")


def profiled(rows: DataFrame, weights: DataFrame, bands: DataFrame, base: int = 35, least: int = 1, most: int = 99) -> DataFrame:
    """Scores of ``rows(doc_id, candidate_key, rules)`` under every profile: ``(profile, doc_id, candidate_key, score, quality)``.

    ``weights(profile, rule, weight)`` and ``bands(profile, quality, least)``
    are tables, with whole numbers as weights; a rule that a profile lacks
    weighs nothing, a repeated rule of a candidate counts once, and a score
    takes the highest band that it reaches.  Candidates without rules score ``base``.
    """
    return under_profiles(rows.select("doc_id", "candidate_key", "rules"), weights, bands, base, least, most).select("profile", "doc_id", "candidate_key", "score", "quality")


#: Profiles are compared side by side; more than so many raise.
MOST_PROFILES = 1_000


def registered(packs: DataFrame, registry: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Terms of ``packs(rule, term)`` with the label and polarity that ``registry(rule, label, polarity)`` gives, and the terms of unknown rules."""
    known = packs.join(registry.select("rule", "label", "polarity"), "rule")
    return known.select("rule", "term", "label", "polarity"), packs.join(registry.select("rule"), "rule", "left_anti").select("rule", "term")


def polarity(rules: Column, registry_map: Column) -> Column:
    """The polarities of an array of rules by a map from rule to polarity; unknown ones are neutral."""
    return F.transform(rules, lambda r: F.coalesce(F.element_at(registry_map, r), F.lit("neutral")))
