"""Semantic types of candidates, whether they need a review, and the sections that they are shown in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Categories of evidence.
ORGANIZATION_CATEGORIES = (
    "department-organization", "organization-suffix", "institution-term", "product-system-name", "administrative-phrase", "legal-administrative-term",
)
PERSON_CATEGORIES = ("known-personal-name-token", "known-first-name", "known-name-structure", "known-surname", "nearby-title")
NAME_CATEGORIES = ("known-personal-name-token", "known-first-name", "known-name-structure")
CALENDAR_CATEGORIES = ("calendar-term", "calendar-abbreviation", "season-or-academic-term")
#: Types in the order in which they are shown; the last one stands for no answer.
ORDER = ("people", "emails", "phones", "organizations", "acronyms", "identifiers", "dates-terms", "document-titles", "other", "undetermined")
#: Detected types that a reviewer always decides.
PROTECTIVE = ("email", "phone", "cin", "long_numeric_id")
#: Sections of a queue by what a recommendation is about.
SECTIONS = {
    "shortened-name": "people", "semantic-alias": "people", "acronym": "acronyms", "identifier": "identifiers",
    "institutional-term": "institutional", "calendar-term": "calendar", "common-word": "common-words",
}


def place(section: Column) -> Column:
    """The position of a section in ORDER."""
    return F.array_position(F.array(*[F.lit(x) for x in ORDER]), section)


def all_categories(filters: Column, reasons: Column) -> Column:
    """Both lists of rules as categories, in order, each once."""
    none = F.expr("cast(array() as array<string>)")
    return F.array_distinct(F.transform(F.concat(F.coalesce(filters, none), F.coalesce(reasons, none)), lambda x: F.replace(x, F.lit("_"), F.lit("-"))))


def _has(categories: Column, *wanted: str) -> Column:
    return F.coalesce(F.arrays_overlap(categories, F.array(*[F.lit(x) for x in wanted])), F.lit(False))


def semantic_type(kind: Column, relations: Column, categories: Column) -> Column:
    """The type that evidence supports; the first that fits.  The shape of a name alone makes no person."""
    return (
        F.when(kind == "email", "emails").when(kind == "phone", "phones").when(kind.isin("cin", "long_numeric_id"), "identifiers")
        .when(_has(relations, "numeric-identifier", "alphanumeric-identifier"), "identifiers")
        .when(_has(relations, "acronym") | _has(categories, "likely-acronym", "institution-acronym"), "acronyms")
        .when((kind == "organization") | _has(categories, *ORGANIZATION_CATEGORIES), "organizations")
        .when(_has(categories, *CALENDAR_CATEGORIES), "dates-terms").when(_has(categories, "document-structure-term"), "document-titles")
        .when((kind == "person") & _has(categories, *PERSON_CATEGORIES), "people").otherwise("other")
    )


def section(kind: Column, relations: Column, categories: Column) -> Column:
    """The section of a type check: the type, or undetermined where no evidence supports one."""
    found = semantic_type(kind, relations, categories)
    return F.when(found == "other", "undetermined").otherwise(found)


def summaries(items: DataFrame, *keys: str) -> DataFrame:
    """Per section of ``items(section, candidate_key, n_occurrences, decided)``: its place, entities, occurrences, decided ones and keys."""
    return items.groupBy(*keys, "section").agg(
        F.first(place(F.col("section"))).alias("place"), F.count("*").alias("n_entities"), F.sum("n_occurrences").alias("n_occurrences"),
        F.count_if("decided").alias("n_decided"), F.sort_array(F.collect_list("candidate_key")).alias("candidate_keys"),
    )


def necessity(kind: Column, readings: Column, harmless: tuple[str, ...]) -> Column:
    """``(necessity, explanation, reason)`` from the readings that evidence supports: only a single harmless one spares a review."""
    only = F.get(readings, F.lit(0))
    required = lambda why: F.struct(F.lit("review-required").alias("necessity"), F.lit(None).cast("string").alias("explanation"), F.lit(why).alias("reason"))
    n = F.size(readings)
    return (
        F.when(kind.isin(*PROTECTIVE), required("protective type")).when(readings.isNull(), required("no profile"))
        .when(n == 0, required("no evidence")).when(n > 1, required("several readings"))
        .when(only == "person", required("a person")).when(~only.isin(*harmless), required("may be private"))
        .otherwise(F.struct(F.lit("unlikely").alias("necessity"), only.alias("explanation"), F.lit("one harmless reading").alias("reason")))
    )


def triage_section(archetype: Column, kind: Column) -> Column:
    known = F.create_map(*[F.lit(x) for pair in SECTIONS.items() for x in pair])
    return F.coalesce(F.element_at(known, archetype), F.when(kind == "person", "people").otherwise("other"))


def gated(facts: DataFrame, ordinary: tuple[str, ...]) -> DataFrame:
    """``facts`` with ``why_review``: null where an ordinary single word is settled without a reviewer, and ``evidence`` for that.

    ``facts``: detected_type, n_tokens, decided, settled, contextual (evidence of a person), categories.
    """
    ordinary_seen = F.array_intersect("categories", F.array(*[F.lit(x) for x in ordinary]))
    why = (
        F.when(F.col("decided"), "decided").when(F.col("settled"), "settled before").when(F.col("detected_type") != "person", "type out of scope")
        .when(F.col("n_tokens") != 1, "several words").when(_has(F.col("categories"), *NAME_CATEGORIES), "known as a name")
        .when(F.col("contextual"), "used as a person").when(F.size(ordinary_seen) == 0, "no ordinary evidence")
    )
    return facts.withColumn("why_review", why).withColumn("evidence", F.when(F.col("why_review").isNull(), ordinary_seen))


def by_rule(rows: DataFrame, rule: str) -> DataFrame:
    """Rows by rule, most frequent first."""
    return rows.groupBy(rule).agg(F.count("*").alias("n")).orderBy(F.desc("n"), rule)


def review_tier(archetype: Column, n_suggestions: Column, kind: Column, n_tokens: Column, categories: Column, n_identities: Column) -> Column:
    """How a recommendation is shown: strong where it names what to do, needs-review, or null for a review of its own.

    A null or uncertain archetype counts only for a possible person: known as a
    name, with identities to choose from.
    """
    person = (kind == "person") & (n_tokens >= 1) & _has(categories, *NAME_CATEGORIES) & (n_identities > 0)
    named = archetype.isNotNull() & (archetype != "uncertain")
    told = (n_suggestions > 0) | archetype.isin("institutional-term", "calendar-term", "common-word", "identifier")
    return F.when(named, F.when(told, "strong").otherwise("needs-review")).when(person, "needs-review")


#: Sections of ambiguous items in their order, with their labels, and tiers inside a section.
AMBIGUOUS = {
    "shortened-names": "Shortened Names", "nicknames": "Other Names", "org-aliases": "Org Names", "acronyms": "Acronyms", "institutional": "Institutional", "calendar": "Time / Calendar",
    "identifiers": "Numeric", "common-words": "Other Words", "other": "Other",
}
TIERS = {"strong": "Strong Recommendations", "needs-review": "Needs Review"}
#: The section of an archetype; an alias is of an organization or a nickname.
ARCHETYPES = {
    "shortened-name": "shortened-names", "acronym": "acronyms", "identifier": "identifiers", "institutional-term": "institutional", "calendar-term": "calendar", "common-word": "common-words",
}


def ambiguous_section(archetype: Column, kind: Column, organization: Column, named: Column) -> Column:
    """The section of an ambiguous item; without an archetype, or an uncertain one, people go by whether evidence names them."""
    known = F.create_map(*[F.lit(x) for pair in ARCHETYPES.items() for x in pair])
    alias = F.when(F.coalesce(organization, F.lit(False)), "org-aliases").otherwise("nicknames")
    rest = F.when(kind != "person", "other").when(F.coalesce(named, F.lit(False)), "shortened-names").otherwise("common-words")
    return F.when(archetype == "semantic-alias", alias).otherwise(F.coalesce(F.element_at(known, archetype), rest))


def ambiguity_queue(items: DataFrame) -> DataFrame:
    """``items(doc_id, candidate_key, archetype, detected_type, organization, named, tier, ord)`` with section, label, and place in the document's queue.

    Sections come in their order, in each the tiers, then what has none, then
    the order of the items; a document's items are sorted in one task.
    """
    from pyspark.sql import Window

    rank = lambda names, c: F.array_position(F.array(*map(F.lit, names)), c)
    rows = items.withColumn("section", ambiguous_section(F.col("archetype"), F.col("detected_type"), F.col("organization"), F.col("named")))
    tier = F.when(rank(TIERS, F.col("tier")) > 0, rank(TIERS, F.col("tier"))).otherwise(len(TIERS) + 1)
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy(rank(AMBIGUOUS, F.col("section")), tier, "ord", "candidate_key"))
    label = F.element_at(F.create_map(*[F.lit(x) for p in AMBIGUOUS.items() for x in p]), F.col("section"))
    return rows.select("doc_id", "candidate_key", "section", label.alias("label"), F.when(tier <= len(TIERS), F.col("tier")).alias("tier"), place.alias("place"))


def ambiguity_sections(queue: DataFrame) -> DataFrame:
    """Per document and section: its items, those of each tier, and where it begins in the queue."""
    return queue.groupBy("doc_id", "section", "label").agg(
        F.count("*").alias("n"), F.count_if(F.col("tier") == "strong").alias("n_strong"), F.count_if(F.col("tier") == "needs-review").alias("n_needs_review"), F.min("place").alias("first_place")
    )
