"""Explanations of scores: texts of rules joined to evidence, filled into sentences, in three views."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What types are called in a sentence.
ENTITIES = {
    "person": "a person's name", "email": "an email address", "phone": "a phone number", "cin": "an identifying number", "long_numeric_id": "an identifying number", "other_identifier": "an identifier",
}
#: Openers by least likelihood, and the last one below all of them.
OPENERS = ((95, "Almost certainly "), (80, "Likely "), (50, "Possibly "))
LOWEST = "Unlikely to be "
#: Rules that look only at shape or frequency; a person claimed by these alone is only name-shaped text.
SHAPE_ONLY = (
    "strong-name-structure", "surname-given-structure", "initials-with-surname", "single-name-candidate", "single-token-reviewable-without-negative-evidence",
    "small-frequency-bonus", "moderate-frequency-bonus", "frequency-saturated", "heading-context",
)
NAME_SHAPED, NO_NAME = "name-shaped text", " No name evidence was found."
NO_EVIDENCE = ". No explanatory evidence was recorded."
#: So many phrases of each side are told in a sentence.
TOLD = 3


def entity_phrase(kind: Column) -> Column:
    known = F.create_map(*[F.lit(x) for pair in ENTITIES.items() for x in pair])
    return F.coalesce(F.element_at(known, kind), F.concat(F.lit("a "), F.replace(kind, F.lit("_"), F.lit(" "))))


def opener(likelihood: Column, thing: Column) -> Column:
    said = None
    for least, text in OPENERS:
        said = F.when(likelihood >= least, text) if said is None else said.when(likelihood >= least, text)
    return F.concat(said.otherwise(LOWEST), thing)


def joined(phrases: Column) -> Column:
    """``a``, ``a and b``, ``a, b, and c``; null for none."""
    kept = F.filter(phrases, lambda x: x != "")
    n = F.size(kept)
    return F.when(n == 1, kept[0]).when(n == 2, F.array_join(kept, " and ")).when(n > 2, F.concat(F.array_join(F.slice(kept, 1, F.greatest(n - 1, F.lit(0))), ", "), F.lit(", and "), F.element_at(kept, -1)))


def worded(evidence: DataFrame, texts: DataFrame) -> DataFrame:
    """Evidence with the texts of its category; one without texts is told by its name.

    ``texts(category, short, standard, expert)`` has each category once.  The
    texts are broadcast only as far as Spark's own threshold allows.
    """
    words = F.trim(F.replace("category", F.lit("-"), F.lit(" ")))
    # the first letter of each word is raised, the others stay
    title = F.array_join(F.transform(F.split(words, " "), lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, F.lit(2), F.length(w)))), " ")
    label = F.when(title == "", "Evidence").otherwise(title)
    met = evidence.join(texts.select("category", "short", "standard", "expert"), "category", "left")
    return met.withColumn("short", F.coalesce("short", label)).withColumn("standard", F.coalesce("standard", F.concat(F.lit("it has "), F.lower(label), F.lit(" evidence")))).withColumn("expert", F.coalesce("expert", label))


def _sides(evidence: DataFrame, texts: DataFrame) -> DataFrame:
    """Per candidate the ordered evidence of each polarity, and the categories in its favour."""
    item = F.struct("ord", "category", "weight", "short", "standard", "expert")
    of = lambda p: F.array_sort(F.collect_list(F.when(F.col("polarity") == p, item)))
    return worded(evidence, texts).groupBy("doc_id", "candidate_key").agg(of("positive").alias("positive"), of("negative").alias("negative"), of("neutral").alias("neutral"))


def summary() -> Column:
    """The sentence over the columns detected_type, likelihood, positive, negative and neutral."""
    said = lambda side: joined(F.transform(F.slice(side, 1, TOLD), lambda x: x["standard"]))
    fors, against, rest = said("positive"), said("negative"), said("neutral")
    # a category may be written with underscores
    shape_only = (F.col("detected_type") == "person") & (F.size("positive") > 0) & F.forall("positive", lambda x: F.replace(x["category"], F.lit("_"), F.lit("-")).isin(*SHAPE_ONLY))
    start = opener(F.col("likelihood"), F.when(shape_only, NAME_SHAPED).otherwise(entity_phrase(F.col("detected_type"))))
    tail = F.concat(F.lit("."), F.when(shape_only, NO_NAME).otherwise(""))
    return (
        F.when(fors.isNotNull() & against.isNotNull(), F.concat(start, F.lit(" because "), fors, F.lit(", but "), against, tail))
        .when(F.coalesce(fors, against).isNotNull(), F.concat(start, F.lit(" because "), F.coalesce(fors, against), tail))
        .when(F.size("neutral") > 0, F.concat(start, F.lit(" based on deterministic evidence: "), F.coalesce(rest, F.lit("")), tail)).otherwise(F.concat(start, F.lit(NO_EVIDENCE)))
    )


def explanations(candidates: DataFrame, evidence: DataFrame, texts: DataFrame) -> DataFrame:
    """All three views of every candidate, as columns: summary; the three sides; disposition and diagnostics.

    ``candidates(doc_id, candidate_key, detected_type, likelihood,
    recommendation, n_occurrences, decision, filter_rules, reasons)``, one row
    each; ``evidence(doc_id, candidate_key, ord, category, polarity, weight)``.
    A candidate without evidence is told as such.  The standard view is
    ``summary``; the audit view has it and the expert texts of each side; the
    expert view has the sides in full, the disposition and the diagnostics:
    the distinct filter rules, or reasons where there are none.
    """
    sides = _sides(evidence, texts)
    rows = candidates.join(sides, ["doc_id", "candidate_key"], "left")
    none = sides.schema["positive"].dataType
    for side in ("positive", "negative", "neutral"):
        rows = rows.withColumn(side, F.coalesce(side, F.array().cast(none)))
    label = F.when(F.col("recommendation") == "ToReview", "To Review").otherwise("Unlikely")
    return rows.select(
        "doc_id", "candidate_key", "likelihood", "recommendation", "n_occurrences", summary().alias("summary"), "positive", "negative", "neutral",
        F.when(F.coalesce(F.col("decision"), F.lit("")) != "", F.concat(F.lit("Resolved: "), "decision")).otherwise(label).alias("disposition"),
        F.array_distinct(F.when(F.size(F.coalesce("filter_rules", F.array().cast("array<string>"))) > 0, F.col("filter_rules")).otherwise(F.coalesce("reasons", F.array().cast("array<string>")))).alias("diagnostics"),
    )


def told(side: str, by: str) -> Column:
    """The expert texts of one side as one string."""
    return F.array_join(F.transform(side, lambda x: x["expert"]), by).alias(side)


def audit(explained: DataFrame) -> DataFrame:
    """The audit view: the sentence and the expert texts of each side."""
    told = lambda side: F.transform(side, lambda x: x["expert"])
    return explained.select("doc_id", "candidate_key", "summary", *[told(s).alias(s) for s in ("positive", "negative", "neutral")])
