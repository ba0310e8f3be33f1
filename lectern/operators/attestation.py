"""What reference packs say of values: one row for each attestation, and a uniform view of all channels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Channels in their order, and what tables call them; the last two are told by what they know, not by terms.
CHANNELS = {
    "higher-ed-terminology": "higher education", "medical-terminology": "medical", "finance-accounting-tax": "finance / accounting / tax", "legal-terminology": "legal",
    "employment-hr-terminology": "employment / HR", "government-public-admin": "government / public administration",
}
NAMES, PLACES = "census-name", "gnis-place"
#: From least to most.
RISKS = ("LOW", "MEDIUM", "HIGH")
#: Families without sub-domains in the uniform view.
UNDIVIDED = ("higher-ed-terminology", "medical-terminology")

PACK = (
    "family string, place long, normalized string, term string, sub_domain string, source_family string, source_id string, hints array<string>, "
    "source_attested boolean, derived boolean, parent_term string, risk string, acronym string, expansion string, notes string"
)


def audit_rows(values: DataFrame, packs: DataFrame, sources: DataFrame | None = None) -> DataFrame:
    """Every attestation of every distinct value, with its provenance.

    ``values(value, family, normalized)`` gives a value's key in each family,
    as families fold differently; ``packs`` are PACK rows, ``place`` the order
    inside a family.  A row without ``source_attested`` counts as attested
    exactly when it is not derived.  ``sources(family, source_family, source,
    source_url, authority_level, licence, retrieved)`` is the side table of
    licences; a family that it lacks keeps empty fields.
    """
    asked = values.select("value", "family", "normalized").distinct().filter("normalized <> ''")
    rows = asked.join(packs, ["family", "normalized"])
    if sources is not None:
        rows = rows.join(sources, ["family", "source_family"], "left")
    else:
        rows = rows.select("*", *[F.lit(None).cast("string").alias(c) for c in ("source", "source_url", "authority_level", "licence", "retrieved")])
    return rows.select(
        "value", "family", "place", "source_family", *[F.coalesce(c, F.lit("")).alias(c) for c in ("source", "source_url", "authority_level", "licence", "retrieved")], "source_id", "sub_domain",
        F.col("term").alias("matched_term"), "normalized", F.concat_ws("|", "hints").alias("hints"), F.coalesce("source_attested", ~F.col("derived")).alias("source_attested"), "derived", "parent_term", "risk",
        "acronym", "expansion", F.coalesce("notes", F.lit("")).alias("notes"),
    )


def _in_order(item, place) -> object:
    """Distinct items in the order of their first rows."""
    return F.array_distinct(F.transform(F.array_sort(F.collect_list(F.when(item.isNotNull(), F.struct(place.alias("p"), item.alias("i"))))), lambda x: x["i"]))


def channels(audit: DataFrame) -> DataFrame:
    """The uniform view of ``audit_rows``: one row for each value and family that attests it."""
    at = F.col("place")
    rank = F.array_position(F.array(*map(F.lit, RISKS)), F.col("risk"))
    hints = F.split("hints", r"\|")
    return audit.groupBy("value", "family", "normalized").agg(
        F.min_by("matched_term", "place").alias("matched_term"), F.count("*").alias("attestation_rows"), _in_order(F.col("source_family"), at).alias("source_families"),
        _in_order(F.when(~F.col("family").isin(*UNDIVIDED), F.col("sub_domain")), at).alias("sub_domains"), F.max(rank).alias("r"), F.bool_or("source_attested").alias("has_source_attested"),
        F.array_distinct(F.filter(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct(at.alias("p"), hints.alias("h")))), lambda x: x["h"])), lambda h: h != "")).alias("hints"),
    ).select(
        "value", "family", "normalized", "matched_term", "attestation_rows", "source_families", "sub_domains", "hints", F.get(F.array(*map(F.lit, RISKS)), F.greatest(F.col("r"), F.lit(1)).cast("int") - 1).alias("highest_risk"), "has_source_attested",
        F.size(F.filter(F.split("normalized", " "), lambda w: w != "")).alias("n_tokens"), F.element_at(F.create_map(*[F.lit(x) for p in CHANNELS.items() for x in p]), F.col("family")).alias("label"),
    )


def attesting(values: DataFrame, found: DataFrame, named: DataFrame | None = None, placed: DataFrame | None = None) -> DataFrame:
    """``(value, channels)`` for every distinct value: the channels that attest it, in their order.

    ``found`` is ``channels``; ``named(value)`` and ``placed(value)`` hold the
    values with support as a name or as a place.  A value without any has an empty list.
    """
    order = F.create_map(*[x for i, c in enumerate([*CHANNELS, NAMES, PLACES]) for x in (F.lit(c), F.lit(i))])
    hits = found.select("value", F.col("family").alias("channel"))
    for extra, name in ((named, NAMES), (placed, PLACES)):
        if extra is not None:
            hits = hits.unionByName(extra.select("value", F.lit(name).alias("channel")))
    listed = hits.distinct().groupBy("value").agg(F.array_sort(F.collect_list(F.struct(F.element_at(order, F.col("channel")).alias("o"), "channel"))).alias("c"))
    return values.select("value").distinct().join(listed, "value", "left").select("value", F.coalesce(F.transform("c", lambda x: x["channel"]), F.array().cast("array<string>")).alias("channels"))
