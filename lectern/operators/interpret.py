"""Readings of candidates: who speaks for a person, what is left of a reading, cleaned identities, proposals to split a value."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions.text import matches
from lectern.operators.types import NAME_CATEGORIES, PROTECTIVE

#: What a signal of a person is about, in the order in which they are shown.
SCOPES = ("candidate-span", "component", "neighbourhood", "inherited")
#: Signals by their names.
MEMBERSHIP = "person/census-token-membership"
STRUCTURE = "person/census-name-structure"
#: Categories that speak for a name by themselves.
NAME_EVIDENCE = NAME_CATEGORIES + ("known-surname", "surname-given-structure", "initials-with-surname", "ambiguous-lexical-token")
#: Rules whose polarity is declared; others take the sign of their weight.
NEUTRAL = (
    "address_suffix", "ambiguous_lexical_token", "calendar_abbreviation", "common_abbreviation", "contraction", "document_structure_term",
    "expanded_common_language_token", "honorific_title", "interjection_casual", "legal_administrative_term", "organization_suffix", "product_system_name",
    "professional_credential",
)
NEGATIVE = ("common_english_word",)
#: Words that join two things in a list, and signs that part them.
JOINING = ("and", "or", "und", "y", "et")
DIVIDING = "[,;/&+|]"
_NO_TEXTS = "cast(array() as array<string>)"


def _texts(values: tuple[str, ...]) -> Column:
    return F.array(*[F.lit(x) for x in values]) if values else F.expr(_NO_TEXTS)


def _or_none(texts: Column) -> Column:
    return F.coalesce(texts, F.expr(_NO_TEXTS))


def polarity(rule: Column, weight: Column) -> Column:
    """What a rule argues for: as declared, else by the sign of its weight (null: neutral)."""
    return (
        F.when(rule.isin(*NEUTRAL), "neutral").when(rule.isin(*NEGATIVE), "negative")
        .when(weight > 0, "positive").when(weight < 0, "negative").otherwise("neutral")
    )


# -- people ----------------------------------------------------------------------


def witnesses(lineages: Column) -> Column:
    """The number of independent witnesses among signals, each an array of sources in ``lineages``; null: none.

    A signal joins the first group that shares a source with it, or founds one.
    Groups aren't merged later; a signal without sources stands alone.
    """

    def joined(groups: Column, sources: Column) -> Column:
        at = F.array_position(F.transform(groups, lambda g: F.arrays_overlap(g, sources)), True)
        return F.when(at == 0, F.concat(groups, F.array(sources))).otherwise(
            F.transform(groups, lambda g, i: F.when(i == at - 1, F.array_union(g, sources)).otherwise(g))
        )

    return F.coalesce(F.size(F.aggregate(lineages, F.expr("cast(array() as array<array<string>>)"), joined)), F.lit(0))


def outcome(readings: Column) -> Column:
    """How many readings evidence supports; null counts as none."""
    n = F.size(_or_none(readings))
    return F.when(n == 0, "unsupported").when(n == 1, "single").otherwise("contested")


def contest(readings: Column) -> Column:
    """The readings of a contest as one text, each once and in order."""
    return F.array_join(F.array_distinct(_or_none(readings)), "+")


def scope(signal: Column, n_tokens: Column) -> Column:
    """What a signal of a person is about; with one token every signal but those from outside is about the whole value."""
    return (
        F.when((signal == STRUCTURE) | signal.startswith("person/anchor:"), "candidate-span")
        .when((signal == "person/nearby-title") | signal.startswith("person/contextual-usage:"), "neighbourhood")
        .when(signal == "person/entity-linkage", "inherited").when(n_tokens == 1, "candidate-span").otherwise("component")
    )


def adjudicated(rows: DataFrame) -> DataFrame:
    """``rows(signals, lineages, alternatives, n_tokens)`` with the verdict on the reading as a person.

    ``signals`` are names of what speaks for a person, ``lineages`` their
    sources, ``alternatives`` the other readings; nulls are empty.  The reading
    falls only where its signals are all about single tokens of a longer value:
    absence of evidence never speaks against a person.  Adds had_reading,
    supported, scopes, n_witnesses, disposition and becomes, the only other reading.
    """
    signals, others, n = _or_none(F.col("signals")), _or_none(F.col("alternatives")), F.col("n_tokens")
    had = F.size(signals) > 0
    tokens_only = (n > 1) & F.forall(signals, lambda s: s == MEMBERSHIP)
    supported = had & ~F.coalesce(tokens_only, F.lit(False))
    present = F.transform(signals, lambda s: scope(s, n))
    disposition = F.when(supported, "person-survives").when(F.size(others) == 1, "reclassify").when(F.size(others) > 1, "contested-without-person").otherwise("undetermined")
    return rows.withColumns({
        "had_reading": had, "supported": supported, "scopes": F.array_intersect(_texts(SCOPES), present),
        "n_witnesses": F.when(had, witnesses(F.col("lineages"))).otherwise(0), "disposition": disposition,
        "becomes": F.when(disposition == "reclassify", F.get(others, F.lit(0))),
    })


def person_reasons(categories: Column, positives: Column, rules: Column, linked: Column, structured: Column) -> Column:
    """Why a candidate is protected as a person, each reason once; none leaves it open to other readings.

    ``rules`` are those of ``context.WEIGHTS``; ``linked`` tells of a partner
    that has evidence of its own, ``structured`` of the shape of a whole name.
    """
    dashed = lambda texts: F.transform(_or_none(texts), lambda x: F.replace(x, F.lit("_"), F.lit("-")))
    seen = F.array_intersect(_texts(NAME_EVIDENCE), F.array_union(dashed(categories), dashed(positives)))
    title = F.array_intersect(_texts(("nearby-title",)), dashed(positives))
    used = F.transform(_or_none(rules), lambda r: F.when(r.startswith("anchor_"), F.concat(F.lit("anchor:"), F.substr(r, F.lit(8)))).otherwise(F.concat(F.lit("contextual-usage:"), r)))
    flags = F.array_compact(F.array(F.when(linked, "person-evidenced-linkage"), F.when(structured, "census-name-structure")))
    return F.array_distinct(F.concat(seen, title, used, flags))


def undecided_types(rows: DataFrame) -> DataFrame:
    """Rows whose type a reading may change: not those that a reviewer always decides."""
    return rows.filter(~F.coalesce(F.col("detected_type").isin(*PROTECTIVE), F.lit(False)))


# -- identities --------------------------------------------------------------------


def _bare(token: Column) -> Column:
    return F.lower(F.regexp_replace(token, r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", ""))


def token_classes(tokens: DataFrame, lexicon: DataFrame) -> DataFrame:
    """``tokens(token)`` with ``token_class``: name, ordinary or unknown.

    ``lexicon(word, kind)`` lists words in lower case as name, ambiguous or
    ordinary; a name goes before an ambiguous word, which is unknown, and that
    before an ordinary one.
    """
    known = lexicon.groupBy("word").agg(F.bool_or(F.col("kind") == "name").alias("_name"), F.bool_or(F.col("kind") == "ambiguous").alias("_ambiguous"))
    met = tokens.withColumn("_bare", _bare(F.col("token"))).join(known, F.col("_bare") == F.col("word"), "left")
    found = F.when(F.col("_name"), "name").when(F.col("_ambiguous") | F.col("_name").isNull(), "unknown").otherwise("ordinary")
    return met.withColumn("token_class", found).drop("_bare", "_name", "_ambiguous", "word")


def cleaned_options(options: DataFrame, lexicon: DataFrame) -> DataFrame:
    """The identities left of ``options(candidate_key, position, name, backed, relabel)``.

    A name stays if two of its tokens or more aren't ordinary and its first one
    isn't.  Where ``relabel`` is set (the candidate is known as a name) ordinary
    tokens go from it; options that then name one identity become one, a clean
    one before others, then the first.  ``backed`` options (by knowledge or a
    group) stay as they are.  Adds ``cleaned``, the name to show.
    """
    rows = options.select("candidate_key", "position", "name", F.coalesce("backed", F.lit(False)).alias("backed"), F.coalesce("relabel", F.lit(False)).alias("relabel"))
    words = rows.filter(~F.col("backed")).select("candidate_key", "position", "name", "relabel", F.posexplode(F.split(F.trim("name"), r"\s+")).alias("i", "token"))
    told = token_classes(words.filter("token <> ''"), lexicon).groupBy("candidate_key", "position", "name", "relabel").agg(
        F.sort_array(F.collect_list(F.struct("i", "token", "token_class"))).alias("t")
    )
    kept = F.filter("t", lambda x: x["token_class"] != "ordinary")
    whole = told.withColumn("kept", F.transform(kept, lambda x: x["token"])).filter((F.size("kept") >= 2) & (F.get("t", F.lit(0))["token_class"] != "ordinary"))
    clean = F.size("kept") == F.size("t")
    cleaned = F.when(F.col("relabel") & ~clean, F.array_join("kept", " ")).otherwise(F.col("name"))
    key = F.when(F.col("relabel"), F.array_join(F.transform("kept", _bare), " ")).otherwise(F.lower("name"))
    one = whole.withColumns({"clean": clean, "cleaned": cleaned, "identity": key}).groupBy("candidate_key", "identity").agg(
        F.min_by(F.struct("position", "name", "cleaned"), F.struct(~F.col("clean"), F.col("position"))).alias("x")
    )
    stay = rows.filter("backed").select("candidate_key", "position", "name", F.col("name").alias("cleaned"))
    return stay.unionByName(one.select("candidate_key", "x.*"))


def inserted_words(groups: DataFrame, grounded: DataFrame, lexicon: DataFrame) -> DataFrame:
    """Groups of people whose name hides an ordinary word: ``(group_id, name, cleaned)``.

    ``groups(group_id, name)`` are groups of people; ``grounded(group_id)``
    those at which a candidate known as a name points.
    """
    options = groups.join(grounded.select("group_id").distinct(), "group_id", "left_semi").select(
        F.col("group_id").alias("candidate_key"), F.lit(0).alias("position"), "name", F.lit(False).alias("backed"), F.lit(True).alias("relabel")
    )
    return cleaned_options(options, lexicon).filter("cleaned <> name").select(F.col("candidate_key").alias("group_id"), "name", "cleaned")


# -- splits ------------------------------------------------------------------------


def tokens_of(value: Column) -> Column:
    """The units of a value with offsets: runs of letters, digits, apostrophes, dots and hyphens; joining words only at its head."""
    inner = r"[\p{L}\p{N}'’.\-]"
    found = matches(value, rf"{inner}*[\p{{L}}\p{{N}}]{inner}*")
    return F.filter(found, lambda t, i: (i == 0) | ~F.lower(t["text"]).isin(*JOINING))


def split_proposal(value: Column, tokens: Column, attested: Column | None = None) -> Column:
    """Where a value may be cut, after which token and by which rules: an array of ``(boundary, rules)``.

    Signs and joining words propose a cut; names on both sides (``attested``, a
    truth value per token) only add to one.  Blanks alone never do.
    """
    between = F.transform(F.sequence(F.lit(0), F.size(tokens) - 2), lambda i: F.struct(
        i.alias("i"), F.substring(value, F.get(tokens, i)["end"] + 1, F.get(tokens, i + 1)["start"] - F.get(tokens, i)["end"]).alias("text")
    ))

    def rules(x: Column) -> Column:
        divided = x["text"].rlike(DIVIDING)
        joined = F.arrays_overlap(F.regexp_extract_all(F.lower(x["text"]), F.lit(r"\p{L}+"), F.lit(0)), _texts(JOINING))
        both = F.lit(False) if attested is None else F.coalesce(F.get(attested, x["i"]) & F.get(attested, x["i"] + 1), F.lit(False))
        return F.array_compact(F.array(
            F.when(divided, "dividing-punctuation"), F.when(joined, "coordinating-conjunction"), F.when((divided | joined) & both, "attested-on-both-sides"),
        ))

    cuts = F.filter(F.transform(between, lambda x: F.struct(x["i"].alias("boundary"), rules(x).alias("rules"))), lambda x: F.size(x["rules"]) > 0)
    return F.when(F.size(tokens) > 1, cuts).otherwise(F.expr("cast(array() as array<struct<boundary:int,rules:array<string>>>)"))


def valid_boundaries(boundaries: Column, n_tokens: Column) -> Column:
    """Boundaries in order, each once, without those outside the value."""
    return F.array_sort(F.array_distinct(F.filter(F.coalesce(boundaries, F.expr("cast(array() as array<int>)")), lambda b: (b >= 0) & (b <= n_tokens - 2))))


def segments(value: Column, tokens: Column, boundaries: Column) -> Column:
    """The parts of a value between cuts, with offsets, first and last token; text inside a part stays as it is."""
    last = F.concat(valid_boundaries(boundaries, F.size(tokens)), F.array(F.size(tokens) - 1))
    parts = F.transform(last, lambda b, i: F.struct(F.when(i == 0, 0).otherwise(F.get(last, i - 1) + 1).alias("first"), b.alias("last")))
    whole = F.transform(parts, lambda p: F.struct(
        F.substring(value, F.get(tokens, p["first"])["start"] + 1, F.get(tokens, p["last"])["end"] - F.get(tokens, p["first"])["start"]).alias("text"),
        F.get(tokens, p["first"])["start"].alias("start"), F.get(tokens, p["last"])["end"].alias("end"), p["first"].alias("first"), p["last"].alias("last"),
    ))
    return F.when(F.size(tokens) > 0, whole)


def split_record(rows: DataFrame) -> DataFrame:
    """``rows(value, proposed, confirmed)`` with tokens, valid boundaries of both, whether they agree, and the parts."""
    rows = rows.withColumn("tokens", tokens_of(F.col("value")))
    n = F.size("tokens")
    rows = rows.withColumns({"proposed": valid_boundaries(F.col("proposed"), n), "confirmed": valid_boundaries(F.col("confirmed"), n)})
    return rows.withColumns({"accepted_exactly": F.col("proposed") == F.col("confirmed"), "parts": segments(F.col("value"), F.col("tokens"), F.col("confirmed"))})
