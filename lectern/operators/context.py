"""Occurrences in their surroundings: document order, joined facts, blocks that follow, combined contextual evidence."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Weights of contextual evidence of a person.
WEIGHTS = {
    "anchor_full_name_with_role": 50, "anchor_signature_block": 48, "anchor_name_with_email": 42, "anchor_full_name_with_organization": 40, "contextual_direct_address": 40,
    "contextual_attribution": 40, "contextual_coordination": 34, "contextual_person_list": 32, "contextual_possessive": 30, "contextual_human_subject": 30, "contextual_human_object": 24,
}
#: What the strongest, second, ... rule counts for, then all others; and the most that they add up to.
FACTORS, TAIL, CAP, GATE = (1.0, 0.4, 0.2), 0.1, 55, 30


def document_order(found: DataFrame) -> DataFrame:
    """``found`` with ``sequence``: 0, 1, ... by block and start inside a document."""
    return found.withColumn("sequence", F.row_number().over(Window.partitionBy("doc_id").orderBy("block_order", "start", "candidate_key")) - 1)


def with_facts(found: DataFrame, candidates: DataFrame, groups: DataFrame) -> DataFrame:
    """Occurrences with the facts of their candidates, and the first group (by id) that holds each; both may be missing."""
    first = groups.groupBy("doc_id", "candidate_key").agg(F.min("group_id").alias("group_id"))
    return document_order(found.join(candidates, ["doc_id", "candidate_key"], "left").join(first, ["doc_id", "candidate_key"], "left"))


def with_following(block_rows: DataFrame) -> DataFrame:
    """Blocks with the two that follow in their document."""
    order = Window.partitionBy("doc_id").orderBy("block_order")
    return block_rows.withColumn("next_text", F.lead("text", 1).over(order)).withColumn("after_next_text", F.lead("text", 2).over(order))


def strength(rules: Column) -> Column:
    """The combined weight of an array of rules: each further one counts for less, up to CAP; half rounds up."""
    known = F.create_map(*[F.lit(x) for pair in WEIGHTS.items() for x in pair])
    weights = F.array_sort(F.transform(rules, lambda r: -F.element_at(known, r)))
    factors = F.array(*[F.lit(x) for x in FACTORS])
    each = F.transform(weights, lambda w, i: -w * F.coalesce(F.get(factors, i), F.lit(TAIL)))
    return F.least(F.lit(CAP), F.floor(F.aggregate(each, F.lit(0.0), lambda s, x: s + x) + 0.5)).cast("int")


def person_evidence(rows: DataFrame) -> DataFrame:
    """Per candidate of ``rows(doc_id, candidate_key, sequence, rules)``: all rules, their strength, and the telling occurrence.

    That is one with an anchor before others, then the strongest, then the
    first.  ``n_without`` counts occurrences without evidence; ``passes``
    marks a strength from GATE.
    """
    told = rows.select("doc_id", "candidate_key", "sequence", "rules", strength(F.col("rules")).alias("strength"), F.exists("rules", lambda r: r.startswith("anchor_")).alias("anchor"))
    each = told.groupBy("doc_id", "candidate_key").agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("rules")))).alias("rules"), F.count_if(F.size("rules") == 0).alias("n_without"), F.count("*").alias("n"),
        F.max_by("sequence", F.struct("anchor", "strength", -F.col("sequence"))).alias("telling"),
    )
    return each.withColumn("strength", strength(F.col("rules"))).withColumn("passes", F.col("strength") >= GATE)


# -- how a context uses a name ---------------------------------------------------

#: Words that may stand between a subject and its verb.
AUXILIARIES = tuple(
    "has have had will would can could may might must should is was were also then already never just recently subsequently later since again".split()
)
_NAME = r"[A-Z][A-Za-z'’.-]+"
_LISTED = rf"{_NAME}(?:\s+{_NAME})?"
#: What a word may carry besides letters.
_RIM = r"[^A-Za-z'\s]*"


def _any(words: tuple[str, ...]) -> str:
    """A pattern of the words, longer ones first; none of them fits nothing."""
    return "(?:" + "|".join(r"\s+".join(re.escape(x) for x in w.split()) for w in sorted(words, key=len, reverse=True)) + ")" if words else "(?!)"


def usage_rules(context: Column, words: dict[str, tuple[str, ...]]) -> Column:
    """The rules of WEIGHTS that a bracketed context fulfils, in the order of this function; none without brackets or context.

    ``words``: openers and follow_ons of an address, attribution (verbs),
    lead_ins, roles, actions, directed (verbs at a person), abbreviations that
    end no sentence; verbs in all the forms that count.  Saying something is
    attribution and not also an action.
    """
    w = {k: _any(words.get(k, ())) for k in ("openers", "follow_ons", "attribution", "lead_ins", "roles", "actions", "directed", "abbreviations")}
    part = lambda i: F.regexp_extract(context, r"(?s)^([^\[]*)\[([^\]]*)\](.*)$", i)
    before, match, after = F.regexp_replace(part(1), r"^\.\.\.", ""), part(2), F.regexp_replace(part(3), r"\.\.\.$", "")

    def person(fragment: Column) -> Column:
        head = F.trim(F.get(F.split(F.trim(fragment), "[,.;:]"), F.lit(0)))
        return (fragment != "") & (fragment.rlike(rf"(?i)(?:^|\s){w['roles']}\b") | head.rlike(rf"^{_NAME}(?:\s+{_NAME}){{0,2}}$"))

    said = after.rlike(rf"(?i)^\s*{_RIM}{w['attribution']}{_RIM}(?:\s|$)") | before.rlike(rf"(?i)(?:^|[\s.;,]){w['lead_ins']}\s*$")
    address = before.rlike(rf"(?i)(?:^|[\s.;!?]){w['openers']}\s*,?\s*$") | after.rlike(rf"(?i)^\s*[,–—-]\s*{w['follow_ons']}")
    joined = person(F.regexp_extract(after, r"(?i)^\s*(?:,\s*)?(?:and|&)\s+(.{1,40})", 1)) | person(F.regexp_extract(before, r"(?i)(.{1,40}?)\s+(?:and|&)\s*,?\s*$", 1))
    left, left_two = rf"(?:^|[\s(]){_LISTED}\s*,\s*(?:and\s+)?$", rf"(?:^|[\s(]){_LISTED}\s*,\s*[\s(]{_LISTED}\s*,\s*(?:and\s+)?$"
    right = rf"^\s*,\s*(?:and\s+)?{_LISTED}"
    listed = before.rlike(left_two) | after.rlike(right + right[1:]) | (before.rlike(left) & after.rlike(right))
    owner = match.rlike("['’]s\\s*$") | after.rlike(r"^['’]s\b")
    acts = ~after.rlike(r"^\s*,") & after.rlike(rf"(?i)^\s*{_RIM}(?:(?:{_any(AUXILIARIES)}|[a-z']*ly){_RIM}\s+{_RIM})?{w['actions']}{_RIM}(?:\s|$)")
    ended = before.rlike(r"[!?]\s*$") | (before.rlike(r"(?:^|\s)[\p{L}\p{M}]{2,}\.\s*$") & ~before.rlike(rf"(?i)(?:^|\s){w['abbreviations']}\.\s*$"))
    reached = ~ended & before.rlike(rf"(?i)(?:^|\s){_RIM}{w['directed']}{_RIM}\s*$")
    rules = (
        ("contextual_direct_address", address), ("contextual_attribution", said), ("contextual_coordination", joined), ("contextual_person_list", listed), ("contextual_possessive", owner),
        ("contextual_human_subject", acts & ~said), ("contextual_human_object", reached),
    )
    fired = F.array_compact(F.array(*[F.when(c, F.lit(r)) for r, c in rules]))
    return F.when(context.rlike(r"(?s)\[[^\]]*\]"), fired).otherwise(F.expr("cast(array() as array<string>)"))


# -- anchors of a name -------------------------------------------------------------

#: The shape of a whole name, what may precede a role, and how far behind a name an address counts.
FULL_NAME = r"^[A-Z][A-Za-z'’.-]+(?:\s+(?:[A-Z]\.|[A-Z][A-Za-z'’.-]+)){1,3}$"
RANKS = "(?:senior|junior|associate|assistant|deputy|interim|acting|vice|executive|chief)"
ADDRESS_REACH = 80


def anchor_rules(match: Column, text: Column, end: Column, next_text: Column, roles: tuple[str, ...], tails: tuple[str, ...], address: str) -> Column:
    """The anchors that tell who a name is, the strongest first: its role, a signature, its own address, its organization.

    ``text`` is the block of the occurrence, ``end`` its end there, ``next_text``
    the following block (null: none).  ``roles`` are nouns for people, ``tails``
    words of organizations, ``address`` is the pattern of a mail address.  A
    single word has no role or organization.  A null match or text gives none.
    """
    role = lambda line: F.trim(line).rlike(rf"(?i)^{RANKS}?\s*{_any(roles)}\b")

    def organization(line: Column) -> Column:
        named = F.split(F.lower(F.regexp_replace(F.trim(line), "[.,]", "")), r"\s+")
        return (F.size(named) <= 6) & F.arrays_overlap(named, F.array(*[F.lit(x) for x in tails]) if tails else F.expr("cast(array() as array<string>)"))

    def short(line: Column) -> Column:
        return F.length(F.trim(line)).between(1, 60) & ~F.trim(line).rlike(r"[.!?]\s+\S")

    name, block = F.trim(match), F.trim(text)
    after = F.substr(text, end + 1)
    whole = name.rlike(FULL_NAME)
    led = after.rlike(r"^\s*[,–—(-]")
    tail = F.regexp_replace(after, r"^\s*[,–—(-]\s*", "")
    at = F.instr(block, name)
    rest = F.when(at > 0, F.concat(F.substr(block, F.lit(1), at - 1), F.substr(block, at + F.length(name)))).otherwise(block)
    signed = short(block) & (F.length(F.regexp_replace(rest, r"[,;:()\s.]", "")) <= 6) & short(next_text) & (role(next_text) | organization(next_text))
    parts = F.filter(F.split(F.lower(name), "[^a-z]+"), lambda t: F.length(t) >= 4)
    seen = F.concat(*[
        F.coalesce(F.regexp_extract_all(x, F.lit(address), F.lit(0)), F.expr("cast(array() as array<string>)"))
        for x in (F.substr(after, F.lit(1), F.lit(ADDRESS_REACH)), F.when(short(next_text), next_text))
    ])
    own = F.exists(seen, lambda m: F.exists(parts, lambda t: F.contains(F.lower(F.substring_index(m, "@", 1)), t)))
    rules = (
        ("anchor_full_name_with_role", whole & led & role(tail)), ("anchor_signature_block", signed), ("anchor_name_with_email", own),
        ("anchor_full_name_with_organization", whole & led & ~role(tail) & organization(tail)),
    )
    return F.array_compact(F.array(*[F.when(c, F.lit(r)) for r, c in rules]))
