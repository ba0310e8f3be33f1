"""Proposals, explanations, registries, attestations, saved sessions and spans on small cases."""

import json

import pytest
from pyspark.sql import functions as F

from lectern.operators import attestation, detect, evidence, explain, proposals, registry
from lectern.sources import sessions

CANDIDATE = "doc_id long, candidate_key string, detected_type string, display_value string, n_occurrences long, confidence string, quality string, ord int, name string"


def people(spark, *values, doc=1, **each):
    rows = [(doc, f"person:{v.lower()}", "person", v, each.get(v, 1), "medium", "Possible", i, "clash") for i, v in enumerate(values)]
    return spark.createDataFrame(rows, CANDIDATE)


def options_of(spark, rows, names=(), aliases=(), excluded=None):
    n = spark.createDataFrame(list(names), "a string, b string, strength int")
    a = spark.createDataFrame(list(aliases), "a string, b string, strength int, label string")
    _, found = proposals.proposals(rows, n, a, excluded)
    return {(r.candidate_key.split(":")[1], r.place): (r.group_id, r.confidence, r.evidence) for r in found.collect()}


def test_single_names_ask_about_every_anchor_of_that_name(spark):
    got = options_of(spark, people(spark, "Zoe Adams", "Zoe Baker", "Zoe", "Anna Clark", "Bob"))
    assert got == {("zoe", 1): ("person:adams:z", 95, ['Exact first-name match ("zoe")']), ("zoe", 2): ("person:baker:z", 95, ['Exact first-name match ("zoe")'])}


def test_related_names_follow_exact_ones_and_strength_weakens(spark):
    rows = people(spark, "Andrew Cole", "Andy Price", "Andy", "Drew")
    names = [("andy", "andrew", 5), ("andrew", "andy", 2), ("drew", "andrew", 1), ("andy", "andy", 5)]
    got = options_of(spark, rows, names)
    assert got["andy", 1] == ("person:price:a", 95, ['Exact first-name match ("andy")'])
    assert got["andy", 2] == ("person:cole:a", 91, ['Related-name library: "andy" ↔ "andrew" (Strength 5 — Established)'])
    assert got["drew", 1] == ("person:cole:a", 75, ['Related-name library: "drew" ↔ "andrew" (Strength 1 — Speculative)'])
    assert len(got) == 3


def test_the_less_attested_full_name_asks(spark):
    rows = people(spark, "William Ford", "W. Ford", "Bill Ford")
    got = options_of(spark, rows, [("bill", "william", 4)])
    assert list(got) == [("bill ford", 1)] and got["bill ford", 1][0] == "person:ford:w" and got["bill ford", 1][2][0] == 'Same surname ("ford")'
    # of two single buckets with one confidence, the greater key asks
    assert list(options_of(spark, people(spark, "William Ford", "Bill Ford"), [("bill", "william", 4)])) == [("william ford", 1)]


def test_aliases_are_asked_by_the_shorter_value_and_not_inside_a_group(spark):
    rows = people(spark, "NSC", "National Student Clearinghouse", "National S. Clearinghouse", "Cal-State")
    aliases = [("nsc", "national student clearinghouse", 4, "Acronym relationship"), ("national s clearinghouse", "national student clearinghouse", 5, "Alias relationship")]
    got = options_of(spark, rows, aliases=aliases)
    assert list(got) == [("nsc", 1)]
    assert got["nsc", 1][2] == ['Acronym relationship: "NSC" ↔ "National Student Clearinghouse" (Strength 4 — Strong)']


def test_excluded_and_empty(spark):
    rows = people(spark, "Zoe Adams", "Zoe")
    assert options_of(spark, rows, excluded=spark.createDataFrame([(1, "person:zoe adams")], "doc_id long, candidate_key string")) == {}
    assert options_of(spark, rows.limit(0)) == {}
    assert options_of(spark, people(spark, "---", "12"), [("a", "b", 1)]) == {}
    groups, _ = proposals.proposals(people(spark, "Ann Lee", "A. Lee", "Lee, Ann", "Bo Li"))
    (g,) = groups.collect()
    assert (g.group_id, g.canonical_name, g.members) == ("person:lee:a", "Ann Lee", ["person:ann lee", "person:a. lee", "person:lee, ann"])


FACTS = "doc_id long, candidate_key string, detected_type string, likelihood int, recommendation string, n_occurrences long, decision string, filter_rules array<string>, reasons array<string>, summary string"
EVIDENCE = "doc_id long, candidate_key string, ord int, category string, polarity string, weight int"


def test_explanations(spark):
    facts = spark.createDataFrame([
        (1, "a", "person", 95, "ToReview", 1, None, ["x", "x"], ["y"], "z"), (1, "b", "person", 60, "ToReview", 1, "Keep", [], ["y"], "z"), (1, "c", "email", 10, "Unlikely", 1, "", None, None, "z"), (1, "d", "custom_id", 80, "ToReview", 2, None, [], [], "z"),
    ], FACTS)
    rows = spark.createDataFrame([
        (1, "a", 1, "known_first_name", "positive", 5), (1, "a", 2, "heading-context", "positive", 1), (1, "a", 3, "near", "positive", 1), (1, "a", 4, "fourth", "positive", 1), (1, "a", 5, "odd-one", "negative", -4),
        (1, "b", 1, "strong_name_structure", "positive", 9), (1, "d", 1, "seen-once", "neutral", 0), (1, "d", 2, "", "neutral", 0),
    ], EVIDENCE)
    texts = spark.createDataFrame([("known_first_name", "S", "it has a first name", "E")], "category string, short string, standard string, expert string")
    got = {r.candidate_key: r for r in explain.explanations(facts, rows, texts).collect()}
    assert got["a"].summary == "Almost certainly a person's name because it has a first name, it has heading context evidence, and it has near evidence, but it has odd one evidence."
    assert got["b"].summary == "Possibly name-shaped text because it has strong_name_structure evidence. No name evidence was found."
    assert got["c"].summary == "Unlikely to be an email address. No explanatory evidence was recorded."
    assert got["d"].summary == "Likely a custom id based on deterministic evidence: it has seen once evidence and it has evidence evidence."
    assert [(got[k].disposition, got[k].diagnostics) for k in "abc"] == [("To Review", ["x"]), ("Resolved: Keep", ["y"]), ("Unlikely", [])]
    assert [x.expert for x in got["a"].positive] == ["E", "Heading Context", "Near", "Fourth"]


def test_profiles_are_tables(spark):
    rows = spark.createDataFrame([(1, "a", ["r", "r", "s"]), (1, "b", []), (1, "c", None), (1, "d", ["t"])], "doc_id long, candidate_key string, rules array<string>")
    weights = spark.createDataFrame([("p", "r", 50), ("p", "s", -5), ("q", "t", 500)], "profile string, rule string, weight int")
    bands = spark.createDataFrame([("p", "Strong", 80), ("p", "Weak", 1), ("q", "Top", 99)], "profile string, quality string, least int")
    got = {(r.profile, r.candidate_key): (r.score, r.quality) for r in registry.profiled(rows, weights, bands).collect()}
    assert got == {("p", "a"): (80, "Strong"), ("p", "b"): (35, "Weak"), ("p", "c"): (35, "Weak"), ("p", "d"): (35, "Weak"), ("q", "a"): (35, None), ("q", "b"): (35, None), ("q", "c"): (35, None), ("q", "d"): (99, "Top")}


def test_detectors_and_providers(spark):
    scored = spark.createDataFrame([(1, "person:ann lee", "person", "Ann Lee"), (1, "person:ann lee smith", "person", "Ann Lee Smith"), (1, "person:als", "person", "ALS"), (1, "x:ab12", "id", "AB12"), (1, "x:cd34", "id", "CD34")], "doc_id long, candidate_key string, detected_type string, display_value string")
    got = {(r.detector, tuple(r.members)) for r in registry.relationships(scored).collect()}
    assert got == {("truncated-variant", ("person:ann lee", "person:ann lee smith")), ("acronym-expansion", ("person:als", "person:ann lee smith")), ("identifier-pattern", ("x:ab12", "x:cd34"))}

    @registry.detector("own")
    def own(rows):
        return rows.select("doc_id", F.lit("own").alias("kind"), F.array("candidate_key").alias("members"), F.lit("d").alias("detail"))

    try:
        assert registry.relationships(scored, ["own"]).count() == 5
    finally:
        del registry.DETECTORS["own"]
    with pytest.raises(KeyError):
        registry.relationships(scored, ["own"])
    relations = spark.createDataFrame([("lib", "name-token", "andy", "andrew", 4, "L"), ("lib", "name-token", "andrew", "andy", 5, "M"), ("lib", "name-token", "andy", "drew", 4, "L"), ("lib", "name-token", "x", "x", 1, "L")], "provider string, domain string, a string, b string, strength int, label string")
    terms = spark.createDataFrame([("andy",), ("andy",), ("x",), (None,)], "term string")
    assert [(r.related, r.strength, r.place) for r in registry.relations_of(terms, relations).orderBy("place").collect()] == [("andrew", 5, 1), ("drew", 4, 2)]
    pairs = spark.createDataFrame([("drew", "andy"), ("x", "x"), ("andrew", "drew")], "x string, y string")
    assert [(r.x, r.y, r.strength) for r in registry.strength_between(pairs, relations).collect()] == [("drew", "andy", 4)]
    packs = spark.createDataFrame([("r", "t"), ("lost", "u")], "rule string, term string")
    known, lost = registry.registered(packs, spark.createDataFrame([("r", "A rule", "negative")], "rule string, label string, polarity string"))
    assert [tuple(r) for r in known.collect()] == [("r", "t", "A rule", "negative")] and [tuple(r) for r in lost.collect()] == [("lost", "u")]


def test_attestations(spark):
    f, g = "legal-terminology", "medical-terminology"
    packs = spark.createDataFrame([
        (f, 2, "lien", "Lien", "tax", "B", None, ["h2", "h1"], None, False, None, "HIGH", None, None, None), (f, 1, "lien", "LIEN", None, "A", None, ["h1"], None, True, "x", "LOW", None, None, None), (g, 1, "lien", "lien", "sub", "C", "7", None, False, False, None, "MEDIUM", "L", "E", "n"),
    ], attestation.PACK)
    values = spark.createDataFrame([("Lien", f, "lien"), ("Lien", g, "lien"), ("Lien", g, "lien"), ("Void", f, ""), ("Void", g, "void")], "value string, family string, normalized string")
    sources = spark.createDataFrame([(f, "A", "Src", "u", "official", "PD", "d")], "family string, source_family string, source string, source_url string, authority_level string, licence string, retrieved string")
    audit = attestation.audit_rows(values, packs, sources)
    assert sorted((r.family, r.place, r.matched_term, r.licence, r.source_attested, r.hints) for r in audit.collect()) == [(f, 1, "LIEN", "PD", False, "h1"), (f, 2, "Lien", "", True, "h2|h1"), (g, 1, "lien", "", False, "")]
    view = {r.family: r for r in attestation.channels(audit).collect()}
    assert (view[f].matched_term, view[f].source_families, view[f].sub_domains, view[f].hints, view[f].highest_risk, view[f].has_source_attested) == ("LIEN", ["A", "B"], ["tax"], ["h1", "h2"], "HIGH", True)
    assert (view[g].sub_domains, view[g].highest_risk, view[g].label) == ([], "MEDIUM", "medical")
    told = {r.value: r.channels for r in attestation.attesting(values, attestation.channels(audit), placed=values.select("value")).collect()}
    assert told == {"Lien": [g, f, "gnis-place"], "Void": ["gnis-place"]}
    assert attestation.channels(attestation.audit_rows(values, packs.limit(0))).count() == 0


def session(**change):
    base = {"schemaVersion": 2, "sessionId": "s", "documentId": "d", "createdAt": "a", "updatedAt": "b", "candidateDecisions": {"c": {"decision": "Keep"}}, "groupDecisions": {}, "ambiguityResolutions": {}, "entityRegistry": {}, "activeNotQuite": None, "processingRevisions": [], "events": []}
    return json.dumps({k: v for k, v in {**base, **change}.items() if v != "GONE"})


def test_sessions_of_versions(spark):
    cases = {
        session(): None, session(schemaVersion=2.0): None, "": "not valid JSON", "{": "not valid JSON", "7": "expected a JSON object", "null": "expected a JSON object", "[]": "missing or non-numeric schemaVersion -- not a recognized ReviewSession save file",
        session(schemaVersion="2"): "missing or non-numeric schemaVersion -- not a recognized ReviewSession save file", session(schemaVersion=9): "schemaVersion 9 is newer than this build supports (2) -- refusing to guess at an unknown future format",
        session(schemaVersion=1): "unrecognized schemaVersion 1 -- no migration path implemented", session(schemaVersion=1.5): "unrecognized schemaVersion 1.5 -- no migration path implemented", session(events={}): "missing or malformed required field: events",
        session(groupDecisions=None): "missing or malformed required field: groupDecisions", session(createdAt=1): "missing or non-string required field: createdAt", session(activeNotQuite="GONE"): "missing required field: activeNotQuite",
    }
    texts = spark.createDataFrame([(k,) for k in [*cases, None]], "value string")
    good, bad = sessions.read_sessions(texts)
    assert {r.value: r.problem for r in bad.collect()} == {**{k: v for k, v in cases.items() if v}, None: "not valid JSON"}
    assert [(r.session_id, r.doc_id, r.candidate_id, r.decision, r.source) for r in sessions.session_decisions(good).collect()] == [("s", "d", "c", "Keep", "reviewer")] * 2


def test_sessions_climb_steps(spark):
    old = session(schemaVersion=1, entityRegistry="GONE")
    steps = {1: lambda text: F.concat(F.lit('{"entityRegistry":{},'), F.substring(text, F.lit(2), F.length(text)))}
    good, bad = sessions.read_sessions(spark.createDataFrame([(old,), (session(),), (session(schemaVersion=0),)], "value string"), steps)
    assert sorted((r.session_id, r.migrated) for r in good.collect()) == [("s", False), ("s", True)]
    assert [r.problem for r in bad.collect()] == ["unrecognized schemaVersion 0 -- no migration path implemented"]


def test_spans_from_snippets(spark):
    blocks = spark.createDataFrame([(1, 0, "aXaXaXa end", "c"), (1, 1, "one two", "c"), (1, 2, r"q\Eq \Q.*", "c")], "doc_id long, block_order int, text string, start string")
    rows = [(1, 0, "a[X]a", 3), (1, 0, "a[X]a", None), (1, 0, "...a[X]a...", 99), (1, 1, "[two]", 0), (1, 1, "[none]", 0), (1, 1, "no span", 0), (1, 7, "[x]", 0), (1, 2, r"q\[E]q \Q", 0), (1, 1, None, 0)]
    got = evidence.reanchored(spark.createDataFrame(rows, "doc_id long, block_order int, context string, near int"), blocks.drop("start")).collect()
    assert sorted(((r.block_order, r.context, r.near, r.start, r.end, r.n_places) for r in got), key=str) == sorted([
        (0, "a[X]a", 3, 3, 4, 3), (0, "a[X]a", None, 1, 2, 3), (0, "...a[X]a...", 99, 5, 6, 3), (1, "[two]", 0, 4, 7, 1), (1, "[none]", 0, None, None, 0), (1, "no span", 0, None, None, 0), (7, "[x]", 0, None, None, 0), (2, r"q\[E]q \Q", 0, 2, 3, 1), (1, None, 0, None, None, 0),
    ], key=str)


def test_offsets_of_all_names_are_found_again(spark, sf):
    rows = detect.blocks(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text"))
    found = detect.occurrences(rows).filter(~F.col("context").rlike(r"^[^\[]*\[[^\]]*\[")).select("doc_id", "block_order", "context", F.col("start").alias("true_start"), F.col("start").alias("near"))
    got = evidence.reanchored(found, rows)
    assert got.count() == found.count() > 0 and got.filter("NOT (start <=> true_start)").count() == 0


def test_sessions_are_parsed_once(spark):
    good, _ = sessions.read_sessions(spark.createDataFrame([(session(),), ("[]",), ("7",), ("",), (None,)], "value string"))
    plan = good._jdf.queryExecution().optimizedPlan().toString().lower()
    assert 1 <= plan.count("parsejson") <= 2  # of the text, and of what a step makes of an older one
    assert good.count() == 1
