"""Matches and rewriting at length, components and cliques of any size, wording, packs and normal forms."""

import random
import time
import zipfile

import pytest
from pyspark.sql import functions as F

from lectern.functions import forms, text, wording
from lectern.operators import figures, links, normalize, redact, relate, types
from lectern.sources import packs


def test_many_matches(spark):
    value = " ".join(f"a{i % 97}é" for i in range(20_000))
    rows = spark.createDataFrame([(value,), ("",), ("none",), (None,)], "t string")
    at = time.time()
    got = [r.m for r in rows.select(text.matches(F.col("t"), "a[0-9]+").alias("m")).collect()]
    assert time.time() - at < 30
    assert [(m.start, m.end) for m in got[0]] == [(x, x + len(f"a{i % 97}")) for i, x in enumerate(starts(value))]
    assert got[1:] == [[], [], None]


def starts(value):
    at = 0
    for word in value.split(" "):
        yield at
        at += len(word) + 1


def test_redaction_of_many_spans(spark):
    rows = spark.createDataFrame([(1, 0, "x" * 9000), (1, 1, "free")], "doc_id long, block_order int, text string")
    spans = [(1, 0, i * 3, i * 3 + 2, "[P]") for i in range(3000)] + [(1, 0, 1, 4, "[overlaps]")]
    got = {r.block_order: r.text for r in redact.redacted(rows, spark.createDataFrame(spans, "doc_id long, block_order int, start int, end int, placeholder string")).collect()}
    assert got == {0: "[P]x" * 3000, 1: "free"}


def test_long_chain(spark):
    pairs = spark.range(5000).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    got = links.components(pairs).agg(F.count("*"), F.max("component")).first()
    assert tuple(got) == (5001, 0)


def test_cliques_of_a_large_component(spark):
    # a chain of 300 documents, in whose middle five are all related to each other
    rows = [(i, i + 1, 0.5) for i in range(300)] + [(a, b, 0.9) for a in range(150, 155) for b in range(a + 1, 155) if b > a + 1]
    pairs = spark.createDataFrame(rows, "a long, b long, score double")
    got = relate.cliques(pairs, relate.labels(pairs)).collect()
    assert sorted(r.doc_id for r in got if r.cluster == 150) == [150, 151, 152, 153, 154]
    assert len({r.doc_id for r in got}) == len(got)


def test_cliques_raise_beyond_the_bound(spark, monkeypatch):
    monkeypatch.setattr(relate, "MOST_STEPS", 5)
    near = {i: {j for j in range(6) if j != i} for i in range(6)}
    with pytest.raises(RuntimeError, match="component 7"):
        list(relate._maximal(near, 7))


def test_maximal_cliques_against_brute_force():
    from itertools import combinations

    rng = random.Random(1)
    for _ in range(30):
        n = rng.randint(2, 9)
        edges = {(a, b) for a, b in combinations(range(n), 2) if rng.random() < 0.5}
        near = {i: {j for j in range(n) if (min(i, j), max(i, j)) in edges} for i in range(n)}
        near = {k: v for k, v in near.items() if v}
        full = [set(c) for k in range(2, n + 1) for c in combinations(range(n), k) if all(p in edges for p in combinations(c, 2))]
        best = sorted(sorted(c) for c in full if not any(c < d for d in full))
        assert sorted(relate._maximal(near, 0)) == best


def test_retained_words(spark):
    rows = spark.createDataFrame([("Good Morning Andrew,",), ("Dear Ann Lee",), ("Good Morning",), ("Dear Dear",), ("Goodloe, Andrew",), ("Ann Thanks",), ("...",), ("",)], "display_value string")
    got = [r.retained for r in normalize.with_retained(rows, "display_value", ("dear",), ("thanks",), (("good", "morning"),)).collect()]
    assert got == ["Andrew", "Ann Lee", "Good Morning", "Dear Dear", "Goodloe, Andrew", "Ann", None, None]


def test_merges_are_not_passed_on(spark):
    people = [(1, f"person:{v.lower()}", "person", v, True) for v in ("Dear Dear Ann", "Dear Ann", "Ann", "Dear Bob")]
    rows = spark.createDataFrame(people, "doc_id long, candidate_key string, detected_type string, display_value string, named boolean")
    got = {(r.candidate_key, r.target_key) for r in normalize.merges(rows, F.col("named"), ("dear",), ()).collect()}
    assert got == {("person:dear dear ann", "person:ann"), ("person:dear ann", "person:ann")}


def test_wording(spark):
    row = spark.range(1).select(
        wording.joined(F.array(F.lit("a"), F.lit("b"))).alias("two"), wording.percent_shown(F.lit(99.96), 1).alias("near"), wording.percent_shown(F.lit(None).cast("double")).alias("none"),
        wording.hidden_inside(F.lit("a­b")).alias("hidden"), wording.with_replacements(F.lit("Ann and ann lee, Hannah"), F.array(
            F.struct(F.lit("ann").alias("original"), F.lit("$1").alias("replacement")), F.struct(F.lit("ann lee").alias("original"), F.lit("X").alias("replacement")),
        )).alias("put"), wording.title_case(F.lit("known_first-name")).alias("title"), wording.rule(F.lit("person"), F.lit(None), F.lit(None), F.lit("P")).alias("rule"),
        wording.read_ref(F.lit("hyperlink word/rels rId7")).alias("ref"), wording.blank_image(F.unhex(F.lit("89504E470D0A1A0A0000000D494844520000000100000001"))).alias("blank"),
        F.array_join(forms.verb_forms(F.lit("carry")), ",").alias("verb"), forms.entry(F.lit(" ﬁne ‘x’ ")).alias("entry"), F.array_join(forms.name_tokens(F.lit("O’Neil, J. Ünal-Roy")), "|").alias("tokens"),
    ).first()
    assert (row.two, row.near, row.none, row.hidden, row.put, row.title) == ("a and b", "~100.0%", "0%", True, "$1 and X, Hannah", "Known First Name")
    assert tuple(row.rule) == ("sequential", "[REDACTED NAME]", "P_{n}") and (row.ref.kind, row.ref.relation) == ("hyperlink", "rId7") and row.blank
    assert (row.verb, row.entry, row.tokens) == ("carry,carries,carried,carrying", "fine 'x'", "O’Neil|J|Ünal-Roy")


def test_packs_from_files(spark, tmp_path):
    (tmp_path / "p.csv").write_text("term,family\nalpha,x\n,y\nbeta,z,extra\n")
    good, bad = packs.read_delimited(spark, str(tmp_path / "p.csv"), ["term"])
    assert [tuple(r) for r in good.collect()] == [("alpha", "x")] and sorted(r.problem for r in bad.collect()) == ["empty: term", "number of fields"]
    with pytest.raises(ValueError, match="no column state"):
        packs.read_delimited(spark, str(tmp_path / "p.csv"), ["state"])
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("n.txt", b"\xef\xbb\xbfNAME|ID\r\nRose|1\r\n\r\nHope|2\r\n")
    got = packs.read_archived(spark, str(tmp_path / "a.zip"), renames={"NAME": "name"}).collect()
    assert [(r.number, r.fields["name"], r.fields["ID"]) for r in got] == [(1, "Rose", "1"), (3, "Hope", "2")]
    packs.write_flags(spark.createDataFrame([("b", 2), ("a", 1)], "key string, flags int"), str(tmp_path / "flags"))
    assert [r.value for r in spark.read.text(str(tmp_path / "flags")).orderBy("value").collect()] == ["a\t1", "b\t2"]


def test_gate_and_recent(spark):
    facts = spark.createDataFrame([("person", 1, False, False, False, ["common-english-word"]), ("person", 1, False, False, True, ["common-english-word"])],
                                  "detected_type string, n_tokens int, decided boolean, settled boolean, contextual boolean, categories array<string>")
    assert [r.why_review for r in types.gated(facts, ("common-english-word",)).collect()] == [None, "used as a person"]
    rows = spark.createDataFrame([(1, None, 5, None), (2, None, 6, 1), (3, 9, 7, None)], "session_id int, owner int, updated_at int, archived_at int")
    assert [r.session_id for r in figures.recent_of(rows, None, 10).collect()] == [1] and [r.session_id for r in figures.recent_of(rows, None, 10, True).collect()] == [2, 1]
