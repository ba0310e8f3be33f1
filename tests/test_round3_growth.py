"""Findings of the third round on growth: what is read, sought or compared once."""

from __future__ import annotations

from pyspark.sql import functions as F

from __spark_entry__ import queries
from lectern.functions.text import matches
from lectern.operators import corpus, detect, scores, workflow

TEXTS = [(1, "Mail Anna Berg at a.b@example.com, c@x.org\nor a.b@example.com; Berg, Anna 555-123-4567\n\nnothing here"), (2, "Anna Berg and Anna Berg, 123456789\nx@y.zz"), (3, None), (4, "")]


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def _blocks(spark):
    return detect.blocks(spark.createDataFrame(TEXTS, "doc_id long, text string"))


def test_a_pattern_is_sought_once(spark):
    rows = spark.createDataFrame([("ab xaab",), ("none",), (None,)], "text string").select("text", matches(F.col("text"), "a+b").alias("m"))
    assert _plan(rows).count("regexp_extract_all(") == 1
    assert [None if r.m is None else [tuple(x) for x in r.m] for r in rows.collect()] == [[(0, 2, "ab"), (4, 7, "aab")], [], None]


def test_numbered_detects_once(spark):
    """occurrence_contexts: both numbers come from one table of occurrences."""
    found = detect.numbered(detect.occurrences(_blocks(spark)))
    assert "regexp" not in _plan(found)
    assert sorted((r.doc_id, r.match, r.ordinal, r.placeholder) for r in found.filter("detected_type = 'person'").collect()) == [
        (1, "Berg, Anna", 1, "[PERSON 002]"), (1, "Mail Anna Berg", 1, "[PERSON 001]"), (2, "Anna Berg", 1, "[PERSON 001]"), (2, "Anna Berg", 2, "[PERSON 001]"),
    ]


def test_residual_scan_seeks_addresses_alone(spark, tmp_path):
    """residual_scan: only the detector of addresses runs, and once."""
    kinds = {r.detected_type for r in detect.occurrences(_blocks(spark), ("email",)).collect()}
    assert kinds == {"email"}
    spark.createDataFrame(TEXTS, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = queries()["residual_scan"](spark, str(tmp_path))
    assert "regexp_extract_all" not in _plan(got)
    assert sorted(map(tuple, got.collect())) == [(1, 0, "a.b@example.com", 1), (1, 0, "c@x.org", 1), (1, 1, "a.b@example.com", 1), (2, 1, "x@y.zz", 1)]


def test_person_groups_detects_people_once(spark, tmp_path):
    """person_groups: groups and members come from one table of people."""
    spark.createDataFrame([(1, "we met Anna Berg, then Anton Berg\nand Anna Lind at 555-123-4567")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = queries()["person_groups"](spark, str(tmp_path))
    assert "regexp_extract_all" not in _plan(got)
    assert sorted((r.doc_id, r.group_id, r.canonical_name, r.candidate_key) for r in got.collect()) == [
        (1, "person:berg:a", "Anton Berg", "person:anna berg"), (1, "person:berg:a", "Anton Berg", "person:anton berg"),
    ]


def test_items_come_from_one_pass(spark):
    """doc_clusters: the texts are read once for items of all kinds, which start where words do."""
    docs = spark.createDataFrame([(1, "xABC ABC _ABC ABC-12 ABC éABC; Order no. QX-77 reorder 1234 a@b.com\nGreen Bay Trust mGreen Bay"), (2, None)], "doc_id long, text string")
    got = corpus.items(docs)
    assert _plan(got).count("Generate") == 1
    assert sorted((r.kind, r.item) for r in got.collect()) == [
        ("acronym", "ABC"), ("distinctive_term", "Green Bay Trust"), ("email_domain", "b.com"), ("identifier", "ABC-12"), ("identifier", "QX-77"), ("organization", "Green Bay Trust"),
    ]


def test_shared_words_count_a_value_once(spark):
    """shared_words: candidates with one value share its words, and no distinct values are gathered in a group."""
    people = [(1, str(i), "person", v) for i, v in enumerate(["Red Bolt", "Red Bolt", "Blue Red Bolt", "Red Rod", "red"])]
    got = scores.shared_words(spark.createDataFrame(people, "doc_id long, candidate_key string, detected_type string, display_value string"))
    assert "Expand" not in _plan(got)
    assert sorted((r.candidate_key, r.word_share, r.shared_word, r.last_share, ",".join(r.rules)) for r in got.collect()) == [
        ("0", 3, "red", 2, "token_recurrence,head_noun_paradigm"), ("1", 3, "red", 2, "token_recurrence,head_noun_paradigm"),
        ("2", 3, "red", 2, "token_recurrence,head_noun_paradigm"), ("3", 3, "red", 1, "token_recurrence"),
    ]


def test_reuse_reads_its_tables_once(spark):
    """decision_reuse: the tiers share what they read; the plan doesn't go back to the candidates."""
    c = spark.createDataFrame([(1, "person:anna maria berg"), (1, "person:a. berg"), (2, "person:anna maria bergh"), (3, "person:other")], "doc_id long, candidate_key string")
    members = spark.createDataFrame([(1, "g", "person:anna maria berg"), (1, "g", "person:a. berg")], "doc_id long, group_id string, candidate_key string")
    known = spark.createDataFrame([("person:anna maria berg", "Redact", None), ("person:other", "Undecided", None)], "candidate_key string, decision string, replacement string")
    got = workflow.reuse(c, members, known)
    assert "LogicalRDD" not in _plan(got)
    assert sorted((r.doc_id, r.candidate_key, r.tier, r.decision, r.confidence) for r in got.collect()) == [
        (1, "person:a. berg", "grouped-alias", "Redact", 90), (1, "person:anna maria berg", "exact-key", "Redact", 100), (2, "person:anna maria bergh", "similarity-threshold", "Redact", 97),
    ]


def test_ambiguity_queue_gathers_counts_alone(spark, tmp_path):
    """ambiguity_queue: texts are read once, and no display values are sorted to find the least."""
    spark.createDataFrame([(1, "The cat met Anna berg. Anna Berg"), (2, "none")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = queries()["ambiguity_queue"](spark, str(tmp_path))
    assert "Union" not in _plan(got) and "min(" not in _plan(got)
    assert sorted((r.doc_id, r.candidate_key) for r in got.collect()) == [(1, f"person:{k}") for k in ("anna", "anna berg", "berg", "the", "the cat")]
