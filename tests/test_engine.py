"""The library's own operators, without the corpus subpackage."""

import io
import zipfile

import pytest
from pyspark.sql import functions as F

from lectern.functions.text import matches, shape, snippet
from lectern.operators import corpus, detect, quality, redact, review
from lectern.sources import docx
from lectern.streaming import activity

TEXTS = [
    (1, "Call (555) 987-6543 or mail Ana.Guzman@Example.org now.\nAna Guzmán met Dr Smith.\nSmith, John wrote."),
    (2, "Student 123456789 and id 1234567890123.\nThe upload id=18900663687e4c1a99 failed."),
    (3, None), (4, ""),
]


@pytest.fixture(scope="module")
def found(spark):
    rows = detect.blocks(spark.createDataFrame(TEXTS, "doc_id long, text string"))
    return rows, detect.occurrences(rows)


def test_offsets_reproduce_the_text(spark):
    df = spark.createDataFrame([("a1 😀 b22 c",)], "t string").select("t", F.explode(matches(F.col("t"), r"\d+")).alias("m"))
    rows = df.select("m.text", F.substring("t", F.col("m.start") + 1, F.col("m.end") - F.col("m.start")).alias("cut")).collect()
    assert [(r.text, r.cut) for r in rows] == [("1", "1"), ("22", "22")]


def test_detection(found):
    keys = {(r.doc_id, r.candidate_key) for r in detect.candidates(found[1]).collect()}
    assert (1, "email:ana.guzman@example.org") in keys and (1, "phone:5559876543") in keys
    assert (1, "person:ana guzmán") in keys and (1, "person:smith, john") in keys
    assert (2, "cin:123456789") in keys and (2, "long_numeric_id:1234567890123") in keys
    assert not any("18900663687" in k for _, k in keys)


def test_counts_agree(found):
    occurrences = found[1].count()
    assert occurrences == sum(r.n_occurrences for r in detect.candidates(found[1]).collect())
    assert all(r.ordinal == 1 for r in detect.numbered(found[1]).collect())


def test_redaction_leaves_nothing(found):
    rows, occ = found
    named = detect.numbered(occ)
    done = redact.redacted(rows, named)
    assert redact.residue(done, named).count() == 0
    text = {(r.doc_id, r.block_order): r.text for r in done.collect()}
    assert text[1, 0] == "Call [PHONE 001] or mail [EMAIL 001] now."
    assert done.count() == rows.count()


def test_scores(spark):
    df = spark.createDataFrame([(["surname_given_structure", "single_occurrence"],), (["ocr_artifact"],), ([],), (["x"],)], "rules array<string>")
    got = [tuple(r) for r in df.select(quality.total(F.col("rules")).alias("s")).select("s", quality.label(F.col("s"))).collect()]
    assert got == [(81, "Strong"), (1, "Unlikely"), (35, "Possible"), (35, "Possible")]
    assert len(quality.WEIGHTS) >= 50


def test_snippet_and_shape(spark):
    df = spark.createDataFrame([("x" * 80 + "HIT" + "y" * 5,)], "t string")
    got = df.select(snippet(F.col("t"), F.lit(80), F.lit(83)), shape(F.lit("AB-12c"))).first()
    assert got[0] == "..." + "x" * 70 + "[HIT]" + "y" * 5 and got[1] == "AA-##A"


def test_structure_and_terms(spark):
    docs = spark.createDataFrame([(1, "alpha beta alpha\n\nthis word NASA NASA " + "x" * 300)], "doc_id long, text string")
    assert corpus.structure(docs).first().signature == "p0-l2"
    assert [r.term for r in corpus.top_terms(docs, 2).collect()] == ["alpha", "nasa"]
    assert [(r.acronym, r.n) for r in corpus.acronyms(docs).collect()] == [("NASA", 2)]


def test_sessions_and_runs(spark):
    rows = spark.createDataFrame([(i, f"2024-01-0{d} 00:00:0{i}", 1, t) for i, (d, t) in enumerate([(1, "a"), (1, "a"), (2, "b"), (2, "a")])], "event_id long, ts string, user_id long, event_type string")
    rows = rows.withColumn("ts", F.col("ts").cast("timestamp"))
    assert sorted(r.n_events for r in review.sessions(rows).collect()) == [2, 2]
    assert sorted((r.event_type, r.n) for r in review.runs(rows).collect()) == [("a", 1), ("a", 2), ("b", 1)]


def test_stream_equals_batch(spark, sf, tmp_path):
    raw = spark.read.parquet(f"{sf}/events.parquet")
    raw.orderBy("ts").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = activity.tumbling(activity.read_events(spark, str(tmp_path / "in"), raw.schema))
    q = stream.writeStream.outputMode("complete").format("memory").queryName("tumbled").trigger(availableNow=True).start()
    q.awaitTermination()
    got = {(r.w, r.event_type): r.n for r in spark.sql("select window.start as w, event_type, n from tumbled").collect()}
    want = raw.withColumn("ts", F.col("ts").cast("timestamp")).groupBy(F.window("ts", "1 day").alias("w"), "event_type").count()
    assert got == {(r.s, r.event_type): r["count"] for r in want.select(F.col("w.start").alias("s"), "event_type", "count").collect()}


def test_usage_merge_ignores_order(spark):
    schema = "session_id long, started long, updated long, n_events long, status string"
    old = spark.createDataFrame([(1, 5, 9, 3, "completed"), (2, 1, 2, 1, "started")], schema)
    new = spark.createDataFrame([(1, 4, 8, 2, "started"), (3, 7, 7, 1, "started")], schema)
    want = [(1, 4, 9, 3, "completed"), (2, 1, 2, 1, "started"), (3, 7, 7, 1, "started")]
    assert sorted(tuple(r) for r in activity.merge_usage(old, new).collect()) == want
    assert sorted(tuple(r) for r in activity.merge_usage(new, old).collect()) == want


def test_docx_blocks(spark, tmp_path):
    ns = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    body = f"<w:document {ns}><w:body><w:p><w:r><w:t>Jo</w:t></w:r><w:r><w:t>hn &amp; co</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>cell</w:t></w:r><w:del><w:r><w:delText>gone</w:delText></w:r></w:del></w:p></w:tc></w:tr></w:tbl></w:body></w:document>"
    rels = '<Relationships><Relationship Id="r1" Type="http://x/hyperlink" Target="mailto:a@b.org?x=1&amp;y" TargetMode="External"/><Relationship Id="r2" Type="http://x/hyperlink" Target="#in"/></Relationships>'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", body)
        z.writestr("word/header1.xml", f"<w:hdr {ns}><w:p><w:r><w:t>head</w:t></w:r></w:p></w:hdr>")
        z.writestr("word/_rels/document.xml.rels", rels)
    (tmp_path / "a.docx").write_bytes(out.getvalue())
    (tmp_path / "b.docx").write_bytes(b"plain text")
    got = {(r.kind, r.text) for r in docx.read_blocks(spark, str(tmp_path), "*.docx").collect()}
    assert got == {("body", "John & co"), ("body", "cell"), ("tracked-deletion", "gone"), ("header", "head"), ("hyperlink", "mailto:a@b.org?x=1&y"), ("body", "plain text")}


def test_every_oracle_has_a_query():
    import __spark_entry__

    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_entry_imports_without_a_session():
    import subprocess
    import sys
    from pathlib import Path

    code = "import __spark_entry__ as e; assert e.queries() and e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=Path(__file__).resolve().parents[1], check=True, timeout=120)


def test_person_groups_and_cliques(spark):
    from lectern.operators import relate, resolve

    rows = [("person", "low", "Smith, John", 2, "Strong"), ("person", "low", "John Smith", 1, "Strong"), ("person", "low", "J. Smith", 1, "Possible"), ("person", "low", "Ann Lee", 1, "Strong")]
    people = spark.createDataFrame([(1, f"person:{v.lower()}", *r[:2], v, n, r[4]) for r in rows for v, n in [(r[2], r[3])]], "doc_id long, candidate_key string, detected_type string, confidence string, display_value string, n_occurrences long, quality string")
    got = resolve.person_groups(people).collect()
    assert {r.candidate_key for r in got} == {"person:smith, john", "person:john smith", "person:j. smith"}
    assert {r.group_id for r in got} == {"person:smith:j"} and {r.canonical_name for r in got} == {"John Smith"}
    pairs = spark.createDataFrame([(1, 2, 0.5), (2, 3, 0.6), (1, 3, 0.5), (3, 4, 0.9), (7, 8, 0.46)], "a long, b long, score double")
    clusters = {(r.cluster, r.doc_id) for r in relate.cliques(pairs, relate.labels(pairs)).collect()}
    assert clusters == {(1, 1), (1, 2), (1, 3), (7, 7), (7, 8)}


def test_relations_between_values(spark):
    from lectern.operators import resolve

    schema = "doc_id long, candidate_key string, detected_type string, confidence string, display_value string, n_occurrences long, quality string"
    rows = [(1, f"{t}:{v.lower()}", t, "low", v, 1, "Strong") for t, v in [
        ("person", "Ana Maria Lopez"), ("person", "Ana Maria"), ("person", "Degree Verify Unit"), ("cin", "AB-1234"), ("cin", "CD-9876"), ("phone", "555-1234"),
    ]]
    scored = spark.createDataFrame(rows, schema)
    singles = spark.createDataFrame([(1, "ana", 3), (2, "ana", 2), (1, "bob", 2)], "doc_id long, name string, n long")
    assert {(r.name, r.full_name) for r in resolve.ambiguous_short_names(singles, scored).collect()} == {("ana", "Ana Maria Lopez"), ("ana", "Ana Maria")}
    acronyms = spark.createDataFrame([(1, "DVU", 2), (1, "XX", 2)], "doc_id long, acronym string, n long")
    assert [(r.acronym, r.value) for r in resolve.acronym_expansions(acronyms, scored).collect()] == [("DVU", "Degree Verify Unit")]
    assert [(r.signature, r.n, r.kind) for r in resolve.identifier_patterns(scored).collect()] == [("AA-####", 2, "alphanumeric-identifier")]
    assert [(r.key, r.long_key) for r in resolve.truncated_variants(scored).collect()] == [("person:ana maria", "person:ana maria lopez")]


def test_labels_that_do_not_settle_raise(spark):
    from lectern.operators import relate

    pairs = spark.createDataFrame([(i, i + 1) for i in range(1, 40)], "a long, b long")
    with pytest.raises(RuntimeError, match="did not settle"):
        relate.labels(pairs, rounds=2)
