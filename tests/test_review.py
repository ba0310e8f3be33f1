"""Review workflow, accounts, evidence, reports and rewriting of documents."""

import io
import random
import zipfile
from datetime import datetime
from difflib import SequenceMatcher

from pyspark.sql import functions as F

from lectern.operators import accounts, evidence, workflow
from lectern.sources import docx, reports, rewrite

NOW = datetime(2024, 1, 15, 12)


def rows(df, *columns):
    return sorted(tuple(r) for r in (df.select(*columns) if columns else df).collect())


def _words(seed, n, longest):
    r = random.Random(seed)
    return sorted({"".join(r.choice("abcdef") for _ in range(r.randint(1, longest))) for _ in range(n)})


def _changed(words, seed):
    r, out = random.Random(seed), set()
    for w in words:
        for _ in range(2):
            at = r.randrange(len(w) + 1)
            out.add(w[:at] + r.choice(["", "a", "x"]) + w[at + r.randint(0, 1):])
    return sorted(out - set(words) - {""})


def test_similar_keys_match_brute_force(spark):
    known = _words(1, 60, 22)
    asked = _changed(known, 2)
    want = set()
    for a in asked:
        best = sorted((-SequenceMatcher(None, a, k).ratio(), k) for k in known)[:2]
        if -best[0][0] >= 0.9 and best[1][0] - best[0][0] >= 0.05:
            want.add(("p:" + a, "p:" + best[0][1]))
    a = spark.createDataFrame([("p:" + x,) for x in asked], "candidate_key string")
    k = spark.createDataFrame([("p:" + x, "Redact", "") for x in known], "candidate_key string, decision string, replacement string")
    assert want and set(rows(workflow.similar_keys(a, k), "candidate_key", "source_key")) == want


def test_near_forms_match_brute_force(spark):
    known = [w for w in _words(3, 80, 16) if len(w) >= 7]
    asked = [w for w in _changed(known, 4) if len(w) >= 8]
    inside = lambda a, b: a.startswith(b) or b.startswith(a) or a.endswith(b) or b.endswith(a)
    want = {(a, b) for a in asked for b in known if abs(len(a) - len(b)) <= 1 and (a[:2] == b[:2] or a[-2:] == b[-2:]) and not inside(a, b) and SequenceMatcher(None, a, b).ratio() >= 0.9}
    got = evidence.near_forms(*[spark.createDataFrame([(w,) for w in x], "word string") for x in (asked, known)])
    assert want and rows(got, "word", "form") == sorted(want)


def test_near_forms_meet_by_what_is_left_of_them(spark):
    pick = random.Random(11)
    known = sorted({"st" + "".join(pick.choices("aeinrst", k=8)) + "en" for _ in range(600)})
    asked = sorted({w[:5] + pick.choice("xyz") + w[5 + pick.randrange(2) :] for w in pick.sample(known, 60)} | {"q" * 9, "st" + "er" * 7, "st" + "er" * 6 + "n"})
    words = spark.createDataFrame([(w,) for w in asked], "word string")
    forms = spark.createDataFrame([(w,) for w in known], "form string")
    left = words.select("word", F.explode(evidence._near_keys(F.col("word"), "a", "b", (-1, 0, 1))).alias("key"))
    right = forms.select("form", F.explode(evidence._near_keys(F.col("form"), "b", "a", (0,))).alias("key"))
    met = {tuple(r) for r in left.join(right, "key").select("word", "form").distinct().collect()}
    inside = lambda a, b: a.startswith(b) or b.startswith(a) or a.endswith(b) or b.endswith(a)
    near = {(a, b) for a in asked for b in known if abs(len(a) - len(b)) <= 1 and not inside(a, b) and SequenceMatcher(None, a, b).ratio() >= 0.9}
    # all words begin and end alike and are as long: by that alone, all pairs would meet
    assert near and near <= met and len(met) < 5 * len(asked)


def test_reuse_tiers(spark):
    c = spark.createDataFrame([(1, "p:ann lee"), (1, "p:a. lee"), (1, "p:jonathan smithe"), (1, "p:zed"), (2, "p:x one"), (2, "p:x two"), (2, "p:x three")], "doc_id long, candidate_key string")
    m = spark.createDataFrame([(1, "g", "p:ann lee"), (1, "g", "p:a. lee"), (2, "h", "p:x one"), (2, "h", "p:x two"), (2, "h", "p:x three")], "doc_id long, group_id string, candidate_key string")
    k = spark.createDataFrame([("p:ann lee", "Redact", None), ("p:jonathan smith", "Rename", "J"), ("p:zed", "Undecided", None), ("p:x one", "Keep", None), ("p:x two", "Redact", None)], "candidate_key string, decision string, replacement string")
    got = {r.candidate_key: (r.tier, r.decision, r.source_key) for r in workflow.reuse(c, m, k).collect()}
    assert got == {
        "p:ann lee": ("exact-key", "Redact", "p:ann lee"), "p:a. lee": ("grouped-alias", "Redact", "p:ann lee"), "p:x one": ("exact-key", "Keep", "p:x one"),
        "p:x two": ("exact-key", "Redact", "p:x two"), "p:jonathan smithe": ("similarity-threshold", "Rename", "p:jonathan smith"),
    }


def test_gestures_match_a_walk_through_the_log(spark):
    r = random.Random(5)
    log = [(s, i, r.choice(["decided", "batched", "batched", "anchor"]), r.randrange(12)) for s in range(6) for i in range(40)]
    resolved = {(s, c) for s in range(6) for c in range(12) if r.random() < 0.6}
    want = {}
    for s in range(6):
        credited, made, waiting = set(), 0, []
        for _, _, kind, c in [x for x in log if x[0] == s] + [(s, 99, "anchor", None)]:
            batch = [c] if kind == "decided" else waiting if kind == "anchor" else []
            waiting = waiting + [c] if kind == "batched" else [] if kind == "anchor" else waiting
            new = {x for x in batch if (s, x) in resolved} - credited
            made, credited = made + bool(new), credited | new
        want[s] = made
    e = spark.createDataFrame(log, "session_id long, seq long, kind string, candidate_key long")
    got = workflow.gestures(e, spark.createDataFrame(sorted(resolved), "session_id long, candidate_key long"))
    assert dict(rows(got)) == want


def test_zones(spark):
    cells = spark.createDataFrame([(1, i, i in (0, 1, 3)) for i in range(6)], "g long, seq long, resolved boolean")
    order = lambda kind, n, c=2: [(r.seq, r.active) for r in workflow.zone(cells, "g", kind, n, c).orderBy("place").collect()]
    assert order("compacting", 2) == [(0, True), (1, True), (2, True), (3, True), (4, True), (5, False)]
    assert order("conveyor", 3) == [(2, True), (3, True), (4, True), (5, False), (0, False), (1, False)]
    assert order("rolling", 2) == [(2, True), (4, True), (5, False), (0, False), (1, False), (3, False)]


def test_decisions_of_groups(spark):
    d = spark.createDataFrame([("a", "Keep"), ("a", "Redact"), ("a", None), ("b", None), ("c", "Ignore"), ("c", "Ignore")], "g string, decision string")
    assert rows(workflow.dominant(d, "g")) == [("a", "Redact", ["Keep"]), ("b", None, []), ("c", "Ignore", [])]
    assert rows(workflow.group_state(d, "g"), "g", "state") == [("a", "needs-attention"), ("b", "undecided"), ("c", "uniform")]
    t = spark.createDataFrame([(10, 30.0), (100, 120.0), (0, 5.0), (5, None)], "n long, s double").select("n", workflow.time_saved(F.col("n"), F.col("s")).alias("t")).select("n", "t.value", "t.unit")
    assert {r[0]: r[1:] for r in t.collect()} == {0: (None, None), 5: (None, None), 10: (5.0, "minutes"), 100: (3.3, "hours")}


def test_search_and_presets(spark):
    schema = "doc_id long, candidate_key string, display_value string, detected_type string, n_occurrences long, likelihood int, decision string, replacement string, ambiguous boolean, categories array<string>, necessity string"
    f = spark.createDataFrame([(1, "a", "Ann", "person", 2, 95, None, None, True, ["institution-term"], None), (1, "b", "Bob", "person", 1, None, "Ignore", "X", None, None, "unlikely"), (1, "c", "c@d.e", "email", 1, 99, "Redact", None, False, [], None)], schema)
    keys = lambda *a: [r[0] for r in rows(workflow.shown(f, *a), "candidate_key")]
    assert keys() == ["a", "c"] and keys("", ["unlikely"]) == ["b"] and keys("AMBIGUITY") == ["a"]
    assert keys("", ["high-confidence", "people"]) == ["a"] and keys("", ["organizations"]) == ["a"] and keys("", ["redacted"]) == ["c"]
    assert [r[0] for r in f.orderBy(*workflow.order("confidence-asc")).select("candidate_key").collect()] == ["b", "a", "c"]


def test_coverage(spark):
    o = spark.createDataFrame([(1, "a", 1), (1, "a", 2), (1, "b", 3), (1, "c", 4)], "doc_id long, candidate_key string, occurrence_id long")
    d = spark.createDataFrame([(1, "a", 1)], "doc_id long, candidate_key string, occurrence_id long")
    m, g = spark.createDataFrame([(1, "g", "b")], "doc_id long, group_id string, candidate_key string"), spark.createDataFrame([(1, "g")], "doc_id long, group_id string")
    assert rows(workflow.coverage(o, d, m, g), "candidate_key", "status") == [("a", "partial"), ("b", "resolved"), ("c", "unresolved")]


def test_membership_rules(spark):
    m = spark.createDataFrame([(1, 1, "owner", 5), (1, 2, "member", 6), (2, 1, "owner", 4), (2, 2, "owner", 4)], "organization_id long, user_id long, role string, created_at long")
    c = spark.createDataFrame([(1, 1, 1, None), (2, 1, 1, "owner"), (3, 1, 2, "admin"), (4, 2, 1, "member"), (5, 9, 1, None)], "change_id long, organization_id long, user_id long, next_role string")
    assert [r[0] for r in rows(accounts.without_owner(m, c), "change_id")] == [1, 5]
    assert rows(accounts.first_membership(m)) == [(1, 2, "owner"), (2, 2, "owner")]
    p = spark.createDataFrame([(1, "A@x.org "), (3, "c@x.org")], "user_id long, email string")
    i = spark.createDataFrame([(1, 1, "a@X.org", "pending", "2025-01-01"), (2, 1, "b@x.org", "pending", "2024-01-01"), (3, 1, "d@x.org", "pending", "2025-01-01"), (4, 1, "D@x.org", "pending", "2025-01-01"), (5, 1, "d@x.org", "revoked", "2025-01-01")], "invitation_id long, organization_id long, email string, status string, expires_at string")
    states = accounts.invitation_states(i.withColumn("expires_at", F.col("expires_at").cast("timestamp")), m, p, NOW)
    assert rows(states, "invitation_id", "state") == [(1, "accepted"), (2, "expired"), (3, "pending"), (4, "duplicate"), (5, "revoked")]
    assert rows(accounts.lacking(p, m, spark.createDataFrame([(1,)], "organization_id long")), "user_id") == [(3,)]


def test_usage_of_nothing(spark):
    schema = "id long, user_id long, organization_id long, status string, page_count long, decisions_made long, decisions_avoided long, started_at timestamp, completed_at timestamp, updated_at timestamp"
    none = spark.createDataFrame([], schema)
    one = accounts.summary(none, NOW).first()
    assert (one.started, one.active_users, one.completion_rate, one.mean_seconds) == (0, 0, None, None)
    assert accounts.as_json(none, "id").first()[0] == "[]"
    bad = spark.createDataFrame([(1, 1, 1, "completed", -1, 0, 0, NOW, None, NOW), (2, 1, 1, None, None, 0, 0, NOW, None, NOW)], schema)
    assert rows(accounts.broken(bad, NOW)) == [(1, "page_count is negative"), (1, "status and completion differ")]


def test_kinds_and_cuts(spark):
    c = ["[x]", "(l) [x] nbsp.", "see [x]", "[a] b [x]", "... [x]...", "### [x]"]
    got = spark.createDataFrame([(x,) for x in c], "c string").select("c", evidence.occurrence_kind(F.col("c"))).collect()
    assert [tuple(r)[1] for r in got] == ["standalone", "standalone", "contextual", "contextual", "standalone", "standalone"]
    cuts = [("Ann Smithson", 9, "Ann Smith"), ("Ann s", 5, "Ann s"), ("Al Bo Cy Di Ed", 11, "Al Bo Cy Di"), ("Ann Lee left", 7, "Ann Lee")]
    report = evidence.cut_report(spark.createDataFrame(cuts, "text string, end int, match string"))
    assert rows(report) == sorted((o, 1) for o in evidence.ORIGINS)


def test_lexicons_and_relations(spark):
    packs = spark.createDataFrame([("law", "brief", 1), ("law", "brief", 2), ("tax", "brief", 3), ("tax", "tax return", 1)], "family string, phrase string, risk int")
    v = spark.createDataFrame([("Tax  Return",), ("A Brief",), (None,), ("",)], "value string")
    assert rows(evidence.attested(v, packs)) == [("A Brief", "law", "word", 2), ("A Brief", "tax", "word", 1), ("Tax  Return", "tax", "phrase", 1)]
    assert rows(evidence.overlaps(packs)) == [("law", "law", 1), ("law", "tax", 1), ("tax", "tax", 2)]
    rel = spark.createDataFrame([("bill", "william", 2), ("william", "bill", 3)], "a string, b string, strength int")
    anchors = spark.createDataFrame([(1, "william", "William Orr"), (2, "william", "William Poe")], "doc_id long, first string, full_name string")
    shorts = spark.createDataFrame([(1, "bill"), (1, "ann")], "doc_id long, name string")
    assert rows(evidence.related_anchors(shorts, anchors, rel)) == [(1, "bill", "William Orr", 3)]


def test_reports(spark, tmp_path):
    c = spark.createDataFrame([(1, "a", "person"), (1, "b", "email")], "doc_id long, candidate_key string, detected_type string")
    o = spark.createDataFrame([(1, "a", 7, 0), (1, "a", 8, 1)], "doc_id long, candidate_key string, occurrence_id long, block_order int")
    d = spark.createDataFrame([(1, "a", "Rename", 'say "x", y')], "doc_id long, candidate_key string, decision string, replacement string")
    audit = reports.audit_rows(c, o, d)
    assert rows(audit, "candidate_key", "decision", "occurrence_id") == [("a", "Rename", "7"), ("a", "Rename", "8"), ("b", "Undecided", "")]
    reports.write_audit(audit, str(tmp_path / "audit"))
    back = spark.read.option("header", True).option("escape", '"').csv(str(tmp_path / "audit"))
    assert [r[0] for r in rows(back.filter("candidate_key = 'a'"), "replacement")] == ['say "x", y'] * 2
    saved = reports.decision_records(d).select("json").unionByName(spark.createDataFrame([("nonsense",), ('{"version": 9, "doc_id": 1}',), ('{"version": 1}',)], "json string"))
    good, bad = reports.read_decisions(saved)
    assert rows(good) == [(1, "a", "Rename", 'say "x", y')] and rows(bad, "problem") == [("incomplete",), ("not a record",), ("unknown version",)]
    old, new = (spark.createDataFrame(x, "k string, v string, at long") for x in ([("a", "old", 5), ("b", "old", 5)], [("a", "tie", 5), ("b", "new", 6), ("c", "new", 1)]))
    assert rows(reports.put(old, new, "k")) == [("a", "old", 5), ("b", "new", 6), ("c", "new", 1)]
    s = spark.createDataFrame([("o", i, i) for i in range(13)] + [("p", 50, None)], "owner string, session_id long, saved_at long")
    assert [r[0] for r in rows(reports.recent(s), "session_id")] == [*range(3, 13), 50]
    assert reports.metrics(spark.createDataFrame([], "confidence string, decision string")).first().total == 0


def _docx(body):
    ns = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f"<w:document {ns}><w:body>{body}</w:body></w:document>")
        z.writestr("word/_rels/document.xml.rels", '<Relationships><Relationship Id="r1" Type="http://x/hyperlink" Target="mailto:ann@x.org" TargetMode="External"/></Relationships>')
        z.writestr("word/media/a.bin", b"\x00\x01")
    return out.getvalue()


def test_rewritten_documents(spark):
    raw = _docx("<w:p><w:r><w:t>Hi A</w:t></w:r><w:r><w:t/></w:r><w:r><w:t>nn L</w:t></w:r><w:r><w:t>ee &amp; Ann</w:t></w:r><w:del><w:r><w:delText>Ann</w:delText></w:r></w:del></w:p><w:p><w:r><w:t>é Ann</w:t></w:r></w:p>")
    f = spark.createDataFrame([("p1", "d1", bytearray(raw)), ("p2", "d2", bytearray(b"mail ann@x.org")), ("p3", "d3", bytearray(raw))], "path string, doc_id string, content binary")
    r = spark.createDataFrame([("d1", "Ann Lee", "<P 1>"), ("d1", "Ann", "Anna"), ("d1", "ann@x.org", "[E]"), ("d1", "Bob", "B"), ("d2", "ann@x.org", "")], "doc_id string, search string, replace string")
    got = {x.doc_id: x for x in rewrite.rewrite_documents(f, r).collect()}
    texts = list(docx.blocks_of(bytes(got["d1"].content)))
    assert texts == [("body", "Hi <P 1> & Anna"), ("tracked-deletion", "Anna"), ("body", "é Anna"), ("hyperlink", "mailto:[E]")]
    assert (got["d1"].n_applied, got["d1"].not_found, got["d1"].remaining) == (5, ["Bob"], [])
    assert bytes(got["d2"].content) == b"mail " and got["d2"].n_applied == 1
    assert list(docx.blocks_of(bytes(got["d3"].content))) == list(docx.blocks_of(raw)) and got["d3"].n_applied == 0
    with zipfile.ZipFile(io.BytesIO(bytes(got["d1"].content))) as z:
        assert z.read("word/media/a.bin") == b"\x00\x01"


def test_scores_and_groupings(spark):
    from lectern.operators import scores

    c = spark.createDataFrame([(1, str(i), "person", v) for i, v in enumerate(["Red Fox", "Red Hen", "Red Cat", "Old Cat", "Solo"])] + [(2, "9", "person", "Red Fox")], "doc_id long, candidate_key string, detected_type string, display_value string")
    assert rows(scores.shared_words(c), "candidate_key", "shared_word", "rules") == [
        ("0", "red", ["token_recurrence"]), ("1", "red", ["token_recurrence"]), ("2", "red", ["token_recurrence", "head_noun_paradigm"]), ("3", "cat", ["head_noun_paradigm"]),
    ]
    f = spark.createDataFrame([(1, 1, None, 1, 4, 1, True, 1, None), (2, None, None, None, None, None, None, 9, 9)], "doc_id long, warnings int, unsupported int, images int, items int, resolved int, passed boolean, output_warnings int, output_blockers int")
    assert rows(scores.document_scores(f)) == [(1, 92.0, 25.0, 46.4), (2, 100.0, 100.0, 85.0)]
    k = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3), ("c", 4)], "cluster string, doc_id long")
    p = spark.createDataFrame([(1, 3, 0.5), (3, 2, 0.6), (1, 4, 0.9), (2, 4, 0.1)], "a long, b long, score double")
    assert rows(scores.mergeable(k, p, spark.createDataFrame([("a", "b"), ("c", "a"), ("a", "z")], "a string, b string"), 0.45)) == [("a", "b", True), ("a", "z", False), ("c", "a", False)]
    s = spark.createDataFrame([(1, [[1], [2, 3]]), (2, [[1], [2]]), (3, [[1, 2, 3], []]), (4, [[1, 1], [2, 3]])], "i int, p array<array<int>>")
    assert rows(s.select("i", scores.valid_split(F.col("p"), F.array(F.lit(3), F.lit(2), F.lit(1))))) == [(1, True), (2, False), (3, False), (4, False)]


def test_streams_of_decisions(spark, tmp_path):
    from lectern.streaming import decisions

    log = [("s", 1, "redact", "a"), ("s", 2, "import-keep", "a"), ("s", 3, "import-keep", "b"), ("s", 4, "reset", "b"), ("s", 5, "reset", "b"), ("t", 6, "keep", "a"), ("t", 7, "keep", "a")]
    schema = "session_id string, seq long, kind string, candidate_key string"
    for i, part in enumerate((log[:3], log[3:])):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in" / f"p={i}"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    got = {}
    sink = lambda batch, _: got.update({r.session_id: tuple(r)[1:] for r in batch.collect()})
    decisions.fold(stream).writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "c")).foreachBatch(sink).trigger(availableNow=True).start().awaitTermination()
    assert got == {"s": (1, 3, 2), "t": (1, 1, 1)}
    e = spark.createDataFrame([("k", "Keep", 5, 1), ("k", "Redact", 6, 3), ("k", "Ignore", 6, 2)], "candidate_key string, decision string, ts long, event_id long")
    assert rows(decisions.latest(e), "candidate_key", "decision") == [("k", "Ignore")]
