"""Session figures, registered SQL functions and collated orders on small cases."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F
from test_commands import context

from lectern.functions import forms, sql
from lectern.operators import commands, resolve, tracker


def command(session, seq, kind, candidate=None, group=None, decision=None, ids=None, proposals=None):
    return (session, seq, kind, candidate, group, decision, None, ids, proposals, None, None)


def test_figures_and_payloads(spark):
    rows = [
        command("A", 1, "keepCandidate", "A2"), command("A", 2, "keepCandidate", "A2"), command("A", 3, commands.BULK, decision="Ignore", ids=["A3", "A4", "A9"]), command("A", 4, "confirmGroup", group="g1"),
        command("A", 5, commands.IMPORT, proposals=[("A5", "Redact", None), ("A2", "Redact", None)]), command("A", 6, "keepCandidate", "A3"), command("A", 7, commands.RESET, ids=["A4"]), command("B", 1, "keepCandidate", "none"),
    ]
    done = commands.writes(commands.expanded(spark.createDataFrame(rows, commands.COMMANDS), *context(spark)))
    resolved = commands.decisions(done).select("session_id", "candidate_id")
    occurrences = spark.createDataFrame([("A", f"A{i}", 10) for i in range(6)] + [("B", "B0", 3)], "session_id string, candidate_id string, n long")
    start = datetime(2026, 1, 1)
    times = spark.createDataFrame([("A", i, start + timedelta(seconds=30 * i)) for i in range(1, 8)], "session_id string, seq long, ts timestamp")
    found = tracker.figures(done, occurrences, resolved, times)
    got = {r.session_id: r for r in found.collect()}
    # A2; the bulk (for A3); the group (A0, A1); the import (A5): the second keep of A2 and the keep of A3 settle nothing new
    assert (got["A"].made, got["A"].covered, got["A"].avoided, got["A"].percent) == (4, 50, 46, 92.0)
    assert (got["A"].pace, got["B"].made, got["B"].covered, got["B"].percent, got["B"].saved) == (None, 0, 0, 0.0, None)  # two pauses are no pace
    sizes = spark.createDataFrame([("A", 6, 60), ("C", 1, 1)], "session_id string, items long, occurrences long")
    (p,) = tracker.payloads(done, sizes, found).collect()
    assert (p.keep_count, p.redact_count, p.ignore_count, p.change_count, p.decisions_made, p.decisions_avoided, p.completion_status) == (4, 1, 0, 0, 4, 46, "incomplete")
    assert tracker.figures(done.limit(0), occurrences, resolved.limit(0), times).count() == 0


def test_time_needs_three_pauses(spark):
    rows = [command("A", i, "keepCandidate", f"A{i}") for i in range(4)]
    done = commands.writes(commands.expanded(spark.createDataFrame(rows, commands.COMMANDS), *context(spark)))
    occurrences = spark.createDataFrame([("A", f"A{i}", 100) for i in range(4)], "session_id string, candidate_id string, n long")
    start = datetime(2026, 1, 1)
    times = spark.createDataFrame([("A", i, start + timedelta(seconds=s)) for i, s in enumerate((0, 10, 30, 60))], "session_id string, seq long, ts timestamp")
    (r,) = tracker.figures(done, occurrences, commands.decisions(done).select("session_id", "candidate_id"), times).collect()
    assert (r.made, r.avoided, r.pace, r.saved, r.unit) == (4, 396, 20.0, 2.2, "hours")


def test_sql_functions(spark):
    sql.register(spark, tables=False)
    sql.register(spark, tables=False)  # again: in place of the earlier ones
    row = spark.sql("SELECT guarded_percent(1, 3) a, guarded_percent(1, 0) b, guarded_percent(1, NULL) c, in_range(TIMESTAMP '2024-01-01', NULL, TIMESTAMP '2024-01-01') d, in_range(TIMESTAMP '2024-01-01', TIMESTAMP '2024-01-01', NULL) e, squeezed(' a \t b ') f").first()
    assert tuple(row) == (33.3, None, None, False, True, "a b")
    names = spark.createDataFrame([("Lee,  Ann",), ("Ann Lee",), (" , Ann",), ("Lee,",), ("a, b, c",), ("",), (None,)], "v string")
    for r in names.select("v", F.expr("name_order(v)").alias("got"), resolve.display_name(F.col("v")).alias("want")).collect():
        assert r.got == r.want, r.v
    spark.createDataFrame([(1, "purchase", 1.0, datetime(2024, 1, 1)), (1, "view", 1.0, datetime(2024, 1, 2)), (2, "view", 1.0, datetime(2024, 1, 3))], "user_id long, event_type string, value double, ts timestamp").createOrReplaceTempView(sql.VIEWS)
    sql.register(spark)
    assert [tuple(r) for r in spark.sql("SELECT * FROM usage_summary(NULL, TIMESTAMP '2024-01-03')").collect()] == [(1, 2, 1, 50.0, 2)]
    assert spark.sql("SELECT * FROM usage_of_users(TIMESTAMP '2025-01-01', NULL)").count() == 0


def test_collated_order_differs_from_binary(spark):
    df = spark.createDataFrame([(x,) for x in ["Zoe", "anna", "Émile", "eve", "Eve", "Zoë"]], "name string")
    assert [r.name for r in df.orderBy(*forms.collated("name")).collect()] == ["anna", "Émile", "eve", "Eve", "Zoe", "Zoë"]
    assert [r.name for r in df.orderBy("name").collect()] == ["Eve", "Zoe", "Zoë", "anna", "eve", "Émile"]


def test_single_names_join_the_stream(spark):
    from lectern.operators import detect

    texts = ["Jordan came. We saw Jordan\nand Mary Jones met Jordan, who left.\nJones, Jordan", "Alice " + "x " * 3 + "alone", "Monday was fine. Monday again", "Kim   \t  Lee and Kim", ("word " * 400 + "Robin went. ") * 3, None, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = detect.blocks(docs)
    found = detect.single_occurrences(rows)
    got = {(r.doc_id, r.candidate_key): r.n for r in found.groupBy("doc_id", "candidate_key").agg(F.count("*").alias("n")).collect()}
    counted = {(r.doc_id, f"person:{r.name}"): r.n for r in detect.single_names(rows).collect()}
    assert got == counted == {(0, "person:jordan"): 3, (4, "person:robin"): 3}
    for r in found.collect():
        block = texts[r.doc_id].split("\n")[r.block_order]
        assert block[r.start : r.end] == r.match
    merged = {(r.doc_id, r.candidate_key): (r.detected_type, r.confidence, r.n_occurrences) for r in detect.candidates(detect.all_occurrences(rows)).collect()}
    assert merged[0, "person:jordan"] == ("person", "low", 3) and merged[0, "person:mary jones"][2] == 1


def test_audit_report(spark):
    import json

    from lectern.sources import reports

    frame = spark.createDataFrame
    sessions = frame([("s", "d", "f.docx", "a", "b"), ("t", "e", None, None, None), ("u", "x", "g", "a", "b")], "session_id string, doc_id string, file_name string, created_at string, updated_at string")
    found = frame([("s", "c1", "person", "Ann", 2), ("s", "c2", "person", 'B "o"', 1), ("s", "c3", "email", None, 1)], "session_id string, candidate_id string, detected_type string, display_value string, n_occurrences int")
    decisions = frame([("s", "c1", "Rename", "[X]", "reviewer"), ("s", "gone", "Keep", None, "reviewer")], "session_id string, candidate_id string, decision string, replacement string, source string")
    groups = frame([("s", "g", "Bo", ["c2", "c9"]), ("s", "h", "Li", ["c3"])], "session_id string, group_id string, canonical_name string, members array<string>")
    stamps, links = frame([("s", "g", "Confirmed")], "session_id string, group_id string, decision string"), frame([("s", "c2", "g")], "session_id string, candidate_id string, group_id string")
    checks = frame([("s", "d", True, 0), ("u", "other", True, 0)], "session_id string, doc_id string, passed boolean, problems int")
    got = {r.session_id: r for r in reports.audit_report(sessions, found, decisions, groups, stamps, links, checks).collect()}
    s, t, u = got["s"], got["t"], got["u"]
    assert (s.total, s.rename, s.keep, s.undecided, s.unresolved, s.groups_decided, s.ready, s.outstanding) == (3, 1, 0, 2, 1, 1, True, True)
    assert (t.total, t.unresolved, t.passed, t.ready, t.outstanding, t.mismatched) == (0, 0, None, False, True, False) and (u.mismatched, u.ready) == (True, False)
    told = json.loads(s.report)
    assert [(c["candidate_id"], c["display_value"], c["status"]) for c in told["candidates"]] == [("c1", "Ann", "resolved"), ("c2", 'B "o"', "resolved"), ("c3", None, "unresolved")]
    assert [g["decision"] for g in told["groups"]] == ["Confirmed", "Undecided"] and told["links"] == [{"candidate_id": "c2", "group_id": "g"}] and told["version"] == 1
    assert json.loads(t.report)["candidates"] == [] and json.loads(t.report)["file_name"] is None


def test_collated_words_are_shuffled_once(spark, sf):
    from lectern.plans import tracker as plans

    plan = plans.collated_words(spark, sf)._jdf.queryExecution().sparkPlan().toString()
    executed = plans.collated_words(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "Window" in plan and executed.count("Exchange hashpartitioning") == 1
