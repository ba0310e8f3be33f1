"""Findings of the third round on commands: what sessions hold, and what commands write, is derived once."""

from __future__ import annotations

from test_commands import context

from __spark_entry__ import queries
from lectern.operators import commands, workflow


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def command(session, seq, kind, candidate=None, group=None, decision=None, ids=None, replacement=None):
    return (session, seq, kind, candidate, group, decision, replacement, ids, None, None, None)


def test_writes_read_their_rows_once(spark):
    """audit_reports, usage_payloads, decision_tracker: the open group, dismissals and decisions come from one table of writes."""
    rows = [
        command("A", 1, "enterNotQuite", group="g1"), command("A", 2, "confirmGroup", group="g1"), command("A", 3, commands.LINK, "none", "g1"), command("A", 4, commands.MEMBER, "A5", "g1", "Keep"),
        command("A", 5, commands.BULK, decision="Rename", ids=["A1"], replacement="   "), command("A", 6, commands.RESET, ids=["A1"]), command("A", 7, "keepCandidate", "A1"),
    ]
    rows = commands.expanded(spark.createDataFrame(rows, commands.COMMANDS), *context(spark))
    done = commands.writes(rows)
    assert "LogicalRDD" not in _plan(done)
    got = {r.seq: r.reason for r in commands.results(done).collect()}
    assert got == {
        1: None, 2: commands.OPEN_BULK, 3: "no such candidate: none", 4: "A5 is not a member of Not Quite group g1", 5: commands.BLANK, 6: commands.NONE_DECIDED, 7: None,
    }


def test_audit_reports_reads_a_report_once(spark, sf):
    got = queries()["audit_reports"](spark, sf)
    plan = _plan(got)
    assert "get_json_object" not in plan and plan.count("from_json(") + plan.count("JsonToStructs") <= 2
    assert got.filter("n_groups > 0 AND first_candidate IS NULL").count() == 0


def test_usage_payloads_shares_what_it_counts(spark, sf):
    """usage_payloads: lines of orders and current decisions are derived once, not for each figure."""
    got = queries()["usage_payloads"](spark, sf)
    assert "l_orderkey" not in _plan(got) and "max_by" not in _plan(got)
    assert got.count() > 0


def test_decision_tracker_shares_decisions(spark, sf):
    """decision_tracker: current decisions are derived once; of results only those of batches are asked for, once."""
    plan = _plan(queries()["decision_tracker"](spark, sf))
    assert "max_by" not in plan and plan.count("first(type") + plan.count("first(why") <= 2


def test_settling_has_no_row_for_nothing(spark):
    events = spark.createDataFrame([("A", 1, "decided", "a"), ("B", 1, "decided", "b")], "session_id string, seq long, kind string, candidate_key string")
    resolved = spark.createDataFrame([("A", "a")], "session_id string, candidate_key string")
    assert [tuple(r) for r in workflow.settling(events, resolved).collect()] == [("A", 1)]
    assert sorted(map(tuple, workflow.gestures(events, resolved).collect())) == [("A", 1), ("B", 0)]
