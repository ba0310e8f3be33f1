"""The command fold against a plain one, its stream against the batch, and the retry queue."""

import random
from datetime import datetime, timedelta

import pandas as pd

from lectern.operators import commands
from lectern.streaming import commands as streamed

KINDS = [*commands.SINGLE, *commands.GROUP, *commands.OPENED, commands.IMPORT, commands.BULK, commands.RESET, commands.LINK, commands.ACCEPTED, commands.DISMISS, commands.RESTORE]
CANDIDATES = {s: [f"{s}{i}" for i in range(6)] for s in "AB"}
GROUPS = {"A": {"g1": ("Ann Lee", ["A0", "A1", "A9"]), "g2": (" ", ["A2"]), "g3": ("X", [])}, "B": {"g1": ("Bo", ["B0", "B3"])}}
OPTIONS = {("A", "A0"): ["g1", "g2"], ("B", "B1"): ["g1"]}


def drawn(seed, n):
    pick, out = random.Random(seed), []
    for seq in range(n):
        s = pick.choice("AB")
        ids = [f"{s}{pick.randrange(8)}" for _ in range(pick.randrange(4))]
        proposals = [(f"{s}{pick.randrange(8)}", pick.choice(["Keep", "Rename", "Ignore"]), "N") for _ in range(pick.randrange(3))]
        kind = pick.choice(KINDS)
        decision = pick.choice(["Keep", "Rename", "Redact"] if kind == commands.MEMBER else ["Keep", "Rename", "Redact", "Ignore"])
        out.append((s, seq, kind, f"{s}{pick.randrange(8)}", pick.choice(["g1", "g1", "g2", "g3", "g4"]), decision, pick.choice([None, " ", " r "]), ids, proposals, pick.choice("xy"), pick.choice([None, ids])))
    return out


class Plain:
    """One session, command by command."""

    def __init__(self, session):
        self.s, self.decided, self.opened, self.dismissed, self.stamped, self.linked = session, {}, None, {}, {}, {}
        self.entities, self.minted, self.log = {}, 0, []  # anchor -> (number, seq, members)

    def detach(self, c):
        for anchor, (_, _, members) in list(self.entities.items()):
            if c in members:
                members.remove(c)
                if not members:
                    del self.entities[anchor]

    def decide(self, seq, c, decision, text, anchor, source="reviewer"):
        self.decided[c] = (decision, text, source, seq)
        held = self.entities.get(anchor)
        if decision != "Ignore" and held and c in held[2]:
            return
        self.detach(c)
        if decision == "Ignore":
            return
        if anchor not in self.entities:
            self.minted += 1
            self.entities[anchor] = (self.minted, seq, [])
        self.entities[anchor][2].append(c)

    def run(self, cmd):
        """Returns reason, applied, skipped."""
        _, seq, kind, c, g, decision, text, ids, proposals, proposal, resets = cmd
        known, groups = CANDIDATES[self.s], GROUPS[self.s]
        text = text.strip() if text is not None else None
        bad = lambda d: (d == "Rename" and not text) or (d == "Redact" and text == "")
        put = lambda d: text if d in ("Rename", "Redact") else None
        if kind in commands.SINGLE or kind in (commands.MEMBER, commands.LINK):
            d = commands.SINGLE.get(kind, "Keep" if kind == commands.LINK else decision)
            if kind == commands.MEMBER and (self.opened is None or self.opened != g):
                return f"no open Not Quite group matching {g}", 0, 0
            if kind == commands.MEMBER and c not in groups[g][1]:
                return f"{c} is not a member of Not Quite group {g}", 0, 0
            if c not in known:
                return f"no such candidate: {c}", 0, 0
            if kind == commands.LINK and (self.s, c) not in OPTIONS:
                return f"{c} is not a currently-proposed ambiguity", 0, 0
            if kind == commands.LINK and g not in OPTIONS[self.s, c]:
                return f"{g} is not one of {c}'s proposed entity options", 0, 0
            if kind != commands.LINK and bad(d):
                return commands.BLANK, 0, 0
            self.decide(seq, c, d, put(d) if kind != commands.LINK else None, g if kind in (commands.MEMBER, commands.LINK) else c)
            if kind == commands.LINK:
                self.linked[c] = g
            self.log.append("not-quite-member-applied" if kind == commands.MEMBER else "candidate-decided")
            if kind == commands.LINK:
                self.log.append("ambiguity-resolved")
            return None, 1, 0
        if kind == "enterNotQuite":
            if g not in groups:
                return f"no such entity group: {g}", 0, 0
            if self.opened is not None:
                return (commands.OPEN_HERE if self.opened == g else commands.OPEN_THERE), 0, 0
            self.opened = g
        elif kind in commands.OPENED:
            if self.opened is None or self.opened != g:
                return f"no open Not Quite group matching {g}", 0, 0
            if kind == "exitNotQuite":
                self.opened = None
            else:
                self.stamped[g] = "Refined"
        elif kind in commands.GROUP:
            d = commands.GROUP[kind]
            if g not in groups:
                return f"no such entity group: {g}", 0, 0
            if self.opened == g:
                return commands.OPEN_BULK, 0, 0
            name, members = groups[g]
            if kind == "flattenGroup" and not name.strip():
                return f"group {g}'s canonical name is blank; cannot flatten", 0, 0
            if kind == "redactGroup" and text == "":
                return commands.BLANK, 0, 0
            done = [m for m in members if m in known]
            for m in done:
                self.decide(seq, m, d, name.strip() if kind == "flattenGroup" else put(d), g)
            self.stamped[g] = commands.STAMPS[kind]
            self.log += ["candidate-decided"] * len(done) + ["group-decided"]
            return None, len(done), len(members) - len(done)
        elif kind == commands.IMPORT:
            done = 0
            for i, d, t in proposals:
                if i in known and i not in self.decided:
                    self.decide(seq, i, d, t, i, "imported")
                    done += 1
            self.log += ["candidate-decided"] * done + ["decisions-imported"]
            return None, done, len(proposals) - done
        elif kind == commands.BULK:
            if not ids:
                return commands.NO_BULK, 0, 0
            if bad(decision):
                return commands.BLANK, 0, 0
            done = [i for i in ids if i in known]
            if not done:
                return commands.NONE_EXIST, 0, 0
            for i in done:
                self.decide(seq, i, decision, put(decision), i)
            self.log += ["candidate-decided"] * len(done) + ["bulk-decided"]
            return None, len(done), len(ids) - len(done)
        elif kind in (commands.RESET, commands.RESTORE):
            if not ids:
                return (commands.NO_RESET if kind == commands.RESET else commands.NO_RESTORE), 0, 0
            if kind == commands.RESTORE and proposal not in self.dismissed:
                return commands.NOT_DISMISSED, 0, 0
            todo = ids if kind == commands.RESET else resets or []
            done = 0
            for i in todo:
                if i in self.decided and i in known:
                    del self.decided[i]
                    self.detach(i)
                    done += 1
            if kind == commands.RESET and not done:
                return commands.NONE_DECIDED, 0, 0
            self.dismissed.pop(proposal, None) if kind == commands.RESTORE else None
            self.log += ["candidate-reset"] * done + [commands.CLOSING[kind]]
            return None, done, len(todo) - done
        elif kind == commands.DISMISS:
            if not ids:
                return commands.NO_DISMISS, 0, 0
            self.dismissed[proposal] = seq
        self.log.append(commands.CLOSING[kind])
        return None, 0, 0


def context(spark):
    return (
        spark.createDataFrame([(s, c) for s, cs in CANDIDATES.items() for c in cs], "session_id string, candidate_id string"),
        spark.createDataFrame([(s, g, n, m) for s, gs in GROUPS.items() for g, (n, m) in gs.items()], "session_id string, group_id string, canonical_name string, members array<string>"),
        spark.createDataFrame([(s, c, g) for (s, c), g in OPTIONS.items()], "session_id string, candidate_id string, group_ids array<string>"),
    )


def test_batch_and_stream_against_a_plain_fold(spark, tmp_path):
    rows = drawn(3, 700)
    plain = {s: Plain(s) for s in "AB"}
    want = [(r[0], r[1], r[2], *plain[r[0]].run(r)) for r in rows]
    assert {(w[2], w[3] is None) for w in want} >= {(k, ok) for k in KINDS for ok in (True, False)} - {(commands.IMPORT, False), (commands.ACCEPTED, False)}  # each kind works and fails
    df = spark.createDataFrame(rows, commands.COMMANDS)
    done = commands.writes(commands.expanded(df, *context(spark))).cache()
    got = sorted((r.session_id, r.seq, r.type, r.reason, r.applied, r.skipped) for r in commands.results(done).collect())
    assert got == sorted(want)
    decided = {(s, c): v for s, p in plain.items() for c, v in p.decided.items()}
    assert {(r.session_id, r.candidate_id): (r.decision, r.replacement, r.source, r.seq) for r in commands.decisions(done).collect()} == decided
    entities = sorted((s, f"entity-{n}", a, m, seq) for s, p in plain.items() for a, (n, seq, m) in p.entities.items())
    assert sorted((r.session_id, r.entity_id, r.anchor, r.members, r.confirmed) for r in commands.entities(done).collect()) == entities
    assert {(r.session_id, r.group_id): r.decision for r in commands.group_decisions(done).collect()} == {(s, g): v for s, p in plain.items() for g, v in p.stamped.items()}
    assert {(r.session_id, r.proposal_id): r.seq for r in commands.dismissals(done).collect()} == {(s, x): v for s, p in plain.items() for x, v in p.dismissed.items()}
    assert {(r.session_id, r.candidate_id): r.group_id for r in commands.links(done).collect()} == {(s, x): v for s, p in plain.items() for x, v in p.linked.items()}
    log = commands.events(done).orderBy("session_id", "number").collect()
    assert [r.kind for r in log] == [k for s in "AB" for k in plain[s].log]

    # the same commands in seven batches
    for k in range(7):
        df.filter(f"seq >= {k * 100} AND seq < {k * 100 + 100}").coalesce(1).write.parquet(str(tmp_path / "in" / f"k={k}"))
    streamed.with_state_store(spark)
    stream = spark.readStream.schema(commands.COMMANDS).option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(str(tmp_path / "in" / "k=*"))
    run = streamed.fold(stream, *context(spark)).writeStream.option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start(str(tmp_path / "out"), "parquet", "append")
    run.awaitTermination()
    out = spark.read.parquet(str(tmp_path / "out")).toPandas()
    heads = out[out["item"].isna()]
    assert sorted((r.session_id, r.seq, r.type, r.reason, r.applied, r.skipped) for r in heads.itertuples()) == sorted(want)
    last = out[out["item"].notna()].sort_values(["seq", "item"]).groupby(["session_id", "candidate_id"]).tail(1)
    last = last[last["decision"].notna()]
    assert {(r.session_id, r.candidate_id): (r.decision, None if pd.isna(r.replacement) else r.replacement, r.source, r.seq) for r in last.itertuples()} == decided
    belongs = {(s, c): e for s, e, _, m, _ in entities for c in m}
    assert {(r.session_id, r.candidate_id): r.entity_id for r in last.itertuples() if isinstance(r.entity_id, str)} == belongs


def test_one_candidate_one_entity(spark):
    done = commands.writes(commands.expanded(spark.createDataFrame(drawn(8, 400), commands.COMMANDS), *context(spark)))
    rows = commands.entities(done).collect()
    members = [(r.session_id, m) for r in rows for m in r.members]
    assert members and len(members) == len(set(members)) and all(r.members for r in rows)
    assert len({(r.session_id, r.entity_id) for r in rows}) == len(rows) == len({(r.session_id, r.anchor) for r in rows})


def test_edges(spark):
    empty = spark.createDataFrame([], commands.COMMANDS)
    done = commands.writes(commands.expanded(empty, *context(spark)))
    assert commands.results(done).count() == commands.decisions(done).count() == commands.entities(done).count() == 0
    nulls = spark.createDataFrame([("A", 1, "keepCandidate", *[None] * 8), ("A", 2, None, *[None] * 8), ("A", 3, commands.BULK, *[None] * 8), ("A", 4, "enterNotQuite", *[None] * 8)], commands.COMMANDS)
    got = {r.seq: (r.ok, r.reason) for r in commands.results(commands.writes(commands.expanded(nulls, *context(spark)))).collect()}
    assert got == {1: (False, "no such candidate: "), 2: (True, None), 3: (False, commands.NO_BULK), 4: (False, "no such entity group: ")}


def test_stream_of_a_session_whose_commands_all_fail(spark, tmp_path):
    rows = [("A", n, "keepCandidate", "nobody", *[None] * 7) for n in range(3)]
    spark.createDataFrame(rows, commands.COMMANDS).coalesce(1).write.parquet(str(tmp_path / "in"))
    streamed.with_state_store(spark)
    stream = spark.readStream.schema(commands.COMMANDS).parquet(str(tmp_path / "in"))
    run = streamed.fold(stream, *context(spark)).writeStream.option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start(str(tmp_path / "out"), "parquet", "append")
    run.awaitTermination()
    got = spark.read.schema(streamed.OUT).parquet(str(tmp_path / "out")).collect()
    assert sorted((r.seq, r.ok, r.reason, r.applied) for r in got) == [(n, False, "no such candidate: nobody", 0) for n in range(3)]


def test_state_is_read_and_written_once_for_a_key():
    class State(dict):
        calls = 0

        def containsKey(self, key):  # noqa: N802
            return key in self

        def getValue(self, key):  # noqa: N802
            self.calls += 1
            return self[key]

        def updateValue(self, key, value):  # noqa: N802
            self.calls += 1
            self[key] = value

        def removeKey(self, key):  # noqa: N802
            self.calls += 1
            del self[key]

    state = State({("a",): ("x", 1), ("b",): ("y", 1)})
    held = streamed._Held(state)
    for n in range(9):
        held.put("a", ("x", n))
        held.put("b", None)
        held.put("c", ("z", n))
    held.put("d", ("w", 1))
    held.put("d", None)
    held.store()
    assert state == {("a",): ("x", 8), ("c",): ("z", 8)} and state.calls == 5


def test_retries_until_late_success_or_given_up(spark, tmp_path):
    t0 = datetime(2024, 1, 1)
    at = lambda minutes: t0 + timedelta(minutes=minutes)
    batches = [
        [("c", "m1", "a", False, at(0)), ("c", "m2", "b", False, at(0)), ("d", "x", "p", True, at(0))],
        [("z", "tick", "", True, at(12))],  # moves the watermark past ten minutes
        [("z", "tick", "", True, at(12))],
        [("c", "m1", "a", True, at(12)), ("c", "m2", "b", False, at(12))],  # m1 succeeds late; m2 fails again and waits twice as long
        [("z", "tick", "", True, at(40))],
        [("z", "tick", "", True, at(40))],
        [("c", "m2", "b", False, at(40))],  # the third failure is the last
        [("e", f"n{i}", "q", False, at(41)) for i in range(5)],  # more than may wait
        [("z", "tick", "", True, at(60))],
        [("z", "tick", "", True, at(61))],
    ]
    schema = "client_id string, metric_id string, payload string, delivered boolean, ts timestamp"
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in" / f"k={k}"))
    streamed.with_state_store(spark)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "k=*"))
    seen = []
    run = streamed.retried(stream, most=3, attempts=3).writeStream.foreachBatch(lambda df, n: seen.extend(tuple(r) for r in df.collect())).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    run.awaitTermination()
    got = [x for x in seen if x[0] != "z"]
    assert [x for x in got if x[0] == "d"] == [("d", "x", "p", 1, "delivered")]
    assert [x[3:] for x in got if x[1] == "m1"] == [(2, "retry"), (2, "delivered")]
    assert [x[3:] for x in got if x[1] == "m2"] == [(2, "retry"), (3, "retry"), (3, "given-up")]
    assert sorted((x[1], x[4]) for x in got if x[0] == "e") == sorted([("n0", "dropped"), ("n1", "dropped"), ("n2", "retry"), ("n3", "retry"), ("n4", "retry")])
