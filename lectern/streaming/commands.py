"""The command fold on streams, by keyed state, and a bounded queue of submissions that are tried again."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from lectern.operators import commands

#: A row with ``item`` null is the result of a command, any other one an applied write: decision and entity are null after a reset.
OUT = (
    "session_id string, seq long, item int, type string, ok boolean, reason string, applied long, skipped long, "
    "candidate_id string, decision string, replacement string, source string, entity_id string"
)
_COLUMNS = [x.split()[0] for x in OUT.split(", ")]
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _plain(rows: list, columns: list[str]) -> pd.DataFrame:
    """Rows as objects: a column that is null throughout would be of floats, whose strings Arrow returns in chunks, which Spark can't take."""
    return pd.DataFrame(rows, columns=columns, dtype=object)


def with_state_store(spark: SparkSession) -> None:
    """Keyed state with timers, lists and maps needs the RocksDB state store."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


class _Held:
    """A map of the state, of which the keys of one call are read once, and those that changed are written once: each access costs a round trip."""

    def __init__(self, state) -> None:
        self.state, self.was, self.now = state, {}, {}

    def get(self, key: str) -> tuple | None:
        if key not in self.now:
            had = self.state.getValue((key,)) if self.state.containsKey((key,)) else None
            self.was[key] = self.now[key] = tuple(had) if had is not None else None
        return self.now[key]

    def put(self, key: str, value: tuple | None) -> None:
        """A null value removes the key."""
        self.get(key)
        self.now[key] = value

    def store(self) -> None:
        for key, value in self.now.items():
            if value == self.was[key]:
                continue
            if value is None:
                self.state.removeKey((key,))
            else:
                self.state.updateValue((key,), value)
        self.was, self.now = {}, {}


class CommandFold(StatefulProcessor):
    """A session's decisions, entities, open group and dismissals as maps and values; writes come as ``commands.expanded`` makes them."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.decided = _Held(handle.getMapState("decided", "candidate_id string", "decision string, anchor string"))
        self.anchors = _Held(handle.getMapState("anchors", "anchor string", "number long, members long"))
        self.dismissed = _Held(handle.getMapState("dismissed", "proposal_id string", "seq long"))
        self.opened = handle.getValueState("opened", "group_id string")
        self.minted = handle.getValueState("minted", "number long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        got = pd.concat(rows).sort_values(["seq", "item"], na_position="first").astype(object)
        got = got.where(got.notna(), None)
        had = (self.opened.get()[0] if self.opened.exists() else None, self.minted.get()[0] if self.minted.exists() else 0)
        self.open, self.number = had
        out: list[dict] = []
        for seq, part in groupby(got.to_dict("records"), key=lambda w: w["seq"]):
            part = list(part)
            first = part[0]
            why = first["fault"] or self._stopped(first) or first["late"]
            todo = [w for w in part if w["item"] is not None] if why is None else []
            done = [w for w in todo if w["known"] and self._written(w)]
            if why is None:
                why = self._after(first, len(done))
            out += [{**w, "source": "imported" if w["write"] == "import" else "reviewer", "entity_id": self._entity(w)} for w in done if w["write"] != "reset"]
            out += [{**w, "decision": None, "replacement": None} for w in done if w["write"] == "reset"]
            out.append({"session_id": key[0], "seq": seq, "type": first["type"], "ok": why is None, "reason": why, "applied": len(done), "skipped": len(todo) - len(done) if why is None else 0})
        for state in (self.decided, self.anchors, self.dismissed):
            state.store()
        if self.open is None and had[0] is not None:
            self.opened.clear()
        elif self.open != had[0]:
            self.opened.update((self.open,))
        if self.number != had[1]:
            self.minted.update((self.number,))
        yield _plain(out, _COLUMNS).astype({"item": "Int64", "applied": "Int64", "skipped": "Int64", "ok": "boolean"})

    def _stopped(self, c: dict) -> str | None:
        if c["type"] == commands.RESTORE:
            return None if self.dismissed.get(c["proposal_id"]) else commands.NOT_DISMISSED
        return commands.stopped(c["type"], c["group_id"], self.open)

    def _after(self, c: dict, applied: int) -> str | None:
        """State that a command changes beside its writes, or why it did nothing."""
        kind = c["type"]
        if kind == "enterNotQuite":
            self.open = c["group_id"]
        elif kind == "exitNotQuite":
            self.open = None
        elif kind == commands.DISMISS:
            self.dismissed.put(c["proposal_id"], (int(c["seq"]),))
        elif kind == commands.RESTORE:
            self.dismissed.put(c["proposal_id"], None)
        nothing = {commands.BULK: commands.NONE_EXIST, commands.RESET: commands.NONE_DECIDED}
        return None if applied else nothing.get(kind)

    def _written(self, w: dict) -> bool:
        """Applies a write, unless it is an import over a decision or a reset without one."""
        had = self.decided.get(w["candidate_id"])
        if (w["write"] == "import" and had) or (w["write"] == "reset" and not had):
            return False
        old = had[1] if had and had[0] != "Ignore" else None
        new = w["anchor"] if w["write"] != "reset" and w["decision"] != "Ignore" else None
        if old != new:
            self._left(old)
            self._joined(new)
        self.decided.put(w["candidate_id"], None if w["write"] == "reset" else (w["decision"], w["anchor"]))
        return True

    def _left(self, anchor: str | None) -> None:
        if anchor is None:
            return
        number, members = self.anchors.get(anchor)
        self.anchors.put(anchor, (number, members - 1) if members > 1 else None)

    def _joined(self, anchor: str | None) -> None:
        if anchor is None:
            return
        held = self.anchors.get(anchor)
        if held is None:
            self.number += 1
            held = (self.number, 0)
        self.anchors.put(anchor, (held[0], held[1] + 1))

    def _entity(self, w: dict) -> str | None:
        return f"entity-{self.anchors.get(w['anchor'])[0]}" if w["decision"] != "Ignore" else None

    def close(self) -> None:
        pass


def fold(stream: DataFrame, candidates: DataFrame, groups: DataFrame, options: DataFrame) -> DataFrame:
    """Results and applied writes of a stream of ``commands.COMMANDS``; contexts are tables. Append mode.

    Commands of one micro-batch are carried out in order of seq, and after those of earlier batches.
    """
    rows = commands.expanded(stream, candidates, groups, options)
    return rows.groupBy("session_id").transformWithStateInPandas(CommandFold(), OUT, "append", "None")


PENDING = "metric_id string, payload string, attempts int, due long"
TRIES = "client_id string, metric_id string, payload string, attempt int, state string"


class Retries(StatefulProcessor):
    """A client's submissions that failed, the latest of each metric, at most ``most``; each comes due again until ``attempts`` are spent."""

    def __init__(self, most: int, attempts: int, wait: int) -> None:
        self.most, self.attempts, self.wait = most, attempts, wait

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pending = handle.getListState("pending", PENDING)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        queue, out = self._queue(), []
        for at, metric, payload, delivered in pd.concat(rows).sort_values(["at", "metric_id"])[["at", "metric_id", "payload", "delivered"]].itertuples(index=False):
            tried = next((x[2] for x in queue if x[0] == metric), 0) + 1
            queue = [x for x in queue if x[0] != metric]
            if delivered:
                out.append((metric, payload, tried, "delivered"))
            elif tried >= self.attempts:
                out.append((metric, payload, tried, "given-up"))
            else:
                queue.append((metric, payload, tried, int(at) + self.wait * 2 ** (tried - 1)))
            out += [(x[0], x[1], x[2], "dropped") for x in queue[: -self.most]]
            queue = queue[-self.most :]
        self._store(queue)
        yield self._rows(key, out)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        """What has come due is sent out to be tried again; it stays pending until its outcome arrives."""
        now = expiredTimerInfo.getExpiryTimeInMs()
        yield self._rows(key, [(m, p, n + 1, "retry") for m, p, n, due in self._queue() if due == now])

    def _queue(self) -> list[tuple]:
        return [tuple(x) for x in self.pending.get()] if self.pending.exists() else []

    def _store(self, queue: list[tuple]) -> None:
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        for due in {x[3] for x in queue}:
            self.handle.registerTimer(due)
        if queue:
            self.pending.put(queue)
        else:
            self.pending.clear()

    def _rows(self, key: tuple, rows: list[tuple]) -> pd.DataFrame:
        return _plain([(key[0], *x) for x in rows], [x.split()[0] for x in TRIES.split(", ")])

    def close(self) -> None:
        pass


def retried(outcomes: DataFrame, most: int = 25, attempts: int = 4, wait: str = "10 minutes", late: str = "1 minute") -> DataFrame:
    """What becomes of submissions ``(client_id, metric_id, payload, delivered, ts)``: delivered, retry, given-up or dropped. Append mode.

    A failed one waits, each time twice as long, and goes out as a retry row
    when the watermark passes; whoever sends it again reports the outcome on
    the same stream.  A newer failure of a metric takes the place of the older
    one, and of more than ``most`` pending ones the oldest are dropped.  Times
    are kept to the millisecond.
    """
    rows = outcomes.withColumn("at", F.unix_millis("ts")).withWatermark("ts", late)
    return rows.groupBy("client_id").transformWithStateInPandas(Retries(most, attempts, int(pd.Timedelta(wait).total_seconds() * 1000)), TRIES, "append", "EventTime")
