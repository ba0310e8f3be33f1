"""The trie of conversation prefixes, by an LCP-aware external mergesort.

A turn becomes a digest of 16 bytes and a conversation the string of its
turns' digests, so that any order of digests sorts equal prefixes together.
Spark spills, deals and bounds the sort: tasks sort their strings into runs in
which each row carries its LCP (the number of turns shared with the row before
it), the runs are dealt out by ranges of strings, and each range is merged by a
loser tree that compares LCPs first and looks only at turns beyond them.  The
merged stream keeps a stack of the open path; what a string doesn't share with
the one before it is finished and leaves the stack as a node.

Nodes on the first and last path of a range may go on in its neighbours.  They
leave as partial sums, and one more pass over these paths (two for each range)
puts them together with the same stack.

Conversations longer than SEGMENT turns are cut into segments, each named by
what comes before it.  The segments of one depth are strings of their own,
built from the deepest to the first, and a segment's end takes on what hangs
below it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.llm.common import joined_by_weight, written

#: Bytes of a turn's digest.
TOKEN = 16
#: Turns of a segment; a row holds one (some 6 MB at most).
SEGMENT = 1 << 16
#: First turns that come from another conversation are fewer than this.
HEADS = 6
#: That conversation is the one whose id is rounded to this.
FAMILY = 100

NODE = "part int, side int, depth int, token binary, cp long, n long, low long, children long, leaves long, saved long, ends string, key string, parent string"
NOTHING = hashlib.sha256(b"").hexdigest()


def shared(a: bytes, b: bytes, start: int = 0) -> int:
    """The number of turns that two strings share, known to be ``start`` at least."""
    n, i, step = min(len(a), len(b)) // TOKEN, start, 1
    while i < n:
        j = min(n, i + step)
        if a[TOKEN * i : TOKEN * j] == b[TOKEN * i : TOKEN * j]:
            i, step = j, 2 * step
        elif step == 1:
            break
        else:
            step //= 2
    return i


def sorted_run(strings: list[bytes]) -> tuple[list[int], list[int]]:
    """The order of the strings, and for each place the LCP with the place before it."""
    order = sorted(range(len(strings)), key=strings.__getitem__)
    return order, [0, *(shared(strings[i], strings[j]) for i, j in zip(order, order[1:], strict=False))][: len(order)]


def merged(runs: list[tuple[list[bytes], list[int]]]) -> Iterator[tuple[int, int, int]]:
    """Merges sorted runs ``(strings, lcps)``: yields run, place in it, and the LCP with the string yielded before."""
    size = 1
    while size < len(runs):
        size *= 2
    at = [0] * size
    known = [0] * size  # turns that a run's current string shares with the winner that it lost to
    losers = [0] * size

    def ended(r: int) -> bool:
        return r >= len(runs) or at[r] >= len(runs[r][0])

    def played(a: int, b: int) -> tuple[int, int]:
        """Winner and loser; both LCPs are with the same earlier string."""
        if ended(a) or ended(b):
            return (b, a) if ended(a) else (a, b)
        if known[a] != known[b]:  # the one that shares more of a lesser string is less
            return (a, b) if known[a] > known[b] else (b, a)
        x, y = runs[a][0][at[a]], runs[b][0][at[b]]
        n = shared(x, y, known[a])
        won, lost = (a, b) if x[TOKEN * n : TOKEN * n + TOKEN] <= y[TOKEN * n : TOKEN * n + TOKEN] else (b, a)
        known[lost] = n
        return won, lost

    def first(node: int) -> int:
        if node >= size:
            return node - size
        won, losers[node] = played(first(2 * node), first(2 * node + 1))
        return won

    won = first(1)
    while not ended(won):
        yield won, at[won], known[won]
        at[won] += 1
        if not ended(won):
            known[won] = runs[won][1][at[won]]
        node = (won + size) // 2
        while node:
            won, losers[node] = played(won, losers[node])
            node //= 2


class Node:
    """An open node: what its members and finished children add up to so far."""

    __slots__ = ("token", "cp", "n", "low", "children", "leaves", "saved", "ends", "key", "digest", "edge")

    def __init__(self, token: bytes = b"", cp: int = 0, edge: bool = False) -> None:
        self.token, self.cp, self.edge = token, cp, edge
        self.n = self.children = self.leaves = self.saved = 0
        self.low = self.ends = self.key = self.digest = None

    def add(self, n: int = 0, low: int | None = None, children: int = 0, leaves: int = 0, saved: int = 0, ends: str | None = None) -> None:
        self.n, self.children, self.leaves, self.saved = self.n + n, self.children + children, self.leaves + leaves, self.saved + saved
        self.low = low if self.low is None else self.low if low is None else min(low, self.low)
        self.ends = self.ends or ends


class OpenPath:
    """The stack of nodes on the path of the latest string.  ``named``: whether the first token of strings is their prefix's name."""

    def __init__(self, named: bool, finished: Callable[[Node, int, str | None], None]) -> None:
        self.named, self.finished, self.nodes = named, finished, []

    def push(self, node: Node) -> None:
        depth = len(self.nodes)
        if self.named and depth < 2:
            node.key, node.digest = node.token.hex(), hashlib.md5(usedforsecurity=False)
        else:
            node.digest = self.nodes[-1].digest.copy() if self.nodes else hashlib.md5(usedforsecurity=False)
            node.digest.update(node.token)
            prefix = self.nodes[1].key if self.named else ""
            node.key = hashlib.md5((prefix + node.digest.hexdigest()).encode(), usedforsecurity=False).hexdigest()
        self.nodes.append(node)

    def pop(self) -> Node:
        """Takes the deepest node off; one that isn't on an edge is finished and adds to its parent."""
        node, depth = self.nodes.pop(), len(self.nodes)
        if not node.edge:
            node.leaves = node.leaves or 1
            node.saved += (node.n - 1) * node.cp
            self.finished(node, depth, self.nodes[-1].key if self.nodes else None)
            if self.nodes:
                self.nodes[-1].add(node.n, node.low, 1, node.leaves, node.saved)
        return node

    def row(self, node: Node, depth: int, parent: str | None, part: int | None = None, side: int | None = None) -> tuple:
        return (part, side, depth, node.token, node.cp, node.n, node.low, node.children, node.leaves, node.saved, node.ends, node.key, parent)


COLUMNS = [x.split()[0] for x in NODE.split(", ")]
_ROWS = 10_000


def _frame(rows: list[tuple]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=COLUMNS)
    return out.astype({c: "Int64" for c in ("part", "side", "low")})


def _nodes_of_range(named: bool):
    """Merges the runs of one range of strings into nodes, and the partial nodes of its first and last path."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = pd.concat([b for b in batches if len(b)] or [pd.DataFrame({"run": []})], ignore_index=True)
        if not len(rows):
            return
        rows = rows.sort_values(["run", "place"], ignore_index=True)
        strings, lcps, columns = rows["s"].tolist(), rows["lcp"].tolist(), ["n", "low", "ends", "children", "leaves", "saved"]
        values, cps = list(zip(*[rows[c].tolist() for c in columns], strict=True)), rows["cps"].tolist()
        begins = [*rows.index[rows["run"].ne(rows["run"].shift())], len(rows)]
        runs = [(strings[lo:hi], [0, *lcps[lo + 1 : hi]]) for lo, hi in zip(begins, begins[1:], strict=False)]
        out: list[tuple] = []
        path = OpenPath(named, lambda node, depth, parent: out.append(path.row(node, depth, parent)))
        part, left = TaskContext.get().partitionId(), {}
        for r, place, lcp in merged(runs):
            i = begins[r] + place
            edge = not path.nodes
            if edge:
                first = strings[i], cps[i]
                path.push(Node(edge=True))
            while len(path.nodes) - 1 > lcp:
                node = path.pop()
                if node.edge:
                    left[len(path.nodes)] = node
            s, cp = strings[i], [0, *cps[i]] if named else cps[i]
            for d in range(len(path.nodes) - 1, len(s) // TOKEN):
                path.push(Node(s[TOKEN * d : TOKEN * d + TOKEN], int(cp[d]), edge))
            n, low, ends, children, leaves, saved = values[i]
            path.nodes[-1].add(n, low, children, leaves, saved, ends)
            if len(out) >= _ROWS:
                yield _frame(out)
                out.clear()
        # what both paths have in common is still on the stack: its sums go with the last one
        tokens, cp = first[0], [0, *first[1]] if named else first[1]
        for depth in range(len(tokens) // TOKEN + 1):
            token = tokens[TOKEN * (depth - 1) : TOKEN * depth] if depth else b""
            node = left.get(depth) or Node(token, int(cp[depth - 1]) if depth else 0)
            out.append(path.row(node, depth, None, part, 0))
        out += [path.row(node, depth, None, part, 1) for depth, node in enumerate(path.nodes)]
        yield _frame(out)

    return run


def _joined_edges(named: bool):
    """Puts the partial nodes of all ranges' first and last paths together, in their order."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out: list[tuple] = []
        path = OpenPath(named, lambda node, depth, parent: out.append(path.row(node, depth, parent)))
        for b in batches:
            for row in b.itertuples(index=False):
                if row.depth < len(path.nodes) and path.nodes[row.depth].token != row.token:
                    while len(path.nodes) > row.depth:
                        path.pop()
                if row.depth == len(path.nodes):
                    path.push(Node(row.token, row.cp))
                path.nodes[row.depth].add(row.n, None if pd.isna(row.low) else int(row.low), row.children, row.leaves, row.saved, row.ends or None)
            if len(out) >= _ROWS:
                yield _frame(out)
                out.clear()
        while path.nodes:
            path.pop()
        yield _frame(out)

    return run


#: Bytes of strings in a range.
RANGE_BYTES = 16 << 20


def _placed(turns: DataFrame, parts: int) -> DataFrame:
    """``(conv_id, token, cp, at, before, ...)``: turns in order, dealt out by ranges so that one long conversation fills many tasks.

    ``pos`` is the place of a turn in its conversation, ``h`` and ``given`` how
    many first turns come from the family's first conversation, as asked for and as there are.
    """
    order = ["conv_id", "turn", "role", "token"]
    dealt = turns.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    rows, _ = written(dealt.select("conv_id", "token", "cp", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("at")))
    spans = rows.groupBy("conv_id", "part").agg(F.min("at").alias("low"), F.count("*").alias("n"))
    earlier = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    spans, _ = written(spans.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0))))
    sizes = spans.groupBy("conv_id").agg(F.sum("n").alias("turns"))
    bases = sizes.select(F.col("conv_id").alias("base"), F.least("turns", F.lit(HEADS)).alias("held"))
    asked = sizes.select("conv_id", (F.col("conv_id") - F.col("conv_id") % FAMILY).alias("base"), (F.crc32(F.col("conv_id").cast("string")) % HEADS).alias("h"))
    convs, _ = written(asked.join(bases, "base", "left").select("conv_id", "base", "h", F.least("h", F.coalesce("held", F.lit(0))).alias("given")))
    known = spans.join(convs, "conv_id").select("conv_id", "part", "low", "before", "h", "given")
    placed, _ = written(rows.join(known, ["conv_id", "part"]).select("conv_id", "token", "cp", "h", "given", (F.col("at") - F.col("low") + F.col("before")).alias("pos")))
    own = placed.filter("pos >= h").select("conv_id", (F.col("pos") - F.col("h") + F.col("given")).alias("pos"), "token", "cp")
    heads = placed.filter((F.col("conv_id") % FAMILY == 0) & (F.col("pos") < HEADS)).select(F.col("conv_id").alias("base"), "pos", "token", "cp")
    lent = convs.join(heads, "base").filter("pos < h").select("conv_id", "pos", "token", "cp")
    every = convs.select("conv_id", F.lit(0).cast("long").alias("pos"), F.lit(None).cast("string").alias("token"), F.lit(0).alias("cp"))  # for those without turns
    return own.unionByName(lent).unionByName(every)


def _segments(rebuilt: DataFrame, segment: int) -> DataFrame:
    """``(conv_id, seg, s, cps, prefix, name, ended)``: segments of rebuilt conversations; ``name`` tells equal ones with equal turns before them."""
    turns = F.filter(F.sort_array(F.collect_list(F.struct("pos", "token", "cp"))), lambda x: x["token"].isNotNull())
    grouped = rebuilt.groupBy("conv_id", F.floor(F.col("pos") / segment).alias("seg")).agg(turns.alias("x"))
    segs, _ = written(grouped.select(
        "conv_id", "seg", F.unhex(F.array_join(F.transform("x", lambda t: t["token"]), "")).alias("s"), F.transform("x", lambda t: t["cp"]).alias("cps")
    ))
    if segs.filter("seg > 0").isEmpty():
        return segs.select("*", F.lit("").alias("prefix"), F.md5(F.md5("s").cast("binary")).alias("name"), F.lit(True).alias("ended"))
    byseg = Window.partitionBy("conv_id").orderBy("seg")
    named = lambda digests: F.aggregate(digests, F.lit(""), lambda name, x: F.md5(F.concat(name, x).cast("binary")))
    names = segs.select("conv_id", "seg", F.md5("s").alias("digest")).select(
        "conv_id", "seg", named(F.collect_list("digest").over(byseg.rowsBetween(Window.unboundedPreceding, -1))).alias("prefix"),
        named(F.collect_list("digest").over(byseg.rowsBetween(Window.unboundedPreceding, 0))).alias("name"), F.lead("seg").over(byseg).isNull().alias("ended"),
    )
    return segs.join(names, ["conv_id", "seg"])


def _ends(members: DataFrame, parts: int) -> DataFrame:
    """``(name, ends)``: the digest of the ids ``members(name, conv_id)`` of each name, read as a sorted stream."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, digest = None, None
        for b in batches:
            done = []
            for name, ids in b.groupby("name", sort=False)["conv_id"]:
                text = ",".join(map(str, ids)).encode()
                if name == at:
                    digest.update(b"," + text)
                else:
                    if digest:
                        done.append((at, digest.hexdigest()))
                    at, digest = name, hashlib.sha256(text)
            yield pd.DataFrame(done, columns=["name", "ends"])
        if digest:
            yield pd.DataFrame([(at, digest.hexdigest())], columns=["name", "ends"])

    return members.repartition(parts, "name").sortWithinPartitions("name", "conv_id").mapInPandas(run, "name string, ends string")


def _runs(strings: DataFrame) -> DataFrame:
    """Sorted runs with LCPs: each batch of a task is one."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for k, b in enumerate(batches):
            order, lcps = sorted_run(b["s"].tolist())
            yield b.iloc[order].assign(run=TaskContext.get().partitionId() << 32 | k, place=range(len(b)), lcp=lcps)

    return strings.mapInPandas(run, strings.schema.simpleString()[7:-1].replace(":", " ") + ", run long, place long, lcp long")


def _level(segs: DataFrame, below: DataFrame | None, named: bool, parts: int) -> DataFrame:
    """The nodes of the segments of one depth; ``below``: what hangs under the ends of these segments."""
    stem = F.concat(F.unhex("prefix"), "s") if named else F.col("s")
    strings = segs.groupBy("name").agg(F.first(stem).alias("s"), F.first("cps").alias("cps"), F.count("*").alias("n"), F.min("conv_id").cast("long").alias("low"))
    strings = strings.join(_ends(segs.filter("ended").select("name", "conv_id"), parts), "name", "left")
    if below is None:
        strings = strings.select("s", "cps", "n", "low", "ends", *[F.lit(0).cast("long").alias(c) for c in ("children", "leaves", "saved")])
    else:
        hung = below.select(F.col("key").alias("name"), "children", "leaves", "saved")
        strings = strings.join(hung, "name", "left").select("s", "cps", "n", "low", "ends", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("children", "leaves", "saved")])
    runs, _ = written(_runs(strings))
    ranges = max(parts, (runs.agg(F.sum(F.length("s"))).first()[0] or 0) // RANGE_BYTES)
    made, _ = written(runs.repartitionByRange(ranges, "s").mapInPandas(_nodes_of_range(named), NODE))
    edges = made.filter("part IS NOT NULL").repartition(1).sortWithinPartitions("part", "side", "depth")
    return made.filter("part IS NULL").unionByName(edges.mapInPandas(_joined_edges(named), NODE))


def prefix_trie(conversations: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """Per distinct prefix of the rebuilt conversations: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    ``conversations``: conv_id, turn, role, text; other columns are ignored.
    Turns are ordered by turn (null first), ties by role and a digest of the
    turn; repeated rows are turns of their own.  A null role or text is empty,
    texts may be of any length.  Each conversation c first gets the
    first crc32(c) mod HEADS turns of c - c mod FAMILY in place of as many of its own.  Rows with a null
    conv_id belong to no conversation.  An empty table gives no nodes, not
    even a root.  Ids are whole numbers.

    The ids in ``ends_sha256`` are hashed in one sorted stream for each node,
    as the digest of a list can't be put together from parts.
    """
    spark = conversations.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    role, text = F.coalesce(F.col("role"), F.lit("")), F.coalesce(F.col("text"), F.lit(""))
    token = F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"))
    turns = conversations.filter("conv_id IS NOT NULL").select("conv_id", "turn", role.alias("role"), token.alias("token"), F.length(text).alias("cp"))
    segs, _ = written(_segments(_placed(turns, parts), segment))
    last, below, nodes = segs.agg(F.max("seg")).first()[0], None, None
    for k in range(int(last or 0), -1, -1):
        level, _ = written(_level(segs.filter(F.col("seg") == k), below, k > 0, parts))
        base = 1 if k else 0
        below = level.filter(f"depth = {base}") if k else None
        new = level.filter(f"depth > {base}" if k else "true").withColumn("depth", F.col("depth").cast("long") + (k * segment - base))
        nodes = new if nodes is None else nodes.unionByName(new)
    nodes = nodes.select(
        "key", "parent", "depth", F.col("low").alias("conv_id"), F.col("n").alias("n_convs"), F.col("children").alias("n_children"), F.col("leaves").alias("n_leaves"),
        F.col("saved").alias("saved_tokens"), F.coalesce("ends", F.lit(NOTHING)).alias("ends_sha256"),
    )
    parents = nodes.filter("n_children > 0").select(F.col("key").alias("parent"), F.col("conv_id").alias("parent_conv_id"), F.col("n_children").alias("weight"))
    placed = joined_by_weight(nodes.filter("parent IS NOT NULL"), parents, ["parent"], "weight")
    roots = nodes.filter("parent IS NULL").withColumn("parent_conv_id", F.lit(None).cast("long"))
    return placed.unionByName(roots).select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
