"""Near-duplicates by a MinHash LSH forest, confirmed on full shingle sets.

Documents with equal sets form a class, and only one of each class goes on.
A forest of TREES sorted orders of the signatures gives candidates: in each
order a document meets up to NEIGHBOURS next ones that share a prefix of at
least MIN_DEPTH values.  The depth adapts to the region: a sparse one is read at
MIN_DEPTH, in a dense one only the longest common prefix of either side counts,
and only with the next one, as the exact join below finds the rest.
Candidates that the whole signatures don't rule out are confirmed on full sets.
Documents that met a group but were not linked to it are then compared with its
hubs, the members with most links: where members differ from one original, each
is nearest to the least changed ones.  Last, the documents of dense regions that
are not in one component yet meet by an exact prefix-filter join, rarest
shingles first, so that a pair which shares MIN_DEPTH values in any tree is
found however many others share them.  ``exact`` joins all documents that way.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.llm.common import broadcast_if_small, joined_by_weight, written
from lectern.llm.components import components
from lectern.llm.tokens import chunks, mix64, shingles, word_hashes

WIDTH = 5
#: Documents are linked from this percentage of intersection to union.
PERCENT = 75
VALUES = 128
TREES, DEPTH, MIN_DEPTH, NEIGHBOURS = 32, 8, 4, 3
#: Signatures that agree in fewer values are not confirmed: 6 deviations below what PERCENT gives.
LEAST_AGREE = 66
#: Pairs that agree at least so much can still lead to a group's hubs.
LEAST_NEAR = 40
HUBS = 12
#: Documents (some 50 bytes each) up to this many are broadcast to pick their texts.
BROADCAST_IDS = 1_000_000
#: Shingles of so many dense documents are put last in the order of the prefix filter ...
COMMON = 4
#: ... up to so many of them, the commonest (16 bytes each); any order gives the same pairs.
MOST_COMMON = 1_000_000
#: Longer lists of documents with one shingle are met block by block.
LONG_LIST = 64

_rng = np.random.default_rng(20_240_229)
_MULTIPLY = _rng.integers(0, 1 << 63, VALUES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_FLIP = _rng.integers(0, 1 << 63, VALUES, dtype=np.uint64)
_ORDERS = [_rng.permutation(VALUES)[:DEPTH].tolist() for _ in range(TREES)]
_BLOCK = 4096


def signature(x: np.ndarray) -> bytes:
    """VALUES 16-bit values; two sets agree in each with a probability of their similarity, but for 2^-16."""
    low = np.full(VALUES, np.iinfo(np.uint64).max, dtype=np.uint64)
    for lo in range(0, len(x), _BLOCK):
        h = (x[lo : lo + _BLOCK][None, :] ^ _FLIP[:, None]) * _MULTIPLY[:, None]
        np.minimum(low, h.min(axis=1), out=low)
    return (mix64(low) >> np.uint64(48)).astype(">u2").tobytes()


def _sets(texts: list[str | None], width: int) -> Iterator[np.ndarray]:
    for _, _, encoded in chunks(texts):
        hashes, first = word_hashes(encoded)
        for k in range(len(encoded)):
            yield shingles(hashes[first[k] : first[k + 1]], width)


def _named(x: np.ndarray) -> tuple[int, int]:
    """128 bits that name a set: two sums of its mixed hashes."""
    return int(mix64(x).sum(dtype=np.uint64).astype(np.int64)), int(mix64(x ^ _FLIP[0]).sum(dtype=np.uint64).astype(np.int64))


def _signed(docs: DataFrame, width: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, names, sig = [], [], []
            for x in _sets(b.column(1).to_pylist(), width):
                n.append(len(x))
                names.append(_named(x))
                sig.append(signature(x) if len(x) else b"")
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(n, pa.int64()), *[pa.array([x[i] for x in names], pa.int64()) for i in (0, 1)], pa.array(sig, pa.binary())],
                ["doc_id", "n", "one", "two", "sig"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n long, one long, two long, sig binary")


def _texts_of(ids: DataFrame, classes: DataFrame, docs: DataFrame) -> DataFrame:
    """``(id, one, two, text)``: the texts of the documents that stand for the classes ``ids(id)``."""
    wanted = classes.join(broadcast_if_small(ids, BROADCAST_IDS), "id", "left_semi").select("id", "one", "two", F.col("rep").alias("doc_id"))
    return docs.select("doc_id", "text").join(broadcast_if_small(wanted, BROADCAST_IDS), "doc_id").select("id", "one", "two", "text")


def _sets_of(b: pd.DataFrame, width: int) -> Iterator[tuple[int, np.ndarray]]:
    """Class and set of the rows that are of their class: another row of the same doc_id can have another text."""
    for id_, one, two, x in zip(b["id"], b["one"], b["two"], _sets(list(b["text"]), width), strict=True):
        if (one, two) == _named(x):
            yield id_, x


def _candidates(reps: DataFrame) -> DataFrame:
    """Distinct pairs ``(a, b)``, a < b, of neighbours in the trees, and ``(a, a)`` for documents of dense regions."""
    trees = F.array(*[
        F.struct(F.lit(t).alias("tree"), F.concat(*[F.substring("sig", 2 * c + 1, 2) for c in order]).alias("key"))
        for t, order in enumerate(_ORDERS)
    ])
    rows = reps.select("id", F.explode(trees).alias("x")).select("x.tree", "x.key", "id")
    spark = reps.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartitionByRange(parts, "tree", "key", "id").sortWithinPartitions("tree", "key", "id")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        left = None
        for b in batches:
            tree, ids = b["tree"].to_numpy(), b["id"].to_numpy()
            key = np.frombuffer(b"".join(b["key"]), np.uint8).reshape(-1, 2 * DEPTH).view(">u2")
            if left is not None:
                tree, key, ids = (np.concatenate(p) for p in zip(left, (tree, key, ids), strict=True))
            new = 0 if left is None else len(left[0])
            deep = np.where(tree[1:] == tree[:-1], np.cumprod(key[1:] == key[:-1], axis=1).sum(axis=1), 0)
            longest = np.maximum(np.concatenate(([0], deep)), np.concatenate((deep, [0])))
            region = np.concatenate(([0], np.cumsum(deep < MIN_DEPTH)))
            sizes = np.bincount(region)
            sparse = sizes[region] <= NEIGHBOURS + 1
            # a region at the edge of a batch or partition can go on beyond it, so it counts as dense
            crowd = ids[~sparse | (region == 0) | (region == region[-1])] if len(ids) else ids
            shared, found = deep, []
            for gap in range(1, NEIGHBOURS + 1):
                if len(ids) <= gap:
                    break
                if gap > 1:
                    shared = np.minimum(shared[:-1], deep[gap - 1 :])
                # in a dense region, whose documents are joined exactly afterwards, only next ones with the longest common prefix of either side
                near = sparse[gap:] if gap > 1 else sparse[1:] | (shared >= np.minimum(longest[1:], longest[:-1]))
                good = (shared >= MIN_DEPTH) & near
                good &= np.arange(gap, len(ids)) >= new  # pairs inside what was left over are told already
                x, y = ids[:-gap][good], ids[gap:][good]
                found.append(np.stack([np.minimum(x, y), np.maximum(x, y)]))
            left = (tree[-NEIGHBOURS:], key[-NEIGHBOURS:], ids[-NEIGHBOURS:])
            found.append(np.stack([crowd, crowd]))
            out = np.unique(np.concatenate(found, axis=1), axis=1)
            yield pd.DataFrame({"a": out[0], "b": out[1]})

    return dealt.mapInPandas(run, "a long, b long").distinct()


def _agreement(pairs: DataFrame, reps: DataFrame) -> DataFrame:
    """``pairs`` with ``agree``, the number of equal values in their signatures."""
    one = reps.select(F.col("id").alias("a"), F.col("sig").alias("sig_a"))
    two = reps.select(F.col("id").alias("b"), F.col("sig").alias("sig_b"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            x = np.frombuffer(b"".join(b["sig_a"]), np.uint16).reshape(-1, VALUES)
            y = np.frombuffer(b"".join(b["sig_b"]), np.uint16).reshape(-1, VALUES)
            yield pd.DataFrame({"a": b["a"], "b": b["b"], "agree": (x == y).sum(axis=1)})

    return pairs.join(one, "a").join(two, "b").mapInPandas(run, "a long, b long, agree int")


def _confirmed(pairs: DataFrame, classes: DataFrame, docs: DataFrame, width: int) -> DataFrame:
    """The pairs of classes whose full sets reach PERCENT."""
    pairs, _ = written(pairs.select("a", "b"))
    ids = pairs.select(F.col("a").alias("id")).unionAll(pairs.select("b")).distinct()

    def coded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            got = list(_sets_of(b, width))
            yield pd.DataFrame({"id": [i for i, _ in got], "s": [x.tobytes() for _, x in got]})

    sets, _ = written(_texts_of(ids, classes, docs).mapInPandas(coded, "id long, s binary"))
    if sets.count() != sets.select("id").distinct().count():
        sets = sets.dropDuplicates(["id"])  # several rows of one doc_id can be of one class

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            keep = []
            for x, y in zip(b["s_a"], b["s_b"], strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= PERCENT * (len(x) + len(y) - both))
            yield b.loc[keep, ["a", "b"]]

    one = sets.select(F.col("id").alias("a"), F.col("s").alias("s_a"))
    two = sets.select(F.col("id").alias("b"), F.col("s").alias("s_b"))
    return pairs.join(one, "a").join(two, "b").mapInPandas(run, "a long, b long")


def _meet(key: np.ndarray, rows: np.ndarray, most: int = LONG_LIST) -> np.ndarray:
    """Pairs of ids that can reach PERCENT if a shared key is the first one they share.

    ``key`` is sorted; ``rows`` holds id, component, size and the key's position
    in the document's order.  Pairs inside a component are left out.
    """
    node, group, n, rest = rows[:, 0], rows[:, 1], rows[:, 2], rows[:, 2] - rows[:, 3]

    def good(i, j):
        left = np.minimum(rest[i], rest[j])
        return (group[i] != group[j]) & ((100 + PERCENT) * left >= PERCENT * (n[i] + n[j]))

    edge = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    length = np.diff(np.concatenate((edge, [len(key)])))
    found = [np.zeros((0, 2), np.int64)]
    short = np.repeat(length <= most, length)
    last = np.repeat(edge + length, length)
    i = np.flatnonzero(short & (last - np.arange(len(key)) > 1))
    gap = 1
    while len(i):
        keep = good(i, i + gap)
        found.append(np.stack([node[i[keep]], node[i[keep] + gap]], axis=1))
        gap += 1
        i = i[i + gap < last[i]]
    for lo, size in zip(edge[length > most], length[length > most], strict=True):
        if (group[lo : lo + size] == group[lo]).all():
            continue
        all_ = np.arange(lo, lo + size)
        step = max(1, 4_000_000 // size)
        for at in range(0, size, step):
            x, y = np.nonzero(good(all_[at : at + step, None], all_[None, at:]) & (all_[at : at + step, None] < all_[None, at:]))
            found.append(np.stack([node[lo + at + x], node[lo + at + y]], axis=1))
    out = np.concatenate(found)
    return np.unique(np.sort(out, axis=1), axis=0)


def _in_crowds(dense: DataFrame, groups: DataFrame, classes: DataFrame, docs: DataFrame, width: int) -> DataFrame:
    """Pairs ``(a, b)`` of the classes ``dense(id)`` outside of one component that may reach PERCENT; none that does is left out."""
    spark = dense.sparkSession
    picked = _texts_of(dense, classes, docs)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            x, k = np.unique(np.concatenate([np.zeros(0, np.uint64), *[x for _, x in _sets_of(b, width)]]), return_counts=True)
            yield pd.DataFrame({"s": x.astype(np.int64), "k": k})

    counts = picked.mapInPandas(count, "s long, k long").groupBy("s").agg(F.sum("k").alias("k")).filter(F.col("k") >= COMMON)
    common = counts.orderBy(F.desc("k"), "s").limit(MOST_COMMON).toArrow()
    names = common["s"].to_numpy().astype(np.uint64)
    order = np.argsort(names)
    sent = spark.sparkContext.broadcast((names[order], common["k"].to_numpy()[order]))
    placed = picked.join(groups.toDF("id", "c"), "id", "left").select("id", "one", "two", F.coalesce("c", "id").alias("c"), "text")

    def prefixes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known, often = sent.value
        for b in batches:
            out = [np.zeros((0, 5), np.int64)]
            group = dict(zip(b["id"], b["c"], strict=True))
            for node, x in _sets_of(b, width):
                c, n = group[node], len(x)
                rank = np.zeros(n, np.int64)
                if len(known):
                    at = np.minimum(np.searchsorted(known, x), len(known) - 1)
                    rank = np.where(known[at] == x, often[at], 0)
                head = np.lexsort((x, rank))[: n + 1 - -(-PERCENT * n // 100)]
                row = np.empty((len(head), 5), np.int64)
                row[:, 0], row[:, 1], row[:, 2], row[:, 3], row[:, 4] = x[head].astype(np.int64), node, c, n, np.arange(len(head))
                out.append(row)
            yield pd.DataFrame(np.concatenate(out), columns=["s", "id", "c", "n", "at"])

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = placed.mapInPandas(prefixes, "s long, id long, c long, n long, at long")
    dealt = rows.repartition(parts, "s").sortWithinPartitions("s")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        left = np.zeros((0, 5), np.int64)
        for b in batches:
            all_ = np.concatenate([left, b.to_numpy(np.int64)])
            if not len(all_):
                continue
            # the last list can go on in the next batch
            end = int(np.searchsorted(all_[:, 0], all_[-1, 0]))
            left = all_[end:]
            yield pd.DataFrame(_meet(all_[:end, 0], all_[:end, 1:]), columns=["a", "b"])
        if len(left):
            yield pd.DataFrame(_meet(left[:, 0], left[:, 1:]), columns=["a", "b"])

    return dealt.mapInPandas(run, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, width: int = WIDTH, exact: bool = False) -> DataFrame:
    """Per row of ``docs``: doc_id, n_shingles, component_id, kept.

    A text's set: its distinct shingles of ``width`` words (A-Z folded); with
    fewer words the whole sequence as one; without words, or null, empty and
    linked with nothing.  component_id is the smallest doc_id reachable over
    links of at least PERCENT; ``kept`` marks doc_id = component_id.  Rows
    with one doc_id are one document to links, whatever their texts, and equal
    rows are all kept or not.  A null doc_id links with nothing: its
    component_id is null and it is kept.  Ids may be of any type that sorts.
    Other columns are ignored; no rows give no rows.

    The forest misses a pair at 0.75 only if the two share MIN_DEPTH values in
    no tree, or fewer than LEAST_AGREE in all.  With ``exact`` all documents
    are joined by their rarest shingles instead, so that no pair is missed.
    """
    docs = docs.select("doc_id", "text")
    signed, _ = written(_signed(docs, width))
    real = signed.filter(F.col("doc_id").isNotNull() & (F.col("n") > 0))
    grouped = real.groupBy("one", "two", "n").agg(F.min("doc_id").alias("rep"), F.count("*").alias("rows"))
    classes, _ = written(grouped.withColumn("id", F.monotonically_increasing_id()))
    mapped, _ = written(joined_by_weight(real, classes, ["one", "two", "n"], "rows").select(
        "doc_id", "n", "id", F.when(F.col("doc_id") == F.col("rep"), F.col("sig")).alias("sig")
    ))
    reps = mapped.filter(F.col("sig").isNotNull()).select("id", "sig", "n")
    repeated = mapped.count() != mapped.select("doc_id").distinct().count()
    if repeated:
        reps = reps.dropDuplicates(["id"])
    shared = _shared_ids(mapped) if repeated else None
    if exact:
        alone = mapped.limit(0).select(F.col("id").alias("node"), F.col("id").alias("component"))
        links, _ = written(_confirmed(_in_crowds(classes.select("id"), alone, classes, docs, width), classes, docs, width))
    else:
        links = _links_of_forest(reps, shared, classes, docs, width)
    if repeated:
        links = links.unionAll(shared)
    found = components(links)
    nodes, _ = written(classes.join(found, F.col("id") == F.col("node"), "left").select("id", "rep", "rows", F.coalesce("component", "id").alias("c")))
    lows, _ = written(nodes.groupBy("c").agg(F.min("rep").alias("component_id"), F.count("*").alias("members")))
    labels, _ = written(joined_by_weight(nodes.select("id", "rows", "c"), lows, ["c"], "members").select("id", "rows", "component_id"))
    joined = joined_by_weight(mapped.select("doc_id", "n", "id"), labels, ["id"], "rows").select("doc_id", "n", "component_id")
    alone = signed.filter(F.col("doc_id").isNull() | (F.col("n") == 0)).select("doc_id", "n", F.col("doc_id").alias("component_id"))
    return joined.unionAll(alone).select(
        "doc_id", F.col("n").alias("n_shingles"), "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept")
    )


def _links_of_forest(reps: DataFrame, shared: DataFrame | None, classes: DataFrame, docs: DataFrame, width: int) -> DataFrame:
    """Confirmed links ``(a, b)`` of classes that join all which the trees bring together."""
    met, _ = written(_candidates(reps))
    near, _ = written(_agreement(met.filter("a <> b"), reps).filter(F.col("agree") >= LEAST_NEAR))
    # the likeliest partners of each document first: most other pairs then lie inside a component and need no proof
    strong = near.filter(F.col("agree") >= LEAST_AGREE)
    likeliest, _ = written(_likeliest(strong))
    first, _ = written(_confirmed(likeliest, classes, docs, width))
    rest = _apart(strong, components(first)).join(likeliest, ["a", "b"], "left_anti")
    second, _ = written(_confirmed(rest, classes, docs, width))
    links = first.unionAll(second)
    groups, _ = written(components(links))
    more, _ = written(_confirmed(_to_hubs(near, links, groups, reps), classes, docs, width))
    links = links.unionAll(more)
    groups, _ = written(components(links if shared is None else links.unionAll(shared)))
    crowds = _in_crowds(met.filter("a = b").select(F.col("a").alias("id")), groups, classes, docs, width)
    dense, _ = written(_confirmed(_agreement(crowds, reps).filter(F.col("agree") >= LEAST_AGREE), classes, docs, width))
    return links.unionAll(dense)


def _likeliest(pairs: DataFrame, each: int = 2) -> DataFrame:
    """The pairs that are among the ``each`` with most agreement for either side."""
    sides = pairs.select("a", "b", "agree", F.explode(F.array("a", "b")).alias("node"))
    rank = F.row_number().over(Window.partitionBy("node").orderBy(F.desc("agree"), "a", "b"))
    return sides.withColumn("rank", rank).filter(F.col("rank") <= each).select("a", "b").distinct()


def _apart(pairs: DataFrame, groups: DataFrame) -> DataFrame:
    """The pairs whose sides are not in one component, with their components (null outside of any)."""
    sides = pairs.join(groups.toDF("a", "c_a"), "a", "left").join(groups.toDF("b", "c_b"), "b", "left")
    return sides.filter(~F.coalesce(F.col("c_a") == F.col("c_b"), F.lit(False)))


def _shared_ids(mapped: DataFrame) -> DataFrame:
    """Links between the classes that the rows with one doc_id belong to."""
    spread = mapped.groupBy("doc_id").agg(F.min("id").alias("low"), F.max("id").alias("high")).filter("low <> high")
    return mapped.join(spread, "doc_id").filter("id <> low").select(F.col("low").alias("a"), F.col("id").alias("b"))


def _to_hubs(near: DataFrame, links: DataFrame, groups: DataFrame, reps: DataFrame) -> DataFrame:
    """Pairs of documents and the hubs of groups that they met in a tree without being in them."""
    degree = links.select(F.col("a").alias("node")).unionAll(links.select("b")).groupBy("node").agg(F.count("*").alias("links"))
    rank = F.row_number().over(Window.partitionBy("component").orderBy(F.desc("links"), "node"))
    hubs = groups.join(degree, "node").withColumn("rank", rank).filter(F.col("rank") <= HUBS).select(F.col("component").alias("at"), F.col("node").alias("hub"))
    apart, _ = written(_apart(near, groups))
    to_b = apart.filter(F.col("c_b").isNotNull()).select(F.col("a").alias("x"), F.col("c_b").alias("at"))
    to_a = apart.filter(F.col("c_a").isNotNull()).select(F.col("b").alias("x"), F.col("c_a").alias("at"))
    met = to_a.unionAll(to_b).distinct().join(hubs, "at")
    pairs = met.select(F.least("x", "hub").alias("a"), F.greatest("x", "hub").alias("b")).distinct()
    new = pairs.join(near.filter(F.col("agree") >= LEAST_AGREE).select("a", "b"), ["a", "b"], "left_anti")
    return _agreement(new, reps).filter(F.col("agree") >= LEAST_AGREE)
