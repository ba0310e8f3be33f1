"""Benchmark decontamination by spaced seeds, in DataFrame functions only.

Fixed masks ignore selected positions of a window of tokens.  The hashes of the
tokens that a mask keeps, at every position of every document and of every
benchmark item, meet in an equi-join.  A hit fixes how item and document are
aligned; the whole item is then compared token by token along that alignment,
so that substituted tokens cost only themselves.  The alignments of one item in
one document are chained: going from one to another costs the tokens inserted or
dropped between them.  A long run of agreeing tokens counts by itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import broadcast_if_small, small_enough, words, written

#: Positions that the masks of a family keep.  However a quarter of an item's tokens are changed, the masks of its
#: length's family still fit somewhere: found by search, and proved for every length by ``least_changes`` in the tests.
LONG = ((0, 2, 3, 4, 5), (0, 1, 4, 6, 8), (0, 1, 2, 5, 8))
MIDDLE = ((0, 1, 2, 4), (0, 3, 4, 5))
SHORT = ((0, 1, 2), (0, 1, 3), (0, 2, 3))
#: Lengths below this one have the family that is given here.
FROM = 17
FAMILIES = {
    1: ((0,),), 2: ((0, 1),), 3: ((0, 1, 2),), 4: SHORT, 5: SHORT, 6: MIDDLE, 7: MIDDLE, 8: SHORT, 9: MIDDLE, 10: MIDDLE,
    11: LONG, 12: MIDDLE, 13: MIDDLE, 14: LONG, 15: LONG, 16: MIDDLE,
}
#: Least share of an item's tokens that agree along the alignment.
OVERLAP = 0.75
#: A passage of so many agreeing tokens without a break is held, whatever its share of the item.
RUN = 13
#: Seeds (24 bytes each) up to this many are broadcast; more are joined by shuffle.
BROADCAST_SEEDS = 2_000_000
#: Tokens of all items (8 bytes each) up to this many are broadcast.
BROADCAST_TOKENS = 4_000_000
#: Least tokens of a text that an alignment is compared with at a time.
PIECE = 1024
#: Documents with hits (16 bytes each) up to this many are broadcast to pick their texts.
BROADCAST_IDS = 1_000_000


def _seed(h: Column, i: Column, mask: tuple[int, ...]) -> Column:
    return F.xxhash64(F.lit("".join(map(str, mask))), *[F.get(h, i + p) for p in mask])


def _tokens(text: Column) -> Column:
    return F.transform(words(text), lambda w: F.xxhash64(w))


def masks_of(n: int) -> tuple[tuple[int, ...], ...]:
    """The masks for an item of ``n`` tokens."""
    return FAMILIES.get(n, LONG) if n < FROM else LONG


def item_seeds(items: DataFrame) -> tuple[DataFrame, list[tuple[int, ...]]]:
    """``(seed, item_id, at)`` of every mask of an item's family at every position, and the masks in use."""
    h = items.select("item_id", "h", F.least(F.size("h"), F.lit(FROM)).alias("n")).filter("n > 0")
    lengths = sorted(r[0] for r in h.select("n").distinct().collect())  # at most FROM rows
    masks = sorted({m for n in lengths for m in masks_of(n)})
    keys = []
    for mask in masks:
        rows = h.filter(F.col("n").isin([n for n in lengths if mask in masks_of(n)]) & (F.size("h") > max(mask)))
        at = rows.select("item_id", "h", F.explode(F.sequence(F.lit(0), F.size("h") - (1 + max(mask)))).alias("at"))
        keys.append(at.select(_seed(F.col("h"), F.col("at"), mask).alias("seed"), "item_id", "at"))
    if not keys:
        return h.select(F.lit(0).cast("long").alias("seed"), "item_id", F.lit(0).alias("at")).limit(0), []
    out = keys[0]
    for more in keys[1:]:
        out = out.unionAll(more)
    return out, masks


def overlaps(docs: DataFrame, items: DataFrame, overlap: float = OVERLAP) -> DataFrame:
    """``(doc_id, item_id, n_tokens, n_matched, position)``: documents that hold an item of a benchmark.

    A document holds an item if at least ``overlap`` of the item's tokens agree
    with the document's along one alignment, or along a chain of alignments,
    less one for each token inserted or dropped between two of them, or if RUN
    tokens in a row agree.  n_matched is that of the best alignment, or where
    it isn't enough of the best chain; position is the alignment with most
    agreeing tokens, the first of equal ones.  No alignment that reaches 75 %
    is missed; of chains, those of alignments that share a seed are seen.
    Tokens are the words with A-Z folded.  Null or empty texts hold nothing and are held by nothing;
    rows with one doc_id or one item_id count as one, by their best; null ids
    are values like any other; other columns are ignored; empty tables give
    no rows.
    """
    tests = items.select("item_id", _tokens(F.col("text")).alias("h"))
    seeds, masks = item_seeds(tests)
    coded = docs.select("doc_id", _tokens(F.col("text")).alias("h"))
    at = coded.select("doc_id", "h", F.posexplode("h").alias("i", "c"))
    offered = at.select("doc_id", "i", F.explode(F.array(*[_seed(F.col("h"), F.col("i"), mask) for mask in masks or [(0,)]])).alias("seed"))
    distinct = seeds.select("seed").distinct()
    if small_enough(seeds, BROADCAST_SEEDS):
        # codegen end to end: positions, hashes and probes never leave the stage
        hits = offered.join(F.broadcast(seeds), "seed")
    else:
        # a common passage can hold many hits of one seed: filter first, so that only hits are dealt out
        hits = offered.join(distinct, "seed", "left_semi").join(seeds, "seed")
    aligned, _ = written(hits.select("doc_id", "item_id", (F.col("i") - F.col("at")).alias("shift")).distinct())
    total, longest = tests.agg(F.sum(F.size("h")), F.max(F.size("h"))).first()
    known = tests.select(F.col("item_id").alias("t_id"), F.col("h").alias("t"))
    if (total or 0) <= BROADCAST_TOKENS:  # else an item that many documents hold is split as a skewed key
        known = F.broadcast(known)
    piece = max(PIECE, longest or 0)
    met = aligned.withColumn("piece", F.floor(F.col("shift") / piece)).join(known, F.col("item_id").eqNullSafe(F.col("t_id")))
    # whole texts meet their alignments in pieces that overlap by the longest item, so that an alignment carries only what it compares
    held = docs.select(F.col("doc_id").alias("d_id"), "text").join(
        broadcast_if_small(aligned.select("doc_id").distinct(), BROADCAST_IDS), F.col("d_id").eqNullSafe(F.col("doc_id")), "left_semi",
    ).select("d_id", _tokens(F.col("text")).alias("h")).filter(F.size("h") > 0)
    pieces = F.transform(F.sequence(F.lit(-1).cast("long"), F.floor((F.size("h") - 1) / piece)), lambda c: F.struct(
        c.alias("p"), F.slice("h", (F.greatest(c * piece, F.lit(0)) + 1).cast("int"), F.lit(piece + (longest or 0))).alias("part")
    ))
    held = held.select("d_id", F.xxhash64("h").alias("whole"), F.explode(pieces).alias("x")).select("d_id", "whole", "x.*")
    full = met.join(held, F.col("doc_id").eqNullSafe(F.col("d_id")) & (F.col("piece") == F.col("p")))
    first = F.col("shift") - F.greatest(F.col("p") * piece, F.lit(0)).cast("int")
    agree = F.transform("t", lambda x, i: F.coalesce(F.get("part", i + first) == x, F.lit(False)).cast("int"))
    one = full.select("doc_id", "item_id", "shift", F.size("t").alias("n"), agree.alias("agree"), F.xxhash64("whole", "t").alias("texts"))
    run = F.aggregate("agree", F.array(F.lit(0), F.lit(0)), lambda s, x: F.array((s[0] + 1) * x, F.greatest(s[1], (s[0] + 1) * x)), lambda s: s[1])
    found = one.select("doc_id", "item_id", "texts", "shift", "n", "agree", F.aggregate("agree", F.lit(0), lambda s, x: s + x).alias("same"), run.alias("run"))
    found, _ = written(found)
    # rows that share an id are chained each by itself
    key = ["doc_id", "item_id", "texts"]
    best = found.groupBy(*key).agg(F.max("n").alias("n"), F.max("run").alias("run"), F.max(F.struct("same", (-F.col("shift")).alias("back"))).alias("best"), F.count("*").alias("ways"))
    enough = F.col("best.same") >= F.lit(overlap) * F.col("n")
    open_, _ = written(best.filter((F.col("ways") > 1) & ~enough))
    chained = _chained(found, open_, key, overlap)
    scored = best.withColumn("n_matched", F.col("best.same").cast("long")).select(*key, "n", "run", "best", "n_matched").unionByName(chained)
    scored = scored.groupBy(*key).agg(F.max("n").alias("n"), F.max("run").alias("run"), F.max("best").alias("best"), F.max("n_matched").alias("n_matched"))
    held_items = scored.filter((F.col("n_matched") >= F.lit(overlap) * F.col("n")) | (F.col("run") >= RUN))
    out = held_items.groupBy("doc_id", "item_id").agg(F.max(F.struct("n_matched", "best.back", "n")).alias("best"))
    return out.select(
        "doc_id", "item_id", F.col("best.n").cast("long").alias("n_tokens"), "best.n_matched", (-F.col("best.back")).cast("long").alias("position"),
    )


def _chained(found: DataFrame, pairs: DataFrame, key: list[str], overlap: float) -> DataFrame:
    """The best chains of alignments for ``pairs`` of a document and an item that no single alignment settles.

    A chain that gains anything loses fewer tokens between its alignments than
    the item has, so all of it lies within that many shifts.  Alignments are
    therefore dealt into overlapping windows of twice that width: each window
    holds a bounded number of them, however often a passage is repeated.
    """
    wanted = pairs.select(*[F.col(k).alias(f"p_{k}") for k in key], F.col("run").alias("p_run"), F.col("best").alias("p_best"))
    met = found.join(wanted, [F.col(k).eqNullSafe(F.col(f"p_{k}")) for k in key])
    at = F.floor(F.col("shift") / F.col("n"))
    dealt = met.select(*key, "n", "shift", "agree", "p_run", "p_best", F.explode(F.array(at - 1, at)).alias("window"))
    windows = dealt.groupBy(*key, "window").agg(
        F.max("n").alias("n"), F.max("p_run").alias("run"), F.max("p_best").alias("best"), F.sort_array(F.collect_list(F.struct("shift", "agree"))).alias("ways")
    ).filter(F.size("ways") > 1)
    ways = F.col("ways")
    # no chain agrees in more tokens than its alignments do together
    most = F.aggregate(F.sequence(F.lit(0), F.col("n") - 1), F.lit(0), lambda s, i: s + F.array_max(F.transform(ways, lambda w: F.get(w["agree"], i))))
    hopeful = windows.withColumn("most", most).filter((F.col("most") > F.col("best.same")) & ((F.col("most") >= F.lit(overlap) * F.col("n")) | (F.col("run") >= RUN)))
    # score of the best chain that ends in each alignment, after each token of the item
    chain = F.aggregate(
        F.sequence(F.lit(0), F.col("n") - 1), F.transform(ways, lambda w: F.lit(0).cast("long")),
        lambda at, i: F.transform(ways, lambda w: F.get(w["agree"], i) + F.array_max(
            F.zip_with(at, ways, lambda score, v: score - F.abs(v["shift"] - w["shift"]))
        )), F.array_max,
    )
    return hopeful.select(*key, "n", "run", "best", chain.alias("n_matched"))


def decontaminate(docs: DataFrame, items: DataFrame, overlap: float = OVERLAP) -> DataFrame:
    """``docs`` without the documents that hold an item; rows, columns and order of columns stay."""
    found = overlaps(docs, items, overlap).select(F.col("doc_id").alias("_held_id")).distinct()
    return docs.join(found, docs["doc_id"].eqNullSafe(found["_held_id"]), "left_anti")
