"""Hard negatives by a vector-approximation file.

Each dimension is cut into cells that hold about equally many values; a row's
approximation is one cell number (a byte) per dimension.  For an anchor a table
gives, per dimension and cell, the least and the greatest product that a value
of the cell can add to the score, so that sums of looked-up entries bound a
row's score from both sides.  Exact scores are computed only for rows whose
bounds say that they might be among the best of a block: first among those of
the anchor's own label, then among the others inside each window.

Anchors are a stated set of queries.  They are broadcast in slices of bounded
size, each of which meets all rows, block by block; a block gives back only the
best few of each anchor or window, and these few are ranked by a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectern.llm.common import dropped, written

#: Components are multiplied by this and rounded down.
SCALE = 256
#: Every so manieth vec_id is an anchor.
ANCHOR_EVERY = 100
POSITIVES, NEGATIVES = 5, 5
#: A negative's score is at least this percentage of the positive's, and no greater than it.
PERCENT = 80
#: Bits of a cell number.
CELL_BITS = 6
#: Components (8 bytes each) of anchors, and anchors, in a slice that is broadcast.
SLICE_VALUES, SLICE_ROWS = 1 << 20, 1 << 15
#: Rows whose bounds are taken at a time.
BLOCK = 4096


def _whole(vector: Column) -> Column:
    """The vector in integers, or null if any component is null or not finite."""
    finite = F.forall(vector, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) != float("inf")), F.lit(False)))
    return F.when(finite, F.transform(vector, lambda x: F.floor(x.cast("double") * SCALE)))


def prepared(rows: DataFrame) -> DataFrame:
    """``(vec_id, label, v)`` of the rows that take part, with the planted labels; ``rows``: vec_id, embedding, label."""
    relabelled = F.when(F.col("vec_id") % 7 == 0, (F.col("label").cast("long") + 1) % 10).otherwise(F.col("label"))
    some = rows.filter("vec_id IS NOT NULL AND label IS NOT NULL")
    return some.select("vec_id", relabelled.cast("long").alias("label"), _whole(F.col("embedding")).alias("v")).filter("v IS NOT NULL")


def cell_edges(vectors: DataFrame, rows: int, width: int, bits: int = CELL_BITS) -> np.ndarray:
    """Least value of each dimension, inner edges of its cells, greatest value: an array (width, cells + 1), over all ``rows`` rows."""
    cells = 1 << bits
    inner = [i / cells for i in range(1, cells)]
    found = vectors.select(F.posexplode("v").alias("at", "x")).groupBy("at").agg(
        F.min("x").alias("lo"), F.max("x").alias("hi"), F.percentile_approx("x", inner, 1000).alias("inner"), F.count("*").alias("n")
    ).collect()
    edges = np.zeros((width, cells + 1), np.int64)
    for r in found:  # a shorter vector counts as zero in the dimensions that it lacks
        edges[r.at] = [min(r.lo, 0) if r.n < rows else r.lo, *r.inner, max(r.hi, 0) if r.n < rows else r.hi]
        edges[r.at] = np.clip(edges[r.at], edges[r.at, 0], edges[r.at, -1])
    return edges


def _matrix(vectors: pd.Series, width: int) -> np.ndarray:
    out = np.zeros((len(vectors), width), np.int64)
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return out


def cells_of(m: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """The cell number of every component: cell c holds values x with edge c <= x <= edge c + 1."""
    return np.stack([np.searchsorted(edges[j, 1:-1], m[:, j], side="right") for j in range(m.shape[1])], axis=1).astype(np.uint8)


def lookup_tables(anchor: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest product of the anchor's component with any value of a cell, per dimension and cell, flat."""
    a, b = anchor[:, None] * edges[:, :-1], anchor[:, None] * edges[:, 1:]
    return np.minimum(a, b).ravel(), np.maximum(a, b).ravel()


def bounds(at: np.ndarray, tables: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds of the scores; ``at`` (width, rows) says where a row's entries stand in the flat tables."""
    return tables[0].take(at).sum(axis=0), tables[1].take(at).sum(axis=0)


def possible(lower: np.ndarray, upper: np.ndarray, allowed: np.ndarray, most: int, window: tuple[int, int] | None = None) -> np.ndarray:
    """Indexes of the allowed rows that might be among the best ``most``, of those inside the percent-scaled ``window`` if there is one.

    Rows that are inside for certain set a bar; a row whose upper bound is below the ``most``-th bar has that many better ones.
    """
    sure = allowed
    if window is not None:
        low, high = window
        allowed = allowed & (100 * upper >= low) & (100 * lower <= high)
        sure = allowed & (100 * lower >= low) & (100 * upper <= high)
    certain = lower[sure]
    if len(certain) > most:
        allowed = allowed & (upper >= np.partition(certain, len(certain) - most)[len(certain) - most])
    return np.flatnonzero(allowed)


def _best(scores: np.ndarray, ids: np.ndarray, most: int) -> np.ndarray:
    return np.lexsort((ids, -scores))[:most]


class _Slice:
    """Anchors of one slice, for use in tasks: ids, labels, vectors and the cells' edges."""

    def __init__(self, uid: np.ndarray, label: np.ndarray, m: np.ndarray, edges: np.ndarray) -> None:
        self.uid, self.label, self.m, self.edges = uid, label, m, edges

    def blocks(self, batches: Iterator[pd.DataFrame]) -> Iterator[tuple]:
        """For each block of rows: uids, ids, labels, vectors, and where the cells' entries stand in the tables."""
        width, cells = self.edges.shape[0], self.edges.shape[1] - 1
        base = (np.arange(width, dtype=np.int64) * cells)[:, None]
        for b in batches:
            for lo in range(0, len(b), BLOCK):
                part = b.iloc[lo : lo + BLOCK]
                cell = np.frombuffer(b"".join(part["cells"]), np.uint8).reshape(len(part), width)
                yield part["uid"].to_numpy(), part["vec_id"].to_numpy(), part["label"].to_numpy(), part["v"], base + cell.T


def _exact(vectors: pd.Series, rows: np.ndarray, anchor: np.ndarray) -> np.ndarray:
    m = np.frombuffer(b"".join(vectors.iloc[rows]), "<i8").reshape(len(rows), len(anchor))
    return m @ anchor


def _positives(part: _Slice, most: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for uid, ids, label, vectors, at in part.blocks(batches):
            out = []
            for k, anchor in enumerate(part.m):
                like = (label == part.label[k]) & (uid != part.uid[k])
                if not like.any():
                    continue
                own = np.flatnonzero(like)
                lower, upper = bounds(at[:, own], lookup_tables(anchor, part.edges))
                near = own[possible(lower, upper, np.ones(len(own), bool), most)]
                scores = _exact(vectors, near, anchor)
                best = _best(scores, ids[near], most)
                out.append(np.stack([np.full(len(best), k), ids[near][best], scores[best]], axis=1))
            if out:
                yield pd.DataFrame(np.concatenate(out), columns=["k", "positive_id", "positive_score"])

    return run


def _negatives(part: _Slice, windows: dict[int, list[tuple[int, int]]], most: int, percent: int):
    """``windows``: per anchor the (place, score) of its positives."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for _, ids, label, vectors, at in part.blocks(batches):
            out = []
            for k, wanted in windows.items():
                anchor, other = part.m[k], label != part.label[k]
                if not other.any():
                    continue
                lower, upper = bounds(at, lookup_tables(anchor, part.edges))
                near = [possible(lower, upper, other, most, (percent * score, 100 * score)) for _, score in wanted]
                every = np.unique(np.concatenate(near))
                if not len(every):
                    continue
                exact = _exact(vectors, every, anchor)
                for (place, score), rows in zip(wanted, near, strict=True):
                    s = exact[np.searchsorted(every, rows)]
                    inside = (100 * s >= percent * score) & (100 * s <= 100 * score)
                    rows, s = rows[inside], s[inside]
                    best = _best(s, ids[rows], most)
                    out.append(np.stack([np.full(len(best), k), np.full(len(best), place), ids[rows][best], s[best]], axis=1))
            if out:
                yield pd.DataFrame(np.concatenate(out), columns=["k", "place", "negative_id", "negative_score"])

    return run


def va_file(vectors: DataFrame, edges: np.ndarray) -> DataFrame:
    """``(uid, vec_id, label, cells, v)``: approximations and vectors as bytes, one number per row."""
    width = edges.shape[0]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for lo in range(0, len(b), BLOCK):
                part = b.iloc[lo : lo + BLOCK]
                m = _matrix(part["v"], width)
                yield pd.DataFrame({
                    "vec_id": part["vec_id"].to_numpy(), "label": part["label"].to_numpy(),
                    "cells": [x.tobytes() for x in cells_of(m, edges)], "v": [x.tobytes() for x in m.astype("<i8")],
                })

    made = vectors.mapInPandas(run, "vec_id long, label long, cells binary, v binary")
    return made.select(F.monotonically_increasing_id().alias("uid"), "*")


def _first(rows: DataFrame, key: list[str], score: str, id_: str, most: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(*key).orderBy(F.desc(score), id_))
    return rows.withColumn("rank", rank).filter(F.col("rank") <= most)


RESULT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def hard_negatives(rows: DataFrame, every: int = ANCHOR_EVERY, bits: int = CELL_BITS, percent: int = PERCENT, positives: int = POSITIVES,
                   negatives: int = NEGATIVES, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """Per anchor, positive and rank: anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``rows``: vec_id, embedding, label; other columns are ignored.  Rows with
    a null id, label or vector, or a null or non-finite component, take no
    part.  Where vec_id divides by 7 the label first becomes (label + 1) mod
    10.  Scores are inner products of components times 256, rounded down;
    higher ones come first, ties by lesser vec_id.  A shorter vector counts as
    zero in the components that it lacks, an empty one scores zero.  Repeated
    rows each take part, as positives and negatives and as anchors; only the
    very row is not its own positive.  Anchors without positives, and
    positives whose window is empty (as with negative scores), give no rows,
    nor does an empty table.  Scores that 63 bits may not hold raise an error.
    """
    spark = rows.sparkSession
    vectors, path = written(prepared(rows))
    widest, count = vectors.agg(F.max(F.size("v")), F.count("*")).first()
    width = widest or 1  # an empty vector still has a cell
    edges = cell_edges(vectors, count, width, bits)
    greatest = int(max(abs(int(edges.min())), abs(int(edges.max())), 1))
    if width * greatest * greatest * 100 >= 1 << 63:
        raise ArithmeticError("inner products of these vectors may not fit 63 bits")
    file, _ = written(va_file(vectors, edges))
    dropped(spark, path)
    size = max(1, min(slice_rows, SLICE_VALUES // width))
    anchors = file.filter(F.col("vec_id") % every == 0).select("uid", "vec_id", "label", "v")
    done, last = None, -1
    while True:  # slices by uid, so that each is a bounded read
        part = anchors.filter(F.col("uid") > last).orderBy("uid").limit(size).toPandas()
        if not len(part):
            break
        last = int(part["uid"].iloc[-1])
        m = np.frombuffer(b"".join(part["v"]), "<i8").reshape(len(part), width)
        found = _mined(spark, file, _Slice(part["uid"].to_numpy(), part["label"].to_numpy(), m, edges), part["vec_id"].tolist(), percent, positives, negatives)
        found, _ = written(found)
        done = found if done is None else done.unionAll(found)
    return done if done is not None else spark.createDataFrame([], RESULT)


def _mined(spark: SparkSession, file: DataFrame, part: _Slice, anchor_ids: list[int], percent: int, positives: int, negatives: int) -> DataFrame:
    """The result for one slice of anchors, each of which meets every row."""
    near = file.mapInPandas(_positives(part, positives), "k long, positive_id long, positive_score long")
    # at most ``positives`` rows for each anchor of the slice
    chosen = _first(near, ["k"], "positive_score", "positive_id", positives).select("k", "rank", "positive_id", "positive_score").toPandas()
    windows: dict[int, list[tuple[int, int]]] = {}
    for k, place, score in zip(chosen["k"], chosen["rank"], chosen["positive_score"], strict=True):
        if score >= 0:  # below zero, percent of the score is above the score
            windows.setdefault(int(k), []).append((int(place), int(score)))
    if not windows:
        return spark.createDataFrame([], RESULT)
    found = file.mapInPandas(_negatives(part, windows, negatives, percent), "k long, place int, negative_id long, negative_score long")
    ranked = _first(found, ["k", "place"], "negative_score", "negative_id", negatives)
    named = chosen.assign(anchor_id=[anchor_ids[k] for k in chosen["k"]])
    pairs = spark.createDataFrame(named.rename(columns={"rank": "place"}).astype("int64"), "k long, place long, positive_id long, positive_score long, anchor_id long")
    return ranked.join(F.broadcast(pairs), ["k", "place"]).select(
        "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score"
    )
