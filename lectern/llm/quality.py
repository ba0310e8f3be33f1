"""Quality classifier: naive Bayes support vectors over n-gram indicators.

The indicators (byte 1- to 3-grams, word bigrams, and one for any word that
follows itself, twice, ... ) are scaled by the log ratio of their smoothed counts in the two classes; a linear
hinge-loss model is fitted on them by dual coordinate descent; its margin is
turned into a probability by a logistic curve fitted on margins of rows left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import crc_mod
from lectern.llm.tokens import chunks, word_hashes

#: Labelled rows of each class that the fit uses at most, those with the least hash of doc_id.
SAMPLE_PER_CLASS = 2_000
BITS = 18
THRESHOLD = 0.3
#: Indicators of word bigrams, and of runs of one word, of this length at most.
WORD_BITS, RUN = 17, 4
_RUNS = (1 << BITS) + (1 << WORD_BITS)
_DIM = _RUNS + RUN - 1


def indicators(texts: list[str | None]) -> Iterator[np.ndarray]:
    """For each text the sorted distinct indices of its indicators; a null or empty text has none."""
    seen = np.zeros(_DIM, dtype=bool)
    for _, _, encoded in chunks(texts):
        hashes, first = word_hashes(encoded)
        for k, raw in enumerate(encoded):
            b = np.frombuffer(raw, dtype=np.uint8).astype(np.uint32)
            seen[b] = True
            if len(b) > 1:
                seen[256 + ((b[:-1] << 8 | b[1:]) % ((1 << 16) - 256))] = True
            if len(b) > 2:
                tri = (b[:-2] << 16 | b[1:-1] << 8 | b[2:]) * np.uint32(2654435769)
                seen[(1 << 16) + (tri >> np.uint32(8)) % ((1 << BITS) - (1 << 16))] = True
            w = hashes[first[k] : first[k + 1]]
            if len(w) > 1:
                pair = (w[:-1] * np.uint64(0x9E3779B97F4A7C15) + w[1:]) * np.uint64(0xD6E8FEB86659FD93)
                seen[(1 << BITS) + (pair >> np.uint64(64 - WORD_BITS)).astype(np.int64)] = True
                same = w[1:] == w[:-1]
                for k in range(RUN - 1):
                    seen[_RUNS + k] = same.any()
                    same = same[1:] & same[:-1]
            out = np.flatnonzero(seen)
            seen[out] = False
            yield out.astype(np.int32)


@dataclass
class QualityModel:
    weights: np.ndarray
    bias: float
    slope: float
    shift: float

    def margins(self, rows: Iterator[np.ndarray]) -> np.ndarray:
        return np.array([self.weights[x].sum() / np.sqrt(max(1, len(x))) + self.bias for x in rows])

    def scores(self, texts: list[str | None]) -> np.ndarray:
        z = self.slope * self.margins(indicators(texts)) + self.shift
        return 1.0 / (1.0 + np.exp(-np.clip(z, -500, 500)))


def log_ratios(rows: list[np.ndarray], labels: np.ndarray, alpha: float = 1.0) -> np.ndarray:
    p, q = np.full(_DIM, alpha), np.full(_DIM, alpha)
    for x, y in zip(rows, labels, strict=True):
        (p if y > 0 else q)[x] += 1
    return np.log(p / p.sum()) - np.log(q / q.sum())


def descend(rows: list[np.ndarray], labels: np.ndarray, ratios: np.ndarray, c: float = 1.0, epochs: int = 12) -> tuple[np.ndarray, float]:
    """Dual coordinate descent for the hinge loss; returns the weights over the scaled indicators, and the bias."""
    w, bias = np.zeros(_DIM), 0.0
    alpha = np.zeros(len(rows))
    scale = np.array([1.0 / np.sqrt(max(1, len(x))) for x in rows])
    q = np.array([(ratios[x] ** 2).sum() * s * s + 1.0 for x, s in zip(rows, scale, strict=True)])
    share = np.bincount((labels > 0).astype(int), minlength=2)
    cap = np.where(labels > 0, c * len(rows) / (2.0 * share[1]), c * len(rows) / (2.0 * share[0]))  # classes weigh the same
    rng = np.random.default_rng(0)
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            x, y = rows[i], labels[i]
            r = ratios[x]
            gradient = y * ((w[x] * r).sum() * scale[i] + bias) - 1.0
            new = min(max(alpha[i] - gradient / q[i], 0.0), cap[i])
            step = (new - alpha[i]) * y
            if step:
                w[x] += step * scale[i] * r
                bias += step
                alpha[i] = new
    return w, bias


def logistic(margins: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the logistic curve through margins, by Newton steps on smoothed targets."""
    up, down = (labels > 0).sum(), (labels <= 0).sum()
    target = np.where(labels > 0, (up + 1.0) / (up + 2.0), 1.0 / (down + 2.0))
    x = np.stack([margins, np.ones_like(margins)])
    theta = np.array([1.0, np.log((up + 1.0) / (down + 1.0))])
    for _ in range(50):
        p = 1.0 / (1.0 + np.exp(-np.clip(theta @ x, -35, 35)))
        gradient = x @ (p - target) + 1e-3 * theta
        hessian = (x * (p * (1 - p))) @ x.T + 1e-3 * np.eye(2)
        step = np.linalg.solve(hessian, gradient)
        theta -= step
        if np.abs(step).max() < 1e-9:
            break
    return max(float(theta[0]), 1e-6), float(theta[1])


def fit_rows(rows: list[np.ndarray], labels: np.ndarray, folds: int = 5) -> QualityModel:
    """The model from indicator rows and labels of +1 and -1; with one class, or too few rows, a constant at the smoothed share."""
    up, n = int((labels > 0).sum()), len(labels)
    if min(up, n - up) < folds:
        share = (up + 1.0) / (n + 2.0)
        return QualityModel(np.zeros(_DIM, np.float32), 0.0, 1.0, float(np.log(share / (1 - share))))
    left_out = np.zeros(n)
    for k in range(folds):
        test = np.arange(n) % folds == k
        some = [x for x, t in zip(rows, test, strict=True) if not t]
        r = log_ratios(some, labels[~test])
        w, bias = descend(some, labels[~test], r)
        left_out[test] = QualityModel(w * r, bias, 1.0, 0.0).margins(iter([x for x, t in zip(rows, test, strict=True) if t]))
    slope, shift = logistic(left_out, labels)
    ratios = log_ratios(rows, labels)
    w, bias = descend(rows, labels, ratios)
    return QualityModel((w * ratios).astype(np.float32), bias, slope, shift)


def fit(docs: DataFrame, labels: DataFrame, per_class: int = SAMPLE_PER_CLASS) -> QualityModel:
    """Learns from labelled rows whose crc32(doc_id) mod 5 is not 0, at most ``per_class`` of each class."""
    known = (
        labels.filter(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & (crc_mod("doc_id", 5) != 0))
        .groupBy("doc_id").agg((F.avg("quality") >= 0.5).alias("good"))
    )
    rank = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40))
    some = []
    for good, n in sorted(tuple(r) for r in known.groupBy("good").count().collect()):  # two rows
        # twice the wanted share by hash first, so that what is ordered in one place doesn't grow with the table
        few = known.filter((F.col("good") == good) & (rank <= F.lit((2 * per_class << 40) // n)))
        some.append(few.orderBy(rank, "doc_id").limit(per_class))
    chosen = F.broadcast(some[0].unionAll(some[-1]).distinct() if some else known.limit(0))  # 2 * per_class rows

    def coded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"], "good": b["good"], "x": list(indicators(list(b["text"])))})

    kind = docs.schema["doc_id"].dataType.simpleString()
    got = docs.select("doc_id", "text").join(chosen, "doc_id").mapInPandas(coded, f"doc_id {kind}, good boolean, x array<int>").toArrow().to_pandas()
    got["n"] = [len(x) for x in got["x"]]
    got = got.sort_values(["doc_id", "n"], kind="stable").drop_duplicates("doc_id")
    return fit_rows([np.asarray(x) for x in got["x"]], np.where(got["good"], 1.0, -1.0))


def score(docs: DataFrame, model: QualityModel, threshold: float = THRESHOLD) -> DataFrame:
    """Per row of ``docs``: doc_id, held_out, score, predicted.

    Whole texts are scored; a null text scores as an empty one.  Repeated rows
    are scored one by one; null ids stay; other columns are ignored.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            s = sent.value.scores(list(b["text"]))
            yield pd.DataFrame({"doc_id": b["doc_id"], "held_out": b["held_out"], "score": s, "predicted": (s >= threshold).astype("int32")})

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", (crc_mod("doc_id", 5) == 0).alias("held_out"), "text").mapInPandas(
        run, f"doc_id {kind}, held_out boolean, score double, predicted int"
    )


def accepted(docs: DataFrame, model: QualityModel, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without the rows whose text scores below ``threshold``; rows, columns and their order stay."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("boolean")
    def good(text: pd.Series) -> pd.Series:
        return pd.Series(sent.value.scores(list(text)) >= threshold, index=text.index)

    return docs.filter(good("text"))
