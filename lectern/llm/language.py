"""Language identification by a bidirectional gated recurrent network over bytes.

Plain numpy, trained by backpropagation through time on windows of WINDOW
bytes.  Texts are read in stretches of STRETCH bytes, and each direction starts
MARGIN bytes before a stretch, so that no position lacks its context.  Each has
one gate g and a candidate c:

    g = sigmoid(A[byte] + U h)    c = tanh(B[byte] + g * (V h))    h' = h + g * (c - h)

Both directions' states give a label distribution at every byte; a document's
distribution is the mean over all its bytes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.llm.common import crc_mod
from lectern.llm.tokens import chunks

WINDOW = 64
STRETCH, MARGIN, ABREAST = 512, 32, 1024
HIDDEN = 8
#: Documents of each language that training uses at most, with their whole texts: those with the least hash of doc_id and text.
SAMPLE_PER_LANG = 150
#: Training passes over all windows of the sample, at most EPOCHS times and at least once: until so many windows have been visited.
VISITS, EPOCHS = 120_000, 10
UNKNOWN = "und"


@dataclass
class Direction:
    table: np.ndarray  # (256, 2H): half the gate's input, then the candidate's
    inner: np.ndarray  # (2H, H)

    def run(self, codes: np.ndarray, keep: bool = False, sizes: np.ndarray | None = None) -> tuple[np.ndarray, list]:
        """States (T, H, B) after each row of ``codes`` (T, B); with ``keep`` also what the way back needs.

        ``sizes``, descending, are the lengths of the columns; states beyond them mean nothing.
        """
        steps, width = codes.shape
        hidden = self.inner.shape[1]
        table = np.ascontiguousarray(self.table.T)
        out = np.zeros((steps, hidden, width), np.float32)
        h = np.zeros((hidden, width), np.float32)
        saved = []
        alive = np.full(steps, width) if sizes is None else np.searchsorted(-sizes, -np.arange(steps), "left")
        for t in range(steps):
            n = alive[t]
            if n < h.shape[1]:
                h = h[:, :n]
            x = np.take(table, codes[t, :n], axis=1)
            u = self.inner @ h
            g = x[:hidden]
            g += u[:hidden]
            np.tanh(g, out=g)
            g *= 0.5
            g += 0.5
            c = u[hidden:] * g
            c += x[hidden:]
            np.tanh(c, out=c)
            if keep:
                saved.append((h, g.copy(), c.copy(), u[hidden:].copy()))
            c -= h
            c *= g
            h = np.add(h, c, out=out[t, :, :n])
        return out, saved

    def back(self, codes: np.ndarray, saved: list, slopes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Gradients of table and inner from those of the states (T, H, B)."""
        hidden = self.inner.shape[1]
        d_table, d_inner = np.zeros_like(self.table), np.zeros_like(self.inner)
        carried = np.zeros_like(slopes[0])
        for t in range(len(codes) - 1, -1, -1):
            h, g, c, v = saved[t]
            d = slopes[t] + carried
            dc = d * g * (1 - c * c)
            dg = (d * (c - h) + dc * v) * (2 * g * (1 - g))  # for tanh of half the input
            du = np.concatenate([dg, dc * g])
            dx = np.concatenate([dg, dc])
            np.add.at(d_table, codes[t], dx.T)
            d_inner += du @ h.T
            carried = d * (1 - g) + self.inner.T @ du
        return d_table, d_inner


@dataclass
class LanguageModel:
    labels: list[str]
    ahead: Direction | None = None
    behind: Direction | None = None
    head: np.ndarray | None = None  # (L, 2H + 1)

    def positions(self, codes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Label probabilities (T, L, B) at every byte of columns (T, B) of descending ``sizes``."""
        steps, width = codes.shape
        mirror = np.maximum(sizes[None, :] - 1 - np.arange(steps)[:, None], 0)
        column = np.arange(width)
        a, _ = self.ahead.run(codes, sizes=sizes)
        b, _ = self.behind.run(codes[mirror, column], sizes=sizes)
        hidden = self.ahead.inner.shape[1]
        z = np.matmul(self.head[:, :hidden], a)
        z += np.matmul(self.head[:, hidden : 2 * hidden], b).transpose(0, 2, 1)[mirror, column].transpose(0, 2, 1)
        z += self.head[:, -1:]
        np.exp(z, out=z)  # states lie in (-1, 1), so this can't overflow for heads of any sane size
        z /= z.sum(axis=1, keepdims=True)
        return z

    def pooled(self, encoded: list[bytes]) -> np.ndarray:
        """Mean label probabilities over all bytes of every text, (n, L); of an empty text zeros."""
        lengths = np.array([len(x) for x in encoded])
        buf = np.frombuffer(b"".join(encoded), np.uint8)
        out = np.zeros((len(encoded), len(self.labels)))
        begins = np.concatenate(([0], np.cumsum(lengths)[:-1]))
        pieces = -(-lengths // STRETCH)
        owner = np.repeat(np.arange(len(encoded)), pieces)
        core = (np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * STRETCH
        start, end = np.maximum(core - MARGIN, 0), np.minimum(core + STRETCH + MARGIN, lengths[owner])
        size, skip = end - start, core - start
        order = np.argsort(-size, kind="stable")
        for lo in range(0, len(order), ABREAST):
            pick = order[lo : lo + ABREAST]
            n, t = size[pick], np.arange(size[pick[0]])[:, None]
            codes = buf[begins[owner[pick]] + start[pick] + np.minimum(t, n - 1)]
            inside = (t >= skip[pick]) & (t < np.minimum(skip[pick] + STRETCH, n))
            p = np.where(inside[:, None, :], self.positions(codes, n), 0).sum(axis=0, dtype=np.float64)
            for k in range(len(self.labels)):
                out[:, k] += np.bincount(owner[pick], weights=p[k], minlength=len(encoded))
        return out / np.maximum(lengths, 1)[:, None]

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        names, scores = [], []
        for lo, hi, encoded in chunks(texts):
            letters = [isinstance(t, str) and any(map(str.isalpha, t)) for t in texts[lo:hi]]
            if self.ahead is None:
                names += [UNKNOWN if not x or not self.labels else self.labels[0] for x in letters]
                scores += [1.0 if x and self.labels else 0.0 for x in letters]
                continue
            p = self.pooled(encoded)
            best = p.argmax(axis=1)
            names += [self.labels[k] if x else UNKNOWN for x, k in zip(letters, best, strict=True)]
            scores += [float(min(1.0, v)) if x else 0.0 for x, v in zip(letters, p.max(axis=1), strict=True)]
        return names, np.array(scores)


def train(texts: list[str], labels: list[str], hidden: int = HIDDEN, epochs: int = EPOCHS, visits: int = VISITS, seed: int = 0) -> LanguageModel:
    """Adam on the mean cross-entropy of all positions of all windows; every language weighs the same.

    Windows cover whole texts: the last one of a text ends where it ends, and a shorter text is repeated to fill one.
    """
    names = sorted(set(labels))
    if len(names) < 2:
        return LanguageModel(names)
    code = {x: i for i, x in enumerate(names)}
    windows, target = [], []
    for text, label in zip(texts, labels, strict=True):
        raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
        for lo in range(0, len(raw), WINDOW):
            lo = max(0, min(lo, len(raw) - WINDOW))
            windows.append(np.resize(raw[lo : lo + WINDOW], WINDOW))
            target.append(code[label])
    if not windows:
        return LanguageModel(names[:1])
    codes, y = np.stack(windows).T, np.array(target)
    weight = (len(y) / (len(names) * np.maximum(np.bincount(y, minlength=len(names)), 1)))[y].astype(np.float32)
    rng = np.random.default_rng(seed)
    draw = lambda *shape, by=0.3: (rng.standard_normal(shape) * by).astype(np.float32)
    params = [draw(256, 2 * hidden), draw(2 * hidden, hidden), draw(256, 2 * hidden), draw(2 * hidden, hidden), draw(len(names), 2 * hidden + 1)]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    batch, step = 128, 0
    epochs = max(1, min(epochs, -(-visits // len(y))))
    total = epochs * -(-len(y) // batch)
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for lo in range(0, len(order), batch):
            pick = order[lo : lo + batch]
            c = np.ascontiguousarray(codes[:, pick])
            model = LanguageModel(names, Direction(params[0], params[1]), Direction(params[2], params[3]), params[4])
            a, kept_a = model.ahead.run(c, keep=True)
            b, kept_b = model.behind.run(c[::-1], keep=True)
            b = b[::-1]
            z = np.einsum("lh,thb->tlb", params[4][:, :hidden], a) + np.einsum("lh,thb->tlb", params[4][:, hidden:-1], b) + params[4][:, -1:]
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[:, y[pick], np.arange(len(pick))] -= 1
            p *= weight[pick] / (len(pick) * len(c))
            d_head = np.concatenate([np.einsum("tlb,thb->lh", p, a), np.einsum("tlb,thb->lh", p, b), p.sum(axis=(0, 2))[:, None]], axis=1)
            da, db = np.einsum("lh,tlb->thb", params[4][:, :hidden], p), np.einsum("lh,tlb->thb", params[4][:, hidden:-1], p)
            gradients = [*model.ahead.back(c, kept_a, da), *model.behind.back(c[::-1], kept_b, db[::-1]), d_head]
            step += 1
            rate = 0.02 * (1 - step / (total + 1))
            for k, g in enumerate(gradients):
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                params[k] = params[k] - (rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return LanguageModel(names, Direction(params[0], params[1]), Direction(params[2], params[3]), params[4])


def fit(docs: DataFrame, per_lang: int = SAMPLE_PER_LANG, epochs: int = EPOCHS, visits: int = VISITS) -> LanguageModel:
    """Learns from text and lang of documents whose crc32(doc_id) mod 4 is not 2.

    The sample: at most ``per_lang`` documents of each language, with their
    whole texts, all of which is trained on.  Rows without text, letters or lang teach nothing.
    """
    known = docs.select("doc_id", "text", "lang").filter(
        F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}") & (crc_mod("doc_id", 4) != 2)
    ).withColumn("rank", F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 40)))
    # twice the wanted share by hash first, so that what is ranked in one place doesn't grow with the table
    share = F.broadcast(known.groupBy("lang").agg((F.lit(2.0 * per_lang * (1 << 40)) / F.count("*")).alias("most")))
    few = known.join(share, "lang").filter(F.col("rank") <= F.col("most"))
    ranked = few.withColumn("n", F.row_number().over(Window.partitionBy("lang").orderBy("rank", "text"))).filter(F.col("n") <= per_lang)
    got = ranked.select("lang", "n", "text").toArrow().to_pandas().sort_values(["lang", "n"], kind="stable")
    return train(list(got["text"]), list(got["lang"]), epochs=epochs, visits=visits)


def label(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """Per row of ``docs``: doc_id, held_out, lang_pred, score.

    The label with the greatest mean probability over all bytes of the whole
    text, and that mean; ``und`` with score 0 for a text that is null or has
    no letter.  A model of one language gives it score 1, of none ``und``.
    Repeated rows are labelled one by one; null ids stay; other columns are
    ignored; an empty table gives no rows.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            names, scores = sent.value.predict(list(b["text"]))
            yield pd.DataFrame({"doc_id": b["doc_id"], "held_out": b["held_out"], "lang_pred": names, "score": scores})

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", (crc_mod("doc_id", 4) == 2).alias("held_out"), "text").mapInPandas(
        run, f"doc_id {kind}, held_out boolean, lang_pred string, score double"
    )
