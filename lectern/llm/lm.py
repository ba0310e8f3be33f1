"""Language-model scores by deleted interpolation.

    P(w | v) = l2[b] c(v, w) / c(v) + l1[b] c(w) / N + l0[b] / (V + 1)

mixes maximum-likelihood estimates; the bucket b follows the frequency of the
context v.  The weights l of every bucket are learned by expectation
maximisation on held-out counts: each training token is held out in turn, so
its estimates are those of the training tokens without it.  A text is its words
and one end; the first word's context is a start.

All counts cover all training documents, and there is one way for all sizes.
Documents are encoded in packs.  A pack asks for the counts of its distinct
words and pairs: its own counts of them are dealt to shards by hash, a shard
sums them over all packs and answers each.  With the answers a pack has all
that its documents' scores need, so neither vocabulary nor counts are ever in
one place, and what is sent grows with the distinct words and pairs of packs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import crc_mod, dropped, written
from lectern.llm.tokens import mix64, word_hashes

FOLDS, HELD_OUT = 5, 1
END, START = np.uint64(0x51A7E5EED0000001), np.uint64(0x51A7E5EED0000002)
#: Tokens for each shard; it sees at most so many different words and pairs of packs at once, some 60 bytes each.
TOKENS_PER_SHARD = 3_000_000
#: Bytes of text that are packed together; a longer text is a pack of its own.
PACK_BYTES = 4 << 20
BUCKETS = 24
_STEPS = 20  # cells per factor of ten, for the histogram of estimates
_FLOOR = 15 * _STEPS


def buckets(context: np.ndarray) -> np.ndarray:
    """0 for an unseen context, else one for each power of two of its count."""
    return np.where(context > 0, np.minimum(1 + np.floor(np.log2(np.maximum(context, 1))), BUCKETS - 1), 0).astype(np.int64)


def _cells(p: np.ndarray) -> np.ndarray:
    """Estimates as whole numbers of 1/_STEPS of a factor of ten below 1; 0 becomes _FLOOR."""
    with np.errstate(divide="ignore"):
        return np.where(p > 0, np.minimum(np.rint(-np.log10(p) * _STEPS), _FLOOR - 1), _FLOOR).astype(np.int64)


def learn_weights(cells: np.ndarray, counts: np.ndarray, uniform: float, rounds: int = 100) -> np.ndarray:
    """(BUCKETS, 3) weights of bigram, unigram and uniform estimates, from a histogram of held-out events.

    ``cells``: bucket, cell of the bigram's and cell of the unigram's estimate,
    mixed into one number each.  Buckets without events take the weights of all.
    """
    b, p2, p1 = cells // ((_FLOOR + 1) ** 2), cells // (_FLOOR + 1) % (_FLOOR + 1), cells % (_FLOOR + 1)
    back = lambda x: np.where(x == _FLOOR, 0.0, 10.0 ** (-x / _STEPS))
    estimates = np.stack([np.where(b == 0, 0.0, back(p2)), back(p1), np.full(len(b), uniform)])

    def em(pick: np.ndarray) -> np.ndarray:
        e, n = estimates[:, pick], counts[pick].astype(float)
        weights = np.full(3, 1 / 3)
        for _ in range(rounds):
            share = weights[:, None] * e
            share /= share.sum(axis=0)
            weights = (share * n).sum(axis=1) / n.sum()
        return weights

    out = np.tile([0.0, 0.5, 0.5], (BUCKETS, 1))
    if len(b):
        whole = em(np.arange(len(b)))
        for k in range(BUCKETS):
            pick = np.flatnonzero(b == k)
            out[k] = em(pick) if len(pick) else whole
    # what no held-out event used still gets a little, so that every text has a probability
    out = np.maximum(out, 1e-6)
    out[0, 0] = 0.0
    return out / out.sum(axis=1, keepdims=True)


def held_out_histogram(pair: np.ndarray, context: np.ndarray, word: np.ndarray, n: int, weights: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Cells and counts of training pairs, each with its count taken once less, from their counts; ``weights`` tells how often each is held out."""
    p2 = (pair - 1) / np.maximum(context - 1, 1)
    p1 = (word - 1) / max(n - 1, 1)
    cells = (buckets(context - 1) * (_FLOOR + 1) + _cells(p2)) * (_FLOOR + 1) + _cells(p1)
    keys, at = np.unique(cells, return_inverse=True)
    return keys, np.bincount(at, weights=pair if weights is None else weights, minlength=len(keys))


def log10_mix(weights: np.ndarray, pair: np.ndarray, context: np.ndarray, word: np.ndarray, n: int, v: int) -> np.ndarray:
    out = np.empty(len(word))
    for lo in range(0, len(word), 1 << 18):  # in blocks, for small temporaries
        part = slice(lo, lo + (1 << 18))
        b, c = buckets(context[part]), np.maximum(context[part], 1)
        out[part] = np.log10(weights[b, 0] * pair[part] / c + weights[b, 1] * word[part] / max(n, 1) + weights[b, 2] / (v + 1))
    return out


def _texts(docs: DataFrame) -> DataFrame:
    mod = crc_mod("doc_id", FOLDS)
    return docs.select("doc_id", (mod == HELD_OUT).alias("held_out"), F.coalesce("text", F.lit("")).alias("text"))


def _packs(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, slice]]:
    """Word hashes, first words and the slice of the texts, for about PACK_BYTES at a time."""
    lo, size, part = 0, 0, []
    for i, text in enumerate(texts):
        raw = text.encode("utf-8", "surrogatepass")
        if part and size + len(raw) > PACK_BYTES:
            yield *_hashed(part), slice(lo, i)
            lo, size, part = i, 0, []
        part.append(raw)
        size += len(raw)
    if part:
        yield *_hashed(part), slice(lo, len(texts))


def _hashed(part: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """As word_hashes, in steps of about 1 MB, so that its temporaries stay small."""
    hashes, first, lo = [], [np.zeros(1, np.int64)], 0
    base = 0
    while lo < len(part):
        hi, size = lo, 0
        while hi < len(part) and (hi == lo or size + len(part[hi]) <= 1 << 20):
            size += len(part[hi])
            hi += 1
        h, f = word_hashes(part[lo:hi])
        hashes.append(h)
        first.append(f[1:] + base)
        base += len(h)
        lo = hi
    return np.concatenate(hashes), np.concatenate(first)


def _planes(x: np.ndarray) -> bytes:
    """Whole numbers, byte by byte of significance, compressed."""
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(x.astype("<i8").view(np.uint8).reshape(-1, 8).T).tobytes())


def _unplanes(raw: bytes) -> np.ndarray:
    flat = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), np.uint8)
    return np.ascontiguousarray(flat.reshape(8, -1).T).view("<i8").ravel()


def encoded(texts: DataFrame) -> DataFrame:
    """Packs: their documents, sizes in tokens, distinct words (hashes, ascending) and tokens as places among these."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            row = b.column(0).to_numpy()
            for h, first, at in _packs(b.column(3).to_pylist()):
                sizes = np.diff(first) + 1
                word = np.full(int(sizes.sum()), END)
                inner = np.ones(len(word), bool)
                inner[np.cumsum(sizes) - 1] = False
                word[inner] = h
                vocabulary, places = np.unique(word, return_inverse=True)
                one = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)
                width = at.stop - at.start
                yield pa.RecordBatch.from_arrays([
                    pa.array([row[at.start]], pa.int64()),  # rows are numbered without repeats, so the first one names the pack
                    one(b.column(1).slice(at.start, width)), one(b.column(2).slice(at.start, width)), one(pa.array(sizes, pa.int64())),
                    pa.array([vocabulary.tobytes()], pa.binary()), pa.array([_planes(places)], pa.binary()),
                ], ["pack", "doc_id", "held_out", "sizes", "vocabulary", "places"])

    kind = texts.schema["doc_id"].dataType.simpleString()
    numbered = texts.select(F.monotonically_increasing_id().alias("row"), "doc_id", "held_out", "text")
    return numbered.mapInArrow(run, f"pack long, doc_id array<{kind}>, held_out array<boolean>, sizes array<long>, vocabulary binary, places binary")


class Pack:
    """A pack's tokens ``w``, their contexts ``v`` (``start``: none), its distinct pairs and how often training documents have them."""

    def __init__(self, held: np.ndarray, sizes: np.ndarray, places: np.ndarray, start: int):
        self.w, self.start = places, start
        self.owner = np.repeat(np.arange(len(sizes)), sizes)
        self.training = ~held[self.owner]
        self.v = np.empty_like(places)
        self.v[1:] = places[:-1]
        self.v[np.cumsum(sizes) - sizes] = start
        self.pairs, self.pair = np.unique(self.v * (start + 1) + self.w, return_inverse=True)

    def counts(self) -> np.ndarray:
        """Of the distinct words, then of the distinct pairs."""
        return np.concatenate([np.bincount(self.w[self.training], minlength=self.start), np.bincount(self.pair[self.training], minlength=len(self.pairs))])

    def keys(self, vocabulary: np.ndarray) -> np.ndarray:
        v, w = np.append(vocabulary, START)[self.pairs // (self.start + 1)], vocabulary[self.pairs % (self.start + 1)]
        return np.concatenate([mix64(vocabulary), mix64(mix64(v) * np.uint64(0x9E3779B97F4A7C15) + w)])


def _shards_of(keys: np.ndarray, shards: int) -> np.ndarray:
    return ((keys >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)


def _opened(b: pa.RecordBatch, start: list[int]) -> Iterator[Pack]:
    held, sizes, places = (b.column(b.schema.get_field_index(x)) for x in ("held_out", "sizes", "places"))
    for i in range(b.num_rows):
        yield Pack(held[i].values.to_numpy(zero_copy_only=False).astype(bool), sizes[i].values.to_numpy(), _unplanes(places[i].as_py()), start[i])


def answered(packs: DataFrame, shards: int) -> DataFrame:
    """``(pack, shard, counts, v, n)``: a shard's answer to a pack, and with a null pack its number of training words, distinct and in all."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names, words = b.column(0), [np.frombuffer(x.as_py(), np.uint64) for x in b.column(b.schema.get_field_index("vocabulary"))]
            for i, pack in enumerate(_opened(b, [len(x) for x in words])):
                keys, counts = pack.keys(words[i]), pack.counts()
                shard = _shards_of(keys, shards)
                order = np.argsort(shard, kind="stable")
                cuts = np.searchsorted(shard[order], np.arange(shards + 1)) if shards < len(keys) else None
                used = np.unique(shard) if cuts is None else np.flatnonzero(np.diff(cuts))
                lo, hi = (cuts[used], cuts[used + 1]) if cuts is not None else (np.searchsorted(shard[order], used), np.searchsorted(shard[order], used, "right"))
                parts = [order[x:y] for x, y in zip(lo, hi, strict=True)]
                yield pa.RecordBatch.from_arrays([
                    pa.array(used, pa.int64()), pa.array(np.full(len(used), names[i].as_py()), pa.int64()),
                    pa.array([int((p < len(words[i])).sum()) for p in parts], pa.int64()),
                    pa.array([keys[p].tobytes() for p in parts], pa.binary()), pa.array([_planes(counts[p]) for p in parts], pa.binary()),
                ], ["shard", "pack", "words", "keys", "counts"])

    def total(table: pa.Table) -> pa.Table:
        raw = table.column("keys").to_pylist()
        sizes = np.array([len(x) // 8 for x in raw])
        keys = np.frombuffer(b"".join(raw), np.uint64)
        del raw
        counts = np.concatenate([_unplanes(x) for x in table.column("counts").to_pylist()])
        ends = np.cumsum(sizes)
        is_word = np.arange(len(keys)) - np.repeat(ends - sizes, sizes) < np.repeat(table.column("words").to_numpy(), sizes)
        distinct, at = np.unique(keys, return_inverse=True)
        # sums of whole numbers: exact, as they are below 2^53
        sums = np.bincount(at, weights=counts, minlength=len(distinct)).astype(np.int64)
        of_words = np.zeros(len(distinct), bool)
        of_words[at[is_word]] = True
        known = sums[of_words & (sums > 0)]
        every = sums[at]
        shard = table.column("shard")[0].as_py()
        return pa.table({
            "pack": pa.array([*table.column("pack").to_pylist(), None], pa.int64()), "shard": pa.array([shard] * (len(sizes) + 1), pa.int64()),
            "counts": pa.array([*[_planes(every[e - n : e]) for e, n in zip(ends, sizes, strict=True)], None], pa.binary()),
            "v": pa.array([*[None] * len(sizes), len(known)], pa.int64()), "n": pa.array([*[None] * len(sizes), int(known.sum())], pa.int64()),
        })

    asked = packs.mapInArrow(ask, "shard long, pack long, words long, keys binary, counts binary")
    return asked.groupBy("shard").applyInArrow(total, "pack long, shard long, counts binary, v long, n long")


def counted(packs: DataFrame, answers: DataFrame, shards: int) -> DataFrame:
    """Packs without words, with ``known``: the training counts of their distinct words, then of their distinct pairs."""
    each = answers.filter(F.col("pack").isNotNull()).groupBy("pack").agg(F.sort_array(F.collect_list(F.struct("shard", "counts"))).alias("answers"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words = [np.frombuffer(x.as_py(), np.uint64) for x in b.column(b.schema.get_field_index("vocabulary"))]
            got, known = b.column(b.schema.get_field_index("answers")), []
            for i, pack in enumerate(_opened(b, [len(x) for x in words])):
                order = np.argsort(_shards_of(pack.keys(words[i]), shards), kind="stable")
                out = np.empty(len(order), np.int64)
                out[order] = np.concatenate([_unplanes(x["counts"].as_py()) for x in got[i]])
                known.append(_planes(out))
            kept = [b.column(b.schema.get_field_index(x)) for x in ("doc_id", "held_out", "sizes", "places")]
            yield pa.RecordBatch.from_arrays(
                [*kept, pa.array([len(x) for x in words], pa.int64()), pa.array(known, pa.binary())], ["doc_id", "held_out", "sizes", "places", "start", "known"]
            )

    kind = packs.schema["doc_id"].dataType.simpleString()
    return packs.join(each, "pack").mapInArrow(run, f"doc_id {kind}, held_out array<boolean>, sizes array<long>, places binary, start long, known binary")


def _with_counts(b: pa.RecordBatch) -> Iterator[tuple[int, Pack, np.ndarray, np.ndarray]]:
    """Number, pack, and the training counts of its words and of its distinct pairs."""
    start, known = b.column(b.schema.get_field_index("start")).to_pylist(), b.column(b.schema.get_field_index("known"))
    for i, pack in enumerate(_opened(b, start)):
        c = _unplanes(known[i].as_py())
        yield i, pack, c[: pack.start], c[pack.start :]


def score(docs: DataFrame, tokens_per_shard: int = TOKENS_PER_SHARD) -> DataFrame:
    """Per row of ``docs``: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Learns from documents whose crc32(doc_id) mod 5 is not 1.  A null text is
    empty: one end.  Without training documents every estimate but the uniform
    is 0.  Repeated rows are scored, and counted, one by one; null ids are
    scored like any other; ids may be of any type; other columns are ignored;
    no rows give none.
    """
    packs, packs_at = written(encoded(_texts(docs)))
    tokens = packs.select(F.sum(F.aggregate("sizes", F.lit(0).cast("long"), lambda s, x: s + x))).first()[0] or 0
    shards = max(1, -(-tokens // tokens_per_shard))
    answers, answers_at = written(answered(packs, shards))
    facts = answers.filter(F.col("pack").isNull()).agg(F.coalesce(F.sum("v"), F.lit(0)), F.coalesce(F.sum("n"), F.lit(0))).first()
    distinct, total = int(facts[0]), int(facts[1])
    ready, _ = written(counted(packs, answers, shards))
    dropped(docs.sparkSession, packs_at, answers_at)
    training = _texts(docs).filter(~F.col("held_out")).count()

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for _, pack, words, pairs in _with_counts(b):
                own = pack.counts()[pack.start :]
                pick = np.flatnonzero(own)
                v, w = pack.pairs[pick] // (pack.start + 1), pack.pairs[pick] % (pack.start + 1)
                k, n = held_out_histogram(pairs[pick], np.append(words, training)[v], words[w], total, own[pick])
                yield pa.RecordBatch.from_arrays([pa.array(k, pa.int64()), pa.array(n.astype(np.int64), pa.int64())], ["cell", "n"])

    # bounded by the number of cells
    seen = ready.mapInArrow(cells, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).orderBy("cell").toArrow()
    weights = learn_weights(seen["cell"].to_numpy(), seen["n"].to_numpy(), 1.0 / (distinct + 1))

    def scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, pack, words, pairs in _with_counts(b):
                v, w = pack.pairs // (pack.start + 1), pack.pairs % (pack.start + 1)
                p = log10_mix(weights, pairs, np.append(words, training)[v], words[w], total, distinct)
                sizes = b.column(2)[i].values
                n = len(sizes)
                base = np.log10((words + 0.5) / (total + 0.5 * (distinct + 1)))
                add = lambda x: np.bincount(pack.owner, weights=x, minlength=n)  # noqa: B023, E731
                yield pa.RecordBatch.from_arrays([
                    b.column(0)[i].values, b.column(1)[i].values, sizes, pa.array(add((words > 0)[pack.w]).astype(np.int64)),
                    pa.array(np.full(n, total), pa.int64()), pa.array(add(base[pack.w])), pa.array(add(p[pack.pair])),
                ], ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return ready.mapInArrow(scores, f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
