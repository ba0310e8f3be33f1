"""Vectorised word and shingle hashing over batches of whole texts.

Words are the maximal runs of bytes outside ``[\\x20\\x09-\\x0D]`` of the UTF-8
text, with A-Z folded to a-z.  Everything below works on one flat byte buffer
per batch, so the cost is a few numpy passes and no Python loop over words.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np

#: Bytes of text handled per numpy pass; bounds the temporaries to ~50x this.
CHUNK_BYTES = 1 << 20

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_STEP = np.uint64(0x9E3779B97F4A7C15)


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (two xor-shift-multiply rounds) on uint64 arrays."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


_BYTE = mix64(np.arange(1, 257, dtype=np.uint64) * _STEP)
_POWERS = np.cumprod(np.full(64, np.uint64(0xF1357AEA2E62A9C5)), dtype=np.uint64)


def _powers(n: int) -> np.ndarray:
    global _POWERS
    if n > len(_POWERS):
        _POWERS = np.cumprod(np.full(2 * n, np.uint64(0xF1357AEA2E62A9C5)), dtype=np.uint64)
    return _POWERS


def chunks(texts: Sequence[str | None]) -> Iterator[tuple[int, int, list[bytes]]]:
    """Consecutive slices ``(lo, hi, encoded)`` of about CHUNK_BYTES; a longer text is a slice of its own."""
    lo, size, part = 0, 0, []
    for i, text in enumerate(texts):
        raw = text.encode("utf-8", "surrogatepass") if isinstance(text, str) else b""
        if part and size + len(raw) > CHUNK_BYTES:
            yield lo, i, part
            lo, size, part = i, 0, []
        part.append(raw)
        size += len(raw) + 1
    if part:
        yield lo, len(texts), part


def word_spans(encoded: Sequence[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``(buffer, starts, ends, first)``: folded bytes, word byte spans, and each text's first word index (n + 1 entries)."""
    buf = _FOLD[np.frombuffer(b"\n".join(encoded) + b"\n", dtype=np.uint8)]
    space = _SPACE[buf]
    edge = np.flatnonzero(np.diff(np.concatenate(([True], space)).view(np.int8)))
    starts, ends = edge[0::2], edge[1::2]
    begins = np.concatenate(([0], np.cumsum([len(x) + 1 for x in encoded])))
    return buf, starts, ends, np.searchsorted(starts, begins)


def word_hashes(encoded: Sequence[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """``(hashes, first)``: a uint64 per word, and each text's first word index (n + 1 entries)."""
    buf, starts, ends, first = word_spans(encoded)
    if not len(starts):
        return np.zeros(0, np.uint64), first
    length = ends - starts
    inside = ~_SPACE[buf]
    place = np.arange(int(length.sum())) - np.repeat(np.concatenate(([0], np.cumsum(length)[:-1])), length)
    terms = _BYTE[buf[inside]] * _powers(int(length.max()) + 1)[place]
    sums = np.add.reduceat(terms, np.concatenate(([0], np.cumsum(length)[:-1])))
    return mix64(sums), first


def shingles(words: np.ndarray, width: int) -> np.ndarray:
    """Distinct hashes of ``width`` consecutive words; fewer words give one shingle, no words none."""
    n = len(words)
    if not n:
        return words
    w = min(width, n)
    out = np.full(n - w + 1, np.uint64(w), dtype=np.uint64)
    for j in range(w):
        out = out * np.uint64(0xFF51AFD7ED558CCD) + words[j : n - w + 1 + j]
    return np.unique(mix64(out))
