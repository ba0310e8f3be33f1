"""Near-duplicates by SimHash fingerprints that share blocks, verified by Hamming distance.

A fingerprint of 64 bits is cut into blocks.  Two that differ in at most
DIFFER bits agree in all blocks but DIFFER, so each combination of that many
blocks is a key, and close pairs meet under one of them at least (pigeonhole).
The number of blocks follows the number of distinct fingerprints, so that a key
has more bits than they need to be told apart; it changes the work and never
the result.

Groups of one key are not expanded into pairs.  First the members meet a few
of their own (least, greatest, two by hash), which gives all pairs of groups up
to two members and joins most of a dense one.  Groups whose members then lie in several
components are compared again: those outside of the largest component with all
others, as long as they are few.  Where they are many, each fingerprint
names all values within DIFFER / 2 bits of it: two are linked if, and only if,
they name a common value, so that linking the least under each value takes work
in proportion to the members.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from lectern.llm.common import joined_by_weight, written
from lectern.llm.components import components

WIDTH, SEED, BITS = 4, 42, 64
#: Fingerprints link from so few differing bits.
DIFFER = 4
#: Numbers of blocks to choose from; keys get about BITS / blocks * (blocks - DIFFER) bits.
BLOCKS = (6, 7, 8, 9)
#: Members outside of the largest component of a group up to so many are compared directly, more by values near them.
FEW = 64
#: Shingles hashed at a time, and bytes of a text split at a time.
_SHINGLES, _PIECE = 1 << 15, 1 << 20

_FOLD = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_SPACE = re.compile(rb"[\x20\x09-\x0D]")


def _words(raw: bytes) -> Iterator[list[bytes]]:
    """The folded words of a text, in pieces that end between words."""
    at = 0
    while at < len(raw):
        end = len(raw)
        if at + _PIECE < end and (gap := _SPACE.search(raw, at + _PIECE)):
            end = gap.start()
        yield raw[at:end].translate(_FOLD).split()
        at = end


def _hashes(words: list[bytes], width: int) -> Iterator[np.ndarray]:
    """XXH64 of all shingles of ``width`` words, in bounded arrays."""
    joined, size = b" ".join(words), np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(size + 1) - 1
    starts, ends = (ends - size)[: len(words) - width + 1].tolist(), ends[width - 1 :].tolist()
    for lo in range(0, len(starts), _SHINGLES):
        part = [joined[s:e] for s, e in zip(starts[lo : lo + _SHINGLES], ends[lo : lo + _SHINGLES], strict=True)]
        yield np.fromiter(map(xxhash.xxh64_intdigest, part, itertools.repeat(SEED)), np.uint64, len(part))


def _bits(hashes: np.ndarray) -> np.ndarray:
    return np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)


def fingerprint(raw: bytes | None, width: int = WIDTH) -> int:
    """The fingerprint of a text in UTF-8, as a signed number of 64 bits; a text without words has 0."""
    counts, n, words = np.zeros(BITS, np.int64), 0, []
    for piece in _words(raw or b""):
        words = words + piece
        if len(words) >= width:
            for h in _hashes(words, width):
                counts += _bits(h)
                n += len(h)
            words = words[len(words) - width + 1 :]
    if not n and words:
        counts, n = _bits(np.array([xxhash.xxh64_intdigest(b" ".join(words), SEED)], np.uint64)), 1
    return int(np.packbits(2 * counts > n, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """``(doc_id, fp)`` for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = pa.array((fingerprint(x.as_py(), width) for x in b.column(1)), pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), fps], ["doc_id", "fp"])

    schema = StructType([docs.schema["doc_id"], StructField("fp", LongType())])
    return docs.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(run, schema)


def _signed(x: int) -> int:
    return x - (1 << BITS) if x >> (BITS - 1) else x


def key_masks(blocks: int) -> list[int]:
    """The bits of each combination of ``blocks - DIFFER`` blocks."""
    edges = [round(i * BITS / blocks) for i in range(blocks + 1)]
    masks = [sum(1 << b for b in range(lo, hi)) for lo, hi in itertools.pairwise(edges)]
    return [sum(c) for c in itertools.combinations(masks, blocks - DIFFER)]


def blocks_for(fingerprints: int) -> int:
    """The least number of blocks whose keys could number each fingerprint."""
    return next((k for k in BLOCKS if BITS // k * (k - DIFFER) > fingerprints.bit_length()), BLOCKS[-1])


def _keyed(nodes: DataFrame, blocks: int) -> DataFrame:
    """Each node under each of its keys: ``(combo, key, ...)``."""
    keys = F.array(*[F.col("fp").bitwiseAND(F.lit(_signed(m))) for m in key_masks(blocks)])
    return nodes.select("*", F.posexplode(keys).alias("combo", "key"))


def _close(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b)) <= DIFFER


def _starred(keyed: DataFrame) -> DataFrame:
    """Links ``(a, b)`` of members with the least, the greatest and two others of their groups."""
    by_hash = F.xxhash64("fp")
    groups = keyed.groupBy("combo", "key").agg(
        F.count("*").alias("members"), F.min("fp").alias("h0"), F.max("fp").alias("h1"),
        F.min_by("fp", by_hash).alias("h2"), F.max_by("fp", by_hash).alias("h3"),
    ).filter("members > 1")
    met = keyed.join(groups, ["combo", "key"])
    hub = F.array_distinct(F.filter(F.array("h0", "h1", "h2", "h3"), lambda h: (h != F.col("fp")) & _close(h, F.col("fp"))))
    return met.select("fp", F.explode(hub).alias("hub")).select(F.least("fp", "hub").alias("a"), F.greatest("fp", "hub").alias("b")).distinct()


def _mixed(keyed: DataFrame) -> DataFrame:
    """Groups of more than two with several components: their largest component, and how many members are outside of it."""
    parts = keyed.groupBy("combo", "key", "c").agg(F.count("*").alias("n"))
    groups = parts.groupBy("combo", "key").agg(F.count("*").alias("parts"), F.sum("n").alias("members"), F.max("n").alias("most"), F.max_by("c", F.struct("n", "c")).alias("main"))
    return groups.filter("parts > 1 AND members > 2").select("combo", "key", "main", (F.col("members") - F.col("most")).alias("outside"))


def _across(keyed: DataFrame, mixed: DataFrame) -> DataFrame:
    """All links between different components in groups, comparing the members outside of the largest one with all others."""
    met = keyed.join(mixed, ["combo", "key"])
    strays = met.filter("c <> main").select("combo", "key", F.col("fp").alias("a"), F.col("c").alias("c_a"))
    pairs = strays.join(met.select("combo", "key", F.col("fp").alias("b"), "c"), ["combo", "key"])
    return pairs.filter((F.col("c_a") != F.col("c")) & _close(F.col("a"), F.col("b"))).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def _by_values(fps: DataFrame) -> DataFrame:
    """Links of each fingerprint with the least one that shares a value within DIFFER / 2 bits; all such pairs are close."""
    flips = [sum(1 << b for b in c) for n in range(DIFFER // 2 + 1) for c in itertools.combinations(range(BITS), n)]

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        masks = np.array(flips, np.uint64).view(np.int64)
        for b in batches:
            x = b.column(0).to_numpy(zero_copy_only=False)
            for lo in range(0, len(x), 256):
                part = x[lo : lo + 256]
                yield pa.RecordBatch.from_arrays([pa.array((part[:, None] ^ masks).ravel()), pa.array(np.repeat(part, len(masks)))], ["value", "fp"])

    named = fps.select("fp").mapInArrow(near, "value long, fp long")
    least = named.groupBy("value").agg(F.min("fp").alias("a"), F.max("fp").alias("last")).filter("a <> last").select("value", "a")
    return named.join(least, "value").filter("fp <> a").select("a", F.col("fp").alias("b")).distinct()


def links(nodes: DataFrame, blocks: int | None = None, few: int = FEW) -> DataFrame:
    """Links ``(a, b)`` between distinct fingerprints ``nodes(fp)`` that have the components of all close pairs.

    ``nodes`` should be a table, as it is read several times.
    """
    keyed = _keyed(nodes.select("fp"), blocks or blocks_for(nodes.count()))
    first, _ = written(_starred(keyed))
    known = nodes.select("fp").join(components(first), F.col("fp") == F.col("node"), "left").select("fp", F.coalesce("component", "fp").alias("c"))
    known, _ = written(known)
    keyed = _keyed(known, blocks or blocks_for(nodes.count()))
    mixed, _ = written(_mixed(keyed))
    second, _ = written(_across(keyed, mixed.filter(F.col("outside") <= few)))
    many = mixed.filter(F.col("outside") > few)
    if many.isEmpty():
        return first.unionAll(second)
    third, _ = written(_by_values(keyed.join(many, ["combo", "key"], "left_semi").select("fp").distinct()))
    return first.unionAll(second).unionAll(third)


def near_duplicates(docs: DataFrame, width: int = WIDTH, blocks: int | None = None) -> DataFrame:
    """Per row of ``docs``: doc_id, fingerprint, component_id.

    A text's shingles, with their repeats, are all sequences of ``width``
    words (A-Z folded), joined by spaces; with fewer words the whole sequence;
    without words, or null, the fingerprint is zero and links like any other.
    A bit is 1 if it is set in over half of the shingles' XXH64.  component_id
    is the smallest doc_id reachable over links of at most DIFFER differing
    bits.  Equal rows get equal results, and rows with one doc_id but other
    texts are linked only by their fingerprints.  A null doc_id takes part: its row links others, and its
    component_id is null only if no row in reach has an id.  Other columns
    are ignored; no rows give no rows.  Texts of any length are read in pieces.
    """
    signed, _ = written(fingerprints(docs.select("doc_id", "text"), width))
    nodes, _ = written(signed.groupBy("fp").agg(F.min("doc_id").alias("low"), F.count("*").alias("rows")))
    found = components(links(nodes, blocks))
    placed = nodes.join(found, F.col("fp") == F.col("node"), "left").select("fp", "low", "rows", F.coalesce("component", "fp").alias("c"))
    placed, _ = written(placed)
    lows, _ = written(placed.groupBy("c").agg(F.min("low").alias("component_id"), F.count("*").alias("members")))
    labels, _ = written(joined_by_weight(placed.select("fp", "rows", "c"), lows, ["c"], "members").select("fp", "rows", "component_id"))
    named = joined_by_weight(signed, labels, ["fp"], "rows")
    return named.select("doc_id", F.lower(F.lpad(F.hex("fp"), BITS // 4, "0")).alias("fingerprint"), "component_id")
