"""Homomorphic multiset hash of a document's paragraphs, in DataFrame functions only.

A paragraph (the text between newlines) is hashed to a wide vector: EQUAL_LANES
lanes of 32 bits from its SHA-256, and LIKE_LANES lanes that hold signed counts
of its hashed word shingles.  A document's vector is the sum of its paragraphs'
vectors, each lane modulo a power of two.  So the order of paragraphs does not
matter, and a paragraph is inserted or deleted by adding or subtracting its
vector (``combine``).  The first lanes decide equality; the difference of the
second estimates the share of shingles, counted with repeats, that two texts
have in common.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.llm.common import SPACES

EQUAL_LANES = 8
LIKE_LANES = 128
SHINGLE = 3
_EQUAL_HEX, _LIKE_HEX = 8, 6
_LIKE_POWER = 1 << 4 * _LIKE_HEX
#: Text per bucket of neighbouring ids, in characters ...
BUCKET_CHARS = 8_000_000
#: ... where that gives no more buckets than this, as their bounds are part of the plan; else buckets are larger.
MOST_BUCKETS = 65_536


def _long(hexadecimal: Column) -> Column:
    return F.conv(hexadecimal, 16, 10).cast("long")


def _word_hashes(text: Column) -> Column:
    """The hashed words of all paragraphs, each paragraph followed by SHINGLE - 1 nulls."""
    return F.flatten(F.transform(F.split(text, "\n"), lambda p: F.concat(
        F.transform(F.split(F.btrim(p, F.lit(" \t\x0b\x0c\r")), SPACES), lambda w: F.xxhash64(w)),
        F.array_repeat(F.lit(None).cast("long"), SHINGLE - 1),
    )))


def _equal_codes(text: Column) -> Column:
    """For each paragraph and each of the first lanes, lane * 2^32 + the 32 bits to add."""
    return F.flatten(F.transform(F.split(text, "\n"), lambda p: F.transform(
        F.sequence(F.lit(0), F.lit(EQUAL_LANES - 1)),
        lambda k: k.cast("long") * F.lit(1 << 32) + _long(F.substring(F.sha2(p, 256), k * 8 + 1, F.lit(8))),
    )))


def lane_arrays(rows: DataFrame, keys: list[str], texts: dict[str, str], carried: list[str]) -> DataFrame:
    """``keys``, the lanes of each text column as an array of longs, and ``carried``, an array of longs.

    ``keys`` tell the rows apart; where ``rows`` are partitioned by a subset of
    them, all sums stay in their partition and nothing is shuffled.  ``texts``
    maps text columns, without nulls, to names of results.  ``carried`` are
    long columns, which go through the sums as lanes of their own; a null
    comes out as a null.
    """
    width, word = EQUAL_LANES + LIKE_LANES, F.lit(1 << 32)
    sides = [F.struct(
        F.lit(i * width).alias("base"), F.col(c).alias("text"),
        F.lit(None).cast("array<long>").alias("carried"),
    ) for i, c in enumerate(texts)]
    base = len(texts) * width
    riders = [F.when(F.col(c).isNotNull(), F.array(
        F.lit(2 * i << 32) + F.shiftrightunsigned(F.col(c), 32), F.lit(2 * i + 1 << 32) + F.col(c).bitwiseAND(word - 1),
    )).otherwise(F.array().cast("array<long>")) for i, c in enumerate(carried)]
    sides.append(F.struct(F.lit(base).alias("base"), F.lit(None).cast("string").alias("text"), F.concat(*riders).alias("carried")))
    each = rows.select(*keys, F.explode(F.array(*sides)).alias("s"))
    hashed = each.select(
        *keys, "s.base",
        F.coalesce(_word_hashes(F.col("s.text")), F.array().cast("array<long>")).alias("h"),
        F.coalesce("s.carried", _equal_codes(F.col("s.text"))).alias("codes"),
    ).select(*keys, "base", F.size("h").alias("n"), F.concat("h", "codes").alias("h"))
    at = hashed.select(*keys, "base", "n", "h", F.posexplode("h").alias("i", "c")).filter(F.col("c").isNotNull())
    shingle = F.xxhash64("c", *[F.when(F.col("i") < F.col("n"), F.get("h", F.col("i") + k)) for k in range(1, SHINGLE)])
    split = at.select(*keys, "base", (F.col("i") < F.col("n")).alias("word"), "c", shingle.alias("sh"))
    lane = F.when(F.col("word"), F.lit(EQUAL_LANES) + F.pmod(F.shiftright("sh", 8), F.lit(LIKE_LANES))).otherwise(F.shiftright("c", 32))
    add = F.when(F.col("word"), F.lit(2) * F.col("sh").bitwiseAND(F.lit(1)) - F.lit(1)).otherwise(F.col("c").bitwiseAND(word - 1))
    summed = split.select(*keys, (F.col("base") + lane).cast("int").alias("k"), add.cast("long").alias("add")).groupBy(*keys, "k").agg(F.sum("add").alias("v"))
    gathered = summed.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("k", "v"))).alias("kv")).select(*keys, F.map_from_entries("kv").alias("m"))

    def lanes(first: int, n: int) -> Column:
        return F.transform(F.sequence(F.lit(first), F.lit(first + n - 1)), lambda k: F.coalesce(F.element_at("m", k), F.lit(0)))

    whole = F.transform(F.sequence(F.lit(0), F.lit(len(carried) - 1)), lambda i: (
        F.shiftleft(F.element_at("m", i * 2 + base), 32).bitwiseOR(F.element_at("m", i * 2 + base + 1))
    ))
    return gathered.select(*keys, *[lanes(i * width, width).alias(name) for i, name in enumerate(texts.values())], whole.alias("carried"))


def as_hex(lanes: Column) -> Column:
    """The fingerprint as text: the lanes modulo their powers, in hex."""
    equal = F.transform(F.slice(lanes, 1, EQUAL_LANES), lambda v: F.lpad(F.lower(F.hex(F.pmod(v, F.lit(1 << 32)))), _EQUAL_HEX, "0"))
    like = F.transform(F.slice(lanes, EQUAL_LANES + 1, LIKE_LANES), lambda v: F.lpad(F.lower(F.hex(F.pmod(v, F.lit(_LIKE_POWER)))), _LIKE_HEX, "0"))
    return F.concat(F.array_join(equal, ""), F.array_join(like, ""))


def combine(a: Column, b: Column, sign: int = 1) -> Column:
    """The lanes of the union (or, with sign -1, difference) of two multisets of paragraphs."""
    return F.zip_with(a, b, lambda x, y: x + sign * y)


def likeness(a: Column, b: Column) -> Column:
    """Estimated share of common shingles, counted with repeats (Dice): 1 for equal lanes, 0 where the estimate is not positive."""
    tail = lambda x: F.slice(x, EQUAL_LANES + 1, LIKE_LANES)
    square = lambda x: F.aggregate(x, F.lit(0).cast("double"), lambda s, v: s + v.cast("double") * v.cast("double"))
    apart = square(F.zip_with(tail(a), tail(b), lambda x, y: x - y))
    both = square(tail(a)) + square(tail(b))
    return F.when(a == b, F.lit(1.0)).when(both == 0, F.lit(0.0)).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), 1.0 - apart / both)))


def with_next(docs: DataFrame, bucket_chars: int = BUCKET_CHARS) -> DataFrame:
    """``(bucket, place, doc_id, text, next_text)``: each row and the text of the next one by descending doc_id.

    After the last row comes the first.  Rows with one doc_id follow by text;
    null ids come last; null texts are empty.  One shuffle of the texts: ids
    are cut into buckets at quantiles that are ids of the data, and the row at
    the head of a bucket is sent to the bucket before it as well.
    """
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    total, rows = docs.agg(F.coalesce(F.sum(F.length("text")), F.lit(0)), F.count("*")).first()
    n = min(max(1, total // bucket_chars), MOST_BUCKETS)
    bounds: list[int] = []
    if n > 1:
        shares = [(i + 1) / n for i in range(n)]
        shares[-1] = 1.0
        # a text of so many mean lengths counts so many times, so that buckets hold like amounts of text
        weighed = docs.select(F.explode(F.array_repeat("doc_id", (1 + F.floor(F.length("text") / F.lit(total / rows))).cast("int"))).alias("doc_id"))
        bounds = sorted(set(weighed.agg(F.percentile_approx("doc_id", shares, F.lit(max(10_000, 20 * n)))).first()[0] or []))
    if not bounds:
        top = docs.agg(F.max("doc_id")).first()[0]
        bounds = [] if top is None else [top]
    k = max(1, len(bounds))
    if bounds:
        step = max(1, int(len(bounds) ** 0.5))
        coarse = F.array(*[F.lit(b) for b in bounds[step - 1 :: step]])
        fine = F.array(*[F.lit(b) for b in bounds])
        skip = F.size(F.filter(coarse, lambda b: b < F.col("doc_id"))) * step
        bucket = skip + F.size(F.filter(F.slice(fine, skip + 1, F.lit(step)), lambda b: b < F.col("doc_id")))
        bucket = F.when(F.col("doc_id").isNull(), F.lit(0)).otherwise(bucket)
        is_head = F.coalesce(F.col("doc_id") == F.element_at(fine, F.col("home") + 1), F.lit(False))
    else:
        bucket, is_head = F.lit(0), F.lit(True)
    placed = docs.withColumn("home", bucket)
    at = F.when(is_head, F.array(
        F.struct(F.lit(False).alias("guest"), F.col("home").alias("bucket")),
        F.struct(F.lit(True).alias("guest"), F.pmod(F.col("home") + 1, F.lit(k)).alias("bucket")),
    )).otherwise(F.array(F.struct(F.lit(False).alias("guest"), F.col("home").alias("bucket"))))
    dealt = placed.select("doc_id", "text", F.explode(at).alias("at")).select("at.bucket", "at.guest", "doc_id", "text")
    order = Window.partitionBy("bucket").orderBy("guest", F.col("doc_id").desc_nulls_last(), "text")
    return (
        dealt.withColumn("next_text", F.lead("text").over(order)).withColumn("place", F.row_number().over(order))
        .filter(~F.col("guest")).select("bucket", "place", "doc_id", "text", "next_text")
    )


def fingerprint_edits(docs: DataFrame, bucket_chars: int = BUCKET_CHARS) -> DataFrame:
    """Fingerprints of every text and of its edited text, and how alike they are.

    The edited text is the text whose last floor(n/2) code points give way to
    the first as many (or all) of the next document's.  A null text is empty,
    and an empty text has one empty paragraph; a single row is its own next
    one; order and rows with one doc_id as in ``with_next``; other columns of
    ``docs`` are ignored; no rows give no rows.  doc_id is a whole number.
    """
    half = F.floor(F.length("text") / 2).cast("int")
    rows = with_next(docs, bucket_chars).withColumn(
        "edited", F.concat(F.substring("text", F.lit(1), F.length("text") - half), F.substring("next_text", F.lit(1), half))
    )
    quarters = [_signed(F.substring(F.sha2("edited", 256), 1 + 16 * i, 16)).alias(f"q{i}") for i in range(4)]
    rows = rows.select("bucket", "place", "doc_id", "text", "edited", "next_text", F.length("text").cast("long").alias("n_chars"), *quarters)
    lanes = lane_arrays(
        rows, ["bucket", "place"], {"text": "own", "edited": "changed", "next_text": "following"}, ["doc_id", "n_chars", "q0", "q1", "q2", "q3"],
    )
    digest = F.concat(*[F.lpad(F.lower(F.hex(F.col("carried")[i])), 16, "0") for i in range(2, 6)])
    return lanes.select(
        F.col("carried")[0].alias("doc_id"), F.col("carried")[1].alias("n_chars"), digest.alias("edited_sha256"),
        as_hex(F.col("own")).alias("fingerprint"), as_hex(F.col("changed")).alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("changed")).alias("near_edited"), likeness(F.col("own"), F.col("following")).alias("near_next"),
    )


def _signed(digits: Column) -> Column:
    """16 hex digits as the long with the same bits."""
    return F.shiftleft(_long(F.substring(digits, 1, 8)), 32).bitwiseOR(_long(F.substring(digits, 9, 8)))
