"""Packing into length buckets that minimise padding, and token-budget batches inside each.

A dynamic programme over the histogram of all lengths chooses the upper bounds
of the buckets; every document is padded to its bucket's bound.  A batch holds
as many documents of one bucket as fit the token budget at that bound.
"""

from __future__ import annotations

from collections import deque

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.llm.common import words

N_BUCKETS = 8
TOKEN_BUDGET = 32_768
#: Rows that are ranked together when batches are formed; one batch at most stays unfilled for each so many.
CHUNK_ROWS = 20_000
#: Lengths are exact below 2^EXACT_BITS, beyond that rounded up to EXACT_BITS leading bits: so the histogram is bounded.
EXACT_BITS = 16


def rounded_up(n: Column) -> Column:
    shift = F.greatest(F.length(F.bin(n)) - EXACT_BITS, F.lit(0))
    unit = F.pow(F.lit(2.0), shift).cast("long")
    return (F.ceil(n / unit) * unit).cast("long")


def bucket_bounds(lengths: list[int], counts: list[int], n_buckets: int) -> list[int]:
    """At most ``n_buckets`` upper bounds, the last of them the greatest length, with the least total padding.

    ``lengths`` ascend.  Of equally good choices the one with fewer buckets is
    taken.  Each layer is a lower envelope of lines (slope: minus the count
    before the bucket; x: the bound), so the cost is lengths x buckets.
    """
    n = len(lengths)
    if not n:
        return []
    before = [0]
    for c in counts:
        before.append(before[-1] + c)
    cost: list[float] = [0] + [float("inf")] * n
    back: list[list[int]] = []
    ends = []
    for _ in range(min(n_buckets, n)):
        hull: deque[tuple[int, float, int]] = deque()  # slope, intercept, start
        new: list[float] = [float("inf")] * (n + 1)
        start = [0] * (n + 1)
        for j in range(1, n + 1):
            if cost[j - 1] != float("inf"):
                m, b = -before[j - 1], cost[j - 1]
                while len(hull) > 1 and (hull[-1][1] - hull[-2][1]) * (hull[-2][0] - m) >= (b - hull[-2][1]) * (hull[-2][0] - hull[-1][0]):
                    hull.pop()
                hull.append((m, b, j - 1))
            x = lengths[j - 1]
            while len(hull) > 1 and hull[0][0] * x + hull[0][1] > hull[1][0] * x + hull[1][1]:
                hull.popleft()
            if hull:
                new[j] = hull[0][0] * x + hull[0][1] + x * before[j]
                start[j] = hull[0][2]
        back.append(start)
        ends.append(new[n])
        cost = new
    layer = min(range(len(ends)), key=lambda k: (ends[k], k))
    bounds, j = [], n
    while layer >= 0:
        bounds.append(lengths[j - 1])
        j, layer = back[layer][j], layer - 1
    return bounds[::-1]


def pack(docs: DataFrame, n_buckets: int = N_BUCKETS, token_budget: int = TOKEN_BUDGET, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Per row of ``docs``: doc_id, n_tokens, bucket, bucket_tokens (its bound), batch.

    Tokens are the words of the text; a null text has none.  Each row is in
    one batch of its bucket, in order of doc_id inside chunks dealt by its
    hash; a batch times its bound fits ``token_budget``, unless one document
    is longer than that and is a batch of its own.  Rows with one doc_id are
    packed one by one, null ids among them; other columns are ignored; no
    rows give no rows.
    """
    sized = docs.select("doc_id", F.size(words(F.col("text"))).cast("long").alias("n_tokens")).withColumn("top", rounded_up(F.col("n_tokens")))
    histogram = sorted(tuple(r) for r in sized.groupBy("top").count().collect())  # bounded by EXACT_BITS
    bounds = bucket_bounds([r[0] for r in histogram], [r[1] for r in histogram], n_buckets) or [0]
    chunks, at = [], 0
    for bound in bounds:
        rows = 0
        while at < len(histogram) and histogram[at][0] <= bound:
            rows += histogram[at][1]
            at += 1
        chunks.append(max(1, -(-rows // chunk_rows)))
    known = F.array(*[F.lit(b).cast("long") for b in bounds])
    dealt = (
        sized.withColumn("bucket", F.size(F.filter(known, lambda b: b < F.col("top"))))
        .withColumn("bucket_tokens", F.element_at(known, F.col("bucket") + 1))
        .withColumn("chunk", F.pmod(F.xxhash64("doc_id"), F.element_at(F.array(*[F.lit(c) for c in chunks]), F.col("bucket") + 1)))
    )
    place = F.row_number().over(Window.partitionBy("bucket", "chunk").orderBy("doc_id", "n_tokens")) - 1
    fits = F.greatest(F.lit(1), F.floor(F.lit(token_budget) / F.greatest(F.lit(1), F.col("bucket_tokens"))))
    return dealt.withColumn("batch", F.concat_ws("-", "bucket", "chunk", F.floor(place / fits).cast("long"))).select(
        "doc_id", "n_tokens", "bucket", "bucket_tokens", "batch"
    )
