"""Hard negatives against brute force and on edge cases."""

import math
import random

import numpy as np
import pytest

from lectern.llm import negatives

ROWS = "vec_id long, embedding array<float>, label int, uid string, k int"


def brute(rows, every=100):
    """``rows``: (vec_id, embedding, label)."""
    kept = []
    for id_, v, label in rows:
        if id_ is None or label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        kept.append((id_, (label + 1) % 10 if id_ % 7 == 0 else label, [math.floor(256 * float(np.float32(x))) for x in v]))
    out = []
    for n, (a, label, v) in enumerate(kept):
        if a % every:
            continue
        scored = [(-sum(x * y for x, y in zip(v, w, strict=False)), b, other == label) for m, (b, other, w) in enumerate(kept) if m != n]
        for p, positive, _ in sorted(x for x in scored if x[2])[:5]:
            inside = sorted(x for x in scored if not x[2] and 80 * -p <= 100 * -x[0] <= 100 * -p)[:5]
            out += [(a, positive, i, b, -p, -s) for i, (s, b, _) in enumerate(inside, 1)]
    return sorted(out)


def mined(spark, rows, **how):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], ROWS)
    return sorted(tuple(r) for r in negatives.hard_negatives(df, **how).collect())


def drawn(n, width, seed):
    pick = random.Random(seed)
    return [(i, [pick.gauss(0.1, 0.3) for _ in range(width)], pick.randrange(3)) for i in range(n)]


@pytest.mark.parametrize(("bits", "slice_rows"), [(6, 1 << 15), (1, 2), (8, 1)])
def test_against_brute_force(spark, bits, slice_rows):
    rows = drawn(420, 8, bits)
    assert mined(spark, rows, bits=bits, slice_rows=slice_rows) == brute(rows)


def test_edges(spark):
    rows = [
        *drawn(60, 4, 9), (100, [0.5, 0.5, 0.5, 0.5], 1), (100, [0.5, 0.5, 0.5, 0.5], 1),  # repeated anchors
        (101, [0.5, 0.5, 0.5, 0.5], 1), (102, [0.5, 0.5, 0.5, 0.5], 2), (103, [0.5, 0.5, 0.5, 0.5], 2), (102, [0.5, 0.5, 0.5, 0.5], 2),  # ties and repeats
        (104, None, 1), (105, [0.1, None, 0.1, 0.1], 1), (106, [float("nan")] * 4, 1), (107, [float("inf")] * 4, 1), (108, [0.1] * 4, None), (None, [0.1] * 4, 1),
        (109, [], 2), (110, [0.9], 2), (200, [], 2), (300, [-1.0] * 4, 1), (400, [5.0, -3.0, 2.0, 0.1], 8),
    ]
    assert mined(spark, rows) == brute(rows)
    assert mined(spark, []) == []
    assert mined(spark, [(0, [], 1), (1, [], 1), (2, [], 2)]) == brute([(0, [], 1), (1, [], 1), (2, [], 2)])


def test_hot_vector_and_label(spark):
    rows = [*drawn(100, 6, 3), *[(200 + i, [0.25] * 6, 1 if i % 3 else 2) for i in range(300)]]
    assert mined(spark, rows) == brute(rows)


def test_bounds_hold_and_prune():
    pick = np.random.default_rng(1)
    m = pick.normal(0, 30, (2000, 16)).astype(np.int64)
    edges = np.quantile(m, np.linspace(0, 1, 65), axis=0, method="lower").T.astype(np.int64)
    cells = negatives.cells_of(m, edges)
    at = (np.arange(16) * 64)[:, None] + cells.T
    lower, upper = negatives.bounds(at, negatives.lookup_tables(m[0], edges))
    exact = m @ m[0]
    assert (lower <= exact).all() and (exact <= upper).all()
    near = negatives.possible(lower, upper, np.ones(2000, bool), 5)
    assert set(np.argsort(-exact)[:5]) <= set(near) and len(near) < 100


def test_large_components_raise(spark):
    with pytest.raises(ArithmeticError):
        mined(spark, [(0, [1e12], 1), (1, [1e12], 1)])
