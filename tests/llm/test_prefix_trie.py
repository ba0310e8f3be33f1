"""The trie of conversation prefixes against brute force and on edge cases."""

import hashlib
import random
import zlib

import pytest

from lectern.llm import prefix_trie

ROWS = "conv_id long, turn long, role string, text string, depth int, key string"


def brute(rows):
    """``rows``: (conv_id, turn, role, text)."""
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            tie = hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest()
            own.setdefault(c, []).append((turn is not None, turn or 0, role, tie, text))
    own = {c: [(x[2], x[4]) for x in sorted(turns)] for c, turns in own.items()}
    paths = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - (abs(c) % 100) * (1 if c >= 0 else -1)
        paths[c] = tuple(own.get(base, [])[:h] + turns[h:])
    members, kids = {}, {}
    for c, path in paths.items():
        for d in range(len(path) + 1):
            members.setdefault(path[:d], []).append(c)
    for path in members:
        if path:
            kids.setdefault(path[:-1], []).append(path)
    totals = {}
    for path in sorted(members, key=len, reverse=True):
        below = [totals[k] for k in kids.get(path, [])]
        saved = (len(members[path]) - 1) * len(path[-1][1]) if path else 0
        totals[path] = (sum(x[0] for x in below) or 1, saved + sum(x[1] for x in below))
    out = []
    for path, who in members.items():
        ends = ",".join(str(c) for c in sorted(who) if len(paths[c]) == len(path))
        parent = min(members[path[:-1]]) if path else None
        out.append((min(who), len(path), parent, len(who), len(kids.get(path, [])), *totals[path], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def built(spark, rows, **how):
    df = spark.createDataFrame([(*r, 1, "k") for r in rows], ROWS)
    return sorted((tuple(r) for r in prefix_trie.prefix_trie(df, **how).collect()), key=str)


def drawn(seed, n):
    pick = random.Random(seed)
    rows = []
    for c in range(n):
        c = c * 7 + 90
        rows += [(c, t, pick.choice(["user", "assistant", None]), pick.choice(["a", "bb", "", "ccc", None])) for t in range(pick.randrange(1, 9))]
    pick.shuffle(rows)
    return rows


@pytest.mark.parametrize("segment", [1 << 16, 3, 1])
def test_against_brute_force(spark, segment):
    rows = drawn(segment, 60)
    assert built(spark, rows, segment=segment) == brute(rows)


def test_edges(spark):
    hot = [(400, t, "user", "again") for t in range(40)] + [(c, t, "user", "again") for c in (401, 402, 455) for t in range(45)]
    same = [(c, t, "u", "hello") for c in range(1000, 1060) for t in range(2)]
    rows = [
        *hot, *same, (None, 0, "u", "x"), (-5, None, None, None), (-5, 1, "u", "y"), (-5, None, "a", "z"), (-105, 0, "u", "é日本"),
        (7, 1, "a", "tie"), (7, 1, "b", "tie"), (7, 1, "a", "tie"), (9, 0, "x" * 3, "word " * 20_000), (10, 0, "xxxw", "ord " + "word " * 19_999),
    ]
    assert built(spark, rows, segment=4) == brute(rows)
    assert built(spark, []) == []
    assert built(spark, [(None, 1, "u", "x")]) == []


def test_merge_compares_less_and_keeps_order():
    pick = random.Random(2)
    strings = [b"".join(bytes([pick.randrange(3)]) * 16 for _ in range(pick.randrange(6))) for _ in range(300)]
    runs = []
    for lo in range(0, 300, 37):
        part = strings[lo : lo + 37]
        order, lcps = prefix_trie.sorted_run(part)
        runs.append(([part[i] for i in order], lcps))
    got, lcps = [], []
    for r, place, lcp in prefix_trie.merged(runs):
        got.append(runs[r][0][place])
        lcps.append(lcp)
    assert got == sorted(strings)
    assert lcps == [0, *(prefix_trie.shared(a, b) for a, b in zip(got, got[1:], strict=False))]
    assert list(prefix_trie.merged([])) == []
