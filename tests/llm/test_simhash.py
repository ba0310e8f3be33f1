"""SimHash near-duplicates against brute force and on edge cases."""

import random

import pytest
import xxhash
from test_operators import DOCS, EDGES, docs_of, words_of

from lectern.llm import simhash


def exact_fingerprint(text, width=4):
    words = words_of(text)
    if not words:
        return 0
    parts = [" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))]
    hashes = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def exact_components(rows):
    """``rows``: (id, fingerprint).  Per row the least id in reach over links of at most 4 bits."""
    distinct = sorted({fp for _, fp in rows})
    root = {fp: fp for fp in distinct}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for i, a in enumerate(distinct):
        for b in distinct[:i]:
            if (a ^ b).bit_count() <= 4:
                root[find(a)] = find(b)
    low = {}
    for id_, fp in rows:
        if id_ is not None:
            low[find(fp)] = min(low.get(find(fp), id_), id_)
    return [(id_, f"{fp:016x}", low.get(find(fp))) for id_, fp in rows]


def order(rows):
    return sorted(((r[0] is None, r[0] or 0, r[1], r[2] or 0) for r in rows))


def got_of(df):
    return order([(r.doc_id, r.fingerprint, r.component_id) for r in df.collect()])


@pytest.mark.parametrize("text", [*EDGES, "A b C", "one two three four", "É é " * 9, "x y z"])
def test_fingerprint(text):
    assert simhash.fingerprint(text and text.encode()) % (1 << 64) == exact_fingerprint(text)


def test_long_texts_are_read_in_pieces(monkeypatch):
    text = " ".join(random.Random(1).choice("ab cd EF ghi jklm".split()) for _ in range(3000))
    whole = simhash.fingerprint(text.encode())
    monkeypatch.setattr(simhash, "_PIECE", 50)
    monkeypatch.setattr(simhash, "_SHINGLES", 7)
    assert simhash.fingerprint(text.encode()) == whole


def test_whole_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [(r.doc_id, exact_fingerprint(r.text)) for r in docs.select("doc_id", "text").collect()]
    assert got_of(simhash.near_duplicates(docs)) == order(exact_components(rows))


def test_edges(spark):
    texts = [*EDGES, *EDGES]
    ids = [None, *range(1, len(texts))]
    got = got_of(simhash.near_duplicates(docs_of(spark, texts, ids)))
    assert got == order(exact_components([(i, exact_fingerprint(t)) for i, t in zip(ids, texts, strict=True)]))
    assert simhash.near_duplicates(spark.createDataFrame([], DOCS)).count() == 0


def clouds(seed, n):
    """Fingerprints in dense clouds, with chains of links between and strays beside them."""
    pick = random.Random(seed)
    out = set()
    for _ in range(4):
        centre = pick.getrandbits(64)
        for _ in range(n):
            x = centre
            for b in pick.sample(range(64), pick.choice([1, 2, 3, 5, 7])):
                x ^= 1 << b
            out.add(x)
        for _ in range(10):  # a chain that leaves the cloud, four bits a step
            for b in pick.sample(range(64), 4):
                centre ^= 1 << b
            out.add(centre)
    return sorted({*out, *(pick.getrandbits(64) for _ in range(50))})


@pytest.mark.parametrize(("blocks", "few"), [(6, 64), (6, 0), (8, 3), (9, 64)])
def test_no_link_between_components_is_lost(spark, blocks, few):
    fps = clouds(blocks + few, 60)
    nodes = spark.createDataFrame([(x - (1 << 64) if x >> 63 else x,) for x in fps], "fp long")
    found = simhash.components(simhash.links(nodes, blocks, few))
    of = {r.node % (1 << 64): r.component for r in found.collect()}
    groups = {}
    for x in fps:
        groups.setdefault(of.get(x, x), []).append(x)
    exact = {}
    for x, _, low in exact_components([(x, x) for x in fps]):
        exact.setdefault(low, []).append(x)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, exact.values()))


def test_any_close_pair_shares_a_key():
    pick = random.Random(5)
    for blocks in simhash.BLOCKS:
        masks = simhash.key_masks(blocks)
        for _ in range(200):
            flip = sum(1 << b for b in pick.sample(range(64), 4))
            assert any(not flip & m for m in masks)
    assert [simhash.blocks_for(n) for n in (10, 10**6, 10**7, 10**9, 10**12)] == [6, 7, 7, 8, 9]
