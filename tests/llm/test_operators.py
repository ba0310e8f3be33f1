"""The corpus operators against brute force and on edge cases."""

import hashlib
import math
import random
import zlib

import numpy as np
import pytest

from lectern.llm import components, decontaminate, fingerprint, language, line_dedup, lm, main_text, minhash, packing, quality, url_filter

DOCS = "doc_id long, text string, lang string, n_chars string, component_id int, score string"


def docs_of(spark, texts, ids=None):
    rows = [(i if ids is None else ids[i], t, "en", "x", 1, "y") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


EDGES = [None, "", " \n\t ", "one", "a b c d e f", "a b c d e f", "x" * 50_000, "word " * 5000, "naïve É 日本\r\nß"]


def words_of(text):
    import re

    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


# --- main text ---------------------------------------------------------------------------------


@pytest.mark.parametrize(("html", "text"), [
    (None, ""), ("", ""), ("<html></html>", ""), ("plain &amp; simple", "plain & simple"),
    ("<body><nav><a href=x>Menu</a></nav><article><h1>T</h1><p>a<b>b</b>\n c<br>d</p></article><footer>f</footer></body>", "T ab c d"),
    ("<body><div class=sidebar>s</div><div><p>Some words of a story.<p>And more of it.</div><div id=comments>c</div>", "Some words of a story. And more of it."),
    ("<article>x<script>var a='</p>'</script><form>q</form><style>p{}</style> y</article>", "x y"),
    ("<article><p>never closed", "never closed"),
    ("<article>" + "<div>" * 3000 + "deep", "deep"),
])
def test_main_text(html, text):
    assert main_text.main_text(html) == text


def test_main_text_rows(spark):
    pages = spark.createDataFrame([(1, None, None, "z"), (1, None, None, "z"), (None, "u", "<p>é</p>", "z")], "page_id long, url string, html string, text string")
    got = main_text.extract(pages).collect()
    assert sorted((r.page_id or 0, r.text, r.n_chars) for r in got) == [(0, "é", 1), (1, "", 0), (1, "", 0)]
    assert main_text.extract(pages.limit(0)).count() == 0


# --- language model ----------------------------------------------------------------------------


def exact_lm(texts, held):
    """Scores by counts of token tuples and expectation maximisation over single held-out tokens."""
    tokens = [[*words_of(t), None] for t in texts]
    uni, bi, contexts, total = {}, {}, {}, 0
    for i, ws in enumerate(tokens):
        if not held[i]:
            for v, w in zip([0, *ws], ws, strict=False):
                uni[w], bi[v, w], contexts[v] = uni.get(w, 0) + 1, bi.get((v, w), 0) + 1, contexts.get(v, 0) + 1
                total += 1
    bucket = lambda c: min(1 + int(math.log2(c)), lm.BUCKETS - 1) if c > 0 else 0
    rough = lambda p: 10 ** (-min(round(-math.log10(p) * 20), 299) / 20) if p > 0 else 0.0
    seen = {}
    for (v, w), c in bi.items():
        b = bucket(contexts[v] - 1)
        p2 = rough((c - 1) / max(contexts[v] - 1, 1)) if b else 0.0
        seen.setdefault(b, []).append((p2, rough((uni[w] - 1) / max(total - 1, 1)), 1 / (len(uni) + 1), c))

    def em(rows):
        l = [1 / 3] * 3
        for _ in range(100):
            new = [0.0] * 3
            for *p, c in rows:
                mix = sum(x * y for x, y in zip(l, p, strict=True))
                for k in range(3):
                    new[k] += c * l[k] * p[k] / mix
            l = [x / sum(new) for x in new]
        return l

    whole = em([r for rows in seen.values() for r in rows])
    weights = {}
    for b in range(lm.BUCKETS):
        l = [max(x, 1e-6) for x in (em(seen[b]) if b in seen else whole)]
        l[0] = l[0] if b else 0.0
        weights[b] = [x / sum(l) for x in l]
    for ws in tokens:
        out = 0.0
        for v, w in zip([0, *ws], ws, strict=False):
            c = contexts.get(v, 0)
            l = weights[bucket(c)]
            out += math.log10(l[0] * bi.get((v, w), 0) / max(c, 1) + l[1] * uni.get(w, 0) / total + l[2] / (len(uni) + 1))
        yield out


@pytest.mark.parametrize("tokens_per_shard", [lm.TOKENS_PER_SHARD, 50])
def test_lm_against_brute_force(spark, tokens_per_shard, monkeypatch):
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(60)]
    texts = [*EDGES, *[" ".join(rng.choices(vocabulary, k=rng.randint(1, 60))) for _ in range(80)]]
    got = {r.doc_id: r for r in lm.score(docs_of(spark, texts), tokens_per_shard).collect()}
    held = {i: zlib.crc32(str(i).encode()) % 5 == 1 for i in range(len(texts))}
    counts, total = {}, 0
    for i, t in enumerate(texts):
        if not held[i]:
            for w in [*words_of(t), None]:
                counts[w] = counts.get(w, 0) + 1
                total += 1
    for i, (t, score) in enumerate(zip(texts, exact_lm(texts, held), strict=True)):
        tokens = [*words_of(t), None]
        base = sum(math.log10((counts.get(w, 0) + 0.5) / (total + 0.5 * (len(counts) + 1))) for w in tokens)
        assert (got[i].held_out, got[i].n_tokens, got[i].train_tokens) == (held[i], len(tokens), total)
        assert got[i].n_known == sum(w in counts for w in tokens)
        assert got[i].base_score == pytest.approx(base, abs=1e-6)
        assert got[i].score == pytest.approx(score, rel=1e-6)


def test_lm_text_ids(spark):
    rows = spark.createDataFrame([("a", "x y"), (None, None), ("b", "x y")], "doc_id string, text string")
    assert sorted((r.doc_id or "", r.n_tokens) for r in lm.score(rows).collect()) == [("", 1), ("a", 3), ("b", 3)]


def test_lm_edges(spark):
    assert lm.score(docs_of(spark, ["a"]).limit(0)).count() == 0
    got = lm.score(docs_of(spark, ["a b", "a b", None], [7, 7, None])).collect()
    assert len(got) == 3


def test_weights_by_em():
    rng = np.random.default_rng(0)
    cells = lm.held_out_histogram(np.full(50, 10), np.full(50, 20), rng.integers(1, 9, 50), 10_000)
    weights = lm.learn_weights(*cells, 1e-4)
    assert np.allclose(weights.sum(axis=1), 1)
    assert weights[int(lm.buckets(np.array([19]))[0]), 0] > 0.95


# --- urls --------------------------------------------------------------------------------------


def test_urls_against_brute_force(spark):
    rules = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("a.net", "/e", "block")]
    urls = [None, "", "no scheme", "http://", "HTTP://WWW.Example.COM/en/x", "http://example.com/en", "http://m.example.com/en/1?q#f", "http://example.com",
            "https://notexample.com/en/", "http://x.net/es/", "http://a.net/es/", "http://b.a.net/e#x", "x://y://z.com/a", "http://h.com:80/p", "http://" + "a." * 500 + "com/"]
    pages = spark.createDataFrame([(i, u, "q", "w") for i, u in enumerate(urls)], "page_id long, url string, rule string, host string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge_urls(pages, url_filter.rules_frame(spark, rules)).collect()}
    for i, u in enumerate(urls):
        host = path = ""
        if u and "://" in u:
            rest = u.split("://", 1)[1]
            cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
            host, path = rest[:cut].lower(), rest[cut:]
            path = path[: min([path.find(c) for c in "?#" if c in path] or [len(path)])]
        fit = [r for r in rules if (host == r[0] or host.endswith("." + r[0])) and path.startswith(r[1])]
        best = max(fit, key=lambda r: (len(r[0] + r[1]), len(r[0]), r[2] == "block"), default=None)
        assert got[i] == (host, path, best and best[0] + best[1], best[2] if best else "allow"), u
    assert {r.verdict for r in url_filter.judge_urls(pages, url_filter.rules_frame(spark, [])).collect()} == {"allow"}
    assert url_filter.judge_urls(pages.limit(0), url_filter.rules_frame(spark, rules)).count() == 0


# --- language ----------------------------------------------------------------------------------


def test_language(spark):
    rng = random.Random(1)
    make = {"aa": "lorem ipsum dolor", "bb": "żółw gęś łódź"}
    rows = []
    for i in range(160):
        lang = ("aa", "bb")[i % 2]
        rows.append((i, " ".join(rng.choices(make[lang].split(), k=40)), lang, "x"))
    rows += [(200, None, "aa", "x"), (201, "", None, "x"), (202, "12 34 !", "bb", "x"), (None, "lorem ipsum", None, "x"), (0, rows[0][1], "aa", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")
    got = language.label(docs, language.fit(docs)).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    assert all(by[i].lang_pred == ("aa", "bb")[i % 2] and 0.5 < by[i].score <= 1 for i in range(160))
    assert [by[i].lang_pred for i in (200, 201, 202)] == ["und"] * 3 and by[None].lang_pred == "aa"
    assert language.label(docs, language.fit(docs.limit(0))).filter("lang_pred <> 'und'").count() == 0


def test_language_gradients():
    rng = np.random.default_rng(0)
    d = language.Direction(rng.standard_normal((256, 6)), rng.standard_normal((6, 3)))
    d.table, d.inner = d.table.astype(np.float64), d.inner.astype(np.float64)
    codes, slopes = rng.integers(0, 256, (5, 2)), rng.standard_normal((5, 3, 2))

    def loss():
        return float((d.run(codes)[0].astype(np.float64) * slopes).sum())

    _, saved = d.run(codes, keep=True)
    d_table, d_inner = d.back(codes, saved, slopes)
    for i, j in ((0, 0), (4, 2), (5, 1)):
        old = d.inner[i, j]
        d.inner[i, j] = old + 1e-3
        up = loss()
        d.inner[i, j] = old - 1e-3
        down = loss()
        d.inner[i, j] = old
        assert d_inner[i, j] == pytest.approx((up - down) / 2e-3, rel=0.02, abs=2e-3)


# --- fingerprints ------------------------------------------------------------------------------


@pytest.mark.parametrize("bucket_chars", [8_000_000, 30])
def test_fingerprints(spark, bucket_chars):
    texts = [t for t in EDGES if t is None or len(t) < 1000] + [f"line {i}\nshared line of words\nmore {i}" for i in range(30)] + ["p\nq", "q\np"]
    got = {r.doc_id: r for r in fingerprint.fingerprint_edits(docs_of(spark, texts), bucket_chars).collect()}
    n = len(texts)
    assert len(got) == n
    for i, t in enumerate(texts):
        t, after = t or "", texts[i - 1 if i else n - 1] or ""
        half = len(t) // 2
        edited = t[: len(t) - half] + after[:half]
        assert got[i].n_chars == len(t)
        assert got[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert (got[i].fingerprint == got[i].edited_fingerprint) == (sorted(t.split("\n")) == sorted(edited.split("\n")))
        assert 0 <= got[i].near_edited <= 1 and 0 <= got[i].near_next <= 1
        if t == after:
            assert got[i].near_next == 1 and got[i].fingerprint == got[i - 1 if i else n - 1].fingerprint
    assert got[n - 1].fingerprint == got[n - 2].fingerprint  # order does not matter


def test_next_rows_beside_a_long_text(spark):
    """The characters of one text times the rows exceed 32 bits; buckets still hold each row once and in order."""
    rows = docs_of(spark, ["x" * 1_000_000] + [f"text {i}" for i in range(2_500)])
    got = {r.doc_id: (r.bucket, r.after) for r in fingerprint.with_next(rows, 100_000).selectExpr("bucket", "doc_id", "left(next_text, 9) AS after").collect()}
    assert len(got) == 2_501 and len({b for b, _ in got.values()}) > 1
    assert got[0][1] == "text 2499" and got[1][1] == "x" * 9 and all(got[i][1] == f"text {i - 2}" for i in range(2, 2_501))


def test_fingerprint_rows(spark):
    rows = docs_of(spark, ["a", "a", "b", None], [1, 1, None, -5])
    got = fingerprint.fingerprint_edits(rows).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.n_chars) for r in got) == [(False, -5, 0), (False, 1, 1), (False, 1, 1), (True, 0, 1)]
    assert fingerprint.fingerprint_edits(rows.limit(0)).count() == 0
    assert fingerprint.fingerprint_edits(docs_of(spark, ["alone"])).first().near_next == 1


# --- near-duplicates ---------------------------------------------------------------------------


def exact_components(rows):
    sets, up = [], list(range(len(rows)))
    for _, t in rows:
        w = words_of(t)
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                up[find(i)] = find(j)
    low = {}
    for i, (d, _) in enumerate(rows):
        low[find(i)] = min(low.get(find(i), d), d)
    return {d: (len(sets[i]), low[find(i)]) for i, (d, _) in enumerate(rows)}


def test_near_duplicates_against_brute_force(spark):
    rng = random.Random(5)
    texts = list(EDGES)
    for _ in range(12):
        base = [f"w{rng.randint(0, 400)}" for _ in range(rng.randint(20, 120))]
        for _ in range(6):
            copy = list(base)
            for _ in range(rng.randint(0, 3)):
                copy[rng.randrange(len(copy))] = f"n{rng.randint(0, 10**6)}"
            texts.append(" ".join(copy))
    ids = rng.sample(range(10_000), len(texts))
    rows = list(zip(ids, texts, strict=True))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(docs_of(spark, texts, ids)).collect()}
    assert got == exact_components(rows)


def test_near_duplicates_in_a_crowd(spark):
    # all share boilerplate (150 of 178 shingles, similarity 0.728); 60 pairs among them share 3 more (0.754)
    rng = random.Random(8)
    fresh = lambda n: [f"o{rng.randint(0, 10**12)}" for _ in range(n)]
    common = fresh(154)
    texts = [" ".join(common + fresh(28)) for _ in range(1500)]
    for _ in range(60):
        own = fresh(28)
        texts += [" ".join(common + own), " ".join(common + own[:3] + fresh(25))]
    ids = rng.sample(range(len(texts)), len(texts))
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(docs_of(spark, texts, ids)).collect()}
    assert got == {d: min(d, ids[i ^ 1]) if i >= 1500 else d for i, d in enumerate(ids)}


def test_near_duplicate_rows(spark):
    rows = minhash.near_duplicates(docs_of(spark, ["a b c d e f", "A B c d e f", "a b c d e f", "q r", "q r"], [3, 2, None, 9, 9])).collect()
    got = sorted((r.doc_id is None, r.doc_id or 0, r.component_id, r.kept) for r in rows)
    assert got == [(False, 2, 2, True), (False, 3, 2, False), (False, 9, 9, True), (False, 9, 9, True), (True, 0, None, True)]
    assert minhash.near_duplicates(docs_of(spark, ["a"]).limit(0)).count() == 0


def test_components_of_a_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(1, 200)] + [(500, 501), (7, 7)], "a long, b long")
    got = {r.node: r.component for r in components.components(links).collect()}
    assert got == {**{i: 1 for i in range(1, 201)}, 500: 500, 501: 500}


# --- lines -------------------------------------------------------------------------------------


def exact_lines(rows):
    import re

    key = lambda x: re.sub("[A-Z]", lambda m: m[0].lower(), x.strip(" \t\n\x0b\x0c\r"))
    held = {}
    for d, t in rows:
        for line in (t or "").split("\n"):
            if len(key(line)) >= 20:
                held.setdefault(key(line), set()).add(d)
    out = []
    for d, t in rows:
        lines = (t or "").split("\n")
        keep = [x for x in lines if not (len(held.get(key(x), ())) >= 3 and d != max(held[key(x)]))]
        out.append((d, len(lines), len(lines) - len(keep), "\n".join(keep)))
    return sorted(out)


@pytest.mark.parametrize("repeated", [False, True])
def test_lines_against_brute_force(spark, repeated):
    rng = random.Random(2)
    pool = [f"  A common line of text no {i}\t" for i in range(8)] + ["short", "", "exactly twenty chars", "exactly nineteen ch"]
    texts = [*EDGES, *["\n".join(rng.choices(pool, k=rng.randint(1, 9))) for _ in range(40)]]
    ids = [i // 2 if repeated else i for i in range(len(texts))]
    got = line_dedup.dedup_lines(docs_of(spark, texts, ids))
    assert got.columns == ["doc_id", "lang", "n_chars", "component_id", "score", "text", "n_lines", "n_dropped"]
    assert sorted((r.doc_id, r.n_lines, r.n_dropped, r.text) for r in got.collect()) == exact_lines(list(zip(ids, texts, strict=True)))
    assert line_dedup.dedup_lines(docs_of(spark, ["a"]).limit(0)).count() == 0


# --- packing -----------------------------------------------------------------------------------


def test_bounds_are_optimal():
    import itertools

    rng = random.Random(1)
    for _ in range(60):
        lengths = sorted(rng.sample(range(1, 60), rng.randint(1, 8)))
        counts = [rng.randint(1, 9) for _ in lengths]
        k = rng.randint(1, 4)

        def padding(bounds, lengths=lengths, counts=counts):
            return sum(c * (min(b for b in bounds if b >= x) - x) for x, c in zip(lengths, counts, strict=True))

        best = min(padding([*c, lengths[-1]]) for r in range(min(k, len(lengths))) for c in itertools.combinations(lengths[:-1], r))
        got = packing.bucket_bounds(lengths, counts, k)
        assert len(got) <= k and got == sorted(set(got)) and padding(got) == best


def test_packing(spark):
    texts = [*EDGES, *["w " * (i % 17) for i in range(100)]]
    got = packing.pack(docs_of(spark, texts), n_buckets=4, token_budget=40, chunk_rows=16).collect()
    assert sorted(r.doc_id for r in got) == list(range(len(texts)))
    batches = {}
    for r in got:
        assert r.n_tokens == len(words_of(texts[r.doc_id])) <= r.bucket_tokens
        batches.setdefault(r.batch, []).append(r)
    assert all(len({r.bucket for r in b}) == 1 and (len(b) == 1 or len(b) * b[0].bucket_tokens <= 40) for b in batches.values())
    assert packing.pack(docs_of(spark, ["a"]).limit(0)).count() == 0
    assert packing.pack(docs_of(spark, [None, "a a", "a a"], [None, 1, 1])).count() == 3


# --- decontamination ---------------------------------------------------------------------------


def exact_overlaps(docs, items):
    out = {}
    for d, text in docs:
        h = words_of(text)
        for item, t in items:
            t = words_of(t)
            for shift in range(-len(t) + 1, len(h)):
                n = sum(0 <= shift + i < len(h) and h[shift + i] == x for i, x in enumerate(t))
                if t and n >= 0.75 * len(t) and n > out.get((d, item), (0, 0))[0]:
                    out[d, item] = (n, len(t))
    return out


def test_overlaps_against_brute_force(spark):
    rng = random.Random(4)
    fresh = lambda n: [f"v{rng.randint(0, 5000)}" for _ in range(n)]
    items = [(i, " ".join(fresh(n))) for i, n in enumerate([30, 16, 9, 8, 7, 3, 1])] + [(20, None), (21, "")]
    texts = list(EDGES)
    for _, t in items[:7]:
        for changed in (0, 1, 2):
            w = t.split()
            for p in rng.sample(range(len(w)), min(changed, len(w) // 8)):
                w[p] = "changed"
            texts += [" ".join([*fresh(20), *w, *fresh(5)]), " ".join([*w, *fresh(40)]).upper(), " ".join(fresh(60))]
    docs = docs_of(spark, texts)
    bench = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, doc_id string")
    got = {(r.doc_id, r.item_id): (r.n_matched, r.n_tokens) for r in decontaminate.overlaps(docs, bench).collect()}
    assert got == exact_overlaps(list(enumerate(texts)), items)
    left = decontaminate.decontaminate(docs, bench)
    assert left.columns == docs.columns
    assert {r.doc_id for r in left.collect()} == set(range(len(texts))) - {d for d, _ in got}
    assert decontaminate.overlaps(docs.limit(0), bench).count() == 0
    assert decontaminate.overlaps(docs, bench.limit(0)).count() == 0


def exact_chains(h, t):
    """The score of the best chain of alignments of the tokens ``t`` in ``h`` that share a seed."""
    masks = decontaminate.masks_of(len(t))
    held = lambda w, i, m: all(i + p < len(t) and 0 <= w + i + p < len(h) and h[w + i + p] == t[i + p] for p in m)
    shifts = [w for w in range(-len(t) + 1, len(h)) if any(held(w, i, m) for i in range(len(t)) for m in masks)]
    at = dict.fromkeys(shifts, 0)
    for i, x in enumerate(t):
        at = {w: max(at[v] - abs(v - w) for v in shifts) + (0 <= i + w < len(h) and h[i + w] == x) for w in shifts}
    return max(at.values())


@pytest.mark.parametrize(("passage", "times", "item"), [("a b a k ", 30, "a b x k a y z w"), ("a b a k ", 30, "a b a x a b a k b a k a b a a k"), ("a ", 60, "a a b a a a c a a a a a"), ("a b c d ", 400, "a b c d b c d a b c d e a b c a")])
def test_chains_of_repeated_passages(spark, passage, times, item):
    got = decontaminate.overlaps(docs_of(spark, [passage * times]), spark.createDataFrame([(1, item)], "item_id long, text string")).collect()
    t = item.split()
    best = exact_chains((passage * min(times, 30)).split(), t)
    assert [r.n_matched for r in got] == ([best] if best >= 0.75 * len(t) else [])


def test_overlaps_of_parts_and_shifted_tokens(spark):
    rng = random.Random(9)
    fresh = lambda n: [f"v{rng.randint(0, 10**9)}" for _ in range(n)]
    long, mid = fresh(59), fresh(24)
    around = lambda *parts: " ".join([*fresh(20), *sum(parts, []), *fresh(20)])
    texts = [
        around(long[:44]), around(long[:20], long[39:]), around(mid[:12], ["new"], mid[12:]), around(mid[:12], mid[13:]),
        around(mid[:8], ["new"], mid[8:16], ["more"], mid[16:]),
        around(long[:12]), around(mid[:12], fresh(30), mid[12:]), around(["a"] * 5),
    ]
    items = spark.createDataFrame([(0, " ".join(long)), (1, " ".join(mid)), (2, "a " * 8)], "item_id long, text string")
    got = {(r.doc_id, r.item_id): (r.n_matched, r.n_tokens) for r in decontaminate.overlaps(docs_of(spark, texts), items).collect()}
    assert got == {(0, 0): (44, 59), (1, 0): (21, 59), (2, 1): (23, 24), (3, 1): (22, 24), (4, 1): (22, 24)}


# --- quality -----------------------------------------------------------------------------------


def test_quality(spark):
    rng = random.Random(6)
    good = lambda: " ".join(rng.choices("the cat sat on a mat and saw it".split(), k=30))
    bad = lambda: " ".join(w.upper() + "!!" for w in good().split())
    texts = [good() if i % 3 else bad() for i in range(200)] + EDGES
    docs = docs_of(spark, texts)
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(200)] + [(None, 1, 0), (5, None, 0), (999, 0, 0)], "doc_id long, quality int, toxic int")
    model = quality.fit(docs, labels)
    got = {r.doc_id: r for r in quality.score(docs, model).collect()}
    assert all(got[i].predicted == int(i % 3 > 0) and 0 <= got[i].score <= 1 for i in range(200))
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i in range(len(texts)))
    kept = quality.accepted(docs, model)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i, r in got.items() if r.predicted}
    assert quality.score(docs.limit(0), model).count() == 0
    empty = quality.fit(docs, labels.limit(0))
    assert {r.predicted for r in quality.score(docs, empty).collect()} == {1}


# --- pipeline ----------------------------------------------------------------------------------


def test_pipeline_stages(spark, sf):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    at = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r.doc_id: r.text for r in at.collect()}
        out = stage(spark, at, sf)
        assert out.columns == docs.columns, name
        rows = {r.doc_id: r.text for r in out.collect()}
        assert set(rows) <= set(before)
        if name == "line dedup":
            assert [(d, t) for d, _, _, t in exact_lines(list(before.items()))] == sorted(rows.items())
        elif name == "near-duplicates":
            assert set(rows) == {d for d, (_, c) in exact_components(list(before.items())).items() if d == c}
        elif name == "benchmark decontamination":
            items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
            sure = {d for d, t in before.items() for _, x in items if x in t}
            assert not sure & set(rows)
        at = spark.createDataFrame(out.collect(), docs.schema)
    packed = corpus_pipeline.run(spark, sf).collect()
    assert {r.doc_id for r in packed} == {r.doc_id for r in at.collect()}


# --- what densities, masks and classes promise -------------------------------------------------

STORY = "Some words of a long story that goes on and on, with quite some text in it. " * 4


@pytest.mark.parametrize(("html", "text"), [
    (f'<div class="page has-sidebar"><p>{STORY}</p><p>{STORY}</p></div>', "S S"),
    (f"<div class=sidebar><p>{STORY}<p>{STORY}</div>", "S S"),  # a layout name around all text
    (f"<section id=legal><p>{STORY}<p>{STORY}</section><div>x</div>", "S S"),
    (f"<body><div><p>{STORY}</p><p>{STORY}</p></div><article><h2><a href=x>Teaser</a></h2><p>short one</p></article><article><h2><a href=x>Other</a></h2><p>two</p></article>", "S S"),
    (f"<article><section><p>{STORY}<p>a</section><section><p>{STORY}</section></article>", "S a S"),
    (f'<body><h1>Title</h1><div class=story><p>{STORY}<p>Re.<p>{STORY}</div><div class="site-footer">f</div>', "S Re. S"),
    (f'<article><header><h1>Head</h1></header><p>{STORY}<div class="side-note">note</div><div class=comments><p>{STORY}<p>{STORY}</div></article>', "Head S note"),
    (f"<div><p>{STORY}</p></div><div><p>{STORY}</p></div>", "S S"),  # equal sums
])
def test_densities_choose(html, text):
    got = main_text.main_text(html).replace(STORY.strip(), "S")
    assert got.replace("Title ", "") == text


def test_densities_against_recursion():
    html = "<body><div><p>a <a href=x>link</a> b<br>c</p><ul><li><a>1</a><li>two</ul></div><p>tail <b>bold</b></body>"

    def naive(x):
        counts = [x.chars, x.tags, x.link_chars, x.link_tags] if x.name == "#run" else [0, 0 if x.name[0] == "#" else 1, 0, 0]
        for p in x.parts:
            counts = [m + n for m, n in zip(counts, naive(p), strict=True)]
        return counts

    plain, measured = main_text.parse(html), main_text.parse(html)
    main_text.measure(measured)
    body = next(x for x in main_text.order_of(plain) if x.name == "body")
    share = naive(body)[2] / naive(body)[0]
    assert naive(body)[0] == 19 and share == 5 / 19
    for x, y in zip(main_text.order_of(plain), main_text.order_of(measured), strict=True):
        c, t, lc, lt = naive(x)
        want = c / max(t, 1) * math.log(max(c / max(lc, 1) * max(t, 1) / max(lt, 1), 1)) / math.log(c / max(c - lc, 1) * lc + share * c + math.e)
        assert y.density == pytest.approx(want)
        assert y.total == pytest.approx(sum(p.density for p in y.parts))


def test_long_and_broken_pages():
    import time

    for html in ('<a "' * 250_000, '<a ="' * 200_000, "<a " * 300_000, "<p>" * 100_000, "<b>" * 100_000 + "</i>" * 100_000):
        at = time.time()
        assert main_text.main_text(html) == ""
        assert time.time() - at < 15


def least_changes(masks, n):
    """The least number of changed tokens among ``n`` after which no mask fits anywhere."""
    span = max(m[-1] for m in masks) + 1
    best = {(): 0}
    for _ in range(n):
        new = {}
        for past, cost in best.items():
            for changed in (0, 1):
                window = (*past, changed)
                fits = any(len(window) > m[-1] and not any(window[len(window) - 1 - m[-1] + p] for p in m) for m in masks)
                if not fits:
                    key = window[-(span - 1):] if span > 1 else ()
                    new[key] = min(new.get(key, n + 1), cost + changed)
        best = new
    return min(best.values(), default=n + 1)


@pytest.mark.parametrize("n", [*range(1, 33), 40, 57])
def test_masks_are_complete(n):
    assert least_changes(decontaminate.masks_of(n), n) > n // 4


def test_overlaps_of_three_quarters(spark):
    rng = random.Random(11)
    fresh = lambda n: [f"v{rng.randint(0, 10**9)}" for _ in range(n)]
    items, texts = [], []
    for i, n in enumerate([4, 5, 6, 7, 8, 9, 12, 13, 16, 20, 40, 59]):
        t = fresh(n)
        items.append((i, " ".join(t)))
        w = list(t)
        for p in (range(3, n, 4) if i % 2 else rng.sample(range(n), n // 4)):
            w[p] = "changed"
        texts.append(" ".join([*fresh(9), *w, *fresh(9)]))
    got = {(r.doc_id, r.item_id) for r in decontaminate.overlaps(docs_of(spark, texts), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == {(i, i) for i in range(len(items))}


def test_near_duplicates_of_rows_with_one_id(spark):
    rng = random.Random(12)
    a, b = ([f"w{rng.randint(0, 10**9)}" for _ in range(200)] for _ in range(2))
    near = lambda x: " ".join([*x[:100], "new", *x[101:]])
    docs = docs_of(spark, [" ".join(a), " ".join(b), near(b), near(a)], [1, 1, 2, 3])
    for exact in (False, True):
        assert {(r.doc_id, r.component_id) for r in minhash.near_duplicates(docs, exact=exact).collect()} == {(1, 1), (2, 1), (3, 1)}
