"""The network and the classifier against plain versions, their limits, and what they reach on documents that they didn't learn from."""

import zlib

import numpy as np
import pandas as pd
import pytest

from lectern.llm import language, quality


def model_of(seed, labels=3, hidden=4):
    rng = np.random.default_rng(seed)
    one = lambda: language.Direction(rng.normal(0, 0.7, (256, 2 * hidden)).astype(np.float32), rng.normal(0, 0.7, (2 * hidden, hidden)).astype(np.float32))
    return language.LanguageModel([f"l{i}" for i in range(labels)], one(), one(), rng.normal(0, 1, (labels, 2 * hidden + 1)).astype(np.float32))


def walked(direction, codes):
    """States after each byte, one at a time."""
    h, out = np.zeros(direction.inner.shape[1]), []
    for c in codes:
        x, u = direction.table[c].astype(float), direction.inner.astype(float) @ h
        n = len(h)
        g = 1 / (1 + np.exp(-2 * (x[:n] + u[:n])))
        h = h + g * (np.tanh(x[n:] + g * u[n:]) - h)
        out.append(h)
    return out


def plain_pooled(model, raw):
    total = np.zeros(len(model.labels))
    for core in range(0, len(raw), language.STRETCH):
        lo, hi = max(core - language.MARGIN, 0), min(core + language.STRETCH + language.MARGIN, len(raw))
        a, b = walked(model.ahead, raw[lo:hi]), walked(model.behind, raw[lo:hi][::-1])[::-1]
        for i in range(core, min(core + language.STRETCH, len(raw))):
            z = model.head.astype(float) @ np.concatenate([a[i - lo], b[i - lo], [1]])
            e = np.exp(z - z.max())
            total += e / e.sum()
    return total / max(len(raw), 1)


def test_network_against_one_byte_at_a_time():
    rng, model = np.random.default_rng(5), model_of(1)
    texts = [bytes(rng.integers(0, 256, n, dtype=np.uint8)) for n in (1, 31, 64, 511, 512, 513, 0, 545, 1100, 3)]
    got = model.pooled(texts)
    for raw, p in zip(texts, got, strict=True):
        np.testing.assert_allclose(p, plain_pooled(model, list(raw)), atol=1e-4)


def test_network_on_long_texts_ties_and_nothing():
    model = model_of(2)
    long = "né " * 200_000
    names, scores = model.predict([long, long, None, "", "123", "né"])
    assert names[0] == names[1] and scores[0] == scores[1] and 0 < scores[0] <= 1
    assert names[2:5] == ["und"] * 3 and list(scores[2:5]) == [0, 0, 0]
    model.head[:] = 0  # all labels equally likely: the first by name
    names, scores = model.predict(["abc"])
    assert names == ["l0"] and scores[0] == pytest.approx(1 / 3)


def test_every_byte_is_trained_on(monkeypatch):
    seen = []
    real = language.Direction.run
    monkeypatch.setattr(language.Direction, "run", lambda self, codes, keep=False, sizes=None: (seen.append(codes.copy()), real(self, codes, keep, sizes))[1])
    language.train(["a" * 64 + "b" * 5, "c" * 10, "d" * 200], ["x", "y", "y"], epochs=3, visits=1)
    ahead = np.concatenate([c.ravel() for c in seen[::2]])
    assert {chr(c) for c in ahead} == set("abcd")
    assert len(seen) == 2  # once over all windows, though fewer visits were asked for


def drawn(n, seed):
    rng = np.random.default_rng(seed)
    labels = np.where(rng.random(n) < 0.6, 1.0, -1.0)
    rows = [np.unique(np.concatenate([rng.integers(0, 30, 4), rng.integers(30, 60, 3) if y > 0 else rng.integers(60, 90, 3)])) for y in labels]
    flip = rng.random(n) < 0.1
    return rows, np.where(flip, -labels, labels)


def test_log_ratios_and_margins():
    rows, labels = drawn(80, 1)
    r = quality.log_ratios(rows, labels)
    up = {i: 1 + sum(i in x for x, y in zip(rows, labels, strict=True) if y > 0) for i in range(90)}
    down = {i: 1 + sum(i in x for x, y in zip(rows, labels, strict=True) if y <= 0) for i in range(90)}
    rest = len(r) - 90
    for i in range(90):
        assert r[i] == pytest.approx(np.log(up[i] / (sum(up.values()) + rest)) - np.log(down[i] / (sum(down.values()) + rest)))
    model = quality.QualityModel(r, 0.25, 1.0, 0.0)
    np.testing.assert_allclose(model.margins(iter(rows)), [sum(r[i] for i in x) / len(x) ** 0.5 + 0.25 for x in rows])


def test_descent_reaches_the_least_of_the_hinge_loss():
    rows, labels = drawn(60, 2)
    ratios = quality.log_ratios(rows, labels)
    x = np.zeros((60, 91))
    for i, row in enumerate(rows):
        x[i, row] = ratios[row] / np.sqrt(len(row))
    x[:, 90] = 1
    share = {y: (labels == y).sum() for y in (1.0, -1.0)}
    cost = np.array([60 / (2 * share[y]) for y in labels])

    def loss(v):
        return 0.5 * v @ v + (cost * np.maximum(0, 1 - labels * (x @ v))).sum()

    w, bias = quality.descend(rows, labels, ratios, epochs=400)
    best = np.concatenate([w[:90], [bias]])
    assert not w[90:].any()
    rng, least = np.random.default_rng(3), loss(best)
    for size in (1e-3, 1e-2, 0.1, 1.0):
        for _ in range(200):
            assert loss(best + size * rng.standard_normal(91)) >= least - 1e-4 * least


def held(ids, n, rest):
    return np.array([zlib.crc32(str(i).encode()) % n == rest for i in ids])


def test_held_out_accuracy():
    docs = pd.read_parquet("/root/testdata/sf0.01/documents.parquet")
    known = docs[docs["lang"].notna() & docs["text"].notna()]
    out = held(known["doc_id"], 4, 2)
    model = language.train(list(known["text"][~out]), list(known["lang"][~out]), epochs=4)
    names, _ = model.predict(list(known["text"][out]))
    assert np.mean(np.array(names) == known["lang"][out].to_numpy()) >= 0.97
    rows = docs.merge(pd.read_parquet("/root/testdata/sf0.01/labels.parquet"), on="doc_id").dropna(subset=["quality"])
    out = held(rows["doc_id"], 5, 0)
    y = np.where(rows["quality"] > 0, 1.0, -1.0)
    fitted = quality.fit_rows(list(quality.indicators(list(rows["text"][~out]))), y[~out])
    assert np.mean((fitted.scores(list(rows["text"][out])) >= 0.3) == (y[out] > 0)) >= 0.9


def test_classifier_on_empty_and_long_texts():
    rows, labels = drawn(60, 4)
    model = quality.fit_rows(rows, labels)
    same = model.scores([None, "", "a b", "a b", "word " * 100_000])
    assert same[0] == same[1] and same[2] == same[3] and ((0 <= same) & (same <= 1)).all()
