"""What densities choose by themselves, and where names of tags and classes come in."""

import random

import pandas as pd
import pytest

from lectern.llm import main_text

NAMES = ("AROUND_TAGS", "LAYOUT_TAGS", "AROUND_WORDS", "LAYOUT_WORDS")


@pytest.fixture
def pages():
    return pd.read_parquet("/root/testdata/sf0.01/pages.parquet")["html"].tolist()


def without_names(monkeypatch):
    for n in NAMES:
        monkeypatch.setattr(main_text, n, frozenset())


def test_densities_alone_find_nearly_all_articles(monkeypatch, pages):
    whole = [main_text.main_text(h) for h in pages]
    without_names(monkeypatch)
    alone = [main_text.main_text(h) for h in pages]
    assert sum(a == b for a, b in zip(whole, alone, strict=True)) >= 0.95 * len(pages)
    real, pick = main_text.composite, random.Random(1)
    monkeypatch.setattr(main_text, "composite", lambda *counts: pick.random() if counts[0] else 0.0)
    drawn = [main_text.main_text(h) for h in pages]
    assert sum(a == b for a, b in zip(whole, drawn, strict=True)) < sum(a == b for a, b in zip(whole, alone, strict=True)) - 0.1 * len(pages)
    monkeypatch.setattr(main_text, "composite", lambda *counts: 1 / real(*counts) if real(*counts) else 0.0)  # the sparsest instead
    turned = [main_text.main_text(h) for h in pages]
    assert sum(a == b for a, b in zip(whole, turned, strict=True)) < 0.5 * len(pages)


def plain_choice(html):
    """The node with the greatest sum of its children's densities, by plain recursion over all nodes."""
    root = main_text.parse(html)

    def counts(x):
        own = [x.chars, x.tags, x.link_chars, x.link_tags] if x.name == "#run" else [0, 0 if x.name[0] == "#" else 1, 0, 0]
        for p in x.parts:
            own = [a + b for a, b in zip(own, counts(p), strict=True)]
        return own

    def nodes(x):
        yield x
        for p in x.parts:
            yield from nodes(p)

    body = next((x for x in nodes(root) if x.name == "body"), root)
    c = counts(body)
    density = lambda x: main_text.composite(*counts(x), c[2] / max(c[0], 1))
    best = max((x for x in nodes(body) if x.name != "#run" and counts(x)[0]), key=lambda x: (sum(density(p) for p in x.parts), counts(x)[0]), default=None)
    return best and (best.name, counts(best)[0])


def test_choice_against_plain_recursion(pages):
    for html in [*pages[:40], "<p>a", "<body><div>x y<p>z</div><div>x y<p>z</div>", ""]:
        best = main_text.densest(main_text.order_of(main_text.measure(main_text.parse(html))))
        got = best and (best.name, best.chars)
        want = plain_choice(html)
        assert got == (want and (want[0], want[1]))


WORDS = "many words of a story that goes on for a while and then some more "


@pytest.mark.parametrize(("html", "text"), [
    # a short and a thin neighbour stay out without any name, a comparable one comes in
    (f"<body><div>short</div><div><p>{WORDS * 3}<p>{WORDS * 3}</div><div><a href=x>{WORDS}</a></div>", " ".join([(WORDS * 3).strip()] * 2)),
    (f"<body><div><p>{WORDS * 3}<p>{WORDS * 3}</div><div><p>{WORDS * 3}<p>{WORDS * 2}</div>", " ".join([*[(WORDS * 3).strip()] * 3, (WORDS * 2).strip()])),
    # names overrule the choice where it lies in a part around the article
    (f"<body><article><p>{WORDS}</article><div class=comments><p>{WORDS * 2}<p>{WORDS * 2}</div>", WORDS.strip()),
    # of equal sums the first counts where both can't
    ("<body><nav><p>aa bb<p>aa bb</nav><p>one</p>", "one"),
])
def test_neighbours(html, text):
    assert main_text.main_text(html) == text
