"""Texts of a megabyte of each awkward kind take time in proportion to their length."""

import time

import numpy as np
import pytest

from quirefold.llm import html_extract, toxicity

MB = 1_000_000


@pytest.fixture(scope="module")
def restorer():
    rng = np.random.default_rng(5)
    return toxicity.Restorer(toxicity.CharModel(rng.integers(0, 50, toxicity.WIDTH**3)), {"=idiot"})


@pytest.mark.parametrize("text", ["x" * MB, "abc" * (MB // 3), "." * MB, "a-" * (MB // 2), "ab" * (MB // 2) + "!", "1d10t " * (MB // 6), "a " * (MB // 2)], ids=["run", "letters", "dots", "hyphens", "sign", "leet", "spaced"])
def test_toxicity_is_linear(restorer, text):
    began = time.perf_counter()
    restorer.count(text)
    assert time.perf_counter() - began < 30


@pytest.mark.parametrize("page", ["<a" * (MB // 2), "x" * MB, "<div>x" * (MB // 6), "<ul><li>x" * (MB // 9), "<div>" * 80_000 + "</p></li>" * 40_000, "<ul><li><div>" + "<h1>" * 100_000 + "<li></li>" * 50_000, '<a b="' * (MB // 6), "<!--" * (MB // 4)])
def test_pages_are_linear(page):
    began = time.perf_counter()
    html_extract.vote(page)
    html_extract.extract(page, ["/div/div"])
    assert time.perf_counter() - began < 30


def test_thinned_is_the_best_path():
    """The closed form for mere letters equals brute force."""
    rng = np.random.default_rng(7)
    d = toxicity.Decoder(toxicity.CharModel(rng.integers(0, 50, toxicity.WIDTH**3)))
    for _ in range(300):
        word = "".join(rng.choice(list("aabñж"), rng.integers(1, 9)))
        assert d.thinned(word) == _beam(d, word)


def _beam(d, word):
    """All ways to keep at least one letter of each run, by brute force."""
    import itertools
    import re

    runs = [(m[1], m.end() - m.start()) for m in re.finditer(r"(.)\1*", word)]
    best = None
    for ks in itertools.product(*(range(1, n + 1) for _, n in runs)):
        out = "".join(x * k for (x, _), k in zip(runs, ks, strict=True))
        score, a, b = sum((n - k) * toxicity.REPEAT + (k - 1) * (toxicity.KEEP + toxicity.DOUBLE) for (_, n), k in zip(runs, ks, strict=True)), 0, 0
        for c in [toxicity.PLACE.get(x, toxicity.OTHER) for x in out] + [0]:
            score, a, b = score + d.lm[a][b][c], b, c
        if best is None or score > best[0]:
            best = (score, out)
    return best[1]
