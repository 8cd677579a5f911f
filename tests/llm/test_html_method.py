"""HTML extraction against its definition: ratios, kernel, clusters; and that the text follows from them."""

from __future__ import annotations

import math
import random
import re
import time

import numpy as np
import pytest

from hushgrid.llm import common, html_text


def parsed(html):
    p = html_text.Lines()
    p.feed(html)
    p.close()
    p.cut()
    return p.settled()


def test_ratio_of_a_line():
    lines = parsed("<div><p>twelve chars<a href=/x>four</a></p><nav>menu</nav><p>" + "y" * 400 + "</p></div>")
    by_text = {line.text: r for line, r in zip(lines, html_text.ratios(lines)) if line.text}
    assert by_text["twelve charsfour"] == 12 / 3  # p opens after the cut, then a and its end
    assert by_text["menu"] == 0 and by_text["y" * 400] == html_text.FULL


@pytest.mark.parametrize("n", [1, 2, 7, 40])
def test_smoothing_against_its_definition(n):
    values = np.random.default_rng(n).random(n) * 30
    reach, s = int(3 * html_text.SIGMA), html_text.SIGMA
    for k, got in enumerate(html_text.smooth(values)):
        near = [(j, math.exp(-((j - k) ** 2) / (2 * s * s))) for j in range(max(0, k - reach), min(n, k + reach + 1))]
        assert math.isclose(got, sum(values[j] * w for j, w in near) / sum(w for _, w in near), rel_tol=1e-9)


def test_clusters_against_their_definition():
    r = random.Random(4)
    for _ in range(200):
        level = np.array([r.choice([0.0, 0.4, 1.0, 6.0, 20.0]) * r.random() for _ in range(r.randint(1, 30))])
        live = np.array([r.random() < 0.9 for _ in level])
        high = min(level.mean(), level.max() * html_text.HIGH)
        seeds = [bool(ok and x >= high) for x, ok in zip(level, live)]
        members = list(seeds)
        for _ in level:  # grow one line at a time
            members = [m or bool(live[k] and level[k] >= high * html_text.LOW and any(members[j] for j in (k - 1, k + 1) if 0 <= j < len(level))) for k, m in enumerate(members)]
        got = html_text.clusters(level, live)
        assert got[0].tolist() == seeds and got[1].tolist() == members


def test_the_text_follows_from_the_levels(spark, monkeypatch):
    pages = [r.html for r in common.table(spark, "/root/testdata/sf0.001", "pages").select("html").collect()]
    plain = [re.sub(r"(</?)(?:article|main)\b", r"\1div", p) for p in pages]
    want = [html_text.main_text(p) for p in pages]
    assert [html_text.main_text(p) for p in plain] == want
    # the article's own words, cut out by a pattern that knows these pages
    from html import unescape

    for page, text in zip(pages, want):
        inner = re.sub(r"<(?:/?p|br|/?h1)[^>]*>", " ", re.search(r"<article>(.*)</article>", page, re.DOTALL)[1])
        assert text == " ".join(unescape(re.sub(r"<[^>]+>", "", inner)).split())
    rng = np.random.default_rng(0)
    monkeypatch.setattr(html_text, "smooth", lambda values, sigma=2.0: rng.normal(size=len(values)))
    assert sum(html_text.main_text(p) != t for p, t in zip(pages, want)) > len(pages) // 4
    assert sum(html_text.main_text(p) != t for p, t in zip(plain, want)) > len(pages) // 4


def test_far_links_are_no_article():
    long = "Running text of the article, with a good number of words in every one of its paragraphs."
    menu = "".join(f"<div><a href=/{k}>Place {k}</a></div>" for k in range(30))
    assert html_text.main_text(f"<body>{menu}<p>{long}<p>{long}<p>Yes.{menu}") == f"{long} {long} Yes."


def test_deep_nesting_is_linear():
    def seconds(n):
        began = time.perf_counter()
        page = "<article>" + "<div class=related>" * n + "words " * 9 + "</b>" * n + "<p>" * 1000
        html_text.main_text(page)
        assert html_text.main_text("<div>" * n + "words" + "</b>" * n) == "words"
        return time.perf_counter() - began

    seconds(1_000)
    assert seconds(100_000) < 40 * max(0.05, seconds(10_000))
