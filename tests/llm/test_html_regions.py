"""Article regions: learned weights, parts left out, the scan against all stretches, deep nesting."""

from __future__ import annotations

import random
import time

import pyarrow as pa
import pytest

from panelcast.llm import html_content as hc

STORY = " ".join(f"word{k}" for k in range(60))
LABELLED = f"<body><div><a href=x>menu one</a> <a href=y>two</a></div><article><h1>Title</h1><p>{STORY}</p></article><ul><li>list {STORY[:40]}</li></ul></body>"


def learned(pages):
    shares = {}
    for batch in hc._count([pa.record_batch([pa.array(pages)], names=["html"])]):
        for feature, outside, inside in zip(*(batch.column(k).to_pylist() for k in range(3))):
            shares[feature] = (inside + 1) / (outside + inside + 2)
    return shares


SHARES = learned([LABELLED] * 5)


def test_weights_are_learned_by_place_and_side():
    assert SHARES["word p in"] > 0.9 and SHARES["word li out"] < 0.2 and SHARES["word p"] > 0.9 and SHARES["word div link"] < 0.2
    assert hc.main_text(LABELLED, SHARES) == f"Title {STORY}"


def test_marks_on_teasers_do_not_decide():
    page = (f"<body><article class=x><p>short teaser</p></article><div>{STORY}</div><p>{STORY}</p>"
            "<article class=comment><p>a reader comment</p></article></body>")
    text = hc.main_text(page, SHARES)
    assert f"{STORY} {STORY}" in text and "comment" not in text
    whole = f"<article class='post-with-comments'><p>{STORY}</p><article class='comment-item'><p>first!</p></article></article>"
    assert hc.main_text(whole, SHARES) == STORY
    assert hc.main_text(f"<article hidden><p>{STORY}</p></article>", SHARES) == ""


def test_the_scan_finds_the_first_of_the_largest_sums():
    rng = random.Random(4)
    for _ in range(300):
        values = [rng.choice([-1.0, -0.5, 0.0, 0.25, 0.5]) for _ in range(rng.randint(0, 25))]
        low, high = hc.best_region(values)
        most = max([sum(values[i:j]) for i in range(len(values)) for j in range(i + 1, len(values) + 1)], default=0.0)
        assert sum(values[low:high]) == max(most, 0.0)
        if most > 0:  # no stretch that ends earlier does as well
            assert all(sum(values[i:j]) < most for j in range(1, high) for i in range(j))


@pytest.mark.parametrize("tag", ["b", "div", "li", "p", "a", "article"])
def test_open_tags_cost_the_same_however_deep(tag):
    def seconds(n):
        began = time.process_time()
        hc.main_text(f"<{tag}>x " * n, SHARES)
        return time.process_time() - began
    seconds(1000)
    assert seconds(8_000) < 24 * max(seconds(1_000), 0.02)


def test_nesting_is_read_as_browsers_do():
    page = "<ul><li>a<ul><li>b</ul><li>c</ul><table><tr><td>d<td>e<tr><td>f</table><p>g<p>h<div>i</p>j</div>"
    words = [(value, place) for kind, value, place, _, _ in hc.tokens(page) if kind == "text"]
    assert words == [("a", "li"), ("b", "li"), ("c", "li"), ("d", "td"), ("e", "td"), ("f", "td"), ("g", "p"), ("h", "p"), ("i", "div"), ("j", "div")]
