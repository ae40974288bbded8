import random
import time

import pytest

from reportloom.llm import html_text as H

LONG = "The council met in the old hall and talked about the new bridge for most of the evening, without a result. "


@pytest.mark.parametrize("unit", ["<a ", '<a href="', "<a '\"<b ", "<div>", "<script ", "<!", "</x ", "<!--", "<b></i>", "<a href=x "])
def test_broken_pages_take_time_by_their_length(unit):
    def seconds(size):
        page = f"<body><p>{LONG * 3}</p>" + unit * (size // len(unit))
        began = time.process_time()
        found = H.extract(page)
        return time.process_time() - began, found

    seconds(20_000)
    small, _ = seconds(125_000)
    large, found = seconds(1_000_000)
    assert found.startswith(LONG.strip()) and large < 30 * max(small, 0.05)


@pytest.mark.parametrize("page", ["<p><section>" + "<b>" * 100_000 + "<div></div>" * 60_000, "<b>" * 150_000 + "</i>" * 150_000])
def test_deep_pages(page):
    began = time.process_time()
    H.extract(page)
    assert time.process_time() - began < 20


def test_tags():
    of = lambda page: [(page[a:b], closing, name) for a, b, closing, name, _ in H.tags(page)]
    assert of('<a title="x > y <b>">t</A >') == [('<a title="x > y <b>">', False, "a"), ("</A >", True, "a")]
    assert of("1 < 2 <b<i>") == [("<i>", False, "i")]
    assert of('<a href="lost>one</a> <p>two</p>') == [('<a href="lost>', False, "a"), ("</a>", True, "a"), ("<p>", False, "p"), ("</p>", True, "p")]
    assert of("<!-- <p> --><?x?><!doctype html><![CDATA[<p>]]>") == [("<!-- <p> -->", False, ""), ("<?x?>", False, ""), ("<!doctype html>", False, ""), ("<![CDATA[<p>]]>", False, "")]
    assert of("<script>if (a<b) '<p>'</script ><p>") == [("<script>if (a<b) '<p>'</script >", False, ""), ("<p>", False, "p")]
    assert of("<head><title>x<body><p>") == [("<head><title>x", False, ""), ("<body>", False, "body"), ("<p>", False, "p")]


def test_blocks_of_an_article_stay():
    inner = f"<div class='legal'>{LONG}</div><div class='share side'>{LONG}</div><div class='sidebar'>gone</div>"
    assert H.extract(f"<article><p>{LONG}</p>{inner}</article>") == " ".join([LONG.strip()] * 3)
    assert H.extract(f"<p>{LONG}</p><div class='legal'>gone</div>") == LONG.strip()


def test_stretches_against_all_windows():
    rng = random.Random(1)
    for _ in range(200):
        lines = [("x" * n, n if rng.random() < 0.8 else n // 4, 0) for n in rng.choices([1, 5, 20, 40, 90], k=rng.randint(0, 30))]
        weights = [0 if 2 * w < len(t) else w for t, w, _ in lines]
        sums = [sum(weights[j] for j in range(len(lines)) if abs(i - j) <= H.WINDOW // 2) for i in range(len(lines))]
        want, runs = [], "".join("1" if s > H.DIVE else " " for s in sums)
        at = 0
        for run in runs.split(" "):
            if run and max(sums[at : at + len(run)]) > H.SURGE:
                full = [k for k in range(at, at + len(run)) if weights[k]]
                want.append((full[0], full[-1] + 1))
            at += len(run) + 1
        assert H.stretches(lines) == want
