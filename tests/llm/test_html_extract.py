import html
import random
import re

import numpy as np
import pytest

from tallyframe.llm.blocks import DIM, Vectors, blocks
from tallyframe.llm.html_extract import BiLSTM, altered, extract_main_text, label, padded, stated_label, train
from tallyframe.llm.queries import QUERIES
from tests.conftest import SF01


@pytest.fixture(scope="module")
def pages(spark):
    return {r.page_id: r.html for r in spark.read.parquet(f"{SF01}/pages.parquet").collect()}


@pytest.fixture(scope="module")
def model(pages):
    return train([pages[k] for k in sorted(pages)[:60]])


def article(page):
    """The blocks of the article element, cut with plain patterns."""
    inside = re.search(r"(?s)<article>(.*?)(?:</article>|\Z)", page)[1]
    parts = (re.sub(r"\s+", " ", html.unescape(re.sub(r"<[^>]+>", "", x))).strip()
             for x in re.split(r"</?(?:p|h1|br|li|div)[^>]*>", inside))
    return "\n".join(x for x in parts if x)


def test_blocks_of_broken_markup():
    got = blocks("<body><div class='Main content'><p>One<p>Two &amp; <b>2<br>Three</div>x<script>var a='<p>no</p>'</script>"
                 "<!-- <p>no</p> --><ul><li><a href='>'>go</a><li>5 < 6</ul></p>&eacute;")
    assert [b.text for b in got] == ["One", "Two & 2", "Three", "x", "go", "5 < 6", "é"]
    assert got[0].path == ("<body", "<div", "main", "content", "<p") and got[3].path == ("<body",)
    assert [b.linked for b in got] == [0, 0, 0, 0, 2, 0, 0]
    assert blocks(None) == blocks("") == blocks("<p> \n</p><style>x") == []
    assert [b.text for b in blocks("no markup\n at all")] == ["no markup at all"]
    assert [b.text for b in blocks("<p a=\"x>open <p>next")]


def test_gradients_match_differences():
    rng = np.random.default_rng(1)
    m = BiLSTM(hidden=3, seed=2)
    x, mask = padded([rng.normal(size=(4, DIM)).astype(np.float32), rng.normal(size=(2, DIM)).astype(np.float32)])
    y = (rng.random(mask.shape) < 0.5).astype(np.float32)
    m.p = {k: v.astype(np.float64) for k, v in m.p.items()}
    _, g = m.gradients(x.astype(np.float64), mask, y)
    for k in m.p:
        flat = m.p[k].reshape(-1)
        for at in rng.choice(len(flat), min(6, len(flat)), replace=False):
            old, e = flat[at], 1e-4
            flat[at] = old + e
            up = m.gradients(x.astype(np.float64), mask, y)[0]
            flat[at] = old - e
            down = m.gradients(x.astype(np.float64), mask, y)[0]
            flat[at] = old
            assert abs((up - down) / (2 * e) - g[k].reshape(-1)[at]) < 2e-4


def test_padding_changes_nothing(model, pages):
    found = [blocks(pages[k]) for k in sorted(pages)[60:90]]
    together = label(model, found, Vectors())
    assert together == [label(model, [f], Vectors())[0] for f in found]


def test_held_out_altered_pages(model, pages):
    rnd, right, total = random.Random(5), 0, 0
    for k in sorted(pages)[100:200]:
        found = blocks(altered(blocks(pages[k]), rnd))
        for b, kept in zip(found, label(model, [found], Vectors())[0]):
            right, total = right + (kept == stated_label(b)), total + 1
    assert right / total > 0.98


def test_context_decides_between_equal_paths(model):
    """Unmarked paragraphs are kept; the same words in a menu are not."""
    page = "<body><nav><a>Home page</a><a>All news</a></nav><div><p>%s</p><p>Home page</p></div></body>" % ("Long text here. " * 20)
    found = blocks(page)
    assert label(model, [found], Vectors())[0][:3] == [False, False, True]


def test_every_article_of_the_driver_table(spark, pages):
    got = QUERIES["op1_extract_html"](spark, SF01).collect()
    assert len(got) == len(pages)
    wrong = [r.page_id for r in got if r.text != article(pages[r.page_id])]
    assert not wrong and all(r.n_chars == len(r.text) for r in got)


def test_odd_pages(spark, model):
    big = "<article>" + "<p>word word word.</p>" * 5000 + "</article>"
    rows = [(1, "u", None, "x"), (None, None, "", "x"), (2, "u", big, "x"), (2, "u", big, "x"), (3, "u", "<p>", None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = extract_main_text(df, model=model).collect()
    assert sorted((r.page_id or -1, r.n_chars, r.n_main) for r in got) == [
        (-1, 0, 0), (1, 0, 0), (2, 5000 * 16 - 1, 5000), (2, 5000 * 16 - 1, 5000), (3, 0, 0)]
    assert extract_main_text(df.limit(0)).count() == 0


PARAGRAPHS = [f"Paragraph {k} of the article tells about the council, which met on Monday to discuss the plan, in enough words."
              for k in range(6)]
ARTICLE = "".join(f"<p>{p}</p>" for p in PARAGRAPHS)
LINKS = "".join(f"<td><a href='/{x}'>{x}</a></td>" for x in ("Home", "News", "Sport", "Contact"))


@pytest.mark.parametrize("page", [
    f"<html><body class='page no-sidebar'><article>{ARTICLE}</article></body></html>",
    f"<html><body class='single single-post has-header-image menu-on-side'><div>{ARTICLE}</div></body></html>",
    "<html><body class='home single-post no-sidebar'><div id='page' class='site'><nav class='menu'><a>Home</a></nav><main>"
    f"<article class='post type-post'><div class='entry-content'>{ARTICLE}</div></article></main>"
    "<footer class='site-footer'><p>Privacy</p></footer></div></body></html>",
    f"<html><body><table><tr>{LINKS}</tr></table><div>{ARTICLE}</div>"
    "<div><a href='/p'>Privacy</a> / <a href='/t'>Terms</a> / <a href='/c'>Contact</a></div></body></html>",
    f"<body><div class='wrap no-sidebar'><div class='content-area has-sidebar'>{ARTICLE}</div></div></body>"])
def test_states_in_class_names_cost_no_article(model, page):
    found = blocks(page)
    assert [b.text for b, kept in zip(found, label(model, [found], Vectors())[0]) if kept] == PARAGRAPHS


def test_held_out_markups(model, pages):
    """Holders and regions that training never sees: precision and recall by block."""
    holders = ['<div class="td-post-content">', '<div itemprop="articleBody">', '<section class="page-text no-comments">',
               '<div class="c-article with-navigation">', '<table><tr><td class="story-text">']
    regions = ['<div role="navigation"><a>%s</a>', '<div class="footer-widgets"><p>%s</p>', '<div id="comments-area"><div>%s</div>',
               '<div class="left-sidebar"><li>%s</li>', '<div class="site-cookie-bar"><p>%s</p>', '<div class="ad-slot"><p>%s</p>']
    rnd, counts = random.Random(11), [0, 0, 0]
    for k in sorted(pages)[200:320]:
        source = blocks(pages[k])
        main = [b.text for b in source if stated_label(b)]
        other = [b.text for b in source if not stated_label(b)] or ["Menu"]
        begin, aside = rnd.choice(holders), [rnd.choice(regions) % rnd.choice(other) + "</div>" for _ in range(4)]
        esc = [t.replace("&", "&amp;").replace("<", "&lt;") for t in main]
        found = blocks(f"<body>{aside[0]}{aside[1]}{begin}<h1>x</h1>{''.join(f'<p>{t}</p>' for t in esc)}</div>{aside[2]}{aside[3]}</body>")
        for b, kept in zip(found, label(model, [found], Vectors())[0]):
            if b.text != "x":
                real = b.text in main
                counts = [counts[0] + (kept and real), counts[1] + kept, counts[2] + real]
    precision, recall = counts[0] / counts[1], counts[0] / counts[2]
    print("held-out markups:", precision, recall)
    assert precision >= 0.95 and recall >= 0.95


@pytest.mark.parametrize("page, n_blocks", [
    ("<div>x" * 60_000, 60_000), ('<a "' * 100_000, 1), ('<a ="' * 80_000, 1), ("<b>" * 100_000 + "</x>" * 20_000, 0),
    ("<b>" * 20_000 + "<p></p>" * 20_000, 0), ("".join(f"<div class=n{k}>x" for k in range(20_000)), 20_000)])
def test_broken_pages_cost_their_length(page, n_blocks):
    import time

    began = time.process_time()
    assert len(blocks(page)) == n_blocks
    assert time.process_time() - began < 10
