import html
import random
import re

import pytest

from cobi.llm.dom import Nodes
from cobi.llm.main_text import decode, extract, main_texts, query, train, training_page
from tests.conftest import SF_MID, table


@pytest.fixture(scope="module")
def trees(spark):
    return train(spark)


def article(page):
    """Text of the article element of the made pages, by its tags."""
    inner = re.search(r"<article>(.*?)(?:</article>|\Z)", page, re.S)[1]
    blocks = re.split(r"</?(?:h1|p)>", re.sub(r"</?b>", "", inner).replace("<br>", " "))
    blocks = [" ".join(html.unescape(b).split()) for b in blocks]
    return "\n".join(b for b in blocks if b)


def test_pages_of_the_table(spark):
    truth = {r.page_id: article(r.html) for r in table(spark, "pages", SF_MID).collect()}
    got = {r.page_id: r for r in query(spark, SF_MID).collect()}
    assert got.keys() == truth.keys()
    assert all(r.n_chars == len(r.text) for r in got.values())
    assert [i for i in truth if got[i].text != truth[i]] == []


def test_held_out_accuracy(trees):
    nodes = Nodes()
    for seed in range(50_000, 50_200):
        nodes.add(training_page(seed))
    kept, want = decode(nodes, trees.scores(nodes.features())), nodes.subtree_labels()
    own = [o[0] for o in nodes.own]
    right = sum(o for o, k, y in zip(own, kept, want, strict=True) if k and y)
    assert right / sum(o for o, k in zip(own, kept, strict=True) if k) > 0.95
    assert right / sum(o for o, y in zip(own, want, strict=True) if y) > 0.95
    assert all(not k or p < 0 or kept[p] for k, p in zip(kept, nodes.parent, strict=True))


PAGE = """<!doctype html><html><head><title>T</title><script>var a="</p><p>no</p>";</script></head><body>
<header><a href=/>Site</a></header><div class=cookie-banner><p>We use cookies to make this site better for you.</p></div>
<nav><ul><li><a href=/a>Home</a><li><a href=/b>News</a></ul></nav>
<div class="post-content"><h1>A&nbsp;title &amp; more</h1><p>First   paragraph with a <a href=x>link</a>,
and <b>bold</b> words that go on for a while, as they do in real text.<p>Second one &lt;here&gt;, also long enough to be read.
<div class="share">Share this</div><p>Third paragraph closes the article with some more words.</div>
<section id="comments"><h3>Comments</h3><ol class=commentlist><li><b>Ann</b><p>I do not agree with this at all.</p></ol></section>
<form action=/s><label>Your mail</label><input name=m><button>Send</button></form>
<footer>&copy; 2024 Site</footer></body></html>"""


def test_page(trees):
    assert main_texts(trees, [PAGE])[0].split("\n") == [
        "A title & more",
        "First paragraph with a link, and bold words that go on for a while, as they do in real text.",
        "Second one <here>, also long enough to be read.",
        "Third paragraph closes the article with some more words."]


def test_edge_rows(spark, trees):
    big = "<article>" + "<p>Some words of a long page stand here.</p>" * 20000 + "</article>"
    rows = [(1, "u", None), (2, None, ""), (None, "u", PAGE), (4, "u", "<"), (5, "u", "<p"), (6, "u", "<div " * 2000), (7, "u", big),
            (8, "u", "<!-- open"), (9, "u", "<script>x"), (10, "u", "&amp"), (1, "u", None), (11, "u", "</p></div>" * 100),
            (12, "u", "<div>" * 3000 + "deep")]
    out = extract(spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, n_chars int"), trees).collect()
    assert len(out) == len(rows) and all(r.n_chars == len(r.text) for r in out)
    by = {r.page_id: r.text for r in out}
    assert by[1] == by[2] == by[6] == by[8] == by[9] == "" and by[7].count("\n") == 19999
    assert extract(spark.createDataFrame([], "page_id long, url string, html string"), trees).count() == 0


def test_parser_never_fails():
    rng = random.Random(0)
    for seed in range(60):
        page = list(training_page(seed))
        for _ in range(30):
            page[rng.randrange(len(page))] = rng.choice("<>/\"'=& p")
        nodes = Nodes()
        nodes.add("".join(page))
        assert len(nodes.features()) == len(nodes.tag)


def blocks(page):
    nodes = Nodes()
    nodes.add(page)
    return nodes, [text for _, text in nodes.blocks]


@pytest.mark.parametrize("name", ["button", "svg", "select", "canvas", "object", "math", "video", "datalist", "template"])
def test_passed_over_elements_without_an_end_tag(name):
    """Only raw text runs to the end of the page; the others end at the next block."""
    page = f"<article><p>one</p><{name} x=1>Buy<p>two</p><{name}>in<b>x</b></{name}><p>three</p></article>"
    assert blocks(page)[1] == ["one", "two", "three"]
    assert blocks(page.replace(f"<{name} x=1>Buy", f"<{name}><{name}>a</{name}><p>no</p></{name}>"))[1] == ["one", "two", "three"]
    assert blocks("<p>one</p><script>x<p>no</p>")[1] == ["one"]


def test_links_without_an_end_tag_end_with_their_block():
    link = lambda page: [own[2] for own in blocks(page)[0].own if own[0]]
    assert link("<p><a href=x>link<p>plain text<p>more") == [4.0, 0.0, 0.0]
    assert link("<p><a href=x>link</a> text<p>more") == [4.0, 0.0]
    assert link("<a href=x><h3>a title</h3><p>and more</p></a><p>plain") == [7.0, 8.0, 0.0]
