"""Operator 2: main text of web pages by gradient-boosted trees over DOM nodes.

A node's score is the log-odds that its subtree holds main text.  Decoding is
hierarchical: a node can only be kept if its parent is, so the kept nodes form a
tree from the root, and of all such trees the one with the greatest sum of
weighted scores is taken.  A menu inside an article is dropped with all that
lies in it, and an article cannot survive in a dropped wrapper.

The trees (Spark ML) are trained on ``TRAINING_PAGES`` made pages, a fixed
number: ``training_page`` lays out articles among menus, adverts, notices,
forms, comments and so on, with semantic elements, with telling class names, or
with neither.  The pages to extract are not used for training.
"""

from __future__ import annotations

import random
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cobi.llm.common import Shared, saved
from cobi.llm.dom import Nodes

TRAINING_PAGES = 1200
TREES = 24
DEPTH = 5

# -- training pages --------------------------------------------------------------

_SYLLABLES = "ka lo mi re su ta ne vo di pa che ber ung tion les ing er an th ou é ña ö".split()


def _word(r: random.Random) -> str:
    return "".join(r.choice(_SYLLABLES) for _ in range(r.randint(1, 4)))


def _sentence(r: random.Random, low: int = 4, high: int = 18) -> str:
    w = [_word(r) + ("," if r.random() < 0.08 else "") for _ in range(r.randint(low, high))]
    if r.random() < 0.12:
        k = r.randrange(len(w))
        w[k] = r.choice(["<a href='/x'>{}</a>", "<b>{}</b>", "<em>{}</em>", "<code>{}</code>", "{}&amp;", "{}%%%"]).format(w[k])
    return " ".join(w).capitalize() + r.choice([".", ".", ".", "?", "!"])


def _text(r: random.Random, low: int, high: int) -> str:
    return " ".join(_sentence(r) for _ in range(r.randint(low, high)))


def _links(r: random.Random, n: int, row: str = "<li><a href='/p'>{}</a></li>") -> str:
    return "".join(row.format(" ".join(_word(r) for _ in range(r.randint(1, 3)))) for _ in range(n))


def _box(r: random.Random, semantic: str, names: str, inner: str, plain: float = 0.15) -> str:
    """An element that is semantic, or has a telling name, or both or neither."""
    style = r.random()
    tag = semantic if style > 0.4 and semantic else r.choice(["div", "div", "section", "aside" if semantic == "aside" else "div"])
    name = r.choice(names.split())
    name = r.choice([name, name + "-" + r.choice(["box", "wrap", "area", "1", "inner"]), "site-" + name, "c" + name.capitalize()])
    attribute = f' {r.choice(["class", "id", "class"])}="{name}"' if style < 0.85 and (tag != semantic or r.random() < 0.5) else ""
    if style < plain and tag != semantic:
        attribute = ""
    return f"<{tag}{attribute}>{inner}</{tag}>"


def _article(r: random.Random, clutter) -> str:
    y = ' data-y="1"'
    parts = [f"<h{h}{y}>{_sentence(r, 2, 9).rstrip('.')}</h{h}>" for h in [r.choice([1, 1, 2])] if r.random() < 0.85]
    if r.random() < 0.2:
        parts.append(f"<p{y}><b>{_sentence(r)}<br>")
    for _ in range(r.choice([0, 1, 1, 2, 4, 8, 15])):
        kind = r.random()
        body = _text(r, 1, r.choice([1, 3, 8]))
        if kind < 0.75:
            parts.append(f"<p{y}>{body}" + ("</p>" if r.random() < 0.9 else ""))
        elif kind < 0.80:
            parts.append(f"<h3{y}>{_sentence(r, 1, 6)}</h3>")
        elif kind < 0.85:
            parts.append("<ul>" + "".join(f"<li{y}>{_sentence(r)}</li>" for _ in range(r.randint(2, 6))) + "</ul>")
        elif kind < 0.88:
            parts.append(f"<blockquote><p{y}>{body}</p></blockquote>")
        elif kind < 0.91:
            parts.append("<table>" + "".join("<tr>" + "".join(f"<td{y}>{_word(r)} {r.randint(1, 99)}</td>" for _ in range(3)) + "</tr>"
                                             for _ in range(r.randint(2, 5))) + "</table>")
        elif kind < 0.94:
            parts.append(f"<pre{y}>{body}</pre>")
        elif kind < 0.97:
            parts.append(f"<div{y}>{body}</div>")
        else:
            parts.append(f"<figure><img src='i'><figcaption{y}>{_sentence(r)}</figcaption></figure>")
    if len(parts) < 2:
        parts.append(f"<p{y}>{_text(r, 1, 2)}</p>")
    for _ in range(r.choice([0, 0, 1, 2])):
        parts.insert(r.randint(1, len(parts)), clutter())
    style = r.random()
    if style < 0.4:
        return f"<article>{''.join(parts)}</article>"
    if style < 0.5:
        return f"<main>{''.join(parts)}</main>"
    if style < 0.85:
        name = r.choice("content article post entry-content story main article-body post-body page-content text".split())
        return f'<div {r.choice(["class", "id"])}="{name}">{"".join(parts)}</div>'
    return f"<div>{''.join(parts)}</div>"


def training_page(seed: int) -> str:
    """A page whose main text is marked with ``data-y``."""
    r = random.Random(seed)

    def advert() -> str:
        return _box(r, "aside", "ad ads advert sponsored promo banner ad-slot", r.choice(
            ["<p>{}</p>", "{}", "<a href='/ad'>{}</a>"]).format(_sentence(r)), 0)

    def share() -> str:
        return _box(r, "", "share social tags byline post-meta rating", r.choice(
            ["<ul>" + _links(r, 4) + "</ul>", _links(r, 3, "<a href='/s'>{}</a> "), f"<p>{_sentence(r, 2, 5)}</p>"]), 0)

    def related() -> str:
        return _box(r, "aside", "related recommended more-stories popular teaser", f"<h3>{_sentence(r, 1, 4)}</h3><ul>"
                    + _links(r, r.randint(2, 6), r.choice(["<li><a href='/r'>{}</a></li>", "<li><a href='/r'>{}</a><p>" + _sentence(r)
                                                          + "</p></li>"])) + "</ul>")

    def notice() -> str:
        return _box(r, "", "cookie-notice consent newsletter subscribe gdpr alert popup paywall modal", f"<p>{_text(r, 1, 3)}</p>"
                    + r.choice(["", "<button>OK</button>", "<a href='/c'>OK</a>"]), 0)

    def form() -> str:
        return f"<form>{r.choice(['', '<p>' + _sentence(r) + '</p>'])}<label>{_word(r)}</label><input name='q'>" \
               f"<select><option>{_word(r)}</option></select>{r.choice(['', '<div>' + _sentence(r, 2, 6) + '</div>'])}</form>"

    def comments() -> str:
        row = r.choice(["<li class='comment'><b>{0}</b><p>{1}</p></li>", "<div class='comment-body'><span>{0}</span> {1}</div>",
                        "<article class='comment'><p>{1}</p></article>", "<div><p>{0}:</p><p>{1}</p></div>"])
        inner = "".join(row.format(_word(r), _text(r, 1, 4)) for _ in range(r.randint(1, 6)))
        inner = f"<h3>{_sentence(r, 1, 3)}</h3>" * (r.random() < 0.6) + (f"<ol>{inner}</ol>" if "<li" in row else inner)
        return _box(r, "section", "comments commentlist discussion replies respond", inner, 0)

    def hidden() -> str:
        return f"<div {r.choice(['hidden', 'style=\"display:none\"', 'aria-hidden=\"true\"'])}><p>{_text(r, 1, 3)}</p></div>"
    clutter = lambda: r.choice([advert, advert, share, related, notice, form, hidden])()
    nav = _box(r, "nav", "menu nav navbar navigation topbar", r.choice(
        ["<ul>" + _links(r, r.randint(3, 12)) + "</ul>", _links(r, r.randint(3, 9), "<a href='/m'>{}</a> ")]))
    head = _box(r, "header", "header masthead top-bar logo", f"<div class='logo'><a href='/'>{_word(r)}</a></div>" + r.choice(
        [f"<p>{_sentence(r, 3, 7)}</p>", "", f"<h1>{_word(r)}</h1>", nav]))
    foot = _box(r, "footer", "footer site-footer copyright colophon bottom legal", r.choice(["<p>{}</p>", "{}", "<div>{}</div>"]).format(
        r.choice(["&copy; ", "", "Copyright "]) + _word(r) + r.choice([" &middot; ", " | "]) + _text(r, 1, 2))
        + r.choice(["", "<ul>" + _links(r, 4) + "</ul>"]))
    side = _box(r, "aside", "sidebar side widget rail", "".join(
        f"<div class='widget'><h4>{_word(r)}</h4>{r.choice(['<ul>' + _links(r, 4) + '</ul>', '<p>' + _text(r, 1, 3) + '</p>'])}</div>"
        for _ in range(r.randint(1, 3))))
    crumbs = _box(r, "nav", "breadcrumb breadcrumbs crumbs", _links(r, 3, "<a href='/b'>{}</a> &raquo; "), 0)
    body = [x for x, p in ((head, 0.5), (nav, 0.8), (crumbs, 0.2), (notice(), 0.25), (advert(), 0.5), (form(), 0.15)) if r.random() < p]
    core = [_article(r, clutter)] + [x for x, p in ((share(), 0.2), (related(), 0.25), (comments(), 0.35), (advert(), 0.2),
                                                   (notice(), 0.15), (hidden(), 0.1)) if r.random() < p]
    for x, p in ((side, 0.35), (advert(), 0.1)):
        if r.random() < p:
            core.insert(r.choice([0, len(core)]), x)
    wrap = r.random()
    core = "".join(core)
    body.append(core if wrap < 0.4 else f"<main>{core}</main>" if wrap < 0.55 else f'<div class="{r.choice(["wrapper", "container", "page", "row", "layout"])}">{core}</div>')
    body += [x for x, p in ((notice(), 0.1), (foot, 0.85), (notice(), 0.1)) if r.random() < p]
    gap = r.choice(["", "\n", "\n  "])
    return f"<!DOCTYPE html><html><head><title>{_sentence(r)}</title><style>p{{}}</style></head><body>{gap.join(body)}" + r.choice(
        ["</body></html>", ""])


# -- the model ---------------------------------------------------------------------

class Trees:
    """Boosted trees as arrays, for whole feature matrices at a time."""

    def __init__(self, model):
        feature, limit, left, right, value, roots = [], [], [], [], [], []

        def add(node, weight: float) -> int:
            k = len(feature)
            for x in (feature, limit, left, right, value):
                x.append(0)
            if node.subtreeDepth() == 0:
                value[k], left[k], right[k] = node.prediction() * weight, k, k
            else:
                feature[k], limit[k] = node.split().featureIndex(), node.split().threshold()
                left[k], right[k] = add(node.leftChild(), weight), add(node.rightChild(), weight)
            return k
        for tree, weight in zip(model.trees, model.treeWeights, strict=True):
            roots.append(add(tree._java_obj.rootNode(), weight))
        self.feature, self.left, self.right = (np.array(x, dtype=np.int64) for x in (feature, left, right))
        self.limit, self.value, self.roots = np.array(limit, dtype=float), np.array(value, dtype=float), roots

    def scores(self, x: np.ndarray, depth: int = DEPTH) -> np.ndarray:
        """Log-odds (Spark's boosting fits half of them)."""
        out = np.zeros(len(x))
        rows = np.arange(len(x))
        for root in self.roots:
            at = np.full(len(x), root)
            for _ in range(depth):
                at = np.where(x[rows, self.feature[at]] <= self.limit[at], self.left[at], self.right[at])
            out += self.value[at]
        return 2 * out


def _training_rows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        nodes = Nodes()
        for seed in frame["id"]:
            nodes.add(training_page(int(seed)))
        yield pd.DataFrame({"features": list(nodes.features()), "label": nodes.subtree_labels().astype(float)})


_MODELS: dict[tuple, Trees] = {}


def train(spark: SparkSession, pages: int = TRAINING_PAGES, trees: int = TREES, depth: int = DEPTH) -> Trees:
    """The trees; trained once a session for each setting."""
    key = (spark.sparkContext.applicationId, pages, trees, depth)
    if key not in _MODELS:
        rows = saved(spark.range(0, pages, 1, 4).mapInPandas(_training_rows, "features array<double>, label double"), "nodes")
        data = rows.select(array_to_vector("features").alias("features"), "label").coalesce(4).cache()
        model = GBTClassifier(maxIter=trees, maxDepth=depth, stepSize=0.3, seed=7, maxBins=64).fit(data)
        data.unpersist()
        _MODELS[key] = Trees(model)
    return _MODELS[key]


# -- extraction --------------------------------------------------------------------

def decode(nodes: Nodes, scores: np.ndarray) -> np.ndarray:
    """Mask of the kept nodes: the best tree from each page's root."""
    own = np.array([o[0] for o in nodes.own])
    gain = (scores * (1 + np.log1p(own))).tolist()
    parent = nodes.parent
    for k in range(len(gain) - 1, -1, -1):   # children come after their parents
        if gain[k] > 0 and parent[k] >= 0:
            gain[parent[k]] += gain[k]
    kept = [False] * len(gain)
    for k, p in enumerate(parent):
        kept[k] = p < 0 or kept[p] and gain[k] > 0
    return np.array(kept, dtype=bool)


def main_texts(trees: Trees, pages: list[str | None]) -> list[str]:
    nodes = Nodes()
    for p in pages:
        nodes.add(p or "")
    kept = decode(nodes, trees.scores(nodes.features()))
    out: list[list[str]] = [[] for _ in pages]
    for node, text in nodes.blocks:
        if kept[node]:
            out[nodes.page[node]].append(text)
    return ["\n".join(x) for x in out]


def _extract(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                rows = batch.slice(at, 200)
                texts = main_texts(shared.value, rows.column("html").to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [rows.column("page_id"), rows.column("url"), pa.array(texts, pa.string()),
                     pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])
    return run


def extract(pages: DataFrame, trees: Trees | None = None, *, id_col: str = "page_id", url_col: str = "url",
            html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) of each row.  Blocks are joined by one
    line feed, white space inside a block is one space.  A null or empty html
    has the empty text; rows without an id and repeated rows are returned as
    they come; other columns are not read."""
    spark = pages.sparkSession
    shared = Shared(spark, trees or train(spark))
    return (pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"),
                         F.col(html_col).cast("string").alias("html"))
            .mapInArrow(_extract(shared), "page_id long, url string, text string, n_chars long"))


def query(spark, sf_dir: str) -> DataFrame:
    """op2: all ``pages``."""
    from cobi.llm.common import table
    return extract(table(spark, sf_dir, "pages"))
