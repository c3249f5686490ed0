"""HTML to block nodes: a forgiving parser and the features of its nodes.

Nodes are the block elements of a page.  Inline elements (links, emphasis,
``br``) only add to the text and its statistics; scripts, styles and the like
are passed over.  Text between two block limits is one block of its node.
"""

from __future__ import annotations

import html as entities
import re

import numpy as np

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)(?:>|\Z)",
                  re.S)
_ATTRIBUTE = re.compile(r"([a-zA-Z_:][-\w:.]*)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+)|([a-zA-Z_:][-\w:.]*)")
_TOKEN = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")

PASSED_OVER = frozenset("script style noscript template svg iframe object canvas select button textarea title audio "
                        "video math datalist".split())
#: of these, the ones whose text is no markup: without an end tag they run to the end of the page
RAW_TEXT = frozenset("script style noscript iframe textarea title".split())
_SECTIONS = "p div section article main nav header footer aside form ul ol li dl dt dd table tr td th".split()
_BLOCKS = _SECTIONS + ("h1 h2 h3 h4 h5 h6 blockquote pre figure figcaption address body html hr thead tbody tfoot caption "
                       "fieldset legend details summary dialog center label").split()
BLOCK = {t: k for k, t in enumerate(_BLOCKS)}
_VOID = frozenset(["hr"])
_INSIDE_P = frozenset(t for t in _BLOCKS if t not in ("label",))     # opening one of these ends a paragraph
_CLOSES = {"li": (["li"], ["ul", "ol"]), "dt": (["dt", "dd"], ["dl"]), "dd": (["dt", "dd"], ["dl"]),
           "tr": (["tr", "td", "th"], ["table"]), "td": (["td", "th"], ["tr", "table"]), "th": (["td", "th"], ["tr", "table"]),
           "tbody": (["thead", "tbody", "tfoot", "tr", "td", "th"], ["table"])}

#: tags as features: one for each kind
TAG_KINDS = [("p",), ("div", "center"), ("section",), ("article",), ("main",), ("nav",), ("header",), ("footer",), ("aside", "dialog"),
             ("form", "fieldset", "label", "legend"), ("ul", "ol", "dl"), ("li", "dt", "dd"),
             ("table", "tr", "td", "th", "tbody", "thead", "tfoot"), ("h1",), ("h2", "h3", "h4", "h5", "h6"),
             ("blockquote", "pre"), ("figure", "figcaption", "caption"), ("address",), ("body", "html")]
_KIND = {t: k for k, ts in enumerate(TAG_KINDS) for t in ts}

#: words of id, class and role that tell what an element is for
TOKEN_KINDS = [
    set("content article post entry story main text body page prose blog news".split()),
    set("nav navbar navigation menu menubar breadcrumb breadcrumbs crumb crumbs pager pagination tabs toc topbar".split()),
    set("ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner adsense adslot dfp".split()),
    set("footer foot copyright legal colophon bottom contentinfo imprint".split()),
    set("header masthead head logo branding top hero".split()),
    set("sidebar side aside widget widgets related recommended recommendations popular trending more teaser complementary "
        "rail".split()),
    set("share sharing social follow tags meta byline author tools rating".split()),
    set("comment comments commentlist reply replies respond disqus discussion thread reader feedback".split()),
    set("cookie cookies consent gdpr notice alert popup modal overlay newsletter subscribe signup paywall privacy "
        "dialog toast".split()),
    set("login search form register input contact".split()),
]
_WORD_KIND = {w: k for k, ws in enumerate(TOKEN_KINDS) for w in ws}
HIDDEN = len(TOKEN_KINDS)
N_MARKS = HIDDEN + 1


_LINK = re.compile(r"<(/?)a[\s>]", re.I)
_BLOCK_TAG = re.compile(rf"</?(?:{'|'.join(_BLOCKS)})[\s/>]", re.I)


def _after(source: str, name: str, at: int) -> int:
    """Where a passed-over element that opens before ``at`` ends: after its end
    tag; without one, at the next block, or at the end of the page for raw text."""
    depth = 1
    for m in re.compile(rf"<(/?){name}(?=[\s/>])[^>]*(?:>|\Z)", re.I).finditer(source, at):
        if m[1]:
            depth -= 1
        elif name not in RAW_TEXT and not m[0].endswith("/>"):
            depth += 1
        if not depth:
            return m.end()
    block = None if name in RAW_TEXT else _BLOCK_TAG.search(source, at)
    return block.start() if block else len(source)


class Nodes:
    """Nodes of many pages in one set of lists; ``block`` entries are
    (node, text) in page order."""

    def __init__(self):
        self.page: list[int] = []
        self.parent: list[int] = []
        self.depth: list[int] = []
        self.tag: list[int] = []
        self.marks: list[int] = []      # bits of TOKEN_KINDS and HIDDEN
        self.label: list[int] = []      # of training pages
        self.own: list[list[float]] = []  # statistics of the node's own text
        self.inline: list[int] = []     # inline tags in it
        self.blocks: list[tuple[int, str]] = []
        self.pages = 0

    def _open(self, parent: int, name: str, attributes: str) -> int:
        marks = label = 0
        if attributes:
            for a, value, bare in _ATTRIBUTE.findall(attributes):
                a = (a or bare).lower()
                if a in ("class", "id", "role"):
                    for t in _TOKEN.findall(value):
                        k = _WORD_KIND.get(t.lower())
                        if k is not None:
                            marks |= 1 << k
                elif a == "hidden" or a == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value) \
                        or a == "aria-hidden" and "true" in value:
                    marks |= 1 << HIDDEN
                elif a == "data-y":
                    label = 1
        self.page.append(self.pages)
        self.parent.append(parent)
        self.depth.append(self.depth[parent] + 1 if parent >= 0 else 0)
        self.tag.append(BLOCK[name])
        self.marks.append(marks)
        self.label.append(label)
        self.own.append([0.0] * 7)
        self.inline.append(0)
        return len(self.tag) - 1

    def add(self, source: str) -> None:
        root = self._open(-1, "html", "")
        stack, names = [root], ["html"]
        words: list[str] = []
        linked, closed, link_chars = False, True, 0
        at, end = 0, len(source)

        def flush() -> None:
            nonlocal link_chars, linked
            if words:
                text = " ".join("".join(words).split())
                if text:
                    node = stack[-1]
                    self.blocks.append((node, text))
                    own = self.own[node]
                    own[0] += len(text)
                    own[1] += text.count(" ") + 1
                    own[2] += min(link_chars, len(text))
                    own[3] += sum(map(text.count, ".!?"))
                    own[4] += text.count(",")
                    own[5] += 1
                    own[6] += sum(map(text.count, "©|·»•"))
                words.clear()
            link_chars = 0
            linked = linked and closed      # a link without its end tag ends with its block

        def close(down_to: int) -> None:
            flush()
            del stack[down_to:], names[down_to:]

        def text(piece: str) -> None:
            nonlocal link_chars
            if "&" in piece:
                piece = entities.unescape(piece)
            words.append(piece)
            if linked:
                link_chars += len(piece.strip())
        while at < end:
            m = _TAG.search(source, at)
            if m is None:
                text(source[at:])
                break
            if m.start() > at:
                text(source[at:m.start()])
            at = m.end()
            name = m[2]
            if name is None:
                continue
            name = name.lower()
            if name in PASSED_OVER:
                if not m[1] and not m[3].endswith("/"):
                    at = _after(source, name, at)
                    words.append(" ")
                continue
            if name not in BLOCK:
                if name == "a":
                    linked = not m[1]
                    following = _LINK.search(source, at) if linked else None
                    closed = not linked or following is not None and bool(following[1])
                elif name in ("br", "img", "input"):
                    words.append(" ")
                self.inline[stack[-1]] += not m[1]
                continue
            if m[1]:
                if name in names[1:]:
                    close(len(names) - 1 - names[::-1].index(name))
                elif name not in ("html", "p"):
                    flush()
                continue
            if name in ("html", "body") and name in names:
                continue
            flush()
            if "p" in names and name in _INSIDE_P:
                close(len(names) - 1 - names[::-1].index("p"))
            if name in _CLOSES:
                own, limits = _CLOSES[name]
                for k in range(len(names) - 1, 0, -1):
                    if names[k] in limits:
                        break
                    if names[k] in own:
                        close(k)
            node = self._open(stack[-1], name, m[3])
            if name not in _VOID:
                stack.append(node)
                names.append(name)
        flush()
        self.pages += 1

    def features(self) -> np.ndarray:
        """One row a node: tag, marks of it and of what it lies in, its text,
        density of its subtree, depth, and how its siblings are."""
        n = len(self.tag)
        page, parent, depth = (np.array(x, dtype=np.int64) for x in (self.page, self.parent, self.depth))
        kinds = np.array([_KIND.get(t, -1) for t in _BLOCKS])[np.array(self.tag, dtype=np.int64)]
        marks = (np.array(self.marks, dtype=np.int64)[:, None] >> np.arange(N_MARKS) & 1).astype(np.float64)
        tags = np.zeros((n, len(TAG_KINDS)))
        tags[np.arange(n)[kinds >= 0], kinds[kinds >= 0]] = 1
        own = np.array(self.own).reshape(n, 7)
        under = np.concatenate([own, np.array(self.inline, dtype=np.float64)[:, None], np.ones((n, 1))], axis=1)
        above_marks, above_tags = marks.copy(), tags.copy()
        for d in range(int(depth.max(initial=0)), 0, -1):
            at = np.flatnonzero(depth == d)
            np.add.at(under, parent[at], under[at])
        order = np.argsort(depth, kind="stable")
        for d in range(1, int(depth.max(initial=0)) + 1):
            at = order[np.searchsorted(depth[order], d):np.searchsorted(depth[order], d + 1)]
            above_marks[at] = np.maximum(above_marks[at], above_marks[parent[at]])
            above_tags[at] = np.maximum(above_tags[at], above_tags[parent[at]])
        up = np.maximum(parent, 0)
        siblings = np.bincount(up, minlength=n)[up].astype(np.float64)
        chars, links, tags_in = under[:, 0], under[:, 2], under[:, 7] + under[:, 8]
        sibling_chars = np.bincount(up, weights=chars, minlength=n)[up] / np.maximum(siblings, 1)
        sibling_links = np.bincount(up, weights=links, minlength=n)[up] / np.maximum(siblings * sibling_chars, 1)
        same = np.unique(np.stack([up, kinds]), axis=1, return_inverse=True, return_counts=True)
        same = same[2][same[1].ravel()].astype(np.float64)
        total = np.bincount(page, weights=own[:, 0], minlength=self.pages)[page]
        before = np.cumsum(own[:, 0]) - own[:, 0]
        first = np.full(self.pages, np.inf)
        np.minimum.at(first, page, before)
        place = (before - first[page]) / np.maximum(total, 1)
        plain = np.stack([
            np.log1p(chars), np.log1p(own[:, 0]), links / np.maximum(chars, 1), own[:, 2] / np.maximum(own[:, 0], 1),
            chars / tags_in, under[:, 3] / np.maximum(under[:, 1], 1), under[:, 4] / np.maximum(under[:, 1], 1),
            own[:, 3], np.minimum(own[:, 6], 5), under[:, 1] / np.maximum(under[:, 5], 1), depth.astype(np.float64),
            siblings, same, np.log1p(sibling_chars), sibling_links, chars / np.maximum(total, 1), place,
            np.log1p(total), under[:, 8], own[:, 5]], axis=1)
        return np.concatenate([tags, above_tags[:, 2:10], marks, above_marks, plain], axis=1)

    def subtree_labels(self) -> np.ndarray:
        """1 for training nodes that hold marked text anywhere below."""
        out = np.array(self.label, dtype=np.int64)
        for k in range(len(out) - 1, -1, -1):
            if out[k] and self.parent[k] >= 0:
                out[self.parent[k]] = 1
        return out
