"""HTML extraction: the maximum-scoring subsequence of words and tags.

A page is read once into a tree of elements and blocks of text with the tags between them.  Every word of a block has the
same score, the log odds, squeezed into (-1, 1), that such a block is content; every tag has a negative score.  One
linear scan finds the contiguous run of words and tags with the largest sum: the content region.  It grows to the element
that holds it, where that element scores above 0 itself.  A second scan, over the region with the signs changed, finds all
runs of boilerplate within it, and they are cut out.  Nothing else decides: content beyond more boilerplate than it is
worth is left out, unless one element holds both.

The weights come from labelled pages: :func:`labelled_pages` makes small pages in many layouts whose fragments are
marked as content or not, and :func:`learn` fits a logistic model on

* the tags, classes, ids and roles above a block.  Those of a *wrapper* say nothing: the article, whatever holds it, or, on
  pages without an article, what holds most of the words (``<body class="has-sidebar">``, ``<article class="post
  comments-open">``).  Names that the labelled pages do not have count as unknown ones.  The words of a name with three or
  more, or with a joining word (``comment-on-law``), are features of their own kind, which say less than
  ``user-comment``: content has such names too;
* its share of link words, its length, whether it reads like a sentence, whether a small container with an unknown name
  holds it, and whether it lies inside the article, or outside that of a page that has one.

The article is the element article or main with the most words, or the smallest in it that has most of those.  A header
within it, which has the headline, belongs to it; the page's header does not.

Defined results: a null html is empty and gives an empty text; a page without a content block gives an empty text;
unclosed elements end where HTML would end them, or with the page; a tag, comment or script that is never closed takes
the rest of the page.  Reading takes time in proportion to the page, however broken.  Repeated rows are returned as often
as they occur; other columns are not looked at.
"""

from __future__ import annotations

import functools
import html as entities
import random
import re
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.batches import map_batches


def _value(group: str) -> str:
    return rf"\s*+=\s*+(?:\"{group}[^\"]*+)\"|'{group}[^']*+)'|{group}[^\s>\"'][^\s>]*+)|)"


# Possessive throughout: a tag is read once, to its end or to the end of the page.  A quote only counts after "=".
_NAME = r"(?:=?+[^\s/>=]++|=)"
_TAG = re.compile(rf"<(/?)([a-zA-Z][^\s/>]*+)((?:[\s/]++|{_NAME}(?:{_value('(?:')})?+)*+)>")
_ATTRIBUTE = re.compile(rf"({_NAME})(?:{_value('(')})?+")
_PART = re.compile(r"[a-z]+")
_RAW = {name: re.compile(rf"</{name}(?=[\s/>])", re.I) for name in ("script", "style", "iframe", "textarea", "title")}
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr br".split())
_UNSHOWN = frozenset("datalist noscript select svg template".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_CLOSES_P = frozenset("address article aside blockquote div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
_SAME = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "p": ("p",)}
_JOINING = frozenset("a an and at by de for from in la of on or the to with".split())
_BOX = frozenset("div section ul ol dl table aside".split())
_SPACE = re.compile(r"\s+")
_SENTENCE = re.compile(r"[.!?…:;。！？][\"'”’»)\]]*\s*$")
_EMPTY: frozenset[str] = frozenset()


class Block:
    __slots__ = ("base", "links", "node", "tags", "text", "words")

    def __init__(self, node: int, base: int, tags: int):
        self.node, self.base, self.tags, self.text, self.words, self.links = node, base, tags, [], 0, 0


class Page:
    """Blocks, and of every element its parent, tag and names; element 0 is the page, parents come first."""

    def __init__(self) -> None:
        self.blocks: list[Block] = []
        self.parent, self.tag, self.names = [0], [""], [_EMPTY]

    def open(self, parent: int, tag: str, names: frozenset[str]) -> int:
        self.parent.append(parent)
        self.tag.append(tag)
        self.names.append(names)
        return len(self.tag) - 1


def read(page: str, hide: bool = True) -> Page:
    """The page's blocks of text, with the number of tags before each.  Text of elements that are not shown is left out,
    unless one is never closed: then hiding would take the rest of the page."""
    out = Page()
    stack, open_ = [0], Counter()  # open elements, and how many there are of each tag
    outer = [0]  # places in the stack of those that are not inline
    now: Block | None = None
    tags, links, hidden, pos = 0, 0, 0, 0

    def add(text: str) -> None:
        nonlocal now, tags
        if not text or hidden or (now is None and text.isspace()):
            return
        if now is None:
            now = Block(stack[-1], stack[outer[-1]], tags)
            out.blocks.append(now)
            tags = 0
        elif now.node != stack[-1] and not text.isspace():
            now.node = now.base  # an inline element that does not hold all of the block
        now.text.append(text)
        n = len(text.split())
        now.words += n
        now.links += n * bool(links)

    def close(at: int) -> None:
        """Ends the elements from that place in the stack on."""
        for x in stack[at:]:
            open_[out.tag[x]] -= 1
        del stack[at:]
        while outer[-1] >= at:
            outer.pop()

    while True:
        at = page.find("<", pos)
        if at < 0:
            add(page[pos:])
            break
        m = _TAG.match(page, at)
        if m is None:
            after = page[at + 1 : at + 2]
            if page.startswith("<!--", at):
                end = page.find("-->", at + 2)
                end = end + 3 if end >= 0 else len(page)
            elif after and after in "!?/":
                end = page.find(">", at) + 1 or len(page)
            elif after.isascii() and after.isalpha():
                end = len(page)
            else:  # no tag, but a sign
                add(page[pos : at + 1])
                pos = at + 1
                continue
            add(page[pos:at])
            pos = end
            continue
        add(page[pos:at])
        pos = m.end()
        closes, name, attributes = m[1], m[2].lower(), m[3]
        tags += 1
        if name in _RAW:
            if not closes:
                end = _RAW[name].search(page, pos)
                pos = end.start() if end else len(page)
            if name == "title":
                now = None
            continue
        if name in _UNSHOWN:
            if hide and not attributes.endswith("/"):
                hidden = max(0, hidden - 1) if closes else hidden + 1
            continue
        if hidden:
            continue
        if name == "a":
            links = 0 if closes else 1
        if name in _INLINE:
            if name == "br":
                add(" ")
            if not closes and name not in _VOID and name != "a" and attributes and (own := _own(attributes)):
                stack.append(out.open(stack[-1], name, own))
                open_[name] += 1
            elif closes and len(stack) > 1 and out.tag[stack[-1]] == name:
                close(len(stack) - 1)
            continue
        now = None
        ends = (name,) if closes else ("p",) if name in _CLOSES_P and name != "p" else _SAME.get(name, ())
        if any(open_[x] for x in ends):
            for k in range(len(outer) - 1, 0, -1):
                tag = out.tag[stack[outer[k]]]
                if tag in ends:
                    close(outer[k])
                    break
                if not closes and tag != "p":
                    break
        if not closes and name not in _VOID:
            outer.append(len(stack))
            stack.append(out.open(stack[-1], name, _own(attributes) if attributes else _EMPTY))
            open_[name] += 1
    if hidden:
        return read(page, hide=False)
    out.blocks = [b for b in out.blocks if b.words]
    return out


def _own(attributes: str) -> frozenset[str]:
    out = set()
    for key, a, b, c in _ATTRIBUTE.findall(attributes):
        key = key.lower()
        if key == "hidden" or (key == "style" and "display:none" in (a or b or c).replace(" ", "").lower()):
            out.add("hidden")
        elif key in ("class", "id", "role"):
            for token in (a or b or c).lower().split():
                parts = _PART.findall(token)
                kind = "role" if key == "role" else "part" if len(parts) > 2 or not _JOINING.isdisjoint(parts) else "name"
                out.update(f"{kind}:{x}" for x in parts)
    return frozenset(out)


def features(page: Page, known: frozenset[str]) -> list[tuple[frozenset[str], tuple[str, ...]]]:
    """What the model sees of every block: the known tags, names and roles above it, and what it is like."""
    n = len(page.tag)
    words = [0] * n
    for b in page.blocks:
        words[b.node] += b.words
    last = list(range(n))  # the last element within each
    for e in range(n - 1, 0, -1):
        words[page.parent[e]] += words[e]
        last[page.parent[e]] = max(last[page.parent[e]], last[e])
    whole = [e for e in range(n) if (page.tag[e] in ("article", "main") or "role:main" in page.names[e]) and words[e]]
    article = 0
    for e in whole:  # outer ones first: a larger one beside, or one in the present one that has most of its words
        if not article or (words[e] > words[article] if e > last[article] else 2 * words[e] > words[article]):
            article = e
    wrappers = {0}
    e = article
    while e:
        wrappers.add(e)
        e = page.parent[e]
    if not article:
        heads = [e for e in range(n) if page.tag[e] == "h1"]
        wrappers |= {e for e in range(n) if 3 * words[e] > 2 * words[0] and (not heads or e <= heads[0] <= last[e])}
    most = max((words[e] for e in whole), default=0)
    above, inside, boxed = [_EMPTY] * n, [False] * n, [False] * n
    for e in range(1, n):
        up = page.parent[e]
        tag, names = page.tag[e], _EMPTY if e in wrappers or page.tag[e] in ("html", "body") else page.names[e]
        own = {x for x in names if x in known}
        inside[e] = inside[up] or e == article or (e in whole and 3 * words[e] >= most)
        if tag not in _INLINE and f"tag:{tag}" in known and not (tag == "header" and inside[e]):
            own.add(f"tag:{tag}")
        above[e] = above[up] if own <= above[up] else above[up] | own
        strange = any(x.startswith(("name:", "part:")) for x in names) and not (own & names)
        boxed[e] = boxed[up] or (strange and tag in _BOX and 4 * words[e] < words[0])
    out = []
    for b in page.blocks:
        like = (
            ("inside" if inside[b.node] else "outside") if article else "",
            "links" if b.links * 2 > b.words else "",
            "boxed" if boxed[b.node] else "",
            "sentence" if _SENTENCE.search(b.text[-1][-8:]) else "",
            "long" if b.words >= 12 else "brief" if b.words < 4 else "middling",
        )
        out.append((above[b.node], like))
    return out


# What the weights are learned from.  Names of parts that are no content, the shapes that carry such a
# name (X), fragments that are no content whatever their names, and bodies; {} is filled with words, ~ splits a body.
_NAMES = """nav navbar navigation menu breadcrumb breadcrumbs header masthead banner topbar toolbar skip cookie cookies consent gdpr
    notice notices notification alert popup modal overlay disclaimer search searchbox ad ads advert adverts advertisement sponsor
    sponsored promo promotion footer copyright legal colophon sidebar widget aside related recommended outbrain taboola trending popular
    comments comment commentlist reply replies respond responses discussion disqus feedback share sharing social follow newsletter
    subscribe subscription signup login register account paywall pagination pager rail teaser form""".split()
_SHAPES = [
    '<div class="X">{}</div>', '<div id="X"><p>{}</p></div>', '<p class="X">{}</p>', '<section class="X"><h3>{}</h3><p>{}</p></section>', '<ul class="X"><li>{}</li><li>{}</li></ul>',
    '<div class="X"><a href="/a">{}</a></div>', '<div class="site-X-area"><p>{}</p></div>', '<div class="user-X box"><div><p>{}</p></div></div>', '<ol id="X"><li><p>{}</p></li></ol>', '<div class="post-X"><h4>{}</h4><span>{}</span></div>',
]
_PLAIN = [
    '<header><a href="/">{}</a></header>', '<header><p>{}</p></header>', '<nav><ul><li><a href="/a">{}</a></li><li><a href="/b">{}</a></li></ul></nav>', '<nav><p>{}</p></nav>',
    '<div role="navigation"><ul><li><a href="/a">{}</a></li></ul></div>', '<div role="alert"><p>{}</p></div>', '<form action="/s"><label>{}</label><input name="q"></form>', '<form><p>{}</p><button>{}</button></form>',
    '<div role="banner">{}</div>', '<div role="search">{}</div>', '<dialog>{}</dialog>', '<footer><p>{}</p></footer>', '<footer>{}</footer>', '<aside><p>{}</p></aside>', '<aside><h3>{}</h3><ul><li>{}</li></ul></aside>',
    '<div role="complementary"><p>{}</p></div>', '<div role="contentinfo">{}</div>', '<div hidden><p>{}</p></div>', '<button>{}</button>', '<menu><li>{}</li></menu>',
]
_BODIES = [
    '<article><h1>{}</h1><p>{}</p><p>{}</p>~<p>{}</p></article>', '<main><h1>{}</h1><p>{}</p><p>{}</p>~<p><b>{}</b></p></main>', '<main id="main"><article class="post"><h2>{}</h2><p>{}</p>~<p>{}</p></article></main>',
    '<div class="content"><h1>{}</h1><p>{}</p><p>{}</p>~<p>{}</p></div>', '<div id="content"><p>{}</p><p>{}</p>~<ul><li>{}</li></ul></div>', '<div class="post"><h2>{}</h2><p>{}</p>~<p>{}</p></div>',
    '<div class="entry-content"><p>{}</p><p>{}</p>~<blockquote>{}</blockquote></div>', '<div class="story article-body"><p>{}</p><h2>{}</h2>~<p>{}</p></div>', '<section class="text"><p>{}</p>~<p>{}</p><p>{}</p></section>',
    '<p>{}</p><p>{}</p>~<p>{}</p>', '<table><tr><td><p>{}</p><p>{}</p>~<p>{}</p></td></tr></table>', '<div><div>{}</div><div>{}</div>~<div>{}</div></div>', '<div role="main"><p>{}</p><p>{}</p>~<p>{}</p></div>',
    '<article class="article"><p>{}</p><p>{}</p>~<pre>{}</pre><ol><li>{}</li></ol></article>', '<div class="page wrapper container"><div class="body"><p>{}</p><p>{}</p>~<p>{}</p></div></div>',
    '<article><header><h1>{}</h1></header><div class="article-text"><p class="lead">{}</p><p>{}</p>~<figure><figcaption>{}</figcaption></figure></div></article>',
    '<article><h1>{}</h1><section class="zz"><h2>{}</h2><p>{}</p></section><section class="zz"><p>{}</p><p>{}</p></section>~<section class="zz"><h3>{}</h3><p>{}</p></section></article>',
    '<div class="content"><h1>{}</h1><div class="zz"><p>{}</p></div><div class="zz"><p>{}</p></div><div class="zz">{}</div>~<div class="zz"><p>{}</p></div><div class="zz"><h4>{}</h4><span>{}</span></div></div>',
    '<main><h1>{}</h1><p>{}</p><h3>{}</h3><ul><li>{}</li><li>{}</li><li>{}</li></ul>~<h4>{}</h4><p>{}</p><dl><dt>{}</dt><dd>{}</dd></dl></main>',
    '<article><h1>{}</h1><p class="X-on-zz">{}</p><p>{}</p>~<p class="zz-for-X">{}</p><p>{}</p></article>', '<article><h2>{}</h2><div class="the-X-zz"><p>{}</p><p>{}</p></div>~<div class="zz-and-X"><p>{}</p></div></article>',
    '<div class="post"><h1>{}</h1><p class="about-the-X">{}</p>~<p>{}</p><p id="X-with-zz">{}</p></div>',
    '<article><h1>{}</h1><p>{}</p><ul class="zz"><li>{}</li><li>{}</li></ul>~<h3>{}</h3><ol><li>{}</li><li>{}</li></ol><table><tr><th>{}</th><td>{}</td></tr></table></article>',
]
_SLOT = re.compile(r"<(\w+)[^<>]*>\{\}")


def _filled(fragment: str, content: bool, rng: random.Random) -> str:
    """Words for each slot, as many as its element usually has."""

    def words(m: re.Match) -> str:
        tag = m[1]
        least, most, ends = (1, 3, 0.0) if tag in ("a", "button", "label") else (1, 8, 0.0) if tag[0] == "h" else (2, 9, 0.4) if tag in ("li", "span") else (3, 60, 0.9) if content else (2, 30, 0.6)
        n = rng.randint(least, most)
        return m[0][:-2] + " ".join(["words"] * n) + ("." if rng.random() < ends else "")

    return _SLOT.sub(words, fragment)


def labelled_pages(names: list[str] = _NAMES, seed: int = 5, shapes: list[str] = _SHAPES) -> Iterator[tuple[str, list[bool]]]:
    """Pages, and for each of their blocks whether it is content: every name in every shape, and every plain fragment,
    before, within and after some body.  Some names are replaced by unknown ones, for names to come."""
    rng = random.Random(seed)
    fragments = [shape.replace("X", name) for name in names for shape in shapes] + _PLAIN * 6
    for i, fragment in enumerate(f for f in fragments for _ in range(3)):
        body = re.sub(r"\bX\b", lambda _: rng.choice(names), _BODIES[(i * 7 + i // len(_BODIES)) % len(_BODIES)])
        first, second = body.split("~")
        other = fragments[(i * 31 + 17) % len(fragments)]
        if rng.random() < 0.1:
            fragment = re.sub(r"(class|id)=\"[^\"]*\"", r'\1="zz"', fragment)
        parts = [[(first, True), (second, True)], [(fragment, False), (first, True), (second, True), (other, False)], [(first, True), (fragment, False), (second, True)], [(other, False), (first, True), (second, True), (fragment, False)]][i % 4]
        marks = [c for text, c in parts for _ in range(text.count("{}"))]
        yield "".join(_filled(text, c, rng) for text, c in parts), marks


Model = tuple[dict[str, float], float, float]


@functools.cache
def learn() -> Model:
    """Weights of the features, the bias, and the score of a tag."""
    return fit(labelled_pages())


def fit(pages: Iterable[tuple[str, list[bool]]]) -> Model:
    rows: list[frozenset[str]] = []
    labels, tags, words = [], 0, 0
    for text, marks in pages:
        found = read(text)
        # A name that the labelled pages hide is not known either.
        rows += [above.union(filter(None, like)) for above, like in features(found, _Known())]
        labels += marks
        tags += sum(b.tags for b, c in zip(found.blocks, marks, strict=True) if c)
        words += sum(b.words for b, c in zip(found.blocks, marks, strict=True) if c)
    names = sorted(set().union(*rows))
    column = {n: i for i, n in enumerate(names)}
    x = np.zeros((len(rows), len(names)))
    for i, r in enumerate(rows):
        x[i, [column[n] for n in r]] = 1
    # Equal rows are one row with a count.
    x, count = np.unique(np.hstack([x, np.ones((len(rows), 1)), np.array(labels, dtype=float)[:, None]]), axis=0, return_counts=True)
    x, y, w = x[:, :-1], x[:, -1], np.zeros(len(names) + 1)
    ridge = 0.05 * np.append(np.ones(len(names)), 0)
    for _ in range(15):  # Newton's method for the logistic loss
        p = 1 / (1 + np.exp(-(x @ w)))
        w -= np.linalg.solve((x * (count * p * (1 - p))[:, None]).T @ x + np.diag(ridge + 1e-9), x.T @ (count * (p - y)) + ridge * w)
    w, b = w[:-1], w[-1]
    return {n: float(v) for n, v in zip(names, w, strict=True)}, float(b), -0.25 * min(1.0, words / tags)


class _Known(frozenset):
    """While learning, every name but the hidden one is known."""

    def __contains__(self, name: object) -> bool:
        return name not in ("name:zz", "part:zz")


def log_odds(page: Page, model: Model) -> list[float]:
    weights, bias, _ = model
    known = frozenset(weights)
    cache: dict[Iterable[str], float] = {}

    def total(names: frozenset[str] | tuple[str, ...]) -> float:
        if names not in cache:
            cache[names] = sum(weights.get(f, 0.0) for f in sorted(names))
        return cache[names]

    return [bias + total(above) + total(like) for above, like in features(page, known)]


FLOOR = 12.0
SURE = 0.5


def scores(tree: Page, odds: list[float], tag: float) -> tuple[list[float], list[float]]:
    """Of every block the score of its words and that of the tags before it.

    A block counts at most ``FLOOR`` against the run that it lies in, however long it is: an advert or a list of comments
    within an article does not part it.
    """
    return [max(b.words * float(np.tanh(o / 2)), -FLOOR) for b, o in zip(tree.blocks, odds, strict=True)], [tag * b.tags for b in tree.blocks]


def best_run(words: list[float], tags: list[float]) -> tuple[int, int]:
    """The contiguous run of blocks ``[first, last)`` with the largest sum of words and of the tags between them; the tags
    before its first block do not count.  Empty if no block scores above 0; of equal runs the first that ends, as short as
    can be.  One linear scan: the best run that ends here either goes on or starts anew."""
    best, run, start, found = 0.0, 0.0, 0, (0, 0)
    for i, (w, t) in enumerate(zip(words, tags, strict=True)):
        run += t
        if run <= 0:
            run, start = 0.0, i
        run += w
        if run > best:
            best, found = run, (start, i + 1)
    return found


def maximal_runs(values: list[float]) -> list[tuple[int, int, float]]:
    """All disjoint runs ``(first, last, sum)`` with a sum that no longer or shorter run in their place exceeds, in linear
    time (Ruzzo and Tompa, "A Linear Time Algorithm for Finding All Maximal Scoring Subsequences")."""
    held: list[tuple[int, int, float, float]] = []  # first, last, and the sums of all values before it and to its end
    total = 0.0
    for i, v in enumerate(values):
        before, total = total, total + v
        if v <= 0:
            continue
        run = (i, i + 1, before, total)
        while True:
            k = len(held) - 1
            while k >= 0 and held[k][2] >= run[2]:
                k -= 1
            if k < 0 or held[k][3] >= run[3]:
                break
            run = (held[k][0], run[1], held[k][2], run[3])
            del held[k:]
        held.append(run)
    return [(a, b, high - low) for a, b, low, high in held]


def grown(tree: Page, first: int, last: int, words: list[float]) -> tuple[int, int]:
    """The run, grown to all blocks of the smallest element around the elements of its blocks: a headline of one word or a last
    line after an advert does not pay for the tags before it.  Not to the whole page, nor to an element whose blocks score
    below 0 together."""
    if first == last:
        return first, last
    holder = tree.parent[tree.blocks[first].base]
    for b in tree.blocks[first + 1 : last]:
        other = tree.parent[b.base]
        while holder != other:  # parents have smaller numbers
            holder, other = (tree.parent[holder], other) if holder > other else (holder, tree.parent[other])
    if tree.tag[holder] in ("", "html", "body"):
        return first, last
    inside = [False] * len(tree.tag)
    inside[holder] = True
    for e in range(holder + 1, len(inside)):
        inside[e] = inside[tree.parent[e]]
    within = [i for i, b in enumerate(tree.blocks) if inside[b.base]]
    return (min(within), max(within) + 1) if sum(words[i] for i in within) > 0 else (first, last)


def content(tree: Page, odds: list[float], tag: float) -> list[int]:
    """The blocks of the main text: those of the best run, less the runs of boilerplate within it.

    Both are the same kind of scan.  The first finds the region, so what lies beyond more boilerplate than it is worth does
    not count, whatever it looks like, unless the same element holds it (:func:`grown`).  The second runs over the region with signs changed: what it finds is cut out if it
    scores more than ``SURE``, so a short block that only may be boilerplate stays with the text around it, and a
    block between two of boilerplate goes with them if it is worth less than either.
    """
    words, tags = scores(tree, odds, tag)
    first, last = grown(tree, *best_run(words, tags), words)
    out = [True] * (last - first)
    for a, b, total in maximal_runs([-w for w in words[first:last]]):
        if total > SURE:
            out[a:b] = [False] * (b - a)
    return [first + i for i, stays in enumerate(out) if stays]


def extract(page: str | None, model: Model | None = None) -> str:
    """The main text of a page, by these weights or the learned ones."""
    model = model or learn()
    tree = read(page or "")
    texts = (_SPACE.sub(" ", entities.unescape("".join(tree.blocks[i].text))).strip() for i in content(tree, log_odds(tree, model), model[2]))
    return "\n".join(t for t in texts if t)


def main_text(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars`` of every page ``(page_id, url, html)``."""

    model = learn()  # on the driver, once: a few kilobytes go with the tasks

    def work(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            text = [extract(h, model) for h in batch["html"]]
            yield pd.DataFrame({"page_id": batch["page_id"], "url": batch["url"], "text": text, "n_chars": [len(t) for t in text]})

    own = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return map_batches(own, work, "page_id long, url string, text string, n_chars long")
