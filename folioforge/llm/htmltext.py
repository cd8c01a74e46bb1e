"""Main text of web pages: boosted trees over DOM nodes, decoded top down.

A page is cut into tags and text once; block elements become nodes, inline elements only mark text
(links, line breaks). Each node has features of its subtree (text, link and tag density), its
attribute tokens, depth and siblings. Trees are fitted on a bounded sample of pages that mark their
article themselves (article, main, role=main): nodes in it, and above it, are positive. Every
sample page is learned from three times: as it is, with the marks that gave the labels hidden from
the features, so the trees also part pages that mark nothing, and as if what lies outside lay inside,
so that an advert in an article is known by what it is and not by its place. Decoding maximises the summed log odds
over the tree under one rule: a node is kept only if its parent is, so no decision of a node
contradicts that of an ancestor or descendant.
"""

from __future__ import annotations

import html as _html
import math
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import boost
from .common import bounded_batches, tidy

#: Pages used for fitting, those of the lowest hashes.
FIT_PAGES = 500

#: Element groups of HTML. RAW elements hold no markup and end at their end tag or the
#: page's end; HIDDEN ones hide what they hold if an end tag follows. The tags of a head are passed
#: over, as its end tag may be left out; what it may hold is raw or has no text.
RAW = "script style noscript iframe title textarea"
HIDDEN = frozenset("template svg math object canvas select datalist audio video".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img input ins kbd label mark meter output progress q rp rt ruby s samp small span strike strong sub sup time tt u var wbr br area map embed link meta base source track param picture".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
PARAGRAPHS = frozenset("p blockquote pre figure figcaption".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
LISTS = frozenset("ul ol li dl dt dd menu".split())
TABLES = frozenset("table thead tbody tfoot tr td th caption".split())
APART = frozenset("nav footer aside header form fieldset button dialog address details".split())
ARTICLES = frozenset(("article", "main"))
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
HOLDS = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}}
NOISE_WORDS = "ad ads advert advertisement adverts banner breadcrumb breadcrumbs comment comments consent cookie cookies disclaimer discuss disqus feedback footer form gdpr header login masthead menu modal nav navbar navigation newsletter notice pager pagination popup promo promoted promotion recommended related reply replies search share sharing sidebar signup skip social sponsor sponsored subscribe tags toolbar widget"
#: Words that make a name say how a page is laid out, not what an element is: has-sidebar, no-header, comments-open.
STATE_FIRST = frozenset("has have no not is are with without show shows hide hides can allow allows enable enables supports".split())
STATE_LAST = frozenset("open closed enabled disabled active inactive on off allowed none".split())
CONTENT_WORDS = "article articlebody body content entry main mainbody post story text"

_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_NOISE, _CONTENT = frozenset(NOISE_WORDS.split()), frozenset(CONTENT_WORDS.split())
_NAMES = re.compile(r"""(?<![\w-])(class|id|role|itemprop|aria-label)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.I)
#: Share of noise words from which a name counts as noise, and of a page's text from which it does not.
NOISY, MOST = 0.5, 0.6
_ATTRIBUTE = re.compile(r"""([^\s=/>"']+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""")
_MAY_HIDE = re.compile("hidden|display|role", re.I)
_NO_DISPLAY = re.compile(r"(?:^|;)\s*display\s*:\s*none\b", re.I)
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    rf"|<(?P<raw>{RAW.replace(' ', '|')})(?=[\s/>])[^>]*(?:>.*?(?:</(?P=raw)\s*>|\Z)|\Z)"
    r"|</(?P<end>[a-z][^\s/>]*)[^>]*(?:>|\Z)"
    r"""|<(?P<tag>[a-z][^\s/>]*)(?P<attrs>[^>"']*+(?:"[^"]*"[^>"']*+|'[^']*'[^>"']*+)*+)(?:>|\Z)"""
    r"|<[a-z!?/][^>]*(?:>|\Z)",
    re.I | re.S,
)


#: Feature that says a node lies in a part that the page marks.
WITHIN = 21


class Page:
    """Block nodes of a page in document order, and its text runs."""

    def __init__(self, html: str):
        self.tag, self.parent, self.depth, self.attr, self.marks = ["#root"], [-1], [0], [(0.0, False, False)], [False]
        self._html, self._ends = html, {}
        self.runs: list = []  # (node, [text, ...])
        self.chars, self.links, self.tags, self.stops, self.inputs = [0], [0], [0], [0], [0]
        stack, run, at, linked, unseen = [0], None, 0, False, 0
        for m in _TOKEN.finditer(html):
            if m.start() < unseen:  # inside a hidden element
                at = max(unseen, m.end())
                continue
            if m.start() > at:
                run = self._text(html[at : m.start()], stack[-1], run, linked)
            at = m.end()
            if m["tag"]:
                tag = m["tag"].lower()
                node = stack[-1]
                if tag == "head":
                    continue
                if tag in HIDDEN and not m["attrs"].endswith("/"):
                    end = self._end_of(tag, m.start())
                    if end:
                        unseen = at = end
                        continue
                if tag in INLINE:
                    if m["attrs"] and tag not in VOID:
                        noise, content, hide, _ = self._named(m["attrs"], tag)
                        end = self._end_of(tag, m.start()) if hide or noise == 1 and not content else None
                        if end:
                            unseen = at = end
                            continue
                    self.tags[node] += 1
                    if tag == "a":
                        linked = True
                    elif tag == "br" and run is not None:
                        run[1].append(" ")
                    elif tag == "input":
                        self.inputs[node] += 1
                    continue
                run = None
                self._close_for(tag, stack)
                self.parent.append(stack[-1])
                self.depth.append(len(stack))
                self.tag.append(tag)
                *attr, main = self._named(m["attrs"], tag)
                self.attr.append(tuple(attr))
                self.marks.append(main or tag in ARTICLES)
                for x in (self.chars, self.links, self.stops, self.inputs):
                    x.append(0)
                self.tags.append(1)
                if tag not in VOID and not m["attrs"].endswith("/"):
                    stack.append(len(self.tag) - 1)
            elif m["end"]:
                tag = m["end"].lower()
                if tag == "a":
                    linked = False
                if tag in INLINE:
                    continue
                for k in range(len(stack) - 1, 0, -1):
                    if self.tag[stack[k]] == tag:
                        del stack[k:]
                        run, linked = None, False
                        break
        if at < len(html):
            self._text(html[at:], stack[-1], run, linked)

    def _close_for(self, tag: str, stack: list) -> None:
        if self.tag[stack[-1]] == "p" or self.tag[stack[-1]] in HEADINGS and tag in HEADINGS:
            stack.pop()
        if tag in CLOSES:
            for k in range(len(stack) - 1, 0, -1):
                if self.tag[stack[k]] in HOLDS[tag]:
                    break
                if self.tag[stack[k]] in CLOSES[tag]:
                    del stack[k:]
                    break

    def _end_of(self, tag: str, start: int) -> int | None:
        """Where the element whose start tag is at ``start`` ends, by depth; None if it never does."""
        if tag not in self._ends:
            ends, open_ = {}, []
            for m in re.finditer(rf"<(/?){re.escape(tag)}(?=[\s/>])(?:[^>\"']*(?:\"[^\"]*\"|'[^']*')?)*?(/?)>", self._html, re.I):
                if m[1]:
                    if open_:
                        ends[open_.pop()] = m.end()
                elif not m[2]:
                    open_.append(m.start())
            self._ends[tag] = ends
        return self._ends[tag].get(start)

    @staticmethod
    def _named(attrs: str, tag: str) -> tuple:
        """How far a name says noise (the largest share of noise words in one name), whether one says content, whether the element is hidden or the main part.

        Names that tell a state count for nothing, and an id of a paragraph or heading is the anchor of its text.
        """
        if not attrs:
            return 0.0, False, False, False
        noise, content = 0.0, False
        for kind, value in _NAMES.findall(attrs):
            if kind.lower() == "id" and (tag in PARAGRAPHS or tag in HEADINGS):
                continue
            for name in [value] if kind.lower() == "aria-label" else value.strip("\"'").split():
                words = [w.lower() for w in _WORDS.findall(name)]
                if words and words[0] not in STATE_FIRST and (len(words) == 1 or words[-1] not in STATE_LAST):
                    noise = max(noise, sum(w in _NOISE for w in words) / len(words))
                    content = content or not _CONTENT.isdisjoint(words)
        hide = main = False
        if _MAY_HIDE.search(attrs):
            own = {k.lower(): v.strip("\"'") for k, v in reversed(_ATTRIBUTE.findall(attrs))}  # the first of a name counts
            hide = "hidden" in own or own.get("aria-hidden", "").lower() == "true" or bool(_NO_DISPLAY.search(own.get("style", "")))
            main = own.get("role", "").lower() == "main"
        return noise, content, hide, main

    def _text(self, text: str, node: int, run, linked: bool):
        if run is None:
            if text.isspace():
                return None
            run = (node, [])
            self.runs.append(run)
        run[1].append(text)
        n = len(text)
        self.chars[node] += n
        if linked:
            self.links[node] += n
        self.stops[node] += text.count(".") + text.count(",")
        return run

    def features(self, marks: list | None = None) -> list:
        """Features of every node; ``marks`` may replace what is known of the page's own marks."""
        n = len(self.tag)
        marks = self.marks if marks is None else marks
        chars, links, tags, stops, inputs = list(self.chars), list(self.links), list(self.tags), list(self.stops), list(self.inputs)
        kids: list = [[] for _ in range(n)]
        for k in range(n - 1, 0, -1):
            p = self.parent[k]
            kids[p].append(k)
            chars[p] += chars[k]
            links[p] += links[k]
            tags[p] += tags[k]
            stops[p] += stops[k]
            inputs[p] += inputs[k]
        below, within, out = [0.0] * n, [False] * n, []
        noise = self._noise(chars, marks)
        rank, like = [0.0] * n, [1.0] * n
        for k in range(n):
            own = kids[k]
            if own:
                own.reverse()
                of: dict = {}
                for c in own:
                    of[self.tag[c]] = of.get(self.tag[c], 0) + 1
                for i, c in enumerate(own):
                    rank[c] = i / len(own)
                    like[c] = of[self.tag[c]] / len(own)
        for k in range(n):
            p, tag, (_, content, hide) = self.parent[k], self.tag[k], self.attr[k]
            below[k] = 1.0 if hide or tag in APART else noise[k]
            if p >= 0:
                below[k] = max(below[k], below[p])
                within[k] = within[p] or marks[p]
            c, sibs = chars[k], len(kids[p]) if p >= 0 else 1
            out.append(
                (
                    self.depth[k],
                    math.log1p(c),
                    math.log1p(self.chars[k]),
                    links[k] / c if c else 0.0,
                    tags[k] / (c + 1),
                    stops[k] / (c + 1),
                    k / n,
                    sibs,
                    like[k],
                    rank[k],
                    c / (chars[p] + 1) if p >= 0 else 1.0,
                    math.log1p(chars[p] / sibs) if p >= 0 else 0.0,
                    tag in PARAGRAPHS,
                    tag in HEADINGS,
                    tag in LISTS or tag in TABLES,
                    tag in APART,
                    marks[k],
                    noise[k],
                    content,
                    hide,
                    below[k],
                    within[k] or marks[k],
                    inputs[k],
                    len(kids[k]),
                )
            )
        return out

    def _noise(self, chars: list, marks: list) -> list:
        """What names say of each node, not held against the page itself: html, body, a part that the page marks, or one with most of the text and its title or such a part."""
        n = len(self.tag)
        holds = [m or t == "h1" for m, t in zip(marks, self.tag, strict=True)]
        for k in range(n - 1, 0, -1):
            holds[self.parent[k]] = holds[self.parent[k]] or holds[k]
        spared = lambda k: self.tag[k] in ("html", "body") or marks[k] or holds[k] and chars[k] >= MOST * chars[0]
        # half of a name's words are nearer to all than to none: share-buttons, but not search-for-peace
        return [0.0 if x[0] and spared(k) else min(1.0, 1.5 * x[0]) for k, x in enumerate(self.attr)]

    def marked(self) -> list | None:
        """1 for nodes in or above the page's own article, 0 for others; None without an article.

        Labels come from marks, tags and what is hidden. Of a node inside the article that its name
        calls noise they say nothing (-1), so what such a name weighs is learned outside of it.
        """
        n = len(self.tag)
        inside, above, apart, said = [False] * n, [False] * n, [False] * n, [False] * n
        for k in range(n):
            p, (noise, _, hide) = self.parent[k], self.attr[k]
            apart[k] = hide or self.tag[k] in APART or p >= 0 and apart[p]
            said[k] = noise >= NOISY and not self.marks[k] and self.tag[k] not in ("html", "body") or p >= 0 and said[p]
            inside[k] = (self.marks[k] or p >= 0 and inside[p]) and not apart[k]
        if not any(inside):
            return None
        for k in range(n - 1, -1, -1):
            if (inside[k] or above[k]) and self.parent[k] >= 0:
                above[self.parent[k]] = True
        return [-1 if i and s and not a else int(i or a) for i, a, s in zip(inside, above, said, strict=True)]

    def decoded(self, p: list) -> list:
        """Kept nodes: the most likely set in which every kept node has a kept parent and none is hidden."""
        n = len(self.tag)
        keep, drop = [0.0] * n, [0.0] * n
        for k in range(n - 1, -1, -1):
            q = min(max(p[k], 1e-6), 1 - 1e-6)
            keep[k] = -math.inf if self.attr[k][2] else keep[k] + math.log(q)
            drop[k] += math.log(1 - q)
            if k:
                keep[self.parent[k]] += max(keep[k], drop[k])
                drop[self.parent[k]] += drop[k]
        out = [True] * n  # the root stands for the page
        for k in range(1, n):
            out[k] = out[self.parent[k]] and keep[k] > drop[k]
        return out

    def text(self, kept: list) -> str:
        blocks = (" ".join(_html.unescape("".join(parts)).split()) for node, parts in self.runs if kept[node])
        return "\n".join(b for b in blocks if b)


def _plain_odds(x) -> float:
    """Probability of a node where no page could be learned from."""
    return 0.02 if x[20] >= NOISY else 0.2 if x[3] > 0.5 else 0.9


def fit_on(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", fit_pages: int = FIT_PAGES) -> list | None:
    """Trees from at most ``fit_pages`` pages that mark their article; None if there are none."""
    marked = F.col(html_col).rlike(r"(?i)<(?:article|main)[\s/>]|\brole\s*=\s*[\"']?main\b")
    ids = pages.where(marked).select(F.col(id_col).alias("id")).where("id is not null").distinct().orderBy(F.xxhash64("id"), "id").limit(fit_pages)
    sample = pages.select(F.col(id_col).alias("id"), F.col(html_col).alias("html")).join(F.broadcast(ids), "id").select("html")

    def nodes(batches):
        import pyarrow as pa

        for batch in batches:
            xs, ys = [], []
            for html in batch.column(0).to_pylist():
                page = Page(html or "")
                y = page.marked()
                if y:
                    seen, hidden = page.features(), page.features([False] * len(y))
                    moved = [x if known else (*x[:WITHIN], True, *x[WITHIN + 1 :]) for x, known in zip(seen, y, strict=True)]
                    for copy in (seen, hidden, moved):
                        xs += [[float(v) for v in x] for x, known in zip(copy, y, strict=True) if known >= 0]
                        ys += [known for known in y if known >= 0]
            if ys:
                yield pa.RecordBatch.from_arrays([pa.array(xs, pa.list_(pa.float64())), pa.array(ys, pa.int32())], names=["x", "y"])

    rows = sample.mapInArrow(tidy(nodes), "x array<double>, y int").cache()
    try:
        return boost.fit(rows)
    finally:
        rows.unpersist()


def main_text(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", keep: tuple = ("url",), trees: list | None = None) -> DataFrame:
    """Columns id, ``keep``, text and n_chars (code points of text), one row per input row.

    Null, empty and broken pages are read as far as they go; a page without main text has an empty
    text. Character references are decoded, white space inside a block is one space, and blocks
    are joined by a line feed in page order. Ids may be null or repeat; an empty table gives an
    empty result. ``trees`` may be passed; by default they are fitted on ``pages``.
    """
    spark = pages.sparkSession
    bounded_batches(spark)
    if trees is None:
        trees = fit_on(pages, id_col, html_col)
    shared = spark.sparkContext.broadcast(trees)
    own = pages.select(F.col(html_col).alias("_html"), id_col, *keep)
    names = own.columns[1:]

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            read = [Page(h or "") for h in batch.column(0).to_pylist()]
            xs = [p.features() for p in read]
            if shared.value:
                flat = np.array([x for page in xs for x in page], float)
                odds = boost.as_numpy(shared.value, flat).tolist() if len(flat) else []
            else:
                odds = [_plain_odds(x) for page in xs for x in page]
            out, at = [], 0
            for page, x in zip(read, xs, strict=True):
                out.append(page.text(page.decoded(odds[at : at + len(x)])))
                at += len(x)
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(out, pa.string()), pa.array([len(t) for t in out], pa.int64())], names=[*names, "text", "n_chars"])

    schema = own.drop("_html").withColumns({"text": F.lit(""), "n_chars": F.lit(0).cast("long")}).schema
    return own.mapInArrow(tidy(run), schema)
