"""Main text of web pages by a tree-structured graphical model over the page's elements.

Elements and text blocks are nodes of a tree. Each has a hidden state: boilerplate, content,
or mixed (a container of both). A node's features (tag, words of class and id, length, links,
sentence marks) depend on its state, and its state on its parent's. Both tables are counted
from labelled pages. Sum-product messages pass from the leaves to the root and back, which
gives every block its exact marginal; blocks that are content with at least one half are the
text. Because a parent's state reaches its whole subtree, a reader's comment in fluent prose
is rejected with its container, and a short line of an article is kept with its article.

The labelled pages are drawn here from page grammars: a bounded number, ``TRAINING_PAGES``.

Defined results: a NULL, empty or tag-less page is parsed like any other (bare text is one
block of the body), pages without content give the empty text, repeated rows are extracted
alike, unclosed elements end with their parents. Whole pages are read. Other columns pass
through; columns named ``text`` or ``n_chars`` are replaced.
"""

from __future__ import annotations

import math
import random
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from contrastry.llm.batches import slices
from contrastry.llm.inputs import table

TRAINING_PAGES = 1000
BOILERPLATE, CONTENT, MIXED = 0, 1, 2
STATES = (BOILERPLATE, CONTENT, MIXED)
#: Kinds of edges with tables of their own: to a text block, to a part of a list or table, to another element.
EDGES = ("block", "part", "edge")
#: The features of a block depend on one another; this exponent keeps them from counting twice.
BLOCK_WEIGHT = 0.4

#: Fixed values of HTML: elements without an end tag, elements inside a line, elements that are no text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split()) | frozenset(
    "math mi mn mo ms mtext mspace mrow mfrac msqrt mroot mstyle merror mpadded mphantom mfenced menclose msub msup msubsup munder mover munderover mmultiscripts mtable mtr mtd semantics annotation".split())
SILENT = frozenset("head script style noscript template svg annotation iframe object canvas audio video select option textarea button title".split())
#: Silent elements that take no place in a line, and elements that no button holds: an open button ends before them.
UNSEEN = frozenset("script style noscript template svg".split())
NOT_IN_BUTTON = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl table blockquote pre article section main aside header footer nav form figure".split())
NOT_IN_DRAWING = NOT_IN_BUTTON | frozenset("body center dd div dt hr li menu ruby".split())
#: Elements of one kind end an open one of the same kind, up to the container that may nest them.
SIBLINGS = {
    "li": (("li",), ("ul", "ol", "menu")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)),
    "tr": (("tr", "td", "th"), ("table",)), "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")),
}
#: Parts of lists and tables say nothing beyond their container; regions mean different things inside an article.
PLAIN = frozenset("li tr td th dt dd tbody thead tfoot colgroup".split())
REGIONS = frozenset("header footer nav aside section form div ul ol h1 h2".split())
SPACE = re.compile(r"\s+")
NAME_PART = re.compile(r"[a-z]+")

HEAD = {"title", "meta", "link", "base", "basefont", "bgsound", "style", "script", "noscript", "noframes", "template", "head", "html"}


class Page(HTMLParser):
    """Nodes of a page in page order: parent, features, label mark, and the text of blocks."""

    def __init__(self, html: str):
        super().__init__(convert_charrefs=True)
        self.parents: list[int] = [-1]
        self.features: list[list[str]] = [["tag=#root"]]
        self.marks: list[str | None] = [None]
        self.parts: list[bool] = [False]
        self.texts: dict[int, str] = {}
        self.open: list[tuple[str, int]] = [("#root", 0)]
        #: Depths of the open elements with a node, and of those of each tag: nothing walks through the open elements.
        self.blocks: list[int] = [0]
        self.depths: defaultdict[str, list[int]] = defaultdict(list)
        self.silent = self.hush = 0  # open silent elements, and the depth of the outermost
        self.pieces: list[str] = []
        self.link_depth = 0
        self.linked = 0
        self.feed(html)
        self.close()
        self.end_block()

    def end_block(self) -> None:
        if not self.pieces:
            return
        text = SPACE.sub(" ", "".join(self.pieces)).strip()
        linked, self.pieces, self.linked = self.linked, [], 0
        if not text:
            return
        node = self.node(self.block_parent(), None)
        words = text.count(" ") + 1
        share = min(1.0, linked / len(text))
        low = text.lower()
        tag = self.open[self.blocks[-1]][0]
        self.features[node] += [
            f"in={'plain' if tag in PLAIN else tag}", f"words={min(7, words.bit_length())}", f"link={0 if share < 0.2 else 1 if share < 0.7 else 2}",
            f"end={text[-1] if text[-1] in '.!?:;' else 'x'}", f"stops={min(3, sum(text.count(m) for m in ('. ', ', ')))}",
        ]
        if "©" in text or "copyright" in low or "rights reserved" in low:
            self.features[node].append("legal")
        if "cookie" in low or "subscribe" in low or "newsletter" in low or "sponsored" in low:
            self.features[node].append("prompt")
        self.texts[node] = text

    def block_parent(self) -> int:
        return self.open[self.blocks[-1]][1]

    def last(self, *tags: str) -> int:
        """Depth of the innermost open element with one of the tags, 0 without one."""
        return max((self.depths[tag][-1] for tag in tags if self.depths[tag]), default=0)

    def push(self, tag: str, node: int) -> None:
        if node >= 0:
            self.blocks.append(len(self.open))
        self.depths[tag].append(len(self.open))
        if tag in SILENT and not self.silent:
            self.hush = len(self.open)
        self.open.append((tag, node))
        self.silent += tag in SILENT

    def node(self, parent: int, mark: str | None) -> int:
        self.parents.append(parent)
        self.features.append([])
        self.marks.append(mark)
        self.parts.append(False)
        return len(self.parents) - 1

    def edge_kind(self, node: int) -> str:
        return "block" if node in self.texts else "part" if self.parts[node] else "edge"

    def pop_to(self, depth: int) -> None:
        while len(self.open) > depth:
            tag, node = self.open.pop()
            self.depths[tag].pop()
            if node >= 0:
                self.blocks.pop()
            self.silent -= tag in SILENT
            self.link_depth -= tag == "a"

    def close_sibling(self, closing: tuple[str, ...], until: tuple[str, ...]) -> None:
        while (depth := self.last(*closing)) > self.last(*until):
            tag = self.open[depth][0]
            self.pop_to(depth)
            if tag not in ("td", "th") or "tr" not in closing:
                return

    def close_head(self) -> None:
        """Both </head> and <body> may be left out: what cannot stand in a head ends it."""
        if self.open[-1][0] == "head":
            self.pop_to(len(self.open) - 1)

    def handle_starttag(self, tag, attrs):
        if tag not in HEAD:
            self.close_head()
        if tag in INLINE:
            if tag == "br":
                self.pieces.append(" ")
            elif tag not in VOID:
                self.push(tag, -1)
                self.link_depth += tag == "a"
            return
        if tag in NOT_IN_BUTTON and self.depths["button"]:
            self.pop_to(self.depths["button"][-1])
        if tag in NOT_IN_DRAWING and self.depths["svg"] and not self.depths["foreignobject"]:
            self.pop_to(self.depths["svg"][0])
        if tag not in UNSEEN and not self.silent:
            self.end_block()
        if tag in SIBLINGS:
            self.close_sibling(*SIBLINGS[tag])
        if (tag not in SILENT or tag in ("button", "select", "textarea")) and self.open[self.blocks[-1]][0] == "p":
            self.pop_to(self.blocks[-1])
        if tag in VOID:
            return
        if tag == "body" and self.depths["head"]:
            self.pop_to(self.depths["head"][0])
        fields = dict(attrs)
        node = self.node(self.block_parent(), fields.get("data-y"))
        names = {p.rstrip("s") or p for key in ("class", "id", "role") for p in NAME_PART.findall((fields.get(key) or "").lower())}
        inside = self.last("article", "main") > 0
        self.parts[node] = tag in PLAIN
        if tag not in PLAIN:
            self.features[node].append(f"tag={tag}{'@article' if inside and tag in REGIONS else ''}")
        self.features[node] += sorted(f"name={n}" for n in names)
        self.push(tag, node)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        depth = self.last(tag)
        if tag in VOID or not depth:
            return
        if tag not in INLINE and tag not in UNSEEN and (not self.silent or depth <= self.hush):
            self.end_block()
        if tag in INLINE and self.blocks[-1] > depth:
            return  # a block is open inside: the line element goes with it
        self.pop_to(depth)

    def handle_data(self, data):
        if data.strip():
            self.close_head()
        if not self.silent:
            self.pieces.append(data)
            if self.link_depth:
                self.linked += len(data)

    def labels(self) -> list[int]:
        """States of a labelled page: a mark holds for its subtree; unmarked ancestors are mixed."""
        states: list[int] = []
        for parent, mark in zip(self.parents, self.marks):
            inherited = states[parent] if parent >= 0 else MIXED
            states.append(int(mark) if mark is not None else inherited)
        return states


class Model:
    """Counted potentials, as logarithms."""

    def __init__(self, counts: dict[tuple[str, int, int], int]):
        """counts: (feature, state, 0) for features, (kind of edge, parent state, state) and ("state", 0, state)."""
        self.edges = {
            kind: [[v / sum(row) for v in row] for row in ([counts.get((kind, p, s), 0) + 0.05 for s in STATES] for p in STATES)] for kind in EDGES
        }
        self.root = [0.01, 0.01, 0.98]
        totals = [counts.get(("state", 0, s), 0) + 1.0 for s in STATES]
        names = {f for f, _, _ in counts if f not in (*EDGES, "state")}
        self.emit = {f: [math.log((counts.get((f, s, 0), 0) + 0.1) / (totals[s] + 1.0)) for s in STATES] for f in names}

    def marginals(self, page: Page) -> list[float]:
        """Probability of content for every node, by messages up and down the tree."""
        size, parents = len(page.parents), page.parents
        edges = [self.edges[page.edge_kind(i)] for i in range(size)]
        own = []
        for i, features in enumerate(page.features):
            logs = [0.0, 0.0, 0.0]
            weight = BLOCK_WEIGHT if i in page.texts else 1.0
            for f in features:
                if e := self.emit.get(f):
                    logs = [a + b * weight for a, b in zip(logs, e)]
            top = max(logs)
            own.append([math.exp(v - top) for v in logs])
        below = [list(x) for x in own]  # evidence of the subtree
        up: list[list[float]] = [[]] * size  # message to the parent
        for i in range(size - 1, 0, -1):
            b = below[i]
            total = sum(b)
            b[0], b[1], b[2] = b[0] / total, b[1] / total, b[2] / total
            message = [row[0] * b[0] + row[1] * b[1] + row[2] * b[2] for row in edges[i]]
            up[i] = message
            target = below[parents[i]]
            for s in STATES:
                target[s] *= message[s]
            if (scale := max(target)) < 1e-100:
                for s in STATES:
                    target[s] /= scale
        belief: list[list[float]] = [[]] * size
        belief[0] = [a * b for a, b in zip(self.root, below[0])]
        out = [0.0] * size
        for i in range(size):
            if i:
                above, message = belief[parents[i]], up[i]
                free = [a / m for a, m in zip(above, message)]  # all evidence but that of this subtree
                belief[i] = [below[i][s] * sum(free[p] * edges[i][p][s] for p in STATES) for s in STATES]
            total = sum(belief[i])
            belief[i] = [v / total for v in belief[i]]
            out[i] = belief[i][CONTENT]
        return out

    def extract(self, html: str) -> str:
        page = Page(html)
        chances = self.marginals(page)
        return "\n\n".join(text for node, text in page.texts.items() if chances[node] >= 0.5)


class Grammar:
    """Draws labelled pages: ``data-y`` marks content (1) and boilerplate (0)."""

    #: Usual names of page parts.
    PARTS = {
        "nav": "nav menu navbar navigation topnav breadcrumb breadcrumbs main-menu site-nav links pagination toc tags",
        "header": "header masthead site-header top-bar page-header logo branding banner-top",
        "footer": "footer site-footer bottom page-footer legal copyright colophon",
        "aside": "sidebar aside widget related rail recommended side-column more-stories popular trending teaser",
        "notice": "notice cookie cookie-notice consent banner alert popup gdpr newsletter-box overlay modal disclaimer paywall",
        "ad": "ad ads advert advertisement sponsored sponsor promo ad-slot ad-container adbox banner-ad",
        "form": "form login signup search subscribe newsletter contact-form search-box",
        "comments": "comments comment-list discussion reader-comments responses replies disqus comment-section user-comments",
        "share": "share social share-bar social-links buttons byline meta author-box post-meta",
    }
    CONTENT_NAMES = "content article main post entry story article-body post-content entry-content story-text body-text text main-content page-content".split()
    WRAPPERS = "wrapper page container site row layout col inner outer wrap column".split()
    SYLLABLES = "an ber con dal er fin gor hal in jor kel lum mor nes or pal qui ren sol tor un ver wal xen yor zin ment tion ly ing ed".split()

    def __init__(self, seed: int):
        self.r = random.Random(seed)

    def word(self) -> str:
        return "".join(self.r.choice(self.SYLLABLES) for _ in range(self.r.randint(1, 4)))

    def sentence(self) -> str:
        words = [self.word() + ("," if self.r.random() < 0.1 else "") for _ in range(self.r.randint(1, 18))]
        return " ".join(words).rstrip(",").capitalize() + self.r.choice("....!?")

    def prose(self, most: int = 7) -> str:
        parts = [self.sentence() for _ in range(self.r.randint(1, most))]
        if self.r.random() < 0.2:
            style = self.r.choice(("b", "i", "em", "strong", "span"))
            parts[0] = f"<{style}>{parts[0]}" + ("" if self.r.random() < 0.3 else f"</{style}>")
        if self.r.random() < 0.2:
            parts.append(f'<a href="/{self.word()}">{self.word()}</a> {self.sentence()}')
        return " ".join(parts)

    def short(self) -> str:
        return " ".join(self.word() for _ in range(self.r.randint(1, 5))).capitalize()

    def heading(self) -> str:
        level = self.r.randint(2, 4)
        return f"<h{level}>{self.short()}</h{level}>"

    def links(self) -> str:
        items = [f'<a href="/{self.word()}">{self.short()}</a>' for _ in range(self.r.randint(2, 9))]
        return self.r.choice((lambda: "<ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul>", lambda: " | ".join(items), lambda: "".join(f"<div>{x}</div>" for x in items)))()

    def box(self, kind: str) -> str:
        r, name = self.r, self.r.choice(self.PARTS[kind].split())
        tag = r.choice({"nav": ("nav", "nav", "div", "ul"), "header": ("header", "header", "div"), "footer": ("footer", "footer", "div"), "aside": ("aside", "aside", "div", "section"),
                        "form": ("form", "form", "div")}.get(kind, ("div", "div", "section", "p", "span") if kind in ("ad", "notice", "share") else ("div", "section", "ul", "ol")))
        tag = "div" if tag == "span" else tag
        inner = {
            "nav": self.links, "header": lambda: r.choice((f"<h1>{self.short()}</h1>", f"<p>{self.sentence()}</p>", f'<a href="/">{self.short()}</a>', self.links())),
            "footer": lambda: r.choice((f"<p>&copy; {self.short()} {self.sentence()}</p>", f"&copy; {self.word()}.com &middot; {self.sentence()}", self.links(), f"<p>{self.prose(2)}</p>" + self.links())),
            "aside": lambda: self.heading() + r.choice((self.links(), f"<p>{self.prose(3)}</p>", f"<p>{self.sentence()}</p>" + self.links())),
            "notice": lambda: r.choice((f"<p>{self.prose(2)}</p>", self.prose(2), f"We use cookies. {self.sentence()} <button>OK</button>")),
            "ad": lambda: r.choice((self.sentence(), f"<p>{self.prose(2)}</p>", f'<a href="/ad">{self.sentence()}</a>', f"Sponsored {self.sentence()}")),
            "form": lambda: f"<label>{self.short()}</label><input name=q><p>{self.sentence()}</p><button>{self.short()}</button>",
            "comments": lambda: self.heading() + "".join(
                r.choice((f'<div class="comment"><p>{self.prose(4)}</p></div>', f'<div class="comment-body"><b>{self.short()}</b><p>{self.prose(4)}</p></div>', f"<p>{self.prose(4)}</p>", f"<li>{self.prose(3)}</li>"))
                for _ in range(r.randint(1, 6))),
            "share": lambda: r.choice((self.short(), f"By {self.short()}", self.links())),
        }[kind]()
        if tag in ("ul", "ol"):
            inner = "".join(f"<li>{inner}</li>")
        if tag == "p":
            inner = self.prose(2)
        named = r.random() < (0.5 if tag not in ("div", "section", "p", "ul", "ol") else 0.97)
        return f'<{tag}{f" {r.choice(("class", "class", "id"))}={chr(34)}{name}{chr(34)}" if named else ""} data-y="0">{inner}</{tag}>'

    def article(self) -> str:
        r, parts = self.r, []
        if r.random() < 0.8:
            heading = f"<h1>{self.short()}</h1>" if r.random() < 0.7 else f"<h1>{self.sentence()}</h1>"
            parts.append(heading if r.random() < 0.85 else f"<header>{heading}</header>")
        for _ in range(r.randint(1, 12)):
            kind = r.random()
            if kind < 0.78:
                parts.append(f"<p>{self.prose()}" + ("<br>" if r.random() < 0.1 else "") + ("</p>" if r.random() < 0.9 else ""))
            elif kind < 0.81:
                parts.append(f"<p>{self.short()}</p>")
            elif kind < 0.83:
                parts.append(f"<p>{r.choice(('All rights reserved.', 'Licensed under the terms of use.', f'&copy; {self.short()}', f'Subscribe to {self.sentence()}', f'Cookies {self.sentence()}'))}</p>")
            elif kind < 0.86:
                parts.append(self.heading())
            elif kind < 0.91:
                parts.append("<ul>" + "".join(f"<li>{self.sentence()}</li>" for _ in range(r.randint(2, 5))) + "</ul>")
            elif kind < 0.94:
                parts.append(f"<blockquote><p>{self.prose(3)}</p></blockquote>")
            elif kind < 0.96:
                parts.append("<table>" + "".join(f"<tr><td>{self.word()}</td><td>{self.short()}</td></tr>" for _ in range(r.randint(1, 4))) + "</table>")
            elif kind < 0.98:
                parts.append(f"<figure><img src=x><figcaption>{self.sentence()}</figcaption></figure>")
            else:
                parts.append(f"<pre>{self.prose(2)}</pre>")
            if r.random() < 0.04:
                parts.append(self.box(r.choice(("ad", "ad", "share", "aside", "form", "notice"))))
        body = "".join(parts)
        tag = r.choice(("article", "article", "article", "main", "div", "div", "section"))
        name = f' {r.choice(("class", "id"))}="{r.choice(self.CONTENT_NAMES)}"' if tag in ("div", "section") or r.random() < 0.3 else ""
        body = f'<{tag}{name} data-y="1">{body}</{tag}>'
        if r.random() < 0.3:  # comments may stand inside an outer container
            outer = r.choice(("main", "div", "section"))
            body = f'<{outer} class="{r.choice(self.CONTENT_NAMES + self.WRAPPERS)}">{body}{self.box("comments") if r.random() < 0.5 else ""}</{outer}>'
        return body

    def page(self) -> str:
        r = self.r
        before = [self.box(k) for k in ("header", "nav", "notice", "ad", "form", "aside") if r.random() < 0.45]
        after = [self.box(k) for k in ("share", "comments", "aside", "ad", "form", "nav", "notice") if r.random() < 0.35] + ([self.box("footer")] if r.random() < 0.8 else [])
        r.shuffle(before)
        body = "".join(before) + self.article() + "".join(after)
        for _ in range(r.randint(0, 2)):
            body = f'<div class="{r.choice(self.WRAPPERS)}">{body}</div>'
        return f"<!DOCTYPE html><html><head><title>{self.short()}</title></head><body><!-- {self.word()} -->{body}</body></html>"


def labelled_pages(spark: SparkSession, pages: int = TRAINING_PAGES) -> DataFrame:
    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([Grammar(seed).page() for seed in batch.column("id").to_pylist()], pa.string())], ["html"])

    return spark.range(0, pages, 1, 4).mapInArrow(draw, "html string")


def train(labelled: DataFrame) -> dict[tuple[str, int, int], int]:
    """Counts behind the potentials. Their number is bounded by the names in the labelled pages."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter = Counter()
        for batch in batches:
            for html in batch.column("html").to_pylist():
                page = Page(html)
                states = page.labels()
                for node, state in enumerate(states):
                    found["state", 0, state] += 1
                    found.update((f, state, 0) for f in page.features[node])
                    if node:
                        found[page.edge_kind(node), states[page.parents[node]], state] += 1
        rows = [(*k, n) for k, n in found.items()]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], ["name", "first", "second", "n"])

    rows = labelled.mapInArrow(count, "name string, first long, second long, n long").groupBy("name", "first", "second").agg(F.sum("n").alias("n")).collect()
    return {(r["name"], r["first"], r["second"]): r["n"] for r in rows}


def main_text(pages: DataFrame, counts: dict[tuple[str, int, int], int], html: str = "html") -> DataFrame:
    """``pages`` with ``text`` and ``n_chars``, without the column of the page."""
    others = [c for c in pages.columns if c.lower() not in {"text", "n_chars", html}]
    schema = T.StructType([*[pages.schema[c] for c in others], T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(counts)
        for batch in slices(batches, html):
            texts = [model.extract(page or "") for page in batch.column(html).to_pylist()]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in others], pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], [*others, "text", "n_chars"])

    return pages.select(*[f"`{c}`" for c in others], html).mapInArrow(run, schema)


def op10_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = train(labelled_pages(spark))
    return main_text(table(spark, sf_dir, "pages").select("page_id", "url", "html"), counts)


QUERIES = {"op10_main_text": op10_main_text}
SQL: dict[str, str] = {}
