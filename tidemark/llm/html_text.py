"""Main text of web pages: boosted trees judge DOM nodes, and decoding keeps their verdicts consistent."""

from __future__ import annotations

import random
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from html import escape
from html.parser import HTMLParser
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.boosting import BoostedTrees, fit_boosted
from tidemark.llm.common import text_sample

# Element names of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
NEVER_SHOWN = frozenset(
    "head title script style noscript template svg annotation annotation-xml iframe object canvas audio video map "
    "select option textarea button datalist".split()
)
BLOCKS = frozenset(
    "html body address article aside blockquote center dd details dialog div dl dt fieldset figcaption figure footer "
    "form h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol p pre search section summary table tbody td tfoot "
    "th thead tr ul".split()
)
#: What an opening tag closes: elements of these names, up to the nearest of the others.
CLOSES = {
    "li": (frozenset(["li"]), frozenset(["ul", "ol", "menu"])),
    "dt": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "dd": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "tr": (frozenset(["tr", "td", "th"]), frozenset(["table", "tbody", "thead", "tfoot"])),
    "td": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "th": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
}
#: Words of class, id and role attributes that tell of main text, and of what surrounds it.
GOOD_TOKENS = frozenset("article content main body entry post story text prose page".split())
BAD_TOKENS = frozenset(
    "ad ads advert advertisement advertising adv banner sponsor sponsored promo promoted promotion comment comments "
    "reply replies disqus nav navigation navbar menu menus breadcrumb breadcrumbs sidebar aside widget footer foot "
    "header masthead cookie cookies consent gdpr notice alert popup modal overlay newsletter subscribe signup login "
    "share sharing social related recommended teaser tags pager pagination toolbar legal copyright disclaimer form "
    "search outbrain taboola".split()
)
GOOD_TAGS = frozenset(["article", "main"])
BAD_TAGS = frozenset(["nav", "header", "footer", "aside", "form", "menu", "dialog", "search", "fieldset"])
TAG_FEATURES = ("p", "div", "li", "ul", "a", "td", "section", "article", "main", "nav", "aside", "footer", "header", "form", "h1", "h2", "h3", "body", "blockquote", "pre")
TOKEN = re.compile(r"[a-z]+")

#: Training reads at most this many pages of at most so many characters each.
SAMPLE_PAGES = 800
SAMPLE_CHARS = 100_000
#: The depth that is learnt from goes no further than this; deeper elements are nodes like others.
DEEPEST = 200


@dataclass
class Node:
    tag: str
    parent: int
    depth: int
    tokens: frozenset[str]
    position: int = 0
    children: list[int] = field(default_factory=list)
    #: Own characters of text, own words, own sentence ends.
    chars: int = 0
    marks: int = 0
    #: Of the whole subtree: characters, characters in links, elements, links, paragraphs, sentence marks.
    all_chars: int = 0
    link_chars: int = 0
    elements: int = 1
    links: int = 0
    paragraphs: int = 0
    all_marks: int = 0


class Tree(HTMLParser):
    """The block elements of a page, inline elements folded into them, and its texts in order.

    Markup may be broken: end tags that are missing are put in, those without a start tag are left
    out, and an end of the page ends all that is open. Character references are decoded. Each tag takes
    constant time besides the elements that it closes, however many are open.
    """

    def __init__(self, html: str):
        super().__init__(convert_charrefs=True)
        self.nodes = [Node("html", -1, 0, frozenset())]
        #: Runs of text: the node they stand in, and whether a block begins before them.
        self.texts: list[tuple[int, str, bool]] = []
        self._open = [("html", 0)]
        # Where in that list the elements of a name are, and the blocks.
        self._places: dict[str, list[int]] = {}
        self._blocks = [0]
        # The element that hides what is in it, once for each time that it is nested in itself.
        self._hidden: list[str] = []
        self._links = 0
        self._fresh = True
        self.feed(html)
        self.close()
        for at in range(len(self.nodes) - 1, -1, -1):
            node = self.nodes[at]
            node.all_chars += node.chars
            node.all_marks += node.marks
            node.paragraphs += node.tag == "p"
            if node.parent >= 0:
                above = self.nodes[node.parent]
                for name in ("all_chars", "link_chars", "elements", "links", "paragraphs", "all_marks"):
                    setattr(above, name, getattr(above, name) + getattr(node, name))

    def handle_starttag(self, tag, attrs):
        if self._hidden:
            if tag == self._hidden[-1] and tag not in VOID:
                self._hidden.append(tag)
            elif tag in ("body", "article", "main") and self._hidden[-1] == "head":
                self._hidden.clear()
            else:
                return
        if tag in NEVER_SHOWN:
            self._hidden.append(tag)
            return
        if tag in BLOCKS:
            self._close_paragraph()
            closing = CLOSES.get(tag)
            if closing:
                self._close_until(*closing)
        if tag == "hr":
            self._fresh = True
        if tag in VOID:
            if tag == "br" and self.texts:
                self.texts.append((self._open[-1][1], " ", False))
            return
        if tag == "html" or tag == "body" and self._places.get("body"):
            return
        if tag in BLOCKS:
            above = self._open[-1][1]
            values = [v for k, v in attrs if k in ("class", "id", "role", "itemprop") and v]
            tokens = frozenset(t for v in values for t in TOKEN.findall(v.lower()))
            node = len(self.nodes)
            self.nodes.append(Node(tag, above, self.nodes[above].depth + 1, tokens, len(self.nodes[above].children)))
            self.nodes[above].children.append(node)
            self._push(tag, node)
            self._fresh = True
        else:
            self._push(tag, self._open[-1][1])
            if tag == "a":
                self._links += 1
                self.nodes[self._open[-1][1]].links += 1

    def handle_startendtag(self, tag, attrs):
        # A slash closes void elements only; HTML reads any other as an opening tag.
        if tag in VOID or tag not in NEVER_SHOWN:
            self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        if self._hidden:
            if tag == self._hidden[-1]:
                self._hidden.pop()
            return
        at = self._nearest((tag,))
        if tag == "p" and not at:
            self._fresh = True
            return
        # The end of an inline element does not close a block.
        if at and tag not in ("html", "body") and (tag in BLOCKS or self._blocks[-1] < at):
            self._pop_to(at)

    def handle_data(self, data):
        if self._hidden or not data:
            return
        node = self._open[-1][1]
        self.texts.append((node, data, self._fresh))
        if not data.isspace():
            self._fresh = False
            n = len(data.strip())
            self.nodes[node].chars += n
            self.nodes[node].marks += sum(map(data.count, ".,;:!?"))
            if self._links:
                self.nodes[node].link_chars += n

    def _push(self, tag: str, node: int) -> None:
        self._places.setdefault(tag, []).append(len(self._open))
        if tag in BLOCKS:
            self._blocks.append(len(self._open))
        self._open.append((tag, node))

    def _pop_to(self, at: int) -> None:
        while len(self._open) > at:
            tag, _ = self._open.pop()
            self._places[tag].pop()
            if tag in BLOCKS:
                self._blocks.pop()
                self._fresh = True
            self._links -= tag == "a"

    def _nearest(self, names) -> int:
        """Where the innermost open element of one of the names is; 0 if there is none."""
        return max((self._places[n][-1] for n in names if self._places.get(n)), default=0)

    def _close_paragraph(self) -> None:
        innermost = self._blocks[-1]
        if innermost and self._open[innermost][0] == "p":
            self._pop_to(innermost)

    def _close_until(self, names: frozenset, stop: frozenset) -> None:
        at = self._nearest(names)
        if at > self._nearest(stop):
            self._pop_to(at)

    def features(self) -> np.ndarray:
        """A row for every node: its tag, attribute words, depth, density, siblings, and its ancestors' words."""
        rows = []
        page = max(1, self.nodes[0].all_chars)
        above_good = [0] * len(self.nodes)
        above_bad = [0] * len(self.nodes)
        for at, node in enumerate(self.nodes):
            up = self.nodes[node.parent] if node.parent >= 0 else node
            good = len(node.tokens & GOOD_TOKENS) + (node.tag in GOOD_TAGS)
            bad = len(node.tokens & BAD_TOKENS) + (node.tag in BAD_TAGS)
            if node.parent >= 0:
                above_good[at] = above_good[node.parent] + (len(up.tokens & GOOD_TOKENS) + (up.tag in GOOD_TAGS))
                above_bad[at] = above_bad[node.parent] + (len(up.tokens & BAD_TOKENS) + (up.tag in BAD_TAGS))
            chars = max(1, node.all_chars)
            n = max(1, len(up.children))
            same = up.all_chars / n
            rows.append(
                [
                    *[float(node.tag == t) for t in TAG_FEATURES],
                    float(good),
                    float(bad),
                    float(above_good[at]),
                    float(above_bad[at]),
                    float(min(node.depth, DEEPEST)),
                    np.log1p(node.all_chars),
                    np.log1p(node.chars),
                    node.all_chars / page,
                    node.all_chars / node.elements,
                    node.link_chars / chars,
                    node.links / node.elements,
                    float(node.paragraphs),
                    node.all_marks / chars,
                    float(n),
                    node.position / n,
                    node.all_chars / max(1.0, same),
                    up.link_chars / max(1, up.all_chars),
                ]
            )
        return np.array(rows)

    def hints(self) -> list[int]:
        """What the markup itself says of every node: 1 main text, 0 not, -1 not known.

        Anything in an element for menus, notices, forms and the like, by its name or its attribute
        words, is not main text; what else lies in an article or main element is.
        """
        out = []
        inside: list[int] = []
        for at, node in enumerate(self.nodes):
            state = inside[node.parent] if node.parent >= 0 else -1
            if state != 0:
                if node.tag in BAD_TAGS or node.tokens & BAD_TOKENS:
                    state = 0
                elif node.tag in GOOD_TAGS or node.tokens & {"articlebody"}:
                    state = 1
            inside.append(state)
            out.append(state)
        return out

    def kept(self, margins: np.ndarray) -> list[bool]:
        """The likeliest consistent choice: a node is kept only if all that it lies in are.

        The gain of keeping a node is its log odds times the text in it; dropping a node drops its
        whole subtree, so from the leaves up a subtree is kept if its gains add up to more than 0.
        A page without any block element is kept as it is.
        """
        if len(self.nodes) == 1:
            return [True]
        gain = [m * (node.chars + 1) for m, node in zip(margins.tolist(), self.nodes)]
        for at in range(len(self.nodes) - 1, 0, -1):
            if gain[at] > 0:
                gain[self.nodes[at].parent] += gain[at]
        out = [gain[0] > 0]
        for at in range(1, len(self.nodes)):
            out.append(gain[at] > 0 and out[self.nodes[at].parent])
        return out

    def text(self, kept: Sequence[bool]) -> str:
        """The texts of kept nodes, white space in a block made one space, blocks on lines of their own."""
        blocks: list[list[str]] = []
        last = -1
        for node, data, fresh in self.texts:
            if not kept[node]:
                last = -1
                continue
            if fresh or node != last or not blocks:
                blocks.append([])
            blocks[-1].append(data)
            last = node
        lines = (" ".join("".join(b).split()) for b in blocks)
        return "\n".join(line for line in lines if line)


@dataclass(frozen=True)
class PageModel:
    """Trees over node features."""

    trees: BoostedTrees

    def extract(self, pages: Sequence[str | None]) -> list[str]:
        """The main text of each whole page; empty where there is none."""
        trees = [Tree(page) if page else None for page in pages]
        x = [t.features() for t in trees if t is not None]
        if not x:
            return [""] * len(pages)
        margins = iter(np.split(self.trees.margin(np.concatenate(x)), np.cumsum([len(f) for f in x])[:-1]))
        return ["" if t is None else t.text(t.kept(next(margins))) for t in trees]


#: Frames that surround main text in rewritten training pages, and things that stand around or in it.
FRAMES = (
    "<article itemprop='articleBody'>{}</article>",
    "<main><div itemprop='articleBody'>{}</div></main>",
    "<div class='content' itemprop='articleBody'>{}</div>",
    "<div id='main'><div class='post-body' itemprop='articleBody'>{}</div></div>",
    "<section class='entry' itemprop='articleBody'>{}</section>",
    "<div class='wrap'><div class='col' itemprop='articleBody'>{}</div></div>",
    "<div class='row' itemprop='articleBody'><div class='text'>{}</div></div>",
    "<div itemprop='articleBody'>{}</div>",
)
CLUTTER = (
    "<nav><ul><li><a href='#'>{0}</a><li><a href='#'>{1}</a></ul></nav>",
    "<div class='menu'><a href='#'>{0}</a> <a href='#'>{1}</a></div>",
    "<header><h1>{0}</h1><p>{1}</p></header>",
    "<div class='site-header'><h2>{0}</h2></div>",
    "<aside><h3>{0}</h3><p>{2}</p></aside>",
    "<div class='sidebar'><h3>{0}</h3><p>{2}</p><ul><li><a href='#'>{1}</a></ul></div>",
    "<div class='cookie-notice'><p>{2}</p></div>",
    "<div class='notice' role='alert'>{2}</div>",
    "<div class='ad'>{2}</div>",
    "<div class='sponsored promo'><p>{2}</p></div>",
    "<form action='#'><p>{2}</p><label>{0}</label></form>",
    "<div class='newsletter signup'><p>{2}</p></div>",
    "<div class='share'><a href='#'>{0}</a></div>",
    "<section id='comments'><div class='comment'><p>{2}</p></div><div class='comment'><p>{3}</p></div></section>",
    "<div class='comments'><h3>{0}</h3><p>{2}</p><p>{3}</p></div>",
    "<ol class='comment-list'><li><p>{2}</p><li><p>{3}</p></ol>",
    "<div class='related'><ul><li><a href='#'>{0}</a><li><a href='#'>{1}</a></ul></div>",
    "<footer><p>{2}</p></footer>",
    "<div id='footer' class='legal'>{2}</div>",
)
PARAGRAPHS = ("<p>{}</p>", "<p>{}", "<p>{}</p>", "<div>{}</div>", "<blockquote><p>{}</p></blockquote>", "<ul><li>{}</ul>")


def rewritten(lines: Sequence[str], rng: random.Random) -> str:
    """A page with `lines` as its main text, in another frame, with clutter made of the same words.

    Real samples know few layouts; words alone must not tell main text from clutter.
    """

    def clutter() -> str:
        line = rng.choice(lines).split()
        few = [" ".join(line[:n]) for n in (1, 2)]
        many = [" ".join(rng.choice(lines).split()[: rng.randint(3, 40)]) for _ in range(2)]
        return rng.choice(CLUTTER).format(*map(escape, [*few, *many]))

    body = []
    if rng.random() < 0.7:
        body.append(rng.choice(("<h1>{}</h1>", "<h2>{}</h2>")).format(escape(" ".join(rng.choice(lines).split()[:8]))))
    for line in lines:
        body.append(rng.choice(PARAGRAPHS).format(escape(line)))
        if rng.random() < 0.1:
            body.append(clutter())
    if rng.random() < 0.3:
        body.append(clutter())
    if rng.random() < 0.1:
        return f"<html><body itemprop='articleBody'>{''.join(body)}</body></html>"
    before = "".join(clutter() for _ in range(rng.randint(0, 3)))
    after = "".join(clutter() for _ in range(rng.randint(0, 3)))
    main = rng.choice(FRAMES).format("".join(body))
    return f"<html><body>{before}{main}{after}</body></html>"


def train(pages: Sequence[str]) -> PageModel:
    """Trees from the nodes of sample pages on which the markup itself tells what is main text.

    Each of these pages is used as it is and once more rewritten. A node above an article takes its label from most of its text, so that what an article lies in
    is not taken for a menu.
    """
    x, y = [], []
    samples = []
    for page in pages:
        tree = Tree(page)
        hints = tree.hints()
        if 1 not in hints:
            continue
        samples.append((tree, hints))
        lines = tree.text([h == 1 for h in hints]).split("\n")
        if lines[0]:
            tree = Tree(rewritten(lines, random.Random(crc32(page.encode("utf-8", "replace")))))
            samples.append((tree, tree.hints()))
    for tree, hints in samples:
        main = [node.chars * (hint == 1) for node, hint in zip(tree.nodes, hints)]
        for at in range(len(tree.nodes) - 1, 0, -1):
            main[tree.nodes[at].parent] += main[at]
        for node, hint, of_main, row in zip(tree.nodes, hints, main, tree.features()):
            label = hint if hint >= 0 else float(of_main > node.all_chars / 2)
            x.append(row)
            y.append(float(label))
    width = len(TAG_FEATURES) + 17
    return PageModel(fit_boosted(np.array(x).reshape(-1, width), np.array(y), rounds=30, depth=4))


def trained_model(pages: DataFrame) -> PageModel:
    """A model from a bounded sample of pages, the same in every run: first in hash order."""
    return train(text_sample(pages, "html", SAMPLE_PAGES, SAMPLE_CHARS))


def extract_text(pages: DataFrame, model: PageModel | None = None, at_once: int = 64) -> DataFrame:
    """The main text of every page: page_id, url, text, n_chars (code points).

    The whole page is read, null as empty; a page without main text has the empty text. Only
    page_id, url and html are read; repeated rows are all kept.
    """
    model = model or trained_model(pages)

    @F.pandas_udf("string")
    def main_text(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for html in batches:
            texts: list[str] = []
            for at in range(0, len(html), at_once):
                texts += model.extract(html[at : at + at_once].tolist())
            yield pd.Series(texts, dtype="object")

    return pages.select("page_id", "url", main_text(F.col("html")).alias("text")).withColumn(
        "n_chars", F.length("text").cast("long")
    )
