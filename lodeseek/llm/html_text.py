"""Main text of web pages from flat text blocks.

A page is cut into blocks of text wherever a block-level tag starts or ends. A block is described
by its own words and link density, those of the blocks before and after it, whether it is a
heading, and, as minor features, what its surroundings say of themselves: page furniture
(navigation, header, footer, aside, form, or a class, id or role whose last word names an advert, a
notice, comments and the like) or main text (article, main, or a class, id or role that names
content). A decision tree tells main text from the rest. It is trained on the small labelled table
below: sketches of pages as sequences of blocks, once as they are and once without what surroundings
say, so that words and link density of neighbours have to decide there.

Elements end as in HTML: script and the like at their end tag or the page's end, other elements with
whatever is open around them; svg also at a tag that can't be in it, and where it closes itself; a
form's control also at the next block.

Defined results: null, empty or textless html gives an empty text. Pages of any length are read
whole, in time proportional to it; a tag, comment or script that never ends reaches to the end of
the page. Text of math, and what stands in for audio, video, object and canvas, is text like other.
Repeated rows give repeated results; an empty table an empty one. Columns beyond the key, the carried
ones and the html are not read. Character references are decoded, also those without a semicolon.
"""

from __future__ import annotations

import html as markup
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeseek.llm.common import mapped, table

PAGES_AT_A_TIME = 256

# Names of elements.
RAW = frozenset("script style noscript template title iframe textarea noembed noframes xmp".split())
INVISIBLE = frozenset("script style noscript template title".split())
CONTROLS = frozenset("button select option optgroup datalist".split())
INLINE = frozenset(
    "a abbr acronym audio b bdi bdo big canvas cite code data del dfn em font i img input ins kbd label map mark math meter nobr object output picture progress q rp rt ruby s samp small source span strike strong sub sup time track tt u var video wbr br area "
    "mi mn mo ms mtext mspace mrow mfrac msqrt mroot mstyle merror mpadded mphantom msub msup msubsup munder mover munderover mmultiscripts mtable mtr mtd menclose semantics annotation".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
FURNITURE_TAGS = frozenset("nav footer aside form dialog menu head".split())
MAIN_TAGS = frozenset("article main".split())

# Words of a class, id or role that name page furniture, main text, and neither; and those that say what a page has or hasn't.
FURNITURE_WORDS = frozenset(
    "ad ads adv advert advertisement advertising adsense banner sponsor sponsored promo promotion nav navbar navigation menu breadcrumb breadcrumbs header masthead topbar footer foot bottombar sidebar "
    "aside widget comment comments disqus respond reply replies cookie cookies consent notice notification alert popup modal overlay newsletter subscribe subscription signup login share sharing social "
    "related recommended toolbar pagination pager copyright search form dialog contentinfo complementary".split()
)
MAIN_WORDS = frozenset("article content main post story entry body text".split())
NEUTRAL_WORDS = frozenset("area bar block box button buttons col column container group holder inner item items left link links list outer panel right row section site top bottom wrap wrapper page".split())
STATES = frozenset("has with no without is".split())
# Elements that hold running text, and words which there, within the main text, say how it looks rather than what it is.
RUNNING = frozenset("p li dd dt blockquote pre td th figcaption".split()) | HEADINGS
LOOKS = frozenset("widget form dialog search header related share sharing social login alert".split())

_TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+(?:>|\Z)"""
    r"""|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*+)(?P<rest>(?:[^>"']++|"[^"]*+"|'[^']*+')*+>|[^>]*+(?:>|\Z))""",
    re.S,
)
_NAMED = re.compile(r"""(?:^|[\s"'/])(class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
_HREF = re.compile(r"""(?:^|[\s"'/])href\s*=""", re.I)
_NAME_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_RAW_END = {tag: re.compile(rf"</{tag}(?=[\s/>])[^>]*+(?:>|\Z)", re.I) for tag in RAW}


@dataclass
class Block:
    text: str
    words: int
    link_words: int
    heading: bool
    furniture: bool
    main: bool


def says(attributes: str, within_main: bool, tag: str = "") -> tuple[bool, bool]:
    """Whether class, id or role name page furniture, and whether they name main text.

    A name's last word that isn't neutral counts: "search-algorithms" are no search, a
    "comment-list" is of comments. A header is the article's own if the name or what is around says so.
    A paragraph of the main text isn't furniture for a word that may tell of its looks only.
    """
    furniture = main = False
    for _, value in _NAMED.findall(attributes):
        for name in value.strip("\"'").split():
            parts = [p.lower() for p in _NAME_PARTS.findall(name)]
            if not parts or parts[0] in STATES:
                continue
            heads = [p for p in parts if p not in NEUTRAL_WORDS and p not in MAIN_WORDS]
            of_main = not MAIN_WORDS.isdisjoint(parts)
            if not heads:
                main |= of_main
            elif heads[-1] in FURNITURE_WORDS and not (within_main and tag in RUNNING and heads[-1] in LOOKS):
                furniture |= not (heads[-1] == "header" and (within_main or of_main))
    return furniture, main


@dataclass
class _Open:
    """An open element; furniture and main hold for it and all around it."""

    tag: str
    furniture: bool = False
    main: bool = False
    control: bool = False


class _Page:
    """Cuts one page into its text blocks."""

    def __init__(self, page: str) -> None:
        self.page, self.out = page, []
        self.parts: list[str] = []
        self.words = self.link_words = 0
        self.open = [_Open("")]
        self.often: Counter[str] = Counter()  # open elements by tag, so that an end tag without a start costs nothing
        self.link = 0  # how many elements were open where the link began; 0: in none
        self.heading, self.svg = False, 0

    def flush(self) -> None:
        if text := " ".join("".join(self.parts).split()):
            self.out.append(Block(text, self.words, self.link_words, self.heading, self.open[-1].furniture, self.open[-1].main))
        self.parts.clear()
        self.words = self.link_words = 0

    def add(self, raw: str) -> None:
        if self.svg:
            return
        text = markup.unescape(raw) if "&" in raw else raw
        self.parts.append(text)
        n = len(text.split())
        self.words += n
        if self.link:
            self.link_words += n

    def push(self, element: _Open) -> None:
        self.open.append(element)
        self.often[element.tag] += 1

    def pop(self) -> _Open:
        gone = self.open.pop()
        self.often[gone.tag] -= 1
        if self.link > len(self.open):
            self.link = 0
        return gone

    def close(self, tag: str) -> None:
        """Close tag and all that is open in it, if it is open."""
        if self.often[tag]:
            while self.pop().tag != tag:
                pass

    def run(self) -> list[Block]:
        at = 0
        while m := _TOKEN.search(self.page, at):
            if m.start() > at:
                self.add(self.page[at : m.start()])
            at = m.end()
            if not (tag := m["tag"]):
                continue
            tag = tag.lower()
            if tag in RAW and not m["end"]:
                ended = _RAW_END[tag].search(self.page, at)
                at = ended.end() if ended else len(self.page)
                if tag not in INVISIBLE:
                    self.parts.append(" ")
            elif tag == "svg" or self.svg:
                self.graphics(tag, bool(m["end"]), m["rest"])
            elif m["end"]:
                self.end(tag)
            else:
                self.start(tag, m["rest"])
        if at < len(self.page):
            self.add(self.page[at:])
        self.flush()
        return self.out

    def graphics(self, tag: str, ends: bool, rest: str) -> None:
        """svg has no text of the page. It ends at its end tag, or where HTML that can't be in it begins or ends around it."""
        if tag == "svg":
            closed = rest.rstrip(">").endswith("/")
            self.svg = max(0, self.svg - 1) if ends else self.svg + (not closed)
            self.parts.append(" ")
        elif tag in HEADINGS or tag in ("p", "div", "ul", "ol", "li", "table", "section", "article", "main", "body", "br", "span", "b", "em", "i", "strong", "img", "pre", "hr", "blockquote") and not (ends and not self.often[tag]):
            self.svg = 0
            self.end(tag) if ends else self.start(tag, rest)

    def end(self, tag: str) -> None:
        if tag == "a":
            self.link = 0
        elif tag in INLINE:
            if self.open[-1].tag == tag:  # it called itself furniture
                self.flush()
                self.pop()
        elif tag in CONTROLS:
            if self.often[tag]:
                self.flush()
                self.close(tag)
        else:
            self.flush()
            self.heading = False
            self.close(tag)

    def start(self, tag: str, rest: str) -> None:
        top = self.open[-1]
        if tag == "a":
            self.link = len(self.open) if _HREF.search(rest) else 0
            return
        if tag == "br":
            self.parts.append(" ")
        if tag in INLINE:
            if "=" in rest and tag not in VOID and says(rest, top.main)[0]:
                self.flush()
                self.push(_Open(tag, True, top.main))
            return
        self.flush()
        if tag in CONTROLS:
            if tag in ("button", "select"):
                self.close(tag)
                top = self.open[-1]
            self.push(_Open(tag, True, top.main, True))
            return
        while self.open[-1].control:  # a control holds no blocks
            self.pop()
        if self.open[-1].tag == "p" or self.open[-1].tag in HEADINGS and tag in HEADINGS or self.open[-1].tag == tag and tag in ("li", "dt", "dd", "td", "th", "tr"):
            self.pop()
        top = self.open[-1]
        self.heading = tag in HEADINGS
        if tag in VOID:
            return
        furniture, main = says(rest, top.main, tag) if "=" in rest else (False, False)
        # A header within the main text holds its title; elsewhere it is the page's.
        furniture = furniture or tag in FURNITURE_TAGS or (tag == "header" and not top.main)
        main = tag in MAIN_TAGS or (main and not furniture)
        if tag in ("html", "body"):
            furniture = main = False
        self.push(_Open(tag, top.furniture or furniture, top.main or main))


def blocks(page: str) -> list[Block]:
    """The page's text blocks, in order."""
    return _Page(page).run()


#: What the tree sees of a block.
FEATURES = ("words", "link_density", "words_before", "link_density_before", "words_after", "link_density_after", "heading", "furniture", "main")


def features(found: list[Block]) -> list[tuple[float, ...]]:
    own = [(float(b.words), b.link_words / b.words if b.words else 0.0) for b in found]
    around = [(0.0, 0.0), *own, (0.0, 0.0)]
    return [(*own[i], *around[i], *around[i + 2], float(b.heading), float(b.furniture), float(b.main)) for i, b in enumerate(found)]


# The labelled table, written by hand: pages as sequences of blocks. A block is its words, a slash, the
# words in links of a hundred, h for a heading, f, m or b if its surroundings say furniture, main text or
# both, and + for main text or - for the rest. A block with ! can only be told by its surroundings.
SKETCHES = (
    # articles that say what they are
    "1/100f- 1/100f- 2/100f- 9/0hm+ 45/0m+ 80/5m+ 30/0m+ 6/0hm+ 55/0m+ 20/10m+ 3/0m+! 8/0f-! 14/0f-!",
    "10/0f-! 1/100f- 1/100f- 7/0hm+ 120/0m+ 14/0f-! 60/0m+ 25/20m+ 1/0m+! 1/0m+! 2/0m+! 40/0m+ 22/0f-! 3/0f-!",
    "3/0f-! 4/100f- 12/0hm+ 12/0m+ 10/0m+ 9/0m+ 14/30m+ 12/0m+ 30/0f-! 5/0hf-! 18/0f-! 40/0f-! 6/0f-!",
    "2/100f- 2/100f- 40/0f-! 5/0hm+ 200/2m+ 7/100m+ 150/0m+ 3/100m+ 90/0m+ 55/10f-! 2/100f- 2/100f- 9/20f-!",
    "18/0f-! 2/0hm+ 3/0m+! 5/0m+! 4/0m+! 2/0m+! 6/0m+! 25/0f-! 90/0f-!",
    "5/100f- 8/0hm+ 70/0m+ 3/100m+! 4/100m+! 3/100m+! 5/100m+! 65/0m+ 12/100m+ 50/0m+ 2/100f- 3/100f-",
    "1/0m+!",
    "400/1m+ 350/0m+ 500/3m+ 60/0f-! 300/0m+",
    "9/0hm+ 60/0m+ 1/0m+! 1/0b-! 2/0b-! 45/0m+ 5/0b-! 2/0m+! 3/0b-! 30/0b-! 20/0m+ 1/0m+! 12/0b-! 4/0m+! 1/0b-! 70/0b-!",
    "1/0m+! 2/0b-! 1/0m+! 3/0b-! 2/0m+! 1/0b-! 1/0m+! 50/0b-! 1/0m+! 90/0m+ 1/0m+! 60/0m+ 2/0hm+! 80/0m+ 1/0m+! 1/0m+! 3/0m+! 75/0m+ 1/0m+!",
    "12/0m+ 6/100m+! 9/0m+ 4/100m+! 14/0m+ 3/100m+! 2/0m+! 5/100m+! 1/0m+! 8/0m+! 9/100m+! 40/0m+ 2/60b-! 55/0m+ 4/50m+! 3/0m+! 6/40m+!",
    "30/0m+ 2/100m+! 25/0m+ 1/100m+! 40/0m+ 8/100b-! 35/0m+ 20/60b-! 12/0m+",
    "60/0m+ 9/0m+",
    "22/0m+!",
    "15/100m+! 14/0m+!",
    # short articles, and lists of links at an article's end
    "2/100f- 3/100f- 2/0hm+! 8/0m+! 14/0f-! 2/100f-",
    "2/0hm+! 12/0m+!",
    "8/0m+! 10/0m+! 15/0m+!",
    "12/0m+!",
    "9/0hm+! 3/0m+! 6/100m+! 8/0f-!",
    "6/0hm+ 70/0m+ 1/0hm+! 3/100m+! 9/100m+! 14/100m+! 2/100m+! 30/90m+! 5/0f-!",
    "3/100m+!",
    # articles on pages that say nothing
    "1/100- 1/100- 1/100- 2/100- 9/0h+ 45/0+ 80/5+ 30/0+ 6/0h+ 55/0+ 90/20+ 2/100- 1/100- 3/100- 9/0-",
    "2/100- 3/100- 7/0h+ 35/10+ 60/0+ 8/0+ 45/0+ 22/0+ 5/0h+ 28/0+ 50/0+ 4/100- 6/100- 5/100- 6/0-",
    "6/0- 2/100- 1/100- 10/0h+ 18/0+ 40/0+ 14/0+ 33/15+ 7/100+ 48/0+ 16/70- 3/100- 2/100- 2/0-",
    "1/100- 2/100- 120/0+ 6/0+ 90/5+ 4/0h+ 70/0+ 12/0+ 65/0+ 30/90- 20/100- 8/50-",
    "4/0- 3/100- 3/100- 2/100- 11/0h+ 250/4+ 9/100+ 180/0+ 3/0h+ 140/0+ 2/0h- 5/100- 6/100- 4/100- 7/0-",
    "40/0+ 40/0+ 40/0+",
    "55/0+ 3/0+ 70/0+ 5/0+ 50/0+ 2/100- 3/100- 3/0- 2/100- 3/100-",
    "2/100- 3/100- 40/0+ 3/0+ 45/0+ 2/0+ 60/0+ 3/0+ 64/0+ 3/0+ 90/0+ 2/0+ 100/0+ 2/100- 3/0- 2/100-",
    # pages of hardly more than a text
    "1/0+",
    "4/0+",
    "7/0+",
    "12/0+",
    "30/0+",
    "4/0+ 5/0+",
    "5/0+ 4/0+",
    "6/0+ 9/0+",
    "5/0+ 7/0+ 6/0+",
    "12/0+ 10/0+",
    "7/0+ 16/0+",
    "4/0h+ 11/0+",
    "5/0h+ 12/0+ 9/0+",
    "12/0+ 9/10+ 14/0+",
    "3/100- 2/100-",
    "2/100-",
    "1/100- 1/100- 70/0+ 1/0- 90/0+ 1/0- 60/0+ 2/0- 1/0- 1/0- 1/100- 1/0-",
    # pages of links, menus and small print
    "1/100- 1/100- 1/100- 1/100- 3/0h- 5/100- 6/100- 4/100- 2/0h- 3/100- 5/100- 7/100- 6/0- 4/0- 3/100-",
    "2/0- 2/100- 8/100- 9/100- 12/90- 10/100- 3/0- 2/100- 1/0- 9/30- 5/0-",
    "3/0h- 2/100- 16/80- 14/75- 20/100- 18/90- 4/0- 3/0- 5/0- 2/0-",
)
_SKETCHED = re.compile(r"(\d+)/(\d+)(h?)([fmb]?)([+-])(!?)")


def labelled(sketches: tuple[str, ...] = SKETCHES) -> list[tuple[tuple[float, ...], int]]:
    """The features and the label (1: main text) of each sketched block, as it is, and without what surroundings say unless only they can tell it.

    What surroundings say weighs more than form, so each block is also listed as if they said main text, furniture, and both.
    """
    out = []
    for sketch in sketches:
        cut = [_SKETCHED.fullmatch(x).groups() for x in sketch.split()]
        for hints in (True, False):
            found = [Block("", int(w), round(int(w) * int(d) / 100), bool(h), hints and s in ("f", "b"), hints and s in ("m", "b")) for w, d, h, s, _, _ in cut]
            out += [(x, int(c[4] == "+")) for x, c in zip(features(found), cut, strict=True) if hints or not c[5]]
        out += [((*x[:-2], furniture, main), int(main > furniture)) for x in features(found) for furniture, main in ((0.0, 1.0), (1.0, 0.0), (1.0, 1.0))]
    return out


@dataclass
class Node:
    """A leaf (feature < 0) has a verdict; else rows with feature <= cut go low."""

    feature: int
    cut: float
    low: Node | None
    high: Node | None
    verdict: bool


def train(rows: list[tuple[tuple[float, ...], int]], depth: int = 12) -> Node:
    """A classification tree by Gini impurity; among equal splits the first feature and the smallest cut."""
    good = sum(y for _, y in rows)
    leaf = Node(-1, 0.0, None, None, 2 * good > len(rows))
    if not depth or good in (0, len(rows)):
        return leaf
    best = None
    for f in range(len(rows[0][0])):
        values = sorted({x[f] for x, _ in rows})
        for a, b in zip(values, values[1:], strict=False):
            cut = (a + b) / 2
            low = [y for x, y in rows if x[f] <= cut]
            p, q = sum(low), good - sum(low)
            n, m = len(low), len(rows) - len(low)
            impurity = p * (n - p) / n + q * (m - q) / m
            if best is None or impurity < best[0] - 1e-12:
                best = (impurity, f, cut)
    if best is None:
        return leaf
    _, f, cut = best
    return Node(f, cut, train([r for r in rows if r[0][f] <= cut], depth - 1), train([r for r in rows if r[0][f] > cut], depth - 1), leaf.verdict)


def is_main(tree: Node, x: tuple[float, ...]) -> bool:
    while tree.feature >= 0:
        tree = tree.low if x[tree.feature] <= tree.cut else tree.high
    return tree.verdict


def main_text(page: str | None, tree: Node) -> str:
    if not page:
        return ""
    found = blocks(page)
    return "\n\n".join(b.text for b, x in zip(found, features(found), strict=True) if is_main(tree, x))


def extract(df: DataFrame, key: str, html: str, carried: tuple[str, ...] = (), rows: list[tuple[tuple[float, ...], int]] | None = None) -> DataFrame:
    """Per row: key, carried columns, text, n_chars. A narrow pass without a shuffle. rows: a labelled table of one's own."""
    tree = train(labelled() if rows is None else rows)
    kinds = ", ".join(f"c{i} {df.schema[c].dataType.simpleString()}" for i, c in enumerate((key, *carried)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, PAGES_AT_A_TIME):
                part = batch.slice(start, PAGES_AT_A_TIME)
                texts = [main_text(page, tree) for page in part.column(part.num_columns - 1).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[:-1], pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], names=[*part.schema.names[:-1], "text", "n_chars"]
                )

    chosen = df.select(*(F.col(c).alias(f"c{i}") for i, c in enumerate((key, *carried))), F.col(html).cast("string").alias("html"))
    return mapped(chosen, run, f"{kinds}, text string, n_chars long").toDF(key, *carried, "text", "n_chars")


def op3_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    return extract(table(spark, sf_dir, "pages"), "page_id", "html", ("url",))
