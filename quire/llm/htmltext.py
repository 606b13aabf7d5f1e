"""Main-text extraction: flat text blocks, described with their neighbours and classified by a decision tree.

A page is cut at block-level tags into flat blocks of text. A block is described by its words, link density and kind
(heading, paragraph, other), by words and link density of the blocks before and after it, and by where it stands (in an
article, in an area of boilerplate, on a page that has an article). A decision tree, grown here on the small table
LABELLED of pages with a label for each block, says which blocks are main text. Areas of boilerplate are told by element
names and by whole names in class, id and role: a name marks one if all its parts are in MARKS or BESIDE.

Defined results: a null or empty page has the empty text; broken markup (unclosed, unknown or stray tags, unended
comments and scripts) is read as a browser would, up to the page's end; repeated rows each give their text; an empty
table gives no rows; other columns are kept, and a column with the name of the new one is an error; pages are read whole
and no block is capped.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import free_name

_TAG = re.compile(r"<!--(?:>|->|.*?(?:--!?>|\Z))|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*)(?:>|\Z)|<[!?/][^>]*(?:>|\Z)", re.S)
#: One attribute: its name and, in quotes or bare, its value. Attributes are read one after the other from the start.
_ATTRIBUTE = re.compile(r"""([^\s"'/=>][^\s/=>]*)(?:\s*=\s*("[^"]*(?:"|\Z)|'[^']*(?:'|\Z)|[^\s>]+))?|"[^"]*"?|'[^']*'?|[\s/=>]+""")
_PARTS = re.compile(r"[^a-z0-9]+")
_HUMPS = re.compile(r"(?<=[a-z0-9])(?=[A-Z])")
#: Elements whose content is no text.
SILENT = {"script", "style", "noscript", "template", "title", "textarea", "svg", "iframe", "object", "math", "canvas", "audio", "video", "select", "button"}
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr br input".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6", "hgroup"}
PARAGRAPHS = {"p", "blockquote", "pre", "figcaption"}
AREAS = {"nav", "footer", "aside", "form", "menu", "dialog", "head", "fieldset"}
#: Parts of names in class, id and role that mark areas of boilerplate.
MARKS = set("ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion cookie cookies consent gdpr notice popup modal overlay nav navbar navigation menu breadcrumb breadcrumbs header masthead footer sidebar aside widget related recommended share sharing social newsletter subscribe signup login search form comment comments disqus replies pagination pager copyright toolbar dialog alert complementary contentinfo".split())
#: Parts that may stand beside them.
BESIDE = set("a the and main site page global top bottom left right primary secondary inner outer list lists item items box bar block blocks container content wrapper wrap section area slot unit group row col column label labels link links button buttons icon icons post posts article articles stories thread user users reader js l r text title media fixed sticky mobile desktop skip to us".split())
#: Marks of what may also head an article's own text.
HEADS = {"header", "masthead"}


class Block(NamedTuple):
    text: str
    words: int
    linked: int
    kind: int  # 2: heading, 1: paragraph, 0: other
    article: bool
    area: bool


def _named(value: str, in_article: bool) -> bool:
    """Whether a name in class, id or role marks boilerplate."""
    parts = {p for p in _PARTS.split(value) if p and not p.isdigit()}
    marks = parts & MARKS - (HEADS if in_article else set())
    return bool(marks) and parts <= MARKS | BESIDE


def _attributes(text: str) -> list[tuple[str, str]]:
    """Names, in lower case, and values of a tag's attributes."""
    return [(key.lower(), value[1:].removesuffix(value[0]) if value[:1] in ('"', "'") else value) for key, value in _ATTRIBUTE.findall(text) if key]


def _marked(name: str, attributes: str, in_article: bool) -> bool:
    if name in AREAS:
        return True
    if not attributes:
        return False
    for key, value in _attributes(attributes):
        if key == "hidden" or key == "aria-hidden" and value == "true" or key == "style" and "display:none" in value.lower().replace(" ", ""):
            return True
        if key in ("class", "id", "role") and any(_named(_HUMPS.sub("-", x).lower(), in_article) for x in value.split()):
            return True
    return False


def blocks(page: str) -> list[Block]:
    """The page's flat blocks of text in order."""
    out: list[Block] = []
    parts: list[str] = []
    stack: list[tuple[str, bool, bool]] = []  # open block elements: name, in an article, in an area
    linked = 0
    link: int | None = None  # where in parts the open link starts

    def words_of(pieces: list[str]) -> int:
        return len("".join(pieces).split())

    def flush() -> None:
        nonlocal linked, link
        if link is not None:
            linked += words_of(parts[link:])
            link = 0
        text = " ".join("".join(parts).split())
        if text:
            inside, article, area = stack[-1] if stack else ("", False, False)
            out.append(Block(text, len(text.split()), linked, 2 if inside in HEADINGS else int(inside in PARAGRAPHS), article, area))
        parts.clear()
        linked = 0

    at = 0
    while at < len(page):
        m = _TAG.search(page, at)
        end = m.start() if m else len(page)
        if end > at:
            piece = page[at:end]
            parts.append(html.unescape(piece) if "&" in piece else piece)
        if not m:
            break
        at = m.end()
        name = (m[2] or "").lower()
        if not name:
            continue
        closing = bool(m[1])
        if name in SILENT:
            if not closing and not m[3].endswith("/"):
                close = re.compile(rf"</{re.escape(name)}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.I).search(page, at)
                at = close.end() if close else len(page)
            if name not in ("script", "style"):
                parts.append(" ")
            continue
        if name == "a":
            if link is not None:
                linked += words_of(parts[link:])
            link = None if closing else len(parts)
            continue
        if name in INLINE or name.count("-"):
            if name == "br":
                parts.append(" ")
            continue
        flush()
        if name in VOID:
            continue
        if closing:
            places = [i for i, x in enumerate(stack) if x[0] == name]
            if places:
                del stack[places[-1] :]
            continue
        if stack and stack[-1][0] == "p":  # any block element ends a paragraph
            stack.pop()
        if stack and name in ("li", "dt", "dd", "td", "th", "tr", "option") and stack[-1][0] in (name, "dt", "dd", "td", "th") and (name != "tr" or stack[-1][0] in ("td", "th", "tr")) and name in ("tr", stack[-1][0]):
            stack.pop()
        _, article, area = stack[-1] if stack else ("", False, False)
        own = name in ("article", "main") or "role" in m[3].lower() and ("role", "main") in _attributes(m[3])
        stack.append((name, article or own, area or name == "header" and not article or name not in ("body", "html", "article", "main") and _marked(name, m[3], article)))
    flush()
    return out


FEATURES = ("words", "link density", "kind", "words before", "link density before", "words after", "link density after", "in an article", "in an area", "page has an article")
#: Labelled pages. A block is + (main text) or -, its kind (h heading, p paragraph, x other), its words,
#: /linked words, and the marks @ (in an article) and ! (in an area).
LABELLED = (
    # news and blog pages with an article element
    "-x1/1! -x1/1! -x2/2! -x9! +h9@ +p3@ +p62/2@ +p1@ +h2@ +p41@ -x11!",
    "-x3/3! -p25 +h12@ +x4@ +p80/4@ +x6/6@ +x5/5@ +p33@ -x12@! -p18@! -x8/8! -p40!",
    "-h2! -x2/2 -x1/1 +h5@ +p8/7@ +p2@ +x3/3@ +x2/2@ +x9@ +p120@ -x30@! -h3 -p9 -x6/6",
    "-x15 -x4/4 +h4@ +p1@ +p25/8@ +p12/12@ +x2@ +x1@ +x45@ -p30@! -p22 -p3/1",
    "+h3@ +p3@ +x4@",
    "-x1/1! +p9@ +x40@ +x2@",
    # pages that end with their article
    "-x1/1! -x2/2! +h4@ +p20@ +p20@",
    "+h6@ +p48@ +p7@",
    "-x2/2! +h3@ +p90/2@ +p33@ +p110@",
    "-x3/3 -x1/1 +h8@ +p15@ +x4@ +p5@",
    "+h2@ +p17@ +p70@ +x25@",
    "-x1/1! +p30@ +p3@ +p60@ +p12@",
    "-p12 -h6 +p50@ +x7/3@ +p5/5@ +h3@ +x14@ -p55 -x2/2",
    # pages without one: the text stands in plain paragraphs and divisions
    "-x1/1 -x1/1 -x1/1 -x2/2 +h6 +p55 +p40/3 +h2 +p9 +p70 -x3/3 -x2/2 -x5",
    "+h2 +p1",
    "+h4 +p2 +p3 +p1 +p30",
    "+p18 +p4 +p6/2 +p28/4",
    "+h5 +p20 +p20",
    "-x1/1 -x2/2 +h4 +p40 +p65 +p18",
    "+p24 +p9 +p80 +x30",
    "-x2/2 -x3/3 +h3 +p16 +p5",
    "-x2/2 -x2/2 -x3/3 -h2 -x2/2 -x4/4 +h8 +p35 +x12 +x9 +p20 -h1 -x5/5 -x6/6 -x4/4",
    "+x60 +x45/3 +x80 +x22 -x2/2 -x1/1",
    "-x3 -x1/1 -x1/1 +x50/2 +x8 +x65 -x6",
    "-x4/4 -p6/6 +h7 +p4 +p90/9 +p14/5 +x20 +x16 +p60 -p8/7 -x3/3 -h2 -x7/7",
    "+h3 +p12/6 +h2 +p25 +x6 +x7 +x5 +p30 -x2/2 -x3/3",
    "-h1 -x1/1 -x2/2 -x1/1 +p44 +p2 +p61/2 -h2 -x8/8 -x9/9 -x7/7 -p10/8",
    "-x5 -x2/2 -x4 -x2/2 +h10 +p33/1 +p5 -p4! -x20! -x3/3!",
    "+h5 +x35 +x40/6 +h3 +x18 -x2 -x1/1 -x1/1 -p25!",
    "-x2 +h9 +p100 +p1 -x1/1 -x2 -x1/1 -x6",
    "+p7 +x30 +p11/4 +p3 -h3 -x4/4 -x3/3",
)
_SPEC = re.compile(r"([+-])([hpx])(\d+)(?:/(\d+))?(@?)(!?)")


def labelled(pages: tuple[str, ...] = LABELLED) -> np.ndarray:
    """FEATURES of every block of labelled pages, and its label."""
    rows = []
    for page in pages:
        specs = [_SPEC.fullmatch(x) for x in page.split()]
        found = [Block("", int(m[3]), int(m[4] or 0), "xph".index(m[2]), bool(m[5]), bool(m[6])) for m in specs]
        rows += [(*row, float(m[1] == "+")) for row, m in zip(describe(found), specs, strict=True)]
    return np.array(rows)


class Leaf(NamedTuple):
    label: int


class Split(NamedTuple):
    feature: int
    most: float
    yes: Leaf | Split
    no: Leaf | Split


#: Blocks that either side of a split has at least.
LEAST_BLOCKS = 3


def grow(x: np.ndarray, y: np.ndarray, depth: int = 8) -> Leaf | Split:
    """A CART tree by Gini impurity; equal gains go to the first feature and the lowest threshold."""
    label = Leaf(int(2 * y.sum() > len(y)))
    if depth == 0 or y.min() == y.max():
        return label
    gini = lambda part: 2 * part.mean() * (1 - part.mean()) * len(part)
    best: tuple[float, int, float] | None = None
    for feature in range(x.shape[1]):
        values = np.unique(x[:, feature])
        for most in (values[1:] + values[:-1]) / 2:
            left = x[:, feature] <= most
            if min(left.sum(), (~left).sum()) < LEAST_BLOCKS:
                continue
            cost = gini(y[left]) + gini(y[~left])
            if best is None or cost < best[0] - 1e-12:
                best = (cost, feature, float(most))
    if best is None or best[0] >= gini(y) - 1e-12:
        return label
    left = x[:, best[1]] <= best[2]
    return Split(best[1], best[2], grow(x[left], y[left], depth - 1), grow(x[~left], y[~left], depth - 1))


def trained(pages: tuple[str, ...] = LABELLED) -> Leaf | Split:
    table = labelled(pages)
    return grow(table[:, :-1], table[:, -1])


def describe(found: list[Block]) -> list[tuple[float, ...]]:
    """FEATURES of each block."""
    has_article = any(b.article for b in found)
    own = [(float(b.words), b.linked / b.words) for b in found]
    none = (0.0, 0.0)
    return [(*own[i], float(b.kind), *(own[i - 1] if i else none), *(own[i + 1] if i + 1 < len(own) else none), float(b.article), float(b.area), float(has_article)) for i, b in enumerate(found)]


def is_main(tree: Leaf | Split, row: tuple[float, ...]) -> bool:
    while isinstance(tree, Split):
        tree = tree.yes if row[tree.feature] <= tree.most else tree.no
    return bool(tree.label)


def main_text(page: str | None, tree: Leaf | Split) -> str:
    found = blocks(page or "")
    return "\n".join(b.text for b, row in zip(found, describe(found), strict=True) if is_main(tree, row))


def extract(pages: DataFrame, html_col: str = "html", name: str = "text") -> DataFrame:
    """pages with name, the main text of html_col, in its place."""
    from pyspark.sql import types as T

    rest = [f for f in pages.schema.fields if f.name != html_col]
    kept = pages.select(*[f"`{f.name}`" for f in rest], html_col)
    if name in [f.name for f in rest] or free_name(pages.drop(html_col), name) != name:
        raise ValueError(f"column {name} exists")
    tree = trained()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x.as_py(), tree) for x in batch.column(len(rest))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(texts, pa.string())], [*batch.schema.names[:-1], name])

    return kept.mapInArrow(run, T.StructType([*rest, T.StructField(name, T.StringType())]))
