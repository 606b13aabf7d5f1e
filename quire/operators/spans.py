"""Spans of a page's text made lines, images kept or dropped, and equations found among lines.

Spans are rows of doc_id, page, block, line, span_no, text, size, font, raised, bold, italic; their lines have boxes and a
direction. Equations are merged by a fold over the boxes of one page.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions.shared import many

LINE = ["doc_id", "page", "block", "line"]
#: Raised text of so many characters is a mark, not text.
MARK_LENGTH = 4
# Parts of the names of mathematical fonts.
MATH_FONTS = ("math", "cmmi", "cmsy", "cmex", "msam", "msbm", "symbol", "mtmi", "mtsy", "euclid", "cambriamath", "stix", "xits", "asana")
OPERATORS = r"[=+\-−×·/^_∑∫√≈≤≥≠∂]"


def lines_from_spans(spans: DataFrame, boxes: DataFrame) -> DataFrame:
    """A row for each line with text: text and marked (with calls of notes as [^n]), the marks in order, the mark at its start
    and end, the size and font of most characters, bold and italic (over 60 % of the characters), rotated. boxes: LINE, x0,
    y0, x1, y1, dx, dy. A line of nothing but raised spans is text."""
    c = F.col
    shown = F.trim("text")
    rows = spans.withColumn("_t", shown).withColumn("_n", F.length(shown))
    listed = rows.groupBy(*LINE).agg(F.sort_array(F.collect_list(F.struct("span_no", "text", F.col("_t").alias("t"), (c("raised") & (c("_n") > 0) & (c("_n") <= MARK_LENGTH)).alias("up")))).alias("_s"), F.count_if((c("_n") > 0) & ~(c("raised") & (c("_n") <= MARK_LENGTH))).alias("_plain"), F.count_if(c("_n") > 0).alias("_some"))
    listed = listed.where("_some > 0").withColumn("_s", F.when(c("_plain") > 0, c("_s")).otherwise(F.transform("_s", lambda s: s.withField("up", F.lit(False)))))
    squeeze = lambda x: F.trim(F.regexp_replace(x, r"\s+", " "))
    visible = F.filter("_s", lambda s: s["t"] != "")
    first, last = F.get(visible, F.lit(0)), F.try_element_at(visible, F.lit(-1))
    call = lambda t: F.concat(F.lit("[^"), F.translate(t, "⁰¹²³⁴⁵⁶⁷⁸⁹", "0123456789"), F.lit("]"))
    is_call = lambda s: s["t"].rlike(r"^(?:\d{1,3}(?:[,;–-]\d{1,3})*|[⁰¹²³⁴-⁹]+|\*{1,4}|[†‡§])$") & (s["span_no"] != first["span_no"])
    text = squeeze(F.array_join(F.transform(F.filter("_s", lambda s: ~s["up"]), lambda s: s["text"]), ""))
    marked = squeeze(F.array_join(F.transform("_s", lambda s: F.when(~s["up"], s["text"]).when(is_call(s), call(s["t"])).otherwise("")), ""))
    texts = listed.select(*LINE, text.alias("text"), F.regexp_replace(marked, r"\s+(\[\^[^\]]+\])", "$1").alias("marked"), F.transform(F.filter("_s", lambda s: s["up"]), lambda s: s["t"]).alias("marks"), F.when(first["up"], first["t"]).otherwise("").alias("mark_first"), F.when(last["up"] & (F.size(visible) > 1), last["t"]).otherwise("").alias("mark_last"), "_plain")
    # what counts for style: plain spans, or all where there are none
    counted = rows.join(many(texts.select(*LINE, "_plain")), LINE).where((c("_n") > 0) & ((c("_plain") == 0) | ~(c("raised") & (c("_n") <= MARK_LENGTH))))

    def most(value: Column, name: str) -> DataFrame:
        sums = counted.withColumn("_v", value).groupBy(*LINE, "_v").agg(F.sum("_n").alias("_w"), F.min("span_no").alias("_at"))
        return sums.groupBy(*LINE).agg(F.max_by("_v", F.struct("_w", -c("_at"))).alias(name))

    share = lambda x: (F.sum(F.when(c(x), c("_n")).otherwise(0)) / F.sum("_n") > 0.6).alias(x)
    style = counted.groupBy(*LINE).agg(share("bold"), share("italic"))
    out = texts.drop("_plain").where("text <> ''").join(many(most(F.round("size", 1), "size")), LINE).join(many(most(c("font"), "font")), LINE).join(many(style), LINE).join(many(boxes), LINE)
    return out.withColumn("rotated", (F.abs(c("dx") - 1) > 0.01) | (F.abs(c("dy")) > 0.01)).drop("dx", "dy")


def kept_images(images: DataFrame, height: float, scanned: DataFrame | None = None) -> DataFrame:
    """Images of 60 by 60 points or more that don't lie in the top 8 % or the bottom 5 % of their page; none of scanned pages
    (doc_id, page), where the image is the page. images: doc_id, page, x0, y0, x1, y1."""
    c = F.col
    fits = (c("x1") - c("x0") >= 60) & (c("y1") - c("y0") >= 60) & (c("y1") >= 0.08 * height) & (c("y0") <= 0.95 * height)
    kept = images.where(fits)
    return kept if scanned is None else kept.join(scanned.select("doc_id", "page").distinct(), ["doc_id", "page"], "left_anti")


def running_text(text: Column) -> Column:
    """Whether a text has eight words or more and ends like a sentence."""
    return (F.size(F.regexp_extract_all(text, F.lit(r"[A-Za-zÀ-ú]{3,}"), F.lit(0))) >= 8) & F.rtrim(text).rlike("[.;:]$")


def equation_boxes(lines: DataFrame) -> DataFrame:
    """doc_id, page, block, number, text, only_number and box of a page's blocks that are equations: those with a line of
    nothing but a number in brackets, whose rest has an operator or a font of mathematics; and unnumbered ones of 200
    characters at most whose lines have such fonts by half. lines: the body's."""
    c = F.col
    number = F.nullif(F.regexp_extract(F.trim("text"), r"^\(\s*(\d{1,3}[A-Za-z]?(?:\.\d{1,3})?)\s*\)$", 1), F.lit(""))
    rows = lines.where(~c("rotated")).withColumn("_num", number).withColumn("_math", c("font").rlike("(?i)" + "|".join(MATH_FONTS)))
    first = F.min(F.when(c("_num").isNotNull(), c("line_no"))).over(_by(["doc_id", "page", "block"]))
    rows = rows.withColumn("_is_num", F.coalesce(c("line_no") == first, F.lit(False)))
    said = F.array_join(F.transform(F.filter(F.sort_array(F.collect_list(F.struct("y0", "x0", "line_no", "text", c("_is_num").alias("n")))), lambda s: ~s["n"]), lambda s: s["text"]), " ")
    per = rows.groupBy("doc_id", "page", "block").agg(
        F.max(F.when(c("_is_num"), c("_num"))).alias("number"), F.trim(said).alias("text"), F.count_if(~c("_is_num")).alias("_rest"), F.count_if(c("_math") & ~c("_is_num")).alias("_math"), F.count(F.lit(1)).alias("_n"),
        *[f(n).alias(n) for n, f in (("x0", F.min), ("y0", F.min), ("x1", F.max), ("y1", F.max))],
    )
    alone = c("number").isNotNull() & (c("_rest") == 0)
    with_number = c("number").isNotNull() & (c("_rest") > 0) & ~running_text(c("text")) & ((c("_math") > 0) | c("text").rlike(r"[=+\-−×·/^_∑∫√≈≤≥≠∂πα-ω]"))
    without = c("number").isNull() & (c("_math") > 0) & (c("_math") >= F.greatest(F.lit(1), F.floor(c("_n") / 2))) & (F.length("text") <= 200) & ~running_text(c("text"))
    return per.where(alone | with_number | without).select("doc_id", "page", "block", "number", "text", alone.alias("only_number"), "x0", "y0", "x1", "y1")


def _by(keys: list[str]):
    from pyspark.sql.window import Window

    return Window.partitionBy(*keys)


class _Box:
    """An equation's box while it grows."""

    def __init__(self, row: dict):
        self.page, self.number, self.text, self.only = row["page"], row["number"], row["text"], row["only_number"]
        self.low, self.high = [row["x0"], row["y0"]], [row["x1"], row["y1"]]

    def span(self, axis: int) -> float:
        return self.high[axis] - self.low[axis]

    def shared(self, other: _Box, axis: int) -> float:
        """How much of the smaller extent along axis both share."""
        return (min(self.high[axis], other.high[axis]) - max(self.low[axis], other.low[axis])) / (min(self.span(axis), other.span(axis)) or 1)

    def gap(self, other: _Box, axis: int) -> float:
        return max(other.low[axis] - self.high[axis], self.low[axis] - other.high[axis])

    def same(self, other: _Box) -> bool:
        """Boxes with numbers of their own are equations of their own."""
        return self.page == other.page and not (self.number and other.number and self.number != other.number)

    def take(self, other: _Box) -> None:
        self.low, self.high = [min(p) for p in zip(self.low, other.low)], [max(p) for p in zip(self.high, other.high)]
        self.text, self.number, self.only = " ".join(filter(None, (self.text, other.text))), self.number or other.number, self.only and other.only


def _merged(boxes: list[_Box], wide: float, high: float) -> list[_Box]:
    for _ in range(3):
        before = len(boxes)
        rows: list[_Box] = []
        for box in sorted(boxes, key=lambda b: (b.page, b.low[1], b.low[0])):  # side by side: any earlier box of the row
            home = next((r for r in rows if r.same(box) and r.shared(box, 1) > 0.5 and r.gap(box, 0) <= wide), None)
            home.take(box) if home else rows.append(box)
        boxes = []
        for box in sorted(rows, key=lambda b: (b.page, b.low[1])):  # one above the other: only the last box
            last = boxes[-1] if boxes else None
            if last and last.same(box) and box.low[1] - last.high[1] <= high and last.shared(box, 0) > 0.3:
                last.take(box)
            else:
                boxes.append(box)
        if len(boxes) == before:
            break
    return [b for b in boxes if not b.only and (b.number or len(b.text) >= 3 and re.search(OPERATORS, b.text))]


def merged_equations(boxes: DataFrame, wide: float = 140.0, high: float = 12.0) -> DataFrame:
    """doc_id, page, number, text and box of the equations made of boxes side by side (wide points apart at most, half of
    their height shared) or stacked (high points, three tenths of their width), in three passes at most. Numbers without a
    formula, and bits without number or operator, are left out."""

    names = ["block", "number", "text", "only_number", "x0", "y0", "x1", "y1"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc, page, rows in zip(*(batch.column(n).to_pylist() for n in ("doc_id", "page", "_rows")), strict=True):
                given = sorted(({**r, "page": page} for r in rows), key=lambda r: (r["y0"], r["block"]))
                out += [(doc, b.page, b.number, b.text, *b.low, *b.high) for b in _merged([_Box(r) for r in given], wide, high)]
            yield pa.RecordBatch.from_pylist([dict(zip(made.names, r, strict=True)) for r in out], schema=made)

    made = pa.schema([("doc_id", pa.int64()), ("page", pa.int32()), ("number", pa.string()), ("text", pa.string()), *[(n, pa.float64()) for n in ("x0", "y0", "x1", "y1")]])
    listed = boxes.groupBy(F.col("doc_id").cast("long").alias("doc_id"), F.col("page").cast("int").alias("page")).agg(F.collect_list(F.struct(*names)).alias("_rows"))
    return listed.mapInArrow(run, "doc_id long, page int, number string, text string, x0 double, y0 double, x1 double, y1 double")
