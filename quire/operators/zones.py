"""Zones of page lines beyond edges and repetition: sidebars, footnotes, and fragments of one row.

Windows and folds are by page, so no task holds more than the lines of a page at a time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quire.functions.shared import many

from .layout import body_size, weighted_mode

# Names of tags that a box of labels prints.
BOX_LABELS = ("contrib", "aff", "abstract", "sec", "ref", "article-title", "trans-title", "kwd", "kwd-group", "fn", "title", "body", "back", "front")
MARK = r"\d{1,3}|\*{1,4}|[¹²³⁴⁵⁶⁷⁸⁹⁰]+|[†‡§]"
#: A number before its text isn't the start of a range, a share or an ordinal.
OPENING = r"\d{1,3}(?![\d\-–/,)%º°])\.?|\*{1,4}|[¹²³⁴⁵⁶⁷⁸⁹⁰]+|[†‡]"
PAGE = ["doc_id", "page"]


def box_label(text: Column, size: Column) -> Column:
    """Whether a line is a printed tag name in tiny type."""
    return (size <= 7.6) & (F.lower(text).isin(*BOX_LABELS) | text.rlike(r"(?i)^p\[\d+\]$"))


def lone_mark(text: Column) -> Column:
    return text.rlike(f"^(?:{MARK})$")


def note_start(text: Column, size: Column, body: Column, raised: Column) -> Column:
    """Whether a line may begin a footnote: small type, and a raised mark, a mark alone, or a mark before its text (a number
    before a small letter is none)."""
    rest = F.regexp_extract(text, rf"^\s*(?:{OPENING})\s*(.*)$", 1)
    digits = text.rlike(r"^\s*\d") & rest.rlike(r"^\p{Ll}")
    marked = text.rlike(rf"^\s*(?:{OPENING})\s*\S") & (rest != "") & ~digits
    return (size <= body * 0.9 + 0.05) & (raised | lone_mark(text) | marked)


def note_size(lines: DataFrame) -> DataFrame:
    """doc_id, note_size: the commonest size (to a tenth) of sure note starts: raised ones, or of 80 % of the body at most.
    lines: with body_size and raised."""
    sure = lines.where(note_start(F.col("text"), F.col("size"), F.col("body_size"), F.col("raised")) & (F.col("raised") | (F.col("size") <= F.col("body_size") * 0.8)))
    return weighted_mode(sure.withColumn("_size", F.round("size", 1)), ["doc_id"], "_size", F.lit(1), "line_no", "note_size")


def sidebars(lines: DataFrame, width: float, least: int = 5) -> DataFrame:
    """(doc_id, line_no) of sidebar lines: small, narrow, at the left but off the page's main margin, with text to their
    right at about their height; those whose left edges lie within 3 points of the next make a group, of least lines or more.
    lines: the body's, with body_size."""
    c = F.col
    main = weighted_mode(lines.where(c("size") >= c("body_size") * 0.9).withColumn("_x", F.bround("x0")), PAGE, "_x", F.lit(1), "line_no", "_main")
    edges = lines.groupBy(*PAGE).agg(F.min("x0").alias("_least"))
    rows = lines.join(many(edges), PAGE).join(many(main), PAGE, "left").withColumn("_main", F.coalesce("_main", "_least"))
    small = rows.where((c("size") <= c("body_size") * 0.85) & (c("x1") - c("x0") < 0.32 * width) & (c("x1") < 0.45 * width) & (F.abs(c("x0") - c("_main")) > 3))
    other = lines.select(*PAGE, c("line_no").alias("_other"), c("x0").alias("_x0"), c("y0").alias("_y0"), c("y1").alias("_y1"))
    beside = (c("_other") != c("line_no")) & (c("_x0") >= c("x1") + 5) & (F.least(c("y1") + 2 * c("size"), "_y1") > F.greatest(c("y0") - 2 * c("size"), "_y0"))
    found = small.join(many(other), PAGE).where(beside).select(*PAGE, "line_no", "x0").distinct()
    order = Window.partitionBy(*PAGE).orderBy("x0", "line_no")
    groups = found.withColumn("_new", F.coalesce((c("x0") - F.lag("x0").over(order) > 3), F.lit(True)).cast("int")).withColumn("_group", F.sum("_new").over(order))
    return groups.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(*PAGE, "_group"))).where(c("_n") >= least).select("doc_id", "line_no")


def indented_block(lines: DataFrame) -> DataFrame:
    """lines with block_indent: more than two body sizes right of the page's main margin, with nothing left of it at its
    height. lines: with body_size."""
    c = F.col
    main = weighted_mode(lines.where(c("size") >= c("body_size") * 0.9).withColumn("_x", F.bround("x0")), PAGE, "_x", F.lit(1), "line_no", "_main")
    rows = lines.join(many(main), PAGE, "left").withColumn("_far", F.coalesce(c("x0") > c("_main") + 2 * c("body_size"), F.lit(False)))
    other = lines.select(*PAGE, c("line_no").alias("_other"), c("x1").alias("_x1"), c("y0").alias("_y0"), c("y1").alias("_y1"))
    left = rows.where("_far").join(many(other), PAGE).where((c("_other") != c("line_no")) & (c("_x1") <= c("x0")) & (F.least("y1", "_y1") > F.greatest("y0", "_y0")))
    kept = left.select("doc_id", "line_no").distinct().withColumn("_left", F.lit(True))
    return rows.join(many(kept), ["doc_id", "line_no"], "left").withColumn("block_indent", c("_far") & c("_left").isNull()).drop("_main", "_far", "_left")


def footnotes(lines: DataFrame, height: float) -> DataFrame:
    """(doc_id, line_no) of the lines in footnotes. lines: the body's, with raised (a superscript opens the line).

    A start counts in the lower half of its page (or in tiny type) if only small lines follow; then small lines stay notes
    up to a larger one or a copyright line. Starts of another size than the document's notes, and indented blocks, don't
    count. The state is a fold over one page's lines.
    """
    c = F.col
    rows = lines.join(many(body_size(lines)), "doc_id")
    rows = indented_block(rows.join(many(note_size(rows)), "doc_id", "left"))
    small = (c("size") <= c("body_size") * 0.93 + 0.05) | c("text").startswith("©")
    order = Window.partitionBy(*PAGE).orderBy("y0", "x0", "line_no")
    rest = F.coalesce(F.bool_and(small).over(order.rowsBetween(1, Window.unboundedFollowing)), F.lit(True))
    large = c("size") > c("body_size") * 0.8
    other_size = c("note_size").isNotNull() & large & (F.abs(c("size") - c("note_size")) > 0.6) & ~c("raised")
    block = large & ~c("raised") & c("block_indent")
    starts = note_start(c("text"), c("size"), c("body_size"), c("raised")) & ((c("y0") > 0.5 * height) | (c("size") <= c("body_size") * 0.75)) & rest & ~other_size & ~block
    tiny = c("size") <= c("body_size") * 0.93 + 0.05
    flags = rows.withColumn("_kind", F.struct(starts.alias("starts"), tiny.alias("small"), c("text").startswith("©").alias("ends")))
    listed = flags.groupBy(*PAGE).agg(F.sort_array(F.collect_list(F.struct("y0", "x0", "line_no", c("_kind")))).alias("_l"))
    begin = F.struct(F.lit(False).alias("inside"), F.expr("cast(array() as array<bigint>)").alias("notes"))

    def add(acc: Column, x: Column) -> Column:
        stays = acc["inside"] & ~x["_kind"]["ends"] & x["_kind"]["small"]
        note = stays | x["_kind"]["starts"]
        return F.struct(note.alias("inside"), F.when(note, F.concat(acc["notes"], F.array(x["line_no"].cast("bigint")))).otherwise(acc["notes"]).alias("notes"))

    return listed.select("doc_id", F.explode(F.aggregate("_l", begin, add, lambda acc: acc["notes"])).alias("line_no"))


def merged_rows(lines: DataFrame) -> DataFrame:
    """doc_id, page, row_no (from 1), line_no (the first), text, x0, x1, y0, y1: fragments at one height, each close to the
    right end of what has been merged before it, as one row. The fold compares with the growing row."""
    c = F.col
    listed = lines.groupBy(*PAGE).agg(F.sort_array(F.collect_list(F.struct("line_no", "text", "size", "x0", "x1", "y0", "y1"))).alias("_l"))
    empty = F.expr("cast(array() as array<struct<line_no:bigint,text:string,size:double,x0:double,x1:double,y0:double,y1:double>>)")
    whole = lambda x: F.struct(x["line_no"].cast("bigint").alias("line_no"), x["text"].alias("text"), *[x[n].cast("double").alias(n) for n in ("size", "x0", "x1", "y0", "y1")])

    def add(acc: Column, x: Column) -> Column:
        last = F.try_element_at(acc, F.lit(-1))
        scale = F.greatest(x["size"], last["size"])
        gap = x["x0"] - last["x1"]
        joins = (F.abs(x["y0"] - last["y0"]) < 0.35 * scale) & gap.between(-3, 4 * scale)
        grown = F.struct(last["line_no"].alias("line_no"), F.trim(F.concat_ws(" ", last["text"], x["text"])).alias("text"), last["size"].alias("size"), last["x0"].alias("x0"), F.greatest(last["x1"], x["x1"]).cast("double").alias("x1"), last["y0"].alias("y0"), F.greatest(last["y1"], x["y1"]).cast("double").alias("y1"))
        return F.when(F.coalesce(joins, F.lit(False)), F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(grown))).otherwise(F.concat(acc, F.array(whole(x))))

    made = listed.select(*PAGE, F.posexplode(F.aggregate("_l", empty, add)).alias("row_no", "r"))
    return made.select(*PAGE, (c("row_no") + 1).alias("row_no"), "r.line_no", "r.text", "r.x0", "r.x1", "r.y0", "r.y1")


def page_number(lines: DataFrame, height: float) -> DataFrame:
    """(doc_id, line_no) of page numbers: a number at the very edge of a page without small text close to its right, which
    would make it the label of a note. lines: with body_size."""
    c = F.col
    bare = lines.where(c("text").rlike(r"^\d{1,4}$") & ((c("y0") < 0.12 * height) | (c("y1") > 0.88 * height)))
    other = lines.select(*PAGE, c("line_no").alias("_other"), c("size").alias("_size"), c("x0").alias("_x0"), c("y0").alias("_y0"), c("y1").alias("_y1"))
    tiny = bare.where(c("size") <= c("body_size") * 0.7)
    beside = (c("_other") != c("line_no")) & (c("_x0") >= c("x1") - 1) & (c("_x0") <= c("x1") + 3 * c("body_size")) & (c("_size") <= c("body_size") * 0.93 + 0.05) & (F.least("y1", "_y1") > F.greatest("y0", "_y0"))
    labels = tiny.join(many(other), PAGE).where(beside).select("doc_id", "line_no").distinct()
    return bare.select("doc_id", "line_no").join(many(labels), ["doc_id", "line_no"], "left_anti")
