"""Layout operators over positioned lines: statistics, repeated headings, zones, paragraphs and sections.

Lines are rows of doc_id, page, line_no (reading order within the document), text and their geometry: size, x0, y0, x1, y1,
bold, italic, block, rotated.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quire.functions.shared import many
from quire.functions.text import join_lines, repetition_key


def weighted_mode(df: DataFrame, keys: list[str], value: str, weight: Column, seq: str, name: str) -> DataFrame:
    """The value of the largest total weight by keys; ties go to the value seen first."""
    totals = df.groupBy(*keys, value).agg(F.sum(weight).alias("_w"), F.min(seq).alias("_first"))
    return totals.groupBy(*keys).agg(F.max_by(value, F.struct("_w", -F.col("_first"))).alias(name))


def body_size(lines: DataFrame) -> DataFrame:
    """Each document's body size: that with most characters among lines of 6 points or more; 10.0 if there are none."""
    found = weighted_mode(lines.where("size >= 6"), ["doc_id"], "size", F.length("text"), "line_no", "body_size")
    return lines.select("doc_id").distinct().join(many(found), "doc_id", "left").fillna(10.0, ["body_size"])


def repeated_lines(lines: DataFrame, share: float = 0.4) -> DataFrame:
    """Keys that stand on at least max(2, round-half-even(share * pages)) pages of a document, with their first text."""
    pages = lines.groupBy("doc_id").agg(F.countDistinct("page").alias("n_pages"))
    keyed = lines.select("doc_id", "page", "line_no", "text", repetition_key(F.col("text")).alias("key")).where(F.length("key") >= 4)
    found = keyed.groupBy("doc_id", "key").agg(F.countDistinct("page").alias("pages"), F.min_by("text", F.struct("page", "line_no")).alias("example"))
    enough = F.col("pages") >= F.greatest(F.lit(2), F.bround(F.col("n_pages") * F.lit(share)))
    return found.join(many(pages), "doc_id").where(enough).select("doc_id", "key", "pages", "example")


def main_margin(lines: DataFrame) -> DataFrame:
    """The commonest rounded left edge of each page, ties to the one seen first."""
    return weighted_mode(lines.withColumn("_x", F.bround("x0")), ["doc_id", "page"], "_x", F.lit(1), "line_no", "col_left")


def two_columns(lines: DataFrame, width: float) -> DataFrame:
    """Whether more than a fifth of the body-size lines after page 1 are narrow and on the right."""
    sized = lines.join(many(body_size(lines)), "doc_id").where((F.col("page") != 1) & (F.abs(F.col("size") - F.col("body_size")) <= 1))
    narrow = (F.col("x1") - F.col("x0") < 0.5 * width) & (F.col("x0") > 0.45 * width)
    return sized.groupBy("doc_id").agg((F.avg(narrow.cast("int")) > 0.2).alias("two_columns"))


def zones(lines: DataFrame, height: float) -> DataFrame:
    """zone of each line by ordered rules: rotated text is margin; repeated text at an edge or in small type is header or
    footer by half of the page; a page number at the very edge is footer; the rest is body."""
    repeated = repeated_lines(lines).select("doc_id", F.col("key").alias("_key"), F.lit(True).alias("_repeated"))
    all_ = lines.withColumn("_key", repetition_key(F.col("text"))).join(many(repeated), ["doc_id", "_key"], "left").join(many(body_size(lines)), "doc_id")
    edge = (F.col("y0") < 0.15 * height) | (F.col("y1") > 0.85 * height) | (F.col("size") < F.col("body_size") * 0.85)
    number = F.col("text").rlike(r"^(\d{1,4}|\d{1,4}\s*[|•·]\s*.{0,70}|.{0,70}\s*[|•·]\s*\d{1,4})$") & ((F.col("y0") < 0.12 * height) | (F.col("y1") > 0.88 * height))
    zone = F.when(F.col("rotated"), "margin").when(F.col("_repeated") & edge, F.when(F.col("y0") < height / 2, "header").otherwise("footer")).when(number, "footer").otherwise("body")
    return all_.withColumn("zone", zone).drop("_key", "_repeated", "body_size")


TERMINAL = r"[.!?:;”\")…\]]\s*$"


def paragraph_numbers(lines: DataFrame, col_left: Column) -> DataFrame:
    """para_no of each line: a new paragraph starts at a change of style, a wide gap, an indent after a full stop, or a
    new block after a full stop, indent or gap. Gaps and islands: flags by lag(), then a running sum."""
    order = Window.partitionBy("doc_id", "page").orderBy("line_no")
    was = lambda c: F.lag(c).over(order)
    style = (F.abs(F.col("size") - was("size")) > 0.6) | (F.col("bold") != was("bold")) | (F.col("italic") != was("italic"))
    gap = F.col("y0") - was("y1")
    terminal = was("text").rlike(TERMINAL)
    indent = (F.col("x0") > col_left + 6) & (was("x0") <= col_left + 6)
    block = F.col("block") != was("block")
    new = style | (gap > 1.6 * F.col("size")) | (indent & terminal) | (block & (terminal | indent | (gap > 1.1 * F.col("size"))))
    flagged = lines.withColumn("_new", F.coalesce(new, F.lit(True)).cast("int"))
    return flagged.withColumn("para_no", F.sum("_new").over(order)).drop("_new")


def paragraphs(numbered: DataFrame) -> DataFrame:
    """One row per paragraph: its text, lines, majority style and box."""
    texts = F.transform(F.sort_array(F.collect_list(F.struct("line_no", "text"))), lambda x: x["text"])
    return numbered.groupBy("doc_id", "page", "para_no").agg(
        join_lines(texts).alias("text"), F.count(F.lit(1)).alias("n_lines"), (F.avg(F.col("bold").cast("int")) > 0.5).alias("bold"),
        F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"),
    )


def sections(paras: DataFrame, is_title: Column, level: Column) -> DataFrame:
    """section_no, title and level of each paragraph after the first title; a level not given is that of the title before."""
    order = Window.partitionBy("doc_id").orderBy("para_no")
    flagged = paras.withColumn("_title", is_title).withColumn("section_no", F.sum(F.col("_title").cast("int")).over(order)).where("section_no > 0")
    return (
        flagged.withColumn("title", F.last(F.when(F.col("_title"), F.col("text")), ignorenulls=True).over(order))
        .withColumn("level", F.coalesce(F.last(F.when(F.col("_title"), level), ignorenulls=True).over(order), F.lit(1)))
        .drop("_title")
    )


def section_parents(heads: DataFrame, deepest: int = 9) -> DataFrame:
    """parent_no of each section: the latest earlier one of a smaller level, that is the greatest of the last seen numbers
    of the levels above its own."""
    order = Window.partitionBy("doc_id").orderBy("section_no").rowsBetween(Window.unboundedPreceding, -1)
    seen = [F.when(F.col("level") > n, F.last(F.when(F.col("level") == n, F.col("section_no")), ignorenulls=True).over(order)) for n in range(1, deepest)]
    return heads.select("doc_id", "section_no", "level", F.greatest(*seen).alias("parent_no"))


def numbering_gaps(numbered: DataFrame, keys: list[str], number: str) -> DataFrame:
    """The numbers missing between the least and the greatest, by keys."""
    seen = numbered.groupBy(*keys).agg(F.min(number).alias("_low"), F.max(number).alias("_high"), F.collect_set(number).alias("_seen"))
    return seen.select(*keys, F.array_except(F.sequence("_low", "_high"), "_seen").alias("missing"))
