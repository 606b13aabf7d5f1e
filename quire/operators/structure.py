"""The structure that a word processor's file declares: sections by heading styles, and the tables, formulas and images that
stand in them.

Everything is a window over the elements of one file (sources.docx.elements), so they are laid out by path once and neither
joined nor parsed again. What a file holds is taken to be bounded; how many files there are isn't.

Defined results: a file without sections gives its tables, formulas and images with a null section; a damaged file gives
nothing here (its error is an element); an image whose relation or medium is missing is none; equal lines stay apart by
their number; an empty table gives no rows.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quire.functions.text import fold

from .body import source_line

# Words of captions, beginnings of headings that open no section, accents folded.
TABLE_WORDS = ("tabela", "table", "tabla")
FIGURE_WORDS = ("figura", "fig", "fig.", "grafico", "imagem", "foto", "quadro")
REFERENCE_WORDS = ("referencia", "referencias", "references", "bibliografia", "bibliography")
ABSTRACT_WORDS = ("resumo", "abstract", "resumen", "palavras chave", "palavras-chave", "keywords")
#: A line that is in a file so often is a running head, if it has between 4 and 129 characters.
HEAD_TIMES = 3
#: Captions stand among so many lines from an element on, else among so many before it; a source so many after its caption.
AHEAD, BACK, SOURCE = 4, 3, 3
#: A heading before the abstract is the title if it is longer than this.
SHORT_TITLE = 15


def _begins(low: Column, words: tuple[str, ...], then: str = "") -> Column:
    """Whether a folded text begins with one of some whole words (and then with what a pattern says)."""
    return low.rlike(f"^(?:{'|'.join(map(re.escape, words))})(?![a-z0-9_])" + then)


def labelled(text: Column) -> Column:
    """struct(kind, number, label, caption) of a line that begins with a word of captions and a number of up to three digits;
    null for others."""
    parts = r"^\s*(\p{L}+\.?)\s*([0-9]{1,3})(?![\p{L}0-9_])[\s.:–-]*(.*)$"
    word, number, rest = (F.regexp_extract(text, parts, i) for i in (1, 2, 3))
    low = F.lower(fold(word))
    kind = F.when(low.isin(*TABLE_WORDS), "table").when(low.isin(*FIGURE_WORDS), "figure")
    label = F.concat(F.upper(F.left(word, F.lit(1))), F.lower(F.substring(word, F.lit(2), F.length(word))), F.lit(" "), number)
    # few lines do, and the rest is dear
    return F.when(text.rlike(parts) & kind.isNotNull(), F.struct(kind.alias("kind"), number.alias("number"), label.alias("label"), F.trim(rest).alias("caption")))


def numbered_title(title: Column) -> tuple[Column, Column]:
    """Number (null if none) and text of a section's title."""
    number = F.regexp_extract(title, r"^[0-9]+(\.[0-9]+)*", 0)
    tail = F.substring(title, F.length(number) + 1, F.length(title))
    text = F.regexp_replace(tail, r"^[.)\s]+", "")
    has = (number != "") & tail.rlike(r"^[.)\s]") & (text != "")
    return F.when(has, number), F.when(has, text).otherwise(title)


def _with_media(rows: DataFrame) -> DataFrame:
    """rows with medium: the name of the part that an image's relation leads to, by its whole name, else by its last step."""
    of = lambda *keys: Window.partitionBy("path", *keys)
    is_medium = F.col("kind") == "medium"
    rows = rows.withColumn("_target", F.when(F.col("kind") == "image", F.max(F.when(F.col("kind") == "relation", F.col("target"))).over(of("rel_id"))).when(is_medium, F.col("target")))
    plain = F.regexp_replace(F.regexp_replace("_target", r"\.\./", ""), "^/", "")
    rows = rows.withColumn("_name", F.when(plain.startswith("word/"), plain).otherwise(F.concat(F.lit("word/"), plain))).withColumn("_base", F.concat(F.lit("word/media/"), F.substring_index("_target", "/", -1)))
    there = lambda key, name: F.max(F.when(is_medium, F.col("target"))).over(of(name))
    rows = rows.withColumn("_whole", there("_target", "_name"))
    # a medium deeper in the folder isn't found by its last step
    direct = F.when(is_medium & (F.col("target") == F.col("_base")), F.col("target"))
    rows = rows.withColumn("_last", F.max(direct).over(of("_base")))
    return rows.withColumn("medium", F.when(F.col("kind") == "image", F.coalesce("_whole", "_last"))).drop("_target", "_name", "_base", "_whole", "_last")


def _with_sections(rows: DataFrame) -> DataFrame:
    """rows with is_section, is_title, in_body, section_no, and para_pos: the body lines between a row and its section's heading.

    What stands just before a heading, with no line between them, belongs to the heading's section."""
    doc = Window.partitionBy("path")
    upto = doc.orderBy("line_no").rangeBetween(Window.unboundedPreceding, 0)
    before = doc.orderBy("line_no").rangeBetween(Window.unboundedPreceding, -1)
    is_line = F.col("kind").isin("line", "note")
    times = F.sum((F.col("kind") == "line").cast("int")).over(Window.partitionBy("path", "text"))
    rows = rows.withColumn("in_body", (F.col("kind") == "line") & ~((times >= HEAD_TIMES) & F.length("text").between(4, 129)))
    heading = is_line & (F.col("level") >= 1)
    # columns of their own: what they say is asked for by several windows
    rows = rows.withColumn("_low", F.when(is_line, F.lower(fold(F.col("text")))))
    rows = rows.withColumns({"_is_end": heading & _begins(F.col("_low"), REFERENCE_WORDS), "_is_abstract": heading & _begins(F.col("_low"), ABSTRACT_WORDS), "_says_abstract": F.col("in_body") & _begins(F.col("_low"), ABSTRACT_WORDS, r"\s*[:.]")})
    is_end, is_abstract, labelled_abstract = (F.col(n) for n in ("_is_end", "_is_abstract", "_says_abstract"))
    least = lambda which: F.min(F.when(which, F.col("line_no"))).over(doc)
    rows = rows.withColumn("_end", least(is_end)).withColumn("_abstract", F.coalesce(least(heading & is_abstract), least(labelled_abstract)))
    open_ = heading & ~is_end & ~is_abstract & (F.col("_end").isNull() | (F.col("line_no") < F.col("_end")))
    early = F.coalesce(F.col("line_no") < F.col("_abstract"), F.lit(False))
    rows = rows.withColumn("is_section", F.coalesce(open_ & ~early, F.lit(False))).withColumn("_early", F.coalesce(open_ & early, F.lit(False)))
    last_early = F.max(F.when(F.col("_early"), F.col("line_no"))).over(doc)
    rows = rows.withColumn("is_title", F.col("_early") & (F.col("line_no") == last_early) & (F.length(F.trim("text")) > SHORT_TITLE)).drop("_early")
    rows = rows.withColumn("section_no", F.nullif(F.sum(F.col("is_section").cast("int")).over(upto), F.lit(0))).withColumn("_before", F.coalesce(F.sum(F.col("in_body").cast("int")).over(before), F.lit(0)))
    through = F.when(F.col("is_section"), F.col("_before") + F.col("in_body").cast("int"))
    rows = rows.withColumn("para_pos", F.when(F.col("section_no").isNull(), 0).otherwise(F.greatest(F.col("_before") - F.max(through).over(upto), F.lit(0))))
    in_section = F.col("in_body") & ~F.col("is_section") & F.col("section_no").isNotNull() & (F.col("_end").isNull() | (F.col("line_no") < F.col("_end")))
    return rows.withColumn("in_section", in_section).drop("_before", "_end", "_abstract", "_low", "_is_end", "_is_abstract", "_says_abstract")


def _with_captions(rows: DataFrame) -> DataFrame:
    """rows with found: struct(at, number, label, caption, source) of a table's or an image's caption."""
    near = lambda a, b: Window.partitionBy("path").orderBy("line_no").rangeBetween(a, b)
    is_line = F.col("kind").isin("line", "note")
    said = F.when(is_line, source_line(F.col("text")))
    rows = rows.withColumn("_own", F.when(is_line, labelled(F.col("text")))).withColumn("_said", said)
    rows = rows.withColumn("_source", F.min(F.when(F.col("_said").isNotNull(), F.struct("line_no", F.col("_said").alias("said")))).over(near(1, SOURCE))["said"])
    made = F.struct(F.col("line_no").alias("at"), F.col("_own.number").alias("number"), F.col("_own.label").alias("label"), F.col("_own.caption").alias("caption"), F.col("_source").alias("source"))
    for kind in ("table", "figure"):
        mine = F.when(F.col("_own.kind") == kind, made)
        rows = rows.withColumn(f"_{kind}", F.coalesce(F.min(mine).over(near(0, AHEAD - 1)), F.min(mine).over(near(-BACK, -1))))
    return rows.withColumn("found", F.when(F.col("kind") == "table", F.col("_table")).when(F.col("kind") == "image", F.col("_figure"))).drop("_source", "_table", "_figure")


def _with_mentions(rows: DataFrame) -> DataFrame:
    """rows with called: whether a paragraph of a section speaks of the table or figure by its number."""
    paragraph = F.col("in_section") & F.col("_own").isNull() & F.col("_said").isNull()
    rows = rows.withColumn("is_paragraph", F.coalesce(paragraph, F.lit(False)))
    spoken = F.regexp_extract_all(F.lower("text"), F.lit(r"((?:tabela|figura)\s*[0-9]{1,3})(?![\p{L}0-9_])"), F.lit(1))
    keys = F.when(F.col("is_paragraph"), F.array_distinct(F.transform(spoken, lambda x: F.regexp_replace(x, r"\s+", "")))).otherwise(F.array().cast("array<string>"))
    rows = rows.withColumn("_spoken", F.explode(F.concat(F.array(F.lit(None).cast("string")), keys)))
    own = F.concat(F.when(F.col("kind") == "table", "tabela").when(F.col("kind") == "image", "figura"), F.col("found.number"))
    rows = rows.withColumn("_key", F.coalesce("_spoken", own))
    rows = rows.withColumn("called", F.max(F.col("_spoken").isNotNull()).over(Window.partitionBy("path", "_key")) & own.isNotNull())
    return rows.where("_spoken IS NULL").drop("_spoken", "_key")


def declared(elements: DataFrame) -> DataFrame:
    """path, kind (title, section, paragraph, table, formula, figure, loose image), no (from 1 within the kind), section_no,
    para_pos, level, number, label, text (title, paragraph or caption), source, called, file, medium, mathml, n_rows, n_cols,
    header_rows. elements: as of sources.docx.elements. An image without a caption is loose and gets no file name."""
    spark = elements.sparkSession
    # by number: elements are small, so Spark would merge them into few tasks
    rows = _with_media(elements.repartition(max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), "path"))
    rows = rows.where(F.col("kind").isin("line", "note", "table", "formula") | F.col("medium").isNotNull())
    rows = _with_mentions(_with_captions(_with_sections(rows)))
    kind = (
        F.when(F.col("is_title"), "title").when(F.col("is_section"), "section").when(F.col("is_paragraph"), "paragraph")
        .when(F.col("kind") == "image", F.when(F.col("found").isNull(), "loose image").otherwise("figure")).when(F.col("kind").isin("table", "formula"), F.col("kind"))
    )
    rows = rows.withColumn("_kind", kind).where("_kind IS NOT NULL")
    rows = rows.withColumn("no", F.row_number().over(Window.partitionBy("path", "_kind").orderBy("seq")))
    number, title = numbered_title(F.trim("text"))
    heads, is_figure = F.col("_kind").isin("title", "section"), F.col("_kind") == "figure"
    ending = F.lower(F.regexp_extract("medium", r"\.([^./]+)$", 1))
    file = F.concat(F.lit("fig"), F.when(F.col("no") < 10, F.concat(F.lit("0"), F.col("no").cast("string"))).otherwise(F.col("no").cast("string")), F.lit("."), F.when(ending == "", "png").otherwise(ending))
    formula = F.when(F.col("_kind") == "formula", F.col("no").cast("string"))
    return rows.select(
        "path", F.col("_kind").alias("kind"), "no", F.when(F.col("_kind") != "title", F.col("section_no")).alias("section_no"), F.when(~heads, F.col("para_pos")).alias("para_pos"),
        F.when(heads, F.col("level")).alias("level"), F.coalesce(F.when(F.col("_kind") == "section", number), F.col("found.number"), formula).alias("number"),
        F.coalesce(F.col("found.label"), F.when(formula.isNotNull(), F.concat(F.lit("("), formula, F.lit(")")))).alias("label"),
        F.when(F.col("_kind") == "section", title).when(F.col("_kind") == "title", F.trim("text")).when(F.col("_kind") == "paragraph", F.col("text")).otherwise(F.col("found.caption")).alias("text"),
        F.col("found.source").alias("source"), F.when(F.col("_kind").isin("table", "figure"), F.col("called")).alias("called"), F.when(is_figure, file).alias("file"), "medium", "mathml",
        F.when(F.col("_kind") == "table", F.size("cells")).alias("n_rows"), F.when(F.col("_kind") == "table", F.size(F.col("cells")[0])).alias("n_cols"), "header_rows",
    )
