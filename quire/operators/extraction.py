"""Extraction rules over lines and paragraphs: names, labelled dates, notes, labels called in text, grids and votes."""

from __future__ import annotations

import io
import zipfile

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quire.functions import tables
from quire.functions.text import fold, normal_key, parse_date

# Words that a line of names doesn't hold.
NOT_NAMES = "universidade university universidad instituto faculdade departamento resumo abstract revista journal doi http www issn orcid"


def name_score(text: Column, small: Column) -> Column:
    """0 for lines that aren't person names; else 1, 2 more for a marker, 1 more in small type. All capitals need a marker."""
    marker = text.rlike(r"[¹²³⁴-⁹⁰*†‡]|\d$")
    bare = F.trim(F.regexp_replace(text, r"[¹²³⁴-⁹⁰*†‡\d]+", ""))
    parts = F.split(bare, r"\s*(?:,|;| e | and | y )\s*")
    shaped = F.forall(parts, lambda p: p.rlike(r"^\p{Lu}[\p{L}.'’-]*(?: (?:\p{Lu}[\p{L}.'’-]*|d[aeo]s?|e|del?|v[ao]n|la)){1,6}$"))
    stop = F.exists(F.split(normal_key(text), " "), lambda w: w.isin(*NOT_NAMES.split()))
    fits = (F.length(text) <= 80) & F.size(parts).between(1, 6) & shaped & ~stop & ((bare != F.upper(bare)) | marker)
    return F.when(fits, 1 + 2 * marker.cast("int") + small.cast("int")).otherwise(0)


def labelled_dates(lines: DataFrame, this_year: int) -> DataFrame:
    """The first date of each kind and document: within 40 characters after its label, else in the next line."""
    order = Window.partitionBy("doc_id").orderBy("line_no")
    kinds = {"received": r"(?i)\b(?:recebido|received|recibido|submetido|submitted)\b", "revised": r"(?i)\b(?:revisado|revisada|revised|revisi[óo]n)\b", "accepted": r"(?i)\b(?:aceit[oa]|accepted|aceptado|aprovad[oa]|approved)\b", "published": r"(?i)\b(?:publicado|published)\b"}
    rows = lines.withColumn("_next", F.lead("text").over(order)).where(~F.col("text").rlike(r"(?i)\b(acesso|accessed|acessado)\b"))
    each = []
    for kind, label in kinds.items():
        after = F.substring(F.regexp_extract("text", label + "(.*)$", 1), 1, 40)
        each.append(F.when(F.col("text").rlike(label), F.struct(F.lit(kind).alias("kind"), F.coalesce(parse_date(after, this_year), parse_date(F.col("_next"), this_year)).alias("date"))))
    found = rows.select("doc_id", "line_no", F.explode(F.array_compact(F.array(*each))).alias("x")).where("x.date is not null")
    return found.groupBy("doc_id", "x.kind").agg(F.min_by("x.date", "line_no").alias("date"))


def called(labels: DataFrame, bodies: DataFrame, words: str) -> DataFrame:
    """labels (doc_id, number) with called: whether a body text of the document mentions that number of the kind (words is
    an alternation). Mentions are extracted once and semi-joined, so no label scans a text."""
    mention = rf"(?i)\b(?:{words})\.?\s*(\d+)"
    said = bodies.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(mention), F.lit(1))).alias("_n")).select("doc_id", F.col("_n").cast("long").alias("number")).distinct().withColumn("_said", F.lit(True))
    return labels.join(said, ["doc_id", "number"], "left").withColumn("called", F.coalesce("_said", F.lit(False))).drop("_said")


def hanging_indent(lines: DataFrame, least_length: int = 60) -> DataFrame:
    """Whether each document's entries hang: 8 lines or more, a fifth to three fifths at the left (within 2.5 pt), 30 %
    indented by 4 to 40 pt, and, if the lines have a text, entries cut so of least_length characters on average."""
    left = Window.partitionBy("doc_id")
    off = F.col("x0") - F.min("x0").over(left)
    at_left = (F.col("_off") <= 2.5).cast("int")
    length = F.sum(F.length("text")) + F.count(F.lit(1)) - F.sum(at_left) if "text" in lines.columns else F.sum(at_left) * least_length
    sums = lines.withColumn("_off", off).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.avg(at_left).alias("_left"), F.avg(F.col("_off").between(4, 40).cast("int")).alias("_in"), (length / F.sum(at_left)).alias("_mean"))
    return sums.select("doc_id", ((F.col("n") >= 8) & F.col("_left").between(0.2, 0.6) & (F.col("_in") >= 0.3) & (F.col("_mean") >= least_length)).alias("hanging"))


def numbered_list(lines: DataFrame) -> DataFrame:
    """Whether numbers that open lines run from 1: at least four in order, and 60 % of those awaited."""
    number = F.nullif(F.regexp_extract("text", r"^\s*\[?(\d{1,3})[\].)]\s*(?=\p{Lu})", 1), F.lit("")).cast("int")
    seen = lines.withColumn("_n", number).where("_n is not null").groupBy("doc_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("line_no", "_n"))), lambda s: s["_n"]).alias("_s"))
    run = F.aggregate("_s", F.lit(0), lambda a, n: F.when(n == a + 1, n).otherwise(a))
    return seen.select("doc_id", run.alias("in_order"), ((run >= 4) & (run >= 0.6 * (run + 1))).alias("numbered"))


def style_vote(entries: DataFrame, numbered: DataFrame | None = None) -> DataFrame:
    """ABNT or APA if 60 % of a document's entries look so, else mixed; numeric if its list is (numbered: doc_id, numbered)."""
    abnt = F.col("text").rlike(r"^\p{Lu}[\p{Lu}'’-]+(?: \p{Lu}[\p{Lu}'’-]+)*\s*[,.:]\s")
    apa = ~abnt & F.col("text").rlike(r"^\p{Lu}[\p{Ll}'’-]+(?:,?\s+\p{Lu}\.)+")
    votes = entries.groupBy("doc_id").agg(F.avg(abnt.cast("int")).alias("a"), F.avg(apa.cast("int")).alias("p"))
    style = F.when(F.col("a") >= 0.6, "ABNT").when(F.col("p") >= 0.6, "APA").otherwise("mixed")
    if numbered is not None:
        votes = votes.join(numbered.select("doc_id", "numbered"), "doc_id", "left")
        style = F.when(F.col("numbered"), "numeric").otherwise(style)
    return votes.select("doc_id", style.alias("style"))


def first_heading(paras: DataFrame, intro: Column, page_limit: int = 5) -> DataFrame:
    """The first paragraph that opens the body: an introduction-like title on an early page, else the first title from page
    2 on. paras: doc_id, para_no, page, is_title."""
    early, later = F.when(intro & (F.col("page") <= page_limit), F.col("para_no")), F.when(F.col("is_title") & (F.col("page") >= 2), F.col("para_no"))
    return paras.groupBy("doc_id").agg(F.coalesce(F.min(early), F.min(later)).alias("first"))


def references_heading(paras: DataFrame, first: DataFrame | None = None) -> DataFrame:
    """The last paragraph that is a title of the reference list, at or after first (doc_id, first), the body's first
    heading, if that is given and known."""
    title = F.length(F.trim("text")) <= 40
    named = F.rtrim(F.lower(fold(F.regexp_replace(F.trim("text"), r"\s+", " "))), F.lit(" :.")).isin(*tables.REFERENCE_TITLES)
    rows = paras.where(title & named)
    if first is not None:
        rows = rows.join(first.select("doc_id", "first"), "doc_id", "left").where(F.col("first").isNull() | (F.col("para_no") >= F.col("first")))
    return rows.groupBy("doc_id").agg(F.max("para_no").alias("para_no"))


def grid(text: Column) -> Column:
    """A table typed as text (| or tab between cells) as rows of equal width."""
    rows = F.transform(F.filter(F.split(text, "\n"), lambda r: F.trim(r) != ""), lambda r: F.transform(F.split(r, r"\s*\|\s*|\t"), lambda c: F.trim(c)))
    wide = F.array_max(F.transform(rows, lambda r: F.size(r)))
    return F.transform(rows, lambda r: F.concat(r, F.array_repeat(F.lit(""), wide - F.size(r))))


def grid_quality(cells: Column) -> Column:
    """none for a grid under 2 x 2 or with fewer than 4 filled cells, low if over a quarter of these hold two numbers or the
    body is empty, else medium."""
    flat = F.filter(F.flatten(cells), lambda c: c != "")
    two = F.filter(flat, lambda c: c.rlike(r"\d\S*\s+\S*\d"))
    body = F.filter(F.flatten(F.slice(cells, F.lit(2), F.greatest(F.size(cells), F.lit(1)))), lambda c: c != "")
    small = (F.size(cells) < 2) | (F.size(cells[0]) < 2) | (F.size(flat) < 4)
    return F.when(small, "none").when((F.size(two) > 0.25 * F.size(flat)) | (F.size(body) == 0), "low").otherwise("medium")


def turns(lines: DataFrame) -> DataFrame:
    """Dialogue lines ('Name: text', continuation lines) as turns with speaker and text."""
    order = Window.partitionBy("doc_id").orderBy("line_no")
    flagged = lines.withColumn("_who", F.nullif(F.regexp_extract("text", r"^(\p{Lu}[^:]{0,40}):\s", 1), F.lit("")))
    flagged = flagged.withColumn("turn_no", F.count("_who").over(order)).where("turn_no > 0")
    said = F.transform(F.sort_array(F.collect_list(F.struct("line_no", "text"))), lambda s: s["text"])
    return flagged.groupBy("doc_id", "turn_no").agg(F.max("_who").alias("speaker"), F.regexp_replace(F.array_join(said, " "), r"^[^:]{1,41}:\s+", "").alias("said"))


def page_characters(lines: DataFrame, least: int = 40) -> DataFrame:
    """Whether a document is scanned: fewer than least characters a page."""
    return lines.groupBy("doc_id").agg((F.sum(F.length("text")) / F.countDistinct("page") < least).alias("scanned"))


def zipped(files: DataFrame) -> DataFrame:
    """package and content: a zip of each package's files (package, path, content), in order of path, with fixed times, so
    that a run repeated after a lost executor gives the same bytes. A package holds a few files by rule."""

    def build(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            for path, content in sorted(zip(rows["path"], rows["content"], strict=True)):
                z.writestr(zipfile.ZipInfo(path, (1980, 1, 1, 0, 0, 0)), bytes(content))
        return pd.DataFrame({"package": [key[0]], "content": [out.getvalue()]})

    return files.select("package", "path", "content").groupBy("package").applyInPandas(build, "package string, content binary")


def html_report(checks: DataFrame) -> DataFrame:
    """One HTML report for each package from its checklist (package, item, ok)."""
    from .xml import escape

    row = F.concat(F.lit("<tr><td>"), escape(F.col("item")), F.lit("</td><td>"), F.when(F.col("ok"), "ok").otherwise("missing"), F.lit("</td></tr>"))
    rows = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("item", row.alias("row")))), lambda s: s["row"]), "")
    return checks.groupBy("package").agg(F.concat(F.lit("<!DOCTYPE html><table>"), rows, F.lit("</table>")).alias("html"))
