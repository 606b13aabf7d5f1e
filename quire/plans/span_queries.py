"""Queries for spans, images, equations, links inside paragraphs and edits of list items."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.operators import overlay, spans, xml

from .front_queries import C, K, _orders, _rows
from .scalar_queries import _table

QUERIES, ORACLE_SQL = {}, {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def _each(spark, sf_dir, rows):
    return _table(spark, sf_dir, "orders").select(K().alias("doc_id"), F.explode(rows).alias("x")).select("doc_id", "x.*")


@query("""
SELECT o_orderkey AS doc_id, CAST(n AS INTEGER) AS line, [CASE WHEN o_orderkey % 2 = 0 THEN 'A word goes on' ELSE 'A word goes on more' END, '12'][n] AS text, [CASE WHEN o_orderkey % 2 = 0 THEN 'A word[^3] goes on' ELSE 'A word goes on more[^*]' END, '12'][n] AS marked, CASE WHEN n = 2 THEN '' WHEN o_orderkey % 2 = 0 THEN '1,3' ELSE 'long,*' END AS marks,
 CASE WHEN n = 1 AND o_orderkey % 2 = 0 THEN '1' WHEN n = 1 THEN 'long' ELSE '' END AS mark_first, CASE WHEN n = 1 AND o_orderkey % 2 = 1 THEN '*' ELSE '' END AS mark_last, [10.0::DOUBLE, 6.0][n] AS size, ['Serif', 'Small'][n] AS font, n = 1 AND o_orderkey % 2 = 1 AS bold, n = 2 AS rotated FROM orders, (SELECT unnest([1, 2]) AS n)
""")
def span_lines(spark, sf_dir):
    even = K() % 2 == 0
    rows = _rows(
        "line span_no text size font raised bold", (1, 1, F.when(even, "1").otherwise("long"), 6.0, "Small", True, False), (1, 2, "A word", 10.0, "Serif", False, False), (1, 3, F.when(even, " 3").otherwise(" "), 6.0, "Small", True, False), (1, 4, "  goes on", 10.04, "Serif", False, F.when(even, False).otherwise(True)),
        (1, 5, F.when(even, " ").otherwise(" more"), 9.0, "Other", False, True), (1, 6, F.when(even, " ").otherwise("*"), 6.0, "Small", True, False), (2, 1, "12", 6.0, "Small", True, False), (3, 1, "  ", 10.0, "Serif", False, False),
    )
    each = _each(spark, sf_dir, rows.cast("array<struct<line:int,span_no:int,text:string,size:double,font:string,raised:boolean,bold:boolean>>")).withColumns({"page": F.lit(1), "block": F.lit(1), "italic": F.lit(False)})
    boxes = each.select("doc_id", "page", "block", "line").distinct().withColumns({n: F.lit(1.0) for n in ("x0", "y0", "x1", "y1")}).withColumns({"dx": F.when(F.col("line") == 2, 0.0).otherwise(1.0), "dy": F.lit(0.0)})
    made = spans.lines_from_spans(each, boxes)
    return made.select("doc_id", "line", "text", "marked", F.array_join("marks", ",").alias("marks"), "mark_first", "mark_last", "size", "font", "bold", "rotated")


@query("SELECT o_orderkey AS doc_id, CAST(1 AS INTEGER) AS image_no FROM orders WHERE o_orderkey % 2 = 0")
def kept_images(spark, sf_dir):
    rows = _rows("image_no page x0 y0 x1 y1", (1, 1, 100.0, 100.0, 200.0, 200.0), (2, 1, 100.0, 100.0, 150.0, 300.0), (3, 1, 100.0, 0.0, 200.0, 62.0), (4, 1, 100.0, 805.0, 200.0, 900.0))
    scanned = _table(spark, sf_dir, "orders").where("o_orderkey % 2 = 1").select(K().alias("doc_id"), F.lit(1).alias("page"))
    return spans.kept_images(_each(spark, sf_dir, rows), 842.0, scanned).select("doc_id", "image_no")


# a formula of two stacked blocks with its number in a third; a second formula beside another number; text that ends with (9)
@query("""
SELECT o_orderkey AS doc_id, ['1', '2'][n] AS number, CASE n WHEN 1 THEN 'a = ' || o_custkey || ' + b' ELSE 'x = y' END AS text, [100.0::DOUBLE, 100.0][n] AS x0, [420.0::DOUBLE, 420.0][n] AS x1, [124.0::DOUBLE, 210.0][n] AS y1 FROM orders, (SELECT unnest([1, 2]) AS n)
""")
def page_equations(spark, sf_dir):
    rows = _rows(
        "block line_no text font x0 y0 x1 y1", (1, 1, F.concat(F.lit("a = "), C()), "CMMI10", 100.0, 100.0, 300.0, 112.0), (2, 2, "+ b", "CMSY10", 120.0, 114.0, 280.0, 124.0), (3, 3, "(1)", "Serif", 400.0, 101.0, 420.0, 111.0), (4, 4, "x = y", "Serif", 100.0, 200.0, 200.0, 210.0), (4, 5, "(2)", "Serif", 400.0, 200.0, 420.0, 210.0),
        (5, 6, "A paragraph of eight words that ends here with = and more words.", "Serif", 100.0, 300.0, 500.0, 310.0), (5, 7, "(9)", "Serif", 400.0, 312.0, 420.0, 320.0), (6, 8, "plain", "Serif", 100.0, 400.0, 200.0, 410.0), (7, 9, "(8)", "Serif", 400.0, 600.0, 420.0, 610.0), (8, 10, "k", "Symbol", 100.0, 700.0, 110.0, 710.0),
    )
    lines = _each(spark, sf_dir, rows).withColumns({"page": F.lit(1), "rotated": F.lit(False)})
    return spans.merged_equations(spans.equation_boxes(lines)).select("doc_id", "number", "text", "x0", "x1", "y1")


_SUP = '<xref ref-type="bibr" rid="B{0}"><sup>{1}</sup></xref>'


@query(f"""
SELECT o_orderkey AS doc_id, CAST(n AS INTEGER) AS para_no, CASE n WHEN 1 THEN 'See <xref ref-type="bibr" rid="B1">Silva (2010)</xref> &amp; Silva (2010), <xref ref-type="fig" rid="f1">Figura 1</xref> and Figura 12<xref ref-type="fn" rid="fn1"><sup>a</sup></xref>.'
 ELSE CASE WHEN o_orderkey % 2 = 0 THEN '{_SUP.format(1, 1)},{_SUP.format(3, 3)} x{_SUP.format(2, 2)}{_SUP.format(3, 3)}' ELSE '<sup>1,3</sup> x<sup>2-3</sup>' END || ' <xref ref-type="table" rid="t2">tabela 2</xref>, <xref ref-type="disp-formula" rid="e1">Eq. (4)</xref><sup>a</sup>' END AS marked FROM orders, (SELECT unnest([1, 2]) AS n)
""")
def linked_paragraphs(spark, sf_dir):
    o = _orders(spark, sf_dir)
    each = lambda rows: o.select(K().alias("doc_id"), F.explode(rows).alias("x")).select("doc_id", "x.*")
    paras = each(_rows("para_no text", (1, "See Silva (2010) & Silva (2010), Figura 1 and Figura 12[^a]."), (2, "[^1,3] x[^2-3] tabela 2, Eq. (4)[^a]")))
    cites = each(_rows("cit_no text rid", (1, "Silva (2010)", "B1"), (2, "Nobody (1999)", "B2")))
    things = each(_rows("kind number rid", ("fig", "1", "f1"), ("table", "2", "t2"), ("equation", "4", "e1")))
    notes = o.select(K().alias("doc_id"), F.lit("a").alias("label"), F.lit(1).alias("note_no"), F.lit("fn1").alias("id"))
    numeric = o.where("o_orderkey % 2 = 0").select(K().alias("doc_id"), F.lit(3).alias("n"))
    return xml.marked_paragraphs(paras, cites, things, notes, numeric)


@query("""
SELECT o_orderkey AS doc_id, CAST(pos AS INTEGER) AS pos, surname, orcid, removed, edited FROM (SELECT o_orderkey, unnest([0, 1, 2]) AS pos, unnest([CASE WHEN o_orderkey % 2 = 0 THEN 'New' ELSE 'S0' END, 'S1', 'Added']) AS surname, unnest(['o0', NULL, NULL]) AS orcid, unnest([false, o_orderkey % 3 = 0, false]) AS removed, unnest([o_orderkey % 2 = 0, true, true]) AS edited FROM orders)
""")
def item_overlays(spark, sf_dir):
    items = _each(spark, sf_dir, _rows("pos surname orcid", (0, "S0", "o0"), (1, "S1", "o1")))
    edits = _rows("field value", (F.when(K() % 2 == 0, "author_0_surname").otherwise("other"), "New"), ("author_1_orcid", " "), (F.when(K() % 3 == 0, "author_1_remove").otherwise("doi"), "1"), ("author_2_surname", "Added"), ("author_3_surname", ""), ("aff_0_city", "Rio"))
    return overlay.apply_item_edits(items, overlay.item_edits(_each(spark, sf_dir, edits), "doc_id"), "doc_id", "author", ["surname", "orcid"])


@query("""
SELECT s_suppkey AS journal, unnest(CASE WHEN s_suppkey % 2 = 0 THEN ['title', 'publisher', 'issn_epub'] ELSE ['title', 'publisher', 'issn_epub', 'issn_ppub'] END) AS field, unnest(CASE WHEN s_suppkey % 2 = 0 THEN ['A' || s_suppkey, 'sibling', 'x'] ELSE ['A' || s_suppkey, 'sibling', 'x', 'y'] END) AS value FROM supplier
""")
def issn_cascade(spark, sf_dir):
    s = F.col("s_suppkey")
    rows = _rows("number source field value", ("own", "a", "title", F.concat(F.lit("A"), s)), ("own", "b", "title", "B"), ("own", "a", "publisher", " "), ("own", "b", "issn_epub", "x"), ("own", "b", "issn_ppub", F.when(s % 2 == 0, "x").otherwise("y")), ("sib", "b", "publisher", "sibling"), ("sib", "b", "title", "no"))
    values = _table(spark, sf_dir, "supplier").select(s, F.explode(rows).alias("x")).select("s_suppkey", "x.*")
    values = values.select(F.when(F.col("number") == "own", s).otherwise(-s - 1).alias("journal"), F.concat("number", s).alias("issn"), "source", "field", "value")
    siblings = _table(spark, sf_dir, "supplier").select(F.concat(F.lit("own"), s).alias("issn"), F.concat(F.lit("sib"), s).alias("other"))
    return overlay.cascade_by_issn(values, "journal", "issn", siblings, {}, ["a", "b"]).where("journal >= 0").select("journal", "field", "value")
