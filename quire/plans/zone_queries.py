"""Queries for sidebars, footnotes and rows, over one made page for each order."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.operators import zones

from .front_queries import C, K, _rows
from .scalar_queries import _table

QUERIES, ORACLE_SQL = {}, {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def _page(spark, sf_dir, names, *rows):
    return _table(spark, sf_dir, "orders").select(K().alias("doc_id"), C().alias("cust"), F.explode(_rows(names, *rows)).alias("x")).select("doc_id", "cust", "x.*", F.lit(1).alias("page"))


_BODY = tuple((n, f"body line {n}", 10.0, 120.0, 500.0, 100.0 + 14 * n, 110.0 + 14 * n, False) for n in range(1, 9))
_NAMES = "line_no text size x0 x1 y0 y1 raised"


@query("SELECT o_orderkey AS doc_id, CAST(n AS INTEGER) AS line_no FROM orders, (SELECT unnest(range(11, 16)) AS n) WHERE o_orderkey % 2 = 0")
def sidebar_lines(spark, sf_dir):
    # five small lines left of the body; in odd documents the last one stands apart, so that the group is too small
    last = F.when(K() % 2 == 0, 41.0).otherwise(60.0)
    side = tuple((10 + n, f"side {n}", 7.0, last if n == 5 else 40.0 + n % 2, 90.0, 100.0 + 14 * n, 107.0 + 14 * n, False) for n in range(1, 6))
    lines = _page(spark, sf_dir, _NAMES, *_BODY, *side).withColumn("body_size", F.lit(10.0))
    return zones.sidebars(lines, 600.0)


@query("""
SELECT o_orderkey AS doc_id, CAST(n AS BIGINT) AS line_no FROM orders, (SELECT unnest([20, 21, 22, 23]) AS n) WHERE (n IN (20, 21) AND o_orderkey % 4 < 2) OR (n = 23 AND o_orderkey % 4 = 1) OR (n = 22 AND o_orderkey % 4 = 0) OR (n = 23 AND o_orderkey % 4 = 0)
""")
def footnote_lines(spark, sf_dir):
    # 0: two notes; 1: the note is ended by a copyright line, after which a new one starts; 2: a large line follows, so the
    # start doesn't count; 3: the start stands in the upper half
    third = F.when(K() % 4 == 1, "© 2020 the authors").when(K() % 4 == 2, "large again").otherwise("goes on")
    size = F.when(K() % 4 == 2, 10.0).otherwise(7.0)
    up = F.when(K() % 4 == 3, 330.0).otherwise(0.0)
    notes = ((20, "1 The first note", 8.0, 120.0, 400.0, 700.0 - up, 708.0 - up, False), (21, "its second line", 8.0, 120.0, 400.0, 710.0 - up, 718.0 - up, False), (22, third, size, 120.0, 400.0, 720.0 - up, 728.0 - up, False), (23, F.when(K() % 4 == 2, "plain").otherwise("2. Another note"), 8.0, 120.0, 400.0, 730.0 - up, 738.0 - up, False))
    return zones.footnotes(_page(spark, sf_dir, _NAMES, *_BODY, *notes), 842.0)


@query("""
SELECT o_orderkey AS doc_id, CAST(r AS INTEGER) AS row_no, t AS text, x1 FROM (SELECT o_orderkey, unnest(CASE o_orderkey % 3 WHEN 0 THEN [1, 2] WHEN 1 THEN [1, 2, 3] ELSE [1, 2, 3] END) AS r, unnest(CASE o_orderkey % 3 WHEN 0 THEN ['a b c', 'd'] WHEN 1 THEN ['a b', 'c', 'd'] ELSE ['a', 'b c', 'd'] END) AS t, unnest(CASE o_orderkey % 3 WHEN 0 THEN [300.0::DOUBLE, 100] WHEN 1 THEN [150.0::DOUBLE, 300, 100] ELSE [50.0::DOUBLE, 300, 100] END) AS x1 FROM orders)
""")
def merged_rows(spark, sf_dir):
    # b is inside 4 sizes of a, c of b; in documents 1 c is too far, in documents 2 b stands lower than a
    b_y = F.when(K() % 3 == 2, 104.0).otherwise(102.0)
    c_x = F.when(K() % 3 == 1, 200.0).otherwise(160.0)
    rows = ((1, "a", 10.0, 10.0, 50.0, 100.0, 110.0, False), (2, "b", 10.0, 60.0, 150.0, b_y, 112.0, False), (3, "c", 10.0, c_x, 300.0, F.when(K() % 3 == 2, 104.0).otherwise(101.0), 111.0, False), (4, "d", 10.0, 10.0, 100.0, 130.0, 140.0, False))
    return zones.merged_rows(_page(spark, sf_dir, _NAMES, *rows)).select("doc_id", "row_no", "text", "x1")


@query("SELECT o_orderkey AS doc_id, CAST(n AS INTEGER) AS line_no, label FROM orders, (SELECT unnest([30, 31, 33]) AS n, unnest([false, false, true]) AS label) WHERE n <> 31 OR o_orderkey % 2 = 0")
def page_numbers(spark, sf_dir):
    # 31 is small: with text close to its right it is a note's label
    beside = F.when(K() % 2 == 0, 300.0).otherwise(130.0)
    rows = ((30, "12", 10.0, 300.0, 310.0, 20.0, 30.0, False), (31, "3", 6.0, 120.0, 123.0, 800.0, 806.0, False), (32, "a note", 8.0, beside, 400.0, 800.0, 808.0, False), (33, "kwd-group", 7.0, 10.0, 40.0, 400.0, 407.0, False))
    lines = _page(spark, sf_dir, _NAMES, *_BODY, *rows).withColumn("body_size", F.lit(10.0))
    boxes = lines.where(zones.box_label(F.col("text"), F.col("size"))).select("doc_id", "line_no", F.lit(True).alias("label"))
    return zones.page_number(lines, 842.0).withColumn("label", F.lit(False)).unionByName(boxes)
