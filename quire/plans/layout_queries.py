"""Queries for the layout and linking operators, over lines and records derived from the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.operators import layout, linking

from .scalar_queries import _KEY, _table

QUERIES, ORACLE_SQL = {}, {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


# Each document's lines with a made-up geometry that both sides compute from the line number.
_LINES = """
SELECT doc_id, n AS line_no, CAST(ceil(n / 6.0) AS BIGINT) AS page, line AS text, CASE WHEN n % 7 = 0 THEN 12::DOUBLE WHEN n % 11 = 0 THEN 5::DOUBLE ELSE 10::DOUBLE END AS size,
  50::DOUBLE + (length(line) % 4) * 3 AS x0, 50::DOUBLE + (length(line) % 4) * 3 + (length(line) % 60) * 8 AS x1, ((n - 1) % 6) * 140::DOUBLE + (n % 5) AS y0, ((n - 1) % 6) * 140::DOUBLE + (n % 5) + 110.0 AS y1,
  n % 13 = 0 AS bold, n % 17 = 0 AS italic, n // 3 AS block, n % 29 = 0 AS rotated
FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents)
"""


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, size = F.col("line_no"), F.length("text") % 4
    split = _table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("p", "text")).select("doc_id", (F.col("p") + 1).cast("long").alias("line_no"), "text")
    y0 = ((n - 1) % 6) * 140.0 + n % 5
    return split.select(
        "doc_id", "line_no", F.ceil(n / 6.0).alias("page"), "text", F.when(n % 7 == 0, 12.0).when(n % 11 == 0, 5.0).otherwise(10.0).alias("size"),
        (50.0 + size * 3).alias("x0"), (50.0 + size * 3 + (F.length("text") % 60) * 8).alias("x1"), y0.alias("y0"), (y0 + 110.0).alias("y1"),
        (n % 13 == 0).alias("bold"), (n % 17 == 0).alias("italic"), F.floor(n / 3).alias("block"), (n % 29 == 0).alias("rotated"),
    )


_BODY = f"""
SELECT doc_id, coalesce(arg_max(size, w * 1000000 - first), 10::DOUBLE) AS body_size FROM (
  SELECT doc_id, size, sum(length(text)) AS w, min(line_no) AS first FROM ({_LINES}) WHERE size >= 6 GROUP BY doc_id, size) GROUP BY doc_id
"""


@query(f"SELECT d.doc_id, coalesce(b.body_size, 10::DOUBLE) AS body_size FROM (SELECT DISTINCT doc_id FROM ({_LINES})) d LEFT JOIN ({_BODY}) b USING (doc_id)")
def body_size(spark, sf_dir):
    return layout.body_size(lines(spark, sf_dir))


_RKEY = r"trim(regexp_replace(regexp_replace(lower(text), '\d+', '#', 'g'), '\s+', ' ', 'g'))"


@query(f"""
WITH l AS (SELECT source AS doc_id, doc_id AS page, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) AS line_no FROM documents),
k AS (SELECT *, {_RKEY} AS key FROM l), p AS (SELECT doc_id, count(DISTINCT page) AS n FROM l GROUP BY doc_id),
g AS (SELECT doc_id, key, count(DISTINCT page) AS pages, arg_min(text, page * 100000 + line_no) AS example FROM k WHERE length(key) >= 4 GROUP BY doc_id, key)
SELECT doc_id, key, pages, example FROM g JOIN p USING (doc_id) WHERE pages >= greatest(2, round_even(n * 0.05, 0))
""")
def repeated_lines(spark, sf_dir):
    d = _table(spark, sf_dir, "documents")
    got = d.select(F.col("source").alias("doc_id"), F.col("doc_id").alias("page"), F.posexplode(F.split("text", "\n")).alias("line_no", "text"))
    return layout.repeated_lines(got, share=0.05)


@query(f"""
SELECT doc_id, page, arg_max(x, w * 1000000 - first) AS col_left FROM (SELECT doc_id, page, round_even(x0, 0) AS x, count(*) AS w, min(line_no) AS first FROM ({_LINES}) GROUP BY ALL) GROUP BY doc_id, page
""")
def main_margin(spark, sf_dir):
    return layout.main_margin(lines(spark, sf_dir))


@query(f"""
SELECT doc_id, avg(CASE WHEN x1 - x0 < 300 AND x0 > 270 THEN 1 ELSE 0 END) > 0.2 AS two_columns
FROM (SELECT * REPLACE (x0 + (line_no % 3) * 150 AS x0, x1 + (line_no % 3) * 150 AS x1) FROM ({_LINES})) l JOIN ({_BODY}) b USING (doc_id) WHERE page <> 1 AND abs(size - body_size) <= 1 GROUP BY doc_id
""")
def column_vote(spark, sf_dir):
    shift = (F.col("line_no") % 3) * 150
    return layout.two_columns(lines(spark, sf_dir).withColumns({"x0": F.col("x0") + shift, "x1": F.col("x1") + shift}), 600.0)


@query(f"""
WITH l AS (SELECT *, {_RKEY} AS key FROM ({_LINES})), n AS (SELECT doc_id, count(DISTINCT page) AS n FROM l GROUP BY doc_id),
r AS (SELECT doc_id, key FROM l JOIN n USING (doc_id) WHERE length(key) >= 4 GROUP BY doc_id, key, n HAVING count(DISTINCT page) >= greatest(2, round_even(n * 0.4, 0)))
SELECT zone, count(*) AS n, sum(line_no) AS s FROM (SELECT line_no, CASE WHEN rotated THEN 'margin'
  WHEN r.key IS NOT NULL AND (y0 < 0.15 * 842 OR y1 > 0.85 * 842 OR size < coalesce(body_size, 10.0) * 0.85) THEN CASE WHEN y0 < 421 THEN 'header' ELSE 'footer' END
  WHEN regexp_matches(text, '^(\\d{{1,4}}|\\d{{1,4}}\\s*[|•·]\\s*.{{0,70}}|.{{0,70}}\\s*[|•·]\\s*\\d{{1,4}})$') AND (y0 < 0.12 * 842 OR y1 > 0.88 * 842) THEN 'footer' ELSE 'body' END AS zone
  FROM l LEFT JOIN r USING (doc_id, key) LEFT JOIN ({_BODY}) b USING (doc_id)) GROUP BY zone
""")
def line_zones(spark, sf_dir):
    return layout.zones(lines(spark, sf_dir), 842.0).groupBy("zone").agg(F.count(F.lit(1)).alias("n"), F.sum("line_no").alias("s"))


_PARA = f"""
WITH w AS (SELECT *, lag(size) OVER o AS s, lag(bold) OVER o AS b, lag(italic) OVER o AS i, lag(y1) OVER o AS y, lag(x0) OVER o AS x, lag(block) OVER o AS k, lag(text) OVER o AS t
  FROM ({_LINES}) WINDOW o AS (PARTITION BY doc_id, page ORDER BY line_no)),
f AS (SELECT *, regexp_matches(t, '[.!?:;”")…\\]]\\s*$') AS term, x0 > 56 AND x <= 56 AS ind FROM w),
n AS (SELECT *, coalesce(abs(size - s) > 0.6 OR bold <> b OR italic <> i OR y0 - y > 1.6 * size OR (ind AND term) OR (block <> k AND (term OR ind OR y0 - y > 1.1 * size)), true) AS new FROM f),
p AS (SELECT *, sum(CAST(new AS INTEGER)) OVER (PARTITION BY doc_id, page ORDER BY line_no) AS para_no FROM n)
"""


@query(_PARA + "SELECT doc_id, page, CAST(para_no AS BIGINT) AS para_no, count(*) AS n_lines, avg(CAST(bold AS INTEGER)) > 0.5 AS bold, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1 FROM p GROUP BY doc_id, page, para_no")
def paragraph_islands(spark, sf_dir):
    numbered = layout.paragraph_numbers(lines(spark, sf_dir), F.lit(50.0))
    return layout.paragraphs(numbered).drop("text")


_HEADS = """SELECT doc_id, line_no AS para_no, text, length(text) < 40 AS is_title, CASE WHEN line_no % 3 > 0 THEN CAST(line_no % 3 AS INTEGER) END AS lvl FROM ({})""".format(_LINES)


@query(f"""
WITH h AS ({_HEADS}), s AS (SELECT *, sum(CAST(is_title AS INTEGER)) OVER (PARTITION BY doc_id ORDER BY para_no) AS section_no FROM h),
g AS (SELECT doc_id, section_no, min(para_no) AS first, count(*) AS n FROM s WHERE section_no > 0 GROUP BY doc_id, section_no),
t AS (SELECT g.doc_id, CAST(g.section_no AS BIGINT) AS section_no, h.text AS title, h.lvl, g.n FROM g JOIN h ON g.doc_id = h.doc_id AND g.first = h.para_no)
SELECT doc_id, section_no, title, coalesce(last_value(lvl IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY section_no), 1) AS level, n FROM t
""")
def section_assembly(spark, sf_dir):
    level = F.when(F.col("para_no") % 3 > 0, (F.col("para_no") % 3).cast("int"))
    paras = lines(spark, sf_dir).select("doc_id", F.col("line_no").alias("para_no"), "text")
    return layout.sections(paras, F.length("text") < 40, level).groupBy("doc_id", "section_no").agg(F.min_by("title", "para_no").alias("title"), F.min_by("level", "para_no").alias("level"), F.count(F.lit(1)).alias("n"))


_TREE = "SELECT o_custkey AS doc_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS section_no, CAST(o_orderkey % 3 + 1 AS INTEGER) AS level FROM orders"


@query(f"SELECT a.doc_id, a.section_no, a.level, max(b.section_no) AS parent_no FROM ({_TREE}) a LEFT JOIN ({_TREE}) b ON a.doc_id = b.doc_id AND b.section_no < a.section_no AND b.level < a.level GROUP BY ALL")
def section_tree(spark, sf_dir):
    _table(spark, sf_dir, "orders").createOrReplaceTempView("_orders_tree")
    heads = spark.sql(_TREE.replace("FROM orders", "FROM _orders_tree")).withColumn("section_no", F.col("section_no").cast("long"))
    return layout.section_parents(heads)


@query("""
SELECT l_orderkey AS doc_id, array_to_string(list_sort(list_filter(range(min(l_quantity)::BIGINT, max(l_quantity)::BIGINT + 1), lambda i: NOT list_contains(list(l_quantity::BIGINT), i))), ',') AS missing FROM lineitem GROUP BY l_orderkey
""")
def numbering_gaps(spark, sf_dir):
    rows = _table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_quantity").cast("long").alias("n"))
    return layout.numbering_gaps(rows, ["doc_id"], "n").select("doc_id", F.array_join(F.array_sort("missing"), ",").alias("missing"))


_NAMES = "['Silva','Souza e Lima','Castro Neves','Müller et al','Costa & Dias','Sil','Reis']"
_CITES = "SELECT o_custkey % 50 AS doc_id, o_orderkey AS cit_no, {0}[{1}] AS author, {2} || CASE WHEN o_orderkey % 4 = 0 THEN 'a' ELSE '' END AS year FROM orders"
_REFS = "SELECT c_custkey % 50 AS doc_id, c_custkey AS ref_no, ['SILVA, J.','SOUZA, A.','NEVES CASTRO, B.','MÜLLER, C.','COSTA, D.','SILVEIRA, E.'][c_custkey % 6 + 1] AS a, CAST(1992 + c_custkey % 8 AS VARCHAR) || CASE WHEN c_custkey % 5 = 0 THEN 'b' ELSE '' END AS year FROM customer"
_CITED = "trim(" + _KEY.format(r"regexp_replace(regexp_replace(author, ' (?:e|and|y) .*$|&.*$', '', 'g'), ' et al', '', 'g')") + ")"


@query(f"""
WITH c AS (SELECT *, {_CITED} AS k FROM ({_CITES.format(_NAMES, 'o_orderkey % 7 + 1', 'CAST(extract(year FROM o_orderdate) AS VARCHAR)')})),
r AS (SELECT *, {_KEY.format("split_part(a, ',', 1)")} AS n FROM ({_REFS}))
SELECT c.doc_id, c.cit_no, c.author, c.year, min(r.ref_no) AS ref_no FROM c LEFT JOIN r ON c.doc_id = r.doc_id AND rtrim(c.year, 'abcdef') = rtrim(r.year, 'abcdef') AND k <> '' AND (k = n OR list_contains(string_split(n, ' '), k) OR starts_with(n, k)) GROUP BY ALL
""")
def citation_link(spark, sf_dir):
    o, c = _table(spark, sf_dir, "orders"), _table(spark, sf_dir, "customer")
    names = F.array(*map(F.lit, ["Silva", "Souza e Lima", "Castro Neves", "Müller et al", "Costa & Dias", "Sil", "Reis"]))
    cites = o.select((F.col("o_custkey") % 50).alias("doc_id"), F.col("o_orderkey").alias("cit_no"), names[(F.col("o_orderkey") % 7).cast("int")].alias("author"), F.concat(F.year("o_orderdate").cast("string"), F.when(F.col("o_orderkey") % 4 == 0, "a").otherwise("")).alias("year"))
    people = F.array(*map(F.lit, ["SILVA, J.", "SOUZA, A.", "NEVES CASTRO, B.", "MÜLLER, C.", "COSTA, D.", "SILVEIRA, E."]))
    refs = c.select((F.col("c_custkey") % 50).alias("doc_id"), F.col("c_custkey").alias("ref_no"), F.array(people[(F.col("c_custkey") % 6).cast("int")]).alias("authors"), F.concat((1992 + F.col("c_custkey") % 8).cast("string"), F.when(F.col("c_custkey") % 5 == 0, "b").otherwise("")).alias("year"))
    return linking.link_citations(cites, refs)


@query("""
WITH j AS (SELECT s_suppkey AS rank, 'j' || s_suppkey AS acronym, 'E' || (s_suppkey % 60) AS e, CASE WHEN s_suppkey % 2 = 0 THEN 'P' || (s_suppkey % 40) END AS p, CASE WHEN s_suppkey % 3 = 0 THEN '10.' || (1000 + s_suppkey % 9) || '/j' || (s_suppkey % 4) END AS pre FROM supplier),
d AS (SELECT o_orderkey AS doc_id, 'E' || (o_custkey % 200) AS i1, 'P' || (o_orderkey % 300) AS i2, '10.' || (1000 + o_orderkey % 12) || '/j' || (o_custkey % 5) || '.' || o_orderkey AS doi, CASE WHEN o_orderkey % 10 = 0 THEN 'code' END AS code FROM orders),
h AS (SELECT doc_id, 1 AS how, rank, acronym FROM d JOIN j ON e IN (i1, i2) OR p IN (i1, i2) UNION ALL SELECT doc_id, 2, rank, acronym FROM d JOIN j ON starts_with(doi, pre)),
f AS (SELECT doc_id, arg_min(acronym, how * 1000000 + rank) AS a FROM h GROUP BY doc_id)
SELECT doc_id, coalesce(code, a) AS journal FROM d LEFT JOIN f USING (doc_id)
""")
def journal_resolve(spark, sf_dir):
    k = F.col("s_suppkey")
    journals = _table(spark, sf_dir, "supplier").select(k.alias("rank"), F.concat(F.lit("j"), k).alias("acronym"), F.concat(F.lit("E"), k % 60).alias("issn_epub"), F.when(k % 2 == 0, F.concat(F.lit("P"), k % 40)).alias("issn_ppub"), F.when(k % 3 == 0, F.concat(F.lit("10."), 1000 + k % 9, F.lit("/j"), k % 4)).alias("doi_prefix"))
    o, c = F.col("o_orderkey"), F.col("o_custkey")
    docs = _table(spark, sf_dir, "orders").select(o.alias("doc_id"), F.array(F.concat(F.lit("E"), c % 200), F.concat(F.lit("P"), o % 300)).alias("issns"), F.concat(F.lit("10."), 1000 + o % 12, F.lit("/j"), c % 5, F.lit("."), o).alias("doi"), F.when(o % 10 == 0, "code").alias("code"))
    return linking.resolve_journals(docs, journals)


@query("""
SELECT e.event_id, e.user_id % 100 AS k, e.ts, arg_max(a.event_id, a.ts) AS anchor FROM events e LEFT JOIN (SELECT * FROM events WHERE event_id % 10 = 0) a ON a.user_id % 100 = e.user_id % 100 AND a.ts <= e.ts WHERE e.event_id % 10 <> 0 GROUP BY ALL
""")
def asof_anchor(spark, sf_dir):
    e = _table(spark, sf_dir, "events").select("event_id", (F.col("user_id") % 100).alias("k"), "ts")
    marks = e.where("event_id % 10 = 0").select("k", "ts", F.col("event_id").alias("anchor"))
    return linking.anchor(e.where("event_id % 10 <> 0"), marks, "k", "ts", "anchor").select("event_id", "k", "ts", "anchor")


@query("""
WITH g AS (SELECT p_partkey AS grid, p_partkey % 40 AS page, p_size * 10::DOUBLE AS y, p_retailprice / 10 AS x FROM part), c AS (SELECT p_partkey AS caption, p_partkey % 40 AS page, p_size * 11::DOUBLE AS y, p_retailprice / 9 AS x FROM part)
SELECT caption, c.page, c.y, c.x, arg_min(grid, abs(g.y - c.y) * 1000000 + grid) AS grid FROM c LEFT JOIN g ON g.page = c.page AND g.y - c.y BETWEEN -60 AND 90 AND abs(g.x - c.x) < 60 GROUP BY ALL
""")
def caption_grid_nearest(spark, sf_dir):
    p, k = _table(spark, sf_dir, "part"), F.col("p_partkey")
    grids = p.select(k.alias("grid"), (k % 40).alias("page"), (F.col("p_size") * 10.0).alias("gy"), (F.col("p_retailprice") / 10).alias("gx"))
    captions = p.select(k.alias("caption"), (k % 40).alias("page"), (F.col("p_size") * 11.0).alias("y"), (F.col("p_retailprice") / 9).alias("x"))
    fits = (F.col("gy") - F.col("y")).between(-60, 90) & (F.abs(F.col("gx") - F.col("x")) < 60)
    return linking.nearest(captions, grids, ["page"], fits, F.abs(F.col("gy") - F.col("y")), "grid", ("y", "gy", -60.0, 90.0), "caption").select("caption", "page", "y", "x", "grid")


@query("""
WITH c AS (SELECT o_orderkey AS call_no, o_custkey % 300 AS label, row_number() OVER (PARTITION BY o_custkey % 300 ORDER BY o_orderkey) AS k FROM orders), n AS (SELECT c_custkey AS note_id, c_custkey % 300 AS label, row_number() OVER (PARTITION BY c_custkey % 300 ORDER BY c_custkey) AS k FROM customer)
SELECT call_no, c.label, note_id FROM c LEFT JOIN n ON c.label = n.label AND c.k = n.k
""")
def note_fifo(spark, sf_dir):
    calls = _table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("call_no"), (F.col("o_custkey") % 300).alias("label"))
    notes = _table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("note_id"), (F.col("c_custkey") % 300).alias("label"))
    return linking.consume_in_order(calls, notes, ["label"]).select("call_no", "label", "note_id")


@query(f"""
WITH r AS (SELECT o_orderkey AS author, o_custkey % 97 AS doc_id, ['Univ. A','univ a!','Instituto É','INSTITUTO E','Escola'][o_orderkey % 5 + 1] AS aff FROM orders), k AS (SELECT *, {_KEY.format('aff')} AS v FROM r),
n AS (SELECT doc_id, v, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY min(author)) AS INTEGER) AS aff_no FROM k GROUP BY doc_id, v)
SELECT k.doc_id, author, aff, aff_no FROM k JOIN n ON k.doc_id = n.doc_id AND k.v = n.v
""")
def affiliation_ids(spark, sf_dir):
    affs = F.array(*map(F.lit, ["Univ. A", "univ a!", "Instituto É", "INSTITUTO E", "Escola"]))
    rows = _table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("author"), (F.col("o_custkey") % 97).alias("doc_id"), affs[(F.col("o_orderkey") % 5).cast("int")].alias("aff"))
    return linking.first_appearance_ids(rows, ["doc_id"], "aff", "author", "aff_no").select("doc_id", "author", "aff", "aff_no")


@query("""
WITH c AS (SELECT p_partkey AS caption_id, p_partkey % 700 AS page, row_number() OVER (PARTITION BY p_partkey % 700 ORDER BY p_size, p_partkey) AS k FROM part WHERE p_partkey % 2 = 0),
g AS (SELECT p_partkey AS grid_id, p_partkey % 700 AS page, row_number() OVER (PARTITION BY p_partkey % 700 ORDER BY p_size, p_partkey) AS k FROM part WHERE p_partkey % 3 = 0)
SELECT coalesce(c.page, g.page) AS page, caption_id, grid_id FROM c FULL JOIN g ON c.page = g.page AND c.k = g.k
""")
def caption_grid_greedy(spark, sf_dir):
    p, k = _table(spark, sf_dir, "part"), F.col("p_partkey")
    captions = p.where("p_partkey % 2 = 0").select(k.alias("caption_id"), (k % 700).alias("page"), F.col("p_size").alias("caption_y"))
    grids = p.where("p_partkey % 3 = 0").select(k.alias("grid_id"), (k % 700).alias("page"), F.col("p_size").alias("grid_y"))
    return linking.greedy_pairs(captions, grids, ["page"])


@query("SELECT DISTINCT l_orderkey, l_partkey FROM lineitem l WHERE NOT EXISTS (SELECT 1 FROM part p WHERE p.p_partkey = l.l_partkey AND p.p_size > 5)")
def files_missing(spark, sf_dir):
    wanted = _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey").distinct()
    return linking.missing(wanted, _table(spark, sf_dir, "part").where("p_size > 5").select(F.col("p_partkey").alias("l_partkey")), ["l_partkey"]).select("l_orderkey", "l_partkey")


@query(f"""
WITH f AS (SELECT s_suppkey, unnest(['name','nation','balance']) AS field, unnest([s_name, CAST(s_nationkey AS VARCHAR), NULL]) AS expected, unnest([lower(s_name), CAST(s_nationkey + CASE WHEN s_suppkey % 4 = 0 THEN 1 ELSE 0 END AS VARCHAR), CASE WHEN s_suppkey % 3 = 0 THEN 'x' END]) AS obtained FROM supplier)
SELECT s_suppkey, field, expected, obtained, coalesce({_KEY.format("coalesce(expected, '')")} = {_KEY.format("coalesce(obtained, '')")}, false) AS ok FROM f
""")
def field_comparison(spark, sf_dir):
    s, k = _table(spark, sf_dir, "supplier"), F.col("s_suppkey")
    official = s.select(k, F.col("s_name").alias("name"), F.col("s_nationkey").alias("nation"), F.lit(None).cast("string").alias("balance"))
    made = s.select(k, F.lower("s_name").alias("name"), (F.col("s_nationkey") + (k % 4 == 0).cast("int")).alias("nation"), F.when(k % 3 == 0, "x").alias("balance"))
    return linking.field_differences(made, official, "s_suppkey", ["name", "nation", "balance"])
