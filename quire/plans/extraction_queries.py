"""Queries for the extraction operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.functions import text
from quire.operators import extraction, rules

from .layout_queries import _LINES, lines
from .scalar_queries import _table

QUERIES, ORACLE_SQL = {}, {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def _pick(key: str, *values: str):
    return F.array(*map(F.lit, values))[(F.col(key) % len(values)).cast("int")]


def _listed(*values: str) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


_PEOPLE = ("Ana da Silva¹", "JOÃO SOUZA", "JOÃO SOUZA*", "Universidade Federal de Minas", "Maria Lima, Pedro dos Reis", "introduction to law", "Eva Costa")


@query(f"SELECT c_custkey, {_listed(*_PEOPLE)}[c_custkey % 7 + 1] AS line, CASE c_custkey % 7 WHEN 0 THEN 3 WHEN 2 THEN 3 WHEN 4 THEN 1 WHEN 6 THEN 1 ELSE 0 END + CASE WHEN c_custkey % 7 IN (0, 2, 4, 6) AND c_custkey % 2 = 0 THEN 1 ELSE 0 END AS score FROM customer")
def person_name_lines(spark, sf_dir):
    t = _table(spark, sf_dir, "customer").select("c_custkey", _pick("c_custkey", *_PEOPLE).alias("line"))
    return t.select("c_custkey", "line", extraction.name_score(F.col("line"), F.col("c_custkey") % 2 == 0).alias("score"))


@query("""
SELECT o_custkey AS doc_id, kind, arg_min(strftime(o_orderdate, '%Y-%m-%d'), n) AS date FROM (
 SELECT o_custkey, o_orderdate, o_orderkey * 2 AS n, ['received','accepted','published'][o_orderkey % 3 + 1] AS kind FROM orders WHERE o_orderkey % 5 > 0) GROUP BY ALL
""")
def labelled_dates(spark, sf_dir):
    k, day = F.col("o_orderkey"), F.date_format("o_orderdate", "dd/MM/yyyy")
    label = _pick("o_orderkey", "Recebido em: ", "Accepted ", "Publicado: ")
    pair = F.when(k % 5 == 0, F.array(F.concat(F.lit("Acesso "), label, day))).when(k % 5 == 1, F.array(label, day)).otherwise(F.array(F.concat(label, day)))
    t = _table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc_id"), k, F.posexplode(pair).alias("i", "text"))
    return extraction.labelled_dates(t.select("doc_id", (k * 2 + F.col("i")).alias("line_no"), "text"), 2026)


_NOTES = ("Professor da UFMG", "Bolsa CAPES", "Sem conflito de interesse", "Apresentado no congresso", "Ver nota 3")


@query(f"SELECT s_suppkey, {_listed(*_NOTES)}[s_suppkey % 5 + 1] AS note, ['current-aff','supported-by','conflict','presented-at','other'][s_suppkey % 5 + 1] AS kind FROM supplier")
def note_kinds(spark, sf_dir):
    t = _table(spark, sf_dir, "supplier").select("s_suppkey", _pick("s_suppkey", *_NOTES).alias("note"))
    return t.withColumn("kind", text.note_kind(F.col("note")))


@query("""
WITH l AS (SELECT p_partkey % 300 AS doc_id, p_partkey % 12 AS number FROM part), b AS (SELECT DISTINCT s_suppkey % 300 AS doc_id, s_suppkey % 12 AS number FROM supplier UNION SELECT s_suppkey % 300, 3 FROM supplier)
SELECT l.doc_id, l.number, b.number IS NOT NULL AS called FROM l LEFT JOIN b ON l.doc_id = b.doc_id AND l.number = b.number
""")
def called_in_text(spark, sf_dir):
    labels = _table(spark, sf_dir, "part").select((F.col("p_partkey") % 300).alias("doc_id"), (F.col("p_partkey") % 12).alias("number"))
    bodies = _table(spark, sf_dir, "supplier").select((F.col("s_suppkey") % 300).alias("doc_id"), F.concat(F.lit("See tabela "), F.col("s_suppkey") % 12, F.lit(" and Table 3, but Figure 5")).alias("text"))
    return extraction.called(labels, bodies, "tabela|table|quadro")


@query(f"""
WITH l AS (SELECT doc_id, length(text) AS n, x0 - min(x0) OVER (PARTITION BY doc_id) AS off FROM ({_LINES}))
SELECT doc_id, count(*) >= 8 AND avg(CAST(off <= 2.5 AS INTEGER)) BETWEEN 0.2 AND 0.6 AND avg(CAST(off >= 4 AND off <= 40 AS INTEGER)) >= 0.3 AND (sum(n) + count(*) FILTER (off > 2.5)) / count(*) FILTER (off <= 2.5) >= 60 AS hanging FROM l GROUP BY doc_id
""")
def hanging_indent(spark, sf_dir):
    return extraction.hanging_indent(lines(spark, sf_dir))


@query("""
WITH n AS (SELECT o_custkey AS doc_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS k FROM orders), r AS (SELECT doc_id, max(k) AS n FROM n GROUP BY doc_id)
SELECT doc_id, CAST(CASE WHEN doc_id % 2 = 0 THEN n ELSE 0 END AS INTEGER) AS in_order, doc_id % 2 = 0 AND n >= 4 AS numbered FROM r
""")
def numbered_lists(spark, sf_dir):
    _table(spark, sf_dir, "orders").createOrReplaceTempView("_orders_numbered")
    t = spark.sql("SELECT o_custkey AS doc_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS line_no FROM _orders_numbered")
    number = F.when(F.col("doc_id") % 2 == 0, F.col("line_no")).otherwise(F.col("line_no") + 1)
    return extraction.numbered_list(t.withColumn("text", F.concat(F.lit("["), number, F.lit("] Silva"))))


@query("SELECT doc_id, CASE WHEN avg(CAST(k < 2 AS INTEGER)) >= 0.6 THEN 'ABNT' WHEN avg(CAST(k = 2 AS INTEGER)) >= 0.6 THEN 'APA' ELSE 'mixed' END AS style FROM (SELECT o_custkey AS doc_id, o_orderkey % 4 AS k FROM orders) GROUP BY doc_id")
def style_votes(spark, sf_dir):
    text = _pick("o_orderkey", "SILVA, João. Title.", "LIMA REIS, A. Title.", "Costa, B. C. (2001). Title.", "A title without author")
    return extraction.style_vote(_table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc_id"), text.alias("text")))


@query("""
WITH p AS (SELECT o_custkey AS doc_id, o_orderkey AS para_no, o_orderkey % 7 AS page, o_orderkey % 3 = 0 AS is_title, o_orderkey % 5 = 0 AS intro FROM orders),
f AS (SELECT doc_id, coalesce(min(CASE WHEN intro AND page <= 5 THEN para_no END), min(CASE WHEN is_title AND page >= 2 THEN para_no END)) AS first FROM p GROUP BY doc_id)
SELECT f.doc_id, first, max(CASE WHEN para_no % 4 = 0 AND (first IS NULL OR para_no >= first) THEN para_no END) AS references_at FROM f JOIN p ON p.doc_id = f.doc_id GROUP BY f.doc_id, first
""")
def body_bounds(spark, sf_dir):
    k = F.col("o_orderkey")
    p = _table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc_id"), k.alias("para_no"), (k % 7).alias("page"), (k % 3 == 0).alias("is_title"), (k % 5 == 0).alias("intro"), F.when(k % 4 == 0, "Referências:").otherwise("Referências de um texto qualquer").alias("text"))
    first = extraction.first_heading(p, F.col("intro"))
    return first.join(extraction.references_heading(p, first).withColumnRenamed("para_no", "references_at"), "doc_id", "left")


_GRIDS = ("a | b\n1 | 2\n3", "x\ty\n1 2\t3 4", "one", "h | i\n | ")


@query("SELECT s_suppkey, ['a,b;1,2;3,','x,y;1 2,3 4','one','h,i;,'][s_suppkey % 4 + 1] AS cells, ['medium','low','none','none'][s_suppkey % 4 + 1] AS quality FROM supplier")
def typed_grids(spark, sf_dir):
    t = _table(spark, sf_dir, "supplier").select("s_suppkey", extraction.grid(_pick("s_suppkey", *_GRIDS)).alias("g"))
    return t.select("s_suppkey", F.array_join(F.transform("g", lambda r: F.array_join(r, ",")), ";").alias("cells"), extraction.grid_quality(F.col("g")).alias("quality"))


@query("""
SELECT conv_id AS doc_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS turn_no, upper(substr(role, 1, 1)) || substr(role, 2) AS speaker, 'said ' || length(text) || ' and more' AS said FROM conversations
""")
def dialogue_turns(spark, sf_dir):
    who = F.concat(F.upper(F.substring("role", 1, 1)), F.expr("substr(role, 2)"))
    t = _table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), "turn", F.posexplode(F.array(F.concat(who, F.lit(": said "), F.length("text")), F.lit("and more"))).alias("i", "text"))
    return extraction.turns(t.select("doc_id", (F.col("turn") * 2 + F.col("i")).alias("line_no"), "text"))


@query(f"SELECT doc_id, sum(length(text)) / count(DISTINCT page) < 200 AS scanned FROM ({_LINES}) GROUP BY doc_id")
def scanned_documents(spark, sf_dir):
    return extraction.page_characters(lines(spark, sf_dir), 200)


@query("""
SELECT 'pk' || n_nationkey AS package, '<!DOCTYPE html><table>' || string_agg('<tr><td>' || item || '</td><td>' || CASE WHEN ok THEN 'ok' ELSE 'missing' END || '</td></tr>', '' ORDER BY item) || '</table>' AS html
FROM (SELECT n_nationkey, unnest(['a &amp; b', 'pdf']) AS item, unnest([n_nationkey % 2 = 0, true]) AS ok FROM nation) GROUP BY n_nationkey
""")
def package_reports(spark, sf_dir):
    k = F.col("n_nationkey")
    each = F.explode(F.array(F.struct(F.lit("a & b").alias("item"), (k % 2 == 0).alias("ok")), F.struct(F.lit("pdf").alias("item"), F.lit(True).alias("ok")))).alias("x")
    return extraction.html_report(_table(spark, sf_dir, "nation").select(F.concat(F.lit("pk"), k).alias("package"), each).select("package", "x.item", "x.ok"))


@query()
def package_zips(spark, sf_dir):
    """Zips of two files each; the contents are checked by a test."""
    k = F.col("n_nationkey")
    files = _table(spark, sf_dir, "nation").select(F.concat(F.lit("pk"), k).alias("package"), F.explode(F.array(F.lit("a.xml"), F.lit("b.pdf"))).alias("name"), "n_name")
    return extraction.zipped(files.select("package", F.concat("package", F.lit("/"), "name").alias("path"), F.col("n_name").cast("binary").alias("content")))


@query("""
WITH f AS (SELECT o_orderkey, unnest(['A08', 'A01']) AS code FROM orders), m AS (SELECT unnest(['A08','A08','A01']) AS code, unnest(['elocation','volume','doi']) AS field, unnest([1, 2, 1]) AS pos)
SELECT o_orderkey, code, field, CASE WHEN pos = 1 THEN 'rule ' || code ELSE '' END AS text FROM f JOIN m USING (code)
""")
def blocker_fields(spark, sf_dir):
    found = _table(spark, sf_dir, "orders").select("o_orderkey", F.explode(F.array(F.lit("A08"), F.lit("A01"))).alias("code")).withColumn("rule_id", F.concat(F.lit("rule "), "code"))
    fields = spark.createDataFrame([("A08", "elocation", 1), ("A08", "volume", 2), ("A01", "doi", 1)], "code string, field string, pos int")
    return rules.message_per_field(found, "o_orderkey", fields)
