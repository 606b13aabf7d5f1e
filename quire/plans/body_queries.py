"""Queries for captions, notes, back matter, float placement and scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.operators import body

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


def _dealt_each(spark, sf_dir, rows):
    return _orders(spark, sf_dir).select(K().alias("doc_id"), F.explode(rows).alias("x")).select("doc_id", "x.*")


@query("""
SELECT o_orderkey AS doc_id, ['table', NULL, 'fig', 'fig', NULL, 'table', NULL][o_orderkey % 7 + 1] AS kind, ['Tabela 1', NULL, 'Figura 2', 'Gráfico 3', NULL, 'Quadro 4', NULL][o_orderkey % 7 + 1] AS label, ['Dados gerais', NULL, 'mapa', '', NULL, 'Casos', NULL][o_orderkey % 7 + 1] AS caption, CASE WHEN o_orderkey % 7 = 6 THEN 'IBGE, 2020.' END AS source, o_orderkey % 7 = 4 AS title FROM orders
""")
def captions_and_titles(spark, sf_dir):
    texts = ("Tabela 1: Dados gerais", "Table 1 shows the sample", "Figura 2 - mapa", "Gráfico 3", "2.1 O método e a casa", "Quadro 4 Casos", "Fonte: IBGE, 2020.")
    t = _table(spark, sf_dir, "orders").select(K().alias("doc_id"), F.array(*map(F.lit, texts))[(K() % 7).cast("int")].alias("text"))
    title = body.section_title(F.col("text"), F.lit(1), F.lit(10.0), F.lit(10.0), F.lit(True), F.lit(False))
    c = body.caption(F.col("text"))
    return t.select("doc_id", c["kind"].alias("kind"), c["label"].alias("label"), c["caption"].alias("caption"), body.source_line(F.col("text")).alias("source"), title.alias("title"))


@query("""
SELECT o_orderkey AS doc_id, CAST(n AS BIGINT) AS block_no, ['Agradecimentos', 'How to cite this'][n] AS title, CASE WHEN n = 1 THEN 'A todos. E mais ' || o_custkey ELSE '' END AS text FROM orders, (SELECT unnest([1, 2]) AS n) WHERE n = 1 OR o_orderkey % 2 = 0
""")
def back_matter_blocks(spark, sf_dir):
    rows = _rows("para_no first_line text", (1, "Notas", "Notas"), (2, "Referências", "Referências"), (3, "SILVA", "SILVA, A."), (4, "Agradecimentos", "Agradecimentos A todos."), (5, "E mais", F.concat(F.lit("E mais "), C())), (6, F.when(K() % 2 == 0, "How to cite this").otherwise(""), F.when(K() % 2 == 0, "How to cite this").otherwise("")))
    return body.back_matter(_dealt_each(spark, sf_dir, rows), _orders(spark, sf_dir).select(K().alias("doc_id"), F.lit(2).alias("para_no")))


@query("""
SELECT o_orderkey AS doc_id, CAST(n AS INTEGER) AS note_no, ['1', '*', '2', '3'][n] AS label, ['current-aff', 'other', 'supported-by', 'other'][n] AS kind, CASE WHEN n = 4 THEN o_orderkey % 2 = 0 ELSE false END AS called, CASE n WHEN 1 THEN 'author:A' WHEN 2 THEN 'title' END AS attached FROM orders, (SELECT unnest([1, 2, 3, 4]) AS n)
""")
def attached_notes(spark, sf_dir):
    notes = _each(spark, sf_dir, _rows("note_no label text page", (1, "1", "Doutora em Direito", 1), (2, "*", "Traduzido", 1), (3, "2", "Bolsa do CNPq", 1), (4, "3", "Professor da casa", 3)))
    o = _table(spark, sf_dir, "orders")
    calls = o.where("o_orderkey % 2 = 0").select(K().alias("doc_id"), F.lit("3").alias("label"))
    authors = o.select(K().alias("doc_id"), F.lit("A").alias("author"), F.array(F.lit("1"), F.lit("3")).alias("markers"))
    return body.typed_notes(notes, calls, authors, o.select(K().alias("doc_id"), F.lit("*").alias("label")))


# captions 1 and 2 stand on page 1, 3 on page 3; grids 1 (below) and 2 (above) on page 1, 3 on page 2, 4 on page 7
@query("""
SELECT o_orderkey AS doc_id, unnest([1, 2, 3, NULL]) AS caption_no, unnest(CASE WHEN o_orderkey % 2 = 0 THEN [2, 1, 3, 4] ELSE [2, 3, NULL, 4] END) AS grid_no FROM orders
""")
def caption_grids(spark, sf_dir):
    captions = _each(spark, sf_dir, _rows("caption_no page", (1, 1), (2, 1), (3, 3)))
    grids = _each(spark, sf_dir, _rows("grid_no page y0", (1, 1, 500.0), (2, 1, 100.0), (3, 2, 50.0), (4, 7, 10.0))).where("grid_no <> 1 or doc_id % 2 = 0")
    return body.place_grids(captions, grids)


# caption 1 has an image above, 2 takes the next one above, 3 only one below
@query("SELECT o_orderkey AS doc_id, unnest([1, 2, 3]) AS caption_no, unnest([2, 1, CASE WHEN o_orderkey % 2 = 0 THEN 3 END]) AS image_no FROM orders")
def caption_images(spark, sf_dir):
    captions = _each(spark, sf_dir, _rows("caption_no page y0 y1", (1, 1, 300.0, 310.0), (2, 1, 400.0, 410.0), (3, 2, 100.0, 110.0)))
    images = _each(spark, sf_dir, _rows("image_no page y0 y1", (1, 1, 10.0, 90.0), (2, 1, 100.0, 305.0), (3, F.when(K() % 2 == 0, 2).otherwise(3), 104.0, 200.0)))
    return body.place_images(captions, images)


@query("""
SELECT o_orderkey AS doc_id, CAST(1 AS INTEGER) AS element_no, CASE WHEN o_orderkey % 2 = 0 THEN 'Tabela 2' ELSE 'Tabela 1' END AS label, CASE WHEN o_orderkey % 2 = 0 THEN 'Depois' ELSE 'Antes' END AS caption, CASE WHEN o_orderkey % 2 = 0 THEN 'IBGE' END AS source FROM orders
""")
def element_captions(spark, sf_dir):
    lines = _rows("line_no text", (1, "Tabela 1: Antes"), (2, "x"), (3, "y"), (4, F.when(K() % 2 == 0, "Tabela 2: Depois").otherwise("z")), (5, F.when(K() % 2 == 0, "Fonte: IBGE").otherwise("w")))
    return body.element_captions(_each(spark, sf_dir, _rows("element_no line_no", (1, 3))), _each(spark, sf_dir, lines))


@query("""
SELECT o_orderkey AS doc_id, unnest(['heading', 'title', 'authors', 'affiliations', 'citations', 'references']) AS element,
 unnest([CASE o_orderkey % 4 WHEN 0 THEN 'yes' WHEN 1 THEN 'part' WHEN 2 THEN 'no' ELSE 'n/a' END, CASE o_orderkey % 3 WHEN 0 THEN 'yes' WHEN 1 THEN 'part' ELSE 'no' END, CASE WHEN o_orderkey % 2 = 0 THEN 'yes' ELSE 'part' END, CASE WHEN o_orderkey % 2 = 0 THEN 'part' ELSE 'yes' END, 'yes', CASE WHEN o_orderkey % 5 = 0 THEN 'yes' ELSE 'part' END]) AS grade FROM orders
""")
def gold_grades(spark, sf_dir):
    o = _table(spark, sf_dir, "orders")
    heading = F.when(K() % 4 == 0, "Seção Artigos").when(K() % 4 == 1, "Resenhas").when(K() % 4 == 3, "X")
    title = F.when(K() % 3 == 2, "Nothing of it").otherwise("A title of the law")
    translations = F.when(K() % 3 == 0, F.create_map(F.lit("en"), F.lit("T."))).otherwise(F.expr("cast(map() as map<string,string>)"))
    n = lambda x, name: (F.lit(x) if isinstance(x, int) else x).alias(name)
    made = o.select(K().alias("doc_id"), heading.alias("heading"), title.alias("title"), translations.alias("translations"), n(2, "authors_found"), n(F.when(K() % 2 == 0, 2).otherwise(1), "orcids_found"), n(F.when(K() % 2 == 0, 1).otherwise(2), "affiliations_found"), n(9, "citations"), n(F.when(K() % 5 == 0, 20).otherwise(19), "references"))
    gold = o.select(K().alias("doc_id"), F.when(K() % 4 < 3, "Artigos").alias("heading"), F.lit("A title of the law").alias("title"), F.create_map(F.lit("en"), F.lit("T")).alias("translations"), n(2, "n_authors"), n(2, "n_orcids"), n(7, "citations"), n(20, "references"))
    return body.gold_scores(made, gold)
