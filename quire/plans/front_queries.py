"""Queries for front matter, over a few lines of each order's document."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.operators import front

from .scalar_queries import _dealt, _table

QUERIES, ORACLE_SQL = {}, {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def K():
    return F.col("o_orderkey")


def C():
    return F.col("o_custkey")


def _lines(spark, sf_dir, *texts):
    """doc_id, seq (from 1), text of each order: texts are columns; null ones give no line."""
    each = F.posexplode(F.array(*[t.cast("string") if not isinstance(t, str) else F.lit(t) for t in texts])).alias("seq", "text")
    return _orders(spark, sf_dir).select(K().alias("doc_id"), C().alias("cust"), each).where("text is not null").withColumn("seq", F.col("seq") + 1)


def _orders(spark, sf_dir):
    """The orders, dealt by key before lines are made of them: rows alike shrink so much in a shuffle that Spark, which deals
    by bytes, gives a task ever more of them. What follows by document needs no other shuffle."""
    orders = _table(spark, sf_dir, "orders")
    return _dealt(orders, "o_orderkey", orders)


def _rows(names: str, *rows):
    """An array of structs of the names, one for each row of values or columns."""
    return F.array(*[F.struct(*[(F.lit(v) if isinstance(v, (str, int, float)) else v).alias(n) for n, v in zip(names.split(), row, strict=True)]) for row in rows])


def _when(n, r, x):
    return F.when(K() % n == r, x)


@query("""
SELECT o_orderkey AS doc_id, CASE WHEN o_orderkey % 2 = 0 THEN '10.1590/head.' || o_orderkey ELSE '10.1590/page.' || o_orderkey END AS doi, CASE WHEN o_orderkey % 2 = 0 THEN '10.1590/page.' || o_orderkey ELSE '' END AS other_dois,
 CASE WHEN o_orderkey % 3 = 0 THEN '2179-8966' WHEN o_orderkey % 3 = 1 THEN '2179-8967,1234-5678' ELSE '' END AS issns, CASE WHEN o_orderkey % 5 = 0 THEN '58' ELSE CAST(o_custkey AS VARCHAR) END AS volume, CASE WHEN o_orderkey % 5 = 0 THEN '4' ELSE '7' END AS issue,
 CASE WHEN o_orderkey % 5 = 0 THEN '2013' ELSE '2019' END AS year, 'e1234' AS elocation, CASE WHEN o_orderkey % 5 = 0 THEN '691' ELSE '10' END AS fpage, CASE WHEN o_orderkey % 5 = 0 THEN '701' ELSE '29' END AS lpage FROM orders
""")
def doc_identifiers(spark, sf_dir):
    head = F.concat(F.lit("Rev. Dir., v. "), C(), F.lit(", n. 7, 2019"), F.coalesce(_when(2, 0, F.concat(F.lit(" doi 10.1590/head."), K())), F.lit("")))
    issn = _when(3, 0, F.lit("ISSN 2179-8966 and 1234-5678"))
    lines = _lines(spark, sf_dir, head, F.concat(F.lit("DOI: 10.1590/page."), K(), F.lit(".")), F.coalesce(issn, _when(3, 1, F.lit("ISSN 2179-8967, 1234-5678, 0000-0002-1825-0097"))), "p. 10-29, e1234, v. 99 n. 88 1999", _when(5, 0, F.lit("Cad Saude Publica. 2013;58(4):691-701")))
    found = front.identifiers(lines.withColumn("rank", F.when(F.col("seq") == 1, 0).otherwise(1)))
    return found.withColumns({"other_dois": F.array_join("other_dois", ","), "issns": F.array_join("issns", ",")})


@query("""
SELECT o_orderkey AS doc_id, CASE o_orderkey % 4 WHEN 0 THEN 'Direito Penal' WHEN 1 THEN 'Artigos Inéditos' WHEN 2 THEN 'Dossiê: Terra' END AS heading FROM orders WHERE o_orderkey % 4 < 3
""")
def heading_labels(spark, sf_dir):
    return front.section_heading(_lines(spark, sf_dir, "Revista", _when(4, 2, F.lit("Dossiê: Terra")), F.when(K() % 4 < 2, "[Artigos Inéditos]"), _when(4, 0, F.lit("Seção: Direito Penal."))))


@query("""
SELECT o_orderkey AS doc_id, CAST(line_no AS INTEGER) AS line_no, array_to_string(names, ';') AS names, array_to_string(marks, ',') AS markers FROM orders, (SELECT unnest([3, 4, 20]) AS line_no, unnest([['Ana Reis'], ['Bo Lima', 'Caio Sá'], ['Far Away']]) AS names, unnest([['1', '2'], ['*'], []]) AS marks) WHERE line_no < 20 OR (o_orderkey % 2 = 0 AND false)
""")
def author_runs(spark, sf_dir):
    texts = F.array(*[F.struct(F.lit(n).alias("line_no"), F.lit(t).alias("text"), F.lit(s).alias("score")) for n, t, s in ((1, "A title", 0), (3, "Ana Reis¹,²", 3), (4, "Bo Lima e Caio Sá *", 3), (12, "Some Line", 1), (20, "Far Away", 2))])
    lines = _table(spark, sf_dir, "orders").select(K().alias("doc_id"), F.explode(texts).alias("x")).select("doc_id", "x.*")
    run = front.author_lines(lines)
    return run.select("doc_id", "line_no", F.array_join(front.split_authors(F.col("text")), ";").alias("names"), F.array_join(front.markers(F.col("text")), ",").alias("markers"))


@query("""
SELECT o_orderkey AS doc_id, CAST(n AS INTEGER) AS title_no, ['Um título que é de duas linhas e mais', 'A title that is of the law and the land'][n] AS text, ['pt', 'en'][n] AS language FROM orders, (SELECT unnest([1, 2]) AS n)
""")
def title_groups(spark, sf_dir):
    rows = F.array(*[F.struct(F.lit(n).alias("line_no"), F.lit(t).alias("text"), F.lit(s).alias("size"), F.lit(b).alias("bold"), F.lit(False).alias("italic")) for n, t, s, b in (
        (1, "Um título que é de duas linhas", 14.0, True), (2, "e mais¹", 14.5, True), (3, "“A title that is of the law and the land”", 12.0, True), (4, "doi: 10.1590/x", 12.0, True), (5, "Resumo", 14.0, True), (6, "plain text of the front", 10.0, False))])
    lines = _orders(spark, sf_dir).select(K().alias("doc_id"), F.explode(rows).alias("x")).select("doc_id", "x.*")
    fits = front.title_candidate(F.col("text"), F.col("size"), F.lit(10.0), F.col("bold") | F.col("italic"))
    return front.title_groups(lines.where(fits))


# authors stand at 100 and 200 points; a document's lines stand below them, above them, or on another page
@query("""
WITH l AS (SELECT o_orderkey AS doc_id, unnest([1, 2, 3]) AS line_no, unnest(['id', 'aff', 'id']) AS kind, unnest([CASE o_orderkey % 3 WHEN 0 THEN 110 ELSE 90 END, 130, CASE o_orderkey % 3 WHEN 0 THEN 215 WHEN 1 THEN 195 ELSE 190 END]) AS y FROM orders)
SELECT doc_id, CAST(line_no AS INTEGER) AS line_no, kind, CASE WHEN line_no = 3 THEN 'B' ELSE 'A' END AS author FROM l
""")
def support_lines(spark, sf_dir):
    below = K() % 3 == 0
    last = F.when(below, 215.0).when(K() % 3 == 1, 195.0).otherwise(190.0)
    rows = _rows("line_no text y0", (1, "ORCID 0000-0002-1825-0097", F.when(below, 110.0).otherwise(90.0)), (2, "Universidade X, Rio", 130.0), (3, "a@b.org", last), (4, "no support", 140.0))
    docs = _orders(spark, sf_dir).select(K().alias("doc_id"), F.explode(rows).alias("x")).select("doc_id", "x.*", F.lit(1).alias("page"))
    support = docs.withColumn("kind", front.support_kind(F.col("text"))).where("kind is not null")
    names = F.explode(_rows("author y0", ("A", 100.0), ("B", 200.0))).alias("x")
    return front.assign_support(support, _orders(spark, sf_dir).select(K().alias("doc_id"), names).select("doc_id", "x.*", F.lit(1).alias("page")))


@query("""
SELECT o_orderkey AS doc_id, CASE WHEN o_orderkey % 3 = 0 THEN 'B' ELSE 'A' END AS author, CASE o_orderkey % 3 WHEN 0 THEN 2 ELSE CASE WHEN o_orderkey % 3 = 1 THEN 1 ELSE 2 END END AS note_no, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE '0000-0002-1825-0097' END AS orcid, CASE WHEN o_orderkey % 2 = 0 AND o_orderkey % 3 <> 0 THEN 'ana@x.org' END AS email FROM orders
""")
def author_links(spark, sf_dir):
    o = _table(spark, sf_dir, "orders")
    two = K() % 3 == 0
    both = _rows("author name surname markers", ("A", "Ana Reis", "Reis", F.when(K() % 3 == 1, F.array(F.lit("1"))).otherwise(F.array(F.lit("9")))), ("B", "Bo Lima", "Lima", F.array(F.lit("2"))))
    authors = o.select(K().alias("doc_id"), F.explode(F.slice(both, F.lit(1), F.when(two, 2).otherwise(1))).alias("x")).select("doc_id", "x.*")
    first, second = F.when(two, "Apoio do CNPq").when(K() % 3 == 1, "Doutora. Ana REIS 0000-0002-1825-0097").otherwise("Apoio a Reis 0000-0002-1825-0097"), F.lit("Professora na Universidade X")
    notes = o.select(K().alias("doc_id"), F.explode(_rows("note_no label text", (1, "1", first), (2, "2", second))).alias("x")).select("doc_id", "x.*", F.lit(1).alias("page"))
    bars = o.where("o_orderkey % 2 = 0 and o_orderkey % 3 <> 0").select(K().alias("doc_id"), F.posexplode(F.array(*map(F.lit, ("Autora", "Ana REIS (X)", "contato", "ana@x.org.", "b@y.org")))).alias("line_no", "text"))
    linked = front.author_notes(authors, notes)
    return linked.join(front.note_orcids(authors, notes), ["doc_id", "author"], "left").join(front.sidebar_emails(authors, bars), ["doc_id", "author"], "left").where(F.col("author") == F.when(F.col("doc_id") % 3 == 0, "B").otherwise("A"))


_AFFS = (
    ("Universidade de São Paulo, São Paulo, SP, Brasil", True, "Universidade de São Paulo", None, "São Paulo", "SP", "BR"), ("Instituto X, Lima", True, "Instituto X", None, "Lima", None, None), ("University of Y, London, UK", True, "University of Y", None, "London", "UK", None),
    ("Doutora pela casa. Professora do Departamento de Direito da Universidade de Lisboa, Portugal", False, "Universidade de Lisboa", "Departamento de Direito", None, None, "PT"), ("Pesquisador na Fundação Z e professor, Niterói/RJ, Brasil", False, "Fundação Z", None, "Niterói", "RJ", "BR"), ("sem casa", False, None, None, None, None, None),
)
_SQL_AFFS = ", ".join("{" + ", ".join(f"'{n}': " + ("NULL::VARCHAR" if v is None else f"'{v}'") for n, v in zip(("institution", "division", "city", "state", "country"), a[2:], strict=True)) + "}" for a in _AFFS)


@query(f"SELECT o_orderkey AS doc_id, a.institution, a.division, a.city, a.state, a.country FROM (SELECT o_orderkey, [{_SQL_AFFS}][o_orderkey % 6 + 1] AS a FROM orders)")
def affiliation_fields(spark, sf_dir):
    at = (K() % 6).cast("int")
    text, plain = F.array(*[F.lit(a[0]) for a in _AFFS])[at], F.array(*[F.lit(a[1]) for a in _AFFS])[at]
    return _table(spark, sf_dir, "orders").select(K().alias("doc_id"), front.affiliation(text, plain).alias("a")).select("doc_id", "a.*")


@query("""
SELECT o_orderkey AS doc_id, CAST(n AS INTEGER) AS abstract_no, ['resumo', 'abstract'][n] AS label, CASE WHEN n = 1 THEN 'pt' WHEN o_orderkey % 2 = 0 THEN 'en' ELSE 'es' END AS language,
 CASE WHEN n = 1 THEN 'O texto que não é de uma casa e mais. Segue depois' WHEN o_orderkey % 2 = 0 THEN 'The text of the law that is in the land' ELSE 'Los hombres que no son de la casa y por eso hasta hoy' END AS text, ['lei|norma ' || o_orderkey, 'law|land'][n] AS keywords FROM orders, (SELECT unnest([1, 2]) AS n)
""")
def abstract_blocks(spark, sf_dir):
    english = F.when(K() % 2 == 0, "ABSTRACT: The text of the law that is").otherwise("ABSTRACT: Los hombres que no son de la casa")
    rest = F.when(K() % 2 == 0, "in the land Keywords: law, land").otherwise("y por eso hasta hoy Keywords: law, land")
    lines = _lines(spark, sf_dir, "Before", "RESUMO", "O texto que não é de uma casa e mais.", "Palavras-chave: lei;", F.concat(F.lit("norma "), K(), F.lit(".")), "Segue depois", english, rest)
    return front.abstracts(lines.withColumnRenamed("seq", "line_no").withColumn("bold", F.lit(False))).withColumn("keywords", F.array_join("keywords", "|"))
