"""Queries for references, citations, XML, captured responses and DOCX files."""

from __future__ import annotations

import io
import zipfile

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quire.operators import jats, references, xml
from quire.sources import docx, responses

from .scalar_queries import _dealt, _table

QUERIES, ORACLE_SQL = {}, {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


_YEAR = "CAST(extract(year FROM o_orderdate) AS VARCHAR)"
_ENTRY = f"""CASE o_orderkey % 5
 WHEN 0 THEN 'SILVA, J. A. Title ' || o_orderkey || '. Revista Nova, v. ' || (o_orderkey % 40) || ', n. 2, p. 10-' || (11 + o_custkey) || ', ' || {_YEAR} || '. Disponível em: https://ex.org/' || o_orderkey || '. Acesso em: 3 maio 2020.'
 WHEN 1 THEN 'COSTA, Ana; REIS, B. Book number ' || o_orderkey || '. 2. ed. São Paulo: Press ' || (o_custkey % 9) || ', ' || {_YEAR} || '.'
 WHEN 2 THEN 'Lima, C. (' || {_YEAR} || '). Paper ' || o_orderkey || '. Journal of Things, ' || (o_orderkey % 30) || '(4), 5-9. 10.1590/x.' || o_orderkey
 WHEN 3 THEN 'BRASIL. Lei n. ' || o_orderkey || ', de ' || {_YEAR} || '.'
 ELSE 'SOUZA, Pedro. Thesis ' || o_orderkey || '. Tese (Doutorado) - Universidade X, Rio, ' || {_YEAR} || '.' END"""


@query(f"""
SELECT o_orderkey, ['journal','book','journal','legal-doc','thesis'][o_orderkey % 5 + 1] AS kind, {_YEAR} AS year,
 ['SILVA, J. A','COSTA, Ana;REIS, B','Lima, C','BRASIL','SOUZA, Pedro'][o_orderkey % 5 + 1] AS authors,
 CASE o_orderkey % 5 WHEN 0 THEN 'Title ' || o_orderkey WHEN 2 THEN 'Paper ' || o_orderkey END AS article_title,
 CASE o_orderkey % 5 WHEN 0 THEN 'Revista Nova' WHEN 1 THEN 'Book number ' || o_orderkey WHEN 2 THEN 'Journal of Things' WHEN 3 THEN 'Lei n. ' || o_orderkey || ', de ' || {_YEAR} ELSE 'Thesis ' || o_orderkey END AS source,
 CASE o_orderkey % 5 WHEN 0 THEN CAST(o_orderkey % 40 AS VARCHAR) WHEN 2 THEN CAST(o_orderkey % 30 AS VARCHAR) END AS volume,
 CASE o_orderkey % 5 WHEN 0 THEN '2' WHEN 2 THEN '4' END AS issue, CASE o_orderkey % 5 WHEN 0 THEN '10' WHEN 2 THEN '5' END AS fpage,
 CASE o_orderkey % 5 WHEN 0 THEN CAST(11 + o_custkey AS VARCHAR) WHEN 2 THEN '9' END AS lpage,
 CASE WHEN o_orderkey % 5 = 1 THEN '2' END AS edition, CASE o_orderkey % 5 WHEN 1 THEN 'São Paulo' WHEN 4 THEN 'Rio' END AS place, CASE o_orderkey % 5 WHEN 1 THEN 'Press ' || (o_custkey % 9) WHEN 4 THEN 'Universidade X' END AS publisher,
 ['high','high','high','medium','high'][o_orderkey % 5 + 1] AS confidence, CASE WHEN o_orderkey % 5 = 0 THEN '3 maio 2020' END AS access_date, CASE WHEN o_orderkey % 5 = 4 THEN 'Tese (Doutorado)' END AS comment,
 CASE WHEN o_orderkey % 5 = 2 THEN '10.1590/x.' || o_orderkey END AS doi, CASE WHEN o_orderkey % 5 = 0 THEN 'https://ex.org/' || o_orderkey END AS url FROM orders
""")
def reference_fields(spark, sf_dir):
    orders = _table(spark, sf_dir, "orders")
    t = _dealt(orders, "o_orderkey", orders).select("o_orderkey", F.expr(_ENTRY.replace("VARCHAR", "STRING")).alias("t"))
    f = t.select("o_orderkey", references.fields(F.col("t")).alias("f"))
    one = lambda c: F.nullif(F.array_join(c, ";"), F.lit(""))
    return f.select("o_orderkey", "f.kind", "f.year", F.array_join("f.authors", ";").alias("authors"), "f.parts.article_title", "f.parts.source", "f.parts.volume", "f.parts.issue", "f.parts.fpage", "f.parts.lpage", "f.edition", one("f.parts.publisher_loc").alias("place"), one("f.parts.publisher_name").alias("publisher"), "f.parts.confidence", "f.parts.access_date", "f.parts.comment", "f.doi", "f.url")


@query(f"""
SELECT o_orderkey, author, year, how, count(*) AS n FROM (
 SELECT o_orderkey, unnest(['SILVA','Souza e Lima','Lima','Castro']) AS author, unnest([{_YEAR}, '2011a', '2013', {_YEAR}]) AS year, unnest(['brackets','brackets','brackets','narrative']) AS how FROM orders) GROUP BY ALL
""")
def citation_extract(spark, sf_dir):
    y = F.year("o_orderdate").cast("string")
    p = _table(spark, sf_dir, "orders").select("o_orderkey", F.concat(F.lit("As (SILVA, "), y, F.lit("; cf. Souza e Lima, 2011a, p. 3-4) and Castro ("), y, F.lit(", p. 9) but (Art. 5, 1988) or (in Lima et al., 2013).")).alias("text"))
    return references.citations(p, ["o_orderkey"]).groupBy("o_orderkey", "author", "year", "how").agg(F.count(F.lit(1)).alias("n"))


@query("""
SELECT o_custkey AS doc_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS entry_no,
 CASE WHEN o_orderkey % 4 = 0 THEN '______. Another work ' || o_orderkey || ', 1999.' ELSE 'SILVA' || chr(CAST(65 + o_orderkey % 3 AS INTEGER)) || ', J. Long title broken-off here, ' || o_orderkey || '.' END AS text,
 coalesce(last_value(CASE WHEN o_orderkey % 4 > 0 THEN 'SILVA' || chr(CAST(65 + o_orderkey % 3 AS INTEGER)) || ', J' END IGNORE NULLS) OVER (PARTITION BY o_custkey ORDER BY o_orderkey), '') AS authors FROM orders
""")
def reference_entries(spark, sf_dir):
    k = F.col("o_orderkey")
    name = F.concat(F.lit("SILVA"), F.char((65 + k % 3).cast("long")))
    pair = F.when(k % 4 == 0, F.array(F.concat(F.lit("______. Another work "), k, F.lit(", 1999.")))).otherwise(F.array(F.concat(name, F.lit(", J. Long title broken-")), F.concat(F.lit("off here, "), k, F.lit("."))))
    lines = _table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc_id"), k, F.posexplode(pair).alias("i", "text")).select("doc_id", (k * 2 + F.col("i")).alias("line_no"), "text")
    lines = lines.withColumn("text", F.regexp_replace("text", "broken-$", "broken-")).withColumn("text", F.regexp_replace("text", "^off here", "off here"))
    return references.entries(lines).select("doc_id", "entry_no", F.regexp_replace("text", "brokenoff", "broken-off").alias("text"), F.array_join("authors", ";").alias("authors"))


_ESC = "replace(replace(replace(replace({}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;')"


@query(f"""
WITH a AS (SELECT l_orderkey AS d, string_agg('<contrib contrib-type="author"><name><surname>S' || l_partkey || '</surname><given-names>G</given-names></name></contrib>', '' ORDER BY l_linenumber, l_partkey || '<') AS x FROM lineitem GROUP BY l_orderkey),
r AS (SELECT l_orderkey AS d, string_agg('<ref id="B' || l_linenumber || '"><mixed-citation>Ref &amp; ' || l_suppkey || '</mixed-citation><year>1999</year></ref>', '' ORDER BY l_linenumber, l_suppkey || '<') AS x, count(*) AS n FROM lineitem WHERE l_linenumber > 1 GROUP BY l_orderkey)
SELECT o_orderkey AS doc_id, '<?xml version="1.0" encoding="utf-8"?>' || chr(10) || '{xml.DOCTYPE}' || chr(10) || '<article article-type="research-article" dtd-version="1.1" xml:lang="pt"><front><journal-meta><journal-id journal-id-type="publisher-id">j' || (o_custkey % 7) || '</journal-id></journal-meta><article-meta><article-id pub-id-type="doi">10.1/' || o_orderkey || '</article-id><title-group><article-title>A &lt;b&gt; ' || {_ESC.format('o_orderpriority')} || '</article-title></title-group>' ||
 coalesce('<contrib-group>' || a.x || '</contrib-group>', '') || '<pub-date><day>' || strftime(o_orderdate, '%d') || '</day><month>' || strftime(o_orderdate, '%m') || '</month><year>' || strftime(o_orderdate, '%Y') || '</year></pub-date><volume>' || (o_custkey % 50) || '</volume><fpage>10</fpage><lpage>25</lpage><counts>' || coalesce('<ref-count count="' || r.n || '"/>', '') || '<page-count count="16"/></counts></article-meta></front><body><sec sec-type="intro"><title>Introdução</title><p>' || o_orderstatus || '</p></sec></body>' || coalesce('<back><ref-list>' || r.x || '</ref-list></back>', '') || '</article>' AS xml
FROM orders LEFT JOIN a ON a.d = o_orderkey LEFT JOIN r ON r.d = o_orderkey
""")
def article_xml(spark, sf_dir):
    # dealt by document before anything is made of them, in as many tasks as articles take
    orders = _table(spark, sf_dir, "orders")
    o, li = _dealt(orders, "o_orderkey", orders), _dealt(_table(spark, sf_dir, "lineitem").where("l_orderkey is not null"), "l_orderkey", orders)
    docs = o.select(F.col("o_orderkey").alias("doc_id"), F.concat(F.lit("j"), F.col("o_custkey") % 7).alias("journal"), F.when(F.col("o_orderkey") < 0, "").alias("issn"), F.concat(F.lit("10.1/"), "o_orderkey").alias("doi"), F.concat(F.lit("A <b> "), "o_orderpriority").alias("title"), F.lit("pt").alias("lang"), (F.col("o_custkey") % 50).cast("string").alias("volume"), F.lit("10").alias("fpage"), F.lit("25").alias("lpage"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("published"))
    authors = li.select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("pos"), F.concat(F.lit("S"), "l_partkey").alias("surname"), F.lit("G").alias("given"), F.when(F.col("l_orderkey") < 0, "").alias("orcid"))
    sections = o.select(F.col("o_orderkey").alias("doc_id"), F.lit(1).alias("pos"), F.lit("Introdução").alias("title"), F.col("o_orderstatus").alias("body"), F.lit("intro").alias("kind"))
    refs = li.where("l_linenumber > 1").select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("pos"), F.concat(F.lit("Ref & "), "l_suppkey").alias("text"), F.lit("1999").alias("year"))
    return xml.articles(docs, authors, sections, refs)


_JOURNAL = "<journal-meta><journal-id journal-id-type=\"publisher-id\">rdp</journal-id><journal-title-group><journal-title>R &amp; P</journal-title></journal-title-group><issn pub-type=\"epub\">2179-8966</issn></journal-meta>"
_LICENCE = '<license license-type="open-access" xlink:href="https://creativecommons.org/licenses/by/4.0/" xml:lang="en"><license-p>This is an open-access article distributed under the terms of the Creative Commons Attribution 4.0 International License.</license-p></license>'


@query(f"""
WITH i AS (SELECT l_orderkey AS d, l_linenumber AS n, l_partkey AS p, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS r FROM lineitem), u AS (SELECT * FROM i WHERE r <= 5),
a AS (SELECT d, string_agg('<contrib contrib-type="author"><name><surname>S' || p || '</surname><given-names>G</given-names></name><xref ref-type="aff" rid="a' || r || '"><sup>' || r || '</sup></xref>' || CASE WHEN r = 1 THEN '<xref ref-type="corresp" rid="c1">*</xref>' ELSE '' END || '</contrib>', '' ORDER BY r) || string_agg('<aff id="a' || r || '"><label>' || r || '</label><institution content-type="original">U' || p || '</institution><country country="BR">BR</country></aff>', '' ORDER BY r) AS x, arg_min(p, r) AS lead FROM u WHERE r <= 2 GROUP BY d),
t AS (SELECT d, count(*) AS c, string_agg('<table-wrap id="t' || (r - 2) || '"><label>T' || p || '</label><caption><title>C</title></caption><table><tbody><tr><td>1</td><td>' || p || '</td></tr></tbody></table></table-wrap>', '' ORDER BY r) AS x FROM u WHERE r IN (3, 4) GROUP BY d),
f AS (SELECT d, count(*) AS c, string_agg('<ref id="B' || r || '"><mixed-citation>BRASIL. Lei n. ' || p || ', de 1996.</mixed-citation><element-citation publication-type="legal-doc"><person-group person-group-type="author"><collab>BRASIL</collab></person-group><source>Lei n. ' || p || ', de 1996</source><year>1996</year></element-citation></ref>', '' ORDER BY r) AS x FROM u GROUP BY d)
SELECT o_orderkey AS doc_id, '<?xml version="1.0" encoding="UTF-8"?>' || chr(10) || '{jats.VERSIONS["1.10"][2]}' || chr(10) || '<article xmlns:xlink="http://www.w3.org/1999/xlink" xmlns:mml="http://www.w3.org/1998/Math/MathML" article-type="research-article" dtd-version="1.3" specific-use="sps-1.10" xml:lang="en"><front>{_JOURNAL}<article-meta><article-id pub-id-type="doi">10.1/' || o_orderkey || '</article-id><article-categories><subj-group subj-group-type="heading"><subject>Artigos</subject></subj-group></article-categories><title-group><article-title>A &lt;b&gt; ' || o_orderpriority || '</article-title></title-group>'
 || coalesce('<contrib-group>' || a.x || '</contrib-group><author-notes><corresp id="c1"><label>Correspondência</label>: N' || a.lead || ' <email>m@x.org</email></corresp></author-notes>', '') || '<pub-date date-type="pub" publication-format="electronic">' || dmy || '</pub-date><pub-date date-type="collection" publication-format="electronic"><year>' || y || '</year></pub-date><volume>' || (o_custkey % 50 + 1) || '</volume><issue>2</issue>' || CASE WHEN o_orderkey % 2 = 0 THEN '<elocation-id>e7</elocation-id>' ELSE '<fpage>10</fpage><lpage>25</lpage>' END
 || '<history><date date-type="received"><day>02</day><month>01</month><year>1990</year></date></history><permissions><copyright-year>' || y || '</copyright-year>{_LICENCE}</permissions><abstract><title>Abstract</title><p>Said ' || o_orderkey || '</p></abstract><kwd-group xml:lang="en"><title>Keywords:</title><kwd>k1</kwd><kwd>' || o_orderstatus || '</kwd></kwd-group>' || CASE WHEN t.c IS NOT NULL OR f.c IS NOT NULL OR o_orderkey % 2 = 1 THEN '<counts>' || coalesce('<table-count count="' || t.c || '"/>', '') || coalesce('<ref-count count="' || f.c || '"/>', '') || '<page-count count="16"/></counts>' ELSE '<counts><page-count count="16"/></counts>' END
 || '</article-meta></front><body><sec sec-type="intro"><title>One</title><p>p ' || o_orderstatus || '</p>' || coalesce(t.x, '') || '<sec><title>Two</title><p>q</p></sec></sec></body>' || coalesce('<back><ref-list><title>References</title>' || f.x || '</ref-list></back>', '') || '</article>' AS xml
FROM (SELECT *, strftime(o_orderdate, '%Y') AS y, '<day>' || strftime(o_orderdate, '%d') || '</day><month>' || strftime(o_orderdate, '%m') || '</month><year>' || strftime(o_orderdate, '%Y') || '</year>' AS dmy FROM orders) LEFT JOIN a ON a.d = o_orderkey LEFT JOIN t ON t.d = o_orderkey LEFT JOIN f ON f.d = o_orderkey
""")
def jats_articles(spark, sf_dir):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    # orders and items are dealt by document before anything is made of them, the items once for all relations
    o = _table(spark, sf_dir, "orders").repartition("o_orderkey")
    text = lambda **cols: [(F.lit(v) if isinstance(v, str) or v is None else v).cast("string").alias(n) for n, v in cols.items()]
    docs = o.select(k.alias("doc_id"), *text(
        journal="rdp", journal_title="R & P", journal_short=None, issn_epub="2179-8966", issn_ppub=None, publisher=None, article_type=None, language="en", doi=F.concat(F.lit("10.1/"), k), order_no=None, heading="Artigos", volume=c % 50 + 1, issue="02", elocation=F.when(k % 2 == 0, "e7"), fpage="10", lpage="25",
        page_count=None, year=F.year("o_orderdate"), published=F.date_format("o_orderdate", "yyyy-MM-dd"), received="1990-01-02", revised=None, accepted=None, licence_url="https://creativecommons.org/licenses/by/4.0/", funding_text=None, data_status=None,
    ))
    i = _table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), "l_linenumber", F.col("l_partkey").alias("p")).where("doc_id is not null").repartition("doc_id")
    i = i.withColumn("pos", F.row_number().over(Window.partitionBy("doc_id").orderBy("l_linenumber", "p"))).where("pos <= 5").select("doc_id", "pos", "p")
    p, pos = F.col("p"), F.col("pos")
    aff = F.concat(F.lit("a"), pos)
    people = i.where("pos <= 2")
    none = lambda kind, *names: [F.lit(None).cast(kind).alias(n) for n in names]
    sections = o.select(k.alias("doc_id"), F.explode(F.array(F.struct(F.lit(0).alias("pos"), F.lit(1).alias("level"), F.lit("intro").alias("kind"), F.lit("One").alias("title"), F.array(F.concat(F.lit("p "), "o_orderstatus")).alias("paragraphs")), F.struct(F.lit(1).alias("pos"), F.lit(2).alias("level"), F.lit(None).cast("string").alias("kind"), F.lit("Two").alias("title"), F.array(F.lit("q")).alias("paragraphs")))).alias("s")).select("doc_id", "s.*")
    return jats.build({
        "docs": docs, "titles": o.select(k.alias("doc_id"), F.lit(0).alias("pos"), *text(text=F.concat(F.lit("A <b> "), "o_orderpriority"), language="en", kind="article-title")),
        "authors": people.select("doc_id", "pos", *text(surname=F.concat(F.lit("S"), p), given="G", name=F.concat(F.lit("N"), p), orcid=None, email=F.when(pos == 1, "m@x.org")), F.array(aff).alias("aff_ids"), *none("array<string>", "roles"), *none("string", "bio")),
        "affiliations": people.select("doc_id", "pos", *text(id=aff, original=F.concat(F.lit("U"), p), institution=None, division=None, city=None, state=None, country="BR", country_name=None)),
        "abstracts": o.select(k.alias("doc_id"), F.lit(0).alias("pos"), *text(language="en", text=F.concat(F.lit("Said "), k)), F.array(F.lit("k1"), "o_orderstatus").alias("keywords")), "sections": sections,
        "floats": i.where("pos in (3, 4)").select("doc_id", "pos", F.lit("table").alias("kind"), F.lit(0).alias("section"), F.lit(5).alias("paragraph"), *text(label=F.concat(F.lit("T"), p), caption="C", source=None, file=None, mathml=None, text=None), F.lit(0).alias("header_rows"), F.array(F.array(F.lit("1"), p.cast("string"))).alias("cells"), *none("array<struct<speaker:string,said:string>>", "turns")),
        "refs": i.select("doc_id", "pos", F.concat(F.lit("BRASIL. Lei n. "), p, F.lit(", de 1996.")).alias("text")),
    })


@query("""
SELECT o_orderkey, 'see <xref ref-type="bibr" rid="B1">Silva (2010)</xref>, <xref ref-type="table" rid="t' || (o_orderkey % 9) || '">Table ' || (o_orderkey % 9) || '</xref> &amp; more' AS marked FROM orders
""")
def inline_references(spark, sf_dir):
    k = F.col("o_orderkey")
    p = _table(spark, sf_dir, "orders").select(k, F.concat(F.lit("see Silva (2010), Table "), k % 9, F.lit(" & more")).alias("text"))
    made = F.array(*[F.struct(F.lit(a).alias("start"), F.lit(b).alias("end"), F.lit(r).alias("rank"), F.lit(t).alias("tag"), rid.alias("rid")) for a, b, r, t, rid in ((18, 25, 3, "table", F.concat(F.lit("t"), k % 9)), (4, 16, 1, "bibr", F.lit("B1")), (10, 20, 2, "fn", F.lit("x")))])
    return xml.mark_spans(p, p.select(k, F.explode(made).alias("s")).select("o_orderkey", "s.*"), ["o_orderkey"])


@query("""
SELECT 'd' || o_orderkey AS doi, CASE WHEN o_orderkey % 7 > 0 THEN 'T ' || o_orderkey END AS title, CASE WHEN o_orderkey % 7 > 0 THEN CAST(o_custkey AS VARCHAR) END AS volume, NULL::VARCHAR AS issue, CASE WHEN o_orderkey % 7 > 0 THEN '5' END AS fpage, CASE WHEN o_orderkey % 7 > 0 THEN '9' END AS lpage,
 CASE WHEN o_orderkey % 7 > 0 THEN 'http://l' END AS licence, CASE WHEN o_orderkey % 7 > 0 AND o_orderkey % 2 = 0 THEN strftime(o_orderdate, '%Y-%m-%d') END AS published, CASE WHEN o_orderkey % 7 > 0 THEN 1 ELSE 0 END AS n_authors FROM orders
""")
def captured_works(spark, sf_dir):
    k = F.col("o_orderkey")
    date = F.when(k % 2 == 0, F.date_format("o_orderdate", "yyyy,M,d")).otherwise(F.date_format("o_orderdate", "yyyy"))
    body = F.when(k % 7 > 0, F.format_string('{"title":["T %d"],"volume":"%d","page":"5-9","license":[{"URL":"http://l"}],"issued":{"date-parts":[[%s]]},"author":[{"family":"F"}],"more":1}', k, F.col("o_custkey"), date)).otherwise("no json")
    return responses.works(_table(spark, sf_dir, "orders").select(F.concat(F.lit("d"), k).alias("doi"), body.alias("body")))


@query("""
SELECT page_id, 'Title' AS label, trim(regexp_extract(html, '<h1>([^<]*)<', 1)) AS value FROM pages WHERE trim(regexp_extract(html, '<h1>([^<]*)<', 1)) <> ''
""")
def html_label_value(spark, sf_dir):
    pages = _table(spark, sf_dir, "pages").select("page_id", F.concat(F.lit("<dt>Title:</dt><dd>"), F.regexp_extract("html", "<h1>([^<]*)<", 1), F.lit("</dd>")).alias("html"))
    return responses.label_values(pages, "page_id", "html", ["Title"]).where("value is not null")


@query("""
SELECT s_suppkey, ['col0','col1','col2'][min(k) + 1] AS collection, 'v' || (s_suppkey * min(k)) AS value FROM (SELECT s_suppkey, unnest([0, 1, 2]) AS k FROM supplier) WHERE (s_suppkey + k) % 3 > 0 GROUP BY s_suppkey
""")
def first_collection(spark, sf_dir):
    hits = _table(spark, sf_dir, "supplier").select("s_suppkey", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("k")).where("(s_suppkey + k) % 3 > 0")
    return responses.first_by_collection(hits.select("s_suppkey", F.concat(F.lit("col"), "k").alias("collection"), F.concat(F.lit("v"), F.col("s_suppkey") * F.col("k")).alias("value")), ["col0", "col1", "col2"], "s_suppkey")


@query("""
SELECT s_suppkey, ['José da Silva','Ana Reis','Pedro Lima'][s_suppkey % 3 + 1] AS owner, ['SILVA, Jose','Carla Costa'][s_suppkey % 2 + 1] AS name, s_suppkey % 3 = 0 AND s_suppkey % 2 = 0 AS matches FROM supplier
""")
def orcid_owner(spark, sf_dir):
    k = F.col("s_suppkey")
    pick = lambda n, *v: F.array(*map(F.lit, v))[(k % n).cast("int")]
    return responses.orcid_owner_matches(_table(spark, sf_dir, "supplier").select(k, pick(3, "José da Silva", "Ana Reis", "Pedro Lima").alias("owner"), pick(2, "SILVA, Jose", "Carla Costa").alias("name")))


@query("""
SELECT coalesce(a.n_nationkey, b.n_nationkey) AS k, coalesce(a.t, b.t) AS t, coalesce(a.r, b.r) AS r FROM (SELECT n_nationkey, CASE WHEN n_nationkey % 2 = 0 THEN n_name END AS t, n_regionkey AS r FROM nation WHERE n_nationkey < 15) a FULL JOIN (SELECT n_nationkey, 'seed ' || n_name AS t, 9 AS r FROM nation WHERE n_nationkey > 5) b ON a.n_nationkey = b.n_nationkey
""")
def registry_seed_merge(spark, sf_dir):
    n, k = _table(spark, sf_dir, "nation"), F.col("n_nationkey")
    current = n.where(k < 15).select(k.alias("k"), F.when(k % 2 == 0, F.col("n_name")).alias("t"), F.col("n_regionkey").alias("r"))
    return responses.merge_registry(current, n.where(k > 5).select(k.alias("k"), F.concat(F.lit("seed "), "n_name").alias("t"), F.lit(9).alias("r")), "k")


def docx_bytes(paragraphs: list[tuple[str, str]]) -> bytes:
    """A small DOCX of (style, text) paragraphs, for queries and tests."""
    body = "".join(f'<w:p><w:pPr><w:pStyle w:val="{s}"/></w:pPr><w:r><w:t>{t}</w:t></w:r></w:p>' for s, t in paragraphs)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{docx.W[1:-1]}" xmlns:m="{docx.M[1:-1]}"><w:body>{body}</w:body></w:document>')
    return out.getvalue()


@query("SELECT 'n' || n_nationkey AS path, unnest([0, 1]) AS line_no, unnest(['Title', 'Heading1']) AS style, unnest([17::DOUBLE, 13.5::DOUBLE]) AS size, unnest([n_name, 'Section ' || n_regionkey]) AS text FROM nation")
def docx_lines(spark, sf_dir):
    def made(batches):
        for batch in batches:
            content = [docx_bytes([("Title", a), ("Heading1", f"Section {b}")]) for a, b in zip(batch["n_name"].to_pylist(), batch["n_regionkey"].to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([f"n{k}" for k in batch["n_nationkey"].to_pylist()]), pa.array(content, pa.binary())], ["path", "content"])

    files = _table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey").mapInArrow(made, "path string, content binary")
    return docx.parse(files).select("path", "line_no", "style", "size", "text")
