"""Queries for the scalar functions, over inputs derived from the driver's tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import naming, tables, text

QUERIES, ORACLE_SQL = {}, {}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _spread(df: DataFrame) -> DataFrame:
    """df over all tasks where it has fewer partitions than these (a small file is one): for steps that cost far more than
    moving their rows. Larger inputs stay as they are."""
    tasks = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(tasks) if df.rdd.getNumPartitions() < tasks else df


#: Rows of a task in steps that take a millisecond or more for a row.
TASK_ROWS = 20_000


def _dealt(df: DataFrame, key: str, table: DataFrame) -> DataFrame:
    """df by key over tasks whose number grows with the rows of a table (which its files tell), for costly steps: Spark
    deals by bytes, which put all of a small table, or ever more rows of a large one, in one task."""
    tasks = max(df.sparkSession.sparkContext.defaultParallelism, -(-table.count() // TASK_ROWS))
    return df.repartition(tasks, key)


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


_KEY = "trim(regexp_replace(lower(strip_accents({})), '[^a-z0-9]+', ' ', 'g'))"


@query(f"SELECT doc_id, {_KEY.format('text')} AS key FROM documents")
def normalize_keys(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select("doc_id", text.normal_key(F.col("text")).alias("key"))


@query(r"""
SELECT doc_id, len(e) AS n_emails, array_to_string(e, ' ') AS emails
FROM (SELECT doc_id, regexp_extract_all(text, '[\p{L}\p{N}_.+-]+@[\p{L}\p{N}_-]+(?:\.[\p{L}\p{N}_-]+)+') AS e FROM documents) WHERE len(e) > 0
""")
def email_scan(spark, sf_dir):
    found = _table(spark, sf_dir, "documents").select("doc_id", F.regexp_extract_all("text", F.lit(text.EMAIL), F.lit(0)).alias("e")).where(F.size("e") > 0)
    return found.select("doc_id", F.size("e").cast("long").alias("n_emails"), F.array_join("e", " ").alias("emails"))


_CITED = "'See https://ex.org/a' || o_orderkey || ', doi 10.1590/x.' || o_orderkey || ').; ISSN ' || lpad(CAST(o_custkey AS VARCHAR), 4, '0') || '-123X, lattes.cnpq.br/' || o_custkey || ' orcid 0000-0002-1825-0097[^1]'"


@query(rf"""
WITH t AS (SELECT o_orderkey, {_CITED} AS t FROM orders)
SELECT o_orderkey, rtrim(regexp_extract(t, '10\.\d{{4,9}}/[^\s"<>|]+'), '.,;:)]') AS doi,
       regexp_extract(t, '(?:^|[^\d-])(\d{{4}}-\d{{3}}[\dXx])(?:[^\d-]|$)', 1) AS issn,
       regexp_extract(t, '\d{{4}}-\d{{4}}-\d{{4}}-\d{{3}}[\dXx]') AS orcid,
       regexp_extract(t, 'https?://[^\s<>"]+') AS url, regexp_extract(t, 'lattes\.cnpq\.br/\d+') AS lattes,
       regexp_replace(t, '\[\^[^\]]{{1,16}}\]', '', 'g') AS bare
FROM t
""")
def identifier_scan(spark, sf_dir):
    t = _table(spark, sf_dir, "orders").select("o_orderkey", F.expr(_CITED.replace("VARCHAR", "STRING")).alias("t"))
    first = lambda p, g=0: F.regexp_extract("t", p, g)
    return t.select("o_orderkey", text.trim_doi(first(text.DOI)).alias("doi"), first(text.ISSN, 1).alias("issn"), first(text.ORCID, 1).alias("orcid"), first(text.URL).alias("url"), first(text.LATTES).alias("lattes"), text.strip_note_calls(F.col("t")).alias("bare"))


@query("""
WITH t AS (SELECT c_custkey, lpad(CAST((c_custkey * 7919 + 1825) % 1000000000 AS VARCHAR), 15, '0') AS d FROM customer),
u AS (SELECT c_custkey, d, substr('0123456789X', CAST(c_custkey % 11 AS INTEGER) + 1, 1) AS k FROM t),
v AS (SELECT *, list_sum(list_transform(range(1, 16), lambda i: CAST(substr(d, i, 1) AS BIGINT) * (1 << CAST(16 - i AS INTEGER)))) AS total FROM u)
SELECT c_custkey, substr(d,1,4) || '-' || substr(d,5,4) || '-' || substr(d,9,4) || '-' || substr(d,13,3) || k AS orcid,
       k = substr('0123456789X', CAST((12 - total % 11) % 11 AS INTEGER) + 1, 1) AS valid FROM v
""")
def orcid_check(spark, sf_dir):
    d = F.lpad(((F.col("c_custkey") * 7919 + 1825) % 1000000000).cast("string"), 15, "0")
    k = F.substring(F.lit("0123456789X"), (F.col("c_custkey") % 11 + 1).cast("int"), F.lit(1))
    t = _table(spark, sf_dir, "customer").select("c_custkey", F.concat_ws("-", d.substr(1, 4), d.substr(5, 4), d.substr(9, 4), F.concat(d.substr(13, 3), k)).alias("orcid"))
    return t.select("c_custkey", "orcid", text.orcid_valid(F.col("orcid")).alias("valid"))


@query("""
WITH t AS (SELECT p_partkey, lpad(CAST((p_partkey * 104729) % 10000000 AS VARCHAR), 7, '0') || substr('0123456789X', CAST(p_partkey % 11 AS INTEGER) + 1, 1) AS d FROM part),
u AS (SELECT *, list_sum(list_transform(range(1, 8), lambda i: CAST(substr(d, i, 1) AS BIGINT) * (9 - i))) % 11 AS r FROM t)
SELECT p_partkey, substr(d,1,4) || '-' || substr(d,5,4) AS issn,
       substr(d, 8, 1) = CASE r WHEN 0 THEN '0' WHEN 1 THEN 'X' ELSE CAST(11 - r AS VARCHAR) END AS valid FROM u
""")
def issn_check(spark, sf_dir):
    d = F.concat(F.lpad(((F.col("p_partkey") * 104729) % 10000000).cast("string"), 7, "0"), F.substring(F.lit("0123456789X"), (F.col("p_partkey") % 11 + 1).cast("int"), F.lit(1)))
    t = _table(spark, sf_dir, "part").select("p_partkey", text.issn_canonical(F.concat(F.lit(" "), d)).alias("issn"))
    return t.select("p_partkey", "issn", text.issn_valid(F.col("issn")).alias("valid"))


def _listed(words: str) -> str:
    return "[" + ", ".join(f"'{w}'" for w in sorted(set(words.split()))) + "]"


_SCORES = ", ".join(f"{{'score': (len(list_filter(w, lambda t: list_contains({_listed(s)}, t)))" + (f" + 2 * len(list_filter(w, lambda t: list_contains({_listed(tables.OWN_WORDS[c])}, t)))" if c in tables.OWN_WORDS else "") + f") / len(w), 'code': '{c}'}}" for c, s in tables.STOP_WORDS.items())
_LANGUAGE = f"""
WITH t AS (SELECT doc_id, lang, regexp_extract_all(lower(text), '[a-záàâãéêíóôõúüçñ]+') AS w FROM documents),
s AS (SELECT doc_id, lang, len(w) AS n, CASE WHEN len(w) >= 3 THEN list_sort([{_SCORES}]) END AS s FROM t),
d AS (SELECT doc_id, lang, n, s[-1] AS a, s[-2] AS b FROM s)
SELECT doc_id, lang AS declared, CASE WHEN n >= 3 AND a.score >= 0.08 AND a.score - b.score >= 0.04 THEN a.code END AS detected,
       CASE WHEN n >= 3 THEN round(a.score, 3) ELSE 0 END AS confidence FROM d
"""


@query(_LANGUAGE)
def language_detect(spark, sf_dir):
    docs = _spread(_table(spark, sf_dir, "documents").select("doc_id", "lang", "text"))
    found = docs.select("doc_id", F.col("lang").alias("declared"), text.language(F.col("text")).alias("x"))
    return found.select("doc_id", "declared", F.col("x.lang").alias("detected"), F.col("x.confidence").alias("confidence"))


@query(f"SELECT declared, detected, count(*) AS n FROM ({_LANGUAGE}) GROUP BY declared, detected")
def lang_confusion(spark, sf_dir):
    return language_detect(spark, sf_dir).groupBy("declared", "detected").agg(F.count(F.lit(1)).alias("n"))


_MONTH = "CASE extract(month FROM o_orderdate) " + " ".join(f"WHEN {i} THEN '{m}'" for i, m in enumerate("janeiro fevereiro março abril mayo junio July august setembro octubre nov dez".split(), 1)) + " END"
_DAY, _MON, _YEAR = "CAST(extract(day FROM o_orderdate) AS {0})", "CAST(extract(month FROM o_orderdate) AS {0})", "CAST(extract(year FROM o_orderdate) AS {0})"
_PRINTED = f"""CASE o_orderkey % 6
 WHEN 0 THEN 'Em ' || lpad({_DAY},2,'0') || '/' || {_MON} || '/' || {_YEAR}
 WHEN 1 THEN {_DAY} || ' de ' || {_MONTH} || ' de ' || {_YEAR}
 WHEN 2 THEN 'on ' || {_MONTH} || ' ' || {_DAY} || ', ' || {_YEAR}
 WHEN 3 THEN {_YEAR} || '-' || lpad({_MON},2,'0') || '-' || lpad({_DAY},2,'0')
 WHEN 4 THEN 'Recebido: ' || {_DAY} || '/' || {_MON} || '/' || right({_YEAR},2)
 ELSE 'sem data' END"""


@query(f"""
SELECT o_orderkey, {_PRINTED.format('VARCHAR')} AS printed,
 CASE WHEN o_orderkey % 6 < 5 AND NOT (o_orderkey % 6 = 2 AND extract(month FROM o_orderdate) = 3) THEN strftime(o_orderdate, '%Y-%m-%d') END AS parsed FROM orders
""")
def date_forms(spark, sf_dir):
    t = _table(spark, sf_dir, "orders").select("o_orderkey", F.expr(_PRINTED.format("STRING")).alias("printed"))
    return t.select("o_orderkey", "printed", text.parse_date(F.col("printed"), 2026).alias("parsed"))


_NAME = "(array['Sara','João','Ana Maria','Van','Pedro E.'])[i % 5 + 1] || ' ' || (array['da Nova','de','dos Santos','Quadros',''])[(i // 5) % 5 + 1] || ' ' || (array['Côrtes','Silva','Souza Filho','Lima Jr.','Neto'])[(i // 25) % 5 + 1]"
_NAME_SPARK = "array('Sara','João','Ana Maria','Van','Pedro E.')[i % 5] || ' ' || array('da Nova','de','dos Santos','Quadros','')[(i div 5) % 5] || ' ' || array('Côrtes','Silva','Souza Filho','Lima Jr.','Neto')[(i div 25) % 5]"
# token by token: the last word, with the word before a suffix, then every particle before that; never the first word
@query(f"""
WITH t AS (SELECT i, string_split(regexp_replace(trim({_NAME.replace('array[', '[')}), '\\s+', ' ', 'g'), ' ') AS w FROM (SELECT c_custkey AS i FROM customer)),
s AS (SELECT *, len(w) AS n, greatest(2, CASE WHEN lower(rtrim(w[-1], '.')) IN ('junior','júnior','jr','filho','neto','sobrinho','segundo','terceiro','ii','iii') AND len(w) > 2 THEN len(w) - 1 ELSE len(w) END) AS k FROM t),
p AS (SELECT *, CASE WHEN k > 2 AND lower(w[k - 1]) IN ('de','da','do','das','dos','e','del','della','di','van','von','der','la','le','y') THEN 1 ELSE 0 END AS one FROM s),
q AS (SELECT *, k - one - CASE WHEN one = 1 AND k > 3 AND lower(w[k - 2]) IN ('de','da','do','das','dos','e','del','della','di','van','von','der','la','le','y') THEN 1 ELSE 0 END AS f FROM p)
SELECT i AS c_custkey, array_to_string(w, ' ') AS name, array_to_string(w[f:], ' ') AS surname, array_to_string(w[:f - 1], ' ') AS given FROM q
""")
def name_split(spark, sf_dir):
    t = _table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("i")).select("i", F.regexp_replace(F.trim(F.expr(_NAME_SPARK)), r"\s+", " ").alias("name"))
    return t.select(F.col("i").alias("c_custkey"), "name", text.split_name(F.col("name")).alias("x")).select("c_custkey", "name", "x.surname", "x.given")


_PLACE = "'Univ. of ' || c_name || ', ' || (list_of)[c_custkey % 7 + 1] || ' - ' || (list_of)[(c_custkey // 7) % 7 + 1] || ' (' || c_mktsegment || ')'"
_PLACES = ["São Paulo, SP", "España", "Estados Unidos da América", "Rio Grande do Sul, Brasil", "México", "Minas Gerais", "nowhere"]
_LISTED_PLACES = "[" + ", ".join(f"'{p}'" for p in _PLACES) + "]"
# what each place says of country and state, by hand
_SAID = "[{c: NULL, i: NULL, s: 'SP'}, {c: 'espana', i: 'ES', s: NULL}, {c: 'estados unidos', i: 'US', s: NULL}, {c: 'brasil', i: 'BR', s: 'RS'}, {c: 'mexico', i: 'MX', s: NULL}, {c: NULL, i: NULL, s: 'MG'}, {c: NULL, i: NULL, s: NULL}]"


@query(rf"""
WITH t AS (SELECT c_custkey, {_PLACE.replace('(list_of)', _LISTED_PLACES)} AS place, {_SAID}[c_custkey % 7 + 1] AS a, {_SAID}[(c_custkey // 7) % 7 + 1] AS b FROM customer)
SELECT c_custkey, place, coalesce(b.c, a.c) AS country, coalesce(b.i, a.i) AS iso, CASE WHEN a.s = 'SP' OR b.s = 'SP' THEN 'SP' WHEN a.s = 'RS' OR b.s = 'RS' THEN 'RS' ELSE coalesce(a.s, b.s) END AS state FROM t
""")
def place_names(spark, sf_dir):
    listed = "array(" + ", ".join(f"'{p}'" for p in _PLACES) + ")"
    place = F.expr(f"'Univ. of ' || c_name || ', ' || {listed}[c_custkey % 7] || ' - ' || {listed}[(c_custkey div 7) % 7] || ' (' || c_mktsegment || ')'")
    t = _table(spark, sf_dir, "customer").select("c_custkey", place.alias("place"))
    return t.select("c_custkey", "place", text.last_country(F.col("place")).alias("x"), text.state(F.col("place")).alias("state")).select("c_custkey", "place", F.col("x.name").alias("country"), "x.iso", "state")


_DOC = """SELECT o_orderkey, CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE '1234-5678' END AS issn, 'ab' || (o_custkey % 5) AS acronym,
  CASE WHEN o_orderkey % 11 = 0 THEN '' ELSE CAST(o_custkey % 130 AS {0}) END AS volume, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE '0' || (o_orderkey % 4) END AS number,
  CASE WHEN o_orderkey % 4 = 0 THEN 'e' || o_orderkey END AS elocation, CAST(o_orderkey % 90000 AS {0}) AS fpage, o_orderkey % 2 = 0 AS continuous,
  CASE WHEN o_orderkey % 5 > 0 THEN o_orderkey % 120 END AS batch, CAST(extract(year FROM o_orderdate) AS {0}) AS year FROM orders"""


@query(f"""
WITH d AS ({_DOC.format('VARCHAR')}),
n AS (SELECT *, nullif(trim(volume), '') AS v, CASE WHEN length(volume) = 1 THEN '0' || volume ELSE volume END AS v2,
      CASE WHEN length(number) < 2 THEN lpad(number, 2, '0') ELSE number END AS n2,
      CASE WHEN batch IS NOT NULL THEN (CASE WHEN batch < 10 THEN '0' ELSE '' END) || batch || right(year, 2) END AS code FROM d),
m AS (SELECT *, (CASE WHEN v IS NULL THEN '' ELSE 'v' || coalesce(nullif(ltrim(v, '0'), ''), '0') END) || (CASE WHEN number IS NULL THEN '' ELSE 'n' || coalesce(nullif(ltrim(number, '0'), ''), '0') END) AS tag FROM n)
SELECT o_orderkey, concat_ws('-', issn, acronym, nullif(v2, ''), n2, coalesce(elocation, CASE WHEN length(fpage) < 5 THEN lpad(fpage, 5, '0') ELSE fpage END)) AS base_name,
       code AS batch_code, CASE WHEN issn IS NOT NULL AND v IS NOT NULL AND (NOT continuous OR code IS NOT NULL) THEN concat_ws('-', issn, acronym, v2, n2, CASE WHEN continuous THEN code END) END AS folder,
       (CASE WHEN CAST(year AS INTEGER) <= 1995 THEN 'Retrô Entrega' ELSE 'Entrega' END) || ' | ' || concat_ws(' ', acronym, nullif(tag, ''), CASE WHEN continuous THEN 'Lote ' || coalesce(code, '????') ELSE year END) || ' - BR' AS title
FROM m
""")
def package_names(spark, sf_dir):
    _table(spark, sf_dir, "orders").createOrReplaceTempView("_orders_for_names")
    d = spark.sql(_DOC.format("STRING").replace("FROM orders", "FROM _orders_for_names"))
    c = F.col
    return d.select(
        "o_orderkey",
        naming.base_name(c("issn"), c("acronym"), c("volume"), c("number"), c("elocation"), c("fpage")).alias("base_name"),
        naming.batch_code(c("batch"), c("year")).alias("batch_code"),
        naming.folder_name(c("issn"), c("acronym"), c("volume"), c("number"), c("continuous"), c("batch"), c("year")).alias("folder"),
        naming.delivery_title(c("acronym"), c("volume"), c("number"), c("continuous"), c("batch"), c("year"), F.lit("BR"), 1997).alias("title"),
    )


_FILE = "CASE p_partkey % 9 WHEN 0 THEN 'art-' || p_partkey || '.xml' WHEN 1 THEN 'art_' || p_partkey || '.xml' WHEN 2 THEN 'ártico' || p_partkey || '.pdf' WHEN 3 THEN 'a.b' || p_partkey || '.tif' WHEN 4 THEN 'a b' || p_partkey || '.PNG' WHEN 5 THEN 'a' || p_partkey || '.docx' WHEN 6 THEN 'a(' || p_partkey || ').jpg' WHEN 7 THEN 'noext' || p_partkey ELSE 'X' || p_partkey || '.Html' END"


@query(f"""
WITH t AS (SELECT p_partkey, {_FILE} AS name FROM part), e AS (SELECT *, lower(regexp_extract(name, '[^.](\\.[^.]*)$', 1)) AS ext FROM t)
SELECT p_partkey, name, CASE WHEN strip_accents(name) <> name THEN 'accent' WHEN contains(name, '_') THEN 'underscore'
  WHEN contains(regexp_replace(name, '([^.])\\.[^.]*$', '\\1'), '.') THEN 'dot' WHEN contains(name, ' ') THEN 'space'
  WHEN ext NOT IN ({", ".join(f"'{x}'" for x in tables.PACKAGE_EXTENSIONS.split())}) THEN 'extension'
  WHEN NOT regexp_matches(name, '^[A-Za-z0-9][A-Za-z0-9-]*\\.[A-Za-z0-9]+$') THEN 'character' END AS fault FROM e
""")
def file_name_rules(spark, sf_dir):
    t = _table(spark, sf_dir, "part").select("p_partkey", F.expr(_FILE).alias("name"))
    return t.select("p_partkey", "name", naming.file_name_fault(F.col("name")).alias("fault"))


_LICENCES = ["CC BY 4.0", "cc-by-nc-nd", "Licença CC BY-SA-ND", "CC BY NC SA", "https://creativecommons.org/licenses/by/4.0/", "http://x.org/by", "all rights"]


@query(f"""
WITH t AS (SELECT s_suppkey, [{", ".join(f"'{x}'" for x in _LICENCES)}][s_suppkey % 7 + 1] AS said FROM supplier),
r AS (SELECT *, upper(regexp_extract(said, '(?i)\\bCC[\\s-]*BY((?:[\\s-]*(?:NC|SA|ND))*)', 1)) AS r FROM t)
SELECT s_suppkey, said, CASE WHEN said LIKE 'http%' THEN CASE WHEN regexp_matches(said, '^https?://creativecommons\\.org/licenses/') THEN said END
  WHEN regexp_matches(said, '(?i)\\bCC[\\s-]*BY') THEN 'https://creativecommons.org/licenses/by' || CASE WHEN contains(r, 'NC') THEN '-nc' ELSE '' END || CASE WHEN contains(r, 'ND') THEN '-nd' WHEN contains(r, 'SA') THEN '-sa' ELSE '' END || '/4.0/' END AS url FROM r
""")
def licence_urls(spark, sf_dir):
    said = F.array(*map(F.lit, _LICENCES))[(F.col("s_suppkey") % 7).cast("int")]
    t = _table(spark, sf_dir, "supplier").select("s_suppkey", said.alias("said"))
    return t.select("s_suppkey", "said", text.licence_url(F.col("said")).alias("url"))


@query()
def join_wrapped_lines(spark, sf_dir):
    """Hyphens at line ends and broken addresses are beyond plain SQL; a test holds the rows against a plain fold."""
    d = _table(spark, sf_dir, "documents")
    return d.select("doc_id", F.nullif(text.join_lines(F.split("text", "\n")), F.lit("")).alias("joined"))


_LABELS = ["1,2", "4-6", "3", "7 , 9-11", "9-4", "1,x", "2-60", "99"]


@query(f"""
WITH t AS (SELECT s_suppkey, [{", ".join(f"'{x}'" for x in _LABELS)}][s_suppkey % 8 + 1] AS label FROM supplier)
SELECT s_suppkey, label, CASE label WHEN '1,2' THEN '1 2' WHEN '4-6' THEN '4 5 6' WHEN '3' THEN '3' WHEN '7 , 9-11' THEN '7 9 10 11' ELSE '' END AS numbers FROM t
""")
def numeric_citations(spark, sf_dir):
    label = F.array(*map(F.lit, _LABELS))[(F.col("s_suppkey") % 8).cast("int")]
    t = _table(spark, sf_dir, "supplier").select("s_suppkey", label.alias("label"))
    return t.select("s_suppkey", "label", F.array_join(text.cited_numbers(F.col("label"), F.lit(40)), " ").alias("numbers"))


@query(r"""
SELECT s_suppkey, fpage, lpage, manual,
  coalesce(TRY_CAST(lpage AS INTEGER) - TRY_CAST(fpage AS INTEGER) + 1, TRY_CAST(manual AS INTEGER), CASE WHEN s_suppkey % 2 = 0 THEN 9 END) AS pages,
  CASE WHEN secs < 90 THEN 'now' WHEN secs < 3600 THEN (secs // 60) || ' min' WHEN secs < 86400 THEN (secs // 3600) || ' h' WHEN secs < 172800 THEN 'yesterday' ELSE (secs // 86400) || ' days' END AS ago
FROM (SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN 'e1' ELSE '10' END AS fpage, CAST(s_suppkey + 12 AS VARCHAR) AS lpage, CASE WHEN s_suppkey % 6 = 0 THEN '7' END AS manual, s_suppkey * 3001 AS secs FROM supplier)
""")
def page_totals(spark, sf_dir):
    k = F.col("s_suppkey")
    t = _table(spark, sf_dir, "supplier").select(k, F.when(k % 3 == 0, "e1").otherwise("10").alias("fpage"), (k + 12).cast("string").alias("lpage"), F.when(k % 6 == 0, "7").alias("manual"))
    return t.select("s_suppkey", "fpage", "lpage", "manual", naming.page_total(F.col("fpage"), F.col("lpage"), F.col("manual"), F.lit(9), k % 2 == 1).alias("pages"), naming.how_long_ago(k * 3001).alias("ago"))


@query(r"""
WITH t AS (SELECT s_suppkey, ['1 Introdução','Metodologia','RESULTADOS E DISCUSSÃO','Conclusões','Estudo de caso','Outra'][s_suppkey % 6 + 1] AS title FROM supplier)
SELECT s_suppkey, title, ['intro','methods','results','conclusions','cases',NULL][s_suppkey % 6 + 1] AS kind,
  ['1 Introdução','Metodologia','Resultados E Discussão','Conclusões','Estudo de caso','Outra'][s_suppkey % 6 + 1] AS shown FROM t
""")
def section_titles(spark, sf_dir):
    titles = ["1 Introdução", "Metodologia", "RESULTADOS E DISCUSSÃO", "Conclusões", "Estudo de caso", "Outra"]
    t = _table(spark, sf_dir, "supplier").select("s_suppkey", F.array(*map(F.lit, titles))[(F.col("s_suppkey") % 6).cast("int")].alias("title"))
    return t.select("s_suppkey", "title", text.section_type(F.col("title")).alias("kind"), text.title_case(F.col("title")).alias("shown"))
