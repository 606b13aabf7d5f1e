"""Queries for record functions and form operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.functions import records
from quire.operators import forms

from .scalar_queries import _dealt, _table

QUERIES, ORACLE_SQL = {}, {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def _pick(key: str, *values):
    return F.array(*map(F.lit, values))[(F.col(key) % len(values)).cast("int")]


@query("""
SELECT s_suppkey, ['Ciências Sociais Aplicadas (Direito, Administração, Economia)','Ciências da Saúde','Ciências Biológicas','Ciências Exatas e da Terra','Engenharias','Ciências Agrárias','Linguística, Letras e Artes','Ciências Humanas',''][s_suppkey % 9 + 1] AS area FROM supplier
""")
def subject_areas(spark, sf_dir):
    said = _pick("s_suppkey", "Law and Health", "Saúde pública", "Marine ecology", "Computers", "Technology", "Agronomia", "Letras", "Ensino de História", "paralegal outlawed")
    return _table(spark, sf_dir, "supplier").select("s_suppkey", records.subject_area(said, F.lit(None).cast("string")).alias("area"))


@query("""
SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN 'SILVA, J. A.; ONU. ' WHEN 1 THEN '[authors unread]. ' ELSE 'A1, x; A2, x; A3, x; A4, x; A5, x; A6, x. ' END || 'A title ' || o_orderkey || '. ' || CASE WHEN o_orderkey % 2 = 0 THEN 'Revista X, ' ELSE '' END || 'v. ' || (o_custkey % 40) || CASE WHEN o_orderkey % 4 = 0 THEN ', n. 2' ELSE '' END || CASE WHEN o_orderkey % 5 = 0 THEN ', e12' ELSE ', p. ' || (o_custkey % 90) END || ', ' || CAST(extract(year FROM o_orderdate) AS VARCHAR) || '.' || CASE WHEN o_orderkey % 7 = 0 THEN '' ELSE ' DOI: https://doi.org/10.1/' || o_orderkey || '.' END AS cite FROM orders
""")
def own_citations(spark, sf_dir):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    people = "array<struct<surname:string,given:string>>"
    authors = F.when(k % 3 == 0, F.expr(f"cast(array(struct('Silva', 'J. A.'), struct('ONU', null)) as {people})")).when(k % 3 == 2, F.expr(f"cast(transform(sequence(1, 7), i -> struct(concat('a', i), 'x')) as {people})"))
    some = lambda test, x: F.when(test, x)
    cite = records.own_citation(authors, F.concat(F.lit("A title "), k, F.lit(".")), some(k % 2 == 0, "Revista X"), (c % 40).cast("string"), some(k % 4 == 0, "2"), some(k % 5 == 0, "e12"), (c % 90).cast("string"), F.year("o_orderdate").cast("string"), some(k % 7 != 0, F.concat(F.lit("10.1/"), k)))
    return _table(spark, sf_dir, "orders").select(k, cite.alias("cite"))


@query("""
SELECT s_suppkey, ['dgv', 'rab', NULL, 'abcdfg'][s_suppkey % 4 + 1] AS code, CASE s_suppkey % 3 WHEN 0 THEN 'Ana Reis. ORCID: https://orcid.org/0000-0002-1825-0097' WHEN 1 THEN 'Ana Reis. Lattes: http://lattes.cnpq.br/1' ELSE '' END AS editor FROM supplier
""")
def journal_lines(spark, sf_dir):
    k = F.col("s_suppkey")
    title = _pick("s_suppkey", "Revista de Direito GV (Getúlio Vargas)", "Revista: Râs & Álgebra Básica", "Journal of the Law", "Alpha beta Gama? da Delta de Chi, Fi e Gi Hipo").alias("t")
    title = _pick("s_suppkey", "Revista de Direito Getúlio Vargas", "Râs & Álgebra Básica", "Journal of the Law", "Ar Bar Car Dar Far Gar Har Iar").alias("t")
    name = F.when(k % 3 < 2, " Ana Reis ")
    editor = records.editor_line(name, F.when(k % 3 == 0, "https://orcid.org/0000-0002-1825-0097"), F.when(k % 3 == 1, "http://lattes.cnpq.br/1"))
    return _table(spark, sf_dir, "supplier").select(k, title, editor.alias("editor")).select("s_suppkey", records.journal_code(F.col("t")).alias("code"), "editor")


@query("""
SELECT event_id, strftime(ts - INTERVAL 3 HOUR, '%d/%m/%Y %H:%M') AS shown, strftime(ts - INTERVAL 3 HOUR, '%d/%m/%Y') AS day, CAST(greatest(1, (event_id % 500 + 59) // 60) AS INTEGER) AS minutes, event_id % 500 <= 300 AS online,
 strftime(ts, '%d/%m/%Y') AS day_first, upper(regexp_replace('ab-' || event_id || ' x', '[^A-Za-z0-9]', '', 'g')) AS invite, (event_id % 3, event_id % 12) > (1, 9) AS newer FROM events
""")
def zone_times(spark, sf_dir):
    e = F.col("event_id")
    iso = F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.when(e % 2 == 0, "+00:00").otherwise(""))
    version = F.concat_ws(".", e % 3, e % 12)
    at = records.zoned(iso)
    return _table(spark, sf_dir, "events").select(
        "event_id", records.shown_time(at).alias("shown"), records.shown_time(at, with_hour=False).alias("day"), records.wait_minutes(e % 500).alias("minutes"), records.online(e % 500).alias("online"),
        records.day_first(F.date_format("ts", "yyyy-MM-dd")).alias("day_first"), records.invite_code(F.concat(F.lit("ab-"), e, F.lit(" x"))).alias("invite"), (records.version_key(version) > records.version_key(F.lit("1.9"))).alias("newer"),
    )


_RGB = "SELECT p_partkey, p_partkey * 7919 % 256 AS r, p_partkey * 104729 % 256 AS g, p_partkey * 31 % 256 AS b FROM part"
_LIN = "CASE WHEN {0} / 255.0 <= 0.03928 THEN {0} / 255.0 / 12.92 ELSE pow(({0} / 255.0 + 0.055) / 1.055, 2.4) END"


@query(f"""
WITH l AS (SELECT *, 0.2126 * {_LIN.format('r')} + 0.7152 * {_LIN.format('g')} + 0.0722 * {_LIN.format('b')} AS l FROM ({_RGB}))
SELECT p_partkey, round(1.05 / (l + 0.05), 6) AS on_white, round((l + 0.05) / 0.05, 6) AS on_black, '#' || printf('%02X%02X%02X', CAST(round_even(r * 0.25 + 191.25, 0) AS INTEGER), CAST(round_even(g * 0.25 + 191.25, 0) AS INTEGER), CAST(round_even(b * 0.25 + 191.25, 0) AS INTEGER)) AS mixed FROM l
""")
def contrast_ratios(spark, sf_dir):
    k = F.col("p_partkey")
    two = lambda n: F.lpad(F.hex(k * n % 256), 2, "0")
    t = _table(spark, sf_dir, "part").select(k, F.concat(F.lit("#"), two(7919), two(104729), two(31)).alias("c"))
    c = F.col("c")
    return t.select(k, F.round(records.contrast(c, F.lit("#FFFFFF")), 6).alias("on_white"), F.round(records.contrast(c, F.lit("#000000")), 6).alias("on_black"), records.mixed(c, F.lit("#FFFFFF"), F.lit(0.25)).alias("mixed"))


@query("""
WITH f AS (SELECT c_custkey AS form_id, CASE c_custkey % 5 WHEN 0 THEN 'J' || c_custkey % 7 WHEN 1 THEN 'new' || c_custkey WHEN 2 THEN '9x' WHEN 3 THEN 'j3' ELSE ' RDP ' END AS acronym, c_custkey % 5 = 3 AS keeps FROM customer),
e AS (SELECT form_id, 'acronym' AS field, CASE WHEN acronym = '9x' THEN 'form' WHEN lower(trim(acronym)) IN ('j0','j1','j2','j3','j4') AND NOT keeps THEN 'taken' END AS reason FROM f
 UNION ALL SELECT form_id, 'title', CASE WHEN form_id % 4 = 0 THEN 'missing' END FROM f
 UNION ALL SELECT form_id, 'publisher', CASE WHEN form_id % 2 = 0 THEN 'missing' END FROM f
 UNION ALL SELECT form_id, 'issn_epub', ['missing', NULL, 'form', 'form', NULL][form_id % 5 + 1] FROM f
 UNION ALL SELECT form_id, 'doi_prefix', CASE WHEN form_id % 3 = 1 THEN 'form' END FROM f
 UNION ALL SELECT form_id, 'licence_url', CASE WHEN form_id % 6 = 0 THEN 'unlisted' END FROM f
 UNION ALL SELECT form_id, 'area', CASE WHEN form_id % 7 = 0 THEN 'unlisted' END FROM f
 UNION ALL SELECT form_id, 'site', CASE WHEN form_id % 8 = 0 THEN 'form' END FROM f
 UNION ALL SELECT form_id, 'editor_orcid', CASE WHEN form_id % 9 = 0 THEN 'form' END FROM f
 UNION ALL SELECT form_id, 'editorial_email', CASE WHEN form_id % 10 = 0 THEN 'form' END FROM f
 UNION ALL SELECT form_id, 'language', CASE WHEN form_id % 11 = 0 THEN 'unlisted' END FROM f)
SELECT * FROM e WHERE reason IS NOT NULL
""")
def journal_form_errors(spark, sf_dir):
    k = F.col("c_custkey")
    acronym = F.when(k % 5 == 0, F.concat(F.lit("J"), k % 7)).when(k % 5 == 1, F.concat(F.lit("new"), k)).when(k % 5 == 2, "9x").when(k % 5 == 3, "j3").otherwise(" RDP ")
    by = lambda n, bad, good: F.when(k % n == 0, bad).otherwise(good)
    customers = _table(spark, sf_dir, "customer")
    form = _dealt(customers, "c_custkey", customers).select(
        k.alias("form_id"), acronym.alias("acronym"), F.when(k % 5 == 3, "j3").alias("current"), by(4, " ", "T").alias("title"), F.lit("T").alias("short_title"), by(2, None, "P").alias("publisher"),
        _pick("c_custkey", "", "2179-8966", "2179-8967", "x", "0034-8910").alias("issn_epub"), F.lit(None).cast("string").alias("issn_ppub"), F.when(k % 3 == 1, "11.1234").when(k % 3 == 2, "10.1234/a").alias("doi_prefix"),
        by(6, "x", "http://l").alias("licence_url"), by(7, "Other", "Law").alias("area"), F.lit(None).cast("string").alias("style"), by(8, "www.x", "https://x").alias("site"), F.lit("http://lattes.cnpq.br/1").alias("editor_lattes"),
        by(9, "0000-0002-1825-0098", "https://orcid.org/0000-0002-1825-0097").alias("editor_orcid"), by(10, "a@b", "a@b.org").alias("editorial_email"), by(11, "xx", "pt").alias("language"),
    )
    existing = spark.range(5).select(F.concat(F.lit("j"), "id").alias("acronym"))
    return forms.journal_errors(form, existing, ["http://l"], ["Law"], ["ABNT"])


@query("""
WITH u AS (SELECT s_suppkey AS user_id, 'u' || s_suppkey || '@x.org' AS email FROM supplier), r AS (SELECT o_orderkey AS id, CASE o_orderkey % 4 WHEN 0 THEN 'U' || (o_custkey % 150) || '@x.org' WHEN 1 THEN 'admin' WHEN 2 THEN 'a b@c.d' ELSE 'n' || o_orderkey || '@x.org' END AS email, CASE WHEN o_orderkey % 8 = 0 THEN o_custkey % 150 END AS own FROM orders),
e AS (SELECT id, 'email' AS field, CASE WHEN id % 4 = 2 THEN 'form' WHEN u.user_id IS NOT NULL AND (own IS NULL OR own <> u.user_id) THEN 'taken' END AS reason FROM r LEFT JOIN u ON u.email = lower(r.email)
 UNION ALL SELECT id, 'name', CASE WHEN id % 5 = 0 THEN 'missing' END FROM r UNION ALL SELECT id, 'role', CASE WHEN id % 6 = 0 THEN 'unlisted' END FROM r UNION ALL SELECT id, 'password', CASE WHEN id % 9 < 8 THEN 'short' END FROM r)
SELECT id AS request_id, field, reason FROM e WHERE reason IS NOT NULL
""")
def account_form_errors(spark, sf_dir):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    users = _table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("user_id"), F.concat(F.lit("u"), "s_suppkey", F.lit("@x.org")).alias("email"))
    email = F.when(k % 4 == 0, F.concat(F.lit("U"), c % 150, F.lit("@x.org"))).when(k % 4 == 1, "admin").when(k % 4 == 2, "a b@c.d").otherwise(F.concat(F.lit("n"), k, F.lit("@x.org")))
    asked = _table(spark, sf_dir, "orders").select(k.alias("request_id"), F.when(k % 8 == 0, c % 150).alias("user_id"), email.alias("email"), F.when(k % 5 == 0, " ").otherwise("N").alias("name"), F.when(k % 6 == 0, "x").otherwise("admin").alias("role"), F.repeat(F.lit("p"), (k % 9).cast("int")).alias("password"))
    return forms.account_errors(asked, users)


@query("""
SELECT r.c_custkey AS request_id, 'name' AS field, CASE WHEN c_custkey % 5 = 0 THEN 'form' ELSE 'taken' END AS reason FROM customer r LEFT JOIN nation n ON n.n_nationkey = r.c_custkey % 40 WHERE c_custkey % 5 = 0 OR (n_nationkey IS NOT NULL AND c_custkey % 3 > 0)
""")
def organisation_form_errors(spark, sf_dir):
    k = F.col("c_custkey")
    orgs = _table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("org_id"), F.concat(F.lit("Org "), "n_nationkey").alias("name"))
    name = F.when(k % 5 == 0, " a ").otherwise(F.concat(F.lit(" ORG   "), k % 40))
    asked = _table(spark, sf_dir, "customer").select(k.alias("request_id"), F.when(k % 3 == 0, (k % 40).cast("int")).alias("org_id"), name.alias("name"))
    return forms.organisation_errors(asked, orgs)


@query("""
SELECT event_id AS message_id, field, reason FROM (SELECT event_id, 'to' AS field, CASE event_id % 4 WHEN 0 THEN 'missing' WHEN 1 THEN 'form' END AS reason FROM events UNION ALL SELECT event_id, 'subject', CASE WHEN event_id % 6 = 0 THEN 'missing' END FROM events) WHERE reason IS NOT NULL
""")
def message_form_errors(spark, sf_dir):
    e = F.col("event_id")
    to = F.when(e % 4 == 0, " ; ").when(e % 4 == 1, "a@b.org, bad").otherwise("a@b.org;c@d.org")
    return forms.message_errors(_table(spark, sf_dir, "events").select(e.alias("message_id"), to.alias("to"), F.when(e % 6 == 0, " ").otherwise("s").alias("subject")))


@query("""
SELECT event_id AS message_id, ts AS at FROM events WHERE event_type = 'click' AND (event_id % 100 = 42 OR contains(lower(coalesce(props, '')), '42'))
""")
def mailbox_list(spark, sf_dir):
    e = _table(spark, sf_dir, "events").select(F.col("event_id").alias("message_id"), F.col("event_type").alias("box"), F.when(F.col("event_id") % 100 == 42, "No 42").otherwise("Other").alias("subject"), F.lit(None).cast("string").alias("to"), F.lit("x@y").alias("from"), F.col("props").alias("text"), F.col("ts").alias("at"))
    return forms.mailbox(e, "click", "42").select("message_id", "at")


@query("""
WITH i AS (SELECT l_orderkey, l_linenumber, l_quantity < 5 AS removed, l_discount > 0.04 AS empty, l_partkey FROM lineitem), m AS (SELECT l_orderkey, max(l_linenumber) AS last FROM i WHERE NOT empty GROUP BY l_orderkey)
SELECT l_orderkey, l_linenumber, l_partkey FROM i JOIN m USING (l_orderkey) WHERE l_linenumber <= last AND NOT removed
""")
def live_items(spark, sf_dir):
    i = _table(spark, sf_dir, "lineitem")
    return forms.live_items(i, ["l_orderkey"], "l_linenumber", F.col("l_quantity") < 5, F.col("l_discount") > 0.04).select("l_orderkey", "l_linenumber", "l_partkey")


_NOTES = "SELECT n_nationkey // 10 || '.' || n_nationkey % 10 AS version, '2024-' || lpad(CAST(n_nationkey // 3 + 1 AS VARCHAR), 2, '0') || '-05' AS date, unnest([['todos','operador','admin'][n_nationkey % 3 + 1], ['operador','admin','admin'][n_nationkey % 3 + 1]]) AS audience, unnest(['Item', 'Painel']) AS title, n_nationkey AS n FROM nation"
_SEEN = f"SELECT role, version, date, n, count(*) AS n_items FROM ({_NOTES}) JOIN (SELECT unnest(['cliente','operador','admin']) AS role) ON audience = 'todos' OR (audience = 'operador' AND role <> 'cliente') OR (audience = 'admin' AND role = 'admin') GROUP BY ALL"


def _notes(spark, sf_dir):
    k = F.col("n_nationkey")
    pick = lambda *v: F.array(*map(F.lit, v))[k % 3]
    two = F.explode(F.array(F.struct(pick("todos", "operador", "admin").alias("audience"), F.lit("Item").alias("title")), F.struct(pick("operador", "admin", "admin").alias("audience"), F.lit("Painel").alias("title")))).alias("x")
    date = F.concat(F.lit("2024-"), F.lpad((F.floor(k / 3) + 1).cast("string"), 2, "0"), F.lit("-05"))
    return _table(spark, sf_dir, "nation").select(F.concat_ws(".", F.floor(k / 10), k % 10).alias("version"), date.alias("date"), two).select("version", "date", "x.audience", "x.title", F.lit("text").alias("text"))


@query(f"SELECT role, version, date, n_items FROM ({_SEEN})")
def visible_notes(spark, sf_dir):
    return forms.visible_notes(_notes(spark, sf_dir), spark.createDataFrame([(r,) for r in forms.ROLES], "role string"))


@query(f"""
WITH v AS (SELECT DISTINCT version, date, n FROM ({_NOTES})), u AS (SELECT c_custkey AS usr, ['cliente','operador','admin',NULL][c_custkey % 4 + 1] AS role, CASE WHEN c_custkey % 3 = 0 THEN c_custkey % 25 END AS seen, CASE WHEN c_custkey % 3 = 1 THEN '2024-' || lpad(CAST(c_custkey % 12 + 1 AS VARCHAR), 2, '0') || '-05T10:00' END AS access FROM customer),
b AS (SELECT usr, coalesce(role, 'cliente') AS role, CASE WHEN seen IS NOT NULL THEN seen WHEN access IS NULL THEN 24 ELSE (SELECT max(n) FROM v WHERE v.date < left(access, 10)) END AS base FROM u)
SELECT usr AS "user", version, n_items FROM b JOIN ({_SEEN}) s ON s.role = b.role AND (base IS NULL OR s.n > base)
""")
def pending_notes(spark, sf_dir):
    k = F.col("c_custkey")
    users = _table(spark, sf_dir, "customer").select(
        k.alias("user"), _pick("c_custkey", "cliente", "operador", "admin", None).alias("role"), F.when(k % 3 == 0, F.concat_ws(".", F.floor(k % 25 / 10), k % 25 % 10)).alias("seen"),
        F.when(k % 3 == 1, F.concat(F.lit("2024-"), F.lpad((k % 12 + 1).cast("string"), 2, "0"), F.lit("-05T10:00"))).alias("last_access"), F.lit(None).cast("string").alias("created"),
    )
    return forms.pending_notes(users, _notes(spark, sf_dir))


@query(f"SELECT role, (SELECT s2.version FROM ({_SEEN}) s2 WHERE s2.role = s.role ORDER BY s2.n DESC LIMIT 1 OFFSET 1) AS baseline FROM (SELECT DISTINCT role FROM ({_SEEN})) s")
def notes_again(spark, sf_dir):
    return forms.baseline_to_show_again(_notes(spark, sf_dir), spark.createDataFrame([(r,) for r in forms.ROLES], "role string"))


@query("SELECT 'v' || s_suppkey AS version, unnest(CASE s_suppkey % 4 WHEN 0 THEN ['speaks of administration'] WHEN 1 THEN ['malformed'] WHEN 2 THEN ['twice'] ELSE [] END) AS fault FROM supplier")
def note_faults(spark, sf_dir):
    k = F.col("s_suppkey")
    one = lambda d, a, t: F.struct(F.lit(d).alias("date"), a.alias("audience"), t.alias("title"))
    items = F.array(one("d1", F.when(k % 4 == 1, "nobody").otherwise("todos"), F.when(k % 4 == 0, "O Painel novo").otherwise("Item")), one("d1", F.lit("admin"), F.lit("Painel")))
    items = F.when(k % 4 == 2, F.concat(items, F.array(one("d2", F.lit("todos"), F.lit("Item"))))).otherwise(items)
    return forms.note_faults(_table(spark, sf_dir, "supplier").select(F.concat(F.lit("v"), k).alias("version"), F.explode(items).alias("x")).select("version", "x.*", F.lit("t").alias("text")))


@query("""
SELECT n_nationkey AS org_id, n_name AS name, coalesce(members, 0) AS members, coalesce(names, '') AS names, coalesce(docs, 0) AS docs, coalesce(journals, 0) AS journals FROM nation
LEFT JOIN (SELECT c_nationkey, count(*) AS members, string_agg(c_name || CASE WHEN c_custkey % 60 = 0 THEN ' (admin)' ELSE '' END, ', ' ORDER BY c_name || CASE WHEN c_custkey % 60 = 0 THEN ' (admin)' ELSE '' END) AS names FROM customer WHERE c_nationkey < 20 GROUP BY c_nationkey) m ON c_nationkey = n_nationkey
LEFT JOIN (SELECT o_orderkey % 30 AS d, count(*) AS docs FROM orders GROUP BY d) ON d = n_nationkey LEFT JOIN (SELECT s_nationkey, count(*) AS journals FROM supplier GROUP BY s_nationkey) ON s_nationkey = n_nationkey
""")
def organisation_totals(spark, sf_dir):
    orgs = _table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("org_id"), F.col("n_name").alias("name"))
    people = _table(spark, sf_dir, "customer").where("c_nationkey < 20").select(F.col("c_nationkey").alias("org_id"), F.col("c_custkey").alias("user"), F.col("c_name").alias("name"), (F.col("c_custkey") % 60 == 0).alias("is_admin"))
    return forms.organisation_totals(orgs, people, _table(spark, sf_dir, "orders").select((F.col("o_orderkey") % 30).cast("int").alias("org_id")), _table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("org_id")))


@query("SELECT l_orderkey AS doc_id, l_linenumber AS ref_no FROM lineitem l WHERE NOT EXISTS (SELECT 1 FROM lineitem c WHERE c.l_orderkey = l.l_orderkey AND c.l_partkey % 7 = l.l_linenumber)")
def uncited_references(spark, sf_dir):
    i = _table(spark, sf_dir, "lineitem")
    return forms.uncited(i.select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").cast("long").alias("ref_no")), i.select(F.col("l_orderkey").alias("doc_id"), (F.col("l_partkey") % 7).alias("ref_no"))).select("doc_id", F.col("ref_no").cast("int").alias("ref_no"))


@query("""
WITH h AS (SELECT o_orderkey, 'a-gf' || o_orderkey % 50 || '.jpg' AS href FROM orders), f AS (SELECT s_suppkey, 'img/a-gf' || s_suppkey || '.tif' AS file FROM supplier)
SELECT o_orderkey, href, file FROM h LEFT JOIN f ON regexp_replace(file, '^.*/|[.][^.]*$', '', 'g') = regexp_replace(href, '[.][^.]*$', '')
""")
def image_files(spark, sf_dir):
    hrefs = _table(spark, sf_dir, "orders").select("o_orderkey", F.concat(F.lit("a-gf"), F.col("o_orderkey") % 50, F.lit(".jpg")).alias("href"))
    files = _table(spark, sf_dir, "supplier").select(F.concat(F.lit("img/a-gf"), "s_suppkey", F.lit(".tif")).alias("file"))
    stems = files.withColumn("stem", records.file_stem(F.col("file")))
    return hrefs.withColumn("stem", records.file_stem(F.col("href"))).join(stems, "stem", "left").select("o_orderkey", "href", "file")


@query("""
SELECT coalesce(a.d, b.d) AS doc_id, coalesce(citations, 0) AS citations, coalesce(r, 0) AS "references", coalesce(high, 0) AS high, coalesce(medium, 0) AS medium, coalesce(low, 0) AS low, coalesce(fig, 0) AS figure, coalesce(tab, 0) AS "table", 0 AS equation, coalesce(note, 0) AS note
FROM (SELECT o_custkey AS d, count(DISTINCT (o_orderstatus, extract(year FROM o_orderdate))) AS citations, count(*) FILTER (o_orderkey % 3 = 0) AS fig, count(*) FILTER (o_orderkey % 3 = 1) AS tab, count(*) FILTER (o_orderkey % 3 = 2) AS note FROM orders GROUP BY o_custkey) a
FULL JOIN (SELECT l_suppkey AS d, count(*) AS r, count(*) FILTER (l_returnflag = 'A') AS high, count(*) FILTER (l_returnflag = 'N') AS medium, count(*) FILTER (l_returnflag NOT IN ('A', 'N')) AS low FROM lineitem GROUP BY l_suppkey) b ON a.d = b.d
""")
def document_counters(spark, sf_dir):
    o, i = _table(spark, sf_dir, "orders"), _table(spark, sf_dir, "lineitem")
    cites = o.select(F.col("o_custkey").alias("doc_id"), F.col("o_orderstatus").alias("author"), F.year("o_orderdate").alias("year"))
    refs = i.select(F.col("l_suppkey").alias("doc_id"), F.when(F.col("l_returnflag") == "A", "high").when(F.col("l_returnflag") == "N", "medium").otherwise("low").alias("confidence"))
    return forms.document_counters(cites, refs, o.select(F.col("o_custkey").alias("doc_id"), _pick("o_orderkey", "figure", "table", "note").alias("kind")))


@query("""
SELECT o_orderkey AS doc_id, o_custkey AS table_no, left('Caption ' || o_orderkey, 10) AS caption, CAST(o_orderkey % 7 AS INTEGER) AS rows, array_to_string(list_transform(range(1, least(o_orderkey % 7, 4) + 1), lambda i: i || ',x'), ';') AS preview FROM orders
""")
def table_previews(spark, sf_dir):
    k = F.col("o_orderkey")
    cells = F.transform(F.slice(F.sequence(F.lit(1), F.lit(7)), F.lit(1), (k % 7).cast("int")), lambda i: F.array(i.cast("string"), F.lit("x")))
    t = _table(spark, sf_dir, "orders").select(k.alias("doc_id"), F.col("o_custkey").alias("table_no"), F.concat(F.lit("Caption "), k).alias("caption"), cells.alias("cells"))
    return forms.previews(t, chars=10).withColumn("preview", F.array_join(F.transform("preview", lambda r: F.array_join(r, ",")), ";"))


@query("SELECT p_size AS place, arg_max(p_partkey, (p_partkey % 5 * (p_partkey % 4), -p_partkey)) AS grid_no FROM part GROUP BY p_size")
def best_grids(spark, sf_dir):
    k = F.col("p_partkey")
    return forms.best_grid(_table(spark, sf_dir, "part").select(F.col("p_size").alias("place"), k.alias("grid_no"), (k % 5).alias("rows"), (k % 4).alias("cols")), ["place"])


@query("SELECT l_orderkey AS doc_id, l_linenumber AS line_no, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY round_even(l_quantity / 2, 0), l_extendedprice, l_linenumber) AS INTEGER) AS place, array_to_string(list_distinct_in_order, ',') AS kinds FROM lineitem JOIN (SELECT l_orderkey AS o, list(f ORDER BY first, f) AS list_distinct_in_order FROM (SELECT l_orderkey, l_returnflag AS f, min(l_linenumber * 1000000 + l_partkey) AS first FROM lineitem GROUP BY ALL) GROUP BY l_orderkey) ON o = l_orderkey")
def reading_order(spark, sf_dir):
    i = _table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("line_no"), F.col("l_quantity").alias("y0"), F.col("l_extendedprice").alias("x0"), (F.col("l_linenumber") * 1000000 + F.col("l_partkey")).alias("seq"), F.col("l_returnflag").alias("flag"))
    kinds = i.groupBy("doc_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("seq", "flag"))), lambda s: s["flag"]).alias("flags")).select("doc_id", F.array_join(forms.distinct_in_order(F.col("flags")), ",").alias("kinds"))
    return forms.in_reading_order(i, ["doc_id"]).join(kinds, "doc_id").select("doc_id", "line_no", "place", "kinds")
