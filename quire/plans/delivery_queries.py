"""Queries for folds, gates and delivery."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.operators import delivery, folds

from .front_queries import K, _rows
from .scalar_queries import _table

QUERIES, ORACLE_SQL = {}, {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


@query("""
WITH RECURSIVE a AS (SELECT event_id, user_id % 20 AS k, epoch_us(ts) AS t, event_type AS ip, row_number() OVER (PARTITION BY user_id % 20 ORDER BY epoch_us(ts), event_id) AS r FROM events),
f AS (SELECT DISTINCT k, 0::BIGINT AS r, NULL::BIGINT AS event_id, false AS kept, -1000000000000::BIGINT AS last, '' AS ip FROM a
 UNION ALL SELECT a.k, a.r, a.event_id, a.t - f.last >= 60000000 OR a.ip <> f.ip, CASE WHEN a.t - f.last >= 60000000 OR a.ip <> f.ip THEN a.t ELSE f.last END, CASE WHEN a.t - f.last >= 60000000 OR a.ip <> f.ip THEN a.ip ELSE f.ip END FROM f JOIN a ON a.k = f.k AND a.r = f.r + 1),
o AS (SELECT event_id, coalesce(lag(user_id) OVER w = user_id AND lag(strftime(ts, '%Y-%m-%d %H:%M')) OVER w = strftime(ts, '%Y-%m-%d %H:%M'), false) AS same FROM events WINDOW w AS (PARTITION BY user_id % 20 ORDER BY ts, event_id))
SELECT f.event_id, k, kept, NOT same AS opened FROM f JOIN o USING (event_id) WHERE r > 0
""")
def kept_activity(spark, sf_dir):
    e = _table(spark, sf_dir, "events").select("event_id", (F.col("user_id") % 20).alias("k"), "ts", F.col("event_type").alias("ip"), "user_id")
    kept = folds.kept_activity(e, "k", "ts", "event_id", "ip")
    opened = folds.kept_openings(e, "k", "ts", "event_id", "user_id").select("event_id", F.col("kept").alias("opened"))
    return kept.join(opened, "event_id").select("event_id", "k", "kept", "opened")


@query("""
SELECT o_orderkey AS doc, CAST(n AS INTEGER) AS n, CASE o_orderkey % 3 WHEN 0 THEN [NULL, NULL, NULL, 'approved by the chief only', 'not approved'][n] WHEN 1 THEN ['not ready', NULL, NULL, NULL, NULL][n] ELSE [NULL, 'not ready', NULL, 'approved by the chief only', 'not ready'][n] END AS refused FROM orders, (SELECT unnest([1, 2, 3, 4, 5]) AS n)
""")
def stage_gates(spark, sf_dir):
    # 0: approved, then made anew; 1: approved too early, then rightly; 2: never ready
    kinds = [("generate", "approve", "generate"), ("approve", "generate", "approve"), ("generate", "approve", "generate")]
    kind = lambda i: F.array(*[F.lit(k[i]) for k in kinds])[(K() % 3).cast("int")]
    rows = _rows("n kind stage", *[(i + 1, kind(i), "") for i in range(3)], (4, "move", "approved"), (5, "move", "delivered"))
    events = _table(spark, sf_dir, "orders").select(K().alias("doc"), F.explode(rows).alias("x")).select("doc", "x.*").withColumns({"at": F.col("n"), "ready": F.col("doc") % 3 < 2, "needs_chief": F.lit(True)})
    return delivery.stage_gates(events, "doc", "at", "n").select("doc", "n", "refused")


_FAULTS = ("too many documents", "document not found", "not processed", "not ready", "in a batch already", "not released", "no xml", "several issues", "journal not listed", "no volume", "same base name", "no folder name", "folder exists", None)


@query("SELECT n AS batch, [{}][n] AS fault FROM (SELECT unnest(range(1, 15)) AS n)".format(", ".join("NULL" if f is None else f"'{f}'" for f in _FAULTS)))
def batch_faults(spark, sf_dir):
    # every batch has one fault of its own, the last one none
    b, p = F.col("batch"), F.col("pos")
    rows = spark.range(1, 15).select(F.col("id").alias("batch"), F.explode(F.sequence(F.lit(1), F.lit(6))).alias("pos")).where((p <= 2) | (b == 1))
    rows = rows.withColumn("doc_id", b * 10 + p)
    bad = lambda n, x, y: F.when((b == n) & (p == 2), x).otherwise(y)
    docs = rows.where((b != 2) | (p != 2)).select(
        "doc_id", bad(3, False, True).alias("processed"), bad(4, False, True).alias("ready"), bad(5, F.lit("x"), None).alias("batch_folder"), bad(6, False, True).alias("released"), bad(7, None, F.when(b == 11, F.lit("same")).otherwise(F.col("doc_id").cast("string"))).alias("base"),
        F.when(b == 9, "other").otherwise("rdp").alias("journal"), F.when(b == 10, None).otherwise("12").alias("volume"), bad(8, F.lit("2"), F.lit("1")).alias("issue"),
    )
    asked = rows.select("batch", "pos", "doc_id", F.when(b == 12, None).when(b == 13, "there").otherwise(b.cast("string")).alias("folder"))
    return delivery.batch_faults(asked, docs, spark.createDataFrame([("rdp",)], "journal string"), spark.createDataFrame([("there",)], "folder string"))


@query("""
WITH k AS (SELECT n_nationkey AS n FROM nation), i AS (SELECT n, unnest(['zip format', 'file names', 'one folder of the package''s name', 'folder name', '1 to 5 xml', 'pdf', 'report', 'image formats', 'cited files', 'dtd', 'schematron']) AS item, unnest([n % 2 > 0, n % 3 > 0, n % 5 > 0, true, true, n % 7 > 0, n % 11 > 0, true, n % 7 > 0, n % 13 > 0, n % 17 > 0 AND n % 4 > 0]) AS ok FROM k)
SELECT 'pk' || n AS package, item, ok FROM i UNION ALL SELECT 'pk' || n, 'all', bool_and(ok) FROM i GROUP BY n
""")
def package_checks(spark, sf_dir):
    n = F.col("n_nationkey")
    k = _table(spark, sf_dir, "nation").select(n, F.concat(F.lit("pk"), n).alias("package"))
    inside = lambda name: F.concat(F.col("package"), F.lit("/"), name if not isinstance(name, str) else F.lit(name))
    paths = F.array_compact(F.array(inside("a-1.xml"), F.when(n % 7 > 0, inside("a-1.PDF")), F.when(n % 11 > 0, inside("xpm.html")), F.when(n % 5 == 0, F.lit("loose.png")), F.when(n % 3 == 0, inside("b_1.png"))))
    files = k.select("n_nationkey", "package", F.concat(F.lit("out/"), "package", F.when(n % 2 > 0, ".zip").otherwise(".rar")).alias("archive"), F.explode(paths).alias("path"))
    cited = k.select("package", F.lit("a-1.PDF").alias("name"))
    valid = k.select("package", F.lit("a-1.xml").alias("name"), (n % 13 > 0).alias("dtd"), F.when(n % 4 > 0, n % 17 > 0).alias("schematron"))
    return delivery.package_checklist(files.drop("n_nationkey"), cited, valid)


@query("""
WITH c AS (SELECT c_custkey AS usr, c_custkey % 7 AS journal, 'reader' AS role FROM customer WHERE c_custkey % 2 = 0), h AS (SELECT user_id AS usr, user_id % 7 AS journal, arg_max(CASE WHEN event_type = 'click' THEN '' ELSE event_type END, (ts, event_id)) AS role FROM events GROUP BY user_id)
SELECT coalesce(c.usr, h.usr) AS usr, coalesce(c.journal, h.journal) AS journal, coalesce(h.role, c.role) AS role FROM c FULL JOIN h ON c.usr = h.usr AND c.journal = h.journal WHERE coalesce(h.role, c.role) <> ''
""")
def role_upserts(spark, sf_dir):
    current = _table(spark, sf_dir, "customer").where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("usr"), (F.col("c_custkey") % 7).alias("journal"), F.lit("reader").alias("role"))
    changes = _table(spark, sf_dir, "events").select(F.col("user_id").alias("usr"), (F.col("user_id") % 7).alias("journal"), "ts", "event_id", F.when(F.col("event_type") != "click", F.col("event_type")).alias("role"))
    return delivery.upserted(current, changes, ["usr", "journal"], "ts", "event_id", "role")


@query("""
WITH r AS (SELECT o_orderkey AS id, o_custkey % 40 AS i, o_custkey % 3 AS org FROM orders), j AS (SELECT s_suppkey AS j, s_suppkey % 4 AS owner FROM supplier)
SELECT id AS request_id, CASE WHEN j IS NOT NULL AND (owner = 3 OR owner = org) THEN 'j' || j WHEN j IS NULL AND id % 2 = 0 AND id % 3 > 0 AND id % 5 > 0 THEN 'new' || i END AS journal,
 CASE WHEN j IS NOT NULL AND (owner = 3 OR owner = org) THEN 'found' WHEN j IS NOT NULL THEN 'elsewhere' WHEN id % 2 > 0 THEN 'unknown' WHEN id % 3 = 0 THEN 'incomplete' WHEN id % 5 = 0 THEN 'refused' ELSE 'created' END AS outcome FROM r LEFT JOIN j ON j = i
""")
def journal_by_issn(spark, sf_dir):
    i = F.col("o_custkey") % 40
    asked = _table(spark, sf_dir, "orders").select(K().alias("request_id"), F.concat(F.lit("x-"), i).alias("issn"), (F.col("o_custkey") % 3).alias("org"), (K() % 2 == 0).alias("answered"), (K() % 3 > 0).alias("complete"), (K() % 5 > 0).alias("may_create"), F.concat(F.lit("new"), i).alias("suggested"))
    s = F.col("s_suppkey")
    number = F.concat(F.lit("X-"), s)
    journals = _table(spark, sf_dir, "supplier").select(F.concat(F.lit("j"), s).alias("journal"), F.when(s % 2 == 0, number).alias("issn_epub"), F.when(s % 2 == 1, number).alias("issn_ppub"), F.when(s % 4 < 3, s % 4).alias("org"))
    return delivery.find_or_create(asked, journals)


@query("""
SELECT o_orderkey AS upload, CASE o_orderkey % 9 WHEN 0 THEN 'no file' WHEN 1 THEN 'too many files' WHEN 2 THEN 'format' WHEN 3 THEN 'e-mail not confirmed' WHEN 4 THEN 'too large' WHEN 5 THEN 'journal out of reach' WHEN 6 THEN 'role doesn''t send' END AS reason, o_orderkey % 9 = 8 AS queued FROM orders
""")
def upload_admissions(spark, sf_dir):
    m = K() % 9
    names = F.when(m == 0, F.array(F.lit(None).cast("string"))).when(m == 1, F.array_repeat(F.lit("a.pdf"), 21)).when(m == 2, F.array(F.lit("a.pdf"), F.lit("b.odt"))).when(m == 8, F.array(F.lit("a.PDF"), F.lit("b.docx"))).otherwise(F.array(F.lit("a.pdf")))
    rows = _table(spark, sf_dir, "orders").select(K().alias("upload"), F.explode(names).alias("file"), F.when(m == 4, 60_000_000).otherwise(10).alias("bytes"), (m != 3).alias("confirmed"), (m != 5).alias("in_reach"), (m != 6).alias("may_send"))
    return delivery.admissions(rows)


@query("""
SELECT o_orderkey AS doc_id, unnest(CASE WHEN o_orderkey % 2 = 0 THEN ['financiamento', 'ia', 'editor', 'conflito'] ELSE ['ia', 'editor', 'conflito'] END) AS kind, CAST(unnest(CASE WHEN o_orderkey % 2 = 0 THEN [1, 3, 5, 6] ELSE [3, 5, 6] END) AS BIGINT) AS block_no FROM orders
""")
def declared_blocks(spark, sf_dir):
    blocks = _rows("block_no title text", (1, "Financiamento e agradecimento:", "CNPq"), (2, "Editorial process dates", "2020"), (3, "Declaração de IA", "Não."), (4, "Funding", " "), (5, "Editores responsáveis", "Ana"), (6, "Editor e conflito de interesses", "Nenhum"), (7, "Anexo", "x"))
    # agradecimentos comes before financiamento, but is filled by hand; in odd documents both are
    filled = _table(spark, sf_dir, "orders").select(K().alias("doc_id"), F.explode(F.when(K() % 2 == 0, F.array(F.lit("agradecimentos"))).otherwise(F.array(F.lit("agradecimentos"), F.lit("financiamento")))).alias("kind"))
    return delivery.declarations(_table(spark, sf_dir, "orders").select(K().alias("doc_id"), F.explode(blocks).alias("b")).select("doc_id", "b.*"), filled).select("doc_id", "kind", "block_no")
