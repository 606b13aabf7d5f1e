"""Queries for the overlay, rule, workflow and report operators, over records derived from the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.operators import folds, overlay, reports, rules, workflow

from .scalar_queries import _table

QUERIES, ORACLE_SQL = {}, {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


_FORM = """
WITH base AS (SELECT p_partkey, unnest(['name','brand','size']) AS field, unnest([p_name, p_brand, CAST(p_size AS VARCHAR)]) AS value FROM part),
form AS (SELECT p_partkey, field, CASE WHEN (p_partkey + length(field)) % 5 = 0 THEN '  ' WHEN (p_partkey + length(field)) % 7 = 0 THEN '99' ELSE value END AS value FROM base)
"""
_DIFF = _FORM + ", edits AS (SELECT f.p_partkey, f.field, nullif(trim(f.value), '') AS value FROM form f JOIN base b ON f.p_partkey = b.p_partkey AND f.field = b.field WHERE nullif(trim(f.value), '') IS DISTINCT FROM nullif(trim(b.value), ''))"


def _parts(spark, sf_dir):
    return _table(spark, sf_dir, "part").select("p_partkey", F.col("p_name").alias("name"), F.col("p_brand").alias("brand"), F.col("p_size").alias("size"))


def _edits(spark, sf_dir):
    base = overlay.flatten(_parts(spark, sf_dir), "p_partkey", ["name", "brand", "size"])
    m = F.col("p_partkey") + F.length("field")
    return overlay.difference(base.withColumn("value", F.when(m % 5 == 0, "  ").when(m % 7 == 0, "99").otherwise(F.col("value"))), base, "p_partkey")


@query(_DIFF + "SELECT * FROM edits")
def overlay_diff(spark, sf_dir):
    return _edits(spark, sf_dir)


@query(_DIFF + """
, w AS (SELECT p_partkey, map_from_entries(list((field, value))) AS m, string_agg(field, ',' ORDER BY field) AS edited FROM edits GROUP BY p_partkey)
SELECT p.p_partkey, CASE WHEN map_contains(m, 'name') THEN m['name'] ELSE p_name END AS name, CASE WHEN map_contains(m, 'brand') THEN m['brand'] ELSE p_brand END AS brand,
 CASE WHEN map_contains(m, 'size') THEN CAST(m['size'] AS INTEGER) ELSE p_size END AS size, coalesce(edited, '') AS edited FROM part p LEFT JOIN w USING (p_partkey)
""")
def overlay_apply(spark, sf_dir):
    return overlay.apply_edits(_parts(spark, sf_dir), _edits(spark, sf_dir), "p_partkey", ["name", "brand", "size"])


_SOURCES = """
SELECT s_suppkey, unnest(['form','portal','crossref','openalex','doaj']) AS source, unnest([1,2,3,4,5]) AS k, field FROM supplier, (SELECT unnest(['title','issn','license']) AS field)
"""


@query(f"""
WITH v AS (SELECT s_suppkey, source, field, CASE WHEN (s_suppkey + k * length(field)) % 3 = 0 THEN NULL WHEN (s_suppkey * k) % 4 = 0 THEN ' ' ELSE source || s_suppkey END AS value, k FROM ({_SOURCES})),
r AS (SELECT *, CASE WHEN field = 'license' AND source = 'doaj' OR field = 'issn' AND source = 'portal' THEN 0 ELSE 100 + k END AS rank FROM v WHERE trim(value) <> '')
SELECT s_suppkey, field, arg_min(value, rank) AS value, arg_min(source, rank) AS source FROM r GROUP BY s_suppkey, field
""")
def cascade_coalesce(spark, sf_dir):
    order = ["form", "portal", "crossref", "openalex", "doaj"]
    s = _table(spark, sf_dir, "supplier").select("s_suppkey", F.posexplode(F.array(*map(F.lit, order))).alias("p", "source"))
    s = s.select("s_suppkey", "source", (F.col("p") + 1).alias("k"), F.explode(F.array(*map(F.lit, ["title", "issn", "license"]))).alias("field"))
    value = F.when((F.col("s_suppkey") + F.col("k") * F.length("field")) % 3 == 0, None).when((F.col("s_suppkey") * F.col("k")) % 4 == 0, " ").otherwise(F.concat("source", "s_suppkey"))
    return overlay.cascade(s.withColumn("value", value), "s_suppkey", {"license": "doaj", "issn": "portal"}, order)


@query("""
WITH d AS (SELECT c_custkey, c_nationkey, CASE WHEN c_custkey % 3 = 0 THEN '' ELSE c_mktsegment END AS segment, CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE c_name END AS name FROM customer)
SELECT c_custkey, c_nationkey, CASE WHEN trim(segment) = '' THEN n_name ELSE segment END AS segment, coalesce(name, 'nation ' || n_nationkey) AS name,
 concat_ws(',', CASE WHEN trim(segment) = '' THEN 'segment' END, CASE WHEN name IS NULL THEN 'name' END) AS filled FROM d JOIN nation ON c_nationkey = n_nationkey
""")
def journal_defaults(spark, sf_dir):
    k = F.col("c_custkey")
    d = _table(spark, sf_dir, "customer").select(k, "c_nationkey", F.when(k % 3 == 0, "").otherwise(F.col("c_mktsegment")).alias("segment"), F.when(k % 4 == 0, None).otherwise(F.col("c_name")).alias("name"))
    n = _table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("segment"), F.concat(F.lit("nation "), "n_nationkey").alias("name"))
    return overlay.fill_defaults(d, n, "c_nationkey", ["segment", "name"]).select("c_custkey", "c_nationkey", "segment", "name", "filled")


@query("""
SELECT c_custkey, coalesce(f, j, d, g) AS value, CASE WHEN f IS NOT NULL THEN 'form' WHEN j IS NOT NULL THEN 'journal' WHEN d IS NOT NULL THEN 'declaration' WHEN g IS NOT NULL THEN 'generated' END AS reason
FROM (SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN c_name END AS f, CASE WHEN c_custkey % 3 = 0 THEN c_mktsegment END AS j, CASE WHEN c_custkey % 5 = 0 THEN 'decl' END AS d, CASE WHEN c_custkey % 7 > 0 THEN 'gen' END AS g FROM customer)
""")
def prefill_precedence(spark, sf_dir):
    k = F.col("c_custkey")
    x = overlay.prefill(F.when(k % 2 == 0, F.col("c_name")).otherwise(" "), F.when(k % 3 == 0, F.col("c_mktsegment")), F.when(k % 5 == 0, "decl"), F.when(k % 7 > 0, "gen"))
    return _table(spark, sf_dir, "customer").select(k, x.alias("x")).select("c_custkey", "x.value", "x.reason")


_ARTICLE = """SELECT o_orderkey, CASE WHEN o_orderkey % 5 > 0 THEN '10.1590/x' || o_orderkey END AS doi, CASE WHEN o_orderkey % 7 > 0 THEN lpad(CAST(o_orderkey % 99999 AS VARCHAR), 5, '0') ELSE '12' END AS ord,
 CASE WHEN o_orderkey % 6 > 0 THEN 'v' || o_custkey END AS volume, CASE WHEN o_orderkey % 4 > 0 THEN 'e1' END AS elocation, CASE WHEN o_orderkey % 8 > 0 THEN '1' END AS fpage,
 o_orderkey % 9 > 0 AS has_journal, CASE WHEN o_orderkey % 10 > 0 THEN 'https://creativecommons.org/licenses/by/4.0/' ELSE 'CC' END AS licence FROM orders"""
_FOUND = f"""
WITH a AS ({_ARTICLE}), f AS (
 SELECT o_orderkey, 0 AS rule_no, 'journal-unresolved' AS rule_id, 'J01' AS code, 'blocker' AS severity, 'journal' AS field FROM a WHERE NOT has_journal
 UNION ALL SELECT o_orderkey, 1, 'doi-missing', 'A01', 'blocker', 'doi' FROM a WHERE doi IS NULL
 UNION ALL SELECT o_orderkey, 2, 'order-form', 'A02', 'blocker', 'order' FROM a WHERE NOT regexp_matches(ord, '^\\d{{5}}$')
 UNION ALL SELECT o_orderkey, 3, 'volume-missing', 'A08', 'blocker', 'volume' FROM a WHERE volume IS NULL
 UNION ALL SELECT o_orderkey, 4, 'pages-missing', 'A08', 'blocker', 'elocation' FROM a WHERE elocation IS NULL AND fpage IS NULL
 UNION ALL SELECT o_orderkey, 5, 'year-from-copyright', 'A08', 'warning', 'volume' FROM a WHERE fpage IS NULL
 UNION ALL SELECT o_orderkey, 6, 'licence-form', 'L01', 'warning', 'licence' FROM a WHERE NOT starts_with(licence, 'https://creativecommons.org/licenses/'))
"""


def _articles(spark, sf_dir):
    k = F.col("o_orderkey")
    return _table(spark, sf_dir, "orders").select(
        k, F.when(k % 5 > 0, F.concat(F.lit("10.1590/x"), k)).alias("doi"), F.when(k % 7 > 0, F.lpad((k % 99999).cast("string"), 5, "0")).otherwise("12").alias("ord"), F.when(k % 6 > 0, F.concat(F.lit("v"), "o_custkey")).alias("volume"),
        F.when(k % 4 > 0, "e1").alias("elocation"), F.when(k % 8 > 0, "1").alias("fpage"), (k % 9 > 0).alias("has_journal"), F.when(k % 10 > 0, "https://creativecommons.org/licenses/by/4.0/").otherwise("CC").alias("licence"),
    )


def _found(spark, sf_dir):
    c = F.col
    return rules.findings(_articles(spark, sf_dir), "o_orderkey", [
        ("journal-unresolved", "J01", "blocker", "journal", ~c("has_journal")), ("doi-missing", "A01", "blocker", "doi", c("doi").isNull()), ("order-form", "A02", "blocker", "order", ~c("ord").rlike(r"^\d{5}$")),
        ("volume-missing", "A08", "blocker", "volume", c("volume").isNull()), ("pages-missing", "A08", "blocker", "elocation", c("elocation").isNull() & c("fpage").isNull()), ("year-from-copyright", "A08", "warning", "volume", c("fpage").isNull()),
        ("licence-form", "L01", "warning", "licence", ~c("licence").startswith("https://creativecommons.org/licenses/")),
    ])


@query(_FOUND + "SELECT * FROM f")
def rule_findings(spark, sf_dir):
    return _found(spark, sf_dir)


@query(_FOUND + "SELECT o_orderkey, field, arg_max(rule_id, rule_no) AS rule_id, arg_max(code, rule_no) AS code, arg_max(severity, rule_no) AS severity FROM f GROUP BY o_orderkey, field")
def pending_fields(spark, sf_dir):
    return rules.last_by_field(_found(spark, sf_dir), "o_orderkey")


@query(_FOUND + "SELECT * FROM f WHERE severity = 'blocker' OR NOT EXISTS (SELECT 1 FROM f b WHERE b.o_orderkey = f.o_orderkey AND b.code = f.code AND b.severity = 'blocker')")
def warnings_not_blocked(spark, sf_dir):
    return rules.drop_blocked_warnings(_found(spark, sf_dir), "o_orderkey")


@query(_FOUND + "SELECT o_orderkey, count(rule_id) FILTER (severity = 'blocker') AS blockers, count(rule_id) FILTER (severity = 'warning') AS warnings, count(rule_id) FILTER (severity = 'blocker') = 0 AS ready FROM a LEFT JOIN f USING (o_orderkey) GROUP BY o_orderkey")
def readiness(spark, sf_dir):
    return rules.readiness(_articles(spark, sf_dir), _found(spark, sf_dir), "o_orderkey")


@query(_FOUND + "SELECT code, count(*) AS n FROM f WHERE severity = 'blocker' GROUP BY code")
def rule_codes(spark, sf_dir):
    messages = _found(spark, sf_dir).where("severity = 'blocker'").select(F.concat(F.lit("missing "), "field", F.lit(" ("), "code", F.lit(")")).alias("m"))
    return rules.code_frequency(messages, "m")


@query(_FOUND + "SELECT o_orderkey, CASE WHEN field IN ('doi','order') THEN 'ids' ELSE 'issue' END AS block, string_agg(field, ',' ORDER BY rule_no) AS fields FROM f GROUP BY ALL")
def pending_blocks(spark, sf_dir):
    return rules.pending_by_block(_found(spark, sf_dir), "o_orderkey", F.when(F.col("field").isin("doi", "order"), "ids").otherwise("issue"))


@query("""
WITH f AS (SELECT 'pk' || l_orderkey AS package, CASE WHEN l_linenumber = 1 THEN 'pk' || l_orderkey || '/a.xml' WHEN l_linenumber = 2 THEN 'pk' || l_orderkey || '/a.PDF' WHEN l_linenumber = 3 THEN 'pk' || l_orderkey || '/xpm.html' WHEN l_linenumber = 4 AND l_orderkey % 2 = 0 THEN 'loose.tif' ELSE 'pk' || l_orderkey || '/i' || l_linenumber || '.tif' END AS path FROM lineitem),
n AS (SELECT package, regexp_extract(path, '[^/]*$') AS name, regexp_extract(path, '^([^/]*)/', 1) AS folder, length(path) - length(replace(path, '/', '')) AS depth FROM f),
c AS (SELECT package, count(DISTINCT nullif(folder, '')) = 1 AND count(*) FILTER (depth <> 1) = 0 AND bool_or(folder = package) AS a, count(*) FILTER (lower(name) LIKE '%.xml') BETWEEN 1 AND 5 AS b, count(*) FILTER (lower(name) LIKE '%.pdf') > 0 AS p, count(*) FILTER (name = 'xpm.html') > 0 AS r FROM n GROUP BY package)
SELECT package, unnest(['one folder','1 to 5 xml','pdf','report','all']) AS item, unnest([a, b, p, r, a AND b AND p AND r]) AS ok FROM c
""")
def package_checklist(spark, sf_dir):
    k, n = F.concat(F.lit("pk"), "l_orderkey"), F.col("l_linenumber")
    path = F.when(n == 1, F.concat(k, F.lit("/a.xml"))).when(n == 2, F.concat(k, F.lit("/a.PDF"))).when(n == 3, F.concat(k, F.lit("/xpm.html"))).when((n == 4) & (F.col("l_orderkey") % 2 == 0), "loose.tif").otherwise(F.concat(k, F.lit("/i"), n, F.lit(".tif")))
    return rules.package_checks(_table(spark, sf_dir, "lineitem").select(k.alias("package"), path.alias("path")))


@query("SELECT user_id, arg_max(event_type, (ts, event_id)) AS event_type, arg_max(value, (ts, event_id)) AS value FROM events GROUP BY user_id")
def stage_latest(spark, sf_dir):
    return workflow.latest(_table(spark, sf_dir, "events"), "user_id", "ts", "event_id", "event_type", "value")


@query("SELECT user_id, string_agg(event_type, '>' ORDER BY ts, event_id) AS history FROM events GROUP BY user_id")
def stage_history(spark, sf_dir):
    return workflow.history(_table(spark, sf_dir, "events"), "user_id", "ts", "event_id", "event_type")


_JOBS = "SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'queued' WHEN 1 THEN 'processing' WHEN 2 THEN 'done' ELSE 'error' END AS state, ts FROM events"


@query(f"SELECT event_id, state, CASE WHEN state = 'queued' THEN CAST(row_number() OVER (PARTITION BY state ORDER BY ts, event_id) AS INTEGER) WHEN state = 'processing' THEN 0 END AS position FROM ({_JOBS})")
def queue_position(spark, sf_dir):
    state = F.element_at(F.array(*map(F.lit, ["queued", "processing", "done", "error"])), (F.col("event_id") % 4 + 1).cast("int"))
    jobs = _table(spark, sf_dir, "events").select("event_id", state.alias("state"), "ts")
    return workflow.queue_positions(jobs, "state", "ts", "event_id").select("event_id", "state", "position")


@query("""
WITH RECURSIVE a AS (SELECT event_id, user_id % 10 AS k, epoch_us(ts) AS t, event_type = 'purchase' AS ok, row_number() OVER (PARTITION BY user_id % 10 ORDER BY epoch_us(ts), event_id) AS r FROM events),
f AS (SELECT DISTINCT k, 0::BIGINT AS r, NULL::BIGINT AS event_id, 0::BIGINT AS failures, false AS blocked, NULL::BIGINT AS wait_s, []::BIGINT[] AS q FROM a
 UNION ALL SELECT k, r, event_id, len(w), len(w) >= 3, CASE WHEN len(w) >= 3 THEN (3600000000 - (t - w[1])) // 1000000 + 1 END, CASE WHEN len(w) >= 3 THEN w WHEN ok THEN [] ELSE list_append(w, t) END
 FROM (SELECT a.*, list_filter(f.q, lambda x: a.t - x < 3600000000) AS w FROM f JOIN a ON a.k = f.k AND a.r = f.r + 1))
SELECT event_id, k, CAST(failures AS INTEGER) AS failures, blocked, wait_s FROM f WHERE r > 0
""")
def rate_limiter(spark, sf_dir):
    a = _table(spark, sf_dir, "events").select("event_id", (F.col("user_id") % 10).alias("k"), "ts", "event_type")
    return folds.rate_limit(a, "k", "ts", "event_id", F.col("event_type") == "purchase", 3, 3600).select("event_id", "k", "failures", "blocked", "wait_s")


@query("SELECT user_id, date_trunc('hour', ts) AS slot, arg_min(event_id, (ts, event_id)) AS first, count(*) AS n FROM events GROUP BY user_id, date_trunc('hour', ts)")
def open_coalescing(spark, sf_dir):
    return workflow.coalesced(_table(spark, sf_dir, "events"), ["user_id"], "ts", "hour", "event_id")


@query("""
WITH m AS (SELECT 'p' || c_custkey AS provider_id, 'sent' AS state FROM customer), e AS (SELECT 'p' || (user_id * 3) AS provider_id, arg_max(event_type, (ts, event_id)) AS s, bool_or(event_type = 'click') AS inbound FROM events GROUP BY user_id)
SELECT provider_id, coalesce(s, state) AS state, state IS NULL AS created FROM m FULL JOIN e USING (provider_id) WHERE state IS NOT NULL OR inbound
""")
def message_lifecycle(spark, sf_dir):
    m = _table(spark, sf_dir, "customer").select(F.concat(F.lit("p"), "c_custkey").alias("provider_id"), F.lit("sent").alias("state"))
    e = _table(spark, sf_dir, "events").select(F.concat(F.lit("p"), F.col("user_id") * 3).alias("provider_id"), F.col("ts").alias("at"), F.col("event_id").alias("seq"), F.col("event_type").alias("state"), (F.col("event_type") == "click").alias("inbound"))
    return workflow.message_states(m, e)


_KIND = "SELECT user_id, ts, CASE event_id % 3 WHEN 0 THEN 'approve' WHEN 1 THEN 'generate' ELSE 'other' END AS kind FROM events"


@query(f"SELECT user_id, coalesce(max(CASE WHEN kind = 'approve' THEN ts END) > max(CASE WHEN kind = 'generate' THEN ts END), max(CASE WHEN kind = 'approve' THEN ts END) IS NOT NULL) AS approved FROM ({_KIND}) GROUP BY user_id")
def approval_state(spark, sf_dir):
    kind = F.when(F.col("event_id") % 3 == 0, "approve").when(F.col("event_id") % 3 == 1, "generate").otherwise("other")
    return workflow.approvals(_table(spark, sf_dir, "events").select("user_id", "ts", kind.alias("kind")), "user_id", "ts", "kind")


@query("""
WITH e AS (SELECT event_id, user_id, event_type, coalesce(lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id), '') AS from_stage FROM events)
SELECT event_id, user_id, event_type, from_stage, (from_stage = '' AND event_type IN ('view','click')) OR (from_stage = 'view' AND event_type IN ('click','purchase')) OR (from_stage = 'click' AND event_type = 'purchase') AS allowed FROM e
""")
def stage_transitions(spark, sf_dir):
    e = _table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "ts")
    return workflow.transitions(e, "user_id", "ts", "event_id", "event_type", {"": ["view", "click"], "view": ["click", "purchase"], "click": ["purchase"]}).drop("ts")


@query("""
WITH d AS (SELECT o_orderkey, o_custkey % 100 AS journal, CAST(extract(year FROM o_orderdate) AS INTEGER) AS volume, o_orderkey % 1000 AS base, CASE WHEN o_orderkey % 5 = 0 THEN o_orderkey % 7 END AS batch FROM orders WHERE o_orderstatus <> 'P'),
n AS (SELECT journal, volume, max(batch) + 1 AS next FROM d WHERE batch IS NOT NULL GROUP BY journal, volume),
f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY journal, volume, base ORDER BY o_orderkey) AS r FROM d WHERE batch IS NULL) WHERE r = 1),
k AS (SELECT *, row_number() OVER (PARTITION BY journal, volume ORDER BY o_orderkey) - 1 AS k FROM f)
SELECT o_orderkey, journal, volume, base, coalesce(next, 1) + k // 5 AS batch FROM k LEFT JOIN n USING (journal, volume)
""")
def batches_of_five(spark, sf_dir):
    k = F.col("o_orderkey")
    d = _table(spark, sf_dir, "orders").where("o_orderstatus <> 'P'").select(k, (F.col("o_custkey") % 100).alias("journal"), F.year("o_orderdate").alias("volume"), (k % 1000).alias("base"), F.when(k % 5 == 0, k % 7).alias("batch"))
    return workflow.batches(d, ["journal", "volume"], "o_orderkey", workflow.next_numbers(d.where("batch is not null"), ["journal", "volume"])).select("o_orderkey", "journal", "volume", "base", "batch")


_FACTS = """SELECT c_custkey AS "user", c_custkey * 2 AS doc, c_custkey % 20 = 0 AS staff, c_custkey % 40 = 0 AS admin, c_custkey % 6 = 0 AS author, CASE c_custkey % 5 WHEN 0 THEN 'secretary' WHEN 1 THEN 'chief' WHEN 2 THEN 'reader' END AS role,
 CASE WHEN c_custkey % 3 > 0 THEN c_nationkey END AS journal_org, c_custkey % 11 = 0 AS org_admin, c_custkey % 4 AS orgs, CASE WHEN c_custkey % 11 = 0 THEN 1 ELSE 0 END AS admin_orgs FROM customer"""


@query(f"""
SELECT "user", doc, unnest(['send','correct','approve','view','deposit','usage','people','create']) AS action, unnest([staff OR journal_org IS NULL OR ed, staff OR author OR coalesce(role = 'secretary', false), NOT staff AND coalesce(role = 'chief', false), staff OR author OR ed OR org_admin, staff, admin OR org_admin, admin OR org_admin, staff OR admin_orgs > 0 OR orgs = 0]) AS allowed
FROM (SELECT *, coalesce(role IN ('secretary', 'chief'), false) AS ed FROM ({_FACTS}))
""")
def permission_matrix(spark, sf_dir):
    k = F.col("c_custkey")
    facts = _table(spark, sf_dir, "customer").select(
        k.alias("user"), (k * 2).alias("doc"), (k % 20 == 0).alias("staff"), (k % 40 == 0).alias("admin"), (k % 6 == 0).alias("author"), F.when(k % 5 == 0, "secretary").when(k % 5 == 1, "chief").when(k % 5 == 2, "reader").alias("role"),
        F.when(k % 3 > 0, F.col("c_nationkey")).alias("journal_org"), (k % 11 == 0).alias("org_admin"), (k % 4).alias("orgs"), F.when(k % 11 == 0, 1).otherwise(0).alias("admin_orgs"),
    )
    return workflow.permissions(facts)


@query("""
WITH d AS (SELECT o_orderkey AS doc_id, o_custkey AS owner, o_orderkey % 200 AS journal, o_orderkey % 25 AS org FROM orders), r AS (SELECT DISTINCT c_custkey AS usr, c_custkey % 200 AS journal FROM customer WHERE c_custkey % 3 = 0),
o AS (SELECT c_custkey AS usr, c_nationkey AS org FROM customer WHERE c_custkey % 50 = 0), s AS (SELECT c_custkey AS usr FROM customer WHERE c_custkey % 700 = 0),
k AS (SELECT owner AS usr, doc_id FROM d UNION SELECT usr, doc_id FROM d JOIN r USING (journal) UNION SELECT usr, doc_id FROM d JOIN o USING (org))
SELECT usr, doc_id FROM k WHERE usr NOT IN (SELECT usr FROM s) UNION ALL SELECT usr, doc_id FROM s, d
""")
def acl_visible(spark, sf_dir):
    o, c = _table(spark, sf_dir, "orders"), _table(spark, sf_dir, "customer")
    docs = o.select(F.col("o_orderkey").alias("doc_id"), F.col("o_custkey").alias("owner"), (F.col("o_orderkey") % 200).alias("journal"), (F.col("o_orderkey") % 25).alias("org"))
    usr = F.col("c_custkey").alias("usr")
    return workflow.visible(docs, "usr", c.where("c_custkey % 3 = 0").select(usr, (F.col("c_custkey") % 200).alias("journal")), c.where("c_custkey % 50 = 0").select(usr, F.col("c_nationkey").cast("long").alias("org")), c.where("c_custkey % 700 = 0").select(usr))


@query("""
WITH m AS (SELECT c_nationkey AS org, c_custkey AS usr, c_custkey % 60 = 0 AS is_admin FROM customer), n AS (SELECT org, count(*) AS n FROM m WHERE is_admin GROUP BY org)
SELECT org, usr AS "user", is_admin AND coalesce(n, 0) <= 1 AS refused FROM m LEFT JOIN n USING (org)
""")
def last_admin_guard(spark, sf_dir):
    m = _table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("org"), F.col("c_custkey").alias("user"), (F.col("c_custkey") % 60 == 0).alias("is_admin"))
    return workflow.last_admin_guard(m, m.select("org", "user"))


def _listed(spark, sf_dir):
    k = F.col("o_orderkey")
    return _table(spark, sf_dir, "orders").select(k.alias("doc_id"), F.col("o_orderdate").alias("created_at"), F.when(k % 3 > 0, F.col("o_orderdate") + F.expr("interval 5 days")).alias("updated_at"), F.when(k % 4 == 0, F.col("o_orderdate")).alias("opened_at"), F.when(k % 5 > 0, F.concat(F.lit("Title "), k % 50)).alias("title"), F.concat(F.lit("file"), k).alias("file"), F.when(k % 6 > 0, F.concat(F.lit("J"), k % 9)).alias("journal"), (k % 8).alias("blockers"), F.when(F.col("o_orderstatus") == "F", 2).otherwise(1).alias("stage_rank"))


_LISTED = "SELECT o_orderkey AS doc_id, o_orderdate AS created_at, CASE WHEN o_orderkey % 3 > 0 THEN o_orderdate + INTERVAL 5 DAY END AS updated_at, CASE WHEN o_orderkey % 4 = 0 THEN o_orderdate END AS opened_at, CASE WHEN o_orderkey % 5 > 0 THEN 'Title ' || (o_orderkey % 50) END AS title, 'file' || o_orderkey AS file, CASE WHEN o_orderkey % 6 > 0 THEN 'J' || (o_orderkey % 9) END AS journal, o_orderkey % 8 AS blockers, CASE WHEN o_orderstatus = 'F' THEN 2 ELSE 1 END AS stage_rank FROM orders"
_ORDERED = {"updated": "coalesce(updated_at, created_at) DESC", "opened": "opened_at DESC NULLS LAST", "created": "created_at DESC", "oldest": "created_at", "title": "lower(coalesce(title, file))", "journal": "lower(coalesce(journal, 'zzz'))", "blockers": "blockers DESC", "stage": "stage_rank"}


@query(" UNION ALL ".join(f"SELECT * FROM (SELECT '{o}' AS list, doc_id FROM ({_LISTED}) WHERE blockers < 7 ORDER BY {by}, doc_id LIMIT 30)" for o, by in _ORDERED.items()))
def doc_list_orders(spark, sf_dir):
    out = None
    for o in _ORDERED:
        part = reports.document_list(_listed(spark, sf_dir), o, 30, F.col("blockers") < 7).select(F.lit(o).alias("list"), "doc_id")
        out = part if out is None else out.unionByName(part)
    return out


@query("SELECT dimension, value, count(*) AS n FROM (SELECT unnest(['status','priority','year']) AS dimension, unnest([o_orderstatus, o_orderpriority, CAST(extract(year FROM o_orderdate) AS VARCHAR)]) AS value FROM orders) GROUP BY dimension, value")
def dashboard_counts(spark, sf_dir):
    d = _table(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority"), F.year("o_orderdate").alias("year"))
    return reports.dashboard(d, ["status", "priority", "year"])


@query("SELECT c_custkey, count(o_orderkey) AS n, count(o_orderkey) FILTER (o_orderstatus = 'F') AS ready, max(o_orderdate) AS last FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey")
def usage_per_user(spark, sf_dir):
    docs = _table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), (F.col("o_orderstatus") == "F").alias("ready"), F.col("o_orderdate").alias("at"))
    return reports.usage(_table(spark, sf_dir, "customer"), docs, "c_custkey")


@query("SELECT round_even(avg(o_totalprice), 1) AS price, round_even(avg(CASE WHEN o_orderkey % 3 = 0 THEN o_custkey END), 1) AS edits FROM orders")
def mean_times(spark, sf_dir):
    d = _table(spark, sf_dir, "orders").select(F.col("o_totalprice").alias("price"), F.when(F.col("o_orderkey") % 3 == 0, F.col("o_custkey")).alias("edits"))
    return reports.means(d, "price", "edits")


@query("SELECT p_brand, count(*) AS n FROM part GROUP BY p_brand ORDER BY n DESC, min(p_partkey) LIMIT 5")
def most_common(spark, sf_dir):
    return reports.top(_table(spark, sf_dir, "part").select("p_brand", "p_partkey"), "p_brand", "p_partkey", 5)


@query("SELECT box, count(event_id) AS n, count(event_id) FILTER (event_id % 3 > 0) AS unread FROM (SELECT unnest(['view','click','spam']) AS box) LEFT JOIN events ON event_type = box GROUP BY box")
def mailbox_counts(spark, sf_dir):
    return reports.box_counts(_table(spark, sf_dir, "events").select(F.col("event_type").alias("box"), (F.col("event_id") % 3 == 0).alias("read")), ["view", "click", "spam"])


@query("SELECT CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY 1 ORDER BY 1 DESC LIMIT 14")
def recent_days(spark, sf_dir):
    return reports.recent_days(_table(spark, sf_dir, "events"), "ts")


_T = r"trim(regexp_replace(strip_accents(lower(text)), '\s+', ' ', 'g'))"


@query(f"""
WITH t AS (SELECT doc_id, string_split({_T}, 'tion de') AS g FROM documents), h AS (SELECT doc_id, g, unnest(range(0, len(g) - 1)) AS hit_no FROM t WHERE len(g) > 1)
SELECT doc_id, CAST(hit_no AS INTEGER) AS hit_no, CAST(length(array_to_string(g[1:hit_no + 1], 'x')) - length(replace(array_to_string(g[1:hit_no + 1], 'x'), ' ', '')) + hit_no AS INTEGER) AS first_word,
 CAST(length(array_to_string(g[1:hit_no + 1], 'x')) - length(replace(array_to_string(g[1:hit_no + 1], 'x'), ' ', '')) + hit_no + 1 AS INTEGER) AS last_word FROM h
""")
def search_hits(spark, sf_dir):
    return reports.search(_table(spark, sf_dir, "documents"), "Tíon de")
