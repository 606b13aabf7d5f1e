"""Queries for lists, profiles, summaries, recovery and durations."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.operators import extraction, layout, reports, workflow
from quire.sources import docx

from .document_queries import docx_bytes
from .front_queries import K, _rows
from .layout_queries import _BODY, _LINES, lines
from .scalar_queries import _table

QUERIES, ORACLE_SQL = {}, {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


@query("SELECT o_orderkey AS doc FROM orders WHERE o_custkey % 7 = 3 AND o_orderstatus = 'F' AND o_orderkey % 2 = 0 AND strftime(o_orderdate, '%Y-%m-%d') >= '1995-01-01'")
def filtered_list(spark, sf_dir):
    docs = _table(spark, sf_dir, "orders").select(K().alias("doc"), (F.col("o_custkey") % 7).cast("string").alias("journal"), F.col("o_orderstatus").alias("stage"), (K() % 2 == 0).alias("ready"), F.lit("u").alias("owner"), F.lit("o").alias("org"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("updated_at"))
    return reports.filtered(docs, journal="3", stage="F", ready=True, owner="u", org="o", since="1995-01-01").select("doc")


@query("SELECT c_custkey, CAST(row_number() OVER (ORDER BY c_nationkey DESC, c_acctbal DESC, c_custkey) AS INTEGER) AS usage, CAST(row_number() OVER (ORDER BY lower(c_mktsegment), c_custkey) AS INTEGER) AS by_name FROM customer")
def list_places(spark, sf_dir):
    c = _table(spark, sf_dir, "customer")
    placed = reports.in_list_order(c, [F.desc("c_nationkey"), F.desc("c_acctbal")], "usage", "c_custkey")
    return reports.in_list_order(placed, [F.lower("c_mktsegment")], "by_name", "c_custkey").select("c_custkey", "usage", "by_name")


@query(f"""
WITH s AS (SELECT doc_id, size, sum(length(text)) AS n FROM ({_LINES}) GROUP BY ALL), h AS (SELECT doc_id, string_agg(size || ':' || CAST(n AS BIGINT), ' ' ORDER BY n DESC, size DESC) AS sizes FROM s GROUP BY doc_id),
m AS (SELECT doc_id, count(*) AS lines, count(*) FILTER (regexp_matches(text, '^\\s*([0-9]{{1,3}}[.)]?\\s|\\*|[¹²³†‡§])')) AS marks, count(*) FILTER (rotated) AS notes FROM ({_LINES}) GROUP BY doc_id),
k AS (SELECT doc_id, count(*) AS repeated FROM (SELECT doc_id, text FROM ({_LINES}) GROUP BY doc_id, text HAVING count(*) > 1) GROUP BY doc_id),
c AS (SELECT doc_id, avg(CASE WHEN x1 - x0 < 300 AND x0 > 270 THEN 1 ELSE 0 END) > 0.2 AS two_columns FROM ({_LINES}) l JOIN ({_BODY}) b USING (doc_id) WHERE page <> 1 AND abs(size - body_size) <= 1 GROUP BY doc_id)
SELECT doc_id, lines, sizes, marks, coalesce(two_columns, false) AS two_columns, coalesce(repeated, 0) AS repeated, notes FROM h JOIN m USING (doc_id) LEFT JOIN k USING (doc_id) LEFT JOIN c USING (doc_id)
""")
def layout_profiles(spark, sf_dir):
    rows = lines(spark, sf_dir)
    repeated = rows.groupBy("doc_id", "text").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return reports.profile(rows, repeated, layout.two_columns(rows, 600.0), rows.where("rotated").select("doc_id", "line_no"))


@query("SELECT o_orderkey AS doc_id, '# ' || CASE WHEN o_orderkey % 3 = 0 THEN 'not found' ELSE 'T' || o_orderkey END || chr(10) || chr(10) || '- DOI: 10.1/' || o_custkey || chr(10) || '- language: pt' || chr(10) || '- sections: ' || CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey % 9 ELSE 0 END AS summary FROM orders")
def article_summaries(spark, sf_dir):
    o = _table(spark, sf_dir, "orders")
    models = o.select(K().alias("doc_id"), F.when(K() % 3 == 0, " ").otherwise(F.concat(F.lit("T"), K())).alias("title"), F.concat(F.lit("10.1/"), "o_custkey").alias("doi"), F.lit("pt").alias("language"))
    return reports.summaries(models, o.where("o_orderkey % 2 = 0").select(K().alias("doc_id"), (K() % 9).alias("sections")))


@query("""
WITH j AS (SELECT event_id AS doc, CASE WHEN event_id % 4 < 2 THEN CASE WHEN event_id % 3 = 0 THEN 'done' ELSE 'queued' END WHEN event_id % 4 = 2 THEN 'done' ELSE 'error' END AS state, ts FROM events)
SELECT doc, state, CASE WHEN state = 'queued' THEN CAST(row_number() OVER (PARTITION BY state ORDER BY ts, doc) AS INTEGER) END AS position FROM j
""")
def recovered_queue(spark, sf_dir):
    e = F.col("event_id")
    state = F.element_at(F.array(*map(F.lit, ["queued", "processing", "done", "error"])), (e % 4 + 1).cast("int"))
    jobs = _table(spark, sf_dir, "events").select(e.alias("doc"), state.alias("state"), F.col("ts").alias("queued_at"))
    return workflow.recovered(jobs, jobs.where("doc % 3 = 0")).select("doc", "state", "position")


@query("""
WITH e AS (SELECT user_id AS k, epoch_us(ts) AS t, event_id % 3 AS kind FROM events), s AS (SELECT k, max(t) AS f FROM e WHERE kind = 0 GROUP BY k)
SELECT k, round((min(t) FILTER (kind = 1 AND t >= f) - f) / 1000000.0, 3) AS extract_s, round((min(t) FILTER (kind = 2 AND t >= f) - f) / 1000000.0, 3) AS total_s FROM e JOIN s USING (k) GROUP BY k, f
""")
def run_durations(spark, sf_dir):
    kind = F.element_at(F.array(F.lit("start"), F.lit("extracted"), F.lit("end")), (F.col("event_id") % 3 + 1).cast("int"))
    return workflow.durations(_table(spark, sf_dir, "events").select(F.col("user_id").alias("k"), "ts", kind.alias("kind")), "k", "ts", "kind")


@query("SELECT s_suppkey, s_suppkey % 2 AS blockers, s_suppkey % 2 = 0 AND s_suppkey % 3 > 0 AND s_suppkey % 5 > 0 AS ready FROM supplier")
def publication_ready(spark, sf_dir):
    s = F.col("s_suppkey")
    rows = _table(spark, sf_dir, "supplier").select(s, (s % 2).alias("blockers"), (s % 3 > 0).alias("dtd"), F.when(s % 5 > 0, True).alias("schematron"))
    return workflow.publication_ready(rows).select("s_suppkey", "blockers", "ready")


@query("SELECT 'n' || n_nationkey AS path, 'Section ' || n_regionkey AS text, CAST(3 AS BIGINT) AS n FROM nation WHERE n_nationkey % 2 = 0")
def docx_running_heads(spark, sf_dir):
    import pyarrow as pa

    def made(batches):
        for batch in batches:
            content = [docx_bytes([("Heading1", f"Section {b}")] * (3 - k % 2) + [("Normal", f"T{k}")]) for k, b in zip(batch["n_nationkey"].to_pylist(), batch["n_regionkey"].to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([f"n{k}" for k in batch["n_nationkey"].to_pylist()]), pa.array(content, pa.binary())], ["path", "content"])

    files = _table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey").mapInArrow(made, "path string, content binary")
    return docx.running_heads(docx.parse(files))


@query("SELECT o_orderkey AS doc_id, CASE WHEN o_orderkey % 2 = 0 THEN 'numeric' ELSE 'ABNT' END AS style, CASE WHEN o_orderkey % 3 = 0 THEN '2019-03-02' END AS revised FROM orders")
def numeric_styles(spark, sf_dir):
    texts = _rows("line_no text", *[(i, F.concat(F.when(K() % 2 == 0, f"[{i}] ").otherwise(""), F.lit("SILVA, João. Title."))) for i in range(1, 6)], (6, F.when(K() % 3 == 0, "Revised: 2 March 2019").otherwise("Plain line")))
    rows = _table(spark, sf_dir, "orders").select(K().alias("doc_id"), F.explode(texts).alias("x")).select("doc_id", "x.*")
    entries = rows.where("line_no < 6").withColumn("text", F.regexp_replace("text", r"^\[\d\] ", ""))
    dates = extraction.labelled_dates(rows, 2026).where("kind = 'revised'").select("doc_id", F.col("date").alias("revised"))
    return extraction.style_vote(entries, extraction.numbered_list(rows)).join(dates, "doc_id", "left")
