"""Queries for the rule catalogue over articles made of orders and line items."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.operators import rulebook

from .scalar_queries import _table

QUERIES, ORACLE_SQL = {}, {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def article(spark, sf_dir: str) -> dict:
    """Relations in which each rule holds for some rows."""
    k = F.col("o_orderkey")
    nth = lambda n, bad, good: F.when(k % n == 0, F.lit(bad)).otherwise(F.lit(good))
    docs = _table(spark, sf_dir, "orders").select(
        k.alias("doc_id"), (k % 3 > 0).alias("journal_known"), (k % 12 == 1).alias("journal_unsure"), nth(4, "editorial", "research-article").alias("article_type"), nth(5, None, "10.1590/x").alias("doi"),
        F.when(k % 6 == 0, " ").when(k % 6 == 1, "123").otherwise("01234").alias("order_no"), nth(7, "elocation", "read").alias("order_source"), nth(8, "", "Artigos").alias("heading"), nth(9, "journal", "read").alias("heading_source"),
        nth(10, None, "12").alias("volume"), nth(2, None, "e1").alias("elocation"), nth(11, None, "5").alias("fpage"), nth(13, None, "pt").alias("language"), F.when(k % 14 == 0, None).when(k % 14 == 1, "http://x").otherwise("https://creativecommons.org/licenses/by/4.0/").alias("licence_url"),
        nth(15, "journal", "read").alias("licence_source"), F.when(k % 16 == 0, None).when(k % 16 == 1, "2020").otherwise("2020-01-02").alias("published"), nth(32, None, "2020").alias("year"), nth(17, "copyright", "read").alias("year_source"),
        nth(18, None, "2019-05-05").alias("received"), F.when(k % 18 == 0, None).when(k % 19 == 0, "2018-01-01").otherwise("2019-09-09").alias("accepted"), F.when(k % 20 > 0, 9).alias("page_count"), nth(21, "CNPq", None).alias("funding_text"), F.when(k % 42 == 0, 1).otherwise(0).alias("funding_sources"),
        (k % 23 > 0).alias("text_layer"), (k % 46 == 0).alias("ocr"), (k % 24 > 0).alias("reference_list"), nth(25, "APA", "ABNT").alias("reference_style"), F.lit("ABNT").alias("journal_style"),
    )
    item = _table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), (F.col("l_linenumber") - 1).cast("int").alias("pos"), F.col("l_partkey").alias("p"), F.col("l_suppkey").alias("s"))
    p, s = F.col("p"), F.col("s")
    of = lambda n, bad, good: F.when(p % n == 0, F.lit(bad)).otherwise(F.lit(good))
    gone = (s % 5 == 0).alias("removed")
    lots = lambda n: F.when(p % n == 0, F.expr("cast(array() as array<string>)")).otherwise(F.array(F.lit("x")))
    part = lambda where, *cols: item.where(where).select("doc_id", "pos", *cols)
    return {
        "docs": docs,
        "titles": part("pos in (0, 1)", of(3, " ", "T").alias("text"), F.when(p % 4 > 0, F.when(p % 2 == 0, "pt").otherwise("en")).alias("language"), F.when(F.col("pos") == 0, "article-title").otherwise("trans-title").alias("kind")),
        "authors": part("pos in (1, 2)", F.lit("N").alias("name"), of(3, None, "S").alias("surname"), of(4, None, "0000-0002-1825-0097").alias("orcid"), (p % 5 > 0).alias("orcid_valid"), of(2, "a@b.org", None).alias("email"), lots(6).alias("aff_ids"), gone),
        "affiliations": part("pos = 2", F.lit("a1").alias("id"), of(3, "", "U").alias("institution"), of(4, None, "BR").alias("country"), (p % 5 == 0).alias("from_prose"), gone),
        "abstracts": part("pos = 3", of(3, "", "A").alias("text"), F.when(p % 4 > 0, F.when(p % 2 == 0, "pt").otherwise("en")).alias("language"), lots(5).alias("keywords"), F.lit("pt").alias("label_language"), gone),
        "sections": part("pos = 0", of(3, "", "S").alias("title"), gone),
        "figures": part("pos = 1", F.lit("F").alias("label"), of(2, "", "C").alias("caption"), of(3, None, "f.png").alias("file"), of(7, "box", "fig").alias("kind"), (p % 5 > 0).alias("called"), gone),
        "tables": part("pos = 4", F.lit("T").alias("label"), of(2, "", "C").alias("caption"), F.when(p % 3 > 0, F.array(F.array(F.lit("x")))).alias("cells"), of(5, "t.png", None).alias("file"), (p % 7 > 0).alias("called"), (p % 11 == 0).alias("unsure_columns"), gone),
        "equations": part("pos in (5, 6)", F.lit("E").alias("label"), F.when(p % 3 > 0, (p % 4).cast("int")).alias("number"), F.when(p % 4 == 0, "<math><mi>x</math>").when(p % 4 < 3, "<math><mi>x</mi></math>").alias("mathml"), F.lit(None).cast("string").alias("latex"), of(9, "bad", None).alias("error"), of(2, "e.png", None).alias("file"), gone),
        "boxes": part("pos = 0", of(2, " ", "b").alias("text"), gone),
        "dialogues": part("pos = 2", (p % 3).cast("int").alias("turns"), gone),
        "refs": part("pos > 2", (p % 3 > 0).alias("cited"), of(4, "low", "high").alias("confidence"), of(5, "1 jan", None).alias("access_date"), of(2, "http://x", None).alias("link")),
        "notes": part("pos = 3", of(3, "", "1").alias("label"), (p % 2 == 0).alias("called"), gone),
        "calls": part("pos = 4", F.lit("1").alias("label"), (p % 6 > 0).alias("has_note")),
    }


# The same rules once more, each as a plain row of (document, field or place, rule), straight from the tables.
_D = "SELECT o_orderkey AS k FROM orders"
_I = "SELECT l_orderkey AS k, CAST(l_linenumber - 1 AS INTEGER) AS pos, l_partkey AS p, l_suppkey % 5 <> 0 AS live FROM lineitem"


def _doc(rule: str, field: str, test: str) -> str:
    return f"SELECT k AS doc_id, '{field}' AS field, '{rule}' AS rule_id FROM d WHERE {test}"


def _part(rule: str, field: str, test: str) -> str:
    return f"SELECT k, {field}, '{rule}' FROM i WHERE {test}"


_FACTS = f"""WITH i AS ({_I}), d AS (SELECT k, k % 4 > 0 AS typed, (SELECT count(*) FROM i WHERE i.k = x.k AND pos IN (1, 2) AND live) AS authors, (SELECT count(*) FROM i WHERE i.k = x.k AND pos IN (1, 2) AND live AND p % 2 = 0) AS mails,
 (SELECT count(*) FROM i WHERE i.k = x.k AND pos = 3 AND live) AS abstracts, (SELECT count(*) FROM i WHERE i.k = x.k AND pos = 0 AND live) AS sections, (SELECT count(*) FROM i WHERE i.k = x.k AND pos > 2) AS refs, (SELECT count(*) FROM i WHERE i.k = x.k AND pos > 2 AND p % 4 > 0) AS sure,
 (SELECT arg_min(p % 3 > 0, (pos, p % 3 > 0)) FROM i WHERE i.k = x.k AND pos IN (0, 1)) AS titled, (SELECT arg_min(p % 3 > 0, (pos, p % 3 > 0)) FROM i WHERE i.k = x.k AND pos = 0) AS main_titled,
 (SELECT count(*) FROM i WHERE i.k = x.k AND pos IN (5, 6) AND live AND p % 4 < 3) AS mathml, (SELECT count(*) FROM i WHERE i.k = x.k AND pos IN (5, 6) AND live AND p % 4 = 3 AND p % 2 = 0) AS images,
 (SELECT count(DISTINCT p % 4) FROM i WHERE i.k = x.k AND pos IN (5, 6) AND live AND p % 3 > 0) AS numbers, (SELECT max(p % 4) - min(p % 4) + 1 FROM i WHERE i.k = x.k AND pos IN (5, 6) AND live AND p % 3 > 0) AS span FROM ({_D}) x),
 t AS (SELECT DISTINCT k, CASE WHEN p % 2 = 0 THEN 'pt' ELSE 'en' END AS lang FROM i WHERE pos IN (0, 1) AND p % 3 > 0 AND p % 4 > 0), """
_LANG = "CASE WHEN p % 4 = 0 THEN NULL WHEN p % 2 = 0 THEN 'pt' ELSE 'en' END"
_PENDING = " UNION ALL ".join([
    _doc("journal", "journal", "k % 3 = 0"), _doc("heading", "heading", "k % 8 = 0"), _doc("doi", "doi", "k % 5 = 0"), _doc("order", "order", "k % 6 < 2"), _doc("volume", "volume", "k % 10 = 0"), _doc("pages", "elocation", "k % 22 = 0"),
    _doc("language", "language", "k % 13 = 0"), _doc("licence", "licence", "k % 14 < 2"), _doc("published", "date_published", "k % 16 < 2"), _doc("received", "date_received", "typed AND k % 18 = 0"), _doc("accepted", "date_accepted", "typed AND k % 18 = 0"),
    _doc("title", "title_0_text", "NOT coalesce(titled, false)"), _doc("correspondence", "correspondence", "authors > 0 AND mails = 0"), _doc("references", "references", "refs = 0"),
    "SELECT k, 'author_0_surname', 'author' FROM d WHERE authors = 0", "SELECT k, 'abstract_0_text', 'abstract' FROM d WHERE typed AND abstracts = 0", "SELECT k, 'section_0_title', 'section' FROM d WHERE sections = 0",
    *[_part(r, f"'{e}_' || pos || '_{f}'", f"live AND pos IN ({at}) AND {test}") for r, e, f, at, test in (
        ("surname", "author", "surname", "1, 2", "p % 3 = 0"), ("orcid", "author", "orcid", "1, 2", "(p % 4 = 0 OR p % 5 = 0)"), ("affiliation", "author", "affs", "1, 2", "p % 6 = 0"), ("institution", "aff", "institution", "2", "p % 3 = 0"), ("country", "aff", "country", "2", "p % 4 = 0"),
        ("abstract-text", "abstract", "text", "3", "k % 4 > 0 AND p % 3 = 0"), ("abstract-language", "abstract", "language", "3", "k % 4 > 0 AND p % 4 = 0"), ("keywords", "abstract", "keywords", "3", "k % 4 > 0 AND p % 5 = 0"), ("section-title", "section", "title", "0", "p % 3 = 0"),
        ("table-caption", "table", "caption", "4", "p % 2 = 0"), ("table-cells", "table", "cells", "4", "p % 3 = 0 AND p % 5 > 0"), ("figure-caption", "figure", "caption", "1", "p % 7 > 0 AND p % 2 = 0"), ("figure-file", "figure", "file", "1", "p % 7 > 0 AND p % 3 = 0"),
        ("equation", "equation", "latex", "5, 6", "p % 4 = 3"), ("box", "box", "text", "0", "p % 2 = 0"), ("dialogue", "dialogue", "turns", "2", "p % 3 = 0"))],
])
_FOUND = " UNION ALL ".join([
    f"SELECT k AS doc_id, '{code}' AS code, '{rule}' AS rule_id, '{severity}' AS severity, '' AS field FROM d WHERE {test}" for code, rule, severity, test in (
        ("D01", "no-text-layer", "blocker", "k % 23 = 0 AND k % 46 > 0"), ("D02", "text-from-ocr", "warning", "k % 46 = 0"), ("J01", "journal-unresolved", "blocker", "k % 3 = 0"), ("", "journal-unsure", "warning", "k % 12 = 1"), ("A01", "doi-missing", "blocker", "k % 5 = 0"),
        ("A02", "order-derived", "warning", "k % 6 > 0 AND k % 7 = 0"), ("A02", "order-missing", "blocker", "k % 6 = 0"), ("A04", "heading-of-journal", "warning", "k % 8 > 0 AND k % 9 = 0"), ("A04", "heading-missing", "blocker", "k % 8 = 0"), ("A05", "title-missing", "blocker", "NOT coalesce(main_titled, false)"),
        ("A08", "volume-missing", "blocker", "k % 10 = 0"), ("A08", "pages-missing", "blocker", "k % 22 = 0"), ("A08", "year-of-copyright", "warning", "k % 17 = 0"), ("A09", "only-year", "blocker", "k % 16 < 2 AND k % 32 > 0"), ("A09", "date-missing", "blocker", "k % 32 = 0"),
        ("A12", "abstract-missing", "blocker", "typed AND abstracts = 0"), ("A14", "funding-without-source", "warning", "k % 21 = 0 AND k % 42 > 0"), ("A15", "page-count-unknown", "warning", "k % 20 = 0"), ("C01", "author-missing", "blocker", "authors = 0"), ("C07", "email-missing", "blocker", "mails = 0"),
        ("E01", "equations-as-images", "blocker", "images > 0"), ("E01", "equations-as-mathml", "warning", "mathml > 0"), ("E01", "equation-gap", "warning", "span > numbers"), ("H01", "history-missing", "blocker", "typed AND k % 18 = 0"), ("H02", "accepted-before-received", "warning", "k % 19 = 0 AND k % 18 > 0"),
        ("L01", "licence-of-journal", "warning", "k % 14 > 0 AND k % 15 = 0"), ("L01", "licence-missing", "blocker", "k % 14 = 0"), ("R01", "list-not-found", "warning", "k % 24 = 0"), ("R01", "list-empty", "warning", "k % 24 > 0 AND refs = 0"), ("R01", "references-missing", "blocker", "refs = 0"),
        ("R02", "partly-parsed", "warning", "sure < refs"), ("R02", "style-mismatch", "warning", "k % 25 = 0"), ("S01", "sections-missing", "blocker", "sections = 0"))
] + [
    f"SELECT k, '{code}', '{rule}', '{severity}', CAST(pos AS VARCHAR) FROM i WHERE pos IN ({at}) AND {test}" for code, rule, severity, at, test in (
        ("", "translation-without-language", "warning", "1", "p % 4 = 0"), ("A06", "abstract-without-title", "warning", "3", f"live AND NOT EXISTS (SELECT 1 FROM t WHERE t.k = i.k AND t.lang = {_LANG})"), ("A13", "keywords-missing", "blocker", "3", "live AND p % 5 = 0"),
        ("C02", "orcid-invalid", "blocker", "1, 2", "live AND p % 4 > 0 AND p % 5 = 0"), ("C02", "orcid-missing", "blocker", "1, 2", "live AND p % 4 = 0"), ("C03", "affiliation-missing", "blocker", "1, 2", "live AND p % 6 = 0"), ("", "surname-missing", "warning", "1, 2", "live AND p % 3 = 0"),
        ("C05", "institution-missing", "blocker", "2", "live AND p % 3 = 0"), ("C05", "country-missing", "blocker", "2", "live AND p % 4 = 0"), ("", "affiliation-unsure", "warning", "2", "live AND p % 5 = 0"), ("E01", "mathml-malformed", "blocker", "5, 6", "live AND p % 4 = 0"), ("E01", "latex-error", "blocker", "5, 6", "live AND p % 9 = 0"),
        ("F01", "figure-without-image", "warning", "1", "live AND p % 7 > 0 AND p % 3 = 0"), ("F01", "figure-not-called", "warning", "1", "live AND p % 7 > 0 AND p % 3 > 0 AND p % 5 = 0"), ("F02", "figure-without-caption", "blocker", "1", "live AND p % 7 > 0 AND p % 3 > 0 AND p % 2 = 0"),
        ("N01", "call-without-note", "warning", "4", "p % 6 = 0"), ("N01", "note-not-called", "warning", "3", "live AND p % 3 > 0 AND p % 2 = 1"), ("R03", "reference-uncited", "warning", "3, 4, 5, 6", "p % 3 = 0"), ("R04", "access-without-link", "warning", "3, 4, 5, 6", "p % 5 = 0 AND p % 2 = 1"),
        ("T01", "table-without-grid", "warning", "4", "live AND p % 2 = 1 AND p % 3 = 0 AND p % 5 > 0"), ("T01", "table-not-called", "warning", "4", "live AND p % 7 = 0"), ("T02", "columns-unsure", "warning", "4", "live AND p % 11 = 0"), ("T02", "table-without-caption", "blocker", "4", "live AND p % 2 = 0 AND (p % 3 > 0 OR p % 5 = 0)"),
        ("", "label-language", "warning", "3", f"live AND {_LANG} = 'en'"))
])


# for a field that two rules name, the part's rule comes after the document's
@query(f"{_FACTS} f AS ({_PENDING}) SELECT doc_id, field, CASE field WHEN 'author_0_surname' THEN 'author' ELSE max(rule_id) END AS rule_id FROM f GROUP BY doc_id, field")
def article_pending_fields(spark, sf_dir):
    return rulebook.pending_fields(article(spark, sf_dir))


@query(f"{_FACTS} f AS ({_FOUND}) SELECT * FROM f")
def article_findings(spark, sf_dir):
    return rulebook.findings(article(spark, sf_dir))


@query(f"{_FACTS} f AS ({_FOUND}) SELECT k AS doc_id, count(*) FILTER (severity = 'blocker') = 0 AS ready, coalesce(array_to_string(list_sort(list_distinct(list(code) FILTER (severity = 'blocker' AND code <> ''))), ','), '') AS codes FROM ({_D}) LEFT JOIN f ON f.doc_id = k GROUP BY k")
def article_readiness(spark, sf_dir):
    made = article(spark, sf_dir)
    found = rulebook.findings(made).where("severity = 'blocker'").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.array_join(F.sort_array(F.collect_set(F.when(F.col("code") != "", F.col("code")))), ",").alias("codes"))
    return made["docs"].select("doc_id").join(found, "doc_id", "left").select("doc_id", F.col("n").isNull().alias("ready"), F.coalesce("codes", F.lit("")).alias("codes"))
