"""Queries that validate the articles built from the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.operators import validation

from . import document_queries

QUERIES, ORACLE_SQL = {}, {}


def xml_findings(spark, sf_dir):
    """How often each finding is made in each article of article_xml."""
    articles = document_queries.QUERIES["article_xml"](spark, sf_dir)
    return validation.validate(articles).groupBy("doc_id", "path", "rule", "detail").agg(F.count(F.lit(1)).alias("n"))


QUERIES["xml_findings"] = xml_findings
_META, _REF = "/article/front/article-meta", "/article/back/ref-list/ref"
# the findings by the strings of the XML that SQL writes
ORACLE_SQL["xml_findings"] = f"""
WITH made AS ({document_queries.ORACLE_SQL["article_xml"]}
), x AS (
  SELECT doc_id, xml, len(regexp_extract_all(xml, '<ref[ >]')) AS refs, len(regexp_extract_all(xml, '<element-citation')) AS elements,
         len(regexp_extract_all(xml, '</mixed-citation><year>')) AS years, len(regexp_extract_all(xml, '<contrib ')) AS people,
         len(regexp_extract_all(xml, '<aff |<xref ')) AS affs, regexp_extract(xml, '<article-id pub-id-type="doi">([^<]*)<', 1) AS doi FROM made
), ids AS (
  SELECT doc_id, id, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(xml, ' id="([^"]*)"', 1)) AS id FROM made) GROUP BY ALL
)
SELECT doc_id, '{_REF}' AS path, 'id repeated' AS rule, id AS detail, n - 1 AS n FROM ids WHERE n > 1
UNION ALL SELECT doc_id, '{_REF}', 'child not allowed', 'year as child 2', years FROM x WHERE years > 0
UNION ALL SELECT doc_id, '{_REF}', 'reference has its elements', '', refs - elements FROM x WHERE refs > elements
UNION ALL SELECT doc_id, '{_META}/contrib-group/contrib', 'author has an affiliation', '', people FROM x WHERE people > 0 AND affs = 0
UNION ALL SELECT doc_id, '{_META}/article-id', 'doi is well formed', '', 1 FROM x WHERE contains(xml, '<article-id') AND NOT regexp_full_match(trim(doi), '10\\.[0-9]{{4,9}}/[^\\s]+')
UNION ALL SELECT doc_id, '{_META}', 'article has contributors', '', 1 FROM x WHERE people = 0
UNION ALL SELECT doc_id, '{_META}', 'article has a heading', '', 1 FROM x WHERE NOT contains(xml, '<article-categories>')
UNION ALL SELECT doc_id, '{_META}', 'article has permissions', '', 1 FROM x WHERE NOT contains(xml, '<permissions>')
UNION ALL SELECT doc_id, '{_META}', 'article has a date', '', 1 FROM x WHERE NOT contains(xml, '<pub-date')
UNION ALL SELECT doc_id, '/article/front/journal-meta', 'journal has a publisher', '', 1 FROM x WHERE contains(xml, '<journal-meta>') AND NOT contains(xml, '<publisher>')
UNION ALL SELECT doc_id, '/article/front/journal-meta', 'content ends early', 'after 1 children', 1 FROM x WHERE contains(xml, '<journal-meta><journal-id') AND NOT contains(xml, '<issn')
"""
