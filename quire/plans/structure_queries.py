"""Queries over the structure that word processor files declare."""

from __future__ import annotations

import io
import zipfile

import pyarrow as pa
from pyspark.sql import functions as F

from quire.operators import structure
from quire.sources import docx

from .scalar_queries import _spread, _table

QUERIES, ORACLE_SQL = {}, {}

_RELATION = "http://schemas.openxmlformats.org/officeDocument/2006/relationships/image"


def docx_file(parts: list[tuple[str, str, str]], media: dict[str, str] | None = None, title: str = "") -> bytes:
    """A DOCX of (kind, style, text) parts in their order. kind: line; note; image (text: relation id); formula (text: its
    letters); table (text: cells, parted by | and rows by /). media: relation id to the name of a file in word/media, for those
    that the file has."""
    out, notes, body = io.BytesIO(), [], []
    for kind, style, text in parts:
        if kind == "line":
            body.append(f'<w:p><w:pPr><w:pStyle w:val="{style}"/></w:pPr><w:r><w:t xml:space="preserve">{text}</w:t></w:r></w:p>')
        elif kind == "note":
            notes.append(f'<w:footnote w:id="{len(notes) + 1}"><w:p><w:r><w:t>{text}</w:t></w:r></w:p></w:footnote>')
        elif kind == "image":
            body.append(f'<w:p><w:r><w:drawing><a:blip r:embed="{text}"/></w:drawing></w:r></w:p>')
        elif kind == "formula":
            body.append(f"<w:p><m:oMath><m:r><m:t>{text}</m:t></m:r></m:oMath></w:p>")
        else:
            cell = "<w:tc><w:p><w:r><w:t>{}</w:t></w:r></w:p></w:tc>"
            body.append("<w:tbl>" + "".join("<w:tr>" + "".join(cell.format(c) for c in row.split("|")) + "</w:tr>" for row in text.split("/")) + "</w:tbl>")
    names = f'xmlns:w="{docx.W[1:-1]}" xmlns:m="{docx.M[1:-1]}" xmlns:a="{docx.A[1:-1]}" xmlns:r="{docx.R[1:-1]}"'
    related = {text: (media or {}).get(text, f"lost{i}.png") for i, (kind, _, text) in enumerate(parts) if kind == "image"}
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f"<w:document {names}><w:body>{''.join(body)}</w:body></w:document>")
        z.writestr("word/footnotes.xml", f'<w:footnotes {names}><w:footnote w:id="-1" w:type="separator"><w:p/></w:footnote>{"".join(notes)}</w:footnotes>')
        z.writestr("word/_rels/document.xml.rels", f'<Relationships xmlns="{docx.RELATIONS[1:-1]}">' + "".join(f'<Relationship Id="{i}" Type="{_RELATION}" Target="media/{name}"/>' for i, name in related.items()) + "</Relationships>")
        for name in (media or {}).values():
            z.writestr(f"word/media/{name}", b"x")
        if title:
            z.writestr("docProps/core.xml", f'<c xmlns:dc="{docx.DC[1:-1]}"><dc:title>{title}</dc:title></c>')
    return out.getvalue()


def _files(spark, sf_dir):
    """A file of each document, whose sentences become headings, lines, captions, tables, images, formulas and notes by hashes."""
    told = _table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", F.split("text", r"[.\n]").alias("a"))

    def drawn(sentence, k):
        d = F.instr(F.lit("0123456789abcdef"), F.left(F.md5(F.concat_ws(":", F.col("doc_id").cast("string"), k.cast("string"))), F.lit(1))) - 1
        return F.struct(d.alias("d"), F.trim(F.regexp_replace(sentence, "[^A-Za-z]+", " ")).alias("said"), k.alias("k"))

    def part(drawn):
        d, k = drawn["d"], drawn["k"]
        piece = F.when(drawn["said"] != "", drawn["said"]).otherwise("x")
        n, label = k.cast("string"), (k % 5 + 1).cast("string")
        made = lambda kind, style, *text: F.struct(F.lit(kind).alias("kind"), F.lit(style).alias("style"), F.concat(*[F.lit(t) if isinstance(t, str) else t for t in text], F.lit("")).alias("text"))
        word = F.when(k % 3 == 0, "Tabela ").when(k % 3 == 1, "Figura ").otherwise("Quadro ")
        wide = F.when(k % 2 == 0, "").otherwise("|c")
        return (
            F.when(d == 0, made("line", "Heading1", n, ". ", piece)).when(d == 1, made("line", "Heading2", "S", n, " ", piece))
            .when(d == 2, made("table", "", F.when(k % 4 == 0, "7|h").otherwise("g|h"), wide, F.repeat(F.concat(F.lit("/1|2"), wide), (k % 3).cast("int"))))
            .when(d == 3, made("line", "", word, label, ": ", piece)).when(d == 4, made("line", "", "Fonte: ", piece)).when(d == 5, made("image", "", "r", n))
            .when(d == 6, made("formula", "", "a+", n)).when((d == 7) & (k % 2 == 0), made("line", "Heading1", "Resumo")).when(d == 7, made("line", "", "Resumo: ", piece))
            .when((d == 8) & (k > 25), made("line", "Heading1", "Referências")).when(d == 9, made("line", "", "Conforme a Tabela 2 e a figura ", label, " ", piece))
            .when(d == 10, made("line", "", "Revista Nova")).when(d == 11, made("note", "", "n", n)).otherwise(made("line", "", "p", n, " ", piece))
        )

    def made(batches):
        for batch in batches:
            content = []
            for parts in batch["parts"]:
                rows = [(p["kind"], p["style"], p["text"]) for p in parts.as_py() or []]
                content.append(docx_file(rows, {t: f"i{t}.png" for kind, _, t in rows if kind == "image" and int(t[1:]) % 7}))
            yield pa.RecordBatch.from_arrays([batch["path"], pa.array(content, pa.binary())], ["path", "content"])

    parts = _spread(told).select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("path"), F.transform(F.transform("a", drawn), part).alias("parts"))
    return parts.mapInArrow(made, "path string, content binary")


def docx_structure(spark, sf_dir):
    """Sections, paragraphs, tables, formulas and figures of files made from all documents."""
    return structure.declared(docx.elements(_files(spark, sf_dir))).drop("medium", "mathml")


QUERIES["docx_structure"] = docx_structure
ORACLE_SQL["docx_structure"] = """
WITH w AS (
  SELECT doc_id, unnest(range(len(a))) AS k, unnest(a) AS t FROM (SELECT doc_id, regexp_split_to_array(text, '[.\\n]') AS a FROM documents WHERE text IS NOT NULL)
), p AS (
  SELECT doc_id, k, coalesce(nullif(trim(regexp_replace(t, '[^A-Za-z]+', ' ', 'g')), ''), 'x') AS piece, strpos('0123456789abcdef', left(md5(doc_id || ':' || k), 1)) - 1 AS d FROM w
), e AS (
  SELECT *, CASE d WHEN 2 THEN 'table' WHEN 5 THEN 'image' WHEN 6 THEN 'formula' ELSE 'line' END AS kind,
    CASE WHEN d = 0 OR (d = 7 AND k % 2 = 0) OR (d = 8 AND k > 25) THEN 1 WHEN d = 1 THEN 2 END AS level,
    CASE d WHEN 0 THEN k || '. ' || piece WHEN 1 THEN 'S' || k || ' ' || piece WHEN 3 THEN ['Tabela ', 'Figura ', 'Quadro '][k % 3 + 1] || (k % 5 + 1) || ': ' || piece
      WHEN 4 THEN 'Fonte: ' || piece WHEN 7 THEN CASE WHEN k % 2 = 0 THEN 'Resumo' ELSE 'Resumo: ' || piece END WHEN 9 THEN 'Conforme a Tabela 2 e a figura ' || (k % 5 + 1) || ' ' || piece
      WHEN 10 THEN 'Revista Nova' ELSE CASE WHEN d = 8 AND k > 25 THEN 'Referências' ELSE 'p' || k || ' ' || piece END END AS text
  FROM p WHERE d <> 11 AND NOT (d = 5 AND k % 7 = 0)
), n AS (
  SELECT *, coalesce(sum((kind = 'line')::INT) OVER (PARTITION BY doc_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS line_no FROM e
), l AS (
  SELECT *, NOT (count(*) OVER (PARTITION BY doc_id, text) >= 3 AND len(text) BETWEEN 4 AND 129) AS body FROM n WHERE kind = 'line'
), f AS (
  SELECT doc_id, min(line_no) FILTER (WHERE text = 'Referências') AS last, coalesce(min(line_no) FILTER (WHERE text = 'Resumo'), min(line_no) FILTER (WHERE starts_with(text, 'Resumo: ') AND body)) AS abstract FROM l GROUP BY doc_id
), h AS (
  SELECT l.*, coalesce(line_no < abstract, false) AS early FROM l JOIN f USING (doc_id) WHERE d IN (0, 1) AND line_no < coalesce(last, 1000000)
), s AS (
  SELECT doc_id, line_no AS at, row_number() OVER (PARTITION BY doc_id ORDER BY line_no) AS section_no, level, d, k, piece, text FROM h WHERE NOT early
), x AS (
  SELECT n.doc_id, n.k, n.d, n.kind, n.line_no, n.text, n.piece, s.at, s.section_no,
    CASE WHEN s.at IS NULL THEN 0 ELSE (SELECT count(*) FROM l WHERE l.doc_id = n.doc_id AND l.line_no > s.at AND l.line_no < n.line_no AND l.body) END AS para_pos
  FROM n ASOF LEFT JOIN s ON n.doc_id = s.doc_id AND n.line_no >= s.at
), g AS (
  SELECT x.* FROM x JOIN l USING (doc_id, k) JOIN f USING (doc_id) WHERE x.section_no IS NOT NULL AND x.line_no > x.at AND x.line_no < coalesce(f.last, 1000000) AND l.body AND x.d NOT IN (3, 4)
), c AS (
  SELECT doc_id, line_no AS cap_at, CASE k % 3 WHEN 0 THEN 'table' ELSE 'image' END AS kind, (k % 5 + 1)::VARCHAR AS number, ['Tabela ', 'Figura ', 'Quadro '][k % 3 + 1] || (k % 5 + 1) AS label, piece AS caption,
    (SELECT arg_min(q.piece, q.line_no) FROM l q WHERE q.doc_id = l.doc_id AND q.d = 4 AND q.line_no BETWEEN l.line_no + 1 AND l.line_no + 3) AS source
  FROM l WHERE d = 3
), m AS (
  SELECT x.doc_id, x.k, arg_min(struct_pack(number := c.number, label := c.label, caption := c.caption, source := c.source), CASE WHEN cap_at >= line_no THEN cap_at - line_no ELSE 100 + cap_at - line_no END) AS found
  FROM x JOIN c ON x.doc_id = c.doc_id AND x.kind = c.kind AND cap_at BETWEEN line_no - 3 AND line_no + 3 GROUP BY ALL
), y AS (
  SELECT DISTINCT doc_id, 'table' AS kind, '2' AS number FROM g WHERE d = 9 UNION SELECT DISTINCT doc_id, 'image', (k % 5 + 1)::VARCHAR FROM g WHERE d = 9
), z AS (
  SELECT doc_id, k, 'title' AS kind, NULL::BIGINT AS section_no, NULL::BIGINT AS para_pos, level, NULL AS number, NULL AS label, text, NULL AS source, NULL::BOOLEAN AS called
  FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY line_no DESC) AS r FROM h WHERE early) WHERE r = 1 AND len(text) > 15
  UNION ALL SELECT doc_id, k, 'section', section_no, NULL, level, CASE WHEN d = 0 THEN k::VARCHAR END, NULL, CASE WHEN d = 0 THEN piece ELSE text END, NULL, NULL FROM s
  UNION ALL SELECT doc_id, k, 'paragraph', section_no, para_pos, NULL, NULL, NULL, text, NULL, NULL FROM g
  UNION ALL SELECT doc_id, k, CASE WHEN kind = 'image' THEN CASE WHEN found IS NULL THEN 'loose image' ELSE 'figure' END ELSE kind END, section_no, para_pos, NULL, found.number, found.label, found.caption, found.source,
    CASE WHEN kind = 'table' OR (kind = 'image' AND found IS NOT NULL) THEN coalesce((doc_id, kind, found.number) IN (SELECT (doc_id, kind, number) FROM y), false) END
  FROM x LEFT JOIN m USING (doc_id, k) WHERE kind <> 'line'
), o AS (SELECT *, row_number() OVER (PARTITION BY doc_id, kind ORDER BY k) AS no FROM z)
SELECT 'd' || doc_id AS path, kind, no, section_no, para_pos, level, CASE WHEN kind = 'formula' THEN no::VARCHAR ELSE number END AS number, CASE WHEN kind = 'formula' THEN '(' || no || ')' ELSE label END AS label, text, source, called,
  CASE WHEN kind = 'figure' THEN 'fig' || lpad(no::VARCHAR, greatest(2, len(no::VARCHAR))::INT, '0') || '.png' END AS file, CASE WHEN kind = 'table' THEN 1 + k % 3 END AS n_rows, CASE WHEN kind = 'table' THEN 2 + k % 2 END AS n_cols,
  CASE WHEN kind = 'table' THEN (k % 4 <> 0)::INT END AS header_rows FROM o
"""
