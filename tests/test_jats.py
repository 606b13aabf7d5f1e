"""The article XML of a whole model, element by element, and of bare ones."""

import xml.etree.ElementTree as ET

from quire.operators import jats

LINK = "{http://www.w3.org/1999/xlink}href"
LANG = "{http://www.w3.org/XML/1998/namespace}lang"


def relation(spark, name, *rows):
    """Rows of a relation from dicts; what a row leaves out is null."""
    lead = [] if name in ("docs", "declarations") else ["pos int"]
    schema = ", ".join(["doc_id long", *lead, jats.RELATIONS[name]])
    empty = spark.createDataFrame([], schema)
    for i, row in enumerate(rows):
        unknown = set(row) - set(empty.columns)
        assert not unknown, unknown
    full = [{"doc_id": 1, **({"pos": i} if lead else {}), **row} for i, row in enumerate(rows)]
    return spark.createDataFrame([tuple(r.get(c) for c in empty.columns) for r in full], empty.schema)


def article(spark):
    return {
        "docs": relation(spark, "docs", {"journal": "rdp", "journal_title": "Revista & Práxis", "journal_short": "Rev. P.", "issn_epub": "2179-8966", "publisher": "U", "article_type": "research-article", "language": "pt", "doi": "10.1590/2179-8966/2025/1", "order_no": "00001", "heading": "Artigos", "volume": "16", "issue": "01", "fpage": "10", "lpage": "25", "year": "2025", "published": "2025-03-01", "received": "2024-01-02", "accepted": "2024-05-06", "licence_url": "https://creativecommons.org/licenses/by/4.0/", "funding_text": "Apoio", "data_status": "data-available"}),
        "titles": relation(spark, "titles", {"text": "Um <título>", "language": "pt", "kind": "article-title"}, {"text": "A title", "language": "en", "kind": "trans-title"}, {"text": "?", "kind": "trans-title"}),
        "authors": relation(spark, "authors", {"surname": "Silva", "given": "Ana", "name": "Ana Silva", "orcid": "0000-0002-1825-0097", "aff_ids": ["aff1"], "roles": ["software", "x"]}, {"surname": "Reis", "given": "Bo", "name": "Bo Reis", "email": "b@x.org", "aff_ids": ["aff2", "aff1"], "bio": "Doutor."}),
        "affiliations": relation(spark, "affiliations", {"id": "aff1", "original": "U, Rio", "institution": "U", "city": "Rio", "country": "BR", "country_name": "Brasil"}, {"id": "aff2", "original": "V"}),
        "abstracts": relation(spark, "abstracts", {"language": "en", "text": "Abs.", "keywords": ["law"]}, {"language": "pt", "text": "Res.", "keywords": ["lei", "norma"]}),
        "notes": relation(spark, "notes", {"id": "fn1", "label": "1", "text": "Nota.", "kind": "other"}, {"id": "fn2", "label": "*", "text": "Do título.", "attached": "title"}, {"id": "fn3", "label": "2", "text": "Bio", "attached": "author:1"}),
        "declarations": relation(spark, "declarations", {"kind": "conflito", "text": "Nenhum."}, {"kind": "dados", "text": "Aqui.\n\nE ali."}, {"kind": "agradecimentos", "text": "A todos."}),
        "fundings": relation(spark, "fundings", {"source": "CNPq", "award": "12/3"}, {"source": " "}),
        "sections": relation(spark, "sections", {"level": 1, "kind": "intro", "title": "1 Introdução", "paragraphs": ["p0 & q", "p1"]}, {"level": 2, "title": "1.1 Sub", "paragraphs": ["s0"]}, {"level": 1, "title": "2 Fim", "paragraphs": []}),
        "floats": relation(
            spark, "floats", {"kind": "fig", "section": 0, "paragraph": 1, "label": "Figura 1", "caption": "C", "source": "S", "file": "a.png"}, {"kind": "fig", "label": "Sem imagem"}, {"kind": "table", "section": 0, "paragraph": 9, "label": "Tabela 1", "header_rows": 1, "cells": [["h", "k"], ["1"]]},
            {"kind": "equation", "section": 1, "paragraph": 0, "mathml": "<mml:math/>"}, {"kind": "box", "section": 2, "label": "Quadro", "text": "a\n b "}, {"kind": "dialogue", "turns": [("Ana", "Oi"), ("", None)]}, {"kind": "equation", "file": "e.png"},
        ),
        "refs": relation(spark, "refs", {"text": "SILVA, J. A. A title. Revista Nova, v. 3, n. 2, p. 10-33, 1995. Disponível em: https://ex.org/5. Acesso em: 3 maio 2020."}, {"text": "BRASIL. Lei n. 8, de 1996."}),
    }


def shape(node, depth=0):
    return [f"{'.' * depth}{node.tag.split('}')[-1]}", *(x for child in node for x in shape(child, depth + 1))]


def parsed(xml):
    return ET.fromstring(xml.split("\n", 2)[2])


def test_all_elements_in_order(spark):
    made = jats.build(article(spark)).first().xml
    root = parsed(made)
    assert made.startswith('<?xml version="1.0" encoding="UTF-8"?>\n<!DOCTYPE article PUBLIC')
    assert root.attrib == {"article-type": "research-article", "dtd-version": "1.3", "specific-use": "sps-1.10", LANG: "pt"}
    meta = root.find("front/article-meta")
    assert [e.tag for e in meta] == [
        "article-id", "article-id", "article-categories", "title-group", "contrib-group", "author-notes", "pub-date", "pub-date", "volume", "issue", "fpage", "lpage", "history", "permissions", "abstract", "trans-abstract", "kwd-group", "kwd-group", "funding-group", "counts",
    ]
    assert [(e.tag, e.get("count")) for e in meta.find("counts")] == [("fig-count", "1"), ("table-count", "1"), ("equation-count", "2"), ("ref-count", "2"), ("page-count", "16")]
    assert meta.find("title-group/article-title").text == "Um <título>" and len(meta.findall("title-group/trans-title-group")) == 1
    first, second = meta.findall("contrib-group/contrib")
    assert [e.tag for e in first] == ["contrib-id", "name", "role", "xref"] and [e.tag for e in second] == ["name", "xref", "xref", "xref", "bio"]
    assert [x.find("sup").text for x in second.findall("xref[@ref-type='aff']")] == ["2", "1"]
    assert [e.get("fn-type") for e in meta.findall("author-notes/fn")] == ["other", "conflict"] and meta.find("author-notes/corresp/email").text == "b@x.org"
    assert meta.find("abstract/p").text == "Res." and meta.find("trans-abstract").get(LANG) == "en"
    assert meta.find("issue").text == "1" and [e.tag for e in meta.find("pub-date")] == ["day", "month", "year"]
    assert meta.find("funding-group/award-group/award-id").text == "12/3"
    back = root.find("back")
    assert [e.tag for e in back] == ["ack", "fn-group", "sec", "ref-list"] and back.find("sec").get("specific-use") == "data-available"
    assert [(e.get("fn-type"), e.find("p").text) for e in back.find("fn-group")] == [("financial-disclosure", "Apoio CNPq: 12/3"), ("other", "Nota.")]
    entry = back.find("ref-list/ref/element-citation")
    assert [e.tag for e in entry] == ["person-group", "article-title", "source", "volume", "issue", "fpage", "lpage", "year", "ext-link", "date-in-citation"] and entry.find("ext-link").get(LINK) == "https://ex.org/5"
    assert back.find("ref-list/ref[@id='B2']/element-citation/person-group/collab").text == "BRASIL"


def test_floats_and_nested_sections(spark):
    root = parsed(jats.build(article(spark)).first().xml)
    assert shape(root.find("body")) == [
        "body", ".sec", "..title", "..p", "..fig", "...label", "...caption", "....title", "...attrib", "...graphic", "..p", "..table-wrap", "...label", "...table", "....thead", ".....tr", "......th", "......th", "....tbody", ".....tr", "......td", "......td",
        "..sec", "...title", "...disp-formula", "....math", "...p", ".sec", "..title", "..boxed-text", "...label", "...p", "...p", "..disp-formula", "...graphic", "..speech", "...speaker", "...p", "..speech", "...speaker", "...p",
    ]
    assert [e.get("id") for e in root.iter() if e.get("id") and e.tag in ("fig", "table-wrap", "disp-formula", "boxed-text")] == ["f1", "t1", "e01", "q1", "e02"]
    assert root.find("body//graphic").get(LINK) == "2179-8966-rdp-16-01-00010-gf01.tif"
    assert sorted((r.file, r.href) for r in jats.images(article(spark)).collect()) == [("a.png", "2179-8966-rdp-16-01-00010-gf01.tif"), ("e.png", "2179-8966-rdp-16-01-00010-e02.tif")]


def test_bare_article(spark):
    docs = relation(spark, "docs", {"doc_id": 1}, {"doc_id": 2, "elocation": "e9", "year": "2020", "licence_url": "https://creativecommons.org/licenses/by-nc-sa/4.0/", "language": "fr"})
    made = {r.doc_id: parsed(r.xml) for r in jats.build({"docs": docs}, "1.9").collect()}
    assert [e.tag for e in made[1]] == [] and made[1].get("dtd-version") == "1.1"
    assert [e.tag for e in made[2].find("front/article-meta")] == ["pub-date", "pub-date", "elocation-id", "permissions"]
    assert "ShareAlike" in made[2].find(".//license-p").text
    assert jats.build({"docs": docs.where("false")}).count() == 0


def test_references_alike_are_parsed_once(spark):
    """entries are parsed and written by text, not by row; their numbers stay those of their document."""
    texts = ["BRASIL. Lei n. 7, de 1996.", None, "", "COSTA, Ana. Book. 2. ed. Rio: Press, 2001.", "BRASIL. Lei n. 7, de 1996."]
    refs = spark.createDataFrame([(d, i, t) for d in (1, 2) for i, t in enumerate(texts if d == 1 else texts[::-1])], "doc_id long, pos int, text string")
    made = jats._references(refs)
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    parsed = plan[plan.index("ArrowEvalPython") :]
    assert "Aggregate [text#" in parsed
    rows = {r.doc_id: r for r in made.collect()}
    assert [r._n_refs for r in rows.values()] == [5, 5]
    ids = lambda x: [(r.get("id"), r.findtext("mixed-citation")) for r in ET.fromstring(f"<x>{x}</x>")]
    assert ids(rows[1]._refs) == [("B1", texts[0]), ("B4", texts[3]), ("B5", texts[0])] and ids(rows[2]._refs) == [("B1", texts[0]), ("B2", texts[3]), ("B5", texts[0])]
