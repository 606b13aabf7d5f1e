"""Article XML by string assembly: every element is a column, repeated ones are ordered lists joined per document."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from html import escape as escaped

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quire.functions.shared import many

DOCTYPE = '<!DOCTYPE article PUBLIC "-//NLM//DTD JATS (Z39.96) Journal Publishing DTD v1.1 20151215//EN" "JATS-journalpublishing1.dtd">'


def escape(x: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        x = F.replace(x, F.lit(a), F.lit(b))
    return x


def element(name: str, content: Column, **attributes: Column) -> Column:
    """<name a="..">content</name>; null attributes are left out, null or empty content makes no element."""
    named = {"xml_lang": "xml:lang"}
    given = [F.coalesce(F.concat(F.lit(f' {named.get(k, k.rstrip("_").replace("_", "-"))}="'), escape(v.cast("string")), F.lit('"')), F.lit("")) for k, v in attributes.items()]
    # the content stands in the expression once only, so that nested elements don't multiply it
    inner = F.get(F.array_remove(F.array(content), ""), F.lit(0))
    return F.coalesce(F.concat(F.lit(f"<{name}"), *given, F.lit(">"), inner, F.lit(f"</{name}>")), F.lit(""))


def text_element(name: str, x: Column, **attributes: Column) -> Column:
    return element(name, escape(x.cast("string")), **attributes)


def joined(rows: DataFrame, key: str, order: str, content: Column, name: str, *more: Column) -> DataFrame:
    """The contents of a document's rows in order, as one string, and more aggregates."""
    # the contents are columns first, since what stands inside collect_list isn't compiled
    rows = rows.select(key, F.struct(F.col(order).alias("o"), content.alias("x")).alias("_each"))
    return rows.groupBy(key).agg(F.array_join(F.transform(F.sort_array(F.collect_list("_each")), lambda s: s["x"]), "").alias(name), *more)


def date_parts(name: str, iso: Column) -> Column:
    """Day, month and year elements of an ISO date that may stop at the month or year."""
    part = lambda g: F.regexp_extract(iso, r"^(\d{4})(?:-(\d{2}))?(?:-(\d{2}))?", g)
    return element(name, F.concat(text_element("day", part(3)), text_element("month", part(2)), text_element("year", part(1))))


def articles(docs: DataFrame, authors: DataFrame, sections: DataFrame, references: DataFrame) -> DataFrame:
    """doc_id and xml. docs: doc_id, journal, issn, doi, title, lang, volume, fpage, lpage, published; authors: doc_id, pos,
    surname, given, orcid; sections: doc_id, pos, title, body, kind; references: doc_id, pos, text, year."""
    c = F.col
    contribs = joined(authors, "doc_id", "pos", element("contrib", F.concat(text_element("contrib-id", c("orcid"), contrib_id_type=F.lit("orcid")), element("name", F.concat(text_element("surname", c("surname")), text_element("given-names", c("given"))))), contrib_type=F.lit("author")), "_authors")
    secs = joined(sections, "doc_id", "pos", element("sec", F.concat(text_element("title", c("title")), text_element("p", c("body"))), sec_type=c("kind")), "_secs")
    ref = element("ref", F.concat(text_element("mixed-citation", c("text")), text_element("year", c("year"))), id=F.concat(F.lit("B"), c("pos")))
    refs = joined(references, "doc_id", "pos", ref, "_refs", F.count(F.lit(1)).alias("_n_refs"))
    all_ = docs.join(contribs, "doc_id", "left").join(secs, "doc_id", "left").join(refs, "doc_id", "left")
    pages = F.when(c("lpage").rlike(r"^\d+$") & c("fpage").rlike(r"^\d+$"), c("lpage").cast("int") - c("fpage").cast("int") + 1)
    count = lambda name, n: F.when(F.coalesce(n, F.lit(0)) > 0, F.concat(F.lit(f'<{name} count="'), n.cast("string"), F.lit('"/>'))).otherwise("")
    front = element("front", F.concat(
        element("journal-meta", F.concat(text_element("journal-id", c("journal"), journal_id_type=F.lit("publisher-id")), text_element("issn", c("issn"), pub_type=F.lit("epub")))),
        element("article-meta", F.concat(text_element("article-id", c("doi"), pub_id_type=F.lit("doi")), element("title-group", text_element("article-title", c("title"))), element("contrib-group", c("_authors")), date_parts("pub-date", c("published")), text_element("volume", c("volume")), text_element("fpage", c("fpage")), text_element("lpage", c("lpage")), element("counts", F.concat(count("ref-count", c("_n_refs")), count("page-count", pages))))),
    ))
    made = element("article", F.concat(front, element("body", c("_secs")), element("back", element("ref-list", c("_refs")))), article_type=F.lit("research-article"), dtd_version=F.lit("1.1"), xml_lang=c("lang"))
    return all_.select("doc_id", F.concat(F.lit('<?xml version="1.0" encoding="utf-8"?>\n' + DOCTYPE + "\n"), made).alias("xml"))


def draft_marked(xml: Column, blockers: Column) -> Column:
    """A comment after the XML declaration while there are blockers."""
    return F.when(blockers > 0, F.regexp_replace(xml, r"^(<\?xml[^>]*\?>)", F.concat(F.lit("$1\n<!-- draft: "), blockers.cast("string"), F.lit(" blockers -->")))).otherwise(xml)


def hrefs(files: DataFrame, key: str, xml: str) -> DataFrame:
    """The files that an XML text refers to, one row for each."""
    return files.select(key, F.explode(F.regexp_extract_all(xml, F.lit(r'\bhref="([^"]+)"'), F.lit(1))).alias("href")).distinct()


def mark_spans(paragraphs: DataFrame, spans: DataFrame, keys: list[str]) -> DataFrame:
    """paragraphs (keys, text) with spans (keys, start, end, rank, tag, rid) spliced in as <xref>: where spans overlap, the
    lower rank, then the earlier one stays. Greedy selection is a fold over the few spans of one paragraph."""
    listed = spans.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("rank", "start", "end", "tag", "rid"))).alias("_spans"))
    keep = lambda kept, s: F.when(F.exists(kept, lambda k: (k["start"] < s["end"]) & (s["start"] < k["end"])), kept).otherwise(F.concat(kept, F.array(F.struct(s["start"].alias("start"), s["end"].alias("end"), s["tag"].alias("tag"), s["rid"].alias("rid")))))
    empty = F.expr("cast(array() as array<struct<start:int,end:int,tag:string,rid:string>>)")
    chosen = F.array_sort(F.aggregate("_spans", empty, keep))

    def put(acc: Column, s: Column) -> Column:
        before = F.substring(F.col("text"), acc["at"] + 1, s["start"] - acc["at"])
        inner = F.substring(F.col("text"), s["start"] + 1, s["end"] - s["start"])
        return F.struct(F.concat(acc["out"], escape(before), F.lit('<xref ref-type="'), s["tag"], F.lit('" rid="'), s["rid"], F.lit('">'), escape(inner), F.lit("</xref>")).alias("out"), s["end"].alias("at"))

    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))
    spliced = F.aggregate(F.coalesce(chosen, empty), start, put, lambda a: F.concat(a["out"], escape(F.substring(F.col("text"), a["at"] + 1, F.length("text")))))
    return paragraphs.join(listed, keys, "left").select(*keys, spliced.alias("marked"))


def marked_paragraphs(paragraphs: DataFrame, citations: DataFrame, floats: DataFrame, notes: DataFrame, n_refs: DataFrame | None = None) -> DataFrame:
    """paragraphs (doc_id, para_no, text) with marked: their text as XML, with links put in. In the order that decides where
    they overlap: calls [^n] to the k-th note of their label (notes: doc_id, label, note_no, id), in numeric styles to the
    references they count (n_refs: doc_id, n), else raised; the first free place of each citation's text (citations: doc_id,
    cit_no, text, rid); then figures, tables and equations by their numbers (floats: doc_id, kind, number, rid).
    """
    called = paragraphs.select("doc_id", "para_no", F.posexplode(F.regexp_extract_all("text", F.lit(CALL), F.lit(1))).alias("k", "label"))
    turn = lambda *by: F.row_number().over(Window.partitionBy("doc_id", "label").orderBy(*by))
    linked = called.withColumn("_turn", turn("para_no", "k")).join(many(notes.withColumn("_turn", turn("note_no")).select("doc_id", "label", "_turn", "id")), ["doc_id", "label", "_turn"], "left")
    calls = linked.groupBy("doc_id", "para_no").agg(F.transform(F.sort_array(F.collect_list(F.struct("k", "id"))), lambda s: F.coalesce(s["id"], F.lit(""))).alias("_calls"))
    cites = citations.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("cit_no", "text", "rid"))).alias("_cites"))
    things = floats.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("kind", "number", "rid"))).alias("_floats"))
    rows = paragraphs.join(many(cites), "doc_id", "left").join(many(things), "doc_id", "left")
    rows = rows.join(many(n_refs.select("doc_id", F.col("n").alias("_n"))), "doc_id", "left") if n_refs is not None else rows.withColumn("_n", F.lit(0))
    rows = rows.join(many(calls), ["doc_id", "para_no"], "left")

    @F.arrow_udf("string")
    def mark(texts: pa.Array, calls: pa.Array, cites: pa.Array, things: pa.Array, n: pa.Array) -> pa.Array:
        rows = zip(_values(texts), listed(calls), listed(cites), listed(things), n.to_pylist(), strict=True)
        return pa.array([None if t is None else linked_text(t, c, q, f, k or 0) for t, c, q, f, k in rows], pa.string())

    return rows.select("doc_id", "para_no", mark("text", "_calls", "_cites", "_floats", F.col("_n").cast("int")).alias("marked"))


CALL = r"\[\^([^\]]{1,16})\]"
_CALL, _SPECIAL = re.compile(CALL), re.compile("[&<>\"']")
# Words before the number of each kind of float.
FLOAT_WORDS = {"fig": r"(?:Fig(?:ura|\.)|Figure)\s*", "table": r"(?i:(?:Tabela|Table|Quadro|Cuadro)s?)\.?\s*", "equation": r"(?i:equa[çc][ãa]o|equation|eq\.?|f[óo]rmula)\s*\(?"}
_FLOAT_WORDS = {kind: re.compile(rf"\b{words}") for kind, words in FLOAT_WORDS.items()}
FLOAT_TYPES = {"fig": "fig", "table": "table", "equation": "disp-formula"}


def _values(texts: pa.Array) -> list[str | None]:
    return texts.to_numpy(zero_copy_only=False).tolist()


def listed(lists: pa.Array) -> list[list]:
    """The lists of an array of texts, or of structs as dicts of their texts; none for null. Values are taken column by
    column, which is many times faster than list by list."""
    flat, out, at = lists.flatten(), [], 0
    names = [f.name for f in flat.type if pa.types.is_string(f.type)] if pa.types.is_struct(flat.type) else []
    items = [dict(zip(names, v, strict=True)) for v in zip(*(_values(flat.field(n)) for n in names), strict=True)] if names else _values(flat)
    for n in lists.value_lengths().fill_null(0).to_numpy().tolist():
        out.append(items[at : at + n])
        at += n
    return out


@lru_cache(maxsize=10_000)
def _mention(kind: str, number: str) -> re.Pattern:
    close = r"\)?" if kind == "equation" else ""
    return re.compile(rf"\b{FLOAT_WORDS[kind]}{re.escape(number)}{close}(?!\d)")


def plain(text: str) -> str:
    return escaped(text) if _SPECIAL.search(text) else text


def _places(text: str, part: str) -> Iterator[tuple[int, int]]:
    at = text.find(part)
    while at >= 0:
        yield at, at + len(part)
        at = text.find(part, at + len(part))


def linked_text(text: str, calls: list[str], citations: list[dict], floats: list[dict], n_refs: int) -> str:
    """One paragraph as XML; see marked_paragraphs()."""
    put: list[tuple[int, int, str]] = []
    free = lambda a, b: all(b <= x or y <= a for x, y, _ in put)
    link = lambda kind, rid, inner: f'<xref ref-type="{kind}" rid="{plain(rid)}">{inner}</xref>'
    for k, m in enumerate(_CALL.finditer(text)):
        label, rid = m[1], calls[k] if k < len(calls) else ""
        if rid:
            made = link("fn", rid, f"<sup>{plain(label)}</sup>")
        elif numbers := counted(label, n_refs):
            parts = re.split(r"\s*[,;]\s*", label)
            own = len(parts) == len(numbers)
            made = ("," if own else "").join(link("bibr", f"B{n}", f"<sup>{parts[i] if own else n}</sup>") for i, n in enumerate(numbers))
        else:
            made = f"<sup>{plain(label)}</sup>"
        put.append((*m.span(), made))
    for c in citations:
        places = _places(text, c["text"]) if c["text"] and c["rid"] else ()
        spot = next((p for p in places if free(*p)), None)
        if spot:
            put.append((*spot, link("bibr", c["rid"], plain(text[slice(*spot)]))))
    for kind, words in _FLOAT_WORDS.items():
        # most paragraphs lack the number, or the word of the kind
        for f in [f for f in floats if f["kind"] == kind and f["number"] and f["number"] in text]:
            if words.search(text):
                for m in _mention(kind, f["number"]).finditer(text):
                    if free(*m.span()):
                        put.append((*m.span(), link(FLOAT_TYPES[kind], f["rid"], plain(m[0]))))
    out, at = [], 0
    for a, b, made in sorted(put):
        out += [plain(text[at:a]), made]
        at = b
    return "".join([*out, plain(text[at:])])


def counted(label: str, most: int) -> list[int]:
    """The reference numbers of a numeric call such as 1,2 or 4-6; none if any is out of range."""
    out: list[int] = []
    for part in label.replace(" ", "").replace(";", ",").split(","):
        ends = part.replace("–", "-").split("-")
        if not most or len(ends) > 2 or not all(e.isdigit() for e in ends) or not 1 <= int(ends[0]) <= int(ends[-1]) <= most or int(ends[-1]) - int(ends[0]) > 30:
            return []
        out += range(int(ends[0]), int(ends[-1]) + 1)
    return out
