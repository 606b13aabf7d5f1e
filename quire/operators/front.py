"""Front matter: identifiers, labels, titles, authors and what belongs to them, abstracts.

Lines are rows of doc_id, line_no (reading order), page, text and, where needed, geometry and style (size, x0, x1, y0, y1,
bold, italic) and zone. Every operator works per document by windows and aggregates, or by joins on the document.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quire.functions.shared import many
from quire.functions.text import DOI, EMAIL, ISSN, ORCID, fold, issn_valid, join_lines, language, last_country, normal_key, trim_doi

# Labels of abstracts with their languages, and of keywords, accents folded.
ABSTRACT_LABELS = {"resumo": "pt", "abstract": "en", "resumen": "es", "riassunto": "it", "resume": "fr", "zusammenfassung": "de", "summary": "en", "sumario executivo": "pt"}
KEYWORD_LABELS = ("palavras-chaves", "palavras-chave", "palavras chaves", "palavras chave", "keywords", "key-words", "key words", "palabras-claves", "palabras-clave", "palabras claves", "palabras clave", "parole chiave", "mots-cles", "mots cles", "schlusselworter")
# Section headings of journals, and words that introduce one, accents folded.
HEADINGS = (
    "artigo", "artigos", "artigos ineditos", "artigos originais", "artigo original", "artigos de revisao", "artigo de revisao", "artigos cientificos", "artigo cientifico", "articulo", "articulos", "articulos originales", "original article", "original articles", "research article", "research articles",
    "editorial", "editoriais", "editoriales", "resenha", "resenhas", "book review", "book reviews", "resena", "resenas", "dossie", "dossier", "dossie tematico", "traducao", "traducoes", "translation", "translations", "entrevista", "entrevistas", "interview", "interviews",
    "ensaio", "ensaios", "essay", "essays", "comunicacao", "comunicacoes", "nota de pesquisa", "notas de pesquisa", "relato de experiencia", "relatos de experiencia", "estudo de caso", "estudos de caso", "debate", "debates", "tema livre", "temas livres", "secao livre",
)
HEADING_LABELS = ("eixo tematico", "secao", "section", "seccion", "area", "tema")
# Beginnings of words for institutions and for what a biography says, accents folded.
INSTITUTIONS = (
    "universi", "faculdade", "faculty", "facultad", "instituto", "institute", "centro", "center", "centre", "escola", "school", "fundacao", "foundation", "programa", "departamento", "department", "pontificia", "college", "defensoria", "ministerio", "tribunal", "hospital",
    "laboratorio", "academia", "conselho", "secretaria", "observatorio", "unidade", "rede",
)
DIVISIONS = ("programa", "departamento", "department", "faculdade", "faculty", "facultad", "escola", "school", "centro", "center", "instituto", "institute", "nucleo", "grupo", "laboratorio", "curso")
BIOGRAPHY = ("doutor", "doctor", "mestre", "master", "professor", "profesor", "pesquisador", "investigador", "researcher", "graduad", "bacharel", "advogad", "defensor", "docente", "pos-doutor", "postdoc", "post-doctoral", "lattes", "orcid", "e-mail", "email")
SUPERSCRIPTS = "¹²³⁴⁵⁶⁷⁸⁹⁰"


def _has(x: Column, words: tuple[str, ...]) -> Column:
    flat = F.lower(fold(x))
    return reduce(lambda a, b: a | b, [flat.contains(w) for w in words])


def _got(x: Column, pattern: str, group: int = 1) -> Column:
    return F.nullif(F.regexp_extract(x, pattern, group), F.lit(""))


#: What stands at the end of a name and isn't the name's.
MARKS = "0123456789*†‡§"
_APART = " \t,;"


def _marked(x: Column) -> Column:
    """A line up to the marks at its end."""
    return F.rtrim(x, F.lit(MARKS + _APART))


def markers(x: Column) -> Column:
    """Author markers of a line: runs of superscripts as digits, else digits, asterisks or daggers at its end; each once."""
    raised = F.transform(F.regexp_extract_all(x, F.lit(f"[{SUPERSCRIPTS}]+"), F.lit(0)), lambda r: F.translate(r, SUPERSCRIPTS, "1234567890"))
    tail = F.substring(x, F.length(_marked(x)) + 1, F.length(x))
    # each kind of mark has a place of its own: numbers, runs of asterisks, single signs
    spread = reduce(lambda t, sign: F.replace(t, F.lit(sign), F.lit(f" {sign} ")), "†‡§", F.regexp_replace(F.regexp_replace(tail, "([0-9]+)", " $1 "), r"(\*+)", " $1 "))
    found = F.filter(F.split(F.translate(spread, _APART, "    "), " +"), lambda m: F.length(m).between(1, F.when(F.startswith(m, F.lit("*")), 4).otherwise(2)))
    return F.array_distinct(F.when(F.size(raised) > 0, raised).otherwise(found))


def without_markers(x: Column) -> Column:
    """A name without its markers."""
    name = _marked(F.translate(x, SUPERSCRIPTS, " " * len(SUPERSCRIPTS)))
    t = F.ltrim(F.regexp_replace(name, r"\s+", " "))
    first = F.substring_index(t, " ", 1)
    only = lambda signs: F.btrim(first, F.lit(signs)) == ""
    leading = (first != "") & (F.length(first) < F.length(t)) & ((only("*") & (F.length(first) <= 4)) | (only("0123456789") & (F.length(first) <= 2)))
    return F.btrim(F.when(leading, F.substring(t, F.length(first) + 1, F.length(t))).otherwise(t), F.lit(" ,;."))


def without_quotes(lines: Column) -> Column:
    """struct(text, closes, opens) of each line of a title: the text without what is quoted within the line, whether it
    closes a quotation of an earlier line, and whether it leaves one open. A fold over the few lines of one title."""
    start = F.struct(F.lit(False).alias("open"), F.expr("cast(array() as array<struct<text:string,closes:boolean,opens:boolean>>)").alias("out"))

    def add(acc: Column, line: Column) -> Column:
        closes = acc["open"] & line.rlike("[”\"]")
        bare = F.regexp_replace(F.regexp_replace(line, "“[^”]*”", " "), "\"[^\"]*\"", " ")
        opens = (bare.contains("“") & ~F.substring_index(bare, "“", -1).contains("”")) | (acc["open"] & ~closes)
        return F.struct(opens.alias("open"), F.concat(acc["out"], F.array(F.struct(F.trim(F.regexp_replace(bare, r"\s+", " ")).alias("text"), closes.alias("closes"), opens.alias("opens")))).alias("out"))

    return F.aggregate(lines, start, add, lambda acc: acc["out"])


def identifiers(sources: DataFrame) -> DataFrame:
    """doc_id with doi, other_dois (at most six), issns (the valid ones, else the first two), volume, issue, year, elocation,
    fpage, lpage. sources: doc_id, rank (0 running head, 1 first page, 2 front), seq, text. A DOI of a running head goes
    first; the journal's own citation (year;volume(issue):page) goes before labelled numbers, these by rank and order. A number
    that a volume, an issue or pages are labelled with is no year."""
    at = F.struct("rank", "seq")
    rows = sources.select("doc_id", at.alias("at"), "rank", "text")
    dois = rows.select("doc_id", "at", "rank", F.posexplode(F.regexp_extract_all("text", F.lit(DOI), F.lit(0))).alias("k", "doi")).withColumn("doi", trim_doi(F.col("doi")))
    dois = dois.groupBy("doc_id", "doi").agg(F.min(F.struct("at", "k")).alias("first"))
    dois = dois.groupBy("doc_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("first", "doi"))), lambda s: s["doi"]).alias("d")).select("doc_id", F.get("d", F.lit(0)).alias("doi"), F.slice(F.col("d"), 2, 6).alias("other_dois"))
    issns = rows.select("doc_id", "at", F.posexplode(F.regexp_extract_all(F.regexp_replace("text", ORCID, " "), F.lit(ISSN), F.lit(1))).alias("k", "issn")).withColumn("issn", F.upper("issn"))
    issns = issns.groupBy("doc_id", "issn").agg(F.min(F.struct("at", "k")).alias("first"))
    issns = issns.groupBy("doc_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("first", "issn"))), lambda s: s["issn"]).alias("i"))
    good = F.filter("i", issn_valid)
    issns = issns.select("doc_id", F.when(F.size(good) > 0, good).otherwise(F.slice("i", 1, 2)).alias("issns"))
    own = r"\b((?:19[5-9]|20[0-4])\d)\s*;\s*(\d{1,3})(?:\s*\(\s*([\w/-]{1,8})\s*\))?\s*:\s*([eE]?\d{1,6})(?:\s*[-–]\s*(\d{1,6}))?"
    cited = rows.where("rank < 2").where(F.col("text").rlike(own)).groupBy("doc_id").agg(F.min_by("text", "at").alias("_own"))
    free = r"(?i)(?<!\b(?:v|vol|volume|n|no|núm|num|número|number|issue|pp?)\.?\s{0,9}\d{4})(?<!\bpp?\.?\s{0,9}\d{1,4}\s{0,9}[-–]\s{0,9}\d{4})"
    patterns = {
        "volume": r"(?i)\b(?:v|vol|volume|ano)\.?\s*(\d+)", "issue": r"(?i)\b(?:n|no|núm|num|número|number|issue)\.?\s*(\d+)", "year": r"\b((?:19[5-9]|20[0-4])\d)\b" + free, "elocation": r"\b(e\d{3,6})\b",
        "fpage": r"\bp\.?\s*(\d{1,4})\s*[-–]\s*\d{1,4}", "lpage": r"\bp\.?\s*\d{1,4}\s*[-–]\s*(\d{1,4})",
    }
    numbers = rows.where("rank < 2").groupBy("doc_id").agg(*[F.min_by(_got(F.col("text"), p), F.when(F.col("text").rlike(p), F.col("at"))).alias(f"_{n}") for n, p in patterns.items()])
    out = sources.select("doc_id").distinct()
    for part in (dois, issns, cited, numbers):
        out = out.join(part, "doc_id", "left")
    own_page, own_last = _got(F.col("_own"), own, 4), _got(F.col("_own"), own, 5)
    paged = own_last.isNotNull() & ~own_page.rlike("(?i)^e")
    located = F.when(paged, None).otherwise(F.lower(own_page))
    elocation = F.coalesce(located, F.col("_elocation"))
    fpage, lpage = F.coalesce(F.when(paged, own_page), F.col("_fpage")), F.coalesce(F.when(paged, own_last), F.col("_lpage"))
    return out.select("doc_id", "doi", F.coalesce("other_dois", F.expr("cast(array() as array<string>)")).alias("other_dois"), F.coalesce("issns", F.expr("cast(array() as array<string>)")).alias("issns"), F.coalesce(_got(F.col("_own"), own, 2), "_volume").alias("volume"), F.coalesce(_got(F.col("_own"), own, 3), "_issue").alias("issue"), F.coalesce(_got(F.col("_own"), own, 1), "_year").alias("year"), elocation.alias("elocation"), fpage.alias("fpage"), lpage.alias("lpage"))


def section_heading(candidates: DataFrame) -> DataFrame:
    """doc_id and heading: a labelled one first ('Seção: X'), then a bare label, then a dossier's; each the first in order.
    candidates: doc_id, seq, text."""
    t = F.trim("text")
    labelled = F.regexp_extract(t, r"^[^:\-–]{3,20}\s*[:\-–]\s*(.+)$", 1)
    label = F.trim(F.lower(fold(F.regexp_extract(t, r"^([^:\-–]{3,20}?)\s*[:\-–]\s*.+$", 1))))
    bare = F.btrim(t, F.lit("[] "))
    squeezed = F.lower(fold(F.regexp_replace(bare, r"\s+", " ")))
    kind = F.when(label.isin(*HEADING_LABELS) & (F.length(labelled) <= 60), F.struct(F.lit(1).alias("tier"), "seq", F.btrim(labelled, F.lit(" .")).alias("heading")))
    kind = kind.when(squeezed.isin(*HEADINGS) & (F.length(t) < 60), F.struct(F.lit(2).alias("tier"), F.col("seq"), bare.alias("heading")))
    kind = kind.when(label.isin("dossie", "dossier", "dossieer"), F.struct(F.lit(3).alias("tier"), F.col("seq"), F.concat(F.trim(F.regexp_extract(t, r"^([^:\-–]+?)\s*[:\-–]", 1)), F.lit(": "), F.trim(labelled)).alias("heading")))
    return candidates.select("doc_id", kind.alias("x")).where("x is not null").groupBy("doc_id").agg(F.min("x").alias("x")).select("doc_id", "x.heading")


def author_lines(scored: DataFrame, most_gap: int = 6) -> DataFrame:
    """The lines of the author run: lines of score 2 or more (of 1 where there are none), from the first on as long as the
    next one is at most most_gap lines away. scored: doc_id, line_no, score."""
    best = F.max("score").over(Window.partitionBy("doc_id"))
    rows = scored.withColumn("_best", best).where((F.col("score") >= 1) & ((F.col("_best") < 2) | (F.col("score") >= 2)))
    order = Window.partitionBy("doc_id").orderBy("line_no")
    far = F.coalesce((F.col("line_no") - F.lag("line_no").over(order)) > most_gap, F.lit(False))
    return rows.withColumn("_run", F.sum(far.cast("int")).over(order)).where("_run = 0").drop("_run", "_best")


def split_authors(x: Column) -> Column:
    """The names of an author line, markers gone."""
    parts = F.split(without_markers(x), r"\s*(?:;|\||,|\s(?:e|and|y)\s)\s*")
    return F.filter(F.transform(parts, without_markers), lambda p: p != "")


def title_candidate(text: Column, size: Column, body: Column, emphasised: Column) -> Column:
    """Whether a line of the front may be part of a title."""
    t = F.trim(text)
    noise = t.rlike(DOI) | t.rlike(ISSN) | t.rlike(EMAIL) | F.lower(fold(t)).rlike("©|issn|doi|recebid|aceit|submetid|aprovad|licenca|creative")
    label = F.lower(fold(F.regexp_extract(t, r"^([^:.\-–]+)", 1)))
    labels = F.trim(label).isin(*ABSTRACT_LABELS, *KEYWORD_LABELS, *HEADINGS, *HEADING_LABELS)
    lone = (F.size(F.split(t, r"\s+")) < 2) & (size < body * 1.3)
    return (F.length(t) > 3) & (size >= body * 0.9) & (emphasised | (size >= body * 1.15)) & ~noise & ~labels & ~lone & ~t.rlike(r"^\d+\s+\S+\.\s+\d+\s+\S+")


def title_groups(candidates: DataFrame) -> DataFrame:
    """doc_id, title_no (from 1), text and language of the titles: neighbouring candidate lines of one style (size within
    0.7, bold, italic) and, where both lines' languages are known, of one language. The first is the article's title."""
    order = Window.partitionBy("doc_id").orderBy("line_no")
    was = lambda c: F.lag(c).over(order)
    rows = candidates.withColumn("_lang", language(F.col("text"))["lang"])
    style = (F.abs(F.col("size") - was("size")) > 0.7) | (F.col("bold") != was("bold")) | (F.col("italic") != was("italic"))
    tongue = F.coalesce(F.col("_lang") != was("_lang"), F.lit(False))
    rows = rows.withColumn("title_no", F.sum(F.coalesce(style | tongue, F.lit(True)).cast("int")).over(order))
    listed = F.transform(F.sort_array(F.collect_list(F.struct("line_no", "text"))), lambda s: s["text"])
    made = rows.groupBy("doc_id", "title_no").agg(join_lines(listed).alias("_t"), listed.alias("_lines"))
    one_pair = F.col("_t").rlike("^“[^“”]*”$") | F.col("_t").rlike('^"[^"]*"$')
    text = F.when(one_pair, F.trim(F.expr("substring(_t, 2, length(_t) - 2)"))).otherwise(F.col("_t"))
    text = F.trim(F.regexp_replace(text, f"[{SUPERSCRIPTS}]+$", ""))
    unquoted = F.array_join(F.transform(without_quotes(F.col("_lines")), lambda s: s["text"]), " ")
    # the whole is read where it isn't the same as the part without quotes
    made = made.select("doc_id", "title_no", text.alias("text"), F.lower(unquoted).alias("_plain"), F.lower("_t").alias("_whole"))
    whole = F.when(~F.col("_whole").eqNullSafe(F.col("_plain")), F.col("_whole"))
    return made.select("doc_id", "title_no", "text", F.coalesce(language(F.col("_plain"))["lang"], language(whole)["lang"]).alias("language"))


def support_kind(text: Column) -> Column:
    """id for lines with ORCID, Lattes, e-mail or address; aff for affiliations; null for others."""
    t = F.trim(text)
    return F.when(t.rlike(r"(?i)orcid|lattes|@|https?://"), "id").when(_has(t, INSTITUTIONS) | t.rlike(f"^[{SUPERSCRIPTS}\\d*]+\\s"), "aff")


def assign_support(support: DataFrame, authors: DataFrame) -> DataFrame:
    """doc_id, line_no, author of each support line (doc_id, line_no, page, y0, kind) that has one: the nearest author line
    (doc_id, author, page, y0) of its page, above or below. The side is the same for all lines of a kind in a document: that
    of the smaller total distance, where a line without an author counts 1000; equal totals take the one above."""
    c = F.col
    listed = authors.groupBy("doc_id").agg(F.collect_list(F.struct("page", "y0", "author")).alias("_authors"))

    def nearest(side) -> Column:
        mine = F.filter("_authors", lambda a: (a["page"] == c("page")) & side(a["y0"], c("y0") + 1))
        return F.array_min(F.transform(mine, lambda a: F.struct(F.abs(c("y0") - a["y0"]).alias("gap"), a["author"].alias("author"))))

    hits = support.join(many(listed), "doc_id", "left").select("doc_id", "line_no", "kind", nearest(lambda y, at: y <= at).alias("_above"), nearest(lambda y, at: y > at).alias("_below"))
    near = hits.groupBy("doc_id", "kind", "line_no").agg(F.min("_above").alias("_above"), F.min("_below").alias("_below"))
    total = lambda hit: F.sum(F.coalesce(c(hit)["gap"], F.lit(1000.0))).over(Window.partitionBy("doc_id", "kind"))
    near = near.withColumn("_hit", F.when(total("_above") <= total("_below"), c("_above")).otherwise(c("_below")))
    return near.where("_hit is not null").select("doc_id", "line_no", "kind", c("_hit.author").alias("author"))


def author_notes(authors: DataFrame, notes: DataFrame) -> DataFrame:
    """doc_id, author, note_no of the biographical notes (doc_id, note_no, page, label, text) of pages 1 and 2 whose label is
    one of the author's markers; the only author of a document without one takes its first biographical note."""
    early = notes.where("page <= 2")
    matched = authors.select("doc_id", "author", F.explode("markers").alias("label")).join(early.where(F.col("label") != ""), ["doc_id", "label"])
    told = matched.where(_has(F.col("text"), BIOGRAPHY) | _has(F.col("text"), INSTITUTIONS)).select("doc_id", "author", "note_no")
    alone = authors.groupBy("doc_id").agg(F.count(F.lit(1)).alias("_n"), F.first("author").alias("author")).where("_n = 1")
    first = early.where(_has(F.col("text"), BIOGRAPHY)).groupBy("doc_id").agg(F.min("note_no").alias("note_no"))
    rest = alone.join(matched.select("doc_id").distinct(), "doc_id", "left_anti").join(first, "doc_id")
    return told.unionByName(rest.select("doc_id", "author", "note_no"))


def note_orcids(authors: DataFrame, notes: DataFrame) -> DataFrame:
    """doc_id, author, orcid of authors (doc_id, author, surname) from the first note with an ORCID that names the surname."""
    rows = notes.withColumn("_orcid", F.upper(_got(F.col("text"), ORCID))).where("_orcid is not null").select("doc_id", "note_no", "_orcid", normal_key(F.col("text")).alias("_key"))
    both = authors.withColumn("_name", normal_key(F.col("surname"))).join(rows, "doc_id").where((F.col("_name") != "") & F.col("_key").contains(F.col("_name")))
    return both.groupBy("doc_id", "author").agg(F.min_by("_orcid", "note_no").alias("orcid"))


def loose_orcids(lines: DataFrame, used: DataFrame) -> DataFrame:
    """doc_id, orcid of the ORCIDs in lines that no author has, each once."""
    found = lines.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(ORCID), F.lit(1))).alias("orcid")).select("doc_id", F.upper("orcid").alias("orcid")).distinct()
    return found.join(used.select("doc_id", "orcid").distinct(), ["doc_id", "orcid"], "left_anti")


def sidebar_emails(authors: DataFrame, lines: DataFrame, reach: int = 5) -> DataFrame:
    """doc_id, author, email: from the first line of the sidebar that holds the author's name on, the first e-mail within
    reach lines. lines: doc_id, line_no (gapless)."""
    named = authors.withColumn("_name", normal_key(F.col("name"))).join(lines.select("doc_id", "line_no", normal_key(F.col("text")).alias("_key")), "doc_id")
    first = named.where((F.col("_name") != "") & F.col("_key").contains(F.col("_name"))).groupBy("doc_id", "author").agg(F.min("line_no").alias("_at"))
    mails = lines.withColumn("email", F.rtrim(_got(F.col("text"), f"({EMAIL})"), F.lit("."))).where("email is not null").select("doc_id", "line_no", "email")
    near = first.join(mails, "doc_id").where(F.col("line_no").between(F.col("_at"), F.col("_at") + reach - 1))
    return near.groupBy("doc_id", "author").agg(F.min_by("email", "line_no").alias("email"))


# Small words that lead from a division to its institution, and those within names of places.
LEADING = ("da", "do", "de", "la", "del", "the", "of", "at")
LEADING_PAIRS = ("de la", "of the")
WITHIN_NAMES = ("de", "da", "do", "das", "dos")


def _starts(x: Column, words) -> Column:
    return F.exists(F.array(*[F.lit(w) for w in words]), lambda w: F.startswith(x, w))


def _place(text: Column) -> Column:
    """struct(city, state): the first part of two capitals, and the capitalised words that end the part before it."""
    parts = F.transform(F.split(text, r"[-–/(),]"), lambda p: F.trim(p))
    lead = lambda p: F.regexp_extract(p, r"^\p{L}+", 0)
    capital = lambda w: w.rlike(r"^\p{Lu}\p{L}+$")

    def city(part: Column) -> Column:
        # backwards over the words: up to four capitalised ones, small ones only between them
        def step(acc: Column, w: Column) -> Column:
            more = F.struct(F.concat(F.array(w), acc["pending"], acc["taken"]).alias("taken"), F.expr("cast(array() as array<string>)").alias("pending"), (acc["n"] + 1).alias("n"), F.lit(True).alias("open"))
            between = F.struct(acc["taken"].alias("taken"), F.array(w).alias("pending"), acc["n"].alias("n"), F.lit(True).alias("open"))
            shut = F.struct(acc["taken"].alias("taken"), acc["pending"].alias("pending"), acc["n"].alias("n"), F.lit(False).alias("open"))
            return F.when(~acc["open"], acc).when(capital(w) & (acc["n"] < 4), more).when(w.isin(*WITHIN_NAMES) & (acc["n"] > 0) & (F.size(acc["pending"]) == 0), between).otherwise(shut)

        none = F.expr("cast(array() as array<string>)")
        start = F.struct(none.alias("taken"), none.alias("pending"), F.lit(0).alias("n"), F.lit(True).alias("open"))
        return F.array_join(F.aggregate(F.reverse(F.split(part, r"\s+")), start, step)["taken"], " ")

    def read(p: Column) -> Column:
        states = lambda i: (F.length(lead(F.get(p, i))) == 2) & lead(F.get(p, i)).rlike("^[A-Z]{2}$") & (city(F.get(p, i - 1)) != "")
        at = F.when(F.size(p) > 1, F.get(F.filter(F.sequence(F.lit(1), F.size(p) - 1), states), F.lit(0)))
        return F.struct(F.when(at.isNotNull(), city(F.get(p, at - 1))).alias("city"), F.when(at.isNotNull(), lead(F.get(p, at))).alias("state"))

    return F.transform(F.array(parts), read)[0]


def affiliation(text: Column, structured: Column) -> Column:
    """struct(institution, division, city, state, country): structured lines by their commas, prose by its words."""
    iso = last_country(text)["iso"]
    parts = F.filter(F.transform(F.split(text, ","), lambda p: F.btrim(p, F.lit(" ."))), lambda p: p != "")
    n = F.size(parts)
    by_comma = structured & (n >= 2)
    city = F.when(n >= 3, parts[1]).when((n == 2) & iso.isNull(), parts[1])
    state = F.when((n >= 4) | ((n == 3) & iso.isNull()), parts[2])
    flat = fold(text)
    # accents are folded one by one, so that places in the folded text hold for the text
    where = F.regexp_instr(flat, F.lit(rf"(?i)(?<!\p{{L}})(?:{'|'.join(INSTITUTIONS)})"))
    named = F.regexp_extract(F.when(where > 0, F.substring(text, where, F.length(text))), r"^([^.;(),]*)", 1)
    named = F.btrim(F.regexp_replace(named, r"\s(?:e|and|y)\s(?=\p{Ll}).*$", ""), F.lit(" -–"))
    # a division's name ends before the small word that leads to an institution's
    # (read once, as a struct of its words)
    def parted(s: Column) -> Column:
        words, flat_words = s["words"], s["flat"]
        led = lambda i: F.get(flat_words, i - 1).isin(*LEADING) & _starts(F.array_join(F.slice(flat_words, i + 1, F.size(flat_words)), " "), INSTITUTIONS[:18])
        first = F.when(_starts(F.array_join(flat_words, " "), DIVISIONS) & (F.size(words) > 2), F.get(F.filter(F.sequence(F.lit(2), F.size(words) - 1), led), F.lit(0)))
        return F.transform(F.array(first), lambda at: cut_at(words, flat_words, at))[0]

    def cut_at(words: Column, flat_words: Column, at: Column) -> Column:
        two = F.array_join(F.slice(flat_words, F.greatest(at - 1, F.lit(1)), F.lit(2)), " ").isin(*LEADING_PAIRS) & (at > 2)
        division = F.array_join(F.slice(words, F.lit(1), F.greatest(at - F.when(two, 2).otherwise(1), F.lit(0))), " ")
        return F.when(at.isNotNull(), F.struct(division.alias("division"), F.array_join(F.slice(words, at + 1, F.size(words)), " ").alias("whole")))

    named_words = F.struct(F.split(named, r"\s+").alias("words"), F.split(F.lower(fold(named)), r"\s+").alias("flat"))
    both = F.transform(F.array(named_words), parted)[0]
    whole = F.coalesce(both["whole"], named)
    place = _place(text)
    none = F.lit(None).cast("string")
    some = lambda x: F.nullif(x, F.lit(""))
    return F.when(by_comma, F.struct(F.btrim(parts[0], F.lit(" .,;:-–")).alias("institution"), none.alias("division"), city.alias("city"), state.alias("state"), iso.alias("country"))).otherwise(
        F.struct(some(F.btrim(whole, F.lit(" .,;:-–"))).alias("institution"), both["division"].alias("division"), place["city"].alias("city"), place["state"].alias("state"), iso.alias("country"))
    )


def abstracts(lines: DataFrame, sure: float = 0.15) -> DataFrame:
    """doc_id, abstract_no, label, language, text, keywords of the abstracts. lines: doc_id, line_no, text, bold.

    A label opens a block; from a label of keywords on, lines are keywords up to the first that ends in a full stop; what
    follows belongs to the abstract again. The detected language wins over the label's if it is sure.
    """
    order = Window.partitionBy("doc_id").orderBy("line_no")
    flat = F.lower(fold(F.trim("text")))
    names = "|".join(ABSTRACT_LABELS)
    label, rest = F.regexp_extract(flat, rf"^({names})(?=\s*[:.\-–]|\s|$)", 1), F.regexp_replace(F.trim("text"), r"^\S+(?:\s+(?i:executivo))?\s*[:.\-–]?\s*", "")
    marked = F.col("bold") | (F.col("text") == F.upper("text")) | F.trim("text").endswith(":") | (F.length("text") < 25) | (rest != "")
    opens = (label != "") & marked
    rows = lines.withColumn("_label", F.when(opens, label)).withColumn("_said", F.when(opens, rest).otherwise(F.col("text")))
    rows = rows.withColumn("abstract_no", F.count("_label").over(order)).where("abstract_no > 0")
    block = Window.partitionBy("doc_id", "abstract_no").orderBy("line_no")
    said = F.lower(fold(F.col("_said")))
    key = rf"(?:{'|'.join(KEYWORD_LABELS)})\s*[:.\-–]?\s*"
    rows = rows.withColumn("_key_at", F.regexp_instr(said, F.lit(key))).withColumn("_is_key", F.col("_key_at") > 0)
    rows = rows.withColumn("_seen", F.max(F.col("_is_key").cast("int")).over(block))
    first_key = F.coalesce(F.sum(F.col("_is_key").cast("int")).over(block.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) == 0
    rows = rows.withColumn("_first", F.col("_is_key") & first_key)
    length = F.length(F.regexp_extract(F.substring(said, F.col("_key_at"), F.length(said)), rf"^({key})", 1))
    words = F.when(F.col("_first"), F.substring("_said", F.col("_key_at") + length, F.length("_said"))).otherwise(F.col("_said"))
    rows = rows.withColumn("_words", words)
    # keywords go on while no keyword line before ended in a full stop
    stop = F.when(F.col("_seen") == 1, F.trim("_words").endswith(".").cast("int"))
    rows = rows.withColumn("_ended", F.coalesce(F.max(stop).over(block.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    in_keys = (F.col("_seen") == 1) & (F.col("_ended") == 0)
    kept = F.when(F.col("_first"), F.trim(F.left("_said", F.col("_key_at") - 1))).when(~in_keys | (F.col("_seen") == 0), F.col("_said"))
    in_order = lambda c, name: F.transform(F.sort_array(F.collect_list(F.when(c.isNotNull() & (c != ""), F.struct("line_no", c.alias("t"))))), lambda s: s["t"]).alias(name)
    out = rows.groupBy("doc_id", "abstract_no").agg(F.max("_label").alias("label"), in_order(kept, "_text"), in_order(F.when(in_keys, F.col("_words")), "_keys"))
    keys = join_lines(F.col("_keys"))
    listed = F.filter(F.transform(F.split(keys, F.when(keys.contains(";"), ";").otherwise(",")), lambda k: F.btrim(k, F.lit(" ."))), lambda k: k != "")
    out = out.withColumn("text", join_lines(F.col("_text"))).withColumn("keywords", listed)
    found = language(F.col("text"))
    own = F.create_map(*[F.lit(x) for pair in ABSTRACT_LABELS.items() for x in pair])[F.col("label")]
    out = out.withColumn("_found", found)
    chosen = F.when((F.col("_found.confidence") >= sure) & F.col("_found.lang").isNotNull() & (F.col("_found.lang") != own), F.col("_found.lang")).otherwise(F.coalesce(own, F.col("_found.lang")))
    return out.select("doc_id", "abstract_no", "label", chosen.alias("language"), "text", "keywords")
