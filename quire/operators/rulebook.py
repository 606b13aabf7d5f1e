"""The rule catalogue: what an article still lacks, and what blocks or dims its delivery.

An article is a set of relations: docs (one row each) and its parts (titles, authors, ...), each with doc_id and pos. A
rule is a row of PENDING or FINDINGS: the relation it reads, its id, code, severity, form field and condition, the last two
as SQL over the relation's columns. Every relation is read once, whatever the number of its rules. Codes are shared by
rules, so (code, rule_id) is the key of a finding.
"""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Columns of each relation beside doc_id and pos; parts with removed = true don't count.
RELATIONS = {
    "docs": "journal_known boolean, journal_unsure boolean, article_type string, doi string, order_no string, order_source string, heading string, heading_source string, volume string, elocation string, fpage string, language string, licence_url string, licence_source string, published string, year string, year_source string, received string, accepted string, page_count int, funding_text string, funding_sources int, text_layer boolean, ocr boolean, reference_list boolean, reference_style string, journal_style string",
    "titles": "text string, language string, kind string",
    "authors": "name string, surname string, orcid string, orcid_valid boolean, email string, aff_ids array<string>, removed boolean",
    "affiliations": "id string, institution string, country string, from_prose boolean, removed boolean",
    "abstracts": "text string, language string, keywords array<string>, label_language string, removed boolean",
    "sections": "title string, removed boolean",
    "figures": "label string, caption string, file string, kind string, called boolean, removed boolean",
    "tables": "label string, caption string, cells array<array<string>>, file string, called boolean, unsure_columns boolean, removed boolean",
    "equations": "label string, number int, mathml string, latex string, error string, file string, removed boolean",
    "boxes": "text string, removed boolean",
    "dialogues": "turns int, removed boolean",
    "refs": "cited boolean, confidence string, access_date string, link string",
    "notes": "label string, called boolean, removed boolean",
    "calls": "label string, has_note boolean",
}
# Article types that need an abstract and a history.
WITH_ABSTRACT = ("research-article", "review-article")


class Rule(NamedTuple):
    relation: str
    rule_id: str
    code: str
    severity: str
    field: str
    holds: str


def _none(x: str) -> str:
    return f"coalesce(trim({x}), '') = ''"


_TYPED = "coalesce(article_type, 'research-article') in (" + ", ".join(f"'{t}'" for t in WITH_ABSTRACT) + ")"
_DATED = r"rlike '^\\d{4}-\\d{2}-\\d{2}$'"
_BAD_ORCID = f"{_none('orcid')} or orcid_valid = false"

#: What a form still has to ask for, in the screen's order; of several rules of a field the last one counts.
PENDING = (
    Rule("docs", "journal", "", "pending", "journal", "not journal_known"),
    Rule("docs", "heading", "", "pending", "heading", _none("heading")),
    Rule("docs", "doi", "", "pending", "doi", r"not coalesce(trim(doi) rlike '^10\\.\\d{4,9}/\\S+$', false)"),
    Rule("docs", "order", "", "pending", "order", r"not coalesce(trim(order_no) rlike '^\\d{5}$', false)"),
    Rule("docs", "volume", "", "pending", "volume", _none("volume")),
    Rule("docs", "pages", "", "pending", "elocation", f"{_none('elocation')} and {_none('fpage')}"),
    Rule("docs", "language", "", "pending", "language", _none("language")),
    Rule("docs", "licence", "", "pending", "licence", "not coalesce(trim(licence_url) rlike '^https?://creativecommons[.]org/licenses/', false)"),
    Rule("docs", "published", "", "pending", "date_published", f"not coalesce(trim(published) {_DATED}, false)"),
    Rule("docs", "received", "", "pending", "date_received", f"{_TYPED} and not coalesce(trim(received) {_DATED}, false)"),
    Rule("docs", "accepted", "", "pending", "date_accepted", f"{_TYPED} and not coalesce(trim(accepted) {_DATED}, false)"),
    Rule("docs", "title", "", "pending", "title_0_text", f"{_none('first_title')}"),
    Rule("docs", "author", "", "pending", "author_0_surname", "n_authors = 0"),
    Rule("docs", "correspondence", "", "pending", "correspondence", "n_authors > 0 and n_emails = 0"),
    Rule("docs", "abstract", "", "pending", "abstract_0_text", f"{_TYPED} and n_abstracts = 0"),
    Rule("docs", "section", "", "pending", "section_0_title", "n_sections = 0"),
    Rule("docs", "references", "", "pending", "references", "n_refs = 0"),
    Rule("authors", "surname", "", "pending", "concat('author_', pos, '_surname')", _none("surname")),
    Rule("authors", "orcid", "", "pending", "concat('author_', pos, '_orcid')", _BAD_ORCID),
    Rule("authors", "affiliation", "", "pending", "concat('author_', pos, '_affs')", "coalesce(size(aff_ids), 0) <= 0"),
    Rule("affiliations", "institution", "", "pending", "concat('aff_', pos, '_institution')", _none("institution")),
    Rule("affiliations", "country", "", "pending", "concat('aff_', pos, '_country')", _none("country")),
    Rule("abstracts", "abstract-text", "", "pending", "concat('abstract_', pos, '_text')", f"typed and {_none('text')}"),
    Rule("abstracts", "abstract-language", "", "pending", "concat('abstract_', pos, '_language')", f"typed and {_none('language')}"),
    Rule("abstracts", "keywords", "", "pending", "concat('abstract_', pos, '_keywords')", "typed and coalesce(size(keywords), 0) <= 0"),
    Rule("sections", "section-title", "", "pending", "concat('section_', pos, '_title')", _none("title")),
    Rule("tables", "table-caption", "", "pending", "concat('table_', pos, '_caption')", _none("caption")),
    Rule("tables", "table-cells", "", "pending", "concat('table_', pos, '_cells')", f"coalesce(size(cells), 0) <= 0 and {_none('file')}"),
    Rule("figures", "figure-caption", "", "pending", "concat('figure_', pos, '_caption')", f"coalesce(kind, 'fig') = 'fig' and {_none('caption')}"),
    Rule("figures", "figure-file", "", "pending", "concat('figure_', pos, '_file')", f"coalesce(kind, 'fig') = 'fig' and {_none('file')}"),
    Rule("equations", "equation", "", "pending", "concat('equation_', pos, '_latex')", _none("mathml")),
    Rule("boxes", "box", "", "pending", "concat('box_', pos, '_text')", _none("text")),
    Rule("dialogues", "dialogue", "", "pending", "concat('dialogue_', pos, '_turns')", "coalesce(turns, 0) = 0"),
)

#: What the generator reports. The field is where the finding points to: the part's place, or empty for the document.
FINDINGS = (
    Rule("docs", "no-text-layer", "D01", "blocker", "''", "not coalesce(text_layer, true) and not coalesce(ocr, false)"),
    Rule("docs", "text-from-ocr", "D02", "warning", "''", "coalesce(ocr, false)"),
    Rule("docs", "journal-unresolved", "J01", "blocker", "''", "not journal_known"),
    Rule("docs", "journal-unsure", "", "warning", "''", "journal_known and coalesce(journal_unsure, false)"),
    Rule("docs", "doi-missing", "A01", "blocker", "''", _none("doi")),
    Rule("docs", "order-derived", "A02", "warning", "''", f"not ({_none('order_no')}) and order_source = 'elocation'"),
    Rule("docs", "order-missing", "A02", "blocker", "''", _none("order_no")),
    Rule("docs", "heading-of-journal", "A04", "warning", "''", f"not ({_none('heading')}) and heading_source = 'journal'"),
    Rule("docs", "heading-missing", "A04", "blocker", "''", _none("heading")),
    Rule("docs", "title-missing", "A05", "blocker", "''", _none("main_title")),
    Rule("titles", "translation-without-language", "", "warning", "pos", f"kind = 'trans-title' and {_none('language')}"),
    Rule("abstracts", "abstract-without-title", "A06", "warning", "pos", "not title_there"),
    Rule("docs", "volume-missing", "A08", "blocker", "''", _none("volume")),
    Rule("docs", "pages-missing", "A08", "blocker", "''", f"{_none('elocation')} and {_none('fpage')}"),
    Rule("docs", "year-of-copyright", "A08", "warning", "''", "year_source = 'copyright'"),
    Rule("docs", "only-year", "A09", "blocker", "''", f"not coalesce(published {_DATED}, false) and not ({_none('year')})"),
    Rule("docs", "date-missing", "A09", "blocker", "''", f"not coalesce(published {_DATED}, false) and {_none('year')}"),
    Rule("docs", "abstract-missing", "A12", "blocker", "''", f"{_TYPED} and n_abstracts = 0"),
    Rule("abstracts", "keywords-missing", "A13", "blocker", "pos", "coalesce(size(keywords), 0) <= 0"),
    Rule("docs", "funding-without-source", "A14", "warning", "''", f"not ({_none('funding_text')}) and coalesce(funding_sources, 0) = 0"),
    Rule("docs", "page-count-unknown", "A15", "warning", "''", "page_count is null"),
    Rule("docs", "author-missing", "C01", "blocker", "''", "n_authors = 0"),
    Rule("authors", "orcid-invalid", "C02", "blocker", "pos", f"not ({_none('orcid')}) and orcid_valid = false"),
    Rule("authors", "orcid-missing", "C02", "blocker", "pos", _none("orcid")),
    Rule("authors", "affiliation-missing", "C03", "blocker", "pos", "coalesce(size(aff_ids), 0) <= 0"),
    Rule("affiliations", "institution-missing", "C05", "blocker", "pos", _none("institution")),
    Rule("affiliations", "country-missing", "C05", "blocker", "pos", _none("country")),
    Rule("affiliations", "affiliation-unsure", "", "warning", "pos", "coalesce(from_prose, false)"),
    Rule("docs", "email-missing", "C07", "blocker", "''", "n_emails = 0"),
    Rule("equations", "mathml-malformed", "E01", "blocker", "pos", f"not ({_none('mathml')}) and xpath_missing"),
    Rule("docs", "equations-as-images", "E01", "blocker", "''", "n_image_equations > 0"),
    Rule("equations", "latex-error", "E01", "blocker", "pos", f"not ({_none('error')})"),
    Rule("docs", "equations-as-mathml", "E01", "warning", "''", "n_mathml > 0"),
    Rule("docs", "equation-gap", "E01", "warning", "''", "n_numbers > 0 and last_number - first_number + 1 > n_numbers"),
    Rule("figures", "figure-without-image", "F01", "warning", "pos", f"coalesce(kind, 'fig') = 'fig' and {_none('file')}"),
    Rule("figures", "figure-not-called", "F01", "warning", "pos", f"coalesce(kind, 'fig') = 'fig' and not ({_none('file')}) and not coalesce(called, false)"),
    Rule("figures", "figure-without-caption", "F02", "blocker", "pos", f"coalesce(kind, 'fig') = 'fig' and not ({_none('file')}) and {_none('caption')}"),
    Rule("docs", "history-missing", "H01", "blocker", "''", f"coalesce(article_type, 'research-article') = 'research-article' and {_none('received')} and {_none('accepted')}"),
    Rule("docs", "accepted-before-received", "H02", "warning", "''", "accepted < received"),
    Rule("docs", "licence-of-journal", "L01", "warning", "''", f"not ({_none('licence_url')}) and licence_source = 'journal'"),
    Rule("docs", "licence-missing", "L01", "blocker", "''", _none("licence_url")),
    Rule("calls", "call-without-note", "N01", "warning", "pos", "not has_note"),
    Rule("notes", "note-not-called", "N01", "warning", "pos", f"not ({_none('label')}) and not coalesce(called, false)"),
    Rule("docs", "list-not-found", "R01", "warning", "''", "not coalesce(reference_list, false)"),
    Rule("docs", "list-empty", "R01", "warning", "''", "coalesce(reference_list, false) and n_refs = 0"),
    Rule("docs", "references-missing", "R01", "blocker", "''", "n_refs = 0"),
    Rule("docs", "partly-parsed", "R02", "warning", "''", "n_refs > 0 and n_sure_refs < n_refs"),
    Rule("docs", "style-mismatch", "R02", "warning", "''", f"not ({_none('journal_style')}) and not ({_none('reference_style')}) and not startswith(reference_style, journal_style)"),
    Rule("refs", "reference-uncited", "R03", "warning", "pos", "not coalesce(cited, false)"),
    Rule("refs", "access-without-link", "R04", "warning", "pos", f"not ({_none('access_date')}) and {_none('link')}"),
    Rule("docs", "sections-missing", "S01", "blocker", "''", "n_sections = 0"),
    Rule("tables", "table-without-grid", "T01", "warning", "pos", f"not ({_none('caption')}) and coalesce(size(cells), 0) <= 0 and {_none('file')}"),
    Rule("tables", "table-not-called", "T01", "warning", "pos", "not coalesce(called, false)"),
    Rule("tables", "columns-unsure", "T02", "warning", "pos", "coalesce(unsure_columns, false)"),
    Rule("tables", "table-without-caption", "T02", "blocker", "pos", f"{_none('caption')} and (coalesce(size(cells), 0) > 0 or not ({_none('file')}))"),
    Rule("authors", "surname-missing", "", "warning", "pos", _none("surname")),
    Rule("abstracts", "label-language", "", "warning", "pos", "label_language <> language"),
)


def empty_relation(spark, name: str) -> DataFrame:
    extra = "" if name == "docs" else "pos int, "
    return spark.createDataFrame([], f"doc_id long, {extra}{RELATIONS[name]}")


def live(part: DataFrame) -> DataFrame:
    return part.where(~F.coalesce("removed", F.lit(False))) if "removed" in part.columns else part


def prepared(article: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The live parts, and docs with what their rules need of them: counts, first titles, numbers. Relations that aren't
    given count as empty."""
    spark = article["docs"].sparkSession
    parts = {name: live(article[name] if name in article else empty_relation(spark, name)) for name in RELATIONS}
    count = lambda name, *more: parts[name].groupBy("doc_id").agg(*more)
    n = F.count(F.lit(1))
    filled = lambda c: F.coalesce(F.trim(c), F.lit("")) != ""
    facts = [
        count("titles", F.min(F.struct("pos", "text"))["text"].alias("first_title"), F.min(F.when(F.col("kind") == "article-title", F.struct("pos", "text")))["text"].alias("main_title")),
        count("authors", n.alias("n_authors"), F.count_if(filled("email")).alias("n_emails")),
        count("abstracts", n.alias("n_abstracts")), count("sections", n.alias("n_sections")),
        count("refs", n.alias("n_refs"), F.count_if(F.col("confidence") == "high").alias("n_sure_refs")),
        count("equations", F.count_if(filled("mathml")).alias("n_mathml"), F.count_if(~filled("mathml") & filled("file")).alias("n_image_equations"), F.countDistinct("number").alias("n_numbers"), F.min("number").alias("first_number"), F.max("number").alias("last_number")),
    ]
    docs = reduce(lambda a, b: a.join(b, "doc_id", "left"), facts, parts["docs"])
    numbers = [c for c in docs.columns if c.startswith("n_")]
    parts["docs"] = docs.fillna(0, numbers)
    titled = parts["titles"].where(filled("text")).select("doc_id", F.col("language").alias("_language")).distinct().withColumn("_there", F.lit(True))
    typed = parts["docs"].select("doc_id", F.expr(_TYPED).alias("typed"))
    abstracts = parts["abstracts"]
    parts["abstracts"] = abstracts.join(typed, "doc_id").join(titled, (abstracts["doc_id"] == titled["doc_id"]) & (abstracts["language"] == titled["_language"]), "left").select(abstracts["*"], "typed", F.coalesce("_there", F.lit(False)).alias("title_there"))
    opens, closes = F.regexp_count("mathml", F.lit(r"<[A-Za-z][^>]*[^/]>|<[A-Za-z]>")), F.regexp_count("mathml", F.lit("</[A-Za-z]"))
    parts["equations"] = parts["equations"].withColumn("xpath_missing", F.coalesce(opens != closes, F.lit(False)))
    return parts


def evaluate(parts: dict[str, DataFrame], rules: tuple[Rule, ...]) -> DataFrame:
    """doc_id, rule_no, rule_id, code, severity, field of every rule that holds, over prepared() relations."""
    out = []
    for relation in dict.fromkeys(r.relation for r in rules):
        own = [(i, r) for i, r in enumerate(rules) if r.relation == relation]
        each = [F.when(F.coalesce(F.expr(r.holds), F.lit(False)), F.struct(F.lit(i).alias("rule_no"), F.lit(r.rule_id).alias("rule_id"), F.lit(r.code).alias("code"), F.lit(r.severity).alias("severity"), (F.lit(r.field) if r.severity == "pending" and relation == "docs" else F.expr(r.field).cast("string")).alias("field"))) for i, r in own]
        out.append(parts[relation].select("doc_id", F.explode(F.array_compact(F.array(*each))).alias("x")).select("doc_id", "x.*"))
    return reduce(DataFrame.unionByName, out)


def pending_fields(article: dict[str, DataFrame]) -> DataFrame:
    """doc_id, field, rule_id: the form fields that still have to be filled; of several rules of a field the last stays."""
    found = evaluate(prepared(article), PENDING)
    return found.groupBy("doc_id", "field").agg(F.max_by("rule_id", "rule_no").alias("rule_id"))


def findings(article: dict[str, DataFrame]) -> DataFrame:
    """doc_id, code, rule_id, severity, field of every finding."""
    return evaluate(prepared(article), FINDINGS).select("doc_id", "code", "rule_id", "severity", "field")
