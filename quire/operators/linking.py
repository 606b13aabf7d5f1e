"""Joins that link records: citations to references, journals, captions, anchors, labels and files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quire.functions.text import normal_key


def link_citations(citations: DataFrame, references: DataFrame) -> DataFrame:
    """citations (doc_id, cit_no, author, year) with ref_no of the first reference (doc_id, ref_no, authors, year) whose
    year agrees without its letter and one of whose surnames is the cited one, holds it as a word or starts with it. A
    reference without authors goes by its text up to the first comma or full stop, if references has a text.

    An equi-join on document, year and the first letters of the name or of a word of it (three, or all of a shorter cited
    name) does the bulk; the rest is a residual predicate.
    """
    year = lambda c: F.regexp_replace(c, "[a-f]+$", "")
    cited = F.trim(normal_key(F.regexp_replace(F.regexp_replace(F.col("author"), r" (?:e|and|y) .*$|&.*$", ""), " et al", "")))
    c = citations.withColumn("_cited", cited).withColumn("_year", year(F.col("year")))
    surnames = F.transform("authors", lambda a: normal_key(F.split(a, ",")[0]))
    if "text" in references.columns:
        surnames = F.when(F.exists(surnames, lambda s: s != ""), surnames).otherwise(F.array(normal_key(F.regexp_extract("text", "^([^,.]*)", 1))))
    names = references.select(F.col("doc_id").alias("_doc"), "ref_no", F.explode(surnames).alias("_name"), year(F.col("year")).alias("_ref_year")).where("_name <> ''")
    same = (F.col("_cited") == F.col("_name")) | F.array_contains(F.split("_name", " "), F.col("_cited")) | F.col("_name").startswith(F.col("_cited"))
    starts = lambda w: F.array(*[F.substring(w, 1, n) for n in (1, 2, 3)])
    names = names.withColumn("_start", F.explode(F.array_distinct(F.concat(starts(F.col("_name")), F.flatten(F.transform(F.split("_name", " "), starts))))))
    # of references alike in name and year only the first takes part
    names = names.groupBy("_doc", "_name", "_ref_year", "_start").agg(F.min("ref_no").alias("ref_no"))
    hits = c.where("_cited <> ''").join(names, (F.substring("_cited", 1, 3) == F.col("_start")) & (F.col("doc_id") == F.col("_doc")) & (F.col("_year") == F.col("_ref_year")) & same).groupBy("doc_id", "cit_no").agg(F.min("ref_no").alias("ref_no"))
    return citations.join(hits, ["doc_id", "cit_no"], "left")


def resolve_journals(docs: DataFrame, journals: DataFrame) -> DataFrame:
    """docs (doc_id, issns, doi, code) with the journal's acronym: the explicit code, else the first journal that shares an
    ISSN, else the first whose DOI prefix starts the DOI. journals: rank, acronym, issn_epub, issn_ppub, doi_prefix.

    Only the first journal of each ISSN and of each prefix takes part, so a document meets one row for each of its ISSNs and
    for each length that prefixes have.
    """
    first = lambda rows, key: rows.groupBy(key).agg(F.min(F.struct("rank", "acronym")).alias("_first"))
    numbers = first(journals.select("rank", "acronym", F.explode(F.array("issn_epub", "issn_ppub")).alias("issn")).where("issn is not null"), "issn")
    prefixes = first(journals.where("doi_prefix is not null"), "doi_prefix")
    lengths = prefixes.agg(F.collect_set(F.length("doi_prefix")).alias("_lengths"))
    starts = F.transform(F.filter("_lengths", lambda n: n <= F.length("doi")), lambda n: F.substring(F.col("doi"), F.lit(1), n))
    by_issn = docs.select("doc_id", F.explode("issns").alias("issn")).join(numbers, "issn").select("doc_id", F.lit(1).alias("how"), "_first")
    by_doi = docs.crossJoin(lengths).select("doc_id", F.explode(starts).alias("doi_prefix")).join(prefixes, "doi_prefix").select("doc_id", F.lit(2).alias("how"), "_first")
    found = by_issn.unionByName(by_doi).groupBy("doc_id").agg(F.min(F.struct("how", "_first"))["_first"]["acronym"].alias("_found"))
    return docs.join(found, "doc_id", "left").select("doc_id", F.coalesce("code", "_found").alias("journal"))


def nearest(left: DataFrame, right: DataFrame, keys: list[str], within: Column, distance: Column, right_id: str, reach: tuple[str, str, float, float], left_id: str | None = None) -> DataFrame:
    """Every left row with right_id of the right row of least distance among those that fit (smaller id on ties).

    within and distance don't look at right_id nor left_id: of right rows that are alike but for right_id only the least
    takes part, and left rows that are alike but for left_id are paired once.

    reach: a left and a right column of places, and from where to where the right place less the left one may lie; rows meet
    only in buckets of that width, each left row in two or three. A row with a null place fits nothing.
    """
    here, there, low, high = reach
    bucket = lambda at: F.floor(at / max(high - low, 1.0))
    places = [c for c in right.columns if c != right_id]
    right = right.groupBy(*places).agg(F.min(right_id).alias(right_id))
    seen = [c for c in left.columns if c != left_id]
    kinds = left.where(F.col(here).isNotNull()).select(*seen).distinct()
    spread = kinds.withColumn("_bucket", F.explode(F.sequence(bucket(F.col(here) + low), bucket(F.col(here) + high))))
    pairs = spread.join(right.withColumn("_bucket", bucket(F.col(there))), [*keys, "_bucket"]).where(within)
    best = pairs.groupBy(*seen).agg(F.min_by(right_id, F.struct(distance.alias("d"), F.col(right_id))).alias(right_id))
    return left.join(best, seen, "left")


def anchor(points: DataFrame, anchors: DataFrame, key: str, at: str, name: str) -> DataFrame:
    """As-of join: each point gets the last anchor at or before it. One union and one window, no inequality join."""
    both = points.withColumn("_anchor", F.lit(None).cast(anchors.schema[name].dataType)).withColumn("_kind", F.lit(1)).unionByName(anchors.select(key, at, F.col(name).alias("_anchor"), F.lit(0).alias("_kind")), allowMissingColumns=True)
    order = Window.partitionBy(key).orderBy(at, "_kind", F.col("_anchor").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn(name, F.last("_anchor", ignorenulls=True).over(order)).where("_kind = 1").drop("_anchor", "_kind")


def consume_in_order(calls: DataFrame, notes: DataFrame, keys: list[str]) -> DataFrame:
    """The k-th call of a label consumes the k-th note of that label (call_no, note_id)."""
    k = lambda by: F.row_number().over(Window.partitionBy(*keys).orderBy(by))
    return calls.withColumn("_k", k("call_no")).join(notes.withColumn("_k", k("note_id")), [*keys, "_k"], "left").drop("_k")


def first_appearance_ids(rows: DataFrame, keys: list[str], value: str, seq: str, name: str) -> DataFrame:
    """name: a number by first appearance of each normalised value within keys, so equal values share one."""
    keyed = rows.withColumn("_value", normal_key(F.col(value)))
    firsts = keyed.groupBy(*keys, "_value").agg(F.min(seq).alias("_first"))
    numbered = firsts.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy("_first"))).drop("_first")
    return keyed.join(numbered, [*keys, "_value"]).drop("_value")


def greedy_pairs(captions: DataFrame, grids: DataFrame, page_key: list[str]) -> DataFrame:
    """Captions and grids of a page paired from the top down, each used once; what is left over has a null partner."""
    k = lambda by: F.row_number().over(Window.partitionBy(*page_key).orderBy(*by))
    return captions.withColumn("_k", k(["caption_y", "caption_id"])).join(grids.withColumn("_k", k(["grid_y", "grid_id"])), [*page_key, "_k"], "full").select(*page_key, "caption_id", "grid_id")


def missing(wanted: DataFrame, present: DataFrame, keys: list[str]) -> DataFrame:
    """Wanted rows that aren't present (files cited but not packed, references never cited)."""
    return wanted.join(present.select(*keys).distinct(), keys, "left_anti")


def field_differences(made: DataFrame, official: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Both tables unpivoted and joined by field; ok compares normalised values, nulls being equal to empty ones."""
    tall = lambda df, name: df.select(key, F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias(name)) for f in fields])).alias("_x")).select(key, "_x.field", f"_x.{name}")
    both = tall(official, "expected").join(tall(made, "obtained"), [key, "field"], "full")
    return both.withColumn("ok", normal_key(F.col("expected")) == normal_key(F.col("obtained")))
