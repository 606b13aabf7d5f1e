"""Captured responses of journal and article registries as tables; no query ever calls a service."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.functions.text import normal_key

WORK = "struct<title:array<string>,volume:string,issue:string,page:string,license:array<struct<URL:string>>,issued:struct<`date-parts`:array<array<int>>>,author:array<struct<family:string,given:string>>>"


def works(responses: DataFrame) -> DataFrame:
    """doi, title, volume, issue, fpage, lpage, licence, published and n_authors of captured work records (doi, body). A date
    counts only with all of its three parts; a body that is no JSON gives nulls."""
    m = responses.select("doi", F.from_json("body", WORK).alias("m"))
    date = F.try_element_at(F.col("m.issued.date-parts"), F.lit(1))
    two = lambda i: F.lpad(F.element_at(date, i).cast("string"), 2, "0")
    page = lambda g: F.nullif(F.regexp_extract("m.page", r"^(\w+)(?:-(\w+))?", g), F.lit(""))
    return m.select(
        "doi", F.try_element_at("m.title", F.lit(1)).alias("title"), "m.volume", "m.issue", page(1).alias("fpage"), page(2).alias("lpage"), F.try_element_at("m.license", F.lit(1))["URL"].alias("licence"),
        F.when(F.size(date) == 3, F.concat_ws("-", F.element_at(date, 1).cast("string"), two(2), two(3))).alias("published"), F.coalesce(F.when(F.size("m.author") >= 0, F.size("m.author")), F.lit(0)).alias("n_authors"),
    )


def label_values(pages: DataFrame, id_col: str, html_col: str, labels: list[str]) -> DataFrame:
    """For portal pages of labels and values: the text line after each label's line (id, label, value)."""
    bare = F.regexp_replace(F.regexp_replace(html_col, r"(?is)<(script|style)\b.*?</\1>", " "), "<[^>]+>", "\n")
    lines = F.filter(F.transform(F.split(bare, "\n"), lambda x: F.trim(x)), lambda x: x != "")
    found = pages.select(id_col, lines.alias("_lines")).select(id_col, F.posexplode("_lines").alias("_i", "_line"), "_lines").where(F.rtrim("_line", F.lit(":")).isin(*labels))
    return found.select(id_col, F.rtrim("_line", F.lit(":")).alias("label"), F.try_element_at("_lines", F.col("_i") + 2).alias("value"))


def first_by_collection(hits: DataFrame, collections: list[str], key: str) -> DataFrame:
    """The hit of the first collection in the given order."""
    rank = F.array_position(F.array(*map(F.lit, collections)), F.col("collection"))
    return hits.where(rank > 0).groupBy(key).agg(F.min_by(F.struct("collection", "value"), rank).alias("x")).select(key, "x.collection", "x.value")


def orcid_owner_matches(lookups: DataFrame) -> DataFrame:
    """Whether a looked-up owner shares any word with the author's name, accents folded (orcid, owner, name)."""
    words = lambda c: F.filter(F.split(normal_key(F.col(c)), " "), lambda w: w != "")
    return lookups.withColumn("matches", F.arrays_overlap(words("owner"), words("name")))


def merge_registry(current: DataFrame, seed: DataFrame, key: str) -> DataFrame:
    """current journals with missing values from the seed, and the seed's journals that current lacks."""
    cols = [c for c in current.columns if c != key]
    given = seed.select(key, *[F.col(c).alias(f"_{c}") for c in cols])
    return current.join(given, key, "full").select(key, *[F.coalesce(c, f"_{c}").alias(c) for c in cols])
