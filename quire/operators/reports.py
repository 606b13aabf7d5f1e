"""Lists, dashboards, counters and search over records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quire.functions.text import fold


def document_list(docs: DataFrame, order: str, limit: int = 30, where: Column | None = None) -> DataFrame:
    """The filtered documents in a named order (an unknown one is 'updated'), the first limit of them (0: all), with pos."""
    keys = {
        "updated": F.coalesce("updated_at", "created_at").desc_nulls_last(), "opened": F.col("opened_at").desc_nulls_last(), "created": F.col("created_at").desc_nulls_last(), "oldest": F.col("created_at").asc_nulls_first(),
        "title": F.lower(F.coalesce("title", "file")).asc_nulls_first(), "journal": F.lower(F.coalesce("journal", F.lit("zzz"))), "blockers": F.col("blockers").desc_nulls_last(), "stage": F.col("stage_rank").asc_nulls_first(),
    }
    rows = docs if where is None else docs.where(where)
    by = [keys.get(order, keys["updated"]), F.col("doc_id")]
    rows = rows.orderBy(*by)
    return rows.limit(limit) if limit else rows


def dashboard(docs: DataFrame, dimensions: list[str]) -> DataFrame:
    """Counts by each dimension in one pass (grouping sets): dimension, value, n."""
    each = F.explode(F.array(*[F.struct(F.lit(d).alias("dimension"), F.col(d).cast("string").alias("value")) for d in dimensions])).alias("x")
    return docs.select(each).groupBy("x.dimension", "x.value").agg(F.count(F.lit(1)).alias("n"))


def usage(users: DataFrame, docs: DataFrame, user: str) -> DataFrame:
    """Every user's documents, ready ones and latest access; zeros for those without any."""
    sums = docs.groupBy(user).agg(F.count(F.lit(1)).alias("n"), F.count_if("ready").alias("ready"), F.max("at").alias("last"))
    return users.select(user).join(sums, user, "left").fillna(0, ["n", "ready"])


def means(docs: DataFrame, *cols: str) -> DataFrame:
    """Means of the rows that have a number, rounded half-even to one digit."""
    return docs.agg(*[F.bround(F.avg(F.col(c).cast("double")), 1).alias(c) for c in cols])


def top(values: DataFrame, value: str, seq: str, n: int) -> DataFrame:
    """The n commonest values; equal counts go to the one seen first."""
    return values.groupBy(value).agg(F.count(F.lit(1)).alias("n"), F.min(seq).alias("_first")).orderBy(F.desc("n"), "_first").limit(n).drop("_first")


def box_counts(messages: DataFrame, boxes: list[str]) -> DataFrame:
    """Messages and unread ones by box; boxes without any count 0."""
    spark = messages.sparkSession
    sums = messages.groupBy("box").agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.col("read")).alias("unread"))
    return spark.createDataFrame([(b,) for b in boxes], "box string").join(sums, "box", "left").fillna(0, ["n", "unread"])


def recent_days(docs: DataFrame, at: str, n: int = 14) -> DataFrame:
    """The last n days with activity and their counts."""
    return docs.groupBy(F.to_date(at).alias("day")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("day")).limit(n)


def search(pages: DataFrame, needle: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Non-overlapping hits of a needle of two letters or more, whatever case and accents: id, hit_no, first and last word
    (from 0). The words before a hit are counted from the gaps between hits."""
    key = fold(F.lit(needle.lower()))
    if len(needle.strip()) < 2:
        return pages.select(id_col, F.lit(0).alias("hit_no"), F.lit(0).alias("first_word"), F.lit(0).alias("last_word")).limit(0)
    folded = F.trim(F.regexp_replace(fold(F.lower(text_col)), r"\s+", " "))
    found = pages.select(id_col, folded.alias("_t"), key.alias("_k")).where(F.contains("_t", "_k"))
    gaps = F.split("_t", F.concat(F.lit(r"\Q"), F.col("_k"), F.lit(r"\E")), -1)
    spaces = lambda s: F.length(s) - F.length(F.replace(s, F.lit(" "), F.lit("")))
    counted = found.select(id_col, "_k", F.transform(gaps, spaces).alias("_s"))
    hits = counted.select(id_col, "_k", "_s", F.posexplode(F.slice("_s", F.lit(1), F.size("_s") - 1)).alias("hit_no", "_x"))
    first = F.aggregate(F.slice("_s", F.lit(1), F.col("hit_no") + 1), F.lit(0), lambda a, x: a + x) + F.col("hit_no") * spaces(F.col("_k"))
    return hits.select(id_col, "hit_no", first.alias("first_word"), (first + spaces(F.col("_k"))).alias("last_word"))


def filtered(docs: DataFrame, journal: str | None = None, stage: str | None = None, ready: bool | None = None, owner: str | None = None, org: str | None = None, since: str | None = None) -> DataFrame:
    """Documents that meet every filter that is given; since compares updated_at as text."""
    for column, value in (("journal", journal), ("stage", stage), ("ready", ready), ("owner", owner), ("org", org)):
        docs = docs if value is None else docs.where(F.col(column) == value)
    return docs if since is None else docs.where(F.col("updated_at") >= since)


def in_list_order(rows: DataFrame, order: list, name: str = "place", seq: str | None = None) -> DataFrame:
    """rows with their places (from 1) in a list that is shown whole: usage by last access and count, batches newest first,
    organisations by lower name. Lists are counted in people or batches, not in documents."""
    return rows.withColumn(name, F.row_number().over(Window.orderBy(*order, *([seq] if seq else []))))


def profile(lines: DataFrame, repeated: DataFrame, columns: DataFrame, notes: DataFrame) -> DataFrame:
    """A document's diagnosis: its ten commonest sizes (by characters), repeated lines, two_columns, lines that open with a mark,
    notes. lines: doc_id, text, size; repeated: doc_id, key; columns: doc_id, two_columns; notes: doc_id, line_no."""
    sizes = lines.groupBy("doc_id", F.round("size", 1).alias("size")).agg(F.sum(F.length("text")).alias("n"))
    top = F.slice(F.sort_array(F.collect_list(F.struct("n", "size")), asc=False), 1, 10)
    hist = sizes.groupBy("doc_id").agg(F.array_join(F.transform(top, lambda s: F.concat_ws(":", s["size"].cast("string"), s["n"].cast("string"))), " ").alias("sizes"))
    marks = lines.groupBy("doc_id").agg(F.count(F.lit(1)).alias("lines"), F.count_if(F.col("text").rlike(r"^\s*(?:\d{1,3}[.)]?\s|\*|[¹²³†‡§])")).alias("marks"))
    count = lambda df, name: df.groupBy("doc_id").agg(F.count(F.lit(1)).alias(name))
    out = hist.join(marks, "doc_id").join(columns, "doc_id", "left").join(count(repeated, "repeated"), "doc_id", "left").join(count(notes, "notes"), "doc_id", "left")
    return out.fillna(0, ["repeated", "notes"]).fillna(False, ["two_columns"]).select("doc_id", "lines", "sizes", "marks", "two_columns", "repeated", "notes")


def summaries(models: DataFrame, counters: DataFrame) -> DataFrame:
    """doc_id and a Markdown summary of each article: title, DOI, language and what was counted. models: doc_id, title, doi,
    language; counters: doc_id and numbers."""
    numbers = [c for c in counters.columns if c != "doc_id"]
    said = lambda x: F.coalesce(F.nullif(F.trim(x), F.lit("")), F.lit("not found"))
    lines = [F.concat(F.lit("# "), said(F.col("title"))), F.lit(""), F.concat(F.lit("- DOI: "), said(F.col("doi"))), F.concat(F.lit("- language: "), said(F.col("language"))), *[F.concat(F.lit(f"- {n}: "), F.coalesce(F.col(n), F.lit(0)).cast("string")) for n in numbers]]
    return models.join(counters, "doc_id", "left").select("doc_id", F.concat_ws("\n", *lines).alias("summary"))

