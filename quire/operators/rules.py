"""Rules as rows: findings of (document, field, severity, code), and what is summed up from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def findings(records: DataFrame, key: str, rules: list[tuple[str, str, str, str, Column]]) -> DataFrame:
    """One row for each rule (rule_id, code, severity, field, condition) that holds, in one pass over the records."""
    each = [F.when(F.coalesce(test, F.lit(False)), F.struct(F.lit(i).alias("rule_no"), F.lit(rule).alias("rule_id"), F.lit(code).alias("code"), F.lit(severity).alias("severity"), F.lit(field).alias("field"))) for i, (rule, code, severity, field, test) in enumerate(rules)]
    return records.select(key, F.explode(F.array_compact(F.array(*each))).alias("x")).select(key, "x.*")


def last_by_field(found: DataFrame, key: str) -> DataFrame:
    """Of several findings for a form field the last rule's stays."""
    return found.groupBy(key, "field").agg(F.max(F.struct("rule_no", "rule_id", "code", "severity")).alias("x")).select(key, "field", "x.rule_id", "x.code", "x.severity")


def drop_blocked_warnings(found: DataFrame, key: str) -> DataFrame:
    """Warnings whose code the document already has as a blocker are dropped."""
    blocked = found.where("severity = 'blocker'").select(key, "code").distinct().withColumn("_blocked", F.lit(True))
    return found.join(blocked, [key, "code"], "left").where("severity = 'blocker' or _blocked is null").drop("_blocked")


def readiness(records: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """blockers, warnings and ready (no blockers) of every record."""
    sums = found.groupBy(key).agg(F.count_if(F.col("severity") == "blocker").alias("blockers"), F.count_if(F.col("severity") == "warning").alias("warnings"))
    return records.select(key).join(sums, key, "left").fillna(0, ["blockers", "warnings"]).withColumn("ready", F.col("blockers") == 0)


def code_frequency(messages: DataFrame, message: str) -> DataFrame:
    """How often each code, in brackets at a message's end, occurs."""
    codes = F.explode(F.regexp_extract_all(message, F.lit(r"\(([A-Z]\d{2})\)"), F.lit(1)))
    return messages.select(codes.alias("code")).groupBy("code").agg(F.count(F.lit(1)).alias("n"))


def pending_by_block(found: DataFrame, key: str, block: Column) -> DataFrame:
    """Fields to fill by screen block, in the order of their rules."""
    return found.withColumn("block", block).groupBy(key, "block").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rule_no", "field"))), lambda x: x["field"]), ",").alias("fields"))


def message_per_field(found: DataFrame, key: str, code_fields: DataFrame) -> DataFrame:
    """Blockers spread to the fields of their codes (code, field, pos): the first field carries the text, others none."""
    return found.select(key, "code", "rule_id").join(code_fields, "code").withColumn("text", F.when(F.row_number().over(Window.partitionBy(key, "rule_id").orderBy("pos")) == 1, F.col("rule_id")).otherwise("")).select(key, "code", "field", "text")


def package_checks(files: DataFrame, package: str = "package") -> DataFrame:
    """The checklist of each package over its files (package, path): rows of item and ok, plus 'all'."""
    name, folder = F.regexp_extract("path", r"[^/]*$", 0), F.regexp_extract("path", r"^([^/]*)/", 1)
    depth = F.length("path") - F.length(F.replace("path", F.lit("/"), F.lit("")))
    lower = F.lower(name)
    per = files.groupBy(package).agg(
        ((F.countDistinct(F.when(folder != "", folder)) == 1) & (F.count_if(depth != 1) == 0) & F.bool_or(folder == F.col(package))).alias("one folder"),
        F.count_if(lower.endswith(".xml")).between(1, 5).alias("1 to 5 xml"), (F.count_if(lower.endswith(".pdf")) > 0).alias("pdf"), (F.count_if(name == "xpm.html") > 0).alias("report"),
    )
    items = ["one folder", "1 to 5 xml", "pdf", "report"]
    every = F.lit(True)
    for i in items:
        every = every & F.col(f"`{i}`")
    return per.withColumn("all", every).unpivot([package], [*[f"`{i}`" for i in items], "all"], "item", "ok")
