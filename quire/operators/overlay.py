"""Edits over extracted records: difference, application, defaults and the cascade of sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def blank_to_null(x: Column) -> Column:
    return F.nullif(F.trim(x), F.lit(""))


def flatten(records: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """key, field, value: one row for each form field."""
    each = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in fields])).alias("x")
    return records.select(key, each).select(key, "x.field", "x.value")


def difference(form: DataFrame, extracted: DataFrame, key: str) -> DataFrame:
    """The overrides: form values (key, field, value) that differ from the extracted ones, blanks being null. A value
    equal to the extracted one leaves none; an override to null is a row."""
    was = extracted.select(key, "field", blank_to_null(F.col("value")).alias("_was"))
    now = form.select(key, "field", blank_to_null(F.col("value")).alias("value"))
    return now.join(was, [key, "field"], "left").where(~F.col("value").eqNullSafe(F.col("_was"))).select(key, "field", "value")


def merge_edits(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Old overrides replaced by new ones of the same field."""
    return old.join(new.select(key, "field"), [key, "field"], "left_anti").unionByName(new)


def apply_edits(records: DataFrame, edits: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """records with overrides in place, and edited: the fields that have one. An override to null counts, so presence is
    told by its row and not by its value."""
    wide = edits.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("field", "value"))).alias("_edits"))
    known = F.coalesce(F.col("_edits"), F.expr("cast(map() as map<string,string>)"))
    types = dict(records.dtypes)
    made = [F.when(F.map_contains_key(known, F.lit(f)), known[f].cast(types[f])).otherwise(F.col(f)).alias(f) if f in fields else F.col(f) for f in records.columns]
    edited = F.array_join(F.array_sort(F.filter(F.map_keys(known), lambda k: k.isin(*fields))), ",")
    return records.join(wide, key, "left").select(*made, edited.alias("edited"))


def cascade(values: DataFrame, key: str, owners: dict[str, str], order: list[str]) -> DataFrame:
    """The best value of each field from several sources (key, source, field, value): the field's own preferred source,
    then the order of sources; empty values don't count. source tells where it came from."""
    own = F.create_map(*[F.lit(x) for p in owners.items() for x in p]) if owners else F.expr("cast(map() as map<string,string>)")
    rank = F.when(own[F.col("field")] == F.col("source"), 0).otherwise(100 + F.array_position(F.array(*map(F.lit, order)), F.col("source")))
    usable = values.where(blank_to_null(F.col("value")).isNotNull() & F.col("source").isin(*order))
    best = usable.groupBy(key, "field").agg(F.min(F.struct(rank.alias("rank"), "source", "value")).alias("x"))
    return best.select(key, "field", "x.value", "x.source")


def fill_defaults(records: DataFrame, defaults: DataFrame, on: str, fields: list[str]) -> DataFrame:
    """Empty fields filled from the joined defaults, with filled: which ones were."""
    given = defaults.select(on, *[F.col(f).alias(f"_{f}") for f in fields])
    both = records.join(given, on, "left")
    empty = {f: blank_to_null(F.col(f).cast("string")).isNull() & F.col(f"_{f}").isNotNull() for f in fields}
    out = [F.when(empty[c], F.col(f"_{c}")).otherwise(F.col(c)).alias(c) if c in fields else F.col(c) for c in records.columns]
    return both.select(*out, F.array_join(F.array_compact(F.array(*[F.when(empty[f], F.lit(f)) for f in fields])), ",").alias("filled"))


def prefill(form: Column, journal: Column, declaration: Column, generated: Column) -> Column:
    """struct(value, reason): the form's own value, else the journal's default, else a declaration, else a generated one."""
    sources = [(blank_to_null(form), "form"), (blank_to_null(journal), "journal"), (blank_to_null(declaration), "declaration"), (blank_to_null(generated), "generated")]
    reason = F.coalesce(*[F.when(v.isNotNull(), r) for v, r in sources])
    return F.struct(F.coalesce(*[v for v, _ in sources]).alias("value"), reason.alias("reason"))


def item_edits(edits: DataFrame, key: str) -> DataFrame:
    """key, list, pos, field, value of the edits whose field names an item of a list: author_2_orcid; author_2_remove."""
    form = r"^([a-z]+)_(\d+)_([a-z_]+)$"
    part = lambda g: F.regexp_extract("field", form, g)
    return edits.where(F.col("field").rlike(form)).select(key, part(1).alias("list"), part(2).cast("int").alias("pos"), part(3).alias("_field"), "value").withColumnRenamed("_field", "field")


def apply_item_edits(items: DataFrame, edits: DataFrame, key: str, name: str, fields: list[str]) -> DataFrame:
    """items (key, pos, fields) of a list after its edits (item_edits()): an edit replaces, one to null included; edits beyond
    the list's end make new items, unless all of theirs are empty; removed tells the items that were marked for removal."""
    own = edits.where(F.col("list") == name).groupBy(key, "pos").agg(F.map_from_entries(F.collect_list(F.struct("field", "value"))).alias("_edits"))
    both = items.withColumn("_there", F.lit(True)).join(own, [key, "pos"], "full")
    known = F.coalesce(F.col("_edits"), F.expr("cast(map() as map<string,string>)"))
    types = dict(items.dtypes)
    made = [F.when(F.map_contains_key(known, F.lit(f)), blank_to_null(known[f]).cast(types[f])).otherwise(F.col(f)).alias(f) for f in fields]
    some = F.exists(F.map_values(F.map_filter(known, lambda k, v: k.isin(*fields))), lambda v: F.coalesce(F.trim(v), F.lit("")) != "")
    return both.where(F.col("_there").isNotNull() | some).select(key, "pos", *made, F.coalesce(blank_to_null(known["remove"]).isNotNull(), F.lit(False)).alias("removed"), F.coalesce(F.col("_edits").isNotNull(), F.lit(False)).alias("edited"))


def cascade_by_issn(values: DataFrame, key: str, issn: str, siblings: DataFrame, owners: dict[str, str], order: list[str]) -> DataFrame:
    """cascade() over the values of a journal's number and, for fields that it leaves empty, of the numbers linked with it
    (siblings: issn, other); then a print ISSN that equals the electronic one is dropped. values: key, issn, source, field,
    value; key and issn name the journal asked for."""
    direct = cascade(values, key, owners, order)
    linked = siblings.select(F.col(issn).alias("_own"), F.col("other").alias(issn))
    asked = values.select(key, F.col(issn).alias("_own")).distinct()
    other = asked.join(linked, "_own").join(values.select(issn, "source", "field", "value").distinct(), issn).select(key, "source", "field", "value")
    more = cascade(other, key, owners, order).join(direct.select(key, "field"), [key, "field"], "left_anti")
    both = direct.unionByName(more)
    electronic = both.where("field = 'issn_epub'").select(key, F.col("value").alias("_epub"))
    return both.join(electronic, key, "left").where(~((F.col("field") == "issn_ppub") & F.coalesce(F.col("value") == F.col("_epub"), F.lit(False)))).drop("_epub")
