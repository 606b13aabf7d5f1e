"""Personal data by patterns, and sanitisation of the terms that disclose it, in DataFrame operations only.

Patterns find e-mail and IP addresses, card and phone numbers. Each distinct value found is a protected entity c. For a
term t (a word of MIN_LETTERS letters or more) within CONTEXT code points of c, whole-corpus counts estimate the share of
c's information that t gives away, PMI(c; t) / IC(c), where IC(c) = -log2 p(c) and PMI(c; t) = log2(p(c, t) / (p(c) p(t))).
From GENERALISE on the term is generalised in the documents where it stands near c, from REMOVE on it is removed. All
probabilities count different texts, and MIN_SUPPORT of them are needed for c and for c with t, so copies of a text
neither make evidence nor hide it.

Defined results: a null text is treated as empty and stays null; a document without base spans has no spans; rows that
share id and text get the same spans; spans of different kinds may overlap, those of a kind don't; texts are searched
whole; an empty table gives no rows; other columns, whatever their names, are kept by find() and sanitise(), and for
find() a column with the name of the new one is an error.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, free_name

#: Fixed order of kinds.
KINDS = ("email", "ip", "card", "phone", "term")
# The patterns find what the plain ones in the README find: a match can only begin where the run that it begins with does
# or where the last match ended, and runs don't give back, so that long runs cost linear time.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9]){11,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Every text with a base span matches it.
LIKELY = r"@[A-Za-z0-9-]|[0-9]\.[0-9]++\.[0-9]++\.[0-9]|[0-9](?:[\x20-]?[0-9]){11}|\+[0-9][\x20().0-9-]"
LABELS = {"email": "[EMAIL]", "ip": "[IP]", "card": "[CARD]", "phone": "[PHONE]"}
MIN_LETTERS, CONTEXT, MIN_SUPPORT = 3, 60, 3
GENERALISE, REMOVE = 0.75, 0.9
SALTS = 16
_NO_SPANS = "cast(array() as array<struct<start:int,kind:int,end:int,value:string>>)"


def _found(text: Column, pattern: str | Column, kind: int) -> Column:
    """All matches in order as array<struct(start, kind, end, value)>, in code points."""
    pattern = F.lit(pattern) if isinstance(pattern, str) else pattern
    sizes = lambda a: F.transform(a, lambda x: F.length(x))
    total = lambda a: F.aggregate(a, F.lit(0), lambda s, x: s + x)
    both = F.struct(sizes(F.split(text, pattern, -1)).alias("gaps"), F.regexp_extract_all(text, pattern, F.lit(0)).alias("hits"))

    # the struct goes through one-element arrays, so that it is computed once
    def spans(x: Column) -> Column:
        lengths = sizes(x["hits"])
        return F.transform(x["hits"], lambda hit, i: _struct(total(F.slice(x["gaps"], F.lit(1), i + 1)) + total(F.slice(lengths, F.lit(1), i)), kind, hit))

    return F.flatten(F.transform(F.array(both), spans))


def _struct(start: Column, kind: int, hit: Column) -> Column:
    return F.struct(start.cast("int").alias("start"), F.lit(kind).alias("kind"), (start + F.length(hit)).cast("int").alias("end"), hit.alias("value"))


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    def add(total: Column, i: Column) -> Column:
        d = F.substring(F.reverse(digits), i, F.lit(1)).cast("int")
        return total + F.when(i % 2 == 1, d).when(d > 4, 2 * d - 9).otherwise(2 * d)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def _valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(value, r"\."), lambda p: (F.length(F.ltrim(p, F.lit("0"))) <= 3) & (F.right(p, F.lit(9)).cast("int") <= 255))
    if kind == "card":
        return F.length(_digits(value)).between(12, 19) & _luhn(_digits(value))
    if kind == "phone":
        return F.length(_digits(value)).between(9, 15)
    return F.lit(True)


def _checker(kind: str):
    return lambda s: _valid(kind, s["value"])


def _is(kind: str):
    return lambda s: s["kind"] == KINDS.index(kind)


def base_spans(text: Column) -> Column:
    """array<struct(start, kind, end, value)> of the base kinds, by start, then kind."""
    kinds = []
    for i, kind in enumerate(KINDS[:4]):
        found = F.filter(_found(text, PATTERNS[kind], i), _checker(kind))
        kinds.append(F.when(text.rlike(PATTERNS[kind]), found).otherwise(F.expr(_NO_SPANS)))
    return F.array_sort(F.concat(*kinds))


def _term_list(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(r"\p{L}{%d,}+" % MIN_LETTERS), F.lit(0)))


def disclosures(found: DataFrame, docs: DataFrame, text_col: str) -> DataFrame:
    """row_key, term and share: the terms near entities that disclose at least GENERALISE of them.

    found: row_key, text and base of the documents with base spans; docs: all documents.
    """
    digest = F.xxhash64("text")
    near = lambda s: F.substring("text", F.greatest(s["start"] - CONTEXT, F.lit(0)) + 1, F.least(s["start"], F.lit(CONTEXT)) + s["end"] - s["start"] + CONTEXT)
    # the context without the entity itself and without words that its ends cut
    gap = lambda s: F.regexp_replace(F.replace(near(s), s["value"], F.lit(" ")), r"^\p{L}+|\p{L}+$", "")
    met = found.select("row_key", digest.alias("text_key"), F.explode("base").alias("span"), "text")
    met = met.select("row_key", "text_key", F.concat(F.col("span.kind").cast("string"), F.lit(":"), F.lower("span.value")).alias("entity"), _term_list(gap(F.col("span"))).alias("terms"))
    entities = met.select("entity", "text_key").distinct().groupBy("entity").agg(F.count(F.lit(1)).alias("n_entity")).where(F.col("n_entity") >= MIN_SUPPORT)
    # an entity may stand in a third of all texts: its rows are dealt out by their texts as well
    salt, salts = F.pmod("text_key", F.lit(SALTS)).cast("int"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
    met = met.withColumn("salt", salt).join(entities.select("entity", salts.alias("salt")), ["entity", "salt"], "left_semi")
    pairs = met.select("entity", "salt", "text_key", "row_key", F.explode("terms").alias("term"))
    joint = pairs.select("entity", "term", "text_key").distinct().groupBy("entity", "term").agg(F.count(F.lit(1)).alias("n_joint")).where(F.col("n_joint") >= MIN_SUPPORT)
    joint = cut(joint.join(entities, "entity"))
    # a text counts once, however many copies it has
    texts = docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("text")).select("text", digest.alias("text_key"))
    counts = texts.groupBy("text_key").agg(F.first("text").alias("text")).select(F.explode(_term_list(F.col("text"))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n_term"))
    counts = counts.join(joint.select("term").distinct(), "term", "left_semi")
    n = texts.select("text_key").distinct().count()
    p = lambda c: F.col(c) / F.lit(float(max(n, 1)))
    share = F.log2(p("n_joint") / (p("n_entity") * F.greatest(p("n_term"), p("n_joint")))) / F.greatest(-F.log2(p("n_entity")), F.lit(1e-9))
    telling = joint.join(counts, "term").withColumn("share", share).where(F.col("share") >= GENERALISE).select("entity", "term", "share")
    return pairs.join(telling.withColumn("salt", salts), ["entity", "term", "salt"]).groupBy("row_key", "term").agg(F.max("share").alias("share"))


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", name: str = "spans") -> DataFrame:
    """docs with name: array<struct(start, kind, end, value)> by start, then kind; kind is a place in KINDS. The value
    of a term span is the label it gives way to: [TERM], or nothing if it is removed."""
    if free_name(docs, name) != name:
        raise ValueError(f"column {name} exists")
    text = F.coalesce(F.col(text_col), F.lit(""))
    key, terms_col, own_key = free_name(docs, "row_key"), free_name(docs, "terms"), free_name(docs, "terms_key")
    likely = docs.where(text.rlike(LIKELY)).withColumn(name, base_spans(text))
    rest = docs.where(~text.rlike(LIKELY)).withColumn(name, F.expr(_NO_SPANS))
    likely = cut(likely.withColumn(key, F.sha2(F.concat_ws(":", F.coalesce(F.col(id_col).cast("string"), F.lit("")), text), 256)))
    found = likely.where(F.size(name) > 0).select(F.col(key).alias("row_key"), F.col(text_col).alias("text"), F.col(name).alias("base"))
    terms = disclosures(found, docs, text_col).groupBy("row_key").agg(F.sort_array(F.collect_list(F.struct("term", "share"))).alias(terms_col)).withColumnRenamed("row_key", own_key)
    own = likely.join(terms, F.col(key) == F.col(own_key), "left")
    pattern = F.concat(F.lit(r"(?iu)(?<!\p{L})(?:"), F.array_join(F.transform(terms_col, lambda t: t["term"]), "|"), F.lit(r")(?!\p{L})"))
    removed = F.transform(F.filter(terms_col, lambda t: t["share"] >= REMOVE), lambda t: t["term"])
    label = lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"), F.when(F.array_contains(removed, F.lower(s["value"])), F.lit("")).otherwise(F.lit("[TERM]")).alias("value"))
    added = F.when(F.col(terms_col).isNotNull(), F.transform(_found(text, pattern, KINDS.index("term")), label)).otherwise(F.expr(_NO_SPANS))
    # a term inside a base span stays part of it
    loose = F.filter(added, lambda t: ~F.exists(F.col(name), lambda b: (b["start"] < t["end"]) & (t["start"] < b["end"])))
    own = own.withColumn(name, F.array_sort(F.concat(F.col(name), loose))).drop(key, own_key, terms_col)
    return own.unionByName(rest)


def sanitise(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with each span of text_col replaced by its label; of spans that overlap, the one that starts first counts."""
    name = free_name(docs, "pii_spans")
    text = F.col(text_col)
    labels = F.array(*[F.lit(LABELS[k]) for k in KINDS[:4]])
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))

    def step(acc: Column, s: Column) -> Column:
        what = F.when(s["kind"] == KINDS.index("term"), s["value"]).otherwise(F.get(labels, s["kind"]))
        put = F.struct(F.concat(acc["out"], F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), what).alias("out"), s["end"].alias("at"))
        return F.when(s["start"] >= acc["at"], put).otherwise(acc)

    finish = lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text)))
    made = F.aggregate(F.col(name), start, step, finish)
    return find(docs, id_col, text_col, name).withColumn(text_col, F.when(F.size(name) > 0, made).otherwise(text)).drop(name).select(*docs.columns)


def digest_rows(found: DataFrame, name: str = "spans") -> DataFrame:
    """The contract's columns."""
    names = F.array(*[F.lit(k) for k in KINDS])
    listed = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda k: F.size(F.filter(name, _is(k))).cast("long").alias(f"n_{k}")
    base = F.filter(name, lambda s: s["kind"] < 4)
    return found.select("doc_id", *[count(k) for k in KINDS[:4]], F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col(name)).alias("spans"))
