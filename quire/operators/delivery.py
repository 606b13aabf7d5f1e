"""Delivery: gates of stages, validation of batches, package checklists, registries that are written by key, declarations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quire.functions.naming import file_name_fault, folder_name_fault
from quire.functions.shared import many
from quire.functions.text import fold

MOST_XML, MOST_FILES, MOST_BYTES = 5, 20, 50 * 1024 * 1024
FORMATS = ("pdf", "docx")
# What titles of declarations hold, accents folded, in the order that decides; and what rules one out.
DECLARATION_CUES = {
    "ia": ("inteligencia artificial", "artificial intelligence", "ia statement", "ai statement", "ia declara", "ai declaration", "uso de ia", "use of ai", "declaracao de ia", "statement of ai", "generative ai", "generative artificial"),
    "agradecimentos": ("agradecimento", "agradecemos", "acknowledg", "reconocimiento", "remerciement", "ringraziament"),
    "financiamento": ("financiamento", "financiad", "financiac", "funding", "fomento", "apoio financeiro", "grant", "financial support", "apoyo financiero"),
    "contribuicao": ("contribuic", "contribution", "autoria", "authorship", "author statement", "author declaration", "credit"),
    "dados": ("disponibilidade de dados", "data availability", "dados de pesquisa", "dados abertos", "disponibilidad de datos", "disponibilidad de los datos", "research data", "open data"),
    "conflito": ("conflito", "conflict", "interesse", "interes", "competing interest"),
    "como_citar": ("como citar", "how to cite", "citation", "forma de cita"),
    "editor": ("editor",),
}
NO_DECLARATION = {"editor": ("process", "dates", "datas", "prazo", "politica", "guidelines", "norma"), "dados": ("banco de dados do artigo", "coleta de dados"), "contribuicao": ("originalidade", "originality", "plagiarism", "plagio")}


def stage_gates(events: DataFrame, key: str, at: str, seq: str) -> DataFrame:
    """events with refused: why a move or an approval isn't let through, else null. events: kind (generate, approve, move),
    stage (of moves), ready (of generations: whether the XML was ready), needs_chief.

    An approval holds from its event to the next generation; one without a ready XML before it is refused. A move to
    approved needs an approval that holds; a move to delivered needs a ready XML and, where there is a chief, an approval.
    """
    order = Window.partitionBy(key).orderBy(at, seq).rowsBetween(Window.unboundedPreceding, -1)
    kind = F.col("kind")
    made = F.last(F.when(kind == "generate", F.struct("ready")), ignorenulls=True).over(order)
    rows = events.withColumn("_ready", F.coalesce(made["ready"], F.lit(False)))
    fine = (kind == "approve") & F.col("_ready")
    state = F.last(F.when(fine, F.lit(True)).when(kind == "generate", F.lit(False)), ignorenulls=True).over(order)
    rows = rows.withColumn("_approved", F.coalesce(state, F.lit(False)))
    move = lambda stage: (kind == "move") & (F.col("stage") == stage)
    refused = (
        F.when((kind == "approve") & ~F.col("_ready"), "not ready").when(move("approved") & ~F.col("_approved"), "approved by the chief only")
        .when(move("delivered") & ~F.col("_ready"), "not ready").when(move("delivered") & F.col("needs_chief") & ~F.col("_approved"), "not approved")
    )
    return rows.withColumn("refused", refused).drop("_ready", "_approved")


def batch_faults(requests: DataFrame, docs: DataFrame, journals: DataFrame, folders: DataFrame) -> DataFrame:
    """batch and fault: the first reason, in order, why a batch can't be made; batches without one have none.

    requests: batch, pos, doc_id, folder (the name that it would get); docs: doc_id, processed, ready, batch_folder, released,
    base, journal, volume, issue; journals: journal; folders: folder of the batches that exist.
    """
    rows = requests.dropDuplicates(["batch", "doc_id"]).join(docs.withColumn("_there", F.lit(True)), "doc_id", "left").join(journals.select("journal", F.lit(True).alias("_listed")), "journal", "left").join(folders.select("folder", F.lit(True).alias("_used")), "folder", "left")
    c = F.col
    no = lambda x: ~F.coalesce(c(x), F.lit(False))
    of_doc = (
        F.when(no("_there"), 3).when(no("processed"), 4).when(no("ready"), 5).when(c("batch_folder").isNotNull(), 6).when(no("released"), 7).when(F.coalesce("base", F.lit("")) == "", 8)
    )
    n = F.count("doc_id")
    per = rows.withColumn("_f", of_doc).groupBy("batch").agg(
        n.alias("n"), F.min(F.when(c("_f").isNotNull(), F.struct("pos", "_f")))["_f"].alias("doc_fault"), F.countDistinct(F.struct(F.coalesce("journal", F.lit("")), F.coalesce("volume", F.lit("")), F.coalesce("issue", F.lit("")))).alias("groups"), F.bool_or(no("_listed")).alias("unlisted"),
        F.bool_or(F.coalesce("volume", F.lit("")) == "").alias("no_volume"), F.countDistinct("base").alias("bases"), F.bool_or(F.coalesce("folder", F.lit("")) == "").alias("no_folder"), F.bool_or(F.coalesce("_used", F.lit(False))).alias("used"),
    )
    number = (
        F.when(c("n") == 0, 1).when(c("n") > MOST_XML, 2).when(c("doc_fault").isNotNull(), c("doc_fault")).when(c("groups") != 1, 9).when(c("unlisted"), 10).when(c("no_volume"), 11).when(c("bases") != c("n"), 12).when(c("no_folder"), 13).when(c("used"), 14)
    )
    names = ("no document", "too many documents", "document not found", "not processed", "not ready", "in a batch already", "not released", "no xml", "several issues", "journal not listed", "no volume", "same base name", "no folder name", "folder exists")
    return per.select("batch", F.get(F.array(*map(F.lit, names)), number - 1).alias("fault"))


def package_checklist(files: DataFrame, cited: DataFrame | None = None, valid: DataFrame | None = None) -> DataFrame:
    """package, item, ok of each package over its files (package, archive, path), and 'all'. cited: package, name of the
    files that its XMLs refer to; valid: package, name, dtd, schematron (null: validation failed) of its XMLs."""
    c = F.col
    rows = files.withColumn("_name", F.substring_index("path", "/", -1)).withColumn("_top", F.when(c("path").contains("/"), F.substring_index("path", "/", 1)))
    depth = F.length("path") - F.length(F.replace("path", F.lit("/"), F.lit("")))
    is_ = lambda end: F.lower("_name").endswith(end)
    stem = F.regexp_replace(F.substring_index("archive", "/", -1), r"\.[^.]*$", "")
    per = rows.groupBy("package").agg(
        F.bool_and(F.lower("archive").endswith(".zip")).alias("zip format"), F.bool_and(file_name_fault(c("_name")).isNull()).alias("file names"),
        ((F.countDistinct("_top") == 1) & F.bool_and(depth == 1) & F.bool_or(F.coalesce(c("_top") == stem, F.lit(False)))).alias("one folder of the package's name"),
        F.bool_and(c("_top").isNull() | folder_name_fault(c("_top")).isNull()).alias("folder name"), F.count_if(is_(".xml")).between(1, MOST_XML).alias("1 to 5 xml"), (F.count_if(is_(".pdf")) > 0).alias("pdf"), (F.count_if(c("_name") == "xpm.html") > 0).alias("report"), F.lit(True).alias("image formats"),
    )
    items = ["zip format", "file names", "one folder of the package's name", "folder name", "1 to 5 xml", "pdf", "report", "image formats"]
    if cited is not None:
        gone = cited.select("package", c("name").alias("_name")).distinct().join(rows.select("package", "_name").distinct(), ["package", "_name"], "left_anti").groupBy("package").agg(F.lit(False).alias("cited files"))
        per = per.join(gone, "package", "left").withColumn("cited files", F.coalesce(c("cited files"), F.lit(True)))
        items.append("cited files")
    if valid is not None:
        found = valid.groupBy("package").agg(F.bool_and(F.coalesce("dtd", F.lit(False))).alias("dtd"), F.bool_and(F.coalesce("schematron", F.lit(False))).alias("schematron"))
        per = per.join(found, "package", "left")
        items += ["dtd", "schematron"]
    each = [F.coalesce(c(f"`{i}`"), F.lit(False)) for i in items]
    per = per.select("package", *[e.alias(i) for e, i in zip(each, items, strict=True)], reduce(lambda a, b: a & b, each).alias("all"))
    return per.unpivot(["package"], [*[f"`{i}`" for i in items], "all"], "item", "ok")


def upserted(current: DataFrame, changes: DataFrame, keys: list[str], at: str, seq: str, value: str) -> DataFrame:
    """current (keys, value) after changes: the last change of a key counts, and one of null removes the key."""
    old = current.select(*keys, F.struct(F.lit(False).alias("new"), F.lit(None).cast(changes.schema[at].dataType).alias("at"), F.lit(None).cast(changes.schema[seq].dataType).alias("seq"), F.col(value).alias("v")).alias("x"))
    new = changes.select(*keys, F.struct(F.lit(True).alias("new"), F.col(at).alias("at"), F.col(seq).alias("seq"), F.col(value).alias("v")).alias("x"))
    last = old.unionByName(new).groupBy(*keys).agg(F.max_by("x", F.struct("x.new", "x.at", "x.seq")).alias("x"))
    return last.where("x.v is not null").select(*keys, F.col("x.v").alias(value))


def find_or_create(requests: DataFrame, journals: DataFrame) -> DataFrame:
    """request_id, journal and outcome of finding a journal by ISSN: found; elsewhere (another organisation's); unknown (the
    registries don't know it); incomplete (required fields are missing); refused (the user may not create); created.
    requests: request_id, issn, org, answered, complete, may_create, suggested; journals: journal, issn_epub, issn_ppub, org."""
    numbers = journals.select("journal", F.col("org").alias("_org"), F.explode(F.array_distinct(F.array_compact(F.array(F.upper("issn_epub"), F.upper("issn_ppub"))))).alias("_issn"))
    first = numbers.groupBy("_issn").agg(F.min(F.struct("journal", "_org")).alias("_j"))
    rows = requests.withColumn("issn", F.upper("issn")).join(first, F.col("issn") == F.col("_issn"), "left")
    reach = F.col("_j._org").isNull() | (F.col("_j._org") == F.col("org"))
    outcome = (
        F.when(F.col("_j").isNotNull() & F.coalesce(reach, F.lit(False)), "found").when(F.col("_j").isNotNull(), "elsewhere").when(~F.col("answered"), "unknown")
        .when(~F.col("complete"), "incomplete").when(~F.col("may_create"), "refused").otherwise("created")
    )
    return rows.select("request_id", F.when(outcome == "found", F.col("_j.journal")).when(outcome == "created", F.col("suggested")).alias("journal"), outcome.alias("outcome"))


def admissions(uploads: DataFrame) -> DataFrame:
    """upload and reason: the first reason, in order, why an upload isn't taken; null if it is; queued: whether its files wait.
    uploads: upload, file (null: none), bytes, confirmed, in_reach, may_send."""
    extension = F.lower(F.regexp_extract("file", r"\.([^.]*)$", 1))
    per = uploads.groupBy("upload").agg(
        F.count("file").alias("n"), F.bool_or(F.col("file").isNotNull() & ~extension.isin(*FORMATS)).alias("format"), F.bool_and("confirmed").alias("confirmed"), F.bool_or(F.col("bytes") > MOST_BYTES).alias("large"), F.bool_and("in_reach").alias("reach"), F.bool_and("may_send").alias("send"),
    )
    c = F.col
    reason = F.when(c("n") == 0, "no file").when(c("n") > MOST_FILES, "too many files").when(c("format"), "format").when(~c("confirmed"), "e-mail not confirmed").when(c("large"), "too large").when(~c("reach"), "journal out of reach").when(~c("send"), "role doesn't send")
    return per.select("upload", reason.alias("reason"), (reason.isNull() & (c("n") > 1)).alias("queued"))


def declarations(blocks: DataFrame, filled: DataFrame | None = None) -> DataFrame:
    """doc_id, kind, block_no, text of the declarations among back-matter blocks (doc_id, block_no, title, text): a block
    gives the first kind, in order, that its title tells and that no earlier block (nor filled: doc_id, kind) has given. A
    fold over the few blocks of one document."""
    tells = lambda flat, words: reduce(lambda a, b: a | b, [flat.contains(w) for w in words])
    told = lambda flat: F.array_compact(F.array(*[F.when(tells(flat, words) & (~tells(flat, NO_DECLARATION[k]) if k in NO_DECLARATION else F.lit(True)), F.lit(k)) for k, words in DECLARATION_CUES.items()]))
    # a variable of a lambda, so that a title is folded once, not for each cue
    kinds = F.transform(F.array(F.lower(fold(F.coalesce("title", F.lit(""))))), told)[0]
    said = F.trim(F.coalesce("text", F.lit("")))
    listed = blocks.where(said != "").select("doc_id", F.struct("block_no", kinds.alias("kinds"), said.alias("text")).alias("b")).groupBy("doc_id").agg(F.sort_array(F.collect_list("b")).alias("_b"))
    if filled is not None:
        listed = listed.join(many(filled.groupBy("doc_id").agg(F.collect_set("kind").alias("_done"))), "doc_id", "left")
    done = F.coalesce(F.col("_done"), F.expr("cast(array() as array<string>)")) if filled is not None else F.expr("cast(array() as array<string>)")
    start = F.struct(done.alias("done"), F.expr("cast(array() as array<struct<kind:string,block_no:bigint,text:string>>)").alias("out"))

    def add(acc: Column, b: Column) -> Column:
        kind = F.get(F.array_except(b["kinds"], acc["done"]), F.lit(0))
        got = F.struct(F.concat(acc["done"], F.array(kind)).alias("done"), F.concat(acc["out"], F.array(F.struct(kind.alias("kind"), b["block_no"].cast("bigint").alias("block_no"), b["text"].alias("text")))).alias("out"))
        return F.when(kind.isNotNull(), got).otherwise(acc)

    return listed.select("doc_id", F.explode(F.aggregate("_b", start, add, lambda acc: acc["out"])).alias("x")).select("doc_id", "x.*")
