"""Rules over what people enter, and the lists that they see: forms, accounts, mailboxes, release notes and totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quire.functions.records import version_key
from quire.functions.text import issn_valid, orcid_valid

# Roles, and which of them sees notes for whom.
ROLES = ("cliente", "operador", "admin")
AUDIENCES = {"todos": ("cliente", "operador", "admin"), "operador": ("operador", "admin"), "admin": ("admin",)}
# Words that a note for everybody doesn't hold.
ADMIN_WORDS = ("administrador", "administra", "configurações", "correio", "painel", "usuários", "organizações (menu)")
# Languages of journals.
LANGUAGES = ("pt", "es", "en")
EMAIL_FORM = r"^[^@\s]+@[^@\s]+\.[^@\s]+$"
LOGIN_FORM = r"^[a-z0-9._-]{3,}$"


def failed(rows: DataFrame, keys: list[str], rules: list[tuple[str, str, Column]]) -> DataFrame:
    """One row (keys, field, reason) for each rule (field, reason, condition) that holds, the first of each field."""
    first: dict[str, Column] = {}
    for field, reason, test in rules:
        said = F.struct(F.lit(field).alias("field"), F.lit(reason).alias("reason"))
        first[field] = first[field].when(test, said) if field in first else F.when(test, said)
    return rows.select(*keys, F.explode(F.array_compact(F.array(*first.values()))).alias("hit")).select(*keys, "hit.field", "hit.reason")


def taken(rows: DataFrame, key: str, name: Column, existing: DataFrame, other_key: str, other_name: Column) -> DataFrame:
    """rows with taken: whether another key of existing has the name, case aside."""
    names = existing.select(F.lower(other_name).alias("_name"), F.col(other_key).alias("_owner")).groupBy("_name").agg(F.min("_owner").alias("_least"), F.max("_owner").alias("_most"))
    marked = rows.withColumn("_own", F.lower(name)).join(names, F.col("_own") == F.col("_name"), "left")
    other = (F.col("_least") != F.coalesce(F.col(key), F.col("_least"))) | (F.col("_most") != F.coalesce(F.col(key), F.col("_most"))) | F.col(key).isNull()
    return marked.withColumn("taken", F.col("_name").isNotNull() & other).drop("_own", "_name", "_least", "_most")


def journal_errors(forms: DataFrame, existing: DataFrame, licences: list[str], areas: list[str], styles: list[str]) -> DataFrame:
    """Errors (form_id, field, reason) of journal forms; columns that a form may leave out are null. existing: acronym.

    current is the acronym of the journal that the form edits, which it may keep.
    """
    c = lambda name: F.trim(F.coalesce(F.col(name), F.lit("")))
    known = existing.select(F.lower("acronym").alias("_there")).distinct()
    code = F.lower(c("acronym"))
    rows = forms.withColumn("_code", code).join(known, F.col("_code") == F.col("_there"), "left")
    number = lambda name: F.upper(c(name))
    bad_issn = lambda name: (number(name) != "") & ~(number(name).rlike(r"^\d{4}-\d{3}[\dX]$") & issn_valid(number(name)))
    orcid = F.regexp_extract(c("editor_orcid"), r"(\d{4}-\d{4}-\d{4}-\d{3}[\dXx])", 1)
    listed = lambda name, values: (c(name) != "") & ~c(name).isin(*values)
    rules = [
        ("acronym", "form", ~F.col("_code").rlike("^[a-z][a-z0-9]{1,24}$")),
        ("acronym", "taken", F.col("_there").isNotNull() & ~F.col("_code").eqNullSafe(F.col("current"))),
        *((name, "missing", c(name) == "") for name in ("title", "short_title", "publisher")),
        ("issn_epub", "missing", c("issn_epub") == ""), ("issn_epub", "form", bad_issn("issn_epub")), ("issn_ppub", "form", bad_issn("issn_ppub")),
        ("doi_prefix", "form", (c("doi_prefix") != "") & ~c("doi_prefix").rlike(r"^10\.\d{4,9}(/\S*)?$")),
        ("licence_url", "unlisted", ~c("licence_url").isin(*licences)), ("area", "unlisted", listed("area", areas)), ("style", "unlisted", listed("style", styles)),
        ("site", "form", (c("site") != "") & ~c("site").rlike("^https?://")),
        ("editor_lattes", "form", (c("editor_lattes") != "") & ~c("editor_lattes").rlike(r"^https?://(lattes\.cnpq\.br|buscatextual)")),
        ("editor_orcid", "form", (c("editor_orcid") != "") & ((orcid == "") | ~orcid_valid(orcid))),
        ("editorial_email", "form", (c("editorial_email") != "") & ~c("editorial_email").rlike(EMAIL_FORM)),
        ("language", "unlisted", listed("language", LANGUAGES)),
    ]
    return failed(rows, ["form_id"], rules)


def account_errors(requests: DataFrame, users: DataFrame) -> DataFrame:
    """Errors (request_id, field, reason) of account requests: e-mail or simple login, name, role, password, uniqueness."""
    email = F.lower(F.trim(F.coalesce("email", F.lit(""))))
    rows = taken(requests.withColumn("email", email), "user_id", F.col("email"), users, "user_id", F.col("email"))
    rules = [
        ("email", "form", ~F.col("email").rlike(EMAIL_FORM) & ~F.col("email").rlike(LOGIN_FORM)), ("email", "taken", F.col("taken")),
        ("name", "missing", F.trim(F.coalesce("name", F.lit(""))) == ""), ("role", "unlisted", ~F.coalesce("role", F.lit("")).isin(*ROLES)),
        ("password", "short", F.length(F.coalesce("password", F.lit(""))) < 8),
    ]
    return failed(rows, ["request_id"], rules)


def organisation_errors(requests: DataFrame, organisations: DataFrame) -> DataFrame:
    """Errors (request_id, field, reason) of organisation names: 3 to 80 characters once squeezed, and free."""
    name = F.trim(F.regexp_replace(F.coalesce("name", F.lit("")), r"\s+", " "))
    rows = taken(requests.withColumn("name", name), "org_id", F.col("name"), organisations, "org_id", F.col("name"))
    return failed(rows, ["request_id"], [("name", "form", ~F.length("name").between(3, 80)), ("name", "taken", F.col("taken"))])


def message_errors(messages: DataFrame) -> DataFrame:
    """Errors (message_id, field, reason) of messages: to (parted by , or ;) and subject."""
    people = F.filter(F.transform(F.split(F.coalesce("to", F.lit("")), "[,;]"), lambda p: F.trim(p)), lambda p: p != "")
    bad = F.exists(people, lambda p: ~p.rlike(EMAIL_FORM))
    return failed(messages, ["message_id"], [("to", "form", bad), ("to", "missing", F.size(people) == 0), ("subject", "missing", F.trim(F.coalesce("subject", F.lit(""))) == "")])


def mailbox(messages: DataFrame, box: str, wanted: str = "") -> DataFrame:
    """Messages of a box that hold wanted in subject, recipients, sender or text, case aside; newest first."""
    rows = messages.where(F.col("box") == box)
    if wanted:
        rows = rows.where(F.lower(F.concat_ws(" ", "subject", "to", "from", "text")).contains(wanted.lower()))
    return rows.orderBy(F.desc("at"), "message_id")


def live_items(items: DataFrame, key: list[str], order: str, removed: Column, empty: Column) -> DataFrame:
    """items without removed ones and without the empty ones at a list's end; those in between stay."""
    last = F.max(F.when(~F.coalesce(empty, F.lit(False)), F.col(order))).over(Window.partitionBy(*key))
    return items.withColumn("_last", last).where((F.col(order) <= F.col("_last")) & ~F.coalesce(removed, F.lit(False))).drop("_last")


def visible_notes(notes: DataFrame, roles: DataFrame) -> DataFrame:
    """(role, version, date, n_items) of the versions with an item for the role. notes: version, date, audience; roles: role."""
    sees = F.array_contains(F.create_map(*[x for a, rs in AUDIENCES.items() for x in (F.lit(a), F.array(*map(F.lit, rs)))])[F.col("audience")], F.col("role"))
    return notes.join(F.broadcast(roles.select("role").where(F.col("role").isin(*ROLES)).distinct()), sees).groupBy("role", "version", "date").agg(F.count(F.lit(1)).alias("n_items"))


def note_baselines(users: DataFrame, notes: DataFrame) -> DataFrame:
    """users (user, role, seen, last_access, created) with baseline: the version seen last; for accounts without one the
    newest version dated before the last access (or creation); the newest of all if there is no such date; else null."""
    every = notes.select("version", "date").distinct()
    newest = every.agg(F.max_by("version", version_key(F.col("version"))).alias("_newest"))
    # how far each version's date reaches: the greatest version up to each date, by one as-of pass over dates
    steps = every.groupBy("date").agg(F.max(F.struct(version_key(F.col("version")).alias("k"), "version")).alias("v"))
    steps = steps.withColumn("v", F.max("v").over(Window.orderBy("date").rowsBetween(Window.unboundedPreceding, 0))).withColumn("until", F.lead("date").over(Window.orderBy("date")))
    since = F.left(F.coalesce("last_access", "created"), F.lit(10))
    rows = users.withColumn("_since", since).crossJoin(F.broadcast(newest))
    reached = F.broadcast(steps.select(F.col("date").alias("_from"), F.col("until").alias("_until"), F.col("v.version").alias("_before")))
    rows = rows.join(reached, (F.col("_since") > F.col("_from")) & (F.col("_until").isNull() | (F.col("_since") <= F.col("_until"))), "left")
    baseline = F.when(F.col("seen").isNotNull(), F.col("seen")).when(F.coalesce(F.col("_since"), F.lit("")) == "", F.col("_newest")).otherwise(F.col("_before"))
    return rows.withColumn("baseline", baseline).drop("_since", "_newest", "_from", "_until", "_before")


def pending_notes(users: DataFrame, notes: DataFrame) -> DataFrame:
    """(user, version, n_items) of the visible versions newer than each user's baseline."""
    roles = users.select(F.coalesce("role", F.lit("cliente")).alias("role")).distinct()
    seen = visible_notes(notes, roles)
    rows = note_baselines(users, notes).select("user", F.coalesce("role", F.lit("cliente")).alias("role"), "baseline")
    return rows.join(F.broadcast(seen), "role").where(F.col("baseline").isNull() | (version_key(F.col("version")) > version_key(F.col("baseline")))).select("user", "version", "n_items")


def baseline_to_show_again(notes: DataFrame, roles: DataFrame) -> DataFrame:
    """For each role the baseline with which its newest visible version shows again: the second newest, or null."""
    seen = visible_notes(notes, roles).groupBy("role").agg(F.sort_array(F.collect_list(F.struct(version_key(F.col("version")).alias("k"), "version")), asc=False).alias("v"))
    return seen.select("role", F.get("v", F.lit(1))["version"].alias("baseline"))


def note_faults(notes: DataFrame) -> DataFrame:
    """(version, fault) of release notes: words of administration in a note for everybody, a malformed item, a version twice."""
    words = F.lower(F.concat_ws(" ", "title", "text"))
    told = F.exists(F.array(*map(F.lit, ADMIN_WORDS)), lambda w: words.contains(w))
    bad = ~F.coalesce("audience", F.lit("")).isin(*AUDIENCES) | (F.coalesce("title", F.lit("")) == "") | (F.coalesce("text", F.lit("")) == "")
    item = F.explode(F.array_compact(F.array(F.when((F.col("audience") == "todos") & told, "speaks of administration"), F.when(bad, "malformed")))).alias("fault")
    twice = notes.select("version", "date").distinct().groupBy("version").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("version", F.lit("twice").alias("fault"))
    return notes.select("version", item).distinct().unionByName(twice)


def organisation_totals(orgs: DataFrame, members: DataFrame, docs: DataFrame, journals: DataFrame) -> DataFrame:
    """orgs (org_id, name) with members, their names (administrators marked), docs and journals, ordered by name."""
    shown = F.concat("name", F.when(F.col("is_admin"), F.lit(" (admin)")).otherwise(""))
    people = members.groupBy("org_id").agg(F.countDistinct("user").alias("members"), F.array_join(F.sort_array(F.collect_set(shown)), ", ").alias("names"))
    count = lambda df, name: df.where("org_id is not null").groupBy("org_id").agg(F.count(F.lit(1)).alias(name))
    out = orgs.join(people, "org_id", "left").join(count(docs, "docs"), "org_id", "left").join(count(journals, "journals"), "org_id", "left")
    return out.fillna(0, ["members", "docs", "journals"]).fillna("", ["names"]).orderBy(F.lower("name"), "org_id")


def uncited(references: DataFrame, cited: DataFrame) -> DataFrame:
    """references (doc_id, ref_no) that no citation (doc_id, ref_no) names."""
    return references.join(cited.select("doc_id", "ref_no").distinct(), ["doc_id", "ref_no"], "left_anti")


def document_counters(citations: DataFrame, refs: DataFrame, items: DataFrame) -> DataFrame:
    """Per document: distinct (author, year) citations, references by confidence, and items (doc_id, kind) by kind."""
    cites = citations.groupBy("doc_id").agg(F.countDistinct("author", "year").alias("citations"))
    sure = refs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("references"), *[F.count_if(F.col("confidence") == c).alias(c) for c in ("high", "medium", "low")])
    kinds = items.groupBy("doc_id").agg(*[F.count_if(F.col("kind") == k).alias(k) for k in ("figure", "table", "equation", "note")])
    names = ["citations", "references", "high", "medium", "low", "figure", "table", "equation", "note"]
    return cites.join(sure, "doc_id", "full").join(kinds, "doc_id", "full").fillna(0, names).select("doc_id", *names)


def previews(tables: DataFrame, rows: int = 4, chars: int = 120) -> DataFrame:
    """tables (doc_id, table_no, caption, cells) with rows, the first rows of cells and a caption cut to chars."""
    return tables.select("doc_id", "table_no", F.left("caption", F.lit(chars)).alias("caption"), F.size("cells").alias("rows"), F.slice("cells", 1, rows).alias("preview"))


def best_grid(grids: DataFrame, keys: list[str]) -> DataFrame:
    """Of several grids for one place the one with most cells; equal ones: the first."""
    return grids.groupBy(*keys).agg(F.max_by("grid_no", F.struct(F.col("rows") * F.col("cols"), -F.col("grid_no"))).alias("grid_no"))


def in_reading_order(lines: DataFrame, keys: list[str]) -> DataFrame:
    """lines with place: their number (from 1) by height in steps of two points (half to even), then from the left."""
    return lines.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(F.bround(F.col("y0") / 2), "x0", "line_no")))


def distinct_in_order(x: Column) -> Column:
    """The elements once each, in the order of their first places."""
    return F.array_distinct(x)
