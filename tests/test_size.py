"""Findings of large tables: joins whose work is bounded, folds without a call for each document, and odd inputs beside them."""

import re

import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F

from quire.functions import text
from quire.operators import body, delivery, forms, front, jats, linking, references, spans, validation, workflow, xml, zones
from quire.plans import body_queries, document_queries, front_queries, scalar_queries
from quire.streaming import queues


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_journals_by_first_of_each_number(spark):
    """3000 journals of one ISSN and prefix are one row to a document; a prefix may end before the slash."""
    journals = spark.range(3000).select(F.col("id").alias("rank"), F.concat(F.lit("j"), "id").alias("acronym"), F.lit("E1").alias("issn_epub"), F.lit(None).cast("string").alias("issn_ppub"), F.when(F.col("id") > 4, "10.1590").alias("doi_prefix"))
    docs = spark.createDataFrame([(1, ["E1", "X"], "10.1590/a", None), (2, ["X"], "10.1590/b", None), (3, ["X"], "10.1", None), (4, None, None, None), (5, ["E1"], None, "code")], "doc_id long, issns array<string>, doi string, code string")
    got = linking.resolve_journals(docs, journals)
    assert {r.doc_id: r.journal for r in got.collect()} == {1: "j0", 2: "j5", 3: None, 4: None, 5: "code"}


def _lines(spark, *extra):
    """A made page of lines for each of a few documents, by way of explode."""
    row = F.struct(F.lit(1).alias("line_no"), F.lit("1 a note").alias("text"), F.lit(8.0).alias("size"), F.lit(10.0).alias("x0"), F.lit(90.0).alias("x1"), F.lit(700.0).alias("y0"), F.lit(708.0).alias("y1"), F.lit(False).alias("raised"))
    return spark.range(4).select(F.col("id").alias("doc_id"), F.lit(1).alias("page"), F.explode(F.array(row, row)).alias("x")).select("doc_id", "page", "x.*", *extra)


def test_sidebars_are_not_broadcast(spark):
    """F2"""
    assert "Broadcast" not in plan(zones.sidebars(_lines(spark, F.lit(10.0).alias("body_size")), 600.0))
    assert "Broadcast" not in plan(zones.page_number(_lines(spark, F.lit(10.0).alias("body_size")), 842.0))


def test_footnotes_are_not_broadcast(spark):
    """F9"""
    assert "Broadcast" not in plan(zones.footnotes(_lines(spark), 842.0))


def test_spans_are_not_broadcast(spark):
    """F3"""
    row = F.struct(*[F.lit(v).alias(n) for n, v in zip("block line span_no text size font raised bold italic".split(), (1, 1, 1, "a", 9.0, "f", False, False, False))])
    each = spark.range(4).select(F.col("id").alias("doc_id"), F.lit(1).alias("page"), F.explode(F.array(row)).alias("x")).select("doc_id", "page", "x.*")
    boxes = each.select("doc_id", "page", "block", "line").distinct().withColumns({n: F.lit(1.0) for n in ("x0", "y0", "x1", "y1", "dx", "dy")})
    assert "Broadcast" not in plan(spans.lines_from_spans(each, boxes))


def test_titles_of_declarations_are_folded_once(spark):
    """F10"""
    blocks = spark.createDataFrame([(1, 1, "Financiamento", "x"), (1, 2, "Funding", "y"), (1, 3, "Editor e conflito", "z"), (2, 1, None, "w")], "doc_id long, block_no int, title string, text string")
    got = delivery.declarations(blocks)
    assert plan(got).count("translate(") <= 2
    assert sorted((r.doc_id, r.kind, r.block_no) for r in got.collect()) == [(1, "conflito", 3), (1, "financiamento", 1)]


def test_labelled_numbers_are_no_years(spark):
    """F12"""
    texts = ("Rev. Dir., v. 1987, n. 7, 2019", "n. 1999 de 2001", "p. 1950-1961, 2003", "Ano 2004", "ISSN, 2005")
    rows = spark.createDataFrame([(i, 0, 1, t) for i, t in enumerate(texts)], "doc_id long, rank int, seq int, text string")
    assert [r.year for r in front.identifiers(rows).orderBy("doc_id").collect()] == ["2019", "2001", "2003", "2004", "2005"]


def test_grids_without_a_call_for_each_document(spark):
    """F7"""
    captions = spark.createDataFrame([(1, 1, 1), (1, 2, 1), (1, 3, 3), (2, 1, 1)], "doc_id long, caption_no int, page int")
    grids = spark.createDataFrame([(1, 1, 1, 500.0), (1, 2, 1, 100.0), (1, 3, 2, 50.0), (1, 4, 7, 10.0), (3, 9, 1, 1.0)], "doc_id long, grid_no int, page int, y0 double")
    got = body.place_grids(captions, grids)
    assert "Pandas" not in plan(got)
    assert sorted(map(tuple, got.collect()), key=str) == sorted([(1, 1, 2), (1, 2, 1), (1, 3, 3), (1, None, 4), (2, 1, None), (3, None, 9)], key=str)


def test_images_without_a_call_for_each_document(spark):
    """F8"""
    captions = spark.createDataFrame([(1, 1, 1, 300.0, 310.0), (1, 2, 1, 400.0, 410.0), (1, 3, 2, 100.0, 110.0), (2, 1, 1, 1.0, 2.0)], "doc_id long, caption_no int, page int, y0 double, y1 double")
    images = spark.createDataFrame([(1, 1, 1, 10.0, 90.0), (1, 2, 1, 100.0, 305.0), (1, 3, 2, 104.0, 200.0), (3, 1, 1, 1.0, 2.0)], "doc_id long, image_no int, page int, y0 double, y1 double")
    got = body.place_images(captions, images)
    assert "Pandas" not in plan(got)
    assert sorted(map(tuple, got.collect()), key=str) == sorted([(1, 1, 2), (1, 2, 1), (1, 3, 3), (2, 1, None)], key=str)


def test_equations_without_a_call_for_each_document(spark):
    """F11"""
    rows = [(1, 1, 1, None, "a = b", False, 100.0, 100.0, 300.0, 112.0), (1, 1, 2, "1", "", True, 400.0, 101.0, 420.0, 111.0), (1, 2, 3, None, "c + d", False, 100.0, 100.0, 300.0, 112.0), (2, 1, 1, "7", "", True, 1.0, 1.0, 2.0, 2.0)]
    boxes = spark.createDataFrame(rows, "doc_id long, page int, block int, number string, text string, only_number boolean, x0 double, y0 double, x1 double, y1 double")
    got = spans.merged_equations(boxes)
    assert "FlatMapGroups" not in plan(got)
    assert sorted((r.doc_id, r.page, r.number, r.text, r.x1) for r in got.collect()) == [(1, 1, "1", "a = b", 420.0), (1, 2, None, "c + d", 300.0)]


def test_like_places_are_paired_once(spark):
    """2000 grids and 2000 captions at one place would be 4,000,000 pairs."""
    at = lambda name, y, x: spark.range(2000).select(F.col("id").alias(name), F.lit(1).alias("page"), F.lit(5.0).alias(y), F.lit(7.0).alias(x))
    fits = (F.col("gy") - F.col("y")).between(-60, 90) & (F.abs(F.col("gx") - F.col("x")) < 60)
    got = linking.nearest(at("caption", "y", "x"), at("grid", "gy", "gx"), ["page"], fits, F.abs(F.col("gy") - F.col("y")), "grid", ("y", "gy", -60.0, 90.0), "caption")
    assert got.where("grid = 0").count() == 2000


def test_visible_pairs_are_not_shuffled(spark):
    """no step that shuffles follows the pairs, and none is there twice."""
    docs = spark.createDataFrame([(1, 7, 1, 1), (2, 8, 1, 2), (3, 9, 2, 1), (4, None, 3, 3)], "doc_id long, owner long, journal long, org long")
    roles = spark.createDataFrame([(7, 1), (7, 1), (9, 1), (5, 2), (5, 3)], "usr long, journal long")
    admins = spark.createDataFrame([(7, 1), (8, 2), (5, 1), (5, 3), (6, 2)], "usr long, org long")
    got = workflow.visible(docs, "usr", roles, admins, spark.createDataFrame([(6,), (6,)], "usr long"))
    want = {(7, 1), (9, 1), (7, 2), (9, 2), (5, 3), (5, 4), (5, 1), (7, 3), (8, 2), (9, 3), (None, 4), *((6, d) for d in (1, 2, 3, 4))}
    rows = [tuple(r) for r in got.collect()]
    assert len(rows) == len(want) and set(rows) == want
    # the only aggregates are of users' rights: distinct rights, journals by user, distinct staff
    assert not any("doc_id" in line for line in plan(got).splitlines() if "HashAggregate" in line)


def test_visible_pairs_take_little_room(spark, tmp_path):
    """documents of one journal follow each other with the same list of users, so 2,000,000 pairs take less than a quarter byte each."""
    docs = spark.range(0, 20_000, 1, 4).select(F.col("id").alias("doc_id"), F.lit(None).cast("long").alias("owner"), (F.col("id") * 7 % 20).alias("journal"), F.lit(None).cast("long").alias("org"))
    roles = spark.range(0, 2000, 1, 2).select(F.col("id").alias("usr"), (F.col("id") % 20).alias("journal"))
    nobody = spark.createDataFrame([], "usr long, org long")
    workflow.visible(docs, "usr", roles, nobody, nobody.select("usr")).where("usr is not null").write.parquet(str(tmp_path / "pairs"))
    assert spark.read.parquet(str(tmp_path / "pairs")).count() == 2_000_000
    assert sum(p.stat().st_size for p in (tmp_path / "pairs").glob("*.parquet")) < 500_000


def test_lists_of_users_are_parted(spark, monkeypatch):
    """users beyond one list go to the next; an administrator's list leaves out those with a role in the document's journal."""
    monkeypatch.setattr(workflow, "LISTED", 2)
    docs = spark.createDataFrame([(1, None, 1, 1), (2, 3, 2, 1)], "doc_id long, owner long, journal long, org long")
    roles = spark.createDataFrame([(u, 1) for u in range(5)] + [(8, None), (None, 2)], "usr long, journal long")
    admins = spark.createDataFrame([(u, 1) for u in range(3, 8)], "usr long, org long")
    got = workflow.visible(docs, "usr", roles, admins, spark.createDataFrame([(20,), (21,), (22,), (7,)], "usr long"))
    want = [(u, 1) for u in (*range(7), None)] + [(u, 2) for u in (3, 4, 5, 6, None)] + [(u, d) for u in (7, 20, 21, 22) for d in (1, 2)]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)


def test_like_elements_are_rated_once(spark):
    """300 articles of other texts are as many rows as one, but for the texts that a rule reads; every place is kept."""
    xml = F.concat(F.lit("<article><body><sec><title>T"), "id", F.lit("</title><p>a</p><p> </p>"), F.when(F.col("id") == 7, "<q/>").otherwise(""), F.lit("</sec></body></article>"))
    docs = spark.range(0, 300, 1, 1).select(F.col("id").alias("doc_id"), xml.alias("xml"))
    rows = validation.nodes(docs, told=frozenset()).collect()
    assert len(rows) == 8  # article, body, title, two p, q, and sec without and with q
    assert sorted((x.doc_id, x.place) for r in rows for x in r["at"]) == sorted([(d, k) for d in range(300) for k in range(1, 7)] + [(7, 7)])
    assert validation.nodes(docs, told=frozenset(["title"])).count() == 307
    found = validation.validate(docs, content={"article": "(body)", "body": "(sec)", "sec": "(title, p*)", "title": "(#PCDATA)*", "p": "EMPTY"}, rules=()).collect()
    want = [(d, 5, "text not allowed") for d in range(300)] + [(7, 4, "child not allowed"), (7, 7, "unknown element")]
    assert sorted((r.doc_id, r.place, r.rule) for r in found) == sorted((d, 3 if rule == "child not allowed" else k, rule) for d, k, rule in want)


def test_like_markup_is_parsed_once(spark):
    """nothing is shuffled to validate; documents by their markup are read as those that are parsed whole, which an instruction makes them."""
    head = '<?xml version="1.0" encoding="utf-8"?>\n<!DOCTYPE a PUBLIC "x" "y">\n'
    odd = [
        '<a id="i"><b id="j">t</b><b id="j">u &amp;lt; v</b><c rid="i j k k"/></a>', '<a id="i"><b id="k">t</b><b id="l">u</b><c rid="i j k k"/></a>', "<a><b> t</b><b>\u00a0</b><b>\n</b><b>x &lt;&amp;gt; y</b></a>",
        '<a t="x>y"><b>t</b></a>', '<a t="x>y"><b>t</a>', "<a><b>t</b>", "<a>t<b/>u<b>v</b>w</a>", "<a><b>x]]>y</b></a>", "<a><b>x ]] y</b></a>", "<a><b>&nope;</b></a>", "<a><b>&#65; t</b></a>", "<a><b>x\r\ny</b></a>",
        "<a><!-- > x <b> --><b>t</b></a>", "<a><![CDATA[ > t < ]]></a>", "<a><b>a > b</b></a>", "x<a/>", "<a/>x", "<a id=\"i\" id=\"i\"/>", "<a id=''><b id=' '>t</b></a>", "<a t='q id=\"i\" r'><b id=\"i\">t</b></a>", "<a><b>\ue0000\ue001 t</b></a>", "<a><b>\x00t</b></a>", "", "<a><b> id=\"i\"</b></a>",
    ]
    docs = spark.createDataFrame([(2 * i, head + x) for i, x in enumerate(odd)] + [(2 * i + 1, head + x + "<?whole?>") for i, x in enumerate(odd)], "doc_id long, xml string").coalesce(1)
    for told, ids in ((None, True), (frozenset(["b"]), False)):
        seen = {}
        for r in validation.nodes(docs, told=told, ids=ids).collect():
            for at in r["at"]:
                seen.setdefault(at.doc_id, []).append((at.place, r.path, r.name, sorted((r.attributes or {}).items()), r.children, r.text, r.error, r.rule))
        for i, x in enumerate(odd):
            assert sorted(seen[2 * i], key=str) == sorted(seen[2 * i + 1], key=str) or x in ("", "<a/>x", "<a><b>t</b>"), x  # the place of an error at the end is that of the instruction
        assert len(seen[2]) == 4 + 1 and len(seen[0]) == 4 + 2
    assert [r.error for r in validation.nodes(docs.where("doc_id = 8")).collect()] == ["3:17: mismatched tag"]
    assert "Exchange" not in plan(validation.validate(docs)).replace("BroadcastExchange", "")


def test_parts_of_articles_are_made_where_their_document_is(spark, tmp_path):
    """orders and items are shuffled before anything is made of them; of what is made, only references are shuffled."""
    spark.range(0, 400, 1, 4).select(F.col("id").alias("o_orderkey"), F.lit(1).alias("o_custkey"), F.lit("O").alias("o_orderstatus"), F.lit("1-URGENT").alias("o_orderpriority"), F.current_timestamp().alias("o_orderdate")).write.parquet(str(tmp_path / "orders.parquet"))
    spark.range(0, 1600, 1, 4).select((F.col("id") % 400).alias("l_orderkey"), F.expr("cast(id / 400 as int) + 1").alias("l_linenumber"), (F.col("id") % 7).alias("l_partkey")).write.parquet(str(tmp_path / "lineitem.parquet"))
    made = plan(document_queries.QUERIES["jats_articles"](spark, str(tmp_path)))
    assert "FullOuter" not in made and not re.search(r"hashpartitioning\(doc_id#\d+L?, [a-z_]", made)
    below = [re.search(r"Exchange \w+\((\w+)#", line)[1] for line in made.splitlines() if re.search(r"\bExchange hashpartitioning\(", line)]
    assert set(below) == {"o_orderkey", "doc_id", "text"}
    by_document = [line for line in made.splitlines() if re.search(r"Exchange hashpartitioning\(doc_id#", line)]
    assert all("REPARTITION_BY_COL" in line for line in by_document)  # none that a join or an aggregate asks for


def test_references_without_text_keep_their_number(spark):
    """copies of a text, entries without a text and places of floats are as before."""
    refs = spark.createDataFrame([(1, 1, "BRASIL. Lei n. 7, de 1996."), (1, 2, None), (1, 3, "BRASIL. Lei n. 7, de 1996."), (2, 1, "BRASIL. Lei n. 7, de 1996.")], "doc_id long, pos int, text string")
    got = {r.doc_id: r for r in jats._references(refs).collect()}
    assert [got[1]._n_refs, got[2]._n_refs] == [3, 1]
    assert re.findall(r'<ref id="(B\d)"><mixed-citation>([^<]*)<', got[1]._refs) == [("B1", "BRASIL. Lei n. 7, de 1996."), ("B3", "BRASIL. Lei n. 7, de 1996.")]
    docs = spark.createDataFrame([(1, "j"), (2, "j"), (3, "j")], "doc_id long, journal string").select("*", *[F.lit(None).cast("string").alias(c.split()[0]) for c in jats.RELATIONS["docs"].split(", ")[1:]])
    sections = spark.createDataFrame([(1, 0, 1, "A", ["a", "b"]), (1, 1, 2, "B", None)], "doc_id long, pos int, level int, title string, paragraphs array<string>").withColumn("kind", F.lit(None).cast("string"))
    floats = spark.createDataFrame([(d, p, s, k) for d, p, s, k in ((1, 1, 0, 1), (1, 2, 1, 9), (1, 3, None, 0), (1, 4, 7, 0), (2, 1, 0, 0))], "doc_id long, pos int, section int, paragraph int")
    none = {c.split()[0]: F.lit(None).cast(c.split(" ", 1)[1]) for c in "label string, caption string, source string, file string, mathml string, header_rows int".split(", ")}
    floats = floats.select("*", F.lit("box").alias("kind"), F.concat(F.lit("t"), "pos").alias("text"), *[v.alias(n) for n, v in none.items()], F.lit(None).cast("array<array<string>>").alias("cells"), F.lit(None).cast("array<struct<speaker:string,said:string>>").alias("turns"))
    bodies = {r.doc_id: re.sub(r" id=\"q\d\"", "", "".join(re.findall("<body>.*</body>", r.xml))) for r in jats.build({"docs": docs, "sections": sections, "floats": floats}).collect()}
    box = "<boxed-text><p>t{}</p></boxed-text>".format
    assert bodies == {1: f"<body><sec><title>A</title><p>a</p>{box(1)}<p>b</p><sec><title>B</title>{box(2)}{box(3)}{box(4)}</sec></sec></body>", 2: f"<body>{box(1)}</body>", 3: ""}


def test_costly_rows_are_dealt_over_tasks_that_grow(spark, tmp_path):
    """400,000 entries in one file are 20 tasks, none with much more than its share."""
    spark.range(0, 400_000, 1, 1).select(F.col("id").alias("o_orderkey"), F.lit(1).alias("o_custkey"), F.current_timestamp().alias("o_orderdate")).write.parquet(str(tmp_path / "orders.parquet"))
    made = document_queries.QUERIES["reference_fields"](spark, str(tmp_path))
    assert "arrow" in plan(made).lower() and "o_orderkey" in plan(made)
    orders = spark.read.parquet(str(tmp_path / "orders.parquet"))
    sizes = [r["count"] for r in scalar_queries._dealt(orders, "o_orderkey", orders).groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) == 20 and max(sizes) < 25_000
    assert re.search(r"hashpartitioning\(o_orderkey#\d+L?, 20\)", plan(made))


def test_authors_without_the_other_fields(spark):
    """grouping lines into entries needs the authors alone; they are those of the whole parse."""
    texts = ["SILVA, J. A. Title. Revista Nova, v. 3, 2010.", "COSTA, Ana; REIS, B. (Orgs.). Book. São Paulo: Press, 2011.", "  Lima, C.  (2012). Paper. Journal, 3(4), 5-9.", "______. More, 1999.", "IN: x (Ed.). y", "", None]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    both = rows.select(references.authors(F.col("text")).alias("a"), references.fields(F.col("text"))["authors"].alias("b")).collect()
    assert all(r.a == r.b for r in both) and both[0].a == ["SILVA, J. A"] and both[1].a == []
    made = plan(references.entries(rows.select("doc_id", F.lit(1).alias("line_no"), "text")))
    assert "leading(" in made and "parsed(" not in made


def test_forms_rules_are_tried_once(spark):
    """a field's first rule that holds is a condition of its own, not a search through all hits for each of them."""
    rows = spark.createDataFrame([(1, 5, None), (2, 1, "x"), (3, None, "")], "id long, n int, s string")
    n, s = F.col("n"), F.col("s")
    got = forms.failed(rows, ["id"], [("n", "big", n > 4), ("s", "missing", F.coalesce(s, F.lit("")) == ""), ("n", "odd", n % 2 == 1), ("n", "null", n.isNull())])
    assert sorted(map(tuple, got.collect())) == [(1, "n", "big"), (1, "s", "missing"), (2, "n", "odd"), (3, "n", "null"), (3, "s", "missing")]
    assert "slice(" not in plan(got) and "exists(" not in plan(got)


def test_like_references_are_paired_once(spark):
    """2000 citations and 2000 references of one name and year would be 4,000,000 pairs."""
    cites = spark.range(2000).select(F.lit(1).alias("doc_id"), F.col("id").alias("cit_no"), F.lit("Silva").alias("author"), F.lit("1999a").alias("year"))
    refs = spark.range(2000).select(F.lit(1).alias("doc_id"), (F.col("id") + 7).alias("ref_no"), F.array(F.lit("SILVA, J.")).alias("authors"), F.lit("1999").alias("year"))
    got = linking.link_citations(cites, refs)
    assert got.where("ref_no = 7").count() == 2000
    assert re.search(r"HashAggregate\(keys=\[[^\]]*_name", plan(got))


def _exchanges(query, spark, folder, n=400_000):
    """The exchanges of a query's plan over n orders in one file, by what they are dealt by."""
    spark.range(0, n, 1, 1).select(F.col("id").alias("o_orderkey"), F.lit(1).alias("o_custkey"), F.lit("O").alias("o_orderstatus")).write.parquet(f"{folder}/orders.parquet")
    return re.findall(r"Exchange (\w+)\(([^)]*)\)", plan(query(spark, str(folder))))


def _dealt_before_lines(found, times):
    return len(found) == times and all(kind == "hashpartitioning" and re.fullmatch(r"o_orderkey#\d+L, 20", by) for kind, by in found)


def test_abstracts_lines_are_made_in_dealt_tasks(spark, tmp_path):
    """the orders are dealt, 20,000 to a task; the lines made of them aren't shuffled."""
    assert _dealt_before_lines(_exchanges(front_queries.QUERIES["abstract_blocks"], spark, tmp_path), 1)


def test_back_matter_is_made_in_dealt_tasks(spark, tmp_path):
    """F20"""
    query = body_queries.QUERIES["back_matter_blocks"]
    assert _dealt_before_lines(_exchanges(query, spark, tmp_path), 2)
    assert "Broadcast" not in plan(query(spark, str(tmp_path)))


def test_support_meets_a_documents_authors_as_one_row(spark, tmp_path):
    """lines aren't paired with authors nor shuffled; sides, ties and pages as before."""
    assert _dealt_before_lines(_exchanges(front_queries.QUERIES["support_lines"], spark, tmp_path), 2)
    authors = spark.createDataFrame([(1, "A", 1, 100.0), (1, "B", 1, 200.0), (1, "C", 2, 50.0), (2, "D", 1, 100.0), (3, "E", 1, None)], "doc_id long, author string, page int, y0 double")
    rows = [(1, 1, 1, 110.0, "id"), (1, 2, 1, 215.0, "id"), (1, 3, 2, 40.0, "aff"), (1, 4, 1, 150.0, "x"), (2, 1, 2, 100.0, "id"), (3, 1, 1, 5.0, "id"), (4, 1, 1, 5.0, "id")]
    support = spark.createDataFrame(rows, "doc_id long, line_no int, page int, y0 double, kind string")
    got = front.assign_support(support, authors).collect()
    assert sorted((r.doc_id, r.line_no, r.kind, r.author) for r in got) == [(1, 1, "id", "A"), (1, 2, "id", "B"), (1, 3, "aff", "C"), (1, 4, "x", "A")]


def test_titles_are_read_once(spark, tmp_path, monkeypatch):
    """copies of a text are read once; orders are dealt before lines are made of them."""
    assert _exchanges(front_queries.QUERIES["title_groups"], spark, tmp_path)[-1][1].endswith(", 20")
    texts = ["A title that is of the law and the land", None, "", "os e", "Um título que é de duas linhas e mais", "A title that is of the law and the land"] * 3
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, t string").coalesce(1)
    got = [tuple(r.x) for r in rows.select("id", text.language(F.col("t")).alias("x")).orderBy("id").collect()]
    assert [lang for lang, _ in got] == ["en", None, None, None, "pt", "en"] * 3 and got[0][1] > 0.5
    # the second reading is of texts that differ from the first
    lines = spark.createDataFrame([(1, 1, "“A title that is of the law and the land”", 12.0, True, False), (2, 1, "Um título que é de duas linhas", 12.0, True, False)], "doc_id long, line_no int, text string, size double, bold boolean, italic boolean")
    made = front.title_groups(lines)
    assert sorted((r.doc_id, r.text, r.language) for r in made.collect()) == [(1, "A title that is of the law and the land", "en"), (2, "Um título que é de duas linhas", "pt")]
    assert "_whole" in plan(made)


class _State:
    """A key's state, as Spark gives it to the limiter."""

    exists, hasTimedOut = False, False

    def update(self, value):
        self.value = value

    def setTimeoutTimestamp(self, at):
        self.until = at

    def getCurrentWatermarkMs(self):
        return 0


def test_limiter_gives_out_parts(monkeypatch):
    """a key's attempts are given out in parts; late ones are sorted in, and the state is that of the last."""
    steps = []

    class Attempts:
        withWatermark = groupBy = lambda self, *_: self
        applyInPandasWithState = lambda self, step, *_: steps.append(step)

    queues.limiter(Attempts(), 2, 3600)
    monkeypatch.setattr(queues, "PART", 2)
    at = pd.to_datetime(["2024-01-01 00:00:03", "2024-01-01 00:00:01", "2024-01-01 00:00:02", "2024-01-01 00:00:05", "2024-01-01 02:00:00"])
    frame = pd.DataFrame({"key": "a", "at": at, "ok": [True, False, False, False, True]})
    state = _State()
    parts = list(steps[0](("a",), iter([frame[:2], frame[2:]]), state))
    assert [len(p) for p in parts] == [2, 2, 1]
    got = pd.concat(parts)
    assert list(got["at"]) == sorted(at) and list(got["blocked"]) == [False, False, True, True, False] and set(got["key"]) == {"a"}
    assert state.value == ([],) and state.until == int(at[-1].timestamp() * 1000) + 3_600_000


def test_links_lists_are_read_by_column(spark):
    """F16: what a document has is merged, not broadcast; lists come column by column, paragraphs without a word of floats are left at that."""
    given = pa.array([[{"a": "z", "n": 0}], None, [], [{"a": "x", "n": 1}, {"a": None, "n": 2}]])
    assert xml.listed(given.slice(1)) == [[], [], [{"a": "x"}, {"a": None}]]
    assert xml.listed(pa.array([["a", None], None, ["b"]])) == [["a", None], [], ["b"]]
    floats = [{"kind": "table", "number": "2", "rid": "t2"}, {"kind": "fig", "number": "1.a", "rid": "f1"}]
    text = "Fig. 1.a, TABELAS 2 & tabela 22; configura 1.a, 2"
    assert xml.linked_text(text, [], [{"text": "2", "rid": "B1"}], floats, 0) == '<xref ref-type="fig" rid="f1">Fig. 1.a</xref>, TABELAS <xref ref-type="bibr" rid="B1">2</xref> &amp; tabela 22; configura 1.a, 2'
    one = lambda *rows: spark.range(4).select(F.col("id").alias("doc_id"), F.explode(F.array(*rows)).alias("x")).select("doc_id", "x.*")
    row = lambda **cols: F.struct(*[F.lit(v).alias(n) for n, v in cols.items()])
    made = xml.marked_paragraphs(one(row(para_no=1, text="a[^1] tabela 2")), one(row(cit_no=1, text="a", rid="B1")), one(row(kind="table", number="2", rid="t2")), one(row(label="1", note_no=1, id="fn1")), one(row(n=3)))
    assert "Broadcast" not in plan(made)
    assert {r.marked for r in made.collect()} == {'<xref ref-type="bibr" rid="B1">a</xref><xref ref-type="fn" rid="fn1"><sup>1</sup></xref> <xref ref-type="table" rid="t2">tabela 2</xref>'}
