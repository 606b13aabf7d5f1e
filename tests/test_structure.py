"""Structure of word processor files against a plain walk over each file's lines, and damaged or odd files."""

import random
import re
import zipfile
from io import BytesIO

from quire.operators import structure
from quire.plans.structure_queries import docx_file
from quire.sources import docx

SAY = ["Tabela 1: dados", "Figura 2 - mapa", "quadro 3", "Fonte: IBGE", "como na tabela 1 e na Figura  2", "Revista Nova", "Tabela 1000 não é", "uma linha", "figura 2a", "Resumo: algo"]
HEADS = ["1. Introdução", "2 Métodos", "Resultados", "Resumo", "Keywords", "Referências", "Um título bastante comprido"]


def random_parts(rnd):
    out = []
    for i in range(rnd.randrange(0, 30)):
        x = rnd.random()
        if x < 0.25:
            out.append(("line", rnd.choice(["Heading1", "Heading 2", "heading3", "Title"]), rnd.choice(HEADS)))
        elif x < 0.7:
            out.append(("line", "", rnd.choice(SAY)))
        elif x < 0.8:
            out.append(("table", "", rnd.choice(["a|b/1|2", "1|b/3|4/5|6", "x"])))
        elif x < 0.9:
            out.append(("image", "", f"r{i}"))
        elif x < 0.95:
            out.append(("formula", "", "x+1"))
        else:
            out.append(("note", "", "nota"))
    return out


def plain(parts, media):
    """What a file declares, read off its parts one by one."""
    lines, things, notes = [], [], []
    for kind, style, text in parts:
        if kind == "line":
            level = re.fullmatch(r"heading(\d)", style.lower().replace(" ", ""))
            lines.append(["line", int(level[1]) if level else 0 if style == "Title" else None, " ".join(text.split())])
        elif kind == "note":
            notes.append(["note", None, f"{len(notes) + 1} {text}"])
        elif kind != "image" or text in media:
            things.append((kind, len(lines), text))
    seen = [t for k, _, t in lines if k == "line"]
    body = [3 < len(t) < 130 and seen.count(t) < 3 or not 3 < len(t) < 130 for t in seen]
    heads = [(i, level, t) for i, (_, level, t) in enumerate(lines) if level]
    end = next((i for i, _, t in heads if t == "Referências"), None)
    abstract = next((i for i, _, t in heads if t == "Resumo" or t == "Keywords"), None)
    starts = [i for i, _, t in heads if t in ("Resumo", "Keywords")]
    abstract = starts[0] if starts else next((i for i, t in enumerate(seen) if body[i] and t.startswith("Resumo:")), None)
    heads = [h for h in heads if h[2] not in ("Resumo", "Keywords", "Referências") and (end is None or h[0] < end)]
    early = [h for h in heads if abstract is not None and h[0] < abstract]
    out = [("title", 1, None, None, None, early[-1][2])] if early and len(early[-1][2]) > 15 else []
    sections = [h for h in heads if h not in early]
    owner = lambda at: max((n for n, h in enumerate(sections, 1) if h[0] <= at), default=None)
    between = lambda n, at: sum(body[i] for i in range(sections[n - 1][0] + 1, at)) if n else 0
    for n, (_, _, t) in enumerate(sections, 1):
        m = re.fullmatch(r"(\d+)[. ]+(.*)", t)
        out.append(("section", n, n, None, m[1] if m else None, m[2] if m else t))
    said, count = "", 0
    own = [re.match(r"(tabela|figura|quadro) (\d{1,3})\b[ :-]*(.*)", t, re.I) for _, _, t in lines + notes]
    source = [re.match(r"Fonte: (.*)", t) for _, _, t in lines + notes]
    for i, t in enumerate(seen):
        n = owner(i)
        if n and i != sections[n - 1][0] and body[i] and (end is None or i < end) and not own[i] and not source[i]:
            count += 1
            said += t.lower() + "\n"
            out.append(("paragraph", count, n, between(n, i), None, t))
    numbers = dict.fromkeys(["table", "formula", "figure", "loose image"], 0)
    for kind, at, _ in things:
        words = {"table": ("tabela",), "image": ("figura", "quadro")}.get(kind, ())
        places = [*range(at, min(at + 4, len(own))), *range(max(0, at - 3), at)]
        found = next((i for i in places if own[i] and own[i][1].lower() in words), None)
        name = kind if kind != "image" else "loose image" if found is None else "figure"
        numbers[name] += 1
        row = (name, numbers[name], owner(at), between(owner(at), at))
        if found is None:
            out.append((*row, str(numbers[name]) if kind == "formula" else None, None) + ((None, False) if kind == "table" else ()))
        else:
            told = next((source[j][1] for j in range(found + 1, min(found + 4, len(own))) if source[j]), None)
            word = "tabela" if kind == "table" else "figura"
            out.append((*row, own[found][2], own[found][3].strip(), told, bool(re.search(rf"{word}\s*{own[found][2]}\b", said))))
    return out


def test_random_files(spark):
    rnd = random.Random(5)
    files, want = [], []
    for i in range(250):
        parts = random_parts(rnd)
        media = {t: f"m{t}.PNG" for k, _, t in parts if k == "image" and rnd.random() < 0.7}
        files.append((f"f{i}", docx_file(parts, media)))
        want += [(f"f{i}", *x, *[None] * (8 - len(x))) for x in plain(parts, media)]
    rows = structure.declared(docx.elements(spark.createDataFrame(files, "path string, content binary"))).collect()
    got = [(r.path, r.kind, r.no, r.section_no, r.para_pos, r.number, r.text, r.source, r.called) for r in rows]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert {r.kind for r in rows} == {"title", "section", "paragraph", "table", "formula", "figure", "loose image"}
    assert all((r.file == f"fig{r.no:02d}.png") == (r.kind == "figure") for r in rows)


def kinds(content):
    return [(x["kind"], x.get("text")) for x in docx.read_elements(content)]


def test_damaged_and_empty_files(spark):
    assert kinds(b"no zip") == [("error", "BadZipFile")]
    assert kinds(b"") == [("error", "BadZipFile")]
    out = BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/other.xml", "<a/>")
    assert kinds(out.getvalue()) == [("error", "KeyError")]
    good = docx_file([("line", "", "um")])
    assert kinds(good[: len(good) // 2])[0][0] == "error"
    with zipfile.ZipFile(out := BytesIO(), "w") as z:
        z.writestr("word/document.xml", zipfile.ZipFile(BytesIO(good)).read("word/document.xml"))
        z.writestr("word/footnotes.xml", "<broken")
    assert kinds(out.getvalue()) == [("line", "um"), ("error", "word/footnotes.xml: ParseError")]
    files = spark.createDataFrame([("a", b"no zip"), ("b", docx_file([])), ("c", None)], "path string, content binary")
    assert structure.declared(docx.elements(files)).collect() == []
    assert structure.declared(docx.elements(files.limit(0))).collect() == []


def test_notes_properties_and_relations():
    parts = [("line", "Title", "T"), ("note", "", "primeira"), ("image", "", "r9"), ("image", "", "r8"), ("note", "", "segunda")]
    found = docx.read_elements(docx_file(parts, {"r9": "a.png"}, title=" Um  título "))
    assert [(x["text"], x["line_no"]) for x in found if x["kind"] == "note"] == [("1 primeira", 1), ("2 segunda", 2)]
    assert [(x["style"], x["text"]) for x in found if x["kind"] == "property"] == [("title", "Um título")]
    assert [x["target"] for x in found if x["kind"] == "relation"] == ["media/a.png", "media/lost3.png"]
    assert [(x["target"], x["length"]) for x in found if x["kind"] == "medium"] == [("word/media/a.png", 1)]


def test_media_by_whole_name_or_last_step(spark):
    shape = "path string, seq int, kind string, line_no int, text string, style string, level int, bold boolean, italic boolean, cells array<array<string>>, header_rows int, mathml string, rel_id string, target string, length long"
    rows, at = [], 0
    for path, target, there in [("a", "../word/media/x.png", "word/media/x.png"), ("b", "/word/media/x.png", "word/media/x.png"), ("c", "elsewhere/x.png", "word/media/x.png"), ("d", "media/x.png", "word/media/deep/x.png")]:
        for kind, rel, name in [("image", "r", None), ("relation", "r", target), ("medium", None, there)]:
            rows.append((path, at, kind, 0 if kind == "image" else None, *[None] * 8, rel, name, 1))
            at += 1
    got = structure.declared(spark.createDataFrame(rows, shape)).collect()
    assert sorted((r.path, r.kind, r.medium) for r in got) == [(p, "loose image", "word/media/x.png") for p in "abc"]


def test_long_and_null_lines(spark):
    long = "palavra " * 40_000
    parts = [("line", "Heading1", "1. A"), ("line", "", long), ("line", "", long), ("table", "", "a|b")]
    got = structure.declared(docx.elements(spark.createDataFrame([("f", docx_file(parts))], "path string, content binary"))).collect()
    assert sorted((r.kind, r.para_pos, len(r.text or "")) for r in got) == [("paragraph", 0, len(docx.once(long.strip()))), ("paragraph", 1, len(docx.once(long.strip()))), ("section", None, 1), ("table", 2, 0)]


def test_elements_of_files_are_given_out_together(spark):
    """no batch for each file; beginnings are told by one pattern, and elements are dealt by number."""
    from pyspark.sql import functions as F

    spans = lambda rows: {(r.path, r.seq) for r in rows}
    files = spark.createDataFrame([(f"f{i}", docx_file([("line", "", "a"), ("line", "", "b")]) if i % 5 else b"no zip") for i in range(40)], "path string, content binary").coalesce(1)
    made = docx.elements(files)
    counted = made.mapInArrow(lambda batches: (b.slice(0, 1).select(["path"]) for b in batches if b.num_rows), "path string")
    assert counted.count() == 1
    rows = made.collect()
    assert spans(rows) == {(f"f{i}", k) for i in range(40) for k in ((0, 1) if i % 5 else (0,))} and [r.kind for r in rows].count("error") == 8
    said = ["palavras-chave: a", "resumo", "resumos", "resumo_", "abstract . x", "o resumo", None]
    low = spark.createDataFrame([(i, t) for i, t in enumerate(said)], "id int, t string").orderBy("id")
    assert [r.x for r in low.select(structure._begins(F.col("t"), structure.ABSTRACT_WORDS).alias("x")).collect()] == [True, True, False, False, True, False, None]
    assert [r.x for r in low.select(structure._begins(F.col("t"), structure.ABSTRACT_WORDS, r"\s*[:.]").alias("x")).collect()] == [True, False, False, False, True, False, None]
    assert "RepartitionByExpression [path" in structure.declared(made)._jdf.queryExecution().optimizedPlan().toString()
