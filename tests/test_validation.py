"""Validation: automata against derivatives and backtracking, rules and identifiers against a plain walk, broken articles."""

import random
import re
import xml.etree.ElementTree as ET

import pytest

from quire.operators import jats, validation

from .test_jats import article


def ends(tree, names, at):
    """All places up to which a model can read names from at, by backtracking."""
    kind, *parts = tree
    if kind == "name":
        return {at} if parts[0] == "#PCDATA" else ({at + 1} if names[at : at + 1] == parts else set())
    if kind == "alt":
        return set().union(*(ends(p, names, at) for p in parts))
    if kind == "seq":
        found = {at}
        for p in parts:
            found = set().union(*(ends(p, names, i) for i in found))
        return found
    found = ends(parts[0], names, at) | ({at} if kind in "?*" else set())
    while kind in "*+":
        more = found | set().union(*(ends(parts[0], names, i) for i in found if i > at))
        if more == found:
            break
        found = more
    return found


def empty(t):
    kind, *parts = t
    if kind == "name":
        return parts[0] == "#PCDATA"
    return kind in "?*" or (any if kind == "alt" else all)(map(empty, parts))


def derived(t, name):
    """The model of what may follow once name was read, or None."""
    kind, *parts = t
    if kind == "name":
        return ("seq",) if parts[0] == name else None
    if kind == "alt":
        found = [d for d in (derived(p, name) for p in parts) if d]
        return ("alt", *found) if found else None
    if kind == "seq":
        found = []
        for i, p in enumerate(parts):
            if d := derived(p, name):
                found.append(("seq", d, *parts[i + 1 :]))
            if not empty(p):
                break
        return ("alt", *found) if found else None
    d = derived(parts[0], name)
    return d and (d if kind == "?" else ("seq", d, ("*", parts[0])))


def read_by_derivatives(model, names):
    t = validation.parse_model(model)
    for i, n in enumerate(names):
        t = derived(t, n)
        if t is None:
            return "child not allowed", i
    return None if empty(t) else ("content ends early", len(names))


MODELS = {
    "r": "((a, b?)+, (c | (d, e*))?, f)",
    "a": "(#PCDATA | x | y)*",
    "b": "((x | y)+, z?)",
    "c": "EMPTY",
    "d": "(a?, (b | c)*, d?)",
    "e": "((x, y)*, (z | (c, x)+)?)",
    "f": "ANY",
    **dict.fromkeys("xyz", "(#PCDATA)*"),
}


def plain(xml, content, rules=()):
    found, ids, pointers, n = [], {}, [], 0

    def walk(e, above):
        nonlocal n
        n += 1
        place, path = n, f"{above}/{e.tag}"
        names = [c.tag for c in e]
        if "/f/" not in path:
            model = content.get(e.tag)
            if model is None:
                found.append((path, place, "unknown element", e.tag))
            elif model != "ANY":
                wrong = read_by_derivatives(model, names) if model != "EMPTY" else (("child not allowed", 0) if names else None)
                if wrong:
                    found.append((path, place, wrong[0], f"{names[wrong[1]]} as child {wrong[1] + 1}" if wrong[0] == "child not allowed" else f"after {wrong[1]} children"))
                if "#PCDATA" not in model and ((e.text or "") + "".join(c.tail or "" for c in e)).strip():
                    found.append((path, place, "text not allowed", ""))
        if "id" in e.attrib:
            if e.get("id") in ids:
                found.append((path, place, "id repeated", e.get("id")))
            ids.setdefault(e.get("id"), place)
        pointers.extend((path, place, r) for r in dict.fromkeys(e.get("rid", "").split()))
        for c in e:
            walk(c, path)

    walk(ET.fromstring(xml), "")
    return sorted(found + [(p, k, "id not found", r) for p, k, r in pointers if r not in ids])


def grown(rng, name, depth=0):
    names = list("abcdefxyzq")
    attributes = (f' id="i{rng.randrange(6)}"' if rng.random() < 0.15 else "") + (f' rid="i{rng.randrange(8)} i{rng.randrange(8)}"' if rng.random() < 0.15 else "")
    inner = ""
    for _ in range(rng.randrange(0, 5 if depth < 4 else 1)):
        inner += grown(rng, rng.choice(names), depth + 1) + rng.choice(["", "", " ", "t&amp;"])
    return f"<{name}{attributes}>{inner}</{name}>"


def test_random_trees_equal_a_plain_walk(spark):
    rng = random.Random(4)
    docs = [(i, grown(rng, "r")) for i in range(300)]
    got = {}
    for r in validation.validate(spark.createDataFrame(docs, "doc_id long, xml string"), content=MODELS, rules=()).collect():
        got.setdefault(r.doc_id, []).append((r.path, r.place, r.rule, r.detail))
    for i, xml in docs:
        assert sorted(got.get(i, [])) == plain(xml, MODELS), xml


@pytest.mark.parametrize("model", [m for m in {*MODELS.values(), *validation.CONTENT.values()} if m not in ("ANY", "EMPTY")])
def test_automata_accept_what_backtracking_accepts(model):
    tree, made = validation.parse_model(model), validation.automaton(model)
    alphabet = sorted({k.split()[1] for k in made.moves}) + ["other"]
    rng = random.Random(model)
    for _ in range(200):
        names, state, options = [], 0, []
        for _ in range(rng.randrange(0, 7)):  # mostly along the automaton, so that long sequences are accepted as well
            options = [k.split()[1] for k in made.moves if k.startswith(f"{state} ")]
            names.append(rng.choice(options) if options and rng.random() < 0.9 else rng.choice(alphabet))
            state = made.moves.get(f"{state} {names[-1]}", -1)
        state = 0
        for n in names:
            state = made.moves.get(f"{state} {n}", -1) if state >= 0 else state
        assert (state in made.final) == (len(names) in ends(tree, names, 0))


def test_models_must_be_models():
    for bad in ("(a?, a)", "((a, b) | (a, c))", "(a, b | c)"):
        with pytest.raises(ValueError):
            validation.automaton(bad)


#: What is replaced in a valid article, by what, and the findings (rule, detail) that follow.
BROKEN = (
    ("<title-group>", "<title-group><subject>x</subject>", {("child not allowed", "subject as child 1")}),
    (r"<publisher>.*?</publisher>", "", {("journal has a publisher", "")}),
    (r"<permissions>.*?</permissions>", "", {("article has permissions", "")}),
    (r"<contrib-group>.*?</contrib-group>", "", {("article has contributors", "")}),
    (r"<abstract>.*?</abstract>", "<abstract><title>R</title></abstract>", {("abstract has text", "")}),
    (r"<counts>", "stray<counts>", {("text not allowed", "")}),
    (r'<fig-count count="1"/>', "<fig-count/>", {("attribute missing", "count")}),
    (r'<page-count count="16"/>', '<page-count count="0"/>', {("no page count of zero", "")}),
    (r'publication-format="electronic"', 'publication-format="web"', {("attribute value", "publication-format=web")}),
    (r"10\.1590/", "doi:10.1590/", {("doi is well formed", "")}),
    (r"0000-0002-1825-0097", "0000-0002-1825-97", {("orcid is well formed", "")}),
    (r"2179-8966</issn>", "21798966</issn>", {("issn is well formed", "")}),
    (r'rid="aff1"', 'rid="aff9"', {("id not found", "aff9")}),
    (r' id="aff2"', ' id="aff1"', {("id repeated", "aff1"), ("id not found", "aff2")}),
    (r"<graphic [^>]*/>", "", {("figure has a graphic", ""), ("equation is no text only", "")}),
    (r"<front>", "<front><p>x</p>", {("child not allowed", "p as child 1")}),
    (r"<surname>Silva</surname>", "<nick>Silva</nick>", {("unknown element", "nick"), ("child not allowed", "nick as child 1")}),
    (r"<element-citation.*?</element-citation>", "", {("reference has its elements", "")}),
    (r' xml:lang="pt">', ">", {("article has a language", ""), ("keywords have a language", "")}),
    (r"<title>1 Introdução</title>", "", {("section has a title", "")}),
    (r"creativecommons\.org/licenses/by/", "example.org/", {("licence is open", "")}),
    (r"</journal-meta>", "", "not well-formed"),
)


def test_broken_articles(spark):
    sound = jats.build(article(spark)).first().xml
    docs = [(0, sound)] + [(i + 1, re.sub(a, b, sound, flags=re.S)) for i, (a, b, _) in enumerate(BROKEN)] + [(90, None), (91, "")]
    assert all(x != sound for i, x in docs if i)
    df = spark.createDataFrame(docs, "doc_id long, xml string")
    got = {}
    for r in validation.validate(df).collect():
        got.setdefault(r.doc_id, set()).add((r.rule, r.detail))
    base = got.get(0, set())
    for i, (_, _, want) in enumerate(BROKEN):
        if want == "not well-formed":
            assert {r for r, _ in got[i + 1]} == {want}
        else:
            assert want <= got[i + 1] - base, (BROKEN[i], got[i + 1] - base)
            assert len(got[i + 1] - base - want) <= 1, (BROKEN[i], got[i + 1] - base - want)
    assert {r for r, _ in got[90]} == {"no document"} and {r for r, _ in got[91]} == {"not well-formed"}
    verdicts = {r.doc_id: r for r in validation.verdicts(df).collect()}
    assert len(verdicts) == len(docs) and not verdicts[1].dtd_valid and verdicts[2].dtd_valid and not verdicts[2].style_valid
    assert validation.validate(df.where("false")).count() == 0
