"""Validation of article XML: content models, attributes and identifiers as a DTD has them, and rules on contexts.

nodes() makes one row of all elements of a batch that no model and no rule tells apart, with the places where they stand; the
rules are evaluated once for these, and only what they find is spread over the places. Documents whose markup is the same
are parsed once for each task: their texts are cut out first. A content model is compiled to an automaton whose states are the places of names in
it (DTD models are deterministic, so the next name decides); a node's children are run through its element's automaton by a
fold in the JVM. RULES are assertions on elements chosen by path expressions, compiled to one projection. Models and rules
are fixed lists that don't grow with the data. Identifiers are matched where a document is parsed.

Findings are rows (doc_id, path, place, rule, detail). A document that isn't well-formed has one finding with line and
column and no others; a null document has the finding "no document"; comments, instructions and the doctype are no content.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import accumulate, chain
from typing import NamedTuple
from xml.parsers import expat

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows, and places in them, that are made at a time.
NODE_ROWS, PLACES = 5000, 50_000
#: Shapes of documents that a task remembers.
SHAPES = 1000
_BLANK = " \t\n\v\f\r"
# a text between tags that any other one could stand for: it doesn't begin with a blank, and has nothing but characters and
# the five entities; and the value of an id
_PLAIN, _NAMED = r"<>&\]\r\x00-\x08\x0b\x0c\x0e-\x1f\ufffe\uffff", "&(?:amp|lt|gt|quot|apos);"
_SLOT = re.compile(rf"(>(?:[^ \t\n{_PLAIN}]|{_NAMED})[^{_PLAIN}]*+(?:{_NAMED}[^{_PLAIN}]*+)*+(?=<)| id=\"[A-Za-z0-9_.:-]++(?=\"))")
_MARK = re.compile("\ue000([0-9]+)\ue001")
# markup that may hold > or < as text
_OTHER = re.compile(r"<!\[|<!-|<\?(?!xml\s)|<!DOCTYPE[^>]*\[")

# The content of the elements that articles are made of, in the notation of a DTD; a subset of the public
# journal publishing tag set. TEXT stands for mixed content, ANY is not looked into.
_INLINE = "(#PCDATA | xref | sup | sub | italic | bold | ext-link | email | named-content)*"
_TEXT = "(#PCDATA)*"
CONTENT = {
    "article": "(front, body?, back?, (sub-article* | response*))",
    "front": "(journal-meta?, article-meta)",
    "journal-meta": "(journal-id+, journal-title-group*, issn+, isbn*, publisher?)",
    "journal-title-group": "(journal-title*, journal-subtitle*, trans-title-group*, abbrev-journal-title*)",
    "publisher": "(publisher-name, publisher-loc?)",
    "article-meta": "(article-id*, article-categories?, title-group, (contrib-group | aff)*, author-notes?, pub-date*, volume?, issue*, isbn*, supplement?, ((fpage, lpage?, page-range?) | elocation-id)?, history?, permissions?, self-uri*, related-article*, abstract*, trans-abstract*, kwd-group*, funding-group*, counts?, custom-meta-group?)",
    "article-categories": "(subj-group*)",
    "subj-group": "(subject+, subj-group*)",
    "title-group": "(article-title, subtitle*, trans-title-group*)",
    "trans-title-group": "(trans-title, trans-subtitle*)",
    "contrib-group": "(contrib+, (aff | fn | role | xref)*)",
    "contrib": "(contrib-id*, (anonymous | collab | name)*, degrees*, (bio | email | ext-link | role | xref | aff)*)",
    "name": "((surname, given-names?) | given-names)",
    "bio": "(sec-meta?, title?, (p | sec)+)",
    "aff": "(#PCDATA | label | institution | addr-line | country | email | city | state)*",
    "addr-line": "(#PCDATA | city | state | named-content)*",
    "author-notes": "(label?, title?, (corresp | fn | p)+)",
    "corresp": "(#PCDATA | label | email | sup | xref)*",
    "fn": "(label?, p+)",
    "fn-group": "(label?, title?, fn+)",
    "pub-date": "(((day, month?) | month | season)?, year)",
    "date": "(day?, month?, year)",
    "history": "(date+)",
    "permissions": "(copyright-statement*, copyright-year*, copyright-holder*, license*)",
    "license": "(license-p+)",
    "abstract": "(label?, title?, p*, sec*)",
    "trans-abstract": "(label?, title?, p*, sec*)",
    "kwd-group": "(label?, title?, kwd+)",
    "funding-group": "(award-group*, funding-statement*)",
    "award-group": "(funding-source*, award-id*)",
    "counts": "(count*, fig-count?, table-count?, equation-count?, ref-count?, page-count?, word-count?)",
    "body": "((p | fig | table-wrap | disp-formula | boxed-text | speech | disp-quote | list)*, sec*)",
    "sec": "(label?, title?, (p | fig | table-wrap | disp-formula | boxed-text | speech | disp-quote | list)*, (fn-group | ref-list)*, sec*)",
    "fig": "(label?, caption?, (p | attrib | graphic | disp-formula)*)",
    "caption": "(title?, p*)",
    "table-wrap": "(label?, caption?, (table | graphic | alternatives)*, table-wrap-foot*)",
    "table-wrap-foot": "(attrib | fn | p)+",
    "table": "(col*, thead?, tfoot?, (tbody+ | tr+))",
    "thead": "(tr+)",
    "tbody": "(tr+)",
    "tr": "(th | td)+",
    "disp-formula": "(#PCDATA | label | mml:math | graphic)*",
    "boxed-text": "(label?, caption?, (p | sec | list)*)",
    "speech": "(speaker, p+)",
    "back": "(label?, title*, (ack | app-group | bio | fn-group | glossary | ref-list | notes | sec)*)",
    "ack": "(label?, title?, p*, sec*)",
    "ref-list": "(label?, title?, p*, ref*, ref-list*)",
    "ref": "(label?, (element-citation | mixed-citation | note)+)",
    "person-group": "(name | collab | etal | anonymous)*",
    "element-citation": "(person-group | article-title | chapter-title | source | year | volume | issue | fpage | lpage | elocation-id | publisher-name | publisher-loc | edition | comment | ext-link | date-in-citation | pub-id | collab | name)*",
    "mml:math": "ANY",
    "graphic": "EMPTY", "fig-count": "EMPTY", "table-count": "EMPTY", "equation-count": "EMPTY", "ref-count": "EMPTY", "page-count": "EMPTY",
} | dict.fromkeys("article-title trans-title subject kwd p title td th institution speaker attrib collab comment license-p funding-statement mixed-citation source chapter-title".split(), _INLINE) | dict.fromkeys(
    "journal-id journal-title abbrev-journal-title issn publisher-name publisher-loc article-id contrib-id surname given-names role sup sub city state country label email day month year volume issue elocation-id fpage lpage copyright-year funding-source award-id edition date-in-citation pub-id".split(), _TEXT
) | {"xref": "(#PCDATA | sup)*", "ext-link": _TEXT, "italic": _TEXT, "bold": _TEXT, "named-content": _TEXT}
# Attributes that an element must have, and the values that some may take.
REQUIRED = {"contrib-id": ("contrib-id-type",), "journal-id": ("journal-id-type",), "graphic": ("xlink:href",), "xref": ("ref-type", "rid"), "fig-count": ("count",), "table-count": ("count",), "equation-count": ("count",), "ref-count": ("count",), "page-count": ("count",)}
VALUES = {
    ("article", "dtd-version"): ("1.0", "1.1", "1.2", "1.3"),
    ("pub-date", "publication-format"): ("electronic", "print"),
    ("person-group", "person-group-type"): ("author", "compiler", "editor", "translator", "inventor", "director"),
    ("issn", "pub-type"): ("epub", "ppub"),
}


class Rule(NamedTuple):
    """An assertion on the elements that context chooses. context: steps with / (child) or // (below), and predicates [x],
    [not(x)], [@a], [@a='v'] on its last step. test: one of TESTS with its argument."""

    name: str
    context: str
    test: str
    argument: str


RULES = (
    Rule("article has a language", "/article", "attribute", "xml:lang"),
    Rule("article has a type", "/article", "attribute", "article-type"),
    Rule("journal has an acronym", "/article/front/journal-meta", "child", "journal-id"),
    Rule("journal has a publisher", "/article/front/journal-meta", "child", "publisher"),
    Rule("issn is well formed", "journal-meta/issn", "text", r"[0-9]{4}-[0-9]{3}[0-9X]"),
    Rule("article has a doi", "/article/front/article-meta", "child", "article-id"),
    Rule("doi is well formed", "article-meta/article-id[@pub-id-type='doi']", "text", r"10\.[0-9]{4,9}/\S+"),
    Rule("article has a heading", "/article/front/article-meta", "child", "article-categories"),
    Rule("article has contributors", "/article/front/article-meta", "child", "contrib-group"),
    Rule("article has permissions", "/article/front/article-meta", "child", "permissions"),
    Rule("article has a date", "/article/front/article-meta", "child", "pub-date"),
    Rule("author has a name", "contrib-group/contrib[@contrib-type='author']", "child", "name|collab|anonymous"),
    Rule("author has an affiliation", "contrib-group/contrib[@contrib-type='author'][name]", "child", "xref|aff"),
    Rule("orcid is well formed", "contrib//contrib-id[@contrib-id-type='orcid']", "text", r"[0-9]{4}-[0-9]{4}-[0-9]{4}-[0-9]{3}[0-9X]"),
    Rule("affiliation has an id", "contrib-group/aff", "attribute", "id"),
    Rule("affiliation has a country", "contrib-group/aff", "child", "country"),
    Rule("abstract has text", "article-meta/abstract", "child", "p|sec"),
    Rule("keywords have a language", "article-meta/kwd-group", "attribute", "xml:lang"),
    Rule("licence has a link", "permissions/license", "attribute", "xlink:href"),
    Rule("licence is open", "permissions/license[@xlink:href]", "attribute value", r"xlink:href=https?://creativecommons\.org/licenses/.+"),
    Rule("section has a title", "body//sec", "child", "title"),
    Rule("figure has an id", "body//fig", "attribute", "id"),
    Rule("figure has a graphic", "body//fig", "child", "graphic"),
    Rule("table has an id", "body//table-wrap", "attribute", "id"),
    Rule("equation is no text only", "body//disp-formula[not(graphic)]", "child", "mml:math"),
    Rule("reference has an id", "ref-list/ref", "attribute", "id"),
    Rule("reference has its text", "ref-list/ref", "child", "mixed-citation"),
    Rule("reference has its elements", "ref-list/ref", "child", "element-citation"),
    Rule("citation has a type", "ref/element-citation", "attribute", "publication-type"),
    Rule("no page count of zero", "counts/page-count", "attribute value", "count=[1-9][0-9]*"),
)
TESTS = ("child", "attribute", "attribute value", "text")


def parse_model(model: str) -> tuple:
    """A DTD content model as a tree of ("name", n), ("seq", ..), ("alt", ..), ("?", x), ("*", x) and ("+", x)."""
    tokens = re.findall(r"[#\w:.-]+|[(),|?*+]", model)
    at = 0

    def item() -> tuple:
        nonlocal at
        if tokens[at] == "(":
            at += 1
            parts, joint = [item()], None
            while tokens[at] != ")":
                if joint not in (None, tokens[at]):
                    raise ValueError(f"both , and | in {model}")
                joint = tokens[at]
                at += 1
                parts.append(item())
            made = parts[0] if joint is None else ("seq" if joint == "," else "alt", *parts)
        else:
            made = ("name", tokens[at])
        at += 1
        if at < len(tokens) and tokens[at] in "?*+":
            made = (tokens[at], made)
            at += 1
        return made

    tree = item()
    if at != len(tokens):
        raise ValueError(f"not a content model: {model}")
    return tree


class Automaton(NamedTuple):
    """moves["state name"] is the next state; state 0 is the start. mixed: text may stand between the children."""

    moves: dict[str, int]
    final: list[int]
    mixed: bool


def automaton(model: str) -> Automaton:
    """The automaton over the places of names in a content model. An ambiguous model is an error."""
    if model == "EMPTY":
        return Automaton({}, [0], False)
    names = [""]
    follow: dict[int, set[int]] = {}

    def walk(node: tuple) -> tuple[bool, set[int], set[int]]:
        """Whether node may be empty, and its first and last places."""
        kind, *parts = node
        if kind == "name":
            if parts[0] == "#PCDATA":
                return True, set(), set()
            names.append(parts[0])
            return False, {len(names) - 1}, {len(names) - 1}
        done = [walk(p) for p in parts]
        if kind in "?*+":
            empty, first, last = done[0]
            if kind != "?":
                for x in last:
                    follow.setdefault(x, set()).update(first)
            return empty or kind != "+", first, last
        if kind == "alt":
            return any(d[0] for d in done), set().union(*(d[1] for d in done)), set().union(*(d[2] for d in done))
        empty, first, last = True, set(), set()
        for e, f, la in done:
            for x in last:
                follow.setdefault(x, set()).update(f)
            first = first | f if empty else first
            last = last | la if e else la
            empty = empty and e
        return empty, first, last

    empty, first, last = walk(parse_model(model))
    moves: dict[str, int] = {}
    for state, places in [(0, first), *follow.items()]:
        for place in sorted(places):
            if moves.setdefault(f"{state} {names[place]}", place) != place:
                raise ValueError(f"ambiguous at {names[place]}: {model}")
    return Automaton(moves, sorted(last | ({0} if empty else set())), "#PCDATA" in model)


class _Shape(NamedTuple):
    """What documents of the same markup have in common: their elements with their places, and those that hold marks of the
    document's texts; and their identifiers (see _identifiers), which may be marks."""

    same: list[tuple[tuple, int]]
    told: list[tuple[tuple, int]]
    ids: list[tuple[int, str, str | None, str | None]]


def _decoded(text: str) -> str:
    for name, sign in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&")):
        text = text.replace(name, sign)
    return text


def _identifiers(found: list[tuple[int, str, str | None, str | None]]) -> list[tuple[tuple, int]]:
    """Rows for ids that stand at an earlier element of the document too, and for references to none. found: place, path, id
    and rid of elements that have one of them."""
    out, first = [], {}
    for place, path, own, _ in sorted(found, key=lambda r: r[0]):
        if own is not None and first.setdefault(own, place) < place:
            out.append(((path, None, (), (), None, own, "id repeated"), place))
    for place, path, _, to in found:
        for x in dict.fromkeys(re.split(r"[ \t\n\v\f\r]+", to)) if to else ():
            if x and x not in first:
                out.append(((path, None, (), (), None, x, "id not found"), place))
    return out


def nodes(docs: DataFrame, id_col: str = "doc_id", xml_col: str = "xml", told: frozenset[str] | None = None, ids: bool = True) -> DataFrame:
    """path, name, attributes, children (names), text (its own), error, rule and at: doc_id and place (1-based, in document
    order) of each element that is like this. Elements that are alike may be several rows. Of elements whose names aren't in
    told (null: all are) the text is only x, or nothing if it is blank. A rule is that of an identifier, which is the error. Without ids the
    value of an id that isn't blank is x."""
    key_type = docs.schema[id_col].dataType
    at_type = T.ArrayType(T.StructType([T.StructField("doc_id", key_type), T.StructField("place", T.IntegerType())]))
    fields = [T.StructField(n, k) for n, k in (("path", T.StringType()), ("name", T.StringType()), ("attributes", T.MapType(T.StringType(), T.StringType())), ("children", T.ArrayType(T.StringType())), ("text", T.StringType()), ("error", T.StringType()), ("rule", T.StringType()), ("at", at_type))]
    kinds = [pa.string(), pa.string(), pa.map_(pa.string(), pa.string()), pa.list_(pa.string()), pa.string(), pa.string(), pa.string()]
    names = [f.name for f in fields]

    def elements(xml: str) -> tuple[list[tuple[tuple, int]], list[tuple[int, str, str | None, str | None]]]:
        """path, name, attributes (names and values in turn), children, text, error and rule of each element, and its place;
        and the identifiers."""
        parser, stack, out, named = expat.ParserCreate(), [("", "", 0, (), [], [])], [], []
        n = 0

        def start(name: str, attributes: list[str]) -> None:
            nonlocal n
            n += 1
            above = stack[-1]
            above[4].append(name)
            path = f"{above[0]}/{name}"
            at = dict(zip(attributes[::2], attributes[1::2], strict=True))
            if "id" in at or "rid" in at:
                named.append((n, path, at.get("id"), at.get("rid")))
            if not ids and at.get("id", "").strip(" "):
                attributes[2 * attributes[::2].index("id") + 1] = "x"
            stack.append((path, name, n, tuple(attributes), [], []))

        def end(_: str) -> None:
            path, name, place, attributes, children, parts = stack.pop()
            text = "".join(parts)
            if told is not None and name not in told:
                text = "x" if text.strip(_BLANK) else ""
            out.append(((path, name, attributes, tuple(children), text, None, None), place))

        parser.StartElementHandler, parser.EndElementHandler = start, end
        parser.CharacterDataHandler = lambda x: stack[-1][5].append(x)
        parser.ordered_attributes = parser.buffer_text = True
        # the text is already decoded, so what its first line says of an encoding doesn't count
        parser.Parse(re.sub(r"\A\s*<\?xml[^>]*\?>", lambda m: "\n" * m[0].count("\n"), xml), True)
        return out, named

    def whole(xml: str | None) -> list[tuple[tuple, int]]:
        if xml is None:
            return [(("", None, (), (), None, "no document", None), 0)]
        try:
            found, named = elements(xml)
        except expat.ExpatError as e:
            return [(("", None, (), (), None, f"{e.lineno}:{e.offset}: {expat.errors.messages[e.code]}", None), 0)]
        return found + _identifiers(named)

    def shape(markup: list[str]) -> _Shape | None:
        """None if a document of this markup must be parsed itself, as for the place of an error."""
        marks = [f"{' id="' if m[:1] == '"' else '>'}\ue000{i}\ue001{m}" for i, m in enumerate(markup[1:])]
        try:
            found, named = elements("".join([markup[0], *marks]))
        except expat.ExpatError:
            return None
        marked = ["\ue000" in (e[4] or "") or any("\ue000" in a for a in e[2]) for e, _ in found]
        return _Shape([x for x, m in zip(found, marked, strict=True) if not m], [x for x, m in zip(found, marked, strict=True) if m], named)

    def filled(kept: _Shape, texts: list[str]) -> list[tuple[tuple, int]]:
        """The elements of a document that hold its texts, and what is found of its identifiers."""

        def fill(x: str | None) -> str | None:
            return _MARK.sub(lambda m: _decoded(t[1:] if (t := texts[int(m[1])])[0] == ">" else t[5:]), x) if x and "\ue000" in x else x

        own = [((path, name, tuple(map(fill, a)), children, fill(text), error, rule), place) for (path, name, a, children, text, error, rule), place in kept.told]
        return own + _identifiers([(place, path, fill(i), fill(to)) for place, path, i, to in kept.ids]) if kept.ids else own

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shapes: dict[str, _Shape | None] = {}
        for batch in batches:
            kind = batch.schema.types[0]
            found: dict[tuple, list[tuple[list, list[int]]]] = {}
            alike: dict[int, tuple[_Shape, list]] = {}
            n = 0

            def made() -> pa.RecordBatch:
                for kept, ids in alike.values():
                    for element, place in kept.same:
                        found.setdefault(element, []).append((ids, [place] * len(ids)))
                rows = [(path, name, list(zip(a[::2], a[1::2], strict=True)), children, text, error, rule) for path, name, a, children, text, error, rule in found]
                ends = pa.array([0, *accumulate(sum(len(ids) for ids, _ in spots) for spots in found.values())], pa.int32())
                keys, places = (list(chain.from_iterable(x[i] for spots in found.values() for x in spots)) for i in (0, 1))
                at = pa.ListArray.from_arrays(ends, pa.StructArray.from_arrays([pa.array(keys, kind), pa.array(places, pa.int32())], ["doc_id", "place"]))
                return pa.RecordBatch.from_arrays([*[pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], at], names)

            for doc_id, xml in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                xml, kept = xml.as_py(), None
                if xml is not None and "\0" not in xml and "\ue000" not in xml and not _OTHER.search(xml):
                    parts = _SLOT.split(xml)
                    key = "\0".join(parts[::2])
                    if key not in shapes:
                        if len(shapes) == SHAPES:
                            shapes.clear()
                        shapes[key] = shape(parts[::2])
                    kept = shapes[key]
                if kept is None:
                    mine = whole(xml)
                else:
                    alike.setdefault(id(kept), (kept, []))[1].append(doc_id)
                    n += len(kept.same)
                    mine = filled(kept, parts[1::2])
                for element, place in mine:
                    found.setdefault(element, []).append(([doc_id], [place]))
                n += len(mine)
                if len(found) >= NODE_ROWS or n >= PLACES:
                    yield made()
                    found, alike, n = {}, {}, 0
            yield made()

    return docs.select(id_col, xml_col).mapInArrow(run, T.StructType(fields))


def _models(content: dict[str, str]) -> Column:
    """array<struct(name, moves, final, mixed, any)> of the content models."""
    made = []
    for name, model in content.items():
        a = Automaton({}, [0], True) if model == "ANY" else automaton(model)
        pairs = [F.lit(x) for k, v in a.moves.items() for x in (k, v)]
        moves = F.create_map(*pairs) if pairs else F.expr("cast(map() as map<string,int>)")
        made.append(F.struct(F.lit(name).alias("model"), moves.alias("moves"), F.array(*[F.lit(x) for x in a.final]).alias("final"), F.lit(a.mixed).alias("mixed"), F.lit(model == "ANY").alias("any")))
    return F.array(*made)


def _context(context: str) -> Column:
    """Whether a node is one that a path expression chooses."""
    steps, predicates = re.fullmatch(r"([^\[]*)((?:\[[^\]]*\])*)", context).groups()
    last = re.split("/", steps)[-1]
    pattern = "/(?:[^/]+/)*".join("/".join(re.escape(x) for x in part.split("/")) for part in steps.split("//"))
    found = (F.col("name") == last) & F.col("path").rlike(rf"^{pattern}$" if context.startswith("/") else rf"/{pattern}$")
    for p in re.findall(r"\[([^\]]*)\]", predicates):
        if m := re.fullmatch(r"@([\w:-]+)(?:='([^']*)')?", p):
            value = F.col("attributes")[m[1]]
            found &= value.isNotNull() if m[2] is None else F.coalesce(value == m[2], F.lit(False))
        elif m := re.fullmatch(r"not\(([\w:-]+)\)", p):
            found &= ~F.array_contains("children", m[1])
        else:
            found &= F.array_contains("children", p)
    return found


def _holds(rule: Rule) -> Column:
    if rule.test == "child":
        return F.arrays_overlap("children", F.array(*[F.lit(x) for x in rule.argument.split("|")]))
    if rule.test == "attribute":
        return F.trim(F.coalesce(F.col("attributes")[rule.argument], F.lit(""))) != ""
    if rule.test == "text":
        return F.trim("text").rlike(rf"^(?:{rule.argument})$")
    if rule.test == "attribute value":
        name, _, pattern = rule.argument.partition("=")
        return F.coalesce(F.col("attributes")[name].rlike(rf"^(?:{pattern})$"), F.lit(False))
    raise ValueError(f"no test {rule.test}")


def _finding(rule: str, detail: Column) -> Column:
    return F.struct(F.lit(rule).alias("rule"), detail.alias("detail"))


def _of_content(hidden: list[str]) -> list[Column]:
    """Findings of children, text and unknown elements; what stands below a hidden element is left alone."""
    start = F.struct(F.lit(0).alias("state"), F.lit(0).alias("read"))

    def step(acc: Column, child: Column) -> Column:
        after = F.coalesce(F.col("moves")[F.concat(acc["state"].cast("string"), F.lit(" "), child)], F.lit(-1))
        return F.when(acc["state"] < 0, acc).otherwise(F.struct(after.alias("state"), (acc["read"] + F.when(after < 0, 0).otherwise(1)).alias("read")))

    seen = ~F.col("path").rlike("/(?:" + "|".join(map(re.escape, hidden)) + ")/") if hidden else F.lit(True)
    known = seen & F.col("model").isNotNull() & ~F.col("any")

    def verdict(end: Column) -> Column:
        state, read = end["state"], end["read"]
        refused = F.concat_ws(" ", F.get("children", read), F.lit("as child"), (read + 1).cast("string"))
        early = F.concat(F.lit("after "), read.cast("string"), F.lit(" children"))
        return F.when(state < 0, _finding("child not allowed", refused)).when(~F.array_contains("final", state), _finding("content ends early", early))

    ran = F.transform(F.array(F.aggregate("children", start, step)), verdict)[0]
    blank = F.trim(F.regexp_replace("text", r"\s+", " ")) == ""
    return [F.when(seen & F.col("model").isNull(), _finding("unknown element", F.col("name"))), F.when(known, ran), F.when(known & ~F.col("mixed") & ~blank, _finding("text not allowed", F.lit("")))]


def _of_attributes(rules: tuple[Rule, ...]) -> list[Column]:
    """Findings of attributes and rules."""
    attribute = lambda n: F.col("attributes")[n]
    wrong = [F.when((F.col("name") == element) & attribute(n).isNull(), _finding("attribute missing", F.lit(n))) for element, names in REQUIRED.items() for n in names]
    wrong += [F.when((F.col("name") == element) & attribute(n).isNotNull() & ~attribute(n).isin(*values), _finding("attribute value", F.concat(F.lit(f"{n}="), attribute(n)))) for (element, n), values in VALUES.items()]
    return wrong + [F.when(_context(r.context) & ~_holds(r), _finding(r.name, F.lit(""))) for r in rules]


def validate(docs: DataFrame, id_col: str = "doc_id", xml_col: str = "xml", content: dict[str, str] | None = None, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id, path, place, rule and detail of each finding. Documents are parsed once, and nothing is shuffled."""
    content = CONTENT if content is None else content
    told = frozenset(re.split("/", re.sub(r"\[.*", "", r.context))[-1] for r in rules if r.test == "text")
    ids = any("@id=" in r.context or r.test == "attribute value" and r.argument.startswith("id=") for r in rules) or any(a == "id" for _, a in VALUES)
    parsed = nodes(docs, id_col, xml_col, told, ids)
    models = parsed.sparkSession.range(1).select(F.inline(_models(content)))  # as many rows as there are models
    run = parsed.join(F.broadcast(models), F.col("name") == F.col("model"), "left")
    broken = F.when(F.col("error") == "no document", _finding("no document", F.lit(""))).otherwise(_finding("not well-formed", F.col("error")))
    found = F.array_compact(F.array(*_of_content([n for n, m in content.items() if m == "ANY"]), *_of_attributes(rules)))
    given = F.when(F.col("rule").isNotNull(), F.array(F.struct("rule", F.col("error").alias("detail")))).when(F.col("error").isNotNull(), F.array(broken))
    facts = run.select("path", "at", F.inline(given.otherwise(found)))
    return facts.select("path", "rule", "detail", F.inline("at")).select("doc_id", "path", "place", "rule", "detail")


def verdicts(docs: DataFrame, id_col: str = "doc_id", xml_col: str = "xml", **options) -> DataFrame:
    """doc_id, dtd_valid, style_valid and n_findings of every document; ids must be unique."""
    style = [r.name for r in options.get("rules", RULES)]
    found = validate(docs, id_col, xml_col, **options).groupBy(F.col("doc_id").alias("_id")).agg(F.count_if(~F.col("rule").isin(style)).alias("dtd"), F.count_if(F.col("rule").isin(style)).alias("style"))
    out = docs.select(F.col(id_col).alias("doc_id")).join(found, F.col("doc_id").eqNullSafe(F.col("_id")), "left")
    n = lambda c: F.coalesce(c, F.lit(0))
    return out.select("doc_id", (n("dtd") == 0).alias("dtd_valid"), (n("style") == 0).alias("style_valid"), (n("dtd") + n("style")).alias("n_findings"))
