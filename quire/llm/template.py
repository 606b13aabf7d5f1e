"""A sandboxed template language, compiled: source -> tokens -> syntax tree -> folded tree -> Python closures.

Statements: {{ expression }}, {% if %}/{% elif %}/{% else %}/{% endif %}, {% for x in xs %}/{% endfor %},
{% set x = expression %}, {% generation %}/{% endgeneration %} and {# comment #}. A dash inside a mark ({%- -%}) strips
the white space beside it. Expressions: strings, integers, true, false, none, names, member and item access on maps
and lists, ~ + - == != < <= > >=, and, or, not, in, `a if b else c`, and filters of a fixed table. There are no calls, no
attributes of Python objects and no names but those given; so a template can neither reach the process nor loop without
end. Rendering returns the text and the code-point spans of its generation blocks.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from typing import Any, NamedTuple

_MARK = re.compile(r"\{\{-?|\{%-?|\{#-?")
_TOKEN = re.compile(r"""\s*(?:(?P<number>\d+)|(?P<string>"(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*')|(?P<name>[A-Za-z_]\w*)|(?P<op>==|!=|<=|>=|[-<>~+.|()\[\],=]))""")
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r"}


class TemplateError(ValueError):
    pass


class Const(NamedTuple):
    value: Any


class Name(NamedTuple):
    name: str


class Get(NamedTuple):
    of: Any
    key: Any


class Op(NamedTuple):
    op: str
    args: tuple


class Filter(NamedTuple):
    name: str
    of: Any


class Emit(NamedTuple):
    what: Any


class If(NamedTuple):
    test: Any
    yes: tuple
    no: tuple


class For(NamedTuple):
    name: str
    over: Any
    body: tuple


class Set(NamedTuple):
    name: str
    value: Any


class Generation(NamedTuple):
    body: tuple


def _text(x: Any) -> str:
    return x if isinstance(x, str) else "" if x is None else "true" if x is True else "false" if x is False else str(x)


def _get(of: Any, key: Any) -> Any:
    if isinstance(of, dict):
        return of.get(key)
    if isinstance(of, (list, str)) and isinstance(key, int) and -len(of) <= key < len(of):
        return of[key]
    return None


def _less(a: Any, b: Any) -> bool:
    return a < b if type(a) is type(b) and isinstance(a, (int, str)) else False


_BINARY: dict[str, Callable] = {
    "~": lambda a, b: _text(a) + _text(b),
    "+": lambda a, b: a + b if isinstance(a, int) and isinstance(b, int) else _text(a) + _text(b),
    "-": lambda a, b: a - b if isinstance(a, int) and isinstance(b, int) else 0,
    "==": lambda a, b: a == b,
    "!=": lambda a, b: a != b,
    "<": _less,
    ">": lambda a, b: _less(b, a),
    "<=": lambda a, b: a == b or _less(a, b),
    ">=": lambda a, b: a == b or _less(b, a),
    "in": lambda a, b: a in b if isinstance(b, (list, dict)) or isinstance(a, str) and isinstance(b, str) else False,
    "not": lambda a: not a,
}
FILTERS: dict[str, Callable] = {
    "trim": lambda x: _text(x).strip(),
    "upper": lambda x: _text(x).upper(),
    "lower": lambda x: _text(x).lower(),
    "length": lambda x: len(x) if isinstance(x, (str, list, dict)) else 0,
    "first": lambda x: x[0] if x else None,
    "last": lambda x: x[-1] if x else None,
}


class _Expression:
    def __init__(self, source: str, filters: dict[str, Callable]):
        self.filters, self.tokens, at = filters, [], 0
        source = source.rstrip()
        while at < len(source):
            m = _TOKEN.match(source, at)
            if not m:
                raise TemplateError(f"unexpected {source[at:at + 10]!r}")
            self.tokens.append((m.lastgroup, m[m.lastgroup]))
            at = m.end()
        self.at = 0

    def peek(self, *values: str) -> bool:
        return self.at < len(self.tokens) and self.tokens[self.at][0] != "string" and self.tokens[self.at][1] in values

    def take(self, *values: str) -> str | None:
        if self.peek(*values):
            self.at += 1
            return self.tokens[self.at - 1][1]
        return None

    def need(self, value: str) -> None:
        if not self.take(value):
            raise TemplateError(f"{value!r} expected")

    def name(self) -> str:
        kind, value = self.tokens[self.at] if self.at < len(self.tokens) else ("", "")
        if kind != "name":
            raise TemplateError("name expected")
        self.at += 1
        return value

    def whole(self) -> Any:
        out = self.choice()
        if self.at < len(self.tokens):
            raise TemplateError(f"unexpected {self.tokens[self.at][1]!r}")
        return out

    def choice(self) -> Any:
        out = self.either()
        if self.take("if"):
            test = self.either()
            self.need("else")
            return Op("if", (test, out, self.choice()))
        return out

    def either(self) -> Any:
        out = self.both()
        while self.take("or"):
            out = Op("or", (out, self.both()))
        return out

    def both(self) -> Any:
        out = self.negated()
        while self.take("and"):
            out = Op("and", (out, self.negated()))
        return out

    def negated(self) -> Any:
        return Op("not", (self.negated(),)) if self.take("not") else self.compared()

    def compared(self) -> Any:
        out = self.joined()
        while op := self.take("==", "!=", "<", "<=", ">", ">=", "in"):
            out = Op(op, (out, self.joined()))
        return out

    def joined(self) -> Any:
        out = self.filtered()
        while op := self.take("~", "+", "-"):
            out = Op(op, (out, self.filtered()))
        return out

    def filtered(self) -> Any:
        out = self.accessed()
        while self.take("|"):
            name = self.name()
            if name not in self.filters:
                raise TemplateError(f"no filter {name}")
            out = Filter(name, out)
        return out

    def accessed(self) -> Any:
        out = self.atom()
        while op := self.take(".", "["):
            if op == ".":
                out = Get(out, Const(self.name()))
            else:
                out = Get(out, self.choice())
                self.need("]")
        return out

    def atom(self) -> Any:
        if self.take("("):
            out = self.choice()
            self.need(")")
            return out
        if self.at >= len(self.tokens):
            raise TemplateError("expression ends early")
        kind, value = self.tokens[self.at]
        self.at += 1
        if kind == "number":
            return Const(int(value))
        if kind == "string":
            return Const(re.sub(r"\\(.)", lambda m: _ESCAPES.get(m[1], m[1]), value[1:-1], flags=re.S))
        if kind == "name":
            return Const({"true": True, "false": False, "none": None}[value]) if value in ("true", "false", "none") else Name(value)
        raise TemplateError(f"unexpected {value!r}")


def _pieces(source: str) -> list[tuple[str, str]]:
    out, at, strip = [], 0, False
    while at < len(source):
        m = _MARK.search(source, at)
        plain = source[at : m.start() if m else len(source)]
        plain = plain.lstrip() if strip else plain
        if m and m[0].endswith("-"):
            plain = plain.rstrip()
        if plain:
            out.append(("text", plain))
        if not m:
            break
        close = {"{": "}}", "%": "%}", "#": "#}"}[m[0][1]]
        end = _end(source, m.end(), close)
        inner = source[m.end() : end]
        strip = inner.endswith("-")
        if close != "#}":
            out.append(({"}}": "emit", "%}": "do"}[close], inner.removesuffix("-").strip()))
        at = end + 2
    return out


def _end(source: str, at: int, close: str) -> int:
    """Where close stands outside of string literals."""
    quote = ""
    while at < len(source):
        c = source[at]
        if quote:
            at += c == "\\"
            quote = "" if c == quote else quote
        elif c in "\"'" and close != "#}":
            quote = c
        elif source.startswith(close, at):
            return at
        at += 1
    raise TemplateError(f"{close} missing")


def parse(source: str, filters: dict[str, Callable] = FILTERS) -> tuple:
    """The syntax tree: a tuple of statements."""
    pieces, at = _pieces(source), 0

    def block(*ends: str) -> tuple[tuple, str]:
        nonlocal at
        out: list = []
        while at < len(pieces):
            kind, text = pieces[at]
            at += 1
            if kind == "text":
                out.append(Emit(Const(text)))
                continue
            if kind == "emit":
                out.append(Emit(_Expression(text, filters).whole()))
                continue
            word, _, rest = text.partition(" ")
            if word in ends:
                return tuple(out), text
            if word == "if":
                out.append(branch(rest))
            elif word == "for":
                e = _Expression(rest, filters)
                name = e.name()
                e.need("in")
                over = e.whole()
                out.append(For(name, over, block("endfor")[0]))
            elif word == "set":
                e = _Expression(rest, filters)
                name = e.name()
                e.need("=")
                out.append(Set(name, e.whole()))
            elif word == "generation":
                out.append(Generation(block("endgeneration")[0]))
            else:
                raise TemplateError(f"unexpected {text!r}")
        if ends:
            raise TemplateError(f"{ends[-1]} missing")
        return tuple(out), ""

    def branch(test: str) -> If:
        yes, end = block("elif", "else", "endif")
        if end.startswith("elif"):
            no: tuple = (branch(end[4:]),)
        else:
            no = block("endif")[0] if end == "else" else ()
        return If(_Expression(test, filters).whole(), yes, no)

    return block()[0]


def fold(node: Any, filters: dict[str, Callable] = FILTERS) -> Any:
    """The same tree with constant expressions computed, dead branches gone and neighbouring texts joined."""
    again = lambda x: fold(x, filters)
    if isinstance(node, Op):
        args = tuple(map(again, node.args))
        if node.op == "if" and isinstance(args[0], Const):
            return args[1] if args[0].value else args[2]
        if node.op in ("and", "or") and isinstance(args[0], Const):
            return args[1] if bool(args[0].value) == (node.op == "and") else args[0]
        if node.op in _BINARY and all(isinstance(a, Const) for a in args):
            return Const(_BINARY[node.op](*(a.value for a in args)))
        return Op(node.op, args)
    if isinstance(node, Get):
        of, key = again(node.of), again(node.key)
        return Const(_get(of.value, key.value)) if isinstance(of, Const) and isinstance(key, Const) else Get(of, key)
    if isinstance(node, Filter):
        of = again(node.of)
        return Const(filters[node.name](of.value)) if isinstance(of, Const) else Filter(node.name, of)
    if isinstance(node, Emit):
        return Emit(again(node.what))
    if isinstance(node, If):
        return If(again(node.test), _fold_all(node.yes, filters), _fold_all(node.no, filters))
    if isinstance(node, For):
        return For(node.name, again(node.over), _fold_all(node.body, filters))
    if isinstance(node, Set):
        return Set(node.name, again(node.value))
    if isinstance(node, Generation):
        return Generation(_fold_all(node.body, filters))
    return node


def _fold_all(nodes: tuple, filters: dict[str, Callable]) -> tuple:
    out: list = []
    for node in (fold(n, filters) for n in nodes):
        if isinstance(node, If) and isinstance(node.test, Const):
            kept: tuple = node.yes if node.test.value else node.no
        else:
            kept = (node,)
        for x in kept:
            if isinstance(x, Emit) and isinstance(x.what, Const):
                x = Emit(Const(_text(x.what.value)))
                if not x.what.value:
                    continue
                if out and isinstance(out[-1], Emit) and isinstance(out[-1].what, Const):
                    out[-1] = Emit(Const(out[-1].what.value + x.what.value))
                    continue
            out.append(x)
    return tuple(out)


class Output:
    __slots__ = ("parts", "size", "spans")

    def __init__(self) -> None:
        self.parts: list[str] = []
        self.size = 0
        self.spans: list[tuple[int, int]] = []

    def put(self, text: str) -> None:
        self.parts.append(text)
        self.size += len(text)


def _value(node: Any, filters: dict[str, Callable]) -> Callable[[dict], Any]:
    if isinstance(node, Const):
        value = node.value
        return lambda env: value
    if isinstance(node, Name):
        name = node.name
        return lambda env: env.get(name)
    if isinstance(node, Get):
        of, key = _value(node.of, filters), _value(node.key, filters)
        return lambda env: _get(of(env), key(env))
    if isinstance(node, Filter):
        of, f = _value(node.of, filters), filters[node.name]
        return lambda env: f(of(env))
    args = [_value(a, filters) for a in node.args]
    if node.op == "if":
        return lambda env: args[1](env) if args[0](env) else args[2](env)
    if node.op == "and":
        return lambda env: args[0](env) and args[1](env)
    if node.op == "or":
        return lambda env: args[0](env) or args[1](env)
    f = _BINARY[node.op]
    return (lambda env: f(args[0](env))) if len(args) == 1 else (lambda env: f(args[0](env), args[1](env)))


def _block(nodes: tuple, filters: dict[str, Callable]) -> Callable[[dict, Output], None]:
    steps = [_step(n, filters) for n in nodes]

    def run(env: dict, out: Output) -> None:
        for step in steps:
            step(env, out)

    return run


def _step(node: Any, filters: dict[str, Callable]) -> Callable[[dict, Output], None]:
    if isinstance(node, Emit):
        what = _value(node.what, filters)
        return lambda env, out: out.put(_text(what(env)))
    if isinstance(node, If):
        test, yes, no = _value(node.test, filters), _block(node.yes, filters), _block(node.no, filters)
        return lambda env, out: (yes if test(env) else no)(env, out)
    if isinstance(node, Set):
        name, value = node.name, _value(node.value, filters)
        return lambda env, out: env.__setitem__(name, value(env))
    if isinstance(node, Generation):
        body = _block(node.body, filters)

        def generation(env: dict, out: Output) -> None:
            start = out.size
            body(env, out)
            if out.size > start:
                out.spans.append((start, out.size))

        return generation
    over, body, name = _value(node.over, filters), _block(node.body, filters), node.name

    def loop(env: dict, out: Output) -> None:
        rows = over(env)
        rows = list(rows) if isinstance(rows, (list, str, dict)) else []
        outer = {k: env[k] for k in (name, "loop") if k in env}
        for i, row in enumerate(rows):
            env[name] = row
            env["loop"] = {"index": i + 1, "index0": i, "first": i == 0, "last": i == len(rows) - 1, "length": len(rows)}
            body(env, out)
        for k in (name, "loop"):
            env.pop(k, None)
        env.update(outer)

    return loop


class Template:
    """A compiled template; render(**names) gives the text and the spans under generation marks."""

    def __init__(self, source: str, filters: dict[str, Callable] | None = None):
        self.filters = FILTERS | (filters or {})
        self.tree = _fold_all(parse(source, self.filters), self.filters)
        self.run = _block(self.tree, self.filters)

    def render(self, **names: Any) -> tuple[str, list[tuple[int, int]]]:
        out = Output()
        self.run(dict(names), out)
        return "".join(out.parts), out.spans
