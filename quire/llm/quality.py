"""Quality rules: a table of thresholds compiled into one Spark projection, without user functions.

Words are runs without the ASCII space and \\x09 to \\x0D. A text is described by its words, their length, symbols,
exclamation marks, stop words, the lines that repeat earlier ones, lines that are list items or break off, and the words
in three-word windows that occur more than once. RULES says between which bounds each ratio must lie; a rule may hold from
a number of words on only. The table is data: compiled() turns it into one expression that lists the rules that a text
breaks.

Defined results: a null text has no words, and is no less null; texts are measured whole, whatever their length; each
row is judged by itself, so ties and repeated rows get the same verdict; a ratio over nothing is 0; an empty table gives
no rows; other columns are kept, and a column with the name of the new one, in whatever case, is an error.
"""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_name

WINDOW = 3
SPACE = r"[\x20\x09-\x0D]"
SYMBOLS = r"[#*$%&|<>]"
#: Frequent function words of English, German, French and Spanish.
STOP_WORDS = tuple("the of and to in is that it was for on are with as by this be at from der die das und ist nicht ein eine zu mit von auf den dem le la les des et est un une dans que qui pour sur du de el los las en y por con para del se".split())


MEASURES = ("n_words", "word_chars", "n_symbols", "n_exclamations", "n_stop_words", "n_lines", "n_dup_lines", "n_list_lines", "n_open_lines", "n_repeat_words")


class Rule(NamedTuple):
    """measure / per, or the plain measure without per, must lie from least to most, in texts of from_words or more."""

    name: str
    measure: str
    per: str | None = None
    least: float | None = None
    most: float | None = None
    from_words: int = 0


#: The base rules, which come before the verdict of the others.
BASE = (
    Rule("too few words", "n_words", least=50),
    Rule("repeated windows", "n_repeat_words", "n_words", most=0.5),
)
RULES = (
    Rule("short words", "word_chars", "n_words", least=2.5),
    Rule("long words", "word_chars", "n_words", most=11),
    Rule("symbols", "n_symbols", "n_words", most=0.1),
    Rule("exclamations", "n_exclamations", "n_words", most=0.2),
    Rule("no stop words", "n_stop_words", "n_words", least=0.005, from_words=200),
    Rule("repeated lines", "n_dup_lines", "n_lines", most=0.5),
    Rule("list items", "n_list_lines", "n_lines", most=0.9),
    Rule("lines that break off", "n_open_lines", "n_lines", most=0.5),
)


def _once(value: Column, use) -> Column:
    """use(value), with the value computed once although it is used often."""
    return F.transform(F.array(value), use)[0]


def _repeated(words: Column, n: Column) -> Column:
    """Words in windows of WINDOW words that occur more than once."""
    m = F.greatest(n - (WINDOW - 1), F.lit(0))
    shifted = F.arrays_zip(*[F.slice(words, F.lit(k + 1), m) for k in range(WINDOW)])
    windows = F.transform(shifted, lambda x: F.concat_ws(" ", *[x[str(k)] for k in range(WINDOW)]))

    def covered(at: Column) -> Column:
        # starts in order: each covers up to WINDOW words, or as many as there are up to the next start
        return F.aggregate(at, F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")), lambda a, s: F.struct((a["n"] + WINDOW - F.greatest(a["end"] - s, F.lit(0))).alias("n"), (s + WINDOW).alias("end")))["n"]

    def among(sorted_windows: Column) -> Column:
        same = lambda x, k: (x["w"] == F.get(sorted_windows, k - 1)["w"]) | (x["w"] == F.get(sorted_windows, k + 1)["w"])
        return covered(F.sort_array(F.transform(F.filter(sorted_windows, same), lambda x: x["i"])))

    def repeats(w: Column) -> Column:
        numbered = F.sort_array(F.transform(w, lambda x, i: F.struct(x.alias("w"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(w)) == F.size(w), F.lit(0)).otherwise(_once(numbered, among))

    return _once(windows, repeats)


def measures(text: Column) -> Column:
    """struct of the counts that rules refer to, all long."""
    text = F.coalesce(text, F.lit(""))
    count = lambda pattern: F.regexp_count(text, F.lit(pattern))
    bare = lambda word: F.rtrim(F.lower(word), F.lit(".,;:!?"))

    def of_words(words: Column, lines: Column) -> Column:
        found = {
            "n_words": F.size(words),
            "word_chars": F.length(F.array_join(words, "")),
            "n_symbols": count(SYMBOLS),
            "n_exclamations": count("!"),
            "n_stop_words": F.size(F.filter(words, lambda w: bare(w).isin(*STOP_WORDS))),
            "n_lines": F.size(lines),
            "n_dup_lines": F.size(lines) - F.size(F.array_distinct(lines)),
            "n_list_lines": count(r"(?m)^[\x20\x09]*(?:[-*•‣·]|[0-9]{1,3}[.)])[\x20\x09]+[^\x20\x09-\x0D]"),
            "n_open_lines": F.size(F.filter(lines, lambda x: F.endswith(F.rtrim(x), F.lit("...")) | F.endswith(F.rtrim(x), F.lit("…")))),
            "n_repeat_words": _repeated(words, F.size(words)),
        }
        return F.struct(*[value.cast("long").alias(name) for name, value in found.items()])

    words = F.array_remove(F.split(text, SPACE + "+", -1), "")
    # only lines with a word count as lines
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return _once(words, lambda w: _once(lines, lambda x: of_words(w, x)))


def compiled(rules: tuple[Rule, ...], of: Column) -> Column:
    """array<string>: the names of the rules that the measures break; a ratio is held against its bounds as a product."""

    def broken(rule: Rule) -> Column:
        value, per = of[rule.measure], of[rule.per] if rule.per else F.lit(1)
        bad = [value < per * F.lit(rule.least)] if rule.least is not None else []
        bad += [value > per * F.lit(rule.most)] if rule.most is not None else []
        return (of["n_words"] >= rule.from_words) & reduce(Column.__or__, bad, F.lit(False))

    return F.array_compact(F.array(*[F.when(broken(r), F.lit(r.name)) for r in rules])) if rules else F.array().cast("array<string>")


def judge(docs: DataFrame, text_col: str = "text", base: tuple[Rule, ...] = BASE, rules: tuple[Rule, ...] = RULES, name: str = "quality") -> DataFrame:
    """docs with name: struct of the measures, base_broken and broken (names of rules) and kept."""
    if free_name(docs, name) != name:
        raise ValueError(f"column {name} exists")

    def verdict(m: Column) -> Column:
        fields = [m[f].alias(f) for f in MEASURES]
        first, more = compiled(base, m), compiled(rules, m)
        return F.struct(*fields, first.alias("base_broken"), more.alias("broken"), (F.size(F.concat(first, more)) == 0).alias("kept"))

    return docs.withColumn(name, _once(measures(F.col(text_col)), verdict))


def keep(docs: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """docs that break no rule."""
    name = free_name(docs, "_quality")
    return judge(docs, text_col, name=name, **options).where(F.col(name)["kept"]).drop(name)


def digest_rows(judged: DataFrame, name: str = "quality") -> DataFrame:
    """The contract's columns, and the rules that each text breaks."""
    q = F.col(name)
    counts = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    return judged.select("doc_id", *[q[c].alias(c) for c in counts], (F.size(q["base_broken"]) > 0).alias("base_failed"), q["kept"].alias("kept"), F.array_join(F.concat(q["base_broken"], q["broken"]), ",").alias("broken_rules"))
