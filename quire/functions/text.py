"""Scalar text functions as column expressions; all stay in the JVM."""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from functools import reduce
from operator import or_

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import tables

_ACCENTED = [chr(c) for c in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00)) if len(unicodedata.normalize("NFD", chr(c))) > 1 and unicodedata.normalize("NFD", chr(c))[0].isascii()]
FOLD_FROM, FOLD_TO = "".join(_ACCENTED), "".join(unicodedata.normalize("NFD", c)[0] for c in _ACCENTED)

_LETTERS = re.compile("[a-záàâãéêíóôõúüçñ]+")
DOI = r"10\.\d{4,9}/[^\s\"<>|]+"
ISSN = r"(?<![\d-])(\d{4}-\d{3}[\dXx])(?![\d-])"
ORCID = r"(\d{4}-\d{4}-\d{4}-\d{3}[\dXx])"
EMAIL = r"(?U)[\w.+-]+@[\w-]+(?:\.[\w-]+)+"
URL = r"https?://[^\s<>\"]+"
LATTES = r"lattes\.cnpq\.br/\d+"


def fold(x: Column) -> Column:
    """x without accents (composed Latin letters; combining marks go)."""
    return F.regexp_replace(F.translate(x, FOLD_FROM, FOLD_TO), r"\p{Mn}", "")


def normal_key(x: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(fold(F.coalesce(x, F.lit("")))), "[^a-z0-9]+", " "))


def strip_note_calls(x: Column) -> Column:
    return F.regexp_replace(F.coalesce(x, F.lit("")), r"\[\^[^\]]{1,16}\]", "")


def trim_doi(x: Column) -> Column:
    return F.rtrim(x, F.lit(".,;:)]"))


def repetition_key(x: Column) -> Column:
    """Digits as #, lower case, white space squeezed: equal for running heads that differ in numbers."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(x), r"\d+", "#"), r"\s+", " "))


def _digit(x: Column, i: Column) -> Column:
    return F.substring(x, i, F.lit(1)).cast("int")


def orcid_valid(x: Column) -> Column:
    """ISO 7064 MOD 11-2; false unless 15 digits and a check character remain without hyphens."""
    bare = F.upper(F.replace(x, F.lit("-"), F.lit("")))
    total = F.aggregate(F.sequence(F.lit(1), F.lit(15)), F.lit(0).cast("long"), lambda a, i: (a + _digit(bare, i)) * 2)
    check = (F.lit(12) - total % 11) % 11
    return F.when(bare.rlike(r"^\d{15}.$"), F.substring(bare, 16, 1) == F.when(check == 10, "X").otherwise(check.cast("string"))).otherwise(False)


def issn_valid(x: Column) -> Column:
    """Modulus 11 with weights 8 to 2; positions that hold no digit count nothing."""
    bare = F.upper(F.replace(x, F.lit("-"), F.lit("")))
    total = F.aggregate(F.sequence(F.lit(1), F.lit(7)), F.lit(0), lambda a, i: a + F.coalesce(F.try_to_number(F.substring(bare, i, F.lit(1)), F.lit("9")).cast("int"), F.lit(0)) * (9 - i))
    rest = total % 11
    check = F.when(rest == 0, "0").when(rest == 1, "X").otherwise((11 - rest).cast("string"))
    return F.when(F.length(bare) == 8, F.substring(bare, 8, 1) == check).otherwise(False)


def issn_canonical(x: Column) -> Column:
    """NNNN-NNNX, or null if there aren't eight characters."""
    bare = F.upper(F.regexp_replace(x, "[^0-9Xx]", ""))
    return F.when(F.length(bare) == 8, F.concat(F.substring(bare, 1, 4), F.lit("-"), F.substring(bare, 5, 4)))


def superscript_marker(x: Column) -> Column:
    """Superscript digits as plain ones if there is nothing else; others trimmed."""
    bare = F.trim(x)
    return F.when(bare.rlike("^[⁰¹²³⁴-⁹]+$"), F.translate(bare, "⁰¹²³⁴⁵⁶⁷⁸⁹", "0123456789")).otherwise(bare)


def language(x: Column) -> Column:
    """struct(lang, confidence) by shares of function words; null lang for short or undecided texts.

    A word of a language's own counts twice more. The best share must be 0.08 and 0.04 above the next; equal shares go
    to the later code.
    """
    weights = {code: Counter(set(words.split())) for code, words in tables.STOP_WORDS.items()}
    for code, words in tables.OWN_WORDS.items():
        weights[code].update({w: 2 for w in set(words.split())})
    by_word: dict[str, list[tuple[str, int]]] = {}
    for code, own in weights.items():
        for w, n in own.items():
            by_word.setdefault(w, []).append((code, n))

    def decided(text: str | None) -> tuple[str | None, float]:
        words = _LETTERS.findall((text or "").lower())
        if len(words) < 3:
            return None, 0.0
        points = dict.fromkeys(weights, 0)
        for w in words:
            for code, n in by_word.get(w, ()):
                points[code] += n
        (second, _), (first, code) = sorted((n / len(words), code) for code, n in points.items())[-2:]
        return code if first >= 0.08 and first - second >= 0.04 else None, first

    @F.arrow_udf("lang string, confidence double")
    def decide(texts: pa.Array) -> pa.Array:
        # a batch's copies of a text, as headings and labels have many, are read once
        coded = texts.dictionary_encode("encode")
        langs, sure = zip(*map(decided, coded.dictionary.to_pylist()), strict=True) if len(texts) else ((), ())
        found = pa.StructArray.from_arrays([pa.array(langs, pa.string()), pa.array(sure, pa.float64())], ["lang", "confidence"])
        return found.take(coded.indices)

    # one pass over a text's words, each looked up in the languages' lists at once
    found = decide(x)
    return F.struct(found["lang"].alias("lang"), F.round(found["confidence"], 3).alias("confidence"))


def month_number(name: Column) -> Column:
    return F.create_map(*[F.lit(x) for pair in tables.MONTHS.items() for x in pair])[F.lower(fold(name))]


def parse_date(x: Column, this_year: int) -> Column:
    """The first recognisable date as YYYY-MM-DD text: ISO, then d/m/Y, then 'd [de] month [de] Y', then 'month d, Y',
    then d/m/yy, whose century turns five years after this_year. Month lengths aren't checked."""

    def parts(pattern: str) -> list[Column]:
        return [F.regexp_extract(x, pattern, g) for g in (1, 2, 3)]

    two = lambda n: F.lpad(n.cast("string"), 2, "0")
    iso, dmy, named, anglo, short = (
        r"\b(\d{4})-(\d{2})-(\d{2})\b", r"\b(\d{1,2})[/.\-](\d{1,2})[/.\-](\d{4})\b", r"(?U)\b(\d{1,2})\s*(?:de\s+)?([A-Za-zçÇ]{3,10})\.?\s*(?:de\s+)?(\d{4})\b",
        r"\b([A-Za-z]{3,10})\.?\s+(\d{1,2}),\s*(\d{4})\b", r"\b(\d{1,2})[/.\-](\d{1,2})[/.\-](\d{2})\b(?!\d)",
    )
    y, m, d = parts(iso)
    found = [F.when(y != "", F.concat_ws("-", y, m, d))]
    d, m, y = parts(dmy)
    found.append(F.when((y != "") & m.cast("int").between(1, 12) & d.cast("int").between(1, 31), F.concat_ws("-", y, two(m.cast("int")), two(d.cast("int")))))
    d, m, y = parts(named)
    found.append(F.when((y != "") & month_number(m).isNotNull(), F.concat_ws("-", y, two(month_number(m)), two(d.cast("int")))))
    m, d, y = parts(anglo)
    found.append(F.when((y != "") & month_number(m).isNotNull(), F.concat_ws("-", y, two(month_number(m)), two(d.cast("int")))))
    a, b, y = (p.cast("int") for p in (F.nullif(p, F.lit("")) for p in parts(short)))
    swap = (b > 12) & (a <= 12)
    d, m = F.when(swap, b).otherwise(a), F.when(swap, a).otherwise(b)
    century = F.when(y <= this_year % 100 + 5, 2000).otherwise(1900)
    found.append(F.when(m.between(1, 12) & d.between(1, 31), F.concat_ws("-", (century + y).cast("string"), two(m), two(d))))
    return F.coalesce(*found)


COUNTRY_PATTERN = r"^.*\b(" + "|".join(tables.COUNTRIES) + r")\b"


def last_country(x: Column) -> Column:
    """struct(name, iso) of the country mentioned last; a greedy prefix finds it, the list's order settles ties."""
    name = F.nullif(F.regexp_extract(normal_key(x), COUNTRY_PATTERN, 1), F.lit(""))
    iso = F.create_map(*[F.lit(v) for pair in tables.COUNTRIES.items() for v in pair])
    return F.struct(name.alias("name"), iso[name].alias("iso"))


def _plain(name: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFD", name) if unicodedata.category(c) != "Mn").lower()


STATE_NAMES = sorted(((_plain(name), code) for code, name in tables.STATES.items()), key=lambda x: -len(x[0]))
STATE_CODES = [c for c in tables.STATES if c not in ("BR", "PT", "ES", "US")]


def state(x: Column) -> Column:
    """A state's code: the first that stands alone in capitals, else that of the longest state name mentioned."""
    alone = F.regexp_extract(F.coalesce(x, F.lit("")), r"(?<![A-Za-z])(" + "|".join(STATE_CODES) + r")(?![A-Za-z])", 1)
    key = normal_key(x)
    named = F.coalesce(*[F.when(key.rlike(rf"\b{name}\b"), code) for name, code in STATE_NAMES])
    return F.coalesce(F.nullif(alone, F.lit("")), named)


_PARTICLE, _SUFFIX = "|".join(tables.PARTICLES.split()), "|".join(tables.SUFFIXES.split())
NAME_PATTERN = rf"(?i)^(?:(\S.*?)\s+)?(\S+\s+(?:{_SUFFIX})\.?|(?:(?:{_PARTICLE})\s+)+\S+(?:\s+(?:{_SUFFIX})\.?)?|\S+)$"


def split_name(x: Column) -> Column:
    """struct(surname, given): the surname takes a suffix's word and the particles before it, never the first word."""
    bare = F.regexp_replace(F.trim(x), r"\s+", " ")
    return F.struct(F.regexp_extract(bare, NAME_PATTERN, 2).alias("surname"), F.regexp_extract(bare, NAME_PATTERN, 1).alias("given"))


def title_case(x: Column) -> Column:
    """Capitalises an all-capital text, but for alphabetic words of at most three letters."""
    word = lambda w: F.when((F.length(w) <= 3) & w.rlike(r"^\p{L}+$"), w).otherwise(F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substring(w, F.lit(2), F.length(w)))))
    return F.when((x == F.upper(x)) & x.rlike(r"\p{L}"), F.array_join(F.transform(F.split(x, " "), word), " ")).otherwise(x)


def join_lines(lines: Column) -> Column:
    """One text of an array of lines: words broken at a hyphen are joined, but not at identifiers or hyphened prefixes."""
    # a hyphen stays in the last word of a line if that word is an address or an identifier, or has a digit before it
    hosts = ("orcid.org/", "doi.org/", "lattes.cnpq.br/", "http://", "https://", "www.")
    tail = lambda out: F.regexp_extract(F.right(out, F.lit(220)), r"(\S+)$", 1)
    address = lambda w: reduce(or_, [w.contains(h) for h in hosts]) | w.rlike(r"10\.\d{4,9}/")

    def add(out: Column, line: Column) -> Column:
        word = F.lower(F.regexp_extract(out, r"([^\s(]*)-$", 1))
        last = tail(out)
        keeps = address(last) | last.rlike(r"\d-$") | ~line.rlike(r"^\p{Ll}") | word.isin(*tables.HYPHEN_PREFIXES.split())
        goes_on = F.regexp_extract(line, r"^(\S+)", 1)
        broken_url = last.contains("://") & last.contains("http") & F.right(last, F.lit(1)).isin(*"/._-=?&") & goes_on.rlike(r"^[a-z0-9]") & F.rtrim(goes_on, F.lit(".,;")).rlike(r"(?U)^[\w\-./%?=&#~]*$")
        return (
            F.when(out == "", line)
            .when(out.endswith("-") & keeps, F.concat(out, line))
            .when(out.endswith("-"), F.concat(F.substring(out, F.lit(1), F.length(out) - 1), line))
            .when(broken_url, F.concat(out, line))
            .otherwise(F.concat(out, F.lit(" "), line))
        )

    kept = F.filter(F.transform(lines, lambda t: F.trim(F.coalesce(t, F.lit("")))), lambda t: t != "")
    return F.aggregate(kept, F.lit(""), add)


def licence_url(x: Column) -> Column:
    """The licence's address from a code such as CC BY-NC-ND; ND beats SA, since no licence has both."""
    t = F.trim(x)
    rest = F.upper(F.regexp_extract(t, r"(?i)\bCC[\s-]*BY((?:[\s-]*(?:NC|SA|ND))*)", 1))
    code = F.concat(F.lit("by"), F.when(rest.contains("NC"), "-nc").otherwise(""), F.when(rest.contains("ND"), "-nd").when(rest.contains("SA"), "-sa").otherwise(""))
    return F.when(t.startswith("http"), F.when(t.rlike(r"^https?://creativecommons\.org/licenses/"), t)).when(t.rlike(r"(?i)\bCC[\s-]*BY"), F.concat(F.lit("https://creativecommons.org/licenses/"), code, F.lit("/4.0/")))


def _mentioned(x: Column, listed: dict[str, tuple[str, ...]]) -> Column:
    """The first name of listed of whose phrases x holds one."""
    flat = F.lower(fold(x))
    return F.coalesce(*[F.when(reduce(or_, [flat.contains(p) for p in phrases]), name) for name, phrases in listed.items()])


def note_kind(x: Column) -> Column:
    """The kind of a note by what it mentions; other if nothing."""
    return F.coalesce(_mentioned(x, tables.NOTE_KINDS), F.lit("other"))


def section_type(title: Column) -> Column:
    return _mentioned(title, tables.SECTION_TYPES)


def cited_numbers(label: Column, most: Column) -> Column:
    """The numbers of a numeric citation ('1,2', '4-6'); none if any part is odd, wider than 30 or beyond most."""
    parts = F.split(F.regexp_replace(label, r"\s+", ""), ",")
    bounds = F.transform(parts, lambda p: F.transform(F.split(p, "[-–]"), lambda n: F.expr("cast(null as int)") if n is None else F.try_to_number(F.nullif(n, F.lit("")), F.lit("9999")).cast("int")))
    fine = F.forall(parts, lambda p: p.rlike(r"^\d{1,4}([-–]\d{1,4})?$")) & F.forall(bounds, lambda b: (F.element_at(b, 1) >= 1) & (F.element_at(b, -1) >= F.element_at(b, 1)) & (F.element_at(b, -1) - F.element_at(b, 1) <= 30) & (F.element_at(b, -1) <= most))
    return F.when(fine, F.flatten(F.transform(bounds, lambda b: F.sequence(F.element_at(b, 1), F.element_at(b, -1))))).otherwise(F.array().cast("array<int>"))
