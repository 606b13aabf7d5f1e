"""Scalar expressions over records: subjects, own citations, suggested codes, times of one zone, versions and contrast."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import fold

# What subjects of each area begin words with, first hit first.
AREAS = {
    "Ciências Sociais Aplicadas (Direito, Administração, Economia)": ("law", "jurisprudence", "direito", "social scien", "economic", "business", "management", "administra"),
    "Ciências da Saúde": ("medicine", "health", "nursing", "public health", "saúde", "medicina", "enfermagem", "odontolog"),
    "Ciências Biológicas": ("biolog", "zoolog", "botan", "ecolog"),
    "Ciências Exatas e da Terra": ("mathemat", "physic", "chemis", "astronom", "geoscien", "computer", "matemática", "física", "química"),
    "Engenharias": ("engineer", "engenharia", "technolog"),
    "Ciências Agrárias": ("agricultur", "veterinar", "agron", "food scien"),
    "Linguística, Letras e Artes": ("linguistic", "literature", "art", "philolog", "letras", "lingu"),
    "Ciências Humanas": ("history", "philosoph", "psycholog", "sociolog", "anthropolog", "education", "geograph", "história", "filosofia", "psicologia"),
}
# Words of a title that give no letter to its code.
NO_INITIAL = ("revista", "de", "da", "do", "das", "dos", "e", "em", "a", "o", "journal", "of", "the", "brazilian", "brasileira")
#: The zone that times are shown in: three hours behind UTC, without daylight saving.
ZONE = "-03:00"


def subject_area(*texts: Column) -> Column:
    """The area of the first listed word that opens a word of the texts; empty if none does."""
    target = F.concat(F.lit(" "), F.lower(F.concat_ws(" ", *texts)))
    opens = lambda w: target.rlike(rf"(?U)(?<!\w)\Q{w}\E")
    return F.coalesce(*[F.when(reduce(or_, map(opens, words)), area) for area, words in AREAS.items()], F.lit(""))


def journal_code(title: Column) -> Column:
    """A code suggested from a title: the initials, at most six, of its words without NO_INITIAL; null under two."""
    words = F.split(F.regexp_replace(F.lower(fold(title)), "[^a-z ]", ""), " +")
    code = F.left(F.array_join(F.transform(F.filter(words, lambda w: (w != "") & ~w.isin(*NO_INITIAL)), lambda w: F.left(w, F.lit(1))), ""), F.lit(6))
    return F.when(F.length(code) >= 2, code)


def editor_line(name: Column, orcid: Column, lattes: Column) -> Column:
    """The editor's name, ORCID and Lattes, as far as they are known."""
    known = lambda x: F.nullif(F.trim(x), F.lit(""))
    return F.concat_ws(". ", known(name), F.concat(F.lit("ORCID: https://orcid.org/"), F.substring_index(known(orcid), "/", -1)), F.concat(F.lit("Lattes: "), known(lattes)))


def own_citation(authors: Column, title: Column, journal: Column, volume: Column, issue: Column, elocation: Column, fpage: Column, year: Column, doi: Column) -> Column:
    """How to cite an article: authors (array of struct surname, given; the first six), title, journal, issue, year, DOI."""
    given = lambda x: F.coalesce(x, F.lit(""))
    person = lambda a: F.btrim(F.concat(F.upper(given(a["surname"])), F.lit(", "), given(a["given"])), F.lit(" ,"))
    some = lambda x: F.nullif(x, F.lit(""))
    names = F.coalesce(some(F.array_join(F.transform(F.slice(F.coalesce(authors, F.expr("cast(array() as array<struct<surname:string,given:string>>)")), 1, 6), person), "; ")), F.lit("[authors unread]"))
    place = F.coalesce(some(elocation), F.concat(F.lit("p. "), some(fpage)))
    issue_parts = F.concat_ws(", ", F.concat(F.lit("v. "), some(volume)), F.concat(F.lit("n. "), some(issue)), place)
    text = F.concat(
        names, F.lit(". "), F.rtrim(F.coalesce(some(title), F.lit("[title unread]")), F.lit(".")), F.lit("."), F.coalesce(F.concat(F.lit(" "), journal, F.lit(",")), F.lit("")),
        F.coalesce(F.concat(F.lit(" "), some(issue_parts), F.lit(",")), F.lit("")), F.coalesce(F.concat(F.lit(" "), some(year), F.lit(".")), F.lit("")),
        F.coalesce(F.concat(F.lit(" DOI: https://doi.org/"), some(doi), F.lit(".")), F.lit("")),
    )
    return F.trim(F.replace(text, F.lit("  "), F.lit(" ")))


def zoned(x: Column) -> Column:
    """An ISO time in the zone's wall clock; one without an offset counts as UTC. Null for what is no time."""
    t = F.trim(x)
    offset = t.rlike(r"(Z|[+-]\d{2}:?\d{2})$")
    return F.from_utc_timestamp(F.try_to_timestamp(F.when(offset, t).otherwise(F.concat(t, F.lit("Z")))), ZONE)


def shown_time(at: Column, with_hour: bool = True) -> Column:
    return F.coalesce(F.date_format(at, "dd/MM/yyyy HH:mm" if with_hour else "dd/MM/yyyy"), F.lit("—"))


def online(seconds_ago: Column, minutes: int = 5) -> Column:
    return F.coalesce(seconds_ago <= minutes * 60, F.lit(False))


def wait_minutes(seconds: Column) -> Column:
    """Seconds as whole minutes, rounded up, at least one."""
    return F.greatest(F.lit(1), F.ceil(seconds / 60)).cast("int")


def invite_code(x: Column) -> Column:
    return F.regexp_replace(F.upper(F.coalesce(x, F.lit(""))), "[^A-Z0-9]", "")


def version_key(x: Column) -> Column:
    """A dotted version as an array of numbers, which compares as versions do."""
    return F.transform(F.split(x, r"\."), lambda p: p.cast("int"))


def day_first(date: Column) -> Column:
    """2025-03-01 as 01/03/2025; shorter texts stay."""
    return F.when(F.length(date) >= 10, F.concat_ws("/", F.substring(date, 9, 2), F.substring(date, 6, 2), F.left(date, F.lit(4)))).otherwise(date)


def _channel(colour: Column, i: int) -> Column:
    return F.conv(F.substring(F.ltrim(colour, F.lit("#")), 2 * i + 1, 2), 16, 10).cast("int")


def luminance(colour: Column) -> Column:
    """Relative luminance of a colour such as #1A2B3C."""

    def linear(i: int) -> Column:
        c = _channel(colour, i) / 255.0
        return F.when(c <= 0.03928, c / 12.92).otherwise(F.pow((c + 0.055) / 1.055, 2.4))

    return 0.2126 * linear(0) + 0.7152 * linear(1) + 0.0722 * linear(2)


def contrast(a: Column, b: Column) -> Column:
    """Contrast ratio of two colours, from 1 to 21."""
    la, lb = luminance(a), luminance(b)
    return (F.greatest(la, lb) + 0.05) / (F.least(la, lb) + 0.05)


def mixed(a: Column, b: Column, share: Column) -> Column:
    """The colour with share of a and the rest of b."""
    part = lambda i: F.lpad(F.hex(F.bround(_channel(a, i) * share + _channel(b, i) * (1 - share)).cast("long")), 2, "0")
    return F.concat(F.lit("#"), part(0), part(1), part(2))


def file_stem(path: Column) -> Column:
    """The file's name without folders and extension."""
    return F.regexp_replace(F.substring_index(path, "/", -1), r"\.[^.]*$", "")
