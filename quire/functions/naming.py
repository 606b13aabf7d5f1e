"""Names of files, folders, batches and deliveries as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import tables
from .text import fold


def zero_filled(x: Column, width: int) -> Column:
    """Padded with zeros on the left; longer values stay whole."""
    return F.lpad(x, F.greatest(F.lit(width), F.length(x)), F.lit("0"))


def filled(x: Column) -> Column:
    return F.nullif(F.trim(x.cast("string")), F.lit(""))


def base_name(issn: Column, acronym: Column, volume: Column, number: Column, elocation: Column, fpage: Column) -> Column:
    """ISSN-acronym-volume-number-location; the electronic location wins over the first page, absent parts are left out."""
    return F.concat_ws("-", issn, acronym, zero_filled(filled(volume), 2), zero_filled(filled(number), 2), F.coalesce(filled(elocation), zero_filled(filled(fpage), 5)))


def batch_code(batch: Column, year: Column) -> Column:
    """Two or more digits of the sequence, then the year's last two."""
    return F.concat(zero_filled(batch.cast("string"), 2), F.right(filled(year), F.lit(2)))


def folder_name(issn: Column, acronym: Column, volume: Column, number: Column, continuous: Column, batch: Column, year: Column) -> Column:
    """Null without ISSN, acronym or volume; in continuous publication also without a batch or year."""
    known = issn.isNotNull() & acronym.isNotNull() & filled(volume).isNotNull() & (~continuous | (batch.isNotNull() & filled(year).rlike(r"^\d+$")))
    return F.when(known, F.concat_ws("-", issn, acronym, zero_filled(filled(volume), 2), zero_filled(filled(number), 2), F.when(continuous, batch_code(batch, year))))


def bare_number(x: Column) -> Column:
    """Without leading zeros, of which one stays."""
    return F.regexp_replace(filled(x), r"^0+(?=.)", "")


def issue_tag(volume: Column, number: Column) -> Column:
    return F.concat(F.coalesce(F.concat(F.lit("v"), bare_number(volume)), F.lit("")), F.coalesce(F.concat(F.lit("n"), bare_number(number)), F.lit("")))


def delivery_title(acronym: Column, volume: Column, number: Column, continuous: Column, batch: Column, year: Column, country: Column, this_year: int) -> Column:
    """The fixed form of a delivery's title; volumes of two years ago or older are retrospective."""
    known = filled(year).rlike(r"^\d+$")
    middle = F.when(continuous, F.when(batch.isNotNull() & known, F.concat(F.lit("Lote "), batch_code(batch, year))).otherwise(F.lit("Lote ????"))).otherwise(F.when(known, filled(year)).otherwise(F.lit("????")))
    term = F.when(known & (F.when(known, year.cast("int")) <= this_year - 2), "Retrô Entrega").otherwise("Entrega")
    return F.concat(term, F.lit(" | "), F.concat_ws(" ", F.coalesce(acronym, F.lit("?")), F.nullif(issue_tag(volume, number), F.lit("")), middle), F.lit(" - "), F.coalesce(filled(country), F.lit("BR")))


def file_name_fault(name: Column) -> Column:
    """The first rule that a file name breaks, null if none: accent, underscore, extra dot, space, extension, charset."""
    extension = F.lower(F.regexp_extract(name, r"[^.](\.[^.]*)$", 1))
    return (
        F.when(fold(name) != name, "accent")
        .when(name.contains("_"), "underscore")
        .when(F.regexp_replace(name, r"(?<=[^.])\.[^.]*$", "").contains("."), "dot")
        .when(name.contains(" "), "space")
        .when(~extension.isin(*tables.PACKAGE_EXTENSIONS.split()), "extension")
        .when(~name.rlike(r"^[A-Za-z0-9][A-Za-z0-9-]*\.[A-Za-z0-9]+$"), "character")
    )


def folder_name_fault(name: Column) -> Column:
    rule = F.when(fold(name) != name, "accent")
    for char, what in (("_", "underscore"), (".", "dot"), (" ", "space"), ("–", "en dash"), ("—", "em dash")):
        rule = rule.when(name.contains(char), what)
    return rule.when(~name.rlike("^[A-Za-z0-9][A-Za-z0-9-]*$"), "character")


def page_total(fpage: Column, lpage: Column, manual: Column, file_pages: Column, from_docx: Column) -> Column:
    """From the page numbers, else as entered, else the file's pages unless it is a DOCX."""
    number = lambda c: F.when(filled(c).rlike(r"^\d{1,9}$"), filled(c).cast("int"))
    return F.coalesce(number(lpage) - number(fpage) + 1, number(manual), F.when(~from_docx, file_pages))


def how_long_ago(seconds: Column) -> Column:
    n = lambda c: F.floor(c).cast("string")
    return F.when(seconds < 90, "now").when(seconds < 3600, F.concat(n(seconds / 60), F.lit(" min"))).when(seconds < 86400, F.concat(n(seconds / 3600), F.lit(" h"))).when(seconds < 172800, "yesterday").otherwise(F.concat(n(seconds / 86400), F.lit(" days")))


def masked(secret: Column) -> Column:
    """The first three and last two characters, if there are enough to hide some."""
    return F.when(F.length(secret) > 8, F.concat(F.left(secret, F.lit(3)), F.lit("…"), F.right(secret, F.lit(2)))).otherwise(F.lit("…"))
