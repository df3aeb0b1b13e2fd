"""Text and name normalisers as Column expressions: no Python runs in them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import ENTITY_TYPES, FIRST_PERSON, NARRATOR, NUMBER_UNITS, PARTICLES


def content_hash(content: Column) -> Column:
    """SHA-256 of the raw text, in hex."""
    return F.sha2(content, 256)


def clean_markdown(content: Column) -> Column:
    """Drop rule and empty table rows, join table cells by one space, and keep at most one blank line in a row."""

    def line(x: Column) -> Column:
        cells = F.filter(F.transform(F.split(x, r"\|"), lambda c: F.regexp_replace(c, r"^\s+|\s+$", "")), lambda c: c != "")
        return F.when(x.contains("|") & x.rlike(r"^[\s|:\-]*$"), F.lit(None)).when(F.length(x) - F.length(F.replace(x, F.lit("|"))) >= 3, F.when(F.size(cells) > 0, F.array_join(cells, " "))).otherwise(x)

    kept = F.filter(F.transform(F.split(content, "\n", -1), line), lambda x: x.isNotNull())
    return F.regexp_replace(F.array_join(kept, "\n"), r"\n{3,}", "\n\n")


def strip_particle(name: Column) -> Column:
    """Without one trailing case particle, if more than two characters are there."""
    return F.when((F.length(name) > 2) & F.substring(name, -1, 1).isin(*PARTICLES), F.substring(name, F.lit(1), F.length(name) - 1)).otherwise(name)


def name_key(name: Column) -> Column:
    """Equal for names that differ in white space, punctuation, case or a trailing particle."""
    return F.lower(F.regexp_replace(strip_particle(name), r"(?U)[\s\W_]+", ""))


def is_noise_name(name: Column) -> Column:
    """Empty, or nothing but a number with units."""
    rest = F.regexp_replace(name, r"(?U)[\d,.\s]", "")
    rest = reduce(lambda c, unit: F.replace(c, F.lit(unit), F.lit("")), sorted(NUMBER_UNITS, key=len, reverse=True), rest)
    other = r"(?U)[^\d,.\s" + "".join(sorted(set("".join(NUMBER_UNITS)))) + "]"  # most names have such a character, and none is taken away
    return F.when(name.rlike(other), False).when(F.regexp_replace(name, r"(?U)^\s+|\s+$", "") == "", True).when(~name.rlike(r"(?U)\d"), False).otherwise(rest == "")


def document_label(file_name: Column) -> Column:
    """The file's stem without a leading number and underscore."""
    return F.regexp_replace(F.regexp_replace(file_name, r"(?<=.)\.[^.]*$", ""), r"^\d+_", "")


def predicate(value: Column) -> Column:
    """UPPER_SNAKE."""
    joined = F.regexp_replace(F.regexp_replace(F.regexp_replace(value, r"(?U)^\s+|\s+$", ""), r"(?U)[\s\-]+", "_"), r"_+", "_")
    return F.upper(F.regexp_replace(joined, r"^_+|_+$", ""))


def entity_type(value: Column) -> Column:
    known = F.upper(F.regexp_replace(value, r"(?U)^\s+|\s+$", ""))
    return F.when(known.isin(*ENTITY_TYPES), known).otherwise("OTHER")


def clean_aliases(name: Column, aliases: Column) -> Column:
    """Trimmed, not blank, not the name, each once, in order of first sight."""
    trimmed = F.transform(F.coalesce(aliases, F.array().cast("array<string>")), lambda a: F.regexp_replace(a, r"(?U)^\s+|\s+$", ""))
    return F.array_distinct(F.filter(trimmed, lambda a: a.isNotNull() & (a != "") & (a != name)))


def strip_fence(raw: Column) -> Column:
    return F.regexp_replace(F.replace(F.replace(raw, F.lit("```json"), F.lit("")), F.lit("```"), F.lit("")), r"(?U)^\s+|\s+$", "")


def first_person(name: Column, label: Column, scope: str = "document") -> Column:
    """A bare first-person word becomes the narrator of its document, or of the collection."""
    if scope == "off":
        return name
    told = F.concat(F.lit(NARRATOR + "("), label, F.lit(")")) if scope == "document" else F.lit(NARRATOR)
    return F.when(name.isin(*FIRST_PERSON), told).otherwise(name)
