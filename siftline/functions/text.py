"""Masks, hashes, checks and places in text, as native column expressions.

Offsets count code points, from 0, ends are exclusive. Patterns use ``(?U)`` so
that classes follow Unicode.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

STRIP = r"(?U)^\s+|\s+$"
#: Characters in a page of a text.
PAGE = 4096
CHUNK = 256


def pages(text: Column) -> Column:
    """A text in pages of ``PAGE`` characters: places in it are then found without a walk from its start."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PAGE}}}"), F.lit(0))


def cut(paged: Column, start: Column, stop: Column) -> Column:
    """The part of a text in pages from ``start`` up to ``stop``."""
    first = F.floor(start / PAGE).cast("int")
    part = F.slice(paged, first + 1, F.floor(stop / PAGE).cast("int") - first + 1)
    return F.array_join(part, "").substr((start - first * PAGE + 1).cast("int"), (stop - start).cast("int"))


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once; inside lambdas a column is computed wherever it stands."""
    return F.transform(F.array(value), body)[0]


def running(values: Column, zero: Column, join) -> Column:
    """For each value ``join`` of all before it. In chunks: a fold copies what it has gathered at every step."""

    def within(part, base):
        first = F.struct(base.alias("at"), F.array_repeat(base, 0).alias("out"))
        return F.aggregate(part, first, lambda acc, x: F.struct(join(acc["at"], x).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")), lambda acc: acc["out"])

    def over(parts):
        totals = F.transform(parts, lambda p: F.aggregate(p, zero, lambda a, x: join(a, x)))
        return let(within(totals, zero), lambda bases: F.flatten(F.transform(parts, lambda p, j: within(p, F.get(bases, j)))))

    parts = lambda v: F.transform(F.sequence(F.lit(0), F.floor(F.greatest(F.size(v) - 1, F.lit(0)) / CHUNK).cast("int")), lambda j: F.slice(v, j * CHUNK + 1, CHUNK))
    return let(values, lambda v: let(parts(v), over))


def located(text: Column, regex: str) -> Column:
    """``array<struct<value, start>>`` of a pattern's matches, from the pieces between them."""
    pairs = F.arrays_zip(F.regexp_extract_all(text, F.lit(regex), F.lit(0)).alias("value"), F.split(text, regex, -1).alias("ahead"))
    ends = lambda ps: running(F.transform(ps, lambda p: F.length(p["ahead"]) + F.length(p["value"])), F.lit(0), lambda a, x: a + x)
    placed = lambda ps: let(ends(ps), lambda es: F.transform(ps, lambda p, i: F.struct(p["value"].alias("value"), (F.get(es, i) + F.length(p["ahead"])).alias("start"))))
    return let(F.filter(pairs, lambda p: p["value"].isNotNull()), placed)


def strip(value: Column) -> Column:
    """Without white space of any kind at the ends."""
    return F.regexp_replace(value, STRIP, "")


def stars(n: Column) -> Column:
    return F.repeat(F.lit("*"), n.cast("int"))


def _edges(value: Column, head: int, tail: int) -> Column:
    return F.concat(F.left(value, F.lit(head)), F.lit("***"), F.right(value, F.lit(tail)))


def mask_value(value: Column) -> Column:
    """Short values as stars; an address keeps two letters (one of a short name) and its domain; others three and four characters."""
    at = F.instr(value, "@")
    domain = value.substr(at + 1, F.length(value))
    name = value.substr(F.lit(1), at - 1)
    shown = F.when(F.length(name) > 2, F.left(name, F.lit(2))).otherwise(F.left(name, F.lit(1)))
    return F.when(F.length(value) <= 4, stars(F.length(value))).when(at > 0, F.concat(shown, F.lit("***@"), domain)).otherwise(_edges(value, 3, 4))


def mask_edges(value: Column, keep: int = 3) -> Column:
    """``keep`` characters at either end; no tail where the value has no more; empty stays empty."""
    tail = F.when(F.length(value) > keep, F.right(value, F.lit(keep))).otherwise(F.lit(""))
    return F.when(F.coalesce(F.length(value), F.lit(0)) == 0, F.lit("")).otherwise(F.concat(F.left(value, F.lit(keep)), F.lit("***"), tail))


def mask_tracked(value: Column) -> Column:
    """As stored with a detection: up to four characters as stars, else three at either end."""
    return F.when(F.coalesce(F.length(value), F.lit(0)) == 0, F.lit("")).when(F.length(value) <= 4, stars(F.length(value))).otherwise(_edges(value, 3, 3))


def mask_partial(value: Column, head: int = 2, tail: int = 2) -> Column:
    """Keeps the length: two characters at either end, stars between; only stars for up to five characters."""
    n = F.length(value)
    inner = F.concat(F.left(value, F.lit(head)), stars(n - head - tail), F.right(value, F.lit(tail)))
    return F.when(F.coalesce(n, F.lit(0)) == 0, F.lit("****")).when(n <= head + tail + 1, stars(n)).otherwise(inner)


def luhn(value: Column) -> Column:
    """Whether the value has 13 to 19 digits that pass the Luhn test."""
    digits = F.regexp_replace(value, "[^0-9]", "")
    each = F.transform(F.split(F.reverse(digits), ""), lambda d, i: F.when(i % 2 == 0, d.try_cast("int")).otherwise(F.try_element_at(F.array(*[F.lit(x) for x in (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)]), d.try_cast("int") + 1)))
    return F.length(digits).between(13, 19) & (F.aggregate(each, F.lit(0), lambda a, d: a + F.coalesce(d, F.lit(0))) % 10 == 0)


def line_number(text: Column, start: Column) -> Column:
    return F.size(F.split(text.substr(F.lit(1), start.cast("int")), "\n"))


def context(text: Column, start: Column, end: Column, radius: int = 80, collapse: bool = True) -> Column:
    """The text around a span on one line."""
    begin = F.greatest(start - radius, F.lit(0))
    part = text.substr((begin + 1).cast("int"), (end + radius - begin).cast("int"))
    return F.trim(F.regexp_replace(part, r"(?U)\s+", " ")) if collapse else F.replace(part, F.lit("\n"), F.lit(" "))


def content_hash(content: Column) -> Column:
    return F.sha2(content, 256)


def entity_hash(kind: Column, value: Column) -> Column:
    return F.sha2(F.concat_ws(":", kind, strip(value)), 256)


def line_from_location(location: Column) -> Column:
    """The number in ``line N``; 1 where there is none."""
    return F.coalesce(F.regexp_extract(location, r"line (\d+)", 1).try_cast("int"), F.lit(1))


def entity_counts(text: Column) -> Column:
    """A JSON object of counts as a map; empty where it cannot be read."""
    return F.coalesce(F.from_json(text, "map<string,int>"), F.create_map().cast("map<string,int>"))


def languages(text: Column) -> Column:
    """Codes in a list separated by commas or plus signs."""
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("en")), "[,+]"), lambda x: F.trim(x)), lambda x: x != "")


#: Recogniser languages by code.
OCR_LANGUAGES = {"eng": "en", "en": "en", "spa": "es", "es": "es", "fra": "fr", "fr": "fr", "deu": "german", "de": "german", "chi_sim": "ch", "chi_tra": "ch"}


def ocr_language(code: Column) -> Column:
    """The recogniser's name of a language; of a composite code the first; ``en`` where unknown."""
    names = F.create_map(*[F.lit(x) for pair in OCR_LANGUAGES.items() for x in pair])
    return F.coalesce(F.try_element_at(names, F.split(F.lower(F.coalesce(code, F.lit(""))), r"\+")[0]), F.lit("en"))


def setting_value(text: Column) -> Column:
    """A stored setting as JSON text: JSON stays, ``True`` and ``False`` become booleans, anything else a string."""
    known = text.rlike(r'^\s*(\{.*\}|\[.*\]|".*"|-?\d+(\.\d+)?|true|false|null)\s*$')
    return F.when(known, text).when(text.isin("True", "False"), F.lower(text)).otherwise(F.to_json(F.array(text)).substr(F.lit(2), F.length(F.to_json(F.array(text))) - 2))
