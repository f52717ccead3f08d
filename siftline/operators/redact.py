"""Redaction of text by spans or by values, and of image areas by word boxes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import cut, let, mask_partial, pages, strip
from . import spans
from .patterns import FULL_REDACTION

FULL_MARK = "[REDACTED]"


def is_full(f: Column) -> Column:
    return f["type"].isin(*FULL_REDACTION)


def by_mode(findings: Column, mode: str) -> Column:
    """``full``: types that go whole, and high severity; ``partial``: the others; any other mode: all."""
    severe = lambda f: is_full(f) | (F.lower(F.coalesce(f["severity"], F.lit(""))) == "high")
    if mode == "full":
        return F.filter(findings, severe)
    return F.filter(findings, lambda f: ~severe(f)) if mode == "partial" else findings


def selected(findings: Column, indices: Column) -> Column:
    """The findings with the indices given; no indices select all."""
    some = F.transform(F.filter(indices, lambda i: (i >= 0) & (i < F.size(findings))), lambda i: F.get(findings, i))
    return F.when(F.coalesce(F.size(indices), F.lit(0)) <= 0, findings).otherwise(some)


def replacement(f: Column) -> Column:
    return F.when(is_full(f), F.lit(FULL_MARK)).otherwise(mask_partial(f["value"]))


def redact_spans(text: Column, findings: Column) -> Column:
    """Replaces each span, the last one first; where spans overlap, a replacement may be cut by the next."""

    def apart(fs: Column, ps: Column) -> Column:
        parts = F.transform(fs, lambda f, i: F.concat(cut(ps, F.coalesce(F.get(fs, i - 1)["end"], F.lit(0)), f["start"]), replacement(f)))
        return F.concat(F.array_join(parts, ""), cut(ps, F.element_at(fs, -1)["end"], F.greatest(F.length(text), F.element_at(fs, -1)["end"])))

    def piled(fs: Column) -> Column:
        last_first = spans.in_order(fs, lambda f: -f["start"])
        return F.aggregate(last_first, text, lambda t, f: F.concat(t.substr(F.lit(1), f["start"]), replacement(f), t.substr(f["end"] + 1, F.length(t))))

    piles = lambda fs: F.exists(F.transform(fs, lambda f, i: F.coalesce(F.get(fs, i - 1)["end"] > f["start"], F.lit(False))), lambda x: x)
    meets = lambda fs: piles(fs) | (F.array_max(F.transform(fs, lambda f: f["end"])) > F.length(text))
    ordered = let(findings, lambda raw: let(spans.in_order(raw, lambda f: f["start"]), lambda fs: F.when(F.size(fs) == 0, text).when(meets(fs), piled(raw)).otherwise(let(pages(text), lambda ps: apart(fs, ps)))))
    return F.when(findings.isNull(), F.lit(None)).otherwise(ordered)


def replacements(findings: Column) -> Column:
    """``array<struct<value, by>>``: distinct values without white space at their ends, the longest first."""
    rows = F.transform(spans.in_order(findings, lambda f: -F.length(F.coalesce(f["value"], F.lit("")))), lambda f: F.struct(strip(f["value"]).alias("value"), is_full(f).alias("full")))

    def first(rs: Column) -> Column:
        places = F.array_sort(F.transform(rs, lambda r, i: F.struct(r["value"].alias("value"), i.alias("i"))))
        new = let(places, lambda ps: F.filter(ps, lambda p, i: (i == 0) | (p["value"] != F.get(ps, i - 1)["value"])))
        return F.transform(F.array_sort(F.transform(new, lambda p: p["i"])), lambda i: F.get(rs, i))

    kept = let(F.filter(rows, lambda r: F.length(r["value"]) > 0), first)
    return F.transform(kept, lambda r: F.struct(r["value"].alias("value"), F.when(r["full"], FULL_MARK).otherwise(mask_partial(r["value"])).alias("by")))


def redact_values(text: Column, pairs: Column) -> Column:
    """``struct<text, n>``: the text with all occurrences of each value replaced in turn, and their number."""
    start = F.struct(text.alias("text"), F.lit(0).alias("n"))

    def step(acc, p):
        gone = F.replace(acc["text"], p["value"], F.lit(""))
        hits = ((F.length(acc["text"]) - F.length(gone)) / F.length(p["value"])).cast("int")
        return F.struct(F.replace(acc["text"], p["value"], p["by"]).alias("text"), (acc["n"] + hits).alias("n"))

    return F.aggregate(pairs, start, step)


def clamp(box: Column, width: Column, height: Column) -> Column:
    """A box of at least one pixel inside the image."""
    x1, y1 = F.greatest(F.lit(0), F.least(box[0], width - 1)), F.greatest(F.lit(0), F.least(box[1], height - 1))
    return F.array(x1, y1, F.greatest(x1 + 1, F.least(box[2], width)), F.greatest(y1 + 1, F.least(box[3], height)))


def union_box(boxes: Column, width: Column, height: Column) -> Column:
    side = lambda i, f: f(F.transform(boxes, lambda b: b[i]))
    box = F.array(side(0, F.array_min), side(1, F.array_min), side(2, F.array_max), side(3, F.array_max))
    return F.when(F.size(boxes) > 0, clamp(box, width, height))


def part_box(word: Column, start: Column, end: Column, width: Column, height: Column) -> Column:
    """The share of a word's box that some of its characters take, by their number."""
    n, b = F.greatest(F.length(word["text"]), F.lit(1)), word["bbox"]
    wide = b[2] - b[0]
    return clamp(F.array((b[0] + F.floor(wide * start / n)).cast("int"), b[1], (b[0] + F.ceil(wide * end / n)).cast("int"), b[3]), width, height)


def box_offsets(words: Column) -> Column:
    """Where each word starts in the text of all words joined by spaces."""
    return F.transform(words, lambda w, i: F.aggregate(F.slice(words, 1, i), F.lit(0), lambda a, v: a + F.length(F.coalesce(v["text"], F.lit(""))) + 1))


def resolve_box(value: Column, start: Column, words: Column, width: Column, height: Column, share: float = 0.25) -> Column:
    """The image area of a value: inside one word's box (of several the one nearest to ``start``), else over neighbouring boxes; none if over a quarter of the image."""
    low = F.lower(strip(value))
    offsets = box_offsets(words)
    hits = F.transform(words, lambda w, i: F.struct(F.abs(F.get(offsets, i) + F.instr(F.lower(w["text"]), low) - 1 - start).alias("far"), i.alias("i"), part_box(w, F.instr(F.lower(w["text"]), low) - 1, F.instr(F.lower(w["text"]), low) - 1 + F.length(low), width, height).alias("box"), (F.instr(F.lower(w["text"]), low) > 0).alias("hit")))
    single = F.array_sort(F.filter(hits, lambda h: h["hit"]))
    fits = lambda b: (b[2] - b[0]) * (b[3] - b[1]) <= width * height * share
    n = F.size(F.split(low, r"\s+"))

    def window(size: Column) -> Column:
        at = F.transform(words, lambda w, i: F.struct(i.alias("i"), F.slice(words, i + 1, F.greatest(size, F.lit(1))).alias("part")))
        at = F.filter(at, lambda x: (F.size(x["part"]) == size) & (F.instr(F.array_join(F.transform(x["part"], lambda w: F.lower(F.trim(w["text"]))), " "), low) > 0))
        boxes = F.transform(at, lambda x: union_box(F.transform(x["part"], lambda w: w["bbox"]), width, height))
        return F.get(F.filter(boxes, fits), F.lit(0))

    many = F.coalesce(window(n), window(F.greatest(n - 1, F.lit(1))), window(n + 1))
    return F.when(F.length(low) > 0, F.when(F.size(single) > 0, F.when(fits(single[0]["box"]), single[0]["box"])).otherwise(many))


def ocr_summary(words: Column) -> Column:
    """``struct<text, confidence, word_count>`` of recognised lines with scores from 0 to 1; confidence in percent."""
    text = F.array_join(F.transform(words, lambda w: w["text"]), "\n")
    mean = F.aggregate(words, F.lit(0.0), lambda a, w: a + w["score"]) / F.size(words)
    count = F.size(F.filter(F.split(text, r"(?U)\s+"), lambda x: x != ""))
    return F.struct(text.alias("text"), F.when(F.size(words) > 0, F.round(mean * 100, 2)).otherwise(0.0).alias("confidence"), count.alias("word_count"))


def quad_box(quad: Column) -> Column:
    """The upright box around four corners."""
    side = lambda i, f: f(F.transform(quad, lambda p: p[i])).cast("int")
    return F.array(side(0, F.array_min), side(1, F.array_min), side(0, F.array_max), side(1, F.array_max))
