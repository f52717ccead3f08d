"""Span algebra over arrays of findings: one array a document, no join between spans."""

from __future__ import annotations

from bisect import bisect_left, insort

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import let, running

FINDING = "struct<type:string,label:string,value:string,masked_value:string,severity:string,start:int,end:int,line:int,context:string,engine:string,confidence:double>"
RANK = {"low": 1, "medium": 2, "high": 3}


def empty(kind: str) -> Column:
    return F.array().cast(f"array<{kind}>")


def severity_rank(severity: Column, default: int = 0) -> Column:
    out = F.lit(default)
    for name, rank in RANK.items():
        out = F.when(severity == name, F.lit(rank)).otherwise(out)
    return out


def derive(df: DataFrame, **columns: Column) -> DataFrame:
    """Adds columns, in place of those of the same name, that are computed once.

    They come out of a generator of one row: the optimizer neither copies a
    generator into several places nor moves filters on its output through it, while
    filters on other columns still go below.
    """
    others = [F.col(f"`{c}`") for c in df.columns if c not in columns]
    made = F.struct(*[c.alias(name) for name, c in columns.items()])
    return df.select(*others, F.inline(F.array(made)))


def overlaps(a: Column, b: Column) -> Column:
    return (a["start"] < b["end"]) & (b["start"] < a["end"])


def in_order(findings: Column, *keys) -> Column:
    """Findings in order of ``keys`` (functions of a finding), then as they came."""

    def ordered(fs: Column) -> Column:
        places = F.array_sort(F.transform(fs, lambda f, i: F.struct(*[k(f).alias(f"k{j}") for j, k in enumerate(keys)], i.alias("i"))))
        return F.transform(places, lambda p: F.get(fs, p["i"]))

    return let(findings, lambda fs: F.when(F.size(fs) < 2, fs).otherwise(ordered(fs)))


def grouped(rows: Column, first: Column, body) -> Column:
    """``body`` of each run of ``rows`` that begins where the array ``first`` is true, put together."""
    starts = F.filter(F.transform(first, lambda b, i: F.when(b, i)), lambda i: i.isNotNull())
    return let(starts, lambda ss: F.transform(ss, lambda s, j: body(F.slice(rows, s + 1, F.coalesce(F.get(ss, j + 1), F.size(rows)) - s))))


def kept_by_cluster(findings: Column, keep) -> Column:
    """The findings that ``keep`` leaves of each run of findings that overlap, perhaps by way of others, in their order.

    ``keep`` gets and returns arrays of ``struct<start, ord, f>``. What does not overlap never meets, so the work follows the
    number of findings as long as they do not pile up.
    """

    def within(fs: Column) -> Column:
        rows = F.transform(F.array_sort(F.transform(fs, lambda f, i: F.struct(f["start"].alias("start"), i.alias("ord")))), lambda p: F.struct(p["start"].alias("start"), p["ord"].alias("ord"), F.get(fs, p["ord"]).alias("f")))

        def cut(rs: Column) -> Column:
            reach = running(F.transform(rs, lambda r: r["f"]["end"]), F.lit(-1), F.greatest)
            first = let(reach, lambda e: F.transform(rs, lambda r, i: r["start"] >= F.get(e, i)))
            left = F.flatten(grouped(rs, first, lambda g: F.when(F.size(g) == 1, g).otherwise(keep(g))))
            return F.transform(F.array_sort(F.transform(left, lambda r: r["ord"])), lambda o: F.get(fs, o))

        return let(rows, cut)

    return let(findings, lambda fs: F.when(F.size(fs) < 2, fs).otherwise(within(fs)))


def without_overlaps(findings: Column, rank=lambda f: severity_rank(f["severity"], 1)) -> Column:
    """Greedy: by rank (the severity), then length, then start, a finding stays if it meets none that stayed."""

    def greedy(rows: Column) -> Column:
        ranked = in_order(rows, lambda r: -rank(r["f"]), lambda r: r["f"]["start"] - r["f"]["end"], lambda r: r["f"]["start"], lambda r: r["ord"])
        return F.aggregate(ranked, F.slice(rows, 1, 0), lambda acc, r: F.when(F.exists(acc, lambda g: overlaps(r["f"], g["f"])), acc).otherwise(F.concat(acc, F.array(r))))

    return kept_by_cluster(findings, greedy)


def by_place(findings: Column) -> Column:
    return in_order(findings, lambda f: f["start"], lambda f: f["type"])


def without_subsumed(findings: Column) -> Column:
    """Drops a finding that lies in one of another type with at least its confidence. Two equal spans drop each other."""
    over = lambda g, f: (g["type"] != f["type"]) & (g["start"] <= f["start"]) & (g["end"] >= f["end"]) & (g["confidence"] >= f["confidence"])
    return kept_by_cluster(findings, lambda rows: F.filter(rows, lambda r: ~F.exists(rows, lambda s: over(s["f"], r["f"]))))


def without_repeats(findings: Column) -> Column:
    """Of findings equal in type, place and value the first."""

    def within(fs: Column) -> Column:
        rows = F.array_sort(F.transform(fs, lambda f, i: F.struct(f["start"].alias("start"), f["end"].alias("end"), f["type"].alias("type"), f["value"].alias("value"), i.alias("ord"))))
        same = lambda a, b: (a["start"] == b["start"]) & (a["end"] == b["end"]) & (a["type"] == b["type"]) & (a["value"] == b["value"])
        first = let(rows, lambda rs: F.filter(rs, lambda r, i: (i == 0) | ~same(r, F.get(rs, i - 1))))
        return F.transform(F.array_sort(F.transform(first, lambda r: r["ord"])), lambda o: F.get(fs, o))

    return let(findings, lambda fs: F.when(F.size(fs) < 2, fs).otherwise(within(fs)))


def confidence_of(f: Column, engines: dict[str, float]) -> Column:
    base = F.lit(0.6)
    for name, value in engines.items():
        base = F.when(F.lower(f["engine"]) == name, F.lit(value)).otherwise(base)
    return F.when(f["confidence"] > 0, F.least(f["confidence"], F.lit(1.0))).otherwise(base)


def consensus(confidences: Column, sources: Column) -> Column:
    """0.7 of the highest and 0.3 of the mean, with a bonus for each further source; decimal ties round up."""
    mean = F.aggregate(confidences, F.lit(0.0), lambda a, x: a + x) / F.size(confidences)
    bonus = F.least(F.lit(0.16), F.lit(0.08) * F.greatest(F.size(sources) - 1, F.lit(0)))
    return F.when(F.size(confidences) == 0, 0.0).otherwise(F.round(F.least(F.lit(1.0), F.array_max(confidences) * 0.7 + mean * 0.3 + bonus), 3))


def anchors_of(kinds: list, values: list, starts: list, ends: list, safe_spans: bool) -> list[int]:
    """For each finding the place of the first earlier anchor of its kind that it overlaps or whose value it repeats; a finding without one is an anchor.

    Anchors of a kind never overlap each other, so those that a finding meets are neighbours in order of place.
    """
    by_value: dict[tuple, int] = {}
    by_start: dict[object, list[tuple[int, int, int]]] = {}
    out = []
    for i, (kind, value, start, end) in enumerate(zip(kinds, values, starts, ends, strict=True)):
        held = by_start.setdefault(kind, [])
        best = None if safe_spans or not value else by_value.get((kind, value))
        k = bisect_left(held, (end,)) - 1
        while k >= 0 and held[k][1] > start:
            best = held[k][2] if best is None else min(best, held[k][2])
            k -= 1
        if best is None:
            best = i
            insort(held, (start, end, i))
            if value:
                by_value.setdefault((kind, value), i)
        out.append(best)
    return out


def clusters(findings: Column, safe_spans: bool = False) -> Column:
    """Findings joined to the first earlier anchor of their type that they overlap or whose value they repeat.

    With ``safe_spans`` a repeated value elsewhere starts its own cluster, so no
    cluster spans the text between repeats. Anchors are found in order in Python, in
    time in proportion to the findings: native folds copy what they hold at each step.
    """

    @F.arrow_udf("array<int>")
    def anchors(kinds: pa.Array, values: pa.Array, starts: pa.Array, ends: pa.Array) -> pa.Array:
        rows = zip(*(c.to_pylist() for c in (kinds, values, starts, ends)), strict=True)
        return pa.array([None if r[0] is None else anchors_of(*r, safe_spans) for r in rows], pa.list_(pa.int32()))

    field = lambda name: F.transform(findings, lambda f: f[name])
    at = anchors(F.transform(findings, lambda f: F.lower(f["type"])), field("value"), field("start"), field("end"))

    def split(rows: Column) -> Column:
        first = F.transform(rows, lambda r, i: (i == 0) | (r["at"] != F.get(rows, i - 1)["at"]))
        return grouped(rows, first, lambda g: F.transform(g, lambda r: F.get(findings, r["i"])))

    return let(F.array_sort(F.transform(at, lambda a, i: F.struct(a.alias("at"), i.alias("i")))), split)


def merged(cluster: Column, engines: dict[str, float]) -> Column:
    """One record of a cluster: the first most confident member speaks for it, the span covers all."""
    scores = F.transform(cluster, lambda f: confidence_of(f, engines))
    sources = F.array_sort(F.array_distinct(F.transform(cluster, lambda f: f["engine"])))
    top = F.array_max(F.transform(cluster, lambda f: severity_rank(F.lower(F.coalesce(f["severity"], F.lit("medium"))))))

    def record(scores: Column, sources: Column) -> Column:
        best = F.get(cluster, (F.array_position(scores, F.array_max(scores)) - 1).cast("int"))
        # Later members of an engine win.
        by_source = F.map_from_arrays(sources, F.transform(sources, lambda s: F.element_at(F.transform(F.filter(cluster, lambda f: f["engine"] == s), lambda f: confidence_of(f, engines)), -1)))
        value = F.coalesce(F.nullif(best["value"], F.lit("")), cluster[0]["value"], F.lit(""))
        tail = F.when(F.length(value) > 3, F.right(value, F.lit(3))).otherwise(F.lit(""))
        score = consensus(scores, sources)
        return F.struct(
            F.coalesce(best["type"], cluster[0]["type"]).alias("type"), value.alias("value"), F.when(value == "", "").otherwise(F.concat(F.left(value, F.lit(3)), F.lit("***"), tail)).alias("masked_value"),
            F.array_min(F.transform(cluster, lambda f: f["start"])).alias("start"), F.array_max(F.transform(cluster, lambda f: f["end"])).alias("end"), F.coalesce(best["line"], cluster[0]["line"]).alias("line"),
            sources.alias("sources"), by_source.alias("source_confidences"), score.alias("confidence"), score.alias("consensus_score"), F.array_max(scores).alias("highest_confidence"), F.size(sources).alias("engines_count"),
            F.when(top == 3, "high").when(top == 2, "medium").when(top == 1, "low").otherwise(F.lower(cluster[0]["severity"])).alias("severity"), F.coalesce(best["context"], cluster[0]["context"]).alias("representative_context"),
        )

    return let(scores, lambda sc: let(sources, lambda so: record(sc, so)))
