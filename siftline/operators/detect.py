"""Detectors and scan modes: a text column becomes an array of findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import PAGE, cut, let, located, luhn, mask_edges, mask_value, pages, running
from . import spans
from .patterns import ENGINE_CONFIDENCE, ENTITY_STRICT, PATTERNS, RECOGNIZER_CONTEXT, RECOGNIZERS, Pattern

MODES = ("quick", "standard", "deep")
#: A match of the pattern with number ``k``.
HIT = "struct<k:int,value:string,start:int,end:int>"


def normalised(text: Column) -> Column:
    """Line ends as line feeds; null as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"\r\n?", "\n")


def matches(text: Column, patterns) -> Column:
    """A struct with an array of ``struct<value, start>`` for each different pattern: texts are searched once however often a pattern serves."""
    searched = {p.regex: p for p in patterns}
    found = lambda p: F.when(text.rlike(f"(?U){p.hint}"), located(text, f"(?U){p.regex}")).otherwise(F.array().cast("array<struct<value:string,start:int>>"))
    return F.struct(*[found(p).alias(f"m{j}") for j, p in enumerate(searched.values())])


def hits(found: Column, patterns, searched) -> Column:
    """``array<HIT>`` of ``patterns`` in order, from ``matches`` of the patterns ``searched``. All patterns with a group end with it, so its start follows from the match's end."""
    places = {regex: f"m{j}" for j, regex in enumerate(dict.fromkeys(p.regex for p in searched))}

    def of(k: int, p: Pattern) -> Column:
        def hit(m: Column) -> Column:
            end = m["start"] + F.length(m["value"])
            value = lambda v: F.struct(F.lit(k).alias("k"), v.alias("value"), (end - F.length(v)).alias("start"), end.alias("end"))
            return let(F.regexp_extract(m["value"], f"(?U){p.regex}", p.group), value) if p.group else value(m["value"])

        return F.filter(F.transform(found[places[p.regex]], hit), lambda h: (F.length(h["value"]) > 0) & (luhn(h["value"]) if p.luhn else F.lit(True)))

    return F.concat(*[of(k, p) for k, p in enumerate(patterns)]).cast(f"array<{HIT}>")


def dressed(text: Column, found: Column, patterns, engine: str) -> Column:
    """Findings of hits: what their pattern says, masked values, lines and contexts."""
    of = lambda name, h: F.get(F.array(*[F.lit(getattr(p, name) or p.type) for p in patterns]), h["k"])
    lines = lambda ps: running(F.transform(ps, lambda p: F.length(p) - F.length(F.replace(p, F.lit("\n"), F.lit("")))), F.lit(0), lambda a, x: a + x)

    def finding(ps: Column, ls: Column, h: Column) -> Column:
        page = F.floor(h["start"] / PAGE).cast("int")
        ahead = F.left(F.get(ps, page), h["start"] - page * PAGE)
        line = F.get(ls, page) + F.length(ahead) - F.length(F.replace(ahead, F.lit("\n"), F.lit(""))) + 1
        near = cut(ps, F.greatest(h["start"] - 80, F.lit(0)), h["end"] + 80)
        near = F.trim(F.regexp_replace(near, r"(?U)\s+", " ")) if engine == "regex" else F.replace(near, F.lit("\n"), F.lit(" "))
        masked = mask_value(h["value"]) if engine == "regex" else mask_edges(h["value"], 2)
        return F.struct(
            of("type", h).alias("type"), of("label", h).alias("label"), h["value"].alias("value"), masked.alias("masked_value"), of("severity", h).alias("severity"), h["start"].alias("start"), h["end"].alias("end"),
            line.alias("line"), near.alias("context"), F.lit(engine).alias("engine"), of("confidence", h).alias("confidence"),
        )

    each = lambda ps, ls: F.transform(found, lambda h: finding(ps, ls, h))
    return F.when(F.size(found) > 0, let(pages(text), lambda ps: let(lines(ps), lambda ls: each(ps, ls)))).otherwise(spans.empty(spans.FINDING))


def _rank(h: Column) -> Column:
    return F.get(F.array(*[F.lit(spans.RANK[p.severity]) for p in PATTERNS]), h["k"])


def _by_type(patterns):
    order = sorted({p.type for p in patterns})
    return lambda h: F.get(F.array(*[F.lit(order.index(p.type)) for p in patterns]), h["k"])


def _quick(text: Column, found: Column, searched) -> Column:
    stay = lambda hs: spans.in_order(spans.without_overlaps(hs, _rank), lambda h: h["start"], _by_type(PATTERNS))
    return let(hits(found, PATTERNS, searched), lambda hs: let(stay(hs), lambda kept: dressed(text, kept, PATTERNS, "regex")))


def _recognized(text: Column, found: Column, searched) -> Column:
    strict = [k for k, p in enumerate(RECOGNIZERS) if (p.label in ENTITY_STRICT and p.confidence < 0.75) or p.label == "URL"]
    own = F.filter(hits(found, RECOGNIZERS, searched), lambda h: ~h["k"].isin(strict) & (F.length(F.trim(h["value"])) >= 3))
    return let(spans.in_order(own, lambda h: h["start"], _by_type(RECOGNIZERS)), lambda kept: dressed(text, kept, RECOGNIZERS, "presidio"))


def pattern_findings(text: Column, p: Pattern, engine: str = "regex") -> Column:
    """Findings of one pattern, by place."""
    return let(matches(text, [p]), lambda m: let(hits(m, [p], [p]), lambda hs: dressed(text, hs, [p], engine)))


def all_findings(text: Column, patterns=PATTERNS, engine: str = "regex") -> Column:
    """Distinct findings of all patterns, in order of pattern and place, overlaps included."""
    return spans.without_repeats(let(matches(text, patterns), lambda m: let(hits(m, patterns, patterns), lambda hs: dressed(text, hs, patterns, engine))))


def regex_findings(text: Column) -> Column:
    """The quick scan: all patterns, greedy without overlaps, by place."""
    return let(matches(text, PATTERNS), lambda m: _quick(text, m, PATTERNS))


def keep_entity(label: Column, score: Column, value: Column) -> Column:
    """Whether a recognizer's finding is kept: no URL, three characters, and a higher score for entities of language models."""
    return (label != "URL") & (F.length(F.trim(value)) >= 3) & (~label.isin(*ENTITY_STRICT) | (score >= 0.75))


def _boosted(found: Column, boost: float) -> Column:
    def raised(f):
        near = F.lit(False)
        for label, words in RECOGNIZER_CONTEXT.items():
            near = near | ((f["label"] == label) & F.lower(f["context"]).rlike("|".join(words)))
        return F.when(near, f.withField("confidence", F.least(F.lit(1.0), f["confidence"] + boost))).otherwise(f)

    return F.transform(found, raised) if boost else found


def recognizer_findings(text: Column, boost: float = 0.0) -> Column:
    """Pattern recognizers, by place. ``boost`` raises a score where a context word stands near; an approximation, off by default."""
    return _boosted(let(matches(text, RECOGNIZERS), lambda m: _recognized(text, m, RECOGNIZERS)), boost)


def aggregate(findings: Column, safe_spans: bool = False) -> Column:
    """The findings of several detectors, in a column, as merged records, subsumed ones dropped."""
    joined = F.transform(spans.clusters(findings, safe_spans), lambda c: spans.merged(c, ENGINE_CONFIDENCE))
    return spans.without_subsumed(spans.by_place(joined))


def aggregate_facts(groups: dict[str, Column], merged: Column) -> Column:
    """``struct<total_inputs, by_engine, total_merged>``: what went into ``aggregate`` and came out. A group is named by its first finding's detector, an empty one by its place."""
    sizes = [F.struct(F.coalesce(F.get(g, F.lit(0))["engine"], F.lit(f"engine_{j}")).alias("key"), F.size(g).alias("value")) for j, g in enumerate(groups.values())]
    return F.struct(sum((F.size(g) for g in groups.values()), F.lit(0)).alias("total_inputs"), F.map_from_entries(F.array(*sizes)).alias("by_engine"), F.size(merged).alias("total_merged"))


def scan(docs: DataFrame, mode: str = "quick", text: str = "text", extra: str | None = None, safe_spans: bool = False, validator=None) -> DataFrame:
    """Adds ``findings``, and for the fuller modes the findings of each detector, in place of columns of these names.

    ``quick`` runs the patterns; ``standard`` merges them with the recognizers
    and with a column ``extra`` of model findings if there is one; ``deep``
    also validates the merged findings by a model that ``validator`` loads
    (models.validate), and adds ``transformer``: without a model nothing is
    validated, and findings stay, as each has a detector behind it.
    """
    if mode not in MODES:
        raise ValueError(f"unsupported scan mode: {mode}")
    clean = lambda body: let(normalised(F.col(text)), body)
    if mode == "quick":
        return spans.derive(docs, findings=clean(regex_findings))
    searched = (*PATTERNS, *RECOGNIZERS)
    both = clean(lambda t: let(matches(t, searched), lambda m: F.struct(_quick(t, m, searched).alias("r"), _recognized(t, m, searched).alias("p"))))
    model = F.coalesce(F.col(extra), spans.empty(spans.FINDING)) if extra else spans.empty(spans.FINDING)
    found = spans.derive(docs, findings=both)
    found = spans.derive(found, regex_findings=F.col("findings.r"), recognizer_findings=F.col("findings.p"), findings=F.concat(F.col("findings.r"), model, F.col("findings.p")))
    found = spans.derive(found, findings=aggregate(F.col("findings"), safe_spans))
    if mode == "standard":
        return found
    from .models import validate

    checked = validate(found, validator)
    keep = F.filter("findings", lambda f, i: F.get(F.col("transformer"), i)["validated"] | (f["engines_count"] > 0))
    pairs = F.filter("transformer", lambda t, i: t["validated"] | (F.get(F.col("findings"), i)["engines_count"] > 0))
    return spans.derive(checked, findings=keep, transformer=pairs)


def confidence_breakdown(found: DataFrame, findings: str = "findings") -> DataFrame:
    """Findings by detector with mean confidences; a merged finding counts once for each of its sources.

    ``transformer`` counts findings that a validator judged, if there is one, and
    those it validated; its mean is null where there is none. The patterns have no mean.
    """
    each = found.select(F.explode(findings).alias("f")).select(F.explode("f.source_confidences").alias("source", "confidence"))
    sums = each.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("confidence"), 6).alias("mean"), F.lit(None).cast("long").alias("valid"))
    if "transformer" in found.columns:
        judged = found.select(F.explode("transformer").alias("t")).select("t.*").where("confidence is not null")
        one = judged.agg(F.lit("transformer").alias("source"), F.count(F.lit(1)).alias("n"), F.round(F.avg("confidence"), 6).alias("mean"), F.count_if("validated").alias("valid"))
        sums = sums.union(one)
    names = F.explode(F.array(*[F.lit(x) for x in ("regex", "gliner", "presidio", "transformer")])).alias("source")
    mean = F.when(F.col("source") == "transformer", F.col("mean")).when(F.col("source") != "regex", F.coalesce("mean", F.lit(0.0)))
    out = found.sparkSession.range(1).select(names).join(sums, "source", "left")
    return out.select("source", F.coalesce("n", F.lit(0)).alias("count"), mean.alias("avg_confidence"), F.when(F.col("source") == "transformer", F.coalesce("valid", F.lit(0))).alias("validated"))


def exploded(found: DataFrame, key: str, findings: str = "findings") -> DataFrame:
    """A row for each finding, with its place in the document's list."""
    return found.select(key, F.posexplode(findings).alias("pos", "f")).select(key, "pos", "f.*")
