"""Risk levels of findings, risk scores of documents and compliance verdicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .patterns import FRAMEWORKS, FULL_REDACTION, NAMED_HIGH, RISK_HIGH, RISK_LOW, RISK_MEDIUM, WEIGHTS

HIGH_SCORE, MEDIUM_SCORE = 60, 25
PREVIEW = 100


def _named(names, *columns: Column) -> Column:
    out = F.lit(False)
    for name in names:
        for c in columns:
            out = out | F.contains(c, F.lit(name.lower()))
    return out


def risk_level(kind: Column, label: Column, severity: Column, confidence: Column, validated: Column | None = None, validator: Column | None = None, high: float = 0.8, medium: float = 0.5, rules: dict[str, str] | None = None) -> Column:
    """Level of one finding; the first of the rules that holds decides. Names match as parts of type or label."""
    kind, label = (F.lower(F.coalesce(c, F.lit(""))) for c in (kind, label))
    severity, confidence = F.lower(F.coalesce(severity, F.lit("medium"))), F.coalesce(confidence, F.lit(0.0))
    validator = F.coalesce(validator, F.lit(0.0)) if validator is not None else F.lit(0.0)
    validated = F.coalesce(validated, F.lit(False)) if validated is not None else F.lit(False)
    out = None
    for name, level in (rules or {}).items():
        hit = _named([name], kind, label)
        out = F.when(hit, level.lower()) if out is None else out.when(hit, level.lower())
    first = validated & (validator >= high)
    out = F.when(first, "high") if out is None else out.when(first, "high")
    return (
        out.when(_named(RISK_HIGH, kind, label), "high")
        .when(severity == "high", F.when((confidence >= medium) | (validator >= medium), "high").otherwise("medium"))
        .when(_named(RISK_MEDIUM, kind, label), F.when(confidence >= medium, "medium").otherwise("low"))
        .when(_named(RISK_LOW, kind, label), F.when(confidence >= high, "medium").otherwise("low"))
        .when(confidence >= high, "high")
        .when(confidence >= medium, "medium")
        .otherwise("low")
    )


def at_least(findings: Column, level: str, **options) -> Column:
    """The findings of a level or above: ``high``, or ``medium`` for medium and high ones."""
    of = lambda f: risk_level(f["type"], f["label"], f["severity"], f["confidence"], **options)
    return F.filter(findings, lambda f: of(f).isin(*({"high": ("high",), "medium": ("medium", "high"), "low": ("low", "medium", "high")}[level])))


def distribution(levels: DataFrame, level: str = "risk_level") -> DataFrame:
    """One row with the number of low, medium and high findings."""
    value = F.lower(F.coalesce(level, F.lit("medium")))
    return levels.agg(*[F.count_if(value == x).alias(x) for x in ("low", "medium", "high")])


def assess(findings: Column, high: float = HIGH_SCORE, medium: float = MEDIUM_SCORE, weights: dict[str, float] | None = None) -> Column:
    """Risk assessment of a document's findings, as one struct. All types are weighted by the first finding's severity."""
    table = {**WEIGHTS, **(weights or {})}
    weight = F.create_map(*[F.lit(x) for pair in table.items() for x in pair])
    count = lambda s: F.size(F.filter(findings, lambda f: F.lower(F.coalesce(f["severity"], F.lit("medium"))) == s))
    n_high, n_medium, n_low, n = count("high"), count("medium"), count("low"), F.size(findings)
    by_level = F.map_from_arrays(F.array(F.lit("high"), F.lit("medium"), F.lit("low")), F.array(n_high, n_medium, n_low))
    by_severity = F.least(10 * n_high + 5 * n_medium + 2 * n_low, F.lit(100)).cast("double")
    first = F.lower(F.coalesce(F.get(findings, F.lit(0))["severity"], F.lit("medium")))
    factor = F.when(first == "low", 1).when(first == "high", 3).otherwise(2)
    types = F.array_distinct(F.transform(findings, lambda f: f["type"]))
    counts = F.transform(types, lambda t: F.struct(t.alias("type"), F.size(F.filter(findings, lambda f: f["type"] == t)).alias("n")))
    weighted = F.aggregate(counts, F.lit(0.0), lambda a, c: a + c["n"] * F.coalesce(F.try_element_at(weight, c["type"]), F.lit(1.0)) * factor)
    score = F.when(n == 0, 0.0).otherwise(F.round(F.least(by_severity + F.least(2 * weighted, 100 - by_severity), F.lit(100.0)), 2))
    level = F.when(score >= high, "high").when(score >= medium, "medium").otherwise("low")
    # Types by number; of equal ones the first to appear.
    top = F.transform(F.slice(F.array_sort(F.transform(counts, lambda c, i: F.struct((-c["n"]).alias("k"), i.alias("i"), c["type"].alias("t")))), 1, 5), lambda x: x["t"])
    named = F.array_sort(F.filter(types, lambda t: t.isin(*NAMED_HIGH)))
    detail = (
        F.when(n == 0, "The document contains no entities flagged by the detection pipeline.")
        .when(level == "high", F.when(F.size(named) > 0, F.concat(F.lit("Document contains "), n, F.lit(" sensitive findings including: "), F.array_join(named, ", "))).otherwise("high-risk entities (SSN, credit card, passwords)."))
        .when(level == "medium", F.concat(n, F.lit(" potentially sensitive items detected. Apply partial masking or redaction for names, emails, and phone numbers.")))
        .otherwise("No high-severity sensitive entities were detected.")
    )
    # The wording of the verdicts.
    message = F.when(n == 0, "No sensitive information detected. Document appears safe to share.").when(level == "high", "Do NOT share this document without redaction.").when(level == "medium", "Review recommended before sharing.").otherwise("Document appears safe to share.")
    strategy = F.when(n == 0, F.create_map(F.lit("default"), F.lit("partial"))).otherwise(F.map_from_arrays(types, F.transform(types, redaction_mode)))
    return F.struct(
        score.alias("risk_score"), level.alias("risk_level"), n.alias("total_findings"), n_high.alias("high_risk_count"), n_medium.alias("medium_risk_count"), n_low.alias("low_risk_count"),
        F.map_from_entries(counts).alias("findings_by_type"), by_level.alias("findings_by_severity"), top.alias("category_at_risk"), message.alias("recommendation"), detail.alias("recommendation_detail"), strategy.alias("redaction_strategy"), (level == "low").alias("safe_to_share"),
    )


def redaction_mode(kind: Column) -> Column:
    return F.when(kind.isin(*FULL_REDACTION), "full").otherwise("partial")


def preview(findings: Column, most: int = PREVIEW) -> Column:
    """The findings that a page shows."""
    return F.slice(findings, 1, most)


def compliance(findings: Column) -> Column:
    """Verdict, wording and types concerned for each framework, as a struct of structs."""
    types = F.array_distinct(F.transform(findings, lambda f: f["type"]))
    any_high = F.exists(findings, lambda f: F.lower(F.coalesce(f["severity"], F.lit(""))) == "high")
    out = []
    for name, (triggers, wording) in FRAMEWORKS.items():
        hits = F.array_sort(F.array_intersect(types, F.array(*[F.lit(t) for t in triggers])))
        none, listed = F.size(hits) == 0, F.array_join(hits, ", ")
        status = F.when(none, "Pass").when(any_high, "Fail").otherwise("Review")
        detail = F.when(none, f"No {wording} detected.").when(any_high, F.concat(F.lit(f"High-risk {wording}: "), listed, F.lit("."))).otherwise(F.concat(F.lit(f"Potential {wording}: "), listed, F.lit(".")))
        action = F.when(none, "No compliance action required.").when(any_high, "Redact or remove high-risk fields before sharing.").otherwise("Review findings and apply redaction before external sharing.")
        out.append(F.struct(status.alias("status"), detail.alias("detail"), action.alias("action"), hits.alias("types")).alias(name))
    return F.struct(*out)
