"""Model-based detectors as plug-ins: loaded once a worker, fed by batches. Without a model they find nothing."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import spans
from .patterns import ENTITY_HIGH, ENTITY_MEDIUM, ENTITY_TYPES, LABEL_DIGITS, LABEL_HIGH, LABEL_MEDIUM, LABEL_TYPES, VALIDATOR_LABELS

_LOADED: dict[str, object] = {}
THRESHOLD, VALIDATED = 0.50, 0.55


def _model(name: str, load: Callable[[], object]) -> object:
    if name not in _LOADED:
        _LOADED[name] = load()
    return _LOADED[name]


def valid_content(kind: str, value: str) -> bool:
    """Whether a value looks like its type rather than like a label."""
    digits = sum(c.isdigit() for c in value)
    return digits >= LABEL_DIGITS.get(kind, 0) and (kind != "Email" or "@" in value) and (kind != "API Key" or len(value) >= 8)


def mapped(name: Column, table: dict[str, str]) -> Column:
    """The name's entry in a table; itself where it has none."""
    entries = F.create_map(*[F.lit(x) for pair in table.items() for x in pair])
    return F.coalesce(F.try_element_at(entries, name), name)


def entity_type(label: Column) -> Column:
    """The type of a recognizer's label."""
    return mapped(label, ENTITY_TYPES)


def label_type(label: Column) -> Column:
    """The type of an entity model's label."""
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in LABEL_TYPES.items() for x in pair]), F.lower(label)), label)


def validator_label(kind: Column) -> Column:
    """The validator's label that is expected for a type; null for types it does not know."""
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in VALIDATOR_LABELS.items() for x in pair]), kind)


def entity_severity(label: Column) -> Column:
    """Severity of a recognizer's label."""
    return F.when(label.isin(*ENTITY_HIGH), "high").when(label.isin(*ENTITY_MEDIUM), "medium").otherwise("low")


def label_severity(kind: Column) -> Column:
    """Severity of an entity model's type."""
    return F.when(kind.isin(*LABEL_HIGH), "high").when(kind.isin(*LABEL_MEDIUM), "medium").otherwise("low")


def _severity(kind: str) -> str:
    return "high" if kind in LABEL_HIGH else "medium" if kind in LABEL_MEDIUM else "low"


def entity_findings(text: Column, load: Callable[[], Callable[[str, list[str]], list[dict]]] | None, name: str = "entities") -> Column:
    """Findings of a zero-shot entity model: ``load()`` gives ``predict(text, labels)`` that returns start, end, label, score."""
    if load is None:
        return spans.empty(spans.FINDING)

    @F.pandas_udf(f"array<{spans.FINDING}>")
    def find(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        predict = _model(name, load)

        def one(text: str | None) -> list[dict]:
            out, seen = [], set()
            for e in predict(text, list(LABEL_TYPES)) if text else []:
                start, end, label, score = int(e["start"]), int(e["end"]), str(e["label"]), float(e.get("score", 0))
                value = str(e.get("text") or text[start:end]).strip()
                kind = LABEL_TYPES.get(label.lower(), label)
                if score < THRESHOLD or len(value) < 3 or not valid_content(kind, value) or (kind, value, start, end) in seen:
                    continue
                seen.add((kind, value, start, end))
                masked = value[:3] + "***" + (value[-3:] if len(value) > 3 else "")
                near = text[max(0, start - 80) : end + 80].replace("\n", " ")
                out.append({"type": kind, "label": label, "value": value, "masked_value": masked, "severity": _severity(kind), "start": start, "end": end, "line": text.count("\n", 0, start) + 1, "context": near, "engine": "gliner", "confidence": score})
            return out

        for series in texts:
            yield series.map(one)

    return find(text)


def validate(found: DataFrame, load: Callable[[], Callable[[str], list[dict]]] | None, findings: str = "findings") -> DataFrame:
    """Adds ``transformer``: for each finding the validator's confidence and whether it reaches 0.55.

    ``load()`` gives ``predict(context)`` that returns entity and score. The best
    score of the expected label counts, else the best of any. Without a model
    nothing is validated.
    """
    kind = "array<struct<confidence:double,validated:boolean>>"
    if load is None:
        return found.withColumn("transformer", F.transform(findings, lambda f: F.struct(F.lit(None).cast("double").alias("confidence"), F.lit(False).alias("validated"))))

    @F.pandas_udf(kind)
    def score(contexts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        predict = _model("validator", load)

        def one(rows) -> list[dict]:
            out = []
            for r in rows if rows is not None else []:
                text, wanted = r["context"], VALIDATOR_LABELS.get(r["type"])
                hits = predict(text) if text else []
                own = [float(h["score"]) for h in hits if wanted and str(h["entity"]).endswith(wanted)]
                best = max(own or [float(h["score"]) for h in hits] or [0.0])
                out.append({"confidence": best, "validated": best >= VALIDATED})
            return out

        for series in contexts:
            yield series.map(one)

    is_merged = "representative_context" in found.schema[findings].dataType.elementType.names
    field = "representative_context" if is_merged else "context"
    return found.withColumn("transformer", score(F.transform(findings, lambda f: F.struct(f["type"].alias("type"), f[field].alias("context")))))
