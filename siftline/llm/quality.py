"""Quality rules with risk-controlled cutoffs.

Every rule scores a document in [0, 1]; a document whose score reaches the
rule's cutoff is rejected. Cutoffs come from labelled holdout documents. For a
stratum and a rule, cutoffs are tested from the most lenient to stricter ones:
a cutoff is certified if the exact (Clopper-Pearson) upper bound of its false
rejection rate is at most ``alpha`` divided by the number of rules. Testing
stops at the first that fails (a fixed sequence needs no correction among its
cutoffs), and ``delta`` is divided by the number of sequences (Bonferroni), so
with probability ``1 - delta`` no stratum loses by the cutoffs more than ``alpha`` of
those good documents that pass the base rules. Documents that the base rules
reject are no part of the holdout, and the bound says nothing of them. Of the certified cutoffs, the one that takes most bad documents
over good ones is used; where none takes more bad than good ones, the rule
rejects nothing there.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WHITE, map_rows, materialize, read_table

STRATA = ("de", "en", "es", "fr")
OTHER = "other"
SYMBOLS = b"#*$%&|<>"
CAPITALS = bytes(range(65, 91))
CONTINUATION = bytes(range(0x80, 0xC0))
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_capitals")
RULES = {"symbols": ("n_symbols", "word_chars"), "repeats": ("n_repeat_words", "n_words"), "dup_lines": ("n_dup_lines", "n_lines"), "capitals": ("n_capitals", "word_chars")}
STEPS = 200


@dataclass(frozen=True)
class Risk:
    """``alpha``: most good documents past the base rules that a stratum may lose by cutoffs; ``delta``: chance that any loses more."""

    alpha: float = 0.08
    delta: float = 0.05
    steps: int = STEPS
    min_words: int = 50
    max_repeat_percent: int = 50


def counts(text: bytes | None) -> tuple[int, ...]:
    """``COUNTS`` of a UTF-8 text; null counts as empty."""
    text = text or b""
    words = text.split()
    bare = text.translate(None, WHITE)
    seen, duplicates, lines = set(), 0, 0
    for line in text.split(b"\n"):
        if line.strip():
            lines += 1
            duplicates += line in seen
            seen.add(line)
    return len(words), len(bare.translate(None, CONTINUATION)), len(text) - len(text.translate(None, SYMBOLS)), duplicates, repeat_words(words), lines, len(text) - len(text.translate(None, CAPITALS))


def repeat_words(words: list[bytes], width: int = 3) -> int:
    """Number of words in windows of ``width`` words that occur at least twice."""
    windows = list(zip(*(words[k:] for k in range(width)), strict=False))
    found = Counter(windows)
    if len(found) == len(windows):
        return 0
    total = done = 0
    for k, window in enumerate(windows):
        if found[window] > 1:
            total += k + width - max(k, done)
            done = k + width
    return total


def features(docs: DataFrame) -> DataFrame:
    """``doc_id, stratum`` and ``COUNTS`` of every row."""

    def rows(source):
        for r in source:
            yield r["doc_id"], (r["lang"] or b"").decode(), *counts(r["text"])

    lang = F.col("lang") if "lang" in docs.columns else F.lit(None).cast("string")
    found = map_rows(docs.select(F.col("doc_id").cast("long"), "text", lang.cast("string").alias("lang")), rows, "doc_id long, stratum string, " + ", ".join(f"{c} long" for c in COUNTS))
    return found.withColumn("stratum", F.when(F.col("stratum").isin(*STRATA), F.col("stratum")).otherwise(OTHER))


def base_failed(risk: Risk) -> Column:
    return (F.col("n_words") < risk.min_words) | (100 * F.col("n_repeat_words") > risk.max_repeat_percent * F.col("n_words"))


def step_of(rule: str, risk: Risk) -> Column:
    part, whole = RULES[rule]
    return F.least(F.lit(risk.steps), F.floor(F.col(part) * risk.steps / F.greatest(F.col(whole), F.lit(1)))).cast("int")


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function, by Lentz's method."""
    tiny = 1e-300
    c, d = 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    out = d
    for m in range(1, 200_000):
        for t in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + t * d
            d = 1 / (d if abs(d) > tiny else tiny)
            c = 1 + t / c
            c = c if abs(c) > tiny else tiny
            out *= d * c
        if abs(d * c - 1) < 1e-14:
            break
    return out


def binomial_cdf(k: int, n: int, p: float) -> float:
    """P(X <= k) of a binomial variable, exact to rounding."""
    if k >= n:
        return 1.0
    if k < 0:
        return 0.0
    a, b, x = n - k, k + 1, 1 - p  # the regularised incomplete beta function I_x(a, b)
    if x <= 0 or x >= 1:
        return float(x >= 1)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    if x < (a + 1) / (a + b + 2):
        return front * _beta_fraction(a, b, x) / a
    return 1 - front * _beta_fraction(b, a, 1 - x) / b


def upper_bound(k: int, n: int, delta: float) -> float:
    """Clopper-Pearson upper bound of a rate with ``k`` events in ``n`` trials, at level ``delta``."""
    if k >= n:
        return 1.0
    low, high = k / n, 1.0
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if binomial_cdf(k, n, mid) > delta else (low, mid)
    return high


def choose_cutoff(good: dict[int, int], bad: dict[int, int], alpha: float, delta: float, steps: int) -> int:
    """The least rejected step; ``steps + 1`` rejects nothing. ``good``, ``bad``: holdout documents by step."""
    n, best, cutoff, lost, caught = sum(good.values()), 0, steps + 1, 0, 0
    for c in range(steps, -1, -1):
        lost, caught = lost + good.get(c, 0), caught + bad.get(c, 0)
        if not n or binomial_cdf(lost, n, alpha) > delta:  # the bound is above alpha
            break
        if caught - lost > best:
            best, cutoff = caught - lost, c
    return cutoff


def learn_cutoffs(found: DataFrame, labels: DataFrame, risk: Risk = Risk()) -> dict[tuple[str, str], int]:
    """Cutoff by stratum and rule, from all labelled documents that pass the base rules.

    A document labelled several times counts as good if all its labels say so;
    null ids and labels are left out. Only counts by stratum, rule, step and
    label come to the driver: a bounded number, whatever the input.
    """
    truth = labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").alias("label_id")).agg(F.min("quality").alias("good"))
    seen = found.where(~base_failed(risk)).join(truth, F.col("doc_id") == F.col("label_id"))
    steps = F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), step_of(r, risk).alias("step")) for r in RULES]))
    table = seen.select("stratum", (F.col("good") == 1).alias("good"), steps.alias("s")).groupBy("stratum", "good", "s.rule", "s.step").agg(F.count(F.lit(1)).alias("n")).collect()
    by: dict[tuple, dict[int, int]] = {}
    for r in table:
        by.setdefault((r["stratum"], r["rule"], r["good"]), {})[r["step"]] = r["n"]
    delta = risk.delta / (len(RULES) * (len(STRATA) + 1))
    return {(s, r): choose_cutoff(by.get((s, r, True), {}), by.get((s, r, False), {}), risk.alpha / len(RULES), delta, risk.steps) for s in (*STRATA, OTHER) for r in RULES}


def rejected(cutoffs: dict[tuple[str, str], int], risk: Risk) -> Column:
    """Whether the method rejects a row of ``features``."""
    out = F.lit(False)
    for (stratum, rule), c in sorted(cutoffs.items()):
        if c <= risk.steps:
            out = out | ((F.col("stratum") == stratum) & (step_of(rule, risk) >= c))
    return out


def quality_rules(docs: DataFrame, labels: DataFrame, risk: Risk = Risk()) -> DataFrame:
    """``doc_id``, the counts, ``base_failed`` and ``kept`` for every row of ``docs``.

    A null or empty text has no words and fails the base rules. Rows with a
    null or repeated ``doc_id`` are judged each on its own. Without labels no
    cutoff is certified and the base rules alone decide. Repeated rows are judged
    alike, of cutoffs that take equally many the most lenient is used, texts of any
    length count whole. No rows give no rows. Columns of ``docs`` other than doc_id, text and lang are ignored.
    """
    found = materialize(features(docs), "features")
    cutoffs = learn_cutoffs(found, labels, risk)
    failed = base_failed(risk)
    return found.select("doc_id", *COUNTS[:5], failed.alias("base_failed"), (~failed & ~rejected(cutoffs, risk)).alias("kept"), "stratum")


def keep_good(docs: DataFrame, labels: DataFrame, risk: Risk = Risk()) -> DataFrame:
    """The rows of ``docs``, with all their columns, that ``quality_rules`` keeps. Nothing is shuffled but counts.

    Null and empty texts, null and repeated ids, ties, very long texts and missing
    labels are judged as there; no rows give no rows. Words are counted twice, to
    learn and to apply: to join counts with rows would shuffle whole texts.
    """
    cutoffs = learn_cutoffs(materialize(features(docs), "features"), labels, risk)

    def step(rule: str, c: dict) -> int:
        part, whole = RULES[rule]
        return min(risk.steps, int(c[part] * risk.steps / max(c[whole], 1)))

    def good(text: bytes | None, lang: str | None) -> bool:
        c = dict(zip(COUNTS, counts(text), strict=True))
        if c["n_words"] < risk.min_words or 100 * c["n_repeat_words"] > risk.max_repeat_percent * c["n_words"]:
            return False
        stratum = lang if lang in STRATA else OTHER
        return not any(step(r, c) >= cutoffs[stratum, r] for r in RULES)

    def run(batches):
        for batch in batches:
            texts = batch.column("text").cast(pa.binary())
            langs = batch.column("lang") if "lang" in batch.schema.names else [None] * len(batch)
            yield batch.filter(pa.array([good(t.as_py(), x.as_py() if x is not None else None) for t, x in zip(texts, langs, strict=True)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))
