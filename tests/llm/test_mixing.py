"""Targets and scales against plain Python, and inclusion rates against the odds they should have."""

import random

import numpy as np
from pyspark.sql import functions as F

from siftline.llm import mixing


def wanted_targets(sizes, weights=(1.0, 2.0, 3.0), most=3.0):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    fixed = {}
    while True:
        left, open_ = sum(sizes.values()) - sum(fixed.values()), [s for s in order if s not in fixed]
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = [s for s in open_ if share[s] > most * sizes[s]]
        if not over:
            return fixed | share
        fixed |= {s: most * sizes[s] for s in over}


def test_targets(spark):
    rng = random.Random(1)
    cases = [{"b": 100, None: 100, "a": 100}, {"a": 1000, "b": 10, "c": 0}, {"é": 5, "z": 7, "😀": 9, "￮": 3}]
    cases += [{(None if k == 0 else f"s{k}"): int(10 ** rng.uniform(0, 5)) for k in range(rng.randint(1, 40))} for _ in range(4)]
    for sizes in cases:
        got = {r["key"]: r["target"] for r in mixing.targets(spark.createDataFrame(list(sizes.items()), "source string, size long")).collect()}
        want = wanted_targets(sizes)
        assert got.keys() == want.keys() and all(abs(got[s] - want[s]) <= 1e-6 * (1 + want[s]) for s in want)


def due(sizes, target, half=mixing.HALF, most=mixing.MOST):
    """Words due by document, the scale found by bisection."""
    w = np.ceil(mixing.STEPS * sizes / (sizes + half)) / mixing.STEPS
    low, high = 0.0, most * mixing.STEPS
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if (sizes * np.minimum(w * mid, most)).sum() < target else (low, mid)
    return np.minimum(w * high, most)


def test_inclusion_rates(spark):
    """Documents of 300 sources alike but for their ids: each is taken as often as it is due."""
    rng = np.random.default_rng(2)
    sizes, sources = rng.integers(3, 200, 40), 300
    text = {int(n): " ".join(["w"] * int(n)) for n in sizes}
    rows = [(s * 40 + k, text[int(n)], f"s{s:03d}") for s in range(sources) for k, n in enumerate(sizes)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(docs, weights=(1.0, 3.0)).toPandas()
    got["k"], got["s"] = got.doc_id % 40, got.doc_id // 40
    for odd in (0, 1):
        own = got[got.s % 2 == odd]
        target = own.target.iloc[0]
        assert abs(target - sizes.sum() * (0.5, 1.5)[odd]) < 1e-6
        want = due(sizes.astype(float), target)
        rate = own.groupby("k").copies.mean().to_numpy()
        p = want - np.floor(want)
        assert np.ptp(want) > 0.3  # unequal odds
        assert (np.abs(rate - want) <= 4.5 * np.sqrt(p * (1 - p) / 150) + 0.03).all(), np.abs(rate - want).max()
        taken = own.groupby("s").taken.sum()
        assert (np.abs(taken - target) <= sizes.max() / 2).all()
        assert set(np.unique(own.copies - np.floor(want)[own.k])) <= {0, 1}


def test_all_due_the_most(spark):
    docs = spark.createDataFrame([(k, "w " * n, s) for k, (n, s) in enumerate([(5, "a"), (80, "a"), (9000, "b"), (0, "c")])], "doc_id long, text string, source string")
    got = {r["doc_id"]: (r["taken"], r["target"]) for r in mixing.mix(docs, weights=(100.0, 1.0, 1.0)).collect()}
    assert got[0] == (15, 255.0) and got[1] == (240, 255.0) and got[3] == (0, 0.0)
    assert mixing.mix(docs.where(F.lit(False))).count() == 0
