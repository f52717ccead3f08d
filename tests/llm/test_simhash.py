"""Near-duplicates against plain Python that shares no code with the operator."""

import random
import re
from itertools import combinations
from pathlib import Path

import pytest
import xxhash
from pyspark.sql import functions as F

from siftline.llm import simhash

DATA = Path("/root/testdata/sf0.01/documents.parquet")


def words_of(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", low)


def plain_fingerprint(text):
    words = words_of(text)
    if not words:
        return 0
    shingles = [" ".join(words[k : k + 3]) for k in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(nodes, links):
    parent = {n: n for n in nodes}

    def root(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in links:
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    return {n: root(n) for n in nodes}


def edited(rng, text, rate):
    words = text.split()
    for k in range(len(words)):
        if rng.random() < rate:
            words[k] = f"new{rng.randint(0, 10**6)}"
    return " ".join(words)


def corpus(rng, n, length):
    out = []
    while len(out) < n:
        base = " ".join(f"w{rng.randint(0, 5000)}" for _ in range(rng.randint(3, length)))
        out.append(base)
        while rng.random() < 0.7 and len(out) < n:
            out.append(edited(rng, out[-1], rng.choice([0, 0.004, 0.008, 0.02, 0.05])))
    return out


def test_query_from_texts(spark):
    rng = random.Random(21)
    texts = corpus(rng, 250, 200) + [None, "", " \n", "One Two", "one two", "ÉÀ é", "x" * 50_000]
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in simhash.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)).collect()}
    fps = [plain_fingerprint(t) for t in texts]
    roots = plain_components(range(len(texts)), [(i, j) for i, j in combinations(range(len(texts)), 2) if (fps[i] ^ fps[j]).bit_count() <= 2])
    assert got == {k: (f"{fps[k]:016x}", roots[k]) for k in range(len(texts))}


def plain_kept(rows, similarity=0.8):
    """Ids that stay: all pairs of distinct texts that share a shingle are compared with all their shingles."""
    sets: dict[tuple, set] = {}
    ids: dict[tuple, list] = {}
    for i, t in rows:
        words = tuple(words_of(t))
        ids.setdefault(words, []).append(i)
        if words not in sets:
            sets[words] = {words[k : k + 5] for k in range(len(words) - 4)} or ({words} if words else set())
    order = {w: k for k, w in enumerate(sets)}
    where: dict[tuple, list] = {}
    for w, s in sets.items():
        for x in s:
            where.setdefault(x, []).append(w)
    links, pairs = [], {}
    for held in where.values():
        for a, b in combinations(held, 2) if len(held) < 400 else ():
            pairs[order[a], order[b]] = pairs.get((order[a], order[b]), 0) + 1
    names = list(sets)
    for (a, b), both in pairs.items():
        if both >= similarity * (len(sets[names[a]]) + len(sets[names[b]]) - both) - 1e-9:
            links.append((a, b))
    roots = plain_components(range(len(names)), links)
    best: dict[int, int] = {}
    for k, w in enumerate(names):
        best[roots[k]] = min([*ids[w], best.get(roots[k], 1 << 60)])
    return set(best.values()), len(links)


@pytest.mark.parametrize("most", [simhash.SLICE, 300])
def test_kept_rows(spark, most):
    """With slices of 300 shingles nearly every component is cut."""
    rng = random.Random(22)
    rows = list(enumerate(corpus(rng, 300, 120)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    found = {r["doc_id"]: r["root"] for r in simhash.near_classes(docs, most=most).collect()}
    first: dict[int, int] = {}
    for i in sorted(found):
        first.setdefault(found[i], i)
    want, links = plain_kept(rows)
    assert links > 20 and set(first.values()) == want


@pytest.mark.skipif(not DATA.exists(), reason="needs the test tables")
def test_kept_rows_of_documents(spark):
    docs = spark.read.parquet(str(DATA)).select("doc_id", "text")
    want, links = plain_kept([tuple(r) for r in docs.collect()])
    got = {r["doc_id"] for r in simhash.keep_one(docs).collect()}
    assert links > 0 and got == want


def test_blocks_follow_the_number_of_texts():
    assert [simhash.block_bits(n) for n in (0, 1, 2_000_000, 4_000_000, 10**7, 4 * 10**10)] == [12, 12, 12, 13, 15, 27]


@pytest.mark.parametrize("bits", [12, 15, 27])
def test_wide_links_by_block_width(spark, bits):
    rng = random.Random(23)
    base = [[rng.getrandbits(64) for _ in range(4)] for _ in range(30)]
    rows = []
    for b in base:
        rows.append(b)
        for _ in range(3):
            x = list(b)
            for _ in range(rng.randint(0, 30)):
                x[rng.randrange(4)] ^= 1 << rng.randrange(64)
            rows.append(x)
    signed = [[v - (1 << 64) if v >> 63 else v for v in r] for r in rows]
    table = spark.createDataFrame(signed, ", ".join(f"{f} long" for f in simhash.WIDE)).distinct()
    nodes = {r["node"]: tuple(v % (1 << 64) for v in r[:4]) for r in table.select(*simhash.WIDE, simhash._node().alias("node")).collect()}
    key = {v: k for k, v in nodes.items()}
    per = 64 // bits
    cells = lambda x: {(w, k, x[w] >> bits * k & (1 << bits) - 1) for w in range(4) for k in range(per)}
    close = [(key[a], key[b]) for a, b in combinations(key, 2) if sum((p ^ q).bit_count() for p, q in zip(a, b, strict=True)) <= simhash.WIDE_RADIUS and cells(a) & cells(b)]
    for slice_rows in (16_384, 7):
        got = [(r["a"], r["b"]) for r in simhash.wide_links(table, slice_rows=slice_rows, bits=bits).collect()]
        assert plain_components(nodes, got) == plain_components(nodes, close)
    assert table.where(F.lit(False)).count() == 0


@pytest.mark.parametrize("chosen", [12, 15, 32])
def test_candidates_do_not_follow_the_number_of_texts(spark, monkeypatch, chosen):
    """Whatever width would suit the number of texts, those that agree on 12 bits meet. They share no band."""
    monkeypatch.setattr(simhash, "block_bits", lambda n: chosen, raising=False)
    rng = random.Random(24)
    rows = []
    for _ in range(40):
        x = [rng.getrandbits(64) for _ in range(4)]
        rows.append(x)
        rows.append([v ^ sum(1 << b for b in rng.sample(range(64), 10)) for v in x])
    signed = [(k, *(v - (1 << 64) if v >> 63 else v for v in r), [k]) for k, r in enumerate(rows)]
    texts = spark.createDataFrame(signed, "node long, " + ", ".join(f"{f} long" for f in simhash.WIDE) + ", buckets array<long>")
    meet = lambda a, b: any((p ^ q) >> 12 * k & 0xFFF == 0 for p, q in zip(a, b, strict=True) for k in range(5))
    want = {(k, k + 1) for k in range(0, 80, 2) if meet(rows[k], rows[k + 1])}
    got = {tuple(sorted(r)) for r in simhash._candidates(texts, simhash.WIDE_RADIUS).select("a", "b").collect()}
    assert len(want) > 20 and got == want
