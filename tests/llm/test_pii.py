"""Personal data: base spans and contexts against plain Python, and texts with very many matches."""

import hashlib
import random
import re
import time

from pyspark.sql import functions as F

from siftline.llm import pii

BASE = (
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    ("card", r"[0-9]([\x20-]?[0-9])+"),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
)


def stands(kind, value):
    digits = [int(c) for c in value if c in "0123456789"]
    if kind == "ip":
        return all(int(p) <= 255 for p in value.split("."))
    if kind == "card":
        odd = sum(digits[-1::-2])
        return 13 <= len(digits) <= 19 and (odd + sum(sum(divmod(2 * d, 10)) for d in digits[-2::-2])) % 10 == 0
    return kind == "email" or 9 <= len(digits) <= 15


def spans(text):
    return [(k, m.start(), m.end()) for k, p in BASE for m in re.finditer(p, text or "") if stands(k, m[0])]


def context(before):
    words = re.split(r"[\x20\x09-\x0D]+", re.sub(r"[\x20\x09-\x0D]+$", "", before))
    out = []
    for w in (["", ""] + words)[-2:]:
        bare = re.sub(r"^[\W_]+|[\W_]+$", "", w.lower())
        marked = re.search(r"@|[0-9][.()-]{0,2}[0-9][.()-]{0,2}[0-9]", w)
        out.append("#" if marked else hashlib.md5(bare.encode()).hexdigest() if len(bare) > 64 else bare)
    return " ".join(out)


def random_text(rng):
    parts = ["a@b.co", "bob.smith@mail.example.com", "10.0.0.1", "300.1.2.3", "1.2.3.4.5.6.7.8", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (204) 555-2971", "+49 30 123456", "card", "No.", "é", "(", ",", ", ", " ", "  ", "\n", "\t", "—", "😀", "x" * 90, "7", "@", "+", "a@b", "00000001.2.3.4", "Straße", "+1 2"]
    return "".join(rng.choice(parts) + rng.choice(["", " ", " "]) for _ in range(rng.randint(0, 40)))


def test_base_spans_and_contexts(spark):
    rng = random.Random(3)
    texts = [random_text(rng) for _ in range(400)] + [None, "", "host addr 10.0.0.1 and more", "pay card 4111111111111111 5500000000000004 now", "word " * 60 + "w" * 300 + " a@b.co", "a@b.co,c@d.co,4111 1111 1111 1111"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    for r in pii.find_pii(df).collect():
        want = spans(texts[r["doc_id"]])
        listed = ",".join(f"{k}:{a}:{b}" for k, a, b in want)
        assert r["base_sha256"] == hashlib.sha256(listed.encode()).hexdigest(), texts[r["doc_id"]]
        assert [r[f"n_{k}"] for k, _ in BASE] == [sum(x[0] == k for x in want) for k, _ in BASE]
    text = F.coalesce(F.col("text"), F.lit(""))
    for r in df.select("text", pii._seeds(text).alias("s"), pii.tokens(text).alias("t")).collect():
        for found in (r["s"], r["t"]):
            assert [x["pattern"] for x in found] == [context(r["text"][: x["start"]]) for x in found], r["text"]
        assert all(r["text"][x["start"] : x["stop"]] == x["value"] for x in [*r["s"], *r["t"]])
    tokens = {r["doc_id"]: [(t["value"], t["pattern"]) for t in r["t"]] for r in df.where("doc_id >= 402").select("doc_id", pii.tokens(text).alias("t")).collect()}
    assert tokens[402] == [("10.0.0.1", "host addr")]
    assert tokens[403] == [("4111111111111111", "pay card"), ("5500000000000004", "card #")]


def test_tokens_apart_from_seeds(spark):
    rng = random.Random(4)
    rows = []
    for k in range(200):
        seeds = [(s, s + rng.randint(1, 9), f"s{s}", "p") for s in rng.sample(range(60), rng.randint(0, 6))]
        rows.append((k, [(s, s + rng.randint(1, 9), f"t{s}", "p") for s in rng.sample(range(60), rng.randint(0, 6))], seeds))
    kind = "array<struct<start:long,stop:long,value:string,pattern:string>>"
    df = spark.createDataFrame(rows, f"id int, t {kind}, s {kind}")
    for r in df.select("id", pii._apart(F.col("t"), F.col("s")).alias("a")).collect():
        _, tokens, seeds = rows[r["id"]]
        assert sorted(x["value"] for x in r["a"]) == sorted(t[2] for t in tokens if not any(s[0] < t[1] and t[0] < s[1] for s in seeds))


def test_very_many_matches_in_one_text(spark):
    """The work follows the length of the text, also where all matches stand in one word: these would take many minutes otherwise."""
    n = 16_000
    texts = [" ".join(f"mail u{k}@x.com" for k in range(n)), ",".join(f"u{k}@x.com" for k in range(n)), " ".join(f"10.0.{k % 250}.1" for k in range(n))]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    began = time.time()
    got = {r["doc_id"]: (r["n_email"], r["n_ip"]) for r in pii.find_pii(df).collect()}
    assert got == {0: (n, 0), 1: (n, 0), 2: (0, n)}
    masked = pii.mask(df.where("doc_id = 1")).first()["text"]
    assert masked == ",".join(["[EMAIL]"] * n)
    assert time.time() - began < 150
