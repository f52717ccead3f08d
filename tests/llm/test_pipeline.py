"""The pipeline's stages, each on its own input, and two contracts, against plain Python."""

import random
import re
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pytest

from siftline.llm import mixing, packing, pii, quality
from tests.llm.test_pii import spans
from tests.llm.test_simhash import plain_kept

SF = "/root/testdata/sf0.001"
WORD = r"[^\x20\x09-\x0D]+"
needs_tables = pytest.mark.skipif(not Path(SF).exists(), reason="needs the test tables")


@pytest.fixture(scope="module")
def tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(str(public_tokenizers.path("byte_bpe_50k.json")))


def wanted_pieces(tokenizer, rows, most=2048):
    out = []
    for i, text in rows:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]
        first = len(ids) % most if len(ids) > most else len(ids)
        starts = [0] * (first > 0) + list(range(first, len(ids), most))
        for k, start in enumerate(starts):
            part = ids[start : start + (first if k == 0 and first else most)]
            out.append((i, k, start, len(part), zlib.crc32(np.array(part, "<u4").tobytes())))
    return Counter(out)


def packed_well(rows):
    bins: dict[int, list] = {}
    for r in rows:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for held in bins.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= 2048
    return len(bins)


def test_ids_by_tokenizers(spark, tokenizer):
    rng = random.Random(31)
    parts = ["the", " and", "é", "😀", "\n\n", "<|endoftext|>", "12345", "don't", " ", "\t", "Straße", "αβγ", "x" * 50]
    rows = [(k, "".join(rng.choices(parts, k=rng.randint(0, 60)))) for k in range(150)] + [(200, None), (201, ""), (202, "word " * 9000)]
    got = packing.pack(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    assert Counter(tuple(r[c] for c in ("doc_id", "piece", "start", "length", "ids_crc32")) for r in got) == wanted_pieces(tokenizer, rows)
    assert packed_well(got) <= -(-sum(r["length"] for r in got) // 2048) + 1


def wanted_counts(text):
    words = re.findall(WORD, text or "")
    lines = [x for x in (text or "").split("\n") if re.search(WORD, x)]
    windows = Counter(tuple(words[k : k + 3]) for k in range(len(words) - 2))
    inside = {k + j for k in range(len(words) - 2) if windows[tuple(words[k : k + 3])] > 1 for j in range(3)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(inside)


def test_counts_of_quality_rules(spark):
    rng = random.Random(32)
    parts = ["a", "b", "é", "#", "*x", "$5", "%", "&", "|", "<b>", "\n", " ", "\t", "\x0b", "a b a\n", "\n\n", "A b A", "\x85", "\u2003"]
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 80))) for _ in range(300)] + [None, "", "a b c " * 40, "w " * 30_000]
    docs = spark.createDataFrame([(k, t, "en") for k, t in enumerate(texts)], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([], "doc_id long, quality int")
    for r in quality.quality_rules(docs, labels).collect():
        want = wanted_counts(texts[r["doc_id"]])
        assert tuple(r[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == want
        assert r["base_failed"] == (want[0] < 50 or 100 * want[4] > 50 * want[0]) and r["kept"] == (not r["base_failed"])


@needs_tables
def test_stages(spark, tokenizer):
    import corpus_pipeline

    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "personal_data", "mixing", "packing"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        kept[name] = docs
        docs = corpus_pipeline.materialize(stage(spark, docs, SF), "stage")
        assert name == "packing" or docs.columns == columns
        assert docs.count() > 0
    rows = {name: [r.asDict() for r in df.collect()] for name, df in kept.items()}
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    judged = {r["doc_id"]: r["kept"] for r in quality.quality_rules(kept["quality"], labels).collect()}
    for r in rows["quality"]:
        n, _, _, _, repeats = wanted_counts(r["text"])
        assert not judged[r["doc_id"]] or n >= 50 and 2 * repeats <= n
    assert {r["doc_id"] for r in rows["near_duplicates"]} == {i for i, k in judged.items() if k}
    want, _ = plain_kept([(r["doc_id"], r["text"]) for r in rows["near_duplicates"]])
    assert {r["doc_id"] for r in rows["personal_data"]} == want
    found = {r["doc_id"]: r["spans"] for r in pii.find_pii(kept["personal_data"]).collect()}
    masked = {r["doc_id"]: r for r in rows["mixing"]}
    for r in rows["personal_data"]:
        listed = [x.split(":") for x in found[r["doc_id"]].split(",") if x]
        cuts = sorted((int(a), int(b), k) for k, a, b in listed)
        assert {(k, a, b) for k, a, b in spans(r["text"])} <= {(k, a, b) for a, b, k in cuts}
        out, at = "", 0
        for a, b, k in cuts:
            if a >= at:
                out += r["text"][at:a] + f"[{k.upper()}]"
            at = max(at, b)
        assert masked[r["doc_id"]]["text"] == out + r["text"][at:]
        assert masked[r["doc_id"]]["n_chars"] == len(masked[r["doc_id"]]["text"])
    copies = {r["doc_id"]: r["copies"] for r in mixing.mix(kept["mixing"]).collect()}
    assert Counter(r["doc_id"] for r in rows["packing"]) == Counter({i: n for i, n in copies.items() if n})
    packed = docs.collect()
    assert Counter(tuple(r[c] for c in ("doc_id", "piece", "start", "length", "ids_crc32")) for r in packed) == wanted_pieces(tokenizer, [(r["doc_id"], r["text"]) for r in rows["packing"]])
    packed_well(packed)
