"""Media: the store against plain Python, and every value of the result recomputed from the text."""

import hashlib
import random
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from siftline.llm import common, media


def wav(text):
    raw = (text or "").encode()
    raw += b" " * (-len(raw) % 192)
    raw = raw or b" " * 192
    return b"RIFF" + struct.pack("<I", 36 + len(raw)) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, 8000, 8000, 1, 8) + b"data" + struct.pack("<I", len(raw)) + raw


def wanted(doc_id, text):
    stored = wav(text)
    raw = stored[44:]
    x = [b - 128 for b in raw]
    mean, rms = sum(x) / len(x), (sum(v * v for v in x) / len(x)) ** 0.5
    crossings = sum((a >= 0) != (b >= 0) for a, b in zip(x, x[1:], strict=False))
    weight = sum(map(abs, x))
    centroid = sum(k * abs(v) for k, v in enumerate(x)) / weight / len(x) if weight else 0.0
    feature = f"mean={mean:.4f};rms={rms:.4f};crossings={crossings};centroid={centroid:.5f}"
    return doc_id, len((text or "").encode()), len(raw), hashlib.sha256(raw).hexdigest(), zlib.crc32(raw[-16:]), len(stored), hashlib.sha256(stored).hexdigest(), feature


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(8)
    words = [f"word{k}" for k in range(2000)]
    shared = " ".join(rng.choices(words, k=4000))
    out = [None, "", "é😀", "x" * 60_000, shared, shared, "ahead " + shared, shared + " behind"]
    out += [" ".join(rng.choices(words, k=rng.randint(1, 2000))) + (shared if k % 3 == 0 else "") for k in range(40)]
    return list(enumerate(out))


def test_result_from_texts(spark, texts):
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(4)
    assert sorted(tuple(r) for r in media.media_columns(docs).collect()) == sorted(wanted(*r) for r in texts)


def test_store_holds_no_repeats(spark, texts):
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(4)
    lists, kept = media.store(docs, media.shared_bitmap(docs))
    rows, chunks = lists.collect(), {bytes(r["key"]): bytes(r["bytes"]) for r in kept.collect()}
    assert len(chunks) == kept.count() and all(media.digest(b) == d for d, b in chunks.items())
    inline = [bytes(p["digest"]) for r in rows for p in r["parts"] if p["data"] is not None]
    assert len(inline) == len(set(inline)) and not set(inline) & set(chunks)  # each digest's bytes are stored once
    by_id = dict(texts)
    assert len(rows) == len(texts)
    for r in rows:
        assert b"".join(bytes(p["data"]) if p["data"] is not None else chunks[bytes(p["digest"])] for p in r["parts"]) == wav(by_id[r["doc_id"]])
    stored = len(b"".join(chunks.values())) + sum(len(p["data"]) for r in rows for p in r["parts"] if p["data"] is not None)
    assert stored < 0.7 * sum(len(wav(t)) for _, t in texts)
    broken = kept.withColumn("bytes", F.concat("bytes", F.lit(b"x")))
    with pytest.raises(Exception, match="not in the store"):
        media.read_back(lists, broken).collect()
    assert np.all(np.diff(media.cuts(wav("a" * 100_000))) > 0)


def test_tables_go(spark):
    import os

    table = common.materialize(spark.range(3), "gone")
    path = table.inputFiles()[0].removeprefix("file://")
    assert os.path.exists(path)
    common.remove_tables(spark)
    assert not os.path.exists(path)


def test_a_cluster_needs_a_shared_folder():
    class Context:
        master = "spark://host:7077"
        getCheckpointDir = staticmethod(lambda: None)
        getConf = staticmethod(dict)

    class Session:
        sparkContext = Context

    with pytest.raises(ValueError, match=r"spark\.checkpoint\.dir"):
        common.shared_dir(Session)
