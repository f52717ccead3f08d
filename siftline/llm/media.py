"""Media columns with content-defined chunking.

A text's UTF-8 bytes, padded with spaces, become 8-bit samples of a WAV. A gear
hash over the last 32 bytes cuts the WAV into chunks. Every medium is stored as
an ordered list of chunks. Digests that occur twice or more are found by
aggregation; their chunks are in the list by digest only, over a store that Spark
joins keep free of repeats. A chunk that occurs once stays beside its digest in
the list, so the bytes that no other medium holds are never shuffled to be
stored. A bitmap of fixed size tells the writers which digests may be shared:
where it errs, a chunk is in the store although it is the only one, and nothing
else changes. Reading joins the lists with the store, puts the chunks in order,
checks each chunk against its digest and the medium against its SHA-256, and only
then computes features.

Digests are counted in a pass of their own, so media are cut twice: to write all
chunks before their digests are counted would write the payload twice.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_rows, materialize, read_table

UNIT = 192
RATE = 8000
HEADER = 44
#: Random numbers of the gear hash, by rule.
GEAR = np.array([int.from_bytes(hashlib.sha256(b"gear%d" % k).digest()[:4], "little") for k in range(256)], dtype=np.uint32)
LEAST, MASK, MOST = 512, (1 << 11) - 1 << 21, 16_384
BITMAP_BITS = 26
META = "doc_id long, n_bytes long, payload_bytes long, media_sha256 string"


def payload(text: bytes | None) -> bytes:
    text = text or b""
    return text.ljust(max(UNIT, -(-len(text) // UNIT) * UNIT), b" ")


def encode(samples: bytes) -> bytes:
    """A mono WAV of 8-bit samples."""
    n = len(samples)
    return struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + n, b"WAVE", b"fmt ", 16, 1, 1, RATE, RATE, 1, 8, b"data", n) + samples


def decode(media: bytes) -> bytes:
    if media[:4] != b"RIFF" or media[36:40] != b"data":
        raise ValueError("not a medium that encode() made")
    return media[HEADER : HEADER + struct.unpack_from("<I", media, 40)[0]]


def cuts(media: bytes, least: int = LEAST, mask: int = MASK, most: int = MOST) -> list[int]:
    """Ends of the chunks: where the gear hash of 32 bytes has no bit of ``mask``, within the size limits."""
    h = GEAR[np.frombuffer(media, np.uint8)]
    for k in (1, 2, 4, 8, 16):
        h[k:] = h[k:] + (h[:-k] << np.uint32(k))
    out, last = [], 0
    for c in (np.flatnonzero((h & np.uint32(mask)) == 0) + 1).tolist():
        while c - last > most:
            last += most
            out.append(last)
        if c - last >= least:
            out.append(c)
            last = c
    while len(media) - last > most:
        last += most
        out.append(last)
    if last < len(media):
        out.append(len(media))
    return out


def chunks(media: bytes) -> list[tuple[bytes, bytes]]:
    """Digest and bytes of each chunk, in order."""
    ends = cuts(media)
    parts = [media[a:b] for a, b in zip([0, *ends], ends, strict=False)]
    return [(digest(p), p) for p in parts]


def digest(part: bytes) -> bytes:
    return hashlib.blake2b(part, digest_size=16).digest()


def feature(samples: bytes) -> str:
    """Level, loudness, zero crossings and centroid of the samples."""
    x = np.frombuffer(samples, np.uint8).astype(np.float64) - 128
    crossings = int(np.count_nonzero((x[1:] >= 0) != (x[:-1] >= 0)))
    weight = np.abs(x).sum()
    centroid = float((np.arange(len(x)) * np.abs(x)).sum() / weight / len(x)) if weight else 0.0
    return f"mean={x.mean():.4f};rms={np.sqrt((x * x).mean()):.4f};crossings={crossings};centroid={centroid:.5f}"


def _row(media: bytes, n_bytes: int, doc_id: int | None, claimed: str) -> tuple:
    found = hashlib.sha256(media).hexdigest()
    if found != claimed:
        raise ValueError(f"medium {doc_id} was not read back as it was stored")
    samples = decode(media)
    return doc_id, n_bytes, len(samples), hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-16:]), len(media), found, feature(samples)


RESULT = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def _input(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long"), "text")


def shared_bitmap(docs: DataFrame) -> np.ndarray:
    """Bit k is 1 if a digest with leading bits k occurs twice. 8 MiB, whatever the input."""

    def rows(source):
        for r in source:
            for name, _ in chunks(encode(payload(r["text"]))):
                yield (name,)

    seen = map_rows(_input(docs), rows, "digest binary").groupBy("digest").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    place = F.conv(F.hex(F.substring("digest", 1, 4)), 16, 10).cast("long").bitwiseAND(F.lit((1 << BITMAP_BITS) - 1))
    marked = seen.select(F.floor(place / 32_768).alias("bucket"), (place % 32_768).alias("bit"))
    out = np.zeros(1 << BITMAP_BITS - 3, np.uint8)
    for r in marked.groupBy("bucket").agg(F.bitmap_construct_agg("bit").alias("bits")).toLocalIterator():
        out[r["bucket"] * 4096 : (r["bucket"] + 1) * 4096] = np.frombuffer(r["bits"], np.uint8)
    return out


def store(docs: DataFrame, bitmap: np.ndarray, seen: int = 100_000) -> tuple[DataFrame, DataFrame]:
    """Writes all media. Returns the chunk lists and the chunk store.

    Lists: a row for each medium with its number ``medium`` and ``parts``, its
    chunks in order: ``digest``, and ``data`` if the chunk is in no store. Store:
    ``key, bytes``, a row for each digest.
    """
    held = docs.sparkSession.sparkContext.broadcast(bitmap)  # of fixed size

    def rows(source):
        bits, mask, sent = held.value, (1 << BITMAP_BITS) - 1, set()
        for r in source:
            text = r["text"] or b""
            media = encode(payload(text))
            listed = []
            for name, part in chunks(media):
                place = int.from_bytes(name[:4], "big") & mask
                shared = bits[place >> 3] >> (place & 7) & 1
                listed.append({"digest": name, "data": None if shared else part})
                if shared and name not in sent:  # a task sends most of its repeats once
                    yield None, None, None, None, None, name, part
                    if len(sent) >= seen:
                        sent.clear()
                    sent.add(name)
            yield r["doc_id"], len(text), len(media) - HEADER, hashlib.sha256(media).hexdigest(), listed, None, None

    written = materialize(map_rows(_input(docs), rows, f"{META}, parts array<struct<digest:binary,data:binary>>, key binary, bytes binary").withColumn("medium", F.monotonically_increasing_id()), "media")
    sent = written.where("key is not null").select("key", "bytes", "medium")
    owners = materialize(sent.groupBy("key").agg(F.min("medium").alias("owner")), "owners").select("owner")
    kept = sent.join(owners, F.col("medium") == F.col("owner"), "left_semi").select("key", "bytes")
    return written.where("key is null").drop("key", "bytes"), materialize(kept, "chunks")


def read_back(lists: DataFrame, kept: DataFrame) -> DataFrame:
    """``RESULT`` for all media, each put together from its list."""

    def rebuilt(source):
        for r in source:
            parts = r["parts"]
            for p in parts:
                if p["data"] is None or digest(p["data"]) != p["digest"]:
                    raise ValueError(f"a chunk of medium {r['doc_id']} is not in the store")
            yield _row(b"".join(p["data"] for p in parts), r["n_bytes"], r["doc_id"], r["media_sha256"].decode())

    meta = ["doc_id", "n_bytes", "media_sha256"]
    whole = ~F.exists("parts", lambda p: p["data"].isNull())
    each = lists.where(~whole).select("medium", *meta, F.posexplode("parts").alias("ord", "p")).select("medium", *meta, "ord", "p.*")
    # Chunks beside their digests go to their medium at once, the others by way of the store.
    found = each.where("data is null").drop("data").join(kept, F.col("digest") == F.col("key"), "left").select("medium", *meta, "ord", "digest", F.col("bytes").alias("data"))
    parts = F.array_sort(F.collect_list(F.struct("ord", "digest", "data"))).alias("parts")
    joined = each.where("data is not null").select(*found.columns).union(found).groupBy("medium", *meta).agg(parts)
    return map_rows(lists.where(whole).select(*meta, "parts"), rebuilt, RESULT).union(map_rows(joined.drop("medium"), rebuilt, RESULT))


def media_columns(docs: DataFrame) -> DataFrame:
    """``RESULT`` for every row of ``docs``, from stored and reconstructed media.

    A null or empty text is 192 spaces. Rows with null or repeated ids are media
    of their own; equal texts share all their chunks, and which copy's bytes the
    store keeps changes nothing. No rows give no rows. Texts of any length are
    stored whole; one medium must fit into a task's memory. Columns other than
    doc_id and text are ignored.
    """
    return read_back(*store(docs, shared_bitmap(docs)))


def op1_media_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_columns(read_table(spark, sf_dir, "documents"))
