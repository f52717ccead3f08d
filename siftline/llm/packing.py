"""Vector best-fit packing of token sequences.

Pieces are packed by length, longest first. A bin has three residual
capacities: tokens, documents and attention cost (the sum of squared lengths).
A piece goes to the bin where it fits under every one of them and where the
weighted norm of what is left is least, or the weighted dot product of piece
and residual is greatest; if it fits nowhere, to a new bin. Bins in the same
state and pieces of one length are handled together, so the plan is made from
the counts by length alone: on the driver, in memory bounded by the lengths and
states, not by the number of documents. A distributed ranking of the pieces of
each length then gives every piece its place in the plan.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import map_rows, materialize, read_table

TOKENIZER = "byte_bpe_50k"


@dataclass(frozen=True)
class Capacity:
    """The defaults for documents and cost follow from 2048 tokens and so never bind before them."""

    tokens: int = 2048
    docs: int = 2048
    cost: int = 2048 * 2048
    weights: tuple[float, float, float] = (1.0, 1e-4, 1e-4)
    rule: str = "norm"


class Encoder:
    """Ids of the byte-level BPE. tiktoken encodes with the ranks that the tokenizers file holds; both give the same ids."""

    _made: dict = {}

    def __init__(self, name: str = TOKENIZER, folder: str | None = None, special: bool = True):
        import base64
        import os

        import public_tokenizers
        import tiktoken

        path = os.path.join(folder, f"{name}.tiktoken") if folder else public_tokenizers.path(f"{name}.tiktoken")
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.special = special
        self.encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={"<|endoftext|>": len(ranks)})

    @classmethod
    def get(cls, *args) -> Encoder:
        if args not in cls._made:
            cls._made[args] = cls(*args)
        return cls._made[args]

    def __call__(self, text: str) -> np.ndarray:
        """Ids as little-endian unsigned 32-bit numbers."""
        return np.frombuffer(self.encoding.encode_to_numpy(text, allowed_special="all" if self.special else set(), disallowed_special=()), dtype="<u4")


def cut(length: int, most: int) -> list[tuple[int, int]]:
    """Start and length of the pieces of a document; only the first may be shorter than ``most``."""
    if length <= most:
        return [(0, length)]
    first = length % most
    return [(0, first)] * bool(first) + [(s, most) for s in range(first, length, most)]


def pieces(docs: DataFrame, most: int, end_id: int = 0, folder: str | None = None) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32`` of every document: its ids, then ``end_id``. A null text is empty."""

    def rows(source):
        encode = Encoder.get(TOKENIZER, folder)
        for r in source:
            ids = np.append(encode((r["text"] or b"").decode()), np.uint32(end_id)).astype("<u4")
            for k, (start, length) in enumerate(cut(len(ids), most)):
                yield r["doc_id"], k, start, length, zlib.crc32(ids[start : start + length].tobytes())

    return map_rows(docs.select(F.col("doc_id").cast("long"), "text"), rows, "doc_id long, piece int, start long, length long, ids_crc32 long")


def plan(counts: dict[int, int], capacity: Capacity = Capacity()) -> np.ndarray:
    """Rows ``length, first rank, number, first bin, offset``: pieces of a length, by rank, go to consecutive bins.

    Bins in one state are kept as ranges of bin numbers; each row splits one off.
    """
    cap = np.array([capacity.tokens, capacity.docs, capacity.cost], float)
    weights = np.array(capacity.weights)
    state = np.zeros((1024, 3))
    ranges: list[list[tuple[int, int]]] = []
    where: dict[tuple, int] = {}
    alive = np.zeros(1024, bool)
    out, bins = [], 0

    def put(key: tuple[int, int, int], first: int, n: int) -> None:
        nonlocal state, alive
        if key not in where:
            where[key] = len(ranges)
            ranges.append([])
            if len(ranges) > len(state):
                state, alive = np.concatenate([state, np.zeros_like(state)]), np.concatenate([alive, np.zeros_like(alive)])
        k = where[key]
        state[k], alive[k] = key, True
        ranges[k].append((first, n))

    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        item = np.array([length, 1, length * length], float)
        if (item > cap).any():
            raise ValueError(f"a piece of {length} tokens fits no bin")
        while left:
            used = state[: len(ranges)]
            rest = cap - used - item
            fits = np.flatnonzero(alive[: len(ranges)] & (rest >= 0).all(axis=1))
            if len(fits):
                score = ((rest[fits] / cap) ** 2 @ weights) if capacity.rule == "norm" else -(((cap - used[fits]) / cap * (item / cap)) @ weights)
                k = int(fits[np.argmin(score)])
                first, n = ranges[k].pop()
                take = min(n, left)
                if take < n:
                    ranges[k].append((first + take, n - take))
                alive[k] = bool(ranges[k])
                offset, was = int(used[k][0]), tuple(used[k].astype(int))
            else:
                per = int(min(cap[0] // length, cap[1], cap[2] // (length * length)))
                take = left if per == 1 else -(-left // per)  # so many bins will do for all pieces of this length
                first, offset, was = bins, 0, (0, 0, 0)
                bins += take
            out.append((length, rank, take, first, offset))
            put((was[0] + length, was[1] + 1, was[2] + length * length), first, take)
            left, rank = left - take, rank + take
    return np.array(out, dtype=np.int64).reshape(-1, 5)


def place(rows: DataFrame, moves: np.ndarray, columns: list[str]) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to rows with ``length`` and ``rank`` (from 0 within a length)."""
    order = np.lexsort((moves[:, 1], moves[:, 0])) if len(moves) else []
    moves = moves[order]
    shared = rows.sparkSession.sparkContext.broadcast(moves)
    schema = rows.select(*columns).schema.add("sequence_id", "long").add("offset", "long")

    def run(batches):
        table = shared.value
        key = table[:, 0] * (1 << 44) + table[:, 1]
        for batch in batches:
            length, rank = (batch.column(c).to_numpy() for c in ("length", "rank"))
            at = np.searchsorted(key, length * (1 << 44) + rank, side="right") - 1
            found = [pa.array(table[at, 3] + rank - table[at, 1]), pa.array(table[at, 4])]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), *found], names=[*columns, "sequence_id", "offset"])

    return rows.mapInArrow(run, schema)


def pack(docs: DataFrame, capacity: Capacity = Capacity(), end_id: int = 0, folder: str | None = None) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32, sequence_id, offset``, a row for each piece.

    A null or empty text is one piece that holds the end id. Null and repeated
    ids are kept, each row packed on its own; repeated rows take different places.
    Pieces of one length are interchangeable, and bins with equal scores are taken
    in order of their making. Texts of any length are encoded whole and cut. No rows
    give no rows. Columns other than doc_id and text are ignored.
    """
    found = materialize(pieces(docs, capacity.tokens, end_id, folder).withColumn("row", F.monotonically_increasing_id()), "pieces")
    counts = {r["length"]: r["count"] for r in found.groupBy("length").count().collect()}  # at most as many as a bin has tokens
    parts = max(8, sum(counts.values()) // 200_000)
    dealt = found.withColumn("part", F.pmod(F.xxhash64("row"), F.lit(parts)))
    sizes = dealt.groupBy(F.col("length").alias("l"), F.col("part").alias("p")).agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("l").orderBy("p").rowsBetween(Window.unboundedPreceding, -1)
    base = materialize(sizes.select("l", "p", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base")), "base")
    ranked = dealt.withColumn("k", F.row_number().over(Window.partitionBy("length", "part").orderBy("row")) - 1)
    ranked = ranked.join(base, (F.col("length") == F.col("l")) & (F.col("part") == F.col("p"))).withColumn("rank", F.col("base") + F.col("k"))
    return place(ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "rank"), plan(counts, capacity), ["doc_id", "piece", "start", "length", "ids_crc32"])


def op8_vector_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read_table(spark, sf_dir, "documents"))
