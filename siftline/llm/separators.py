"""Token counts by scanning flat token files for the end-of-document id.

A token file is a run of 16-bit ids without an index, held as blocks of fixed
size. Each block is searched with numpy; documents that cross blocks are
stitched by an exclusive prefix scan over the blocks' summaries, in two levels,
so that no file's blocks meet in one task.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import map_rows, materialize, read_table
from .packing import TOKENIZER, Encoder

END, BLOCK, SPAN = 50_256, 65_536, 1024


def write_tokens(docs: DataFrame, block: int = BLOCK, end_id: int = END, folder: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Token files of ``docs``, one for each input partition: blocks ``file, block, data``, and the order of documents ``file, ordinal, doc_id``.

    The end id follows each document and occurs nowhere else. A null text has no tokens.
    """

    def rows(source):
        from pyspark import TaskContext

        encode, file = Encoder.get(TOKENIZER, folder, False), TaskContext.get().partitionId()
        held, size, k, ordinal = [], 0, 0, 0
        for r in source:
            ids = np.append(encode((r["text"] or b"").decode()), end_id).astype("<u2")
            yield file, None, None, ordinal, r["doc_id"]
            ordinal += 1
            held.append(ids)
            size += len(ids)
            if size >= block:
                flat = np.concatenate(held)
                full = size // block * block
                for at in range(0, full, block):
                    yield file, k, flat[at : at + block].tobytes(), None, None
                    k += 1
                held, size = [flat[full:]], size - full
        if size:
            yield file, k, np.concatenate(held).tobytes(), None, None

    written = materialize(map_rows(docs.select(F.col("doc_id").cast("long"), "text"), rows, "file int, block long, data binary, ordinal long, doc_id long"), "tokens")
    return written.where("block is not null").select("file", "block", "data"), written.where("ordinal is not null").select("file", "ordinal", "doc_id")


def _before(rows: DataFrame, value: str, how, zero: int, combine) -> Column | DataFrame:
    """Adds ``before_<value>``: the aggregate over all earlier blocks of the file, in two levels."""
    inner = Window.partitionBy("file", "span").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    outer = Window.partitionBy("f").orderBy("s").rowsBetween(Window.unboundedPreceding, -1)
    spans = rows.groupBy(F.col("file").alias("f"), F.col("span").alias("s")).agg(how(value).alias("whole"))
    spans = spans.select("f", "s", F.coalesce(how("whole").over(outer), F.lit(zero)).alias("earlier"))
    near = rows.withColumn("near", F.coalesce(how(value).over(inner), F.lit(zero)))
    return near.join(spans, (F.col("file") == F.col("f")) & (F.col("span") == F.col("s"))).withColumn(f"before_{value}", combine(F.col("near"), F.col("earlier"))).drop("near", "earlier", "f", "s")


def scan(blocks: DataFrame, end_id: int = END, dtype: str = "<u2") -> DataFrame:
    """``file, ordinal, n_tokens, ended`` of each document in files of ``blocks`` (file, block, data).

    Tokens behind a file's last separator are a document with ``ended`` false;
    two separators in a row hold a document without tokens between them. Blocks
    may differ in size; a null or empty block has no tokens.
    """

    def rows(source):
        for r in source:
            ids = np.frombuffer(r["data"] or b"", dtype)
            at = np.flatnonzero(ids == end_id)
            head = int(at[0]) if len(at) else 0
            tail = int(len(ids) - at[-1] - 1) if len(at) else len(ids)
            yield r["file"], r["block"], len(ids), len(at), int(at[-1]) + 1 if len(at) else 0, head, tail, (np.diff(at) - 1).tolist()

    found = materialize(map_rows(blocks, rows, "file int, block long, tokens long, ends long, last long, head long, tail long, inner array<long>"), "blocks")
    summary = found.select("file", "block", F.floor(F.col("block") / SPAN).alias("span"), "tokens", "ends", "last", "head", "tail")
    summary = _before(_before(summary, "tokens", F.sum, 0, lambda a, b: a + b), "ends", F.sum, 0, lambda a, b: a + b)
    summary = summary.withColumn("reach", F.when(F.col("ends") > 0, F.col("before_tokens") + F.col("last")).otherwise(F.lit(0)))
    summary = materialize(_before(summary, "reach", F.max, 0, F.greatest), "summary")
    carried = F.col("before_tokens") - F.col("before_reach")
    first = summary.where("ends > 0").select("file", F.col("before_ends").alias("ordinal"), (carried + F.col("head")).alias("n_tokens"), F.lit(True).alias("ended"))
    places = summary.select(F.col("file").alias("f"), F.col("block").alias("b"), "before_ends")
    inner = found.where("size(inner) > 0").join(places, (F.col("file") == F.col("f")) & (F.col("block") == F.col("b"))).select("file", "before_ends", F.posexplode("inner"))
    inner = inner.select("file", (F.col("before_ends") + F.col("pos") + 1).alias("ordinal"), F.col("col").alias("n_tokens"), F.lit(True).alias("ended"))
    over = summary.groupBy("file").agg(F.sum("ends").alias("ordinal"), (F.sum("tokens") - F.max("reach")).alias("n_tokens")).where("n_tokens > 0").select("file", "ordinal", "n_tokens", F.lit(False).alias("ended"))
    return first.union(inner).union(over)


def token_counts(docs: DataFrame, block: int = BLOCK, folder: str | None = None) -> DataFrame:
    """``doc_id, n_tokens`` of every row of ``docs``, counted by scanning its token files.

    A null or empty text has 0 tokens; null and repeated ids are kept; no rows
    give no rows. Repeated rows are documents of their own, texts of any length are
    written whole over as many blocks as they take, and there are no ties to
    break. Columns other than doc_id and text are ignored.
    """
    blocks, order = write_tokens(docs, block, folder=folder)
    found = materialize(scan(blocks), "documents").select(F.col("file").alias("f"), F.col("ordinal").alias("o"), "n_tokens")
    return order.join(found, (F.col("file") == F.col("f")) & (F.col("ordinal") == F.col("o"))).select("doc_id", "n_tokens")


def op2_separator_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(read_table(spark, sf_dir, "documents"))
