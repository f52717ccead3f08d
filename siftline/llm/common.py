"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.tables import materialize, read_table, remove_tables, shared_dir  # noqa: F401  for the operators and the pipeline

#: A word is a run of characters other than ASCII white space. ``bytes.split()`` cuts at the same six bytes.
WORD = r"[^\x20\x09-\x0D]+"
WHITE = b" \t\n\r\x0b\x0c"


def map_rows(df: DataFrame, rows: Callable[[Iterator[dict]], Iterator[tuple]], schema: str, batch_bytes: int = 16 << 20, batch_rows: int = 10_000) -> DataFrame:
    """``mapInArrow`` for a generator of tuples over dicts, with bounded output batches.

    Strings arrive as UTF-8 ``bytes``. A tuple holds the values of ``schema`` in order.
    """
    target = df.sparkSession.createDataFrame([], schema).schema
    text = [f.name for f in df.schema if f.dataType.typeName() == "string"]

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(target)

        def source():
            for batch in batches:
                names = batch.schema.names
                step = max(1, min(len(batch), 512))
                for at in range(0, len(batch), step):
                    part = batch.slice(at, step)
                    columns = [(c.cast(pa.binary()) if n in text else c).to_pylist() for n, c in zip(names, part.columns, strict=True)]
                    for values in zip(*columns, strict=True):
                        yield dict(zip(names, values, strict=True))

        held, size = [], 0
        for row in rows(source()):
            held.append(row)
            size += sum(map(_bytes, row))
            if len(held) >= batch_rows or size >= batch_bytes:
                yield _batch(held, arrow)
                held, size = [], 0
        if held:
            yield _batch(held, arrow)

    return df.mapInArrow(run, target)


def _bytes(value) -> int:
    """About the bytes of a value: strings count by length, lists by their elements."""
    if isinstance(value, (bytes, str)):
        return len(value)
    if isinstance(value, list):
        return sum(map(_bytes, value)) + 8 * len(value)
    return sum(map(_bytes, value.values())) if isinstance(value, dict) else 8


def _batch(held: list[tuple], arrow: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(v, type=f.type) for v, f in zip(zip(*held, strict=True), arrow, strict=True)], schema=arrow)


def whole_row(df: DataFrame) -> Column:
    """All columns as one struct ``row``, out of the way of added names."""
    return F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row")


def count_words(text: Column) -> Column:
    """Number of words; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


BITMAP_BITS = 26


def _place(key: Column) -> Column:
    return F.xxhash64(key, F.lit(BITMAP_BITS)).bitwiseAND(F.lit((1 << BITMAP_BITS) - 1))


def flagged(rows: DataFrame, key: Column, keys: DataFrame, name: str) -> DataFrame:
    """Adds ``_flag``: true for every row whose ``key`` is among ``keys``'s column ``name``, and by chance for few others.

    The keys go into a bitmap of 2 ** 26 bits, which is broadcast: 8 MiB at
    most, however many keys there are. Rows without the flag need no join.
    """
    place = keys.select(_place(F.col(name)).alias("p"))
    bits = place.groupBy(F.floor(F.col("p") / 32_768).alias("_bucket")).agg(F.bitmap_construct_agg(F.col("p") % 32_768).alias("_bits"))
    bits = materialize(bits.coalesce(8), "bitmap")
    at = _place(key) % 32_768
    marked = rows.join(F.broadcast(bits), F.floor(_place(key) / 32_768) == F.col("_bucket"), "left")
    byte = F.conv(F.hex(F.substring("_bits", F.floor(at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return marked.withColumn("_flag", F.coalesce(F.getbit(byte, (at % 8).cast("int")) == 1, F.lit(False))).drop("_bucket", "_bits")
