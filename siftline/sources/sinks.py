"""Writers: reports as JSON or CSV, rows added to a table, and redacted files."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType


def write_json(report: DataFrame, path: str) -> None:
    report.write.mode("overwrite").json(path)


def write_csv(history: DataFrame, path: str) -> None:
    history.write.mode("overwrite").option("header", "true").csv(path)


def append(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").parquet(path)


@F.pandas_udf(StructType([StructField("path", StringType()), StructField("bytes", LongType()), StructField("error", StringType())]))
def _written(folder: pd.Series, name: pd.Series, content: pd.Series) -> pd.DataFrame:
    from pyarrow import fs

    out = []
    for base, n, data in zip(folder, name, content, strict=True):
        try:
            system, root = fs.FileSystem.from_uri(base if "://" in base else f"file://{base}")
            system.create_dir(root, recursive=True)
            with system.open_output_stream(f"{root.rstrip('/')}/{n}") as target:
                target.write(data)
            out.append((f"{base.rstrip('/')}/{n}", len(data), None))
        except Exception as e:  # one file must not stop the others
            out.append((None, 0, f"{type(e).__name__}: {e}"))
    return pd.DataFrame(out, columns=["path", "bytes", "error"])


def write_files(done: DataFrame, folder: str, name: Column, content: Column) -> DataFrame:
    """Writes a file for each row into a folder that all executors share, when the result is read: path, bytes and error of each.

    Names should differ. A task that runs again writes the same files again.
    """
    safe = F.regexp_replace(name, r"[^A-Za-z0-9._-]", "_")
    return done.select(_written(F.lit(folder), safe, content).alias("w")).select("w.*")
