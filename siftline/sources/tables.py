"""Tables of a folder, and intermediate tables."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Bytes up to which a table is dealt to all cores: a small file is one split, whatever work its rows take.
SMALL = 24 << 20
_MADE: list[str] = []


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A Parquet table of ``folder``. Only a table of proven small size is shuffled; a larger one has splits enough."""
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(spark.sparkContext.defaultParallelism) if size <= SMALL else df


def shared_dir(spark: SparkSession) -> str:
    """A new folder that the driver and all executors see.

    It lies under ``spark.checkpoint.dir``. Where that is unset in local mode
    (tests), a local temporary folder becomes the session's checkpoint folder and
    goes when Python ends; on a cluster that is an error.
    """
    context = spark.sparkContext
    base = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not base:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="siftline-")
        atexit.register(shutil.rmtree, base, ignore_errors=True)
        context.setCheckpointDir(base)
        base = context.getCheckpointDir()
    path = f"{base.rstrip('/')}/siftline-{uuid.uuid4().hex}"
    _MADE.append(path)
    return path


def remove_tables(spark: SparkSession) -> None:
    """Removes the intermediate tables that this session has written so far. Results that read them must have been written before."""
    jvm = spark.sparkContext._jvm
    while _MADE:
        path = jvm.org.apache.hadoop.fs.Path(_MADE.pop())
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def materialize(df: DataFrame, name: str = "table", codec: str = "zstd") -> DataFrame:
    """Write a table to the shared folder and read it again.

    Lineage ends at the files, so a lost executor costs no recomputation, and a
    plan that joins the result starts from a scan: adaptive execution can then
    split a skewed partition on either side.
    """
    path = f"{shared_dir(df.sparkSession)}/{name}"
    df.write.option("compression", codec).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
