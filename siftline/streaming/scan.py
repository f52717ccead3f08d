"""Arriving text files scanned as a stream: the batch functions on micro-batches.

A batch that runs again overwrites its own folder, so each file counts once for
readers that take finished batches only: those whose folder holds ``_SUCCESS``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.detect import scan
from ..operators.risk import assess
from ..sources.files import decoded


def arriving(spark: SparkSession, path: str, most: int = 1000) -> DataFrame:
    """New files below a path, at most so many in a batch."""
    schema = spark.read.format("binaryFile").load(path).schema
    return spark.readStream.format("binaryFile").schema(schema).option("maxFilesPerTrigger", most).load(path)


def scanned(files: DataFrame) -> DataFrame:
    found = scan(files.select("path", "modificationTime", decoded(F.col("content")).alias("text")), "quick")
    return found.select("path", "modificationTime", "findings", assess(F.col("findings")).alias("risk"))


def start(spark: SparkSession, path: str, out: str, checkpoint: str, most: int = 1000) -> StreamingQuery:
    """Writes a folder for each batch; a batch that runs again overwrites its own."""

    def write(batch: DataFrame, number: int) -> None:
        scanned(batch).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return arriving(spark, path, most).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def finished(spark: SparkSession, out: str) -> DataFrame:
    """The results of all finished batches; a half-written folder is left out."""
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(out)
    fs = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    done = [s.getPath().toString() for s in fs.listStatus(folder) if fs.exists(jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS"))]
    return spark.read.option("basePath", out).parquet(*done)


def risk_by_window(events: DataFrame, time: str = "modificationTime", width: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Files by risk level in windows of arrival; rows later than ``late`` are left out."""
    return events.withWatermark(time, late).groupBy(F.window(time, width), F.col("risk.risk_level").alias("risk_level")).agg(F.count(F.lit(1)).alias("n"))
