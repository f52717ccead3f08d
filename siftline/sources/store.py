"""The store: tables in folders, changed by part, and the job that keeps a scan's results."""

from __future__ import annotations

import logging
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import catalog
from ..operators.analytics import latest_by
from ..operators.risk import assess, compliance

log = logging.getLogger("siftline")
#: The column that names the file a row belongs to.
OWNER = {"files": "id"}


class Store:
    """Tables below a folder that driver and executors share, each dealt to ``parts`` parts by its file.

    A change rewrites only the parts of the files it concerns: they are read, changed, written
    beside the table, and then put in place by Spark's dynamic partition overwrite. One
    writer at a time; a writer that fails before the last step has changed nothing.
    """

    def __init__(self, spark: SparkSession, path: str, parts: int = 64):
        self.spark, self.path, self.parts = spark, path.rstrip("/"), parts

    def _fs(self, path: str):
        jvm = self.spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), at

    def _there(self, path: str) -> bool:
        fs, at = self._fs(path)
        return fs.exists(at)

    def _part(self, name: str) -> Column:
        return F.pmod(F.xxhash64(F.col(OWNER.get(name, "file_id")).cast("long")), F.lit(self.parts)).cast("int")

    def _dealt(self, name: str) -> DataFrame:
        schema = f"{catalog.SCHEMAS[name]}, part int"
        if not self._there(f"{self.path}/{name}"):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.path}/{name}")

    def read(self, name: str) -> DataFrame:
        return self._dealt(name).drop("part")

    def size(self) -> int:
        """Bytes that the store takes."""
        fs, at = self._fs(self.path)
        return fs.getContentSummary(at).getLength() if fs.exists(at) else 0

    def append(self, name: str, rows: DataFrame) -> None:
        fields = self.spark.createDataFrame([], catalog.SCHEMAS[name]).columns
        whole = catalog.evolve(rows, catalog.SCHEMAS[name]).select(*fields)
        if name in ("logs", "app_settings"):
            whole.withColumn("part", F.lit(0)).write.mode("append").partitionBy("part").parquet(f"{self.path}/{name}")
        else:
            whole.withColumn("part", self._part(name)).write.mode("append").partitionBy("part").parquet(f"{self.path}/{name}")

    def replace(self, name: str, rows: DataFrame, ids: DataFrame) -> None:
        """All rows of the files in ``ids`` (id) go, those of ``rows`` come; a file may end without rows."""
        key, schema = OWNER.get(name, "file_id"), catalog.SCHEMAS[name]
        fields = self.spark.createDataFrame([], schema).columns
        touched = [r["part"] for r in ids.select(F.col("id").alias(key)).select(self._part(name).alias("part")).distinct().collect()]  # at most ``parts``
        old = self._dealt(name).where(F.col("part").isin(touched)) if touched else self._dealt(name).where(F.lit(False))
        left = old.join(ids.select(F.col("id").alias(key)).distinct(), key, "left_anti")
        new = left.select(*fields).unionByName(catalog.evolve(rows, schema).select(*fields)).withColumn("part", self._part(name))
        stage = f"{self.path}/_stage/{name}-{uuid.uuid4().hex}"
        new.write.partitionBy("part").parquet(stage)
        filled = set()
        fs, at = self._fs(stage)
        if any(s.getPath().getName().startswith("part=") for s in fs.listStatus(at)):
            staged = self.spark.read.schema(f"{schema}, part int").parquet(stage)
            filled = {r["part"] for r in staged.select("part").distinct().collect()}
            staged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part").parquet(f"{self.path}/{name}")
        for part in set(touched) - filled:
            fs, at = self._fs(f"{self.path}/{name}/part={part}")
            fs.delete(at, True)
        fs, at = self._fs(stage)
        fs.delete(at, True)

    def clean(self) -> None:
        """Removes staged copies. Results of ``persist_scan`` read them: call it once these have been read."""
        fs, at = self._fs(f"{self.path}/_stage")
        fs.delete(at, True)

    def delete_files(self, ids: DataFrame) -> None:
        """Files and all that belongs to them."""
        for name in ("detections", "ocr_results", "redactions", "files"):
            self.replace(name, self.spark.createDataFrame([], catalog.SCHEMAS[name]), ids)


def persist_scan(store: Store, scanned: DataFrame, at: Column) -> DataFrame:
    """Keeps the results of a scan: files, detections, risk and recognised texts, in four writes for the whole batch.

    ``scanned`` has path, name, format, size, hash, text, findings, and perhaps
    ``source`` (``ocr`` for recognised text) and ``ocr`` (struct of confidence,
    word_count, ocr_language). ``at`` is the time of the scan. Returns path, id, duplicate_of (the
    newest other file with the same content) and the compliance verdicts; these
    read a staged copy of the batch, which ``Store.clean`` removes.
    """
    spark = store.spark
    fixed = scanned.withColumns({"risk": assess(F.col("findings")), "verdicts": compliance(F.col("findings"))})
    for name, kind in (("source", "string"), ("ocr", "struct<confidence:double,word_count:int,ocr_language:string>")):
        fixed = fixed if name in fixed.columns else fixed.withColumn(name, F.lit(None).cast(kind))
    stage = f"{store.path}/_stage/scan-{uuid.uuid4().hex}"
    fixed.write.parquet(stage)
    batch = spark.read.parquet(stage)
    old = store.read("files")
    new = batch.select(
        F.col("name").alias("filename"), F.col("path").alias("file_path"), F.col("size").alias("file_size"), F.col("format").alias("file_format"), at.alias("upload_date"), F.col("hash").alias("file_hash"), F.lit("success").alias("status"),
        F.left("text", F.lit(catalog.PREVIEW)).alias("parsed_content_preview"), F.col("risk.risk_score").alias("risk_score"), F.col("risk.risk_level").alias("risk_level"), F.lit("unclassified").alias("document_classification"),
        F.col("risk.total_findings").alias("total_findings_count"),
    )
    # Types are counted in a map, which cannot be compared: it joins after the paths are unique.
    counts = batch.groupBy(F.col("path").alias("path of counts")).agg(F.max_by("risk.findings_by_type", "hash").alias("entity_type_counts"))
    all_files = catalog.upsert_files(old.select("id", *new.columns), new)
    paths = new.select(F.col("file_path").alias("path now")).distinct()
    kept = old.select("id", *[c for c in old.columns if c not in new.columns and c not in ("id", "entity_type_counts")])
    mine = all_files.join(paths, F.col("file_path") == F.col("path now")).drop("path now").join(counts, F.col("file_path") == F.col("path of counts"), "left").drop("path of counts").join(kept, "id", "left")
    files_stage = f"{store.path}/_stage/files-{uuid.uuid4().hex}"
    mine.write.parquet(files_stage)
    mine = spark.read.parquet(files_stage)
    ids = mine.select("id", "file_path")
    log.info("keeping the scan of %s files", ids.count())
    store.replace("files", mine, ids)
    each = batch.join(ids, F.col("path") == F.col("file_path")).select(F.col("id").alias("file_id"), F.posexplode("findings").alias("pos", "f"))
    rows = catalog.detection_rows(each.select("file_id", "pos", "f.*"), at).withColumn("id", F.xxhash64("file_id", "char_start", "char_end", "entity_type"))
    store.replace("detections", rows, ids)
    read = batch.where("source = 'ocr'").join(ids, F.col("path") == F.col("file_path"))
    ocr = read.select("id", F.col("id").alias("file_id"), F.col("text").alias("extracted_text"), "ocr.*", at.alias("ocr_timestamp"))
    store.replace("ocr_results", ocr, ocr.select("id").distinct())
    same = store.read("files").select(F.col("id").alias("other"), F.col("file_hash").alias("hash of other"), "upload_date")
    twins = mine.select("id", "file_hash").join(same, (F.col("file_hash") == F.col("hash of other")) & (F.col("id") != F.col("other")))
    twin = latest_by(twins.select("id", "other", "upload_date"), "id", "upload_date", "other").select("id", F.col("other").alias("duplicate_of"))
    verdicts = batch.groupBy(F.col("path").alias("file_path")).agg(F.max("verdicts").alias("compliance"))
    return ids.join(twin, "id", "left").join(verdicts, "file_path").select(F.col("file_path").alias("path"), "id", "duplicate_of", "compliance")
