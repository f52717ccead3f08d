"""Tables of files, detections, logs, recognised texts, redactions and settings: schemas, and changes as new tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import entity_hash, mask_tracked, setting_value
from .analytics import numbered

SCHEMAS = {
    "files": "id long, filename string, file_path string, file_size long, file_format string, upload_date timestamp, file_hash string, status string, error_message string, parsed_content_preview string, risk_score double, risk_level string, document_classification string, redacted_version_path string, redaction_strategy string, total_findings_count int, entity_type_counts map<string,int>, post_redaction_risk_score double, post_redaction_risk_level string, post_redaction_findings_count int",
    "detections": "id long, file_id long, detection_type string, pattern_matched string, data_found string, location_info string, risk_level string, detection_timestamp timestamp, entity_type string, entity_hash string, char_start int, char_end int, confidence double, entity_value string",
    "logs": "id long, log_level string, message string, source string, log_timestamp timestamp",
    "ocr_results": "id long, file_id long, extracted_text string, confidence double, preprocessing_steps array<string>, word_count int, ocr_timestamp timestamp, ocr_language string, validation_tier string, confidence_breakdown string, word_boxes array<struct<text:string,bbox:array<int>>>",
    "redactions": "id long, file_id long, redaction_type string, entity_type string, mode string, strategy string, output_path string, findings_redacted int, redaction_timestamp timestamp",
    "app_settings": "key string, value string, updated_at timestamp",
}
#: Settings that hold where none is stored.
DEFAULT_SETTINGS = {"default_scan_mode": "standard", "default_redaction_strategy": "blackout", "default_redaction_mode": "auto", "redaction_output_dir": "", "reload_session_on_startup": "true", "rescan_after_redaction": "true"}
PREVIEW = 500


def empty_table(spark: SparkSession, name: str) -> DataFrame:
    return spark.createDataFrame([], SCHEMAS[name])


def evolve(df: DataFrame, schema: str) -> DataFrame:
    """Adds columns that a schema has and the table lacks, as nulls; others stay."""
    have = set(df.columns)
    wanted = df.sparkSession.createDataFrame([], schema).schema
    return df.withColumns({f.name: F.lit(None).cast(f.dataType) for f in wanted if f.name not in have})


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``new`` replace those of ``old`` with the same keys."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new, allowMissingColumns=True)


def upsert_files(files: DataFrame, new: DataFrame) -> DataFrame:
    """A known path keeps its id and takes the new values; an unknown one gets an id above all others, in order of path.

    Paths are unique: of several new rows of one path the greatest stays, compared column by column in the order of ``new``.
    """
    fields = [c for c in new.columns if c != "id"]
    one = new.groupBy(F.col("file_path").alias("path_")).agg(F.max(F.struct(*fields)).alias("new_")).select("new_.*")
    known = files.select(F.col("file_path").alias("path_"), F.col("id").alias("id_"))
    joined = one.join(known, F.col("file_path") == F.col("path_"), "left")
    same = joined.where("id_ is not null").select(F.col("id_").alias("id"), *fields)
    top = files.agg(F.coalesce(F.max("id"), F.lit(0)).alias("id")).first()["id"]  # one row
    fresh = numbered(joined.where("id_ is null").select(*fields), ["file_path"], start=top + 1)
    return upsert(files, same.unionByName(fresh), ["file_path"])


def replace_children(old: DataFrame, new: DataFrame, files: DataFrame, key: str = "file_id") -> DataFrame:
    """All rows of the files given go, the new ones come; a file may end without rows."""
    return old.join(files.select(F.col("id").alias(key)), key, "left_anti").unionByName(new, allowMissingColumns=True)


def delete_where(df: DataFrame, condition: Column) -> DataFrame:
    """The rows for which the condition is not true."""
    return df.where(~F.coalesce(condition, F.lit(False)))


def detection_rows(found: DataFrame, at: Column) -> DataFrame:
    """Stored form of findings (file_id, pos and a finding's fields). The stored level is the severity, if there is one."""
    level = F.coalesce(F.col("severity"), F.col("risk_level")) if "risk_level" in found.columns else F.col("severity")
    return found.select(
        "file_id", F.coalesce("engine", F.lit("unknown")).alias("detection_type"), F.col("type").alias("pattern_matched"), mask_tracked(F.col("value")).alias("data_found"), F.concat(F.lit("line "), F.col("line")).alias("location_info"),
        level.alias("risk_level"), at.alias("detection_timestamp"), F.col("type").alias("entity_type"), entity_hash(F.col("type"), F.col("value")).alias("entity_hash"), F.col("start").alias("char_start"), F.col("end").alias("char_end"), "confidence", F.col("value").alias("entity_value"),
    )


def detection_to_finding(rows: DataFrame) -> DataFrame:
    """Findings as restored from stored rows."""
    from ..functions.text import line_from_location

    text = lambda *names: F.coalesce(*[F.nullif(F.col(n), F.lit("")) for n in names])
    return rows.select(
        "file_id", F.coalesce(text("entity_type", "pattern_matched"), F.lit("Unknown")).alias("type"), text("entity_value", "data_found").alias("value"), F.col("data_found").alias("masked_value"), F.col("risk_level").alias("severity"), F.col("char_start").alias("start"), F.col("char_end").alias("end"),
        line_from_location(F.col("location_info")).alias("line"), F.col("detection_type").alias("engine"), "confidence", "risk_level",
    )


def update_risk(files: DataFrame, new: DataFrame) -> DataFrame:
    """Risk figures of scanned files; classification is always overwritten, path and strategy only if given."""
    n = new.select(F.col("id"), *[F.col(c).alias(f"_{c}") for c in new.columns if c != "id"])
    j = files.join(n, "id", "left")
    hit = F.col("_risk_level").isNotNull()
    given = lambda c: F.coalesce(F.nullif(F.col(f"_{c}"), F.lit("")), F.col(c)) if f"_{c}" in j.columns else F.col(c)
    out = j.withColumns({c: F.when(hit, F.col(f"_{c}")).otherwise(F.col(c)) for c in ("risk_score", "risk_level", "total_findings_count", "entity_type_counts") if f"_{c}" in j.columns})
    kind = F.coalesce("_document_classification", F.lit("unclassified")) if "_document_classification" in j.columns else F.lit("unclassified")
    out = out.withColumns({"document_classification": F.when(hit, kind).otherwise(F.col("document_classification")), "redacted_version_path": given("redacted_version_path"), "redaction_strategy": given("redaction_strategy")})
    return out.select(*files.columns)


def update_post_redaction(files: DataFrame, new: DataFrame) -> DataFrame:
    names = ("post_redaction_risk_score", "post_redaction_risk_level", "post_redaction_findings_count")
    j = files.join(new.select("id", *[F.col(c).alias(f"_{c}") for c in names]), "id", "left")
    return j.withColumns({c: F.coalesce(f"_{c}", c) for c in names}).select(*files.columns)


def settings(stored: DataFrame) -> DataFrame:
    """Stored settings laid over the defaults, as JSON text in ``value``."""
    rows = [(k, v) for k, v in DEFAULT_SETTINGS.items()]
    default = stored.sparkSession.createDataFrame(rows, "key string, value string")
    return upsert(default, stored.select("key", "value"), ["key"]).select("key", "value", setting_value(F.col("value")).alias("json"))


def set_settings(stored: DataFrame, new: DataFrame, at: Column) -> DataFrame:
    """Stored settings with those of ``new`` (key, value) put in."""
    return upsert(stored, new.select("key", "value", at.alias("updated_at")), ["key"])
