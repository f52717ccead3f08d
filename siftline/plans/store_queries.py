"""Queries over the store's tables and their upkeep, and over labels, boxes and batches of redaction."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import analytics, catalog, models, redact, redaction, risk, spans
from ..operators.detect import keep_entity
from ..operators.patterns import ENTITY_TYPES, LABEL_TYPES
from ..sources.files import KEYWORDS, sql_facts
from ..sources.store import Store, persist_scan
from ..sources.tables import read_table
from .queries import AS_OF, at, detections, documents, files, found, plain_files


def risk_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Even files get new figures; every third of them a path, every one a strategy that may be blank."""
    base = plain_files(spark, sf_dir).select("id", F.lit(1.0).alias("risk_score"), F.lit("low").alias("risk_level"), F.lit("old").alias("document_classification"), F.lit("/old").alias("redacted_version_path"), F.lit("blur").alias("redaction_strategy"), F.lit(0).alias("total_findings_count"))
    new = base.where("id % 2 = 0").select("id", (F.col("id") % 100).cast("double").alias("risk_score"), F.lit("high").alias("risk_level"), F.when(F.col("id") % 3 == 0, "/new").otherwise("").alias("redacted_version_path"), F.when(F.col("id") % 5 == 0, "blackout").alias("redaction_strategy"), F.lit(3).alias("total_findings_count"))
    return catalog.update_risk(base, new)


def post_redaction_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = plain_files(spark, sf_dir).select("id", F.lit(9.0).alias("post_redaction_risk_score"), F.lit("high").alias("post_redaction_risk_level"), F.lit(4).alias("post_redaction_findings_count"))
    new = base.where("id % 3 = 0").select("id", F.lit(0.5).alias("post_redaction_risk_score"), F.when(F.col("id") % 2 == 0, "low").alias("post_redaction_risk_level"), F.lit(0).alias("post_redaction_findings_count"))
    return catalog.update_post_redaction(base, new)


def findings_at_least(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = found(spark, sf_dir)
    return f.select("doc_id", *[F.size(risk.at_least(F.col("findings"), x)).alias(f"n_{x}") for x in ("high", "medium")], F.size(risk.preview(F.col("findings"), 2)).alias("n_shown"))


def detections_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = detections(spark, sf_dir).withColumn("detection_type", F.col("entity_type"))
    return analytics.detections_by_type(d, "Phone Number").select("id", "file_id", "data_found")


def detections_for_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = detections(spark, sf_dir)
    most = d.agg(F.max("file_id").alias("f")).first()["f"]
    return analytics.detections_for_file(d, most).select("id", "file_id", "entity_type", "data_found")


def redactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A record for each file with a multiple of 3, some alike."""
    f = plain_files(spark, sf_dir).where("id % 3 = 0")
    return f.select(F.col("id"), (F.col("id") % 30).alias("file_id"), F.lit("document_redaction").alias("redaction_type"), (F.col("id") % 4).cast("int").alias("findings_redacted"), F.when(F.col("id") % 5 != 0, "blackout").alias("strategy"), at(F.col("id")).alias("redaction_timestamp"))


def redaction_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.redaction_history(redactions(spark, sf_dir), plain_files(spark, sf_dir)).select("id", "file_id", "filename", "findings_redacted")


def redactions_for_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.redactions_for_file(redactions(spark, sf_dir), 6).select("id", "file_id", "findings_redacted")


def dedupe_redactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Null keys count as equal here."""
    r = redactions(spark, sf_dir).select("id", "file_id", "strategy", "findings_redacted")
    return analytics.dedupe(r, ["file_id", "strategy", "findings_redacted"], keep_blank=False)


def dedupe_by_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = detections(spark, sf_dir).select("id", "file_id", F.when(F.col("id") % 4 != 0, F.col("entity_hash")).otherwise("").alias("entity_hash"))
    return analytics.dedupe(d, ["entity_hash", "file_id"])


def ocr(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = documents(spark, sf_dir)
    return d.select(F.col("doc_id").alias("id"), (F.col("doc_id") - F.col("doc_id") % 2).alias("file_id"), F.col("text").alias("extracted_text"), (F.col("doc_id") % 100).cast("double").alias("confidence"), at(F.col("doc_id")).alias("ocr_timestamp"), F.col("lang").alias("ocr_language"), F.col("n_chars").cast("int").alias("word_count"))


def all_ocr_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.ocr_results(ocr(spark, sf_dir), plain_files(spark, sf_dir)).select("id", "file_id", "filename", "confidence")


def latest_ocr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.latest_by(ocr(spark, sf_dir), "file_id", "ocr_timestamp").select("id", "file_id", "confidence")


def ocr_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.ocr_languages(ocr(spark, sf_dir))


def ocr_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text, mean score in percent and words of recognised lines: the turns of a conversation stand for lines."""
    c = read_table(spark, sf_dir, "conversations")
    lines = c.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", (F.col("turn") % 8 / 8).alias("score"), F.coalesce("text", F.lit("")).alias("text")))).alias("w"))
    return spans.derive(lines, s=redact.ocr_summary(F.col("w"))).select("conv_id", F.sha2("s.text", 256).alias("text_sha256"), "s.confidence", "s.word_count")


def deleted_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.delete_where(plain_files(spark, sf_dir).select("id", "file_format"), F.when(F.col("file_format") != "src1", F.col("id") % 2 == 0))


def get_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = plain_files(spark, sf_dir)
    return f.where("id = 7").select("id", "file_path").union(f.where("file_path = '/in/doc_11.txt'").select("id", "file_path"))


def restored_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = detections(spark, sf_dir).withColumns({"entity_value": F.when(F.col("id") % 2 == 0, F.col("entity_value")).otherwise(""), "entity_type": F.when(F.col("id") % 3 != 0, F.col("entity_type")), "location_info": F.when(F.col("id") % 5 != 0, F.col("location_info")).otherwise("page x")})
    return catalog.detection_to_finding(d.withColumn("pattern_matched", F.when(F.col("id") % 9 != 0, F.col("pattern_matched")))).select("file_id", "type", "value", "severity", "start", "end", "line")


def replaced_detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Even files were scanned again and now have one detection, those of 4 none."""
    old = detections(spark, sf_dir).select("id", "file_id", "data_found")
    again = plain_files(spark, sf_dir).where("id % 2 = 0").select("id")
    new = again.where("id % 4 = 0").select((-F.col("id")).alias("id"), F.col("id").alias("file_id"), F.lit("new").alias("data_found"))
    return catalog.replace_children(old, new, again)


def files_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.files_report(plain_files(spark, sf_dir), detections(spark, sf_dir)).select("id", "filename", "findings", "high", "medium", "low")


def marked_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files(spark, sf_dir).withColumn("redacted_version_path", F.when(F.col("id") % 4 == 0, "/out").when(F.col("id") % 4 == 1, ""))


def redacted_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.redacted_documents(marked_files(spark, sf_dir))


def tracking_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.tracking_totals(detections(spark, sf_dir))


def database_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.database_info({"files": plain_files(spark, sf_dir), "detections": detections(spark, sf_dir), "redactions": redactions(spark, sf_dir), "ocr_results": ocr(spark, sf_dir)}, 4096)


def statistics_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.statistics_report(marked_files(spark, sf_dir), detections(spark, sf_dir))


def old_logs_cleared(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read_table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("ts").alias("log_timestamp"))
    return analytics.clear_old_logs(e, F.timestamp_seconds(F.unix_timestamp(F.lit(AS_OF))), 3).select("id")


def settings_overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = read_table(spark, sf_dir, "nation").where("n_nationkey < 4")
    name = F.get(F.array(F.lit("default_scan_mode"), F.lit("own_flag"), F.lit("own_number"), F.lit("own_name")), F.col("n_nationkey").cast("int"))
    value = F.when(F.col("n_nationkey") == 1, "True").when(F.col("n_nationkey") == 2, "17").otherwise(F.col("n_name"))
    stored = catalog.set_settings(n.select(name.alias("key"), F.lit("old").alias("value"), F.lit(None).cast("timestamp").alias("updated_at")), n.select(name.alias("key"), value.alias("value")), F.lit(None).cast("timestamp"))
    return catalog.settings(stored)


def recognizer_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = spark.createDataFrame([(x,) for x in (*ENTITY_TYPES, *LABEL_TYPES, "Other")], "label string")
    return labels.select("label", models.entity_type(F.col("label")).alias("entity_type"), models.entity_severity(F.col("label")).alias("entity_severity"), models.label_type(F.initcap("label")).alias("label_type"), models.label_severity(models.label_type(F.col("label"))).alias("label_severity"))


def kept_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels, scores and values from customers: which of them a recognizer would keep."""
    c = read_table(spark, sf_dir, "customer")
    label = F.get(F.array(*[F.lit(x) for x in ("URL", "PERSON", "EMAIL_ADDRESS", "NRP")]), (F.col("c_custkey") % 4).cast("int"))
    return c.select("c_custkey", keep_entity(label, F.col("c_custkey") % 100 / 100, F.left("c_name", F.col("c_custkey") % 5)).alias("kept"))


def selected_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = found(spark, sf_dir).withColumn("pick", F.when(F.col("doc_id") % 2 == 0, F.array(F.lit(0), F.lit(2), F.lit(9))).otherwise(F.array().cast("array<int>")))
    return f.select("doc_id", F.size(redact.selected(F.col("findings"), F.col("pick"))).alias("n"))


def language_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = documents(spark, sf_dir)
    return d.select("doc_id", F.array_join(T.languages(F.when(F.col("doc_id") % 3 != 0, F.concat(F.lit(" "), "lang", F.lit("+fr,, "), "source"))), ";").alias("languages"))


def lenient_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines and counts from stored texts, some of which cannot be read."""
    d = documents(spark, sf_dir)
    place = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("line "), "doc_id")).when(F.col("doc_id") % 3 == 1, F.concat(F.lit("see line "), F.col("doc_id") % 7, F.lit(" there"))).otherwise("line x")
    counts = F.when(F.col("doc_id") % 4 == 0, F.concat(F.lit('{"Email": '), "doc_id", F.lit("}"))).when(F.col("doc_id") % 4 == 1, "{broken")
    return d.select("doc_id", T.line_from_location(place).alias("line"), F.coalesce(F.try_element_at(T.entity_counts(counts), F.lit("Email")), F.lit(0)).alias("emails"))


def keyword_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All seven keywords of statements, also inside words."""
    p = read_table(spark, sf_dir, "part")
    text = F.concat(F.lit("insert into t; "), "p_name", F.lit("; UPDATED x; delete; Alter; droplet; selector; created "), "p_name")
    f = spans.derive(p.select("p_partkey", text.alias("t")), f=sql_facts(F.col("t")))
    return f.select("p_partkey", "f.queries", *[F.coalesce(F.try_element_at("f.keywords", F.lit(k)), F.lit(0)).alias(f"n_{k.lower()}") for k in KEYWORDS])


def word_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes of parts of words, upright boxes around corners, and boxes over several words, from the names of parts."""
    p = read_table(spark, sf_dir, "part").withColumn("x", (F.col("p_partkey") % 50).cast("int"))
    word = F.struct(F.col("p_name").alias("text"), F.array(F.col("x"), F.lit(5), F.col("x") + F.col("p_size").cast("int") * 3, F.lit(15)).alias("bbox"))
    quad = F.array(F.array(F.col("x"), F.lit(2)), F.array(F.lit(20), F.col("x")), F.array(F.lit(7), F.lit(30)), F.array(F.lit(1), F.lit(1)))
    text = lambda b: F.array_join(F.transform(b, lambda v: v.cast("string")), ",")
    both = F.array(F.array(F.col("x"), F.lit(-4), F.lit(30), F.lit(9)), F.array(F.lit(10), F.lit(2), F.col("x") * 4, F.lit(8)))
    return p.select("p_partkey", text(redact.part_box(word, F.lit(1), F.lit(4), F.lit(100), F.lit(60))).alias("part"), text(redact.quad_box(quad)).alias("quad"), text(redact.union_box(both, F.lit(100), F.lit(60))).alias("over"))


def batch_redaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A batch of files of several formats: status, number of places and error of each."""
    kind = F.get(F.array(*[F.lit(x) for x in (".txt", ".pdf", ".xyz", ".sql", ".png")]), (F.col("doc_id") % 5).cast("int"))
    done = redaction.run(found(spark, sf_dir).select("doc_id", kind.alias("format"), F.lit(None).cast("binary").alias("content"), F.regexp_replace(F.coalesce("text", F.lit("")), r"\r\n?", "\n").alias("text"), "findings"), "full")
    return done.select("doc_id", "redaction.status", "redaction.n", "redaction.error", F.sha2("redaction.redacted", 256).alias("redacted_sha256"))


def scratch(spark: SparkSession) -> str:
    """A new folder that all executors see."""
    context = spark.sparkContext
    base = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not base and not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"{base or tempfile.mkdtemp(prefix='siftline-')}/store-{uuid.uuid4().hex}"


def kept_store(spark: SparkSession, sf_dir: str, again: bool = True) -> Store:
    """A store with the scan of all documents; with ``again`` files of even ids were scanned a second time, now without text."""
    f = found(spark, sf_dir)
    none = F.lit(None).cast("string")
    scanned = f.select(F.concat(F.lit("/in/"), F.lpad(F.col("doc_id").cast("string"), 9, "0")).alias("path"), F.concat(F.lit("doc_"), "doc_id").alias("name"), F.lit(".txt").alias("format"), F.col("n_chars").alias("size"), T.content_hash(F.coalesce("text", F.lit(""))).alias("hash"), F.coalesce("text", F.lit("")).alias("text"), "findings", F.when(F.col("doc_id") % 3 == 0, "ocr").otherwise(none).alias("source"), F.struct(F.lit(50.0).alias("confidence"), F.lit(1).alias("word_count"), F.lit("en").alias("ocr_language")).alias("ocr"), "doc_id")
    store = Store(spark, scratch(spark))
    persist_scan(store, scanned.drop("doc_id"), at(F.lit(0)))
    if again:
        empty: Column = F.array().cast(f"array<{spans.FINDING}>")
        persist_scan(store, scanned.where("doc_id % 2 = 0").drop("doc_id").withColumn("findings", empty), at(F.lit(60)))
    return store


def persisted_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of the store with their detections and recognised texts, after two scans."""
    store = kept_store(spark, sf_dir)
    d = store.read("detections").groupBy("file_id").agg(F.count(F.lit(1)).alias("n"))
    o = store.read("ocr_results").groupBy("file_id").agg(F.count(F.lit(1)).alias("o"))
    out = analytics.nested(store.read("files"), {"n": d, "o": o})
    return out.select("id", "file_path", "filename", "file_size", "risk_level", "total_findings_count", F.coalesce("n", F.lit(0)).alias("detections"), F.coalesce("o", F.lit(0)).alias("ocr_results"))


def restored_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest files that are still there, as a session shows them."""
    store = kept_store(spark, sf_dir, again=False)
    there = documents(spark, sf_dir).where("doc_id % 5 <> 0").select(F.concat(F.lit("/in/"), F.lpad(F.col("doc_id").cast("string"), 9, "0")).alias("path"), F.lit("parsed").alias("text"))
    s = analytics.session(store.read("files"), store.read("detections"), store.read("ocr_results"), present=there)
    return s.select("id", "filename", F.size("findings").alias("n_findings"), F.col("risk.risk_score").alias("risk_score"), F.col("compliance.GDPR.status").alias("gdpr"), (F.col("extracted_text") == "parsed").alias("parsed"))


QUERIES = {
    f.__name__: f
    for f in (
        risk_updates, post_redaction_updates, findings_at_least, detections_by_type, detections_for_file, redaction_history, redactions_for_file, dedupe_redactions, dedupe_by_hash, all_ocr_results, latest_ocr, ocr_languages, ocr_summaries,
        deleted_files, get_file, restored_findings, replaced_detections, files_report, redacted_documents, tracking_totals, database_info, statistics_report, old_logs_cleared, settings_overlay, recognizer_labels, kept_entities, selected_findings,
        language_lists, lenient_values, keyword_counts, word_boxes, batch_redaction, persisted_scans, restored_session,
    )
}
