"""Queries over files, detections, redactions and logs. ``as_of`` stands for now; ties go to the higher id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import materialize


def newest(df: DataFrame, time: str, id: str = "id", limit: int | None = None, offset: int = 0) -> DataFrame:
    """The latest rows, a page of them if asked: a top-k, not a full sort, where there is a limit."""
    out = df.orderBy(F.col(time).desc(), F.col(id).desc())
    out = out.offset(offset) if offset else out
    return out.limit(limit) if limit is not None else out


def latest_by(df: DataFrame, key: str, time: str, id: str = "id") -> DataFrame:
    """The latest row of each key, by partial aggregation rather than a window over the key."""
    return df.groupBy(F.col(key).alias("key of the rows")).agg(F.max_by(F.struct(*df.columns), F.struct(time, id)).alias("row")).select("row.*")


def recent_files(files: DataFrame, as_of: Column, days: int = 7, limit: int | None = 50) -> DataFrame:
    return newest(files.where(F.col("upload_date") > as_of - F.make_interval(days=F.lit(days))), "upload_date", limit=limit)


def files_by_format(files: DataFrame, kind: str) -> DataFrame:
    return newest(files.where(F.col("file_format") == kind), "upload_date")


def high_risk_detections(detections: DataFrame, files: DataFrame, limit: int | None = 100) -> DataFrame:
    f = files.select(F.col("id").alias("file_id"), "filename", "file_path")
    return newest(detections.where("risk_level = 'high'").join(f, "file_id"), "detection_timestamp", limit=limit)


def detections_by_type(detections: DataFrame, kind: str, limit: int | None = 100) -> DataFrame:
    return newest(detections.where(F.col("detection_type") == kind), "detection_timestamp", limit=limit)


def redaction_history(redactions: DataFrame, files: DataFrame, limit: int | None = 100) -> DataFrame:
    return newest(redactions.join(files.select(F.col("id").alias("file_id"), "filename"), "file_id"), "redaction_timestamp", limit=limit)


def file_history(files: DataFrame, detections: DataFrame) -> DataFrame:
    """Each file with its number of detections and its distinct levels, null where there are none."""
    by = detections.groupBy(F.col("file_id").alias("id")).agg(F.count(F.lit(1)).alias("n"), F.array_join(F.sort_array(F.collect_set("risk_level")), ",").alias("levels"))
    return files.join(by, "id", "left").select("id", "filename", "file_size", "upload_date", F.coalesce("n", F.lit(0)).alias("detection_count"), F.nullif(F.col("levels"), F.lit("")).alias("risk_levels"))


def overall_stats(files: DataFrame, detections: DataFrame) -> DataFrame:
    f = files.agg(F.count(F.lit(1)).alias("total_files"), F.coalesce(F.sum("file_size"), F.lit(0)).alias("total_size"))
    d = detections.agg(F.count(F.lit(1)).alias("total_detections"), *[F.count_if(F.col("risk_level") == x).alias(f"{x}_risk") for x in ("high", "medium", "low")])
    return f.crossJoin(d)  # one row each


def detection_stats(detections: DataFrame) -> DataFrame:
    """For each file: its total, and counts by detector and by level, in one pass."""
    t = detections.groupingSets([["file_id"], ["file_id", "detection_type"], ["file_id", "risk_level"]], "file_id", "detection_type", "risk_level").agg(F.count(F.lit(1)).alias("n"), F.grouping_id().alias("g"))
    what = F.when(F.col("g") == 3, "total").when(F.col("g") == 1, "type").otherwise("level")
    return t.select("file_id", what.alias("what"), F.when(what == "total", "").when(what == "type", F.col("detection_type")).otherwise(F.col("risk_level")).alias("name"), "n")


def entity_types(detections: DataFrame, limit: int | None = 25) -> DataFrame:
    out = detections.where("coalesce(entity_type, '') <> ''").groupBy("entity_type").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "entity_type")
    return out.limit(limit) if limit is not None else out


def cross_file_entities(detections: DataFrame, limit: int | None = 25) -> DataFrame:
    """Entities found more than once: the hash names the type too, so its least type is the type."""
    by = detections.where("coalesce(entity_hash, '') <> ''").groupBy("entity_hash").agg(F.min("entity_type").alias("entity_type"), F.count(F.lit(1)).alias("occurrences"), F.countDistinct("file_id").alias("file_count"))
    out = by.where("occurrences > 1").orderBy(F.desc("occurrences"), F.desc("file_count"), "entity_hash")
    return out.limit(limit) if limit is not None else out


def risk_by_level(files: DataFrame) -> DataFrame:
    """Files by level, without low and unknown ones."""
    return files.where("risk_level is not null and risk_level <> 'low'").groupBy("risk_level").agg(F.count(F.lit(1)).alias("n"))


def top_entities(files: DataFrame, limit: int | None = 10) -> DataFrame:
    each = files.select(F.explode("entity_type_counts").alias("entity_type", "n"))
    out = each.groupBy("entity_type").agg(F.sum("n").alias("total")).orderBy(F.desc("total"), "entity_type")
    return out.limit(limit) if limit is not None else out


def dashboard(files: DataFrame) -> DataFrame:
    return files.agg(F.count(F.lit(1)).alias("scanned_files"), F.coalesce(F.sum("total_findings_count"), F.lit(0)).alias("findings"), F.count_if("has_high").alias("high_risk_files"))


def duplicates(files: DataFrame) -> DataFrame:
    """For each file the newest other one with its content: two latest by hash are enough, no join of files with files."""
    two = files.groupBy("file_hash").agg(F.max(F.struct("upload_date", "id")).alias("a"), F.count(F.lit(1)).alias("n")).where("n > 1")
    rest = files.join(two.select("file_hash", F.col("a.id").alias("top")), "file_hash")
    second = rest.where("id <> top").groupBy(F.col("file_hash").alias("h")).agg(F.max(F.struct("upload_date", "id")).alias("b"))
    out = rest.join(second, F.col("file_hash") == F.col("h"))
    return out.select("id", "file_hash", F.when(F.col("id") == F.col("top"), F.col("b.id")).otherwise(F.col("top")).alias("duplicate_file_id"))


def dedupe(df: DataFrame, keys: list[str], id: str = "id", keep_blank: bool = True) -> DataFrame:
    """Of rows with equal keys the one with the least id; with ``keep_blank`` rows with a null or empty key all stay."""
    blank = F.lit(False)
    for k in keys:
        blank = blank | F.col(k).isNull() | (F.col(k).cast("string") == "")
    own = df if not keep_blank else df.where(~blank)
    first = own.groupBy(*keys).agg(F.min_by(F.struct(*df.columns), id).alias("r")).select("r.*")
    return first.unionByName(df.where(blank)) if keep_blank else first


def ocr_statistics(ocr: DataFrame) -> DataFrame:
    return ocr.agg(F.count(F.lit(1)).alias("total"), F.coalesce(F.round(F.avg("confidence"), 4), F.lit(0.0)).alias("avg_confidence"), F.coalesce(F.sum("word_count"), F.lit(0)).alias("total_words"))


def ocr_languages(ocr: DataFrame, limit: int = 5) -> DataFrame:
    return ocr.groupBy("ocr_language").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "ocr_language").limit(limit)


def logs(rows: DataFrame, level: str | None = None, as_of: Column | None = None, hours: int | None = None, limit: int | None = 100) -> DataFrame:
    out = rows.where(F.col("log_level") == level) if level else rows
    out = out.where(F.col("log_timestamp") > as_of - F.make_interval(hours=F.lit(hours))) if hours is not None else out
    return newest(out, "log_timestamp", limit=limit)


def clear_old_logs(rows: DataFrame, as_of: Column, days: int = 30) -> DataFrame:
    return rows.where(F.col("log_timestamp") >= as_of - F.make_interval(days=F.lit(days)))


def nested(files: DataFrame, children: dict[str, DataFrame]) -> DataFrame:
    """Files with a column for each of ``children`` (file_id and one column): left joins on the id."""
    out = files
    for name, child in children.items():
        one = child.select(F.col("file_id").alias(f"file of {name}"), F.col(name))
        out = out.join(one, F.col("id") == F.col(f"file of {name}"), "left").drop(f"file of {name}")
    return out


def export_report(files: DataFrame, detections: DataFrame, redactions: DataFrame, ocr: DataFrame, limit: int | None = 1000) -> DataFrame:
    """Newest files with nested detections and redactions and the latest recognised text, one job instead of a query a file.

    Children of other files are dropped before they are aggregated.
    """
    chosen = newest(files, "upload_date", limit=limit)
    own = lambda rows: rows.join(chosen.select(F.col("id").alias("file_id")), "file_id", "left_semi")
    d = own(detections).groupBy("file_id").agg(F.array_sort(F.collect_list(F.struct("id", "pattern_matched", "data_found", "risk_level", "location_info"))).alias("detections"))
    r = own(redactions).groupBy("file_id").agg(F.array_sort(F.collect_list(F.struct("id", "redaction_type", "strategy", "findings_redacted"))).alias("redactions"))
    o = latest_by(own(ocr), "file_id", "ocr_timestamp").select("file_id", F.struct("confidence", "word_count", "ocr_language").alias("ocr_summary"))
    return nested(chosen, {"detections": d, "redactions": r, "ocr_summary": o})


def session(files: DataFrame, detections: DataFrame, ocr: DataFrame, limit: int = 200, present: DataFrame | None = None) -> DataFrame:
    """Latest files as a session restores them: findings in order of place, risk, compliance, and the latest recognised text.

    ``present`` (path, text) lists the files that are still there: others are
    left out, and its text stands in where none was recognised.
    """
    from .catalog import detection_to_finding
    from .risk import assess, compliance

    chosen = newest(files, "upload_date", limit=limit)
    if present is not None:
        there = present.select(F.col("path").alias("path there"), F.col("text").alias("text there"))
        chosen = chosen.join(there, F.col("file_path") == F.col("path there")).drop("path there")
    ids = chosen.select(F.col("id").alias("file_id"))
    found = detection_to_finding(detections.join(ids, "file_id", "left_semi"))
    found = found.groupBy("file_id").agg(F.array_sort(F.collect_list(F.struct("start", "end", "type", "value", "masked_value", "severity", "line", "confidence"))).alias("findings"))
    text = latest_by(ocr.join(ids, "file_id", "left_semi"), "file_id", "ocr_timestamp").select("file_id", "extracted_text")
    out = nested(chosen, {"findings": found, "extracted_text": text})
    none = F.array().cast(dict(out.dtypes)["findings"])
    out = out.withColumn("findings", F.coalesce("findings", none))
    if present is not None:
        out = out.withColumn("extracted_text", F.coalesce("extracted_text", "text there")).drop("text there")
    return out.withColumns({"risk": assess(F.col("findings")), "compliance": compliance(F.col("findings"))})


def numbered(df: DataFrame, order: list[str], id: str = "id", start: int = 1) -> DataFrame:
    """Ids from ``start`` in the order given, without sorting the table in one task: ranks by range partition, then offsets.

    The ranks are written before they are counted: a second run of the same plan may cut its ranges elsewhere.
    """
    row = F.struct(*df.columns).alias("row")
    ordered = df.repartitionByRange(*[F.col(c) for c in order]).sortWithinPartitions(*order).select(row, F.spark_partition_id().alias("part"), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("k"))
    ordered = materialize(ordered, "ordered")
    sizes = ordered.groupBy("part").agg(F.count(F.lit(1)).alias("n"))  # a row for each partition
    before = sizes.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    return ordered.join(before, "part").select("row.*", (F.col("before") + F.col("k") + start).alias(id))


def files_report(files: DataFrame, detections: DataFrame, limit: int | None = 500) -> DataFrame:
    """Newest files with their number of detections by level: one join instead of a query a file."""
    chosen = newest(files, "upload_date", limit=limit)
    own = detections.join(chosen.select(F.col("id").alias("file_id")), "file_id", "left_semi")
    by = own.groupBy("file_id").agg(F.struct(F.count(F.lit(1)).alias("n"), *[F.count_if(F.col("risk_level") == x).alias(x) for x in ("high", "medium", "low")]).alias("counts"))
    out = nested(chosen, {"counts": by})
    return out.select(*files.columns, *[F.coalesce(F.col("counts")[x], F.lit(0)).alias(y) for x, y in (("n", "findings"), ("high", "high"), ("medium", "medium"), ("low", "low"))])


def redactions_for_file(redactions: DataFrame, file_id: int) -> DataFrame:
    return newest(redactions.where(F.col("file_id") == file_id), "redaction_timestamp")


def detections_for_file(detections: DataFrame, file_id: int) -> DataFrame:
    return newest(detections.where(F.col("file_id") == file_id), "detection_timestamp")


def ocr_results(ocr: DataFrame, files: DataFrame, limit: int | None = 100) -> DataFrame:
    """Newest recognised texts with their files' names."""
    return newest(ocr.join(files.select(F.col("id").alias("file_id"), "filename"), "file_id"), "ocr_timestamp", limit=limit)


def redacted_documents(files: DataFrame) -> DataFrame:
    return files.agg(F.count_if(F.coalesce("redacted_version_path", F.lit("")) != "").alias("redacted_documents"))


def tracking_totals(detections: DataFrame) -> DataFrame:
    """All detections, and how many files hold a hashed entity."""
    hashed = F.when(F.coalesce("entity_hash", F.lit("")) != "", F.col("file_id"))
    return detections.agg(F.count(F.lit(1)).alias("total"), F.countDistinct(hashed).alias("hashed_files"))


def database_info(tables: dict[str, DataFrame], size: int | None = None) -> DataFrame:
    """A row for each table with its number of rows, and one with the bytes they take, if known."""
    out = None
    for name, df in tables.items():
        one = df.agg(F.lit(f"total_{name}").alias("name"), F.count(F.lit(1)).alias("value"))
        out = one if out is None else out.union(one)
    total = out.sparkSession.range(1).select(F.lit("database_size").alias("name"), F.lit(size).cast("long").alias("value"))
    return out.union(total) if size is not None else out


def statistics_report(files: DataFrame, detections: DataFrame, top: int = 10) -> DataFrame:
    """``section, name, value``: overall figures, risk, frequent types, redacted documents and entities in several files."""
    row = lambda df, section, name, value: df.select(F.lit(section).alias("section"), name.cast("string").alias("name"), F.col(value).cast("long").alias("value"))
    o = overall_stats(files, detections)
    each = o.select(F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("long").alias("n")) for c in o.columns])).alias("x")).select("x.*")
    out = row(each, "overall", F.col("name"), "n")
    out = out.union(row(risk_by_level(files), "risk", F.col("risk_level"), "n")).union(row(top_entities(files, top), "types", F.col("entity_type"), "total"))
    out = out.union(row(redacted_documents(files), "redactions", F.lit("redacted_documents"), "redacted_documents"))
    return out.union(row(cross_file_entities(detections, top), "entities", F.col("entity_type"), "occurrences"))
