"""Redaction of whole files: dispatch by format, batches with a status for each file, and the record of what was done."""

from __future__ import annotations

import io
import zipfile
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, IntegerType, StringType, StructField, StructType

from . import spans
from .images import IMAGE_FORMATS, NEEDS
from .redact import by_mode, redact_spans, redact_values, replacements, selected

TEXT = (".txt", ".sql")
RESULT = "struct<status:string,error:string,redacted:string,content:binary,n:int>"
WORD = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def docx_redacted(content: bytes, pairs: list[tuple[str, str]]) -> tuple[bytes, int]:
    """A document with all values replaced in turn in its paragraphs, those of tables too, and the number of places. A changed paragraph's text moves to its first run."""
    total, out = 0, io.BytesIO()
    with zipfile.ZipFile(io.BytesIO(content)) as old, zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as new:
        for item in old.infolist():
            data = old.read(item.filename)
            if item.filename == "word/document.xml":
                root = ElementTree.fromstring(data)
                for paragraph in root.iter(f"{WORD}p"):
                    texts = list(paragraph.iter(f"{WORD}t"))
                    before = after = "".join(t.text or "" for t in texts)
                    for value, by in pairs:
                        total += after.count(value)
                        after = after.replace(value, by)
                    if after != before:
                        for k, t in enumerate(texts):
                            t.text = after if k == 0 else ""
                data = ElementTree.tostring(root, encoding="utf-8", xml_declaration=True)
            new.writestr(item, data)
    return out.getvalue(), total


@F.pandas_udf(StructType([StructField("content", BinaryType()), StructField("n", IntegerType()), StructField("error", StringType())]))
def _docx(content: pd.Series, values: pd.Series, marks: pd.Series) -> pd.DataFrame:
    out = []
    for data, v, m in zip(content, values, marks, strict=True):
        try:
            out.append((*docx_redacted(data, list(zip(v, m, strict=True))), None))
        except Exception as e:  # a broken file must not stop the batch
            out.append((None, 0, f"{type(e).__name__}: {e}"))
    return pd.DataFrame(out, columns=["content", "n", "error"])


def run(files: DataFrame, mode: str = "auto", chosen: str | None = None) -> DataFrame:
    """Adds ``redaction`` to files (format, text, content, findings): what was done with each.

    ``mode`` and a column ``chosen`` of indices select findings. Files without
    findings are ``skipped``. Texts are redacted by spans, documents by values;
    a format that needs a package that is not here, or is unknown, is an ``error`` of its own and stops nothing.
    """
    picked = selected(F.col("findings"), F.col(chosen)) if chosen else F.col("findings")
    work = spans.derive(files, redaction=by_mode(picked, mode))
    work = spans.derive(work, redaction=F.struct(F.col("redaction").alias("fs"), replacements(F.col("redaction")).alias("pairs")))
    none = F.size("redaction.fs") == 0
    of = lambda status, error=None, redacted=None, content=None, n=None: F.struct(F.lit(status).alias("status"), (error if isinstance(error, Column) else F.lit(error)).cast("string").alias("error"), (F.lit(None).cast("string") if redacted is None else redacted).alias("redacted"), (F.lit(None).cast("binary") if content is None else content).alias("content"), (F.lit(0) if n is None else n).cast("int").alias("n")).cast(RESULT)
    kind = F.lower("format")
    needs = F.lit(None).cast("string")
    for suffix, package in ((".pdf", NEEDS[".pdf"]), *((x, NEEDS["image"]) for x in IMAGE_FORMATS)):
        needs = F.when(kind == suffix, F.lit(package)).otherwise(needs)
    is_docx = (kind == ".docx") & ~none
    plain = spans.derive(
        work.where(~F.coalesce(is_docx, F.lit(False))),
        redaction=F.when(none, of("skipped"))
        .when(kind.isin(*TEXT), of("redacted", redacted=redact_spans(F.col("text"), F.col("redaction.fs")), n=F.size("redaction.fs")))
        .when(needs.isNotNull(), of("error", needs))
        .otherwise(of("error", F.concat(F.lit("Unsupported format: "), F.coalesce("format", F.lit(""))))),
    )
    documents = spans.derive(work.where(is_docx), redaction=F.struct("redaction", _docx("content", F.transform("redaction.pairs", lambda p: p["value"]), F.transform("redaction.pairs", lambda p: p["by"])).alias("d")))
    new_text = redact_values(F.col("text"), F.col("redaction.redaction.pairs"))["text"]
    done = F.when(F.col("redaction.d.error").isNotNull(), of("error", F.col("redaction.d.error"))).otherwise(of("redacted", redacted=new_text, content=F.col("redaction.d.content"), n=F.col("redaction.d.n")))
    return plain.unionByName(spans.derive(documents, redaction=done))


def records(done: DataFrame, at: Column, mode: str, strategy: str = "blackout", folder: str = "") -> DataFrame:
    """Rows of the redaction table for files (id, name) that ``run`` redacted."""
    out = F.concat(F.lit(folder.rstrip("/") + "/" if folder else ""), F.lit("redacted_"), F.col("name"))
    return done.where("redaction.status = 'redacted'").select(F.col("id").alias("file_id"), F.lit("document_redaction").alias("redaction_type"), F.lit(None).cast("string").alias("entity_type"), F.lit(mode).alias("mode"), F.lit(strategy).alias("strategy"), out.alias("output_path"), F.col("redaction.n").alias("findings_redacted"), at.alias("redaction_timestamp"))


def rescan(done: DataFrame) -> DataFrame:
    """``id`` and the risk that is left in redacted files, by a quick scan of their new texts."""
    from .detect import scan
    from .risk import assess

    again = scan(done.where("redaction.status = 'redacted'").select("id", F.col("redaction.redacted").alias("text")))
    left = spans.derive(again, a=assess(F.col("findings")))
    return left.select("id", F.col("a.risk_score").alias("post_redaction_risk_score"), F.col("a.risk_level").alias("post_redaction_risk_level"), F.col("a.total_findings").alias("post_redaction_findings_count"))
