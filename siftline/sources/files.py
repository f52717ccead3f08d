"""Document files as rows: checks, facts, and text by format. Files are read by Spark, one row each."""

from __future__ import annotations

import io
import zipfile
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

#: Formats, limits, keywords.
FORMATS = (".pdf", ".docx", ".txt", ".sql", ".png", ".jpg", ".jpeg", ".bmp", ".tif", ".tiff")
TEXT_FORMATS = (".txt", ".sql", ".docx", ".pdf")
MOST_BYTES, WARN_BYTES = 50 << 20, 10 << 20
KEYWORDS = ("SELECT", "INSERT", "UPDATE", "DELETE", "CREATE", "DROP", "ALTER")


class UnsupportedFormat(RuntimeError):
    """The format needs a package that is not installed."""


def listing(spark: SparkSession, path: str) -> DataFrame:
    """Path, name, suffix, size, time and content of files below a path. Spark prunes the content where it is not used."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    name = F.element_at(F.split("path", "/"), -1)
    return raw.select("path", name.alias("name"), F.lower(F.regexp_extract(name, r"(\.[^.]+)$", 1)).alias("format"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"), (F.col("length") > WARN_BYTES).alias("size_warning"), "content")


def validity(suffix: Column, size: Column) -> Column:
    """``struct<ok, reason>``: the format is checked before the size."""
    reason = F.when(size.isNull(), "File does not exist").when(~suffix.isin(*FORMATS), F.concat(F.lit("Unsupported format: "), suffix)).when(size > MOST_BYTES, "File exceeds 50 MB")
    return F.struct(reason.isNull().alias("ok"), F.coalesce(reason, F.lit("Valid")).alias("reason"))


def decoded(content: Column) -> Column:
    """UTF-8 without a mark at its start if the bytes are that, else Latin-1; line ends as line feeds."""
    utf8 = F.when(F.is_valid_utf8(content.cast("string")), content.cast("string"))
    return F.regexp_replace(F.coalesce(utf8, F.decode(content, "ISO-8859-1")), r"\r\n?", "\n")


def text_facts(text: Column) -> Column:
    return F.struct(F.size(F.split(text, "\n")).alias("lines"), F.size(F.filter(F.split(text, r"(?U)\s+"), lambda w: w != "")).alias("words"), F.length(text).alias("characters"))


def sql_facts(text: Column) -> Column:
    """Statements between semicolons and occurrences of keywords, also inside longer words; absent ones are left out."""
    statements = F.size(F.filter(F.split(text, ";"), lambda s: F.regexp_replace(s, r"(?U)\s+", "") != ""))
    upper = F.upper(text)
    counts = F.map_from_arrays(F.array(*[F.lit(k) for k in KEYWORDS]), F.array(*[F.regexp_count(upper, F.lit(k)) for k in KEYWORDS]))
    return F.struct(statements.alias("queries"), F.map_filter(counts, lambda _, n: n > 0).alias("keywords"))


def docx_text(content: bytes) -> str:
    """Paragraphs that are not blank, then tables with cells between bars, from the document's XML."""
    w = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{w}body")
    words = lambda e: "".join("\t" if t.tag == f"{w}tab" else "\n" if t.tag == f"{w}br" else t.text or "" for t in e.iter() if t.tag in (f"{w}t", f"{w}tab", f"{w}br"))
    out = [p + "\n" for p in map(words, body.findall(f"{w}p")) if p.strip()]
    tables = body.findall(f"{w}tbl")
    if tables:
        out.append("\n--- Tables ---\n")
    for k, table in enumerate(tables, 1):
        out.append(f"\nTable {k}:\n")
        for row in table.findall(f"{w}tr"):
            out.append(" | ".join("\n".join(map(words, c.findall(f"{w}p"))) for c in row.findall(f"{w}tc")) + "\n")
    return "".join(out)


def pdf_text(content: bytes) -> str:
    try:
        import fitz
    except ImportError as e:
        raise UnsupportedFormat("PDF files need PyMuPDF, which is not installed") from e
    with fitz.open(stream=content, filetype="pdf") as pages:
        return "".join(f"\n--- Page {k} ---\n{page.get_text()}" for k, page in enumerate(pages, 1))


@F.pandas_udf(StructType([StructField("text", StringType()), StructField("error", StringType())]))
def _packed(content: pd.Series, suffix: pd.Series) -> pd.DataFrame:
    out = []
    for data, kind in zip(content, suffix, strict=True):
        try:
            out.append(((docx_text if kind == ".docx" else pdf_text)(data), None))
        except Exception as e:
            out.append((None, f"{type(e).__name__}: {e}"))
    return pd.DataFrame(out, columns=["text", "error"])


def parse(files: DataFrame) -> DataFrame:
    """Adds ``text``, ``status`` and ``error``. Plain formats stay native; only packed ones go to Python."""
    plain = F.col("format").isin(".txt", ".sql")
    strict = (F.col("format") == ".sql") & ~F.is_valid_utf8(F.col("content").cast("string"))
    bad = F.when(strict, "not UTF-8").when(~F.col("format").isin(*TEXT_FORMATS), F.concat(F.lit("Unsupported format: "), "format"))
    native = files.where(plain | ~F.col("format").isin(*TEXT_FORMATS)).withColumn("error", bad).withColumn("text", F.when(F.col("error").isNull(), decoded(F.col("content"))))
    packed = files.where(F.col("format").isin(".docx", ".pdf")).withColumn("p", _packed("content", "format")).withColumns({"text": F.col("p.text"), "error": F.col("p.error")}).drop("p")
    return native.unionByName(packed).withColumn("status", F.when(F.col("error").isNull(), "success").otherwise("error"))

