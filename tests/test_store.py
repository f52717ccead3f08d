"""The store, restored sessions, redaction of files and the interfaces that need other packages."""

import io
import zipfile

import pytest
from pyspark.sql import functions as F

from siftline.operators import analytics, catalog, images, redaction, risk, spans
from siftline.operators.detect import scan
from siftline.sources import files, sinks
from siftline.sources.store import Store, persist_scan


def at(day):
    return F.lit(f"2024-05-{day:02d} 10:00:00").cast("timestamp")


BATCH = "path string, name string, format string, size long, hash string, text string, source string, ocr struct<confidence:double,word_count:int,ocr_language:string>"


def batch(spark, rows):
    return scan(spark.createDataFrame(rows, BATCH))


def docx(*paragraphs):
    w = "xmlns:w='http://schemas.openxmlformats.org/wordprocessingml/2006/main'"
    body = "".join("<w:p>" + "".join(f"<w:r><w:t>{t}</w:t></w:r>" for t in p) + "</w:p>" for p in paragraphs)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f"<w:document {w}><w:body>{body}</w:body></w:document>")
    return out.getvalue()


def test_persist_and_restore(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"), parts=4)
    first = [("/in/a", "a", ".txt", 1, "h1", "mail a@b.co card 4111 1111 1111 1111", None, None), ("/in/b", "b", ".txt", 2, "h2", "ssn 123-45-6789", "ocr", (91.5, 2, "en")), ("/in/c", "c", ".txt", 3, "h3", None, None, None)]
    got = {r["path"]: r for r in persist_scan(store, batch(spark, first), at(1)).collect()}
    assert {p: r["id"] for p, r in got.items()} == {"/in/a": 1, "/in/b": 2, "/in/c": 3} and all(r["duplicate_of"] is None for r in got.values())
    assert got["/in/a"]["compliance"]["GDPR"]["status"] == "Fail" and got["/in/c"]["compliance"]["GDPR"]["status"] == "Pass"
    assert store.read("detections").count() == 3 and store.read("ocr_results").first()["word_count"] == 2
    # A changed file loses its old detections, others keep theirs; a new one has the content of another.
    second = [("/in/a", "a", ".txt", 9, "h9", "nothing", None, None), ("/in/d", "d", ".txt", 2, "h2", "ssn 123-45-6789", None, None)]
    got = {r["path"]: r for r in persist_scan(store, batch(spark, second), at(2)).collect()}
    assert got["/in/a"]["id"] == 1 and got["/in/d"]["id"] == 4 and got["/in/d"]["duplicate_of"] == 2
    rows = {r["file_path"]: r for r in store.read("files").collect()}
    assert len(rows) == 4 and rows["/in/a"]["file_size"] == 9 and rows["/in/a"]["total_findings_count"] == 0 and rows["/in/b"]["entity_type_counts"] == {"ID Number": 1}
    assert sorted((r["file_id"], r["entity_type"], r["data_found"]) for r in store.read("detections").collect()) == [(2, "ID Number", "123***789"), (4, "ID Number", "123***789")]
    present = spark.createDataFrame([("/in/a", "nothing"), ("/in/b", "x")], "path string, text string")
    back = {r["id"]: r for r in analytics.session(store.read("files"), store.read("detections"), store.read("ocr_results"), present=present).collect()}
    assert set(back) == {1, 2} and back[1]["findings"] == [] and back[1]["extracted_text"] == "nothing" and back[2]["extracted_text"] == "ssn 123-45-6789"
    assert back[2]["findings"][0]["value"] == "123-45-6789" and back[2]["risk"]["risk_level"] == "low" and back[2]["compliance"]["HIPAA"]["status"] == "Fail"
    store.append("logs", spark.createDataFrame([(1, "INFO", "kept")], "id long, log_level string, message string"))
    assert store.read("logs").count() == 1 and store.size() > 0
    store.delete_files(store.read("files").where("id = 2"))
    store.clean()
    assert not (tmp_path / "store/_stage").exists()
    assert sorted(r["id"] for r in store.read("files").collect()) == [1, 3, 4] and store.read("ocr_results").count() == 0 and store.read("detections").count() == 1


def test_session_of_many_files(spark, tmp_path):
    """The newest files are those of the last paths, with their own names, when a batch takes several range partitions."""
    n = 12_000
    text = F.concat(*[F.sha2(F.concat(F.lit(f"{k} "), F.col("id").cast("string")), 512) for k in range(4)])
    path = F.format_string("/in/%05d", F.pmod(F.col("id") * 7919, F.lit(n)))
    rows = spark.range(n, numPartitions=4).select(path.alias("path"), F.substring(path, 5, 5).alias("name"), F.lit(".txt").alias("format"), "id", F.lit(1).cast("long").alias("size"), F.sha2(path, 256).alias("hash"), text.alias("text"), F.array().cast(f"array<{spans.FINDING}>").alias("findings"))
    store = Store(spark, str(tmp_path / "store"), parts=2)
    persist_scan(store, rows.drop("id"), at(1))
    back = analytics.session(store.read("files"), store.read("detections"), store.read("ocr_results"), limit=50)
    assert sorted((r["id"], r["filename"]) for r in back.select("id", "filename").collect()) == [(k + 1, f"{k:05d}") for k in range(n - 50, n)]


def test_redaction_of_files(spark, tmp_path):
    mail, card = "bob@mail.com", "4111 1111 1111 1111"
    rows = [
        (1, "a.txt", ".txt", f"mail {mail} card {card}", None),
        (2, "b.docx", ".docx", f"mail {mail}\n{mail}\n", docx(["mail bob@", "mail.com"], [mail], ["other"])),
        (3, "c.pdf", ".pdf", mail, b"x"),
        (4, "d.png", ".png", mail, b"x"),
        (5, "e.xyz", ".xyz", mail, None),
        (6, "f.txt", ".txt", "nothing", None),
        (7, "g.docx", ".docx", mail, b"broken"),
    ]
    df = scan(spark.createDataFrame(rows, "id long, name string, format string, text string, content binary"))
    done = redaction.run(df)
    got = {r["id"]: r["redaction"] for r in done.collect()}
    assert {i: r["status"] for i, r in got.items()} == {1: "redacted", 2: "redacted", 3: "error", 4: "error", 5: "error", 6: "skipped", 7: "error"}
    assert got[1]["redacted"] == "mail bo********om card [REDACTED]" and got[1]["n"] == 2
    assert got[2]["n"] == 2 and files.docx_text(bytes(got[2]["content"])) == "mail bo********om\nbo********om\nother\n"
    assert "PyMuPDF" in got[3]["error"] and "Pillow" in got[4]["error"] and got[5]["error"] == "Unsupported format: .xyz" and "BadZipFile" in got[7]["error"]
    full = {r["id"]: r["redaction"] for r in redaction.run(df, "full").collect()}
    assert full[1]["redacted"] == f"mail {mail} card [REDACTED]" and full[2]["status"] == "skipped"
    assert sorted((r["file_id"], r["findings_redacted"], r["output_path"]) for r in redaction.records(done, at(1), "auto", folder="/out").collect()) == [(1, 2, "/out/redacted_a.txt"), (2, 2, "/out/redacted_b.docx")]
    assert {r["id"]: r["post_redaction_findings_count"] for r in redaction.rescan(done).collect()} == {1: 0, 2: 0}
    chosen = redaction.run(df.where("id = 1").withColumn("pick", F.array(F.lit(1))), chosen="pick").first()["redaction"]
    assert chosen["redacted"] == f"mail {mail} card [REDACTED]"
    content = F.coalesce("redaction.content", F.encode("redaction.redacted", "UTF-8"))
    out = sinks.write_files(done.where("redaction.status = 'redacted'"), str(tmp_path / "out"), F.col("name"), content).collect()
    assert sorted(r["path"].rsplit("/", 1)[1] for r in out) == ["a.txt", "b.docx"] and (tmp_path / "out/a.txt").read_text() == got[1]["redacted"]


def test_reports(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    persist_scan(store, batch(spark, [("/in/a", "a", ".txt", 10, "h1", "mail a@b.co card 4111 1111 1111 1111", None, None)]), at(1)).collect()
    f, d = store.read("files"), store.read("detections")
    info = {r["name"]: r["value"] for r in analytics.database_info({"files": f, "detections": d}, store.size()).collect()}
    assert info["total_files"] == 1 and info["total_detections"] == 2 and info["database_size"] > 0
    report = {(r["section"], r["name"]): r["value"] for r in analytics.statistics_report(f, d).collect()}
    assert report["overall", "total_detections"] == 2 and report["types", "Email"] == 1 and report["redactions", "redacted_documents"] == 0
    one = analytics.files_report(f, d).first()
    assert (one["findings"], one["high"], one["medium"], one["low"]) == (2, 1, 1, 0)
    sinks.write_csv(analytics.file_history(f, d), str(tmp_path / "csv"))
    sinks.write_json(analytics.export_report(f, d, store.read("redactions"), store.read("ocr_results")), str(tmp_path / "json"))
    assert spark.read.option("header", "true").csv(str(tmp_path / "csv")).first()["detection_count"] == "2"
    assert len(spark.read.json(str(tmp_path / "json")).first()["detections"]) == 2
    settings = catalog.set_settings(store.read("app_settings"), spark.createDataFrame([("default_scan_mode", "deep")], "key string, value string"), at(1))
    assert {r["key"]: r["json"] for r in catalog.settings(settings).collect()}["default_scan_mode"] == '"deep"'
    df = scan(spark.createDataFrame([("mail a@b.co card 4111 1111 1111 1111",)], "text string"))
    r = df.select(risk.at_least(F.col("findings"), "high").alias("h"), risk.at_least(F.col("findings"), "medium").alias("m"), risk.preview(F.col("findings"), 1).alias("p")).first()
    assert (len(r["h"]), len(r["m"]), len(r["p"])) == (1, 2, 1)


def test_work_that_needs_other_packages():
    with pytest.raises(images.MissingPackage, match="OpenCV"):
        images.load_image(b"x")
    with pytest.raises(images.MissingPackage, match="PaddleOCR"):
        images.recognise(None)
    with pytest.raises(images.MissingPackage, match="Pillow"):
        images.redact_image(b"x", [])
    with pytest.raises(images.MissingPackage, match="PyMuPDF"):
        images.redact_pdf(b"x", [])
    with pytest.raises(ValueError):
        images.redact_image(b"x", [], "glitter")
    pixels, warnings = images.preprocess(1, ("invert", "sparkle"), {"invert": lambda x: -x})
    assert pixels == -1 and warnings == ["Unknown preprocessing step: sparkle"]
