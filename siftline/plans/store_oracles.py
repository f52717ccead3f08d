"""SQL for the queries over the store."""

from __future__ import annotations

from ..operators.catalog import DEFAULT_SETTINGS
from ..operators.images import NEEDS
from ..operators.patterns import ENTITY_HIGH, ENTITY_MEDIUM, ENTITY_TYPES, FRAMEWORKS, LABEL_HIGH, LABEL_MEDIUM, LABEL_TYPES
from ..sources.files import KEYWORDS
from .oracles import BASE, FILES, FULL, RISK, ROWS, STAMP, SWAP, q

HIGH = "type IN ('Credit Card', 'Password', 'API Key', 'ID Number')"
REDACTIONS = f"""reds AS (SELECT doc_id AS id, doc_id % 30 AS file_id, 'document_redaction' AS redaction_type, CAST(doc_id % 4 AS INT) AS findings_redacted, CASE
  WHEN doc_id % 5 <> 0 THEN 'blackout' END AS strategy, {STAMP} + to_seconds(doc_id) AS t
  FROM documents
  WHERE doc_id % 3 = 0)"""
OCR = f"""ocr AS (SELECT doc_id AS id, doc_id - doc_id % 2 AS file_id, CAST(doc_id % 100 AS DOUBLE) AS confidence, {STAMP} + to_seconds(doc_id) AS t, lang
  FROM documents)"""


def listed(names) -> str:
    return ", ".join(map(q, names))


def case(column: str, table: dict[str, str], other: str) -> str:
    return f"CASE {column} " + " ".join(f"WHEN {q(k)} THEN {q(v)}" for k, v in table.items()) + f" ELSE {other} END"


def _settings() -> str:
    own = "('default_scan_mode', n0), ('own_flag', 'True'), ('own_number', '17'), ('own_name', n3)"
    rest = ", ".join(f"({q(k)}, {q(v)})" for k, v in DEFAULT_SETTINGS.items() if k != "default_scan_mode")
    return f"""WITH n AS (SELECT max(n_name) FILTER (n_nationkey = 0) AS n0, max(n_name) FILTER (n_nationkey = 3) AS n3 FROM nation),
own AS (SELECT unnest([{own.replace("(", "{'key': ").replace("', ", "', 'value': ").replace("),", "},").rstrip(")")}}}], recursive := true) FROM n),
everything AS (SELECT key, value FROM own UNION ALL SELECT * FROM (VALUES {rest}))
SELECT key, value, CASE WHEN value IN ('true', 'false', '17') THEN value WHEN value = 'True' THEN 'true' ELSE '"' || value || '"' END AS json FROM everything"""


_LABELS = ", ".join(f"({q(x)})" for x in (*ENTITY_TYPES, *LABEL_TYPES, "Other"))
_LABEL_TYPE = case("lower(label)", LABEL_TYPES, "{}")
_INITCAP = "array_to_string(list_transform(string_split(label, ' '), lambda w: upper(left(w, 1)) || lower(substr(w, 2))), ' ')"
_TEXT = "'insert into t; ' || p_name || '; UPDATED x; delete; Alter; droplet; selector; created ' || p_name"
_X = "CAST(p_partkey % 50 AS INT)"


def clamped(x1: str, y1: str, x2: str, y2: str, width: int = 100, height: int = 60) -> str:
    a, b = f"greatest(0, least({x1}, {width - 1}))", f"greatest(0, least({y1}, {height - 1}))"
    return f"concat_ws(',', {a}, {b}, greatest({a} + 1, least({x2}, {width})), greatest({b} + 1, least({y2}, {height})))"


_WIDE = "(CAST(p_size AS INT) * 3)"
_N = "greatest(length(p_name), 1)"
_FORMAT = "['.txt', '.pdf', '.xyz', '.sql', '.png'][CAST(doc_id % 5 AS INT) + 1]"
_GDPR = listed(FRAMEWORKS["GDPR"][0])

ORACLES = {
    "risk_updates": """SELECT doc_id AS id, CASE WHEN doc_id % 2 = 0 THEN CAST(doc_id % 100 AS DOUBLE) ELSE 1.0 END AS risk_score, CASE WHEN doc_id % 2 = 0 THEN 'high' ELSE 'low' END AS risk_level,
  CASE WHEN doc_id % 2 = 0 THEN 'unclassified' ELSE 'old' END AS document_classification, CASE WHEN doc_id % 6 = 0 THEN '/new'
  ELSE '/old' END AS redacted_version_path,
  CASE WHEN doc_id % 10 = 0 THEN 'blackout' ELSE 'blur' END AS redaction_strategy, CAST(CASE WHEN doc_id % 2 = 0 THEN 3 ELSE 0 END AS INT) AS total_findings_count FROM documents""",
    "post_redaction_updates": """SELECT doc_id AS id, CASE WHEN doc_id % 3 = 0 THEN 0.5 ELSE 9.0 END::DOUBLE AS post_redaction_risk_score, CASE WHEN doc_id % 6 = 0 THEN 'low'
  ELSE 'high' END AS post_redaction_risk_level, CAST(CASE WHEN doc_id % 3 = 0 THEN 0 ELSE 4 END AS INT) AS post_redaction_findings_count
  FROM documents""",
    "findings_at_least": f"""{BASE} SELECT d.doc_id, CAST(count(*) FILTER ({HIGH}) AS INT) AS n_high, CAST(count(*) FILTER ({HIGH} OR confidence >= 0.5) AS INT) AS n_medium,
  CAST(least(count(t.type), 2) AS INT) AS n_shown
  FROM docs d
  LEFT
  JOIN det t ON d.doc_id = t.doc_id
  GROUP BY 1""",
    "detections_by_type": f"""{BASE}, {ROWS} SELECT id, file_id, data_found
  FROM rows
  WHERE entity_type = 'Phone Number'
  ORDER BY detection_timestamp DESC, id DESC LIMIT 100""",
    "detections_for_file": f"{BASE}, {ROWS} SELECT id, file_id, entity_type, data_found FROM rows WHERE file_id = (SELECT max(file_id) FROM rows)",
    "redaction_history": f"""WITH {FILES}, {REDACTIONS} SELECT r.id, file_id, filename, findings_redacted
  FROM reds r
  JOIN files f ON r.file_id = f.id
  ORDER BY t DESC, r.id DESC LIMIT 100""",
    "redactions_for_file": f"WITH {REDACTIONS} SELECT id, file_id, findings_redacted FROM reds WHERE file_id = 6",
    "dedupe_redactions": f"""WITH {REDACTIONS} SELECT min(id) AS id, file_id, strategy, findings_redacted
  FROM reds
  GROUP BY file_id, strategy, findings_redacted""",
    "dedupe_by_hash": f"""{BASE}, {ROWS}, own AS (SELECT id, file_id, CASE WHEN id % 4 <> 0 THEN entity_hash ELSE '' END AS entity_hash
  FROM rows) SELECT *
  FROM own
  WHERE entity_hash = ''
  UNION ALL SELECT min(id), file_id, entity_hash
  FROM own
  WHERE entity_hash <> ''
  GROUP BY file_id, entity_hash""",
    "all_ocr_results": f"""WITH {FILES}, {OCR} SELECT o.id, file_id, filename, confidence
  FROM ocr o
  JOIN files f ON o.file_id = f.id
  ORDER BY t DESC, o.id DESC LIMIT 100""",
    "latest_ocr": f"WITH {OCR} SELECT id, file_id, confidence FROM ocr QUALIFY row_number() OVER (PARTITION BY file_id ORDER BY t DESC, id DESC) = 1",
    "ocr_languages": f"WITH {OCR} SELECT lang AS ocr_language, count(*) AS n FROM ocr GROUP BY 1 ORDER BY n DESC, 1 LIMIT 5",
    "ocr_summaries": """SELECT conv_id, sha256(string_agg(coalesce(text, ''), chr(10)
  ORDER BY turn, role)) AS text_sha256, CAST(round(avg((turn % 8) / 8.0) * 100, 2) AS DOUBLE) AS confidence,
  CAST(len(regexp_extract_all(string_agg(coalesce(text, ''), chr(10)
  ORDER BY turn, role), '\\S+')) AS INT) AS word_count
  FROM conversations
  GROUP BY conv_id""",
    "deleted_files": "SELECT doc_id AS id, source AS file_format FROM documents WHERE NOT coalesce(source <> 'src1' AND doc_id % 2 = 0, false)",
    "get_file": f"WITH {FILES} SELECT id, file_path FROM files WHERE id = 7 OR file_path = '/in/doc_11.txt'",
    "restored_findings": f"""{BASE}, {ROWS}, own AS (SELECT r.*, d.value AS v, d.s, d.e, d.line FROM rows r JOIN det d ON r.file_id = d.doc_id AND r.id = d.doc_id * 100000 + d.s)
SELECT file_id, CASE WHEN id % 3 <> 0 THEN entity_type WHEN id % 9 <> 0 THEN pattern_matched ELSE 'Unknown' END AS type, CASE WHEN id % 2 = 0 THEN v ELSE data_found END AS value, risk_level AS severity, s AS start, e AS "end", CASE WHEN id % 5 <> 0 THEN line ELSE 1 END AS line FROM own""",
    "replaced_detections": f"""{BASE}, {ROWS} SELECT id, file_id, data_found
  FROM rows
  WHERE file_id % 2 <> 0
  UNION ALL SELECT -doc_id, doc_id, 'new'
  FROM documents
  WHERE doc_id % 4 = 0""",
    "files_report": f"""{BASE}, {FILES}, {ROWS} SELECT f.id, filename, count(r.id) AS findings, count(r.id) FILTER (r.risk_level = 'high') AS high,
  count(r.id) FILTER (r.risk_level = 'medium') AS medium, count(r.id) FILTER (r.risk_level = 'low') AS low
  FROM (SELECT *
  FROM files
  ORDER BY upload_date DESC, id DESC LIMIT 500) f
  LEFT
  JOIN rows r ON f.id = r.file_id
  GROUP BY 1, 2""",
    "redacted_documents": "SELECT count(*) FILTER (doc_id % 4 = 0) AS redacted_documents FROM documents",
    "tracking_totals": f"{BASE}, {ROWS} SELECT count(*) AS total, count(DISTINCT file_id) AS hashed_files FROM rows",
    "database_info": f"""{BASE}, {REDACTIONS} SELECT 'total_files' AS name, count(*) AS value
  FROM documents
  UNION ALL SELECT 'total_detections', count(*)
  FROM det
  UNION ALL SELECT 'total_redactions', count(*)
  FROM reds
  UNION ALL SELECT 'total_ocr_results', count(*)
  FROM documents
  UNION ALL SELECT 'database_size', 4096""",
    "statistics_report": f"""{BASE}, {RISK}, {FILES}, {ROWS},
overall AS (SELECT unnest([{{'n': 'total_files', 'v': (SELECT count(*)
  FROM files)}}, {{'n': 'total_size', 'v': (SELECT CAST(sum(file_size) AS BIGINT)
  FROM files)}}, {{'n': 'total_detections', 'v': (SELECT count(*)
  FROM rows)}},
  {{'n': 'high_risk', 'v': (SELECT count(*)
  FROM rows
  WHERE risk_level = 'high')}}, {{'n': 'medium_risk', 'v': (SELECT count(*)
  FROM rows
  WHERE risk_level = 'medium')}}, {{'n': 'low_risk', 'v': (SELECT count(*)
  FROM rows
  WHERE risk_level = 'low')}}]) AS x),
shared AS (SELECT min(entity_type) AS name, count(*) AS n, count(DISTINCT file_id) AS f, entity_hash
  FROM rows
  GROUP BY entity_hash
  HAVING count(*) > 1
  ORDER BY n DESC, f DESC, entity_hash LIMIT 10),
common AS (SELECT type, count(*) AS n FROM det GROUP BY 1 ORDER BY n DESC, type LIMIT 10)
SELECT 'overall' AS section, x.n AS name, x.v AS value
  FROM overall
  UNION ALL SELECT 'risk', level, count(*)
  FROM levels
  WHERE level <> 'low'
  GROUP BY level
  UNION ALL SELECT 'types', type, n
  FROM common
UNION ALL SELECT 'redactions', 'redacted_documents', count(*) FILTER (doc_id % 4 = 0) FROM documents UNION ALL SELECT 'entities', name, n FROM shared""",
    "old_logs_cleared": "SELECT event_id AS id FROM events WHERE ts >= TIMESTAMP '2024-01-08 00:00:00' - INTERVAL 3 DAY",
    "settings_overlay": _settings(),
    "recognizer_labels": f"""SELECT label, {case("label", ENTITY_TYPES, "label")} AS entity_type, CASE WHEN label IN ({listed(ENTITY_HIGH)}) THEN 'high' WHEN label IN ({listed(ENTITY_MEDIUM)}) THEN 'medium' ELSE 'low' END AS entity_severity,
  {_LABEL_TYPE.format(_INITCAP)} AS label_type, CASE WHEN {_LABEL_TYPE.format("label")} IN ({listed(LABEL_HIGH)}) THEN 'high' WHEN {_LABEL_TYPE.format("label")} IN ({listed(LABEL_MEDIUM)}) THEN 'medium' ELSE 'low' END AS label_severity FROM (VALUES {_LABELS}) v(label)""",
    "kept_entities": """SELECT c_custkey, c_custkey % 4 <> 0 AND length(trim(left(c_name, CAST(c_custkey % 5 AS INT)))) >= 3 AND (c_custkey % 4 = 2
  OR c_custkey % 100 >= 75) AS kept
  FROM customer""",
    "selected_findings": f"""{BASE}, n AS (SELECT d.doc_id, count(t.type) AS n
  FROM docs d
  LEFT
  JOIN det t ON d.doc_id = t.doc_id
  GROUP BY 1) SELECT doc_id, CAST(CASE WHEN doc_id % 2 = 0 THEN (n > 0)::INT + (n > 2)::INT + (n > 9)::INT ELSE n END AS INT) AS n
  FROM n""",
    "language_lists": """SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'en'
  ELSE array_to_string(list_filter(list_transform(string_split(replace(' ' || lang || '+fr,, ' || source, '+', ','), ','), lambda x: trim(x)), lambda x: x <> ''), ';') END AS languages
  FROM documents""",
    "lenient_values": """SELECT doc_id, CAST(CASE doc_id % 3 WHEN 0 THEN doc_id WHEN 1 THEN doc_id % 7 ELSE 1 END AS INT) AS line, CAST(CASE
  WHEN doc_id % 4 = 0 THEN doc_id ELSE 0 END AS INT) AS emails
  FROM documents""",
    "keyword_counts": f"WITH t AS (SELECT p_partkey, {_TEXT} AS t FROM part) SELECT p_partkey, CAST(len(list_filter(string_split(t, ';'), lambda x: trim(x) <> '')) AS INT) AS queries, " + ", ".join(f"CAST(len(regexp_extract_all(upper(t), '{k}')) AS INT) AS n_{k.lower()}" for k in KEYWORDS) + " FROM t",
    "word_boxes": f"""SELECT p_partkey, {clamped(f"CAST({_X} + floor({_WIDE} * 1 / {_N}) AS INT)", "5", f"CAST({_X} + ceil({_WIDE} * 4 / {_N}) AS INT)", "15")} AS part,
  concat_ws(',', least({_X}, 1), least({_X}, 1), greatest({_X}, 20), greatest({_X}, 30)) AS quad, {clamped(f"least({_X}, 10)", "-4", f"greatest(30, {_X} * 4)", "9")} AS over FROM part""",
    "batch_redaction": f"""{BASE}, own AS (SELECT doc_id, s, e, type, value FROM det WHERE type IN ({FULL}) OR severity = 'high'),
lists AS (SELECT doc_id, list({{'s': s, 'e': e, 'type': type, 'value': value}} ORDER BY s) AS l FROM own GROUP BY doc_id),
texts AS (SELECT d.doc_id, {_FORMAT.replace("doc_id", "d.doc_id")} AS format, l, CASE
  WHEN l IS NOT NULL THEN array_to_string(list_transform(l, lambda x, i: substr(d.text, (CASE WHEN i = 1 THEN 0
  ELSE l[i - 1].e END) + 1, x.s - (CASE WHEN i = 1 THEN 0 ELSE l[i - 1].e END)) || {SWAP}), '') || substr(d.text, l[-1].e + 1) END AS r
  FROM docs d
  LEFT
  JOIN lists l ON d.doc_id = l.doc_id),
told AS (SELECT *, CASE WHEN l IS NULL THEN 'skipped' WHEN format IN ('.txt', '.sql') THEN 'redacted' ELSE 'error' END AS status FROM texts)
SELECT doc_id, status, CAST(CASE WHEN status = 'redacted' THEN len(l) ELSE 0 END AS INT) AS n, CASE WHEN status = 'error' THEN CASE format WHEN '.pdf' THEN {q(NEEDS[".pdf"])} WHEN '.png' THEN {q(NEEDS["image"])} ELSE 'Unsupported format: ' || format END END AS error, CASE WHEN status = 'redacted' THEN sha256(r) END AS redacted_sha256 FROM told""",
    "persisted_scans": f"""{BASE}, {RISK} SELECT row_number() OVER (ORDER BY lpad(CAST(d.doc_id AS VARCHAR), 9, '0')) AS id, '/in/' || lpad(CAST(d.doc_id AS VARCHAR), 9, '0') AS file_path, 'doc_' || d.doc_id AS filename, d.n_chars AS file_size,
  CASE WHEN d.doc_id % 2 = 0 THEN 'low' ELSE level END AS risk_level, CAST(CASE WHEN d.doc_id % 2 = 0 THEN 0 ELSE n END AS INT) AS total_findings_count, CASE WHEN d.doc_id % 2 = 0 THEN 0 ELSE n END AS detections, CAST(d.doc_id % 3 = 0 AS BIGINT) AS ocr_results FROM documents d JOIN levels l ON d.doc_id = l.doc_id""",
    "restored_session": f"""{BASE}, {RISK}, f AS (SELECT doc_id, row_number() OVER (ORDER BY lpad(CAST(doc_id AS VARCHAR), 9, '0')) AS id FROM documents), top AS (SELECT * FROM f ORDER BY id DESC LIMIT 200),
g AS (SELECT doc_id, count(*) FILTER (type IN ({_GDPR})) AS hits, count(*) FILTER (severity = 'high') AS h FROM det GROUP BY doc_id)
SELECT t.id, 'doc_' || t.doc_id AS filename, CAST(n AS INT) AS n_findings, score AS risk_score, CASE WHEN coalesce(hits, 0) = 0 THEN 'Pass'
  WHEN g.h > 0 THEN 'Fail' ELSE 'Review' END AS gdpr, t.doc_id % 3 <> 0 AS parsed
FROM top t JOIN levels l ON t.doc_id = l.doc_id LEFT JOIN g ON t.doc_id = g.doc_id WHERE t.doc_id % 5 <> 0""",
}
