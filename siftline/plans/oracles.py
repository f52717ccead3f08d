"""SQL for DuckDB that computes what the named queries return."""

from __future__ import annotations

from ..operators.patterns import FRAMEWORKS, FULL_REDACTION, PATTERNS, RECOGNIZERS, WEIGHTS
from .queries import LITERALS

#: RE2 has no look-around: the same matches, with a word's edge at either end.
PHONE = r"(?:\B\+\d{1,3}[\s.-]?(?:\(?\d{2,4}\)?[\s.-]?)?\d{3,4}[\s.-]?\d{4}|\b\d{1,3}[\s.-]?(?:\(?\d{2,4}\)?[\s.-]?)?\d{3,4}[\s.-]?\d{4}|\B\(\d{2,4}\)?[\s.-]?\d{3,4}[\s.-]?\d{4}|\b\d{2,4}\)?[\s.-]?\d{3,4}[\s.-]?\d{4}|\b\d{3,4}[\s.-]?\d{4})\b"


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def luhn(v: str) -> str:
    digits = f"regexp_replace({v}, '[^0-9]', '', 'g')"
    total = f"list_sum(list_transform(range(1, length({digits}) + 1), lambda i: CASE WHEN (length({digits}) - i) % 2 = 0 THEN CAST(substr({digits}, i, 1) AS INT) WHEN CAST(substr({digits}, i, 1) AS INT) > 4 THEN 2 * CAST(substr({digits}, i, 1) AS INT) - 9 ELSE 2 * CAST(substr({digits}, i, 1) AS INT) END))"
    return f"(length({digits}) BETWEEN 13 AND 19 AND coalesce({total}, 1) % 10 = 0)"


def mask(v: str) -> str:
    at = f"strpos({v}, '@')"
    return f"CASE WHEN length({v}) <= 4 THEN repeat('*', length({v})) WHEN {at} > 0 THEN (CASE WHEN {at} > 3 THEN left({v}, 2) ELSE left({v}, least({at} - 1, 1)) END) || '***@' || substr({v}, {at} + 1) ELSE left({v}, 3) || '***' || right({v}, 4) END"


def edges(v: str, n: int) -> str:
    return f"CASE WHEN {v} = '' THEN '' ELSE left({v}, {n}) || '***' || (CASE WHEN length({v}) > {n} THEN right({v}, {n}) ELSE '' END) END"


def tracked(v: str) -> str:
    return f"CASE WHEN {v} = '' THEN '' WHEN length({v}) <= 4 THEN repeat('*', length({v})) ELSE left({v}, 3) || '***' || right({v}, 3) END"


def partial(v: str) -> str:
    return f"CASE WHEN {v} = '' THEN '****' WHEN length({v}) <= 5 THEN repeat('*', length({v})) ELSE left({v}, 2) || repeat('*', length({v}) - 4) || right({v}, 2) END"


def hits(p, k: int, source: str) -> str:
    """Matches of one pattern, from the pieces between them."""
    regex = q(PHONE if p.type == "Phone Number" else p.regex)
    value = f"regexp_extract(m, {regex}, {p.group})" if p.group else "m"
    keep = f"value <> '' AND {luhn('value')}" if p.luhn else "value <> ''"
    return f"""SELECT doc_id, {k} AS ord, {q(p.type)} AS type, {q(p.label or p.type)} AS label, {q(p.severity)} AS severity, CAST({p.confidence} AS DOUBLE) AS confidence, value, e - length(value) AS s, e FROM (
  SELECT doc_id, e, {value} AS value FROM (
    SELECT doc_id, ms[i] AS m,
  CAST(list_sum(list_transform(ps[1:i], lambda x: length(x))) + list_sum(list_transform(ms[1:i], lambda x: length(x))) AS INT) AS e
  FROM (
      SELECT doc_id, ms, ps, unnest(range(1, len(ms) + 1)) AS i FROM (
        SELECT doc_id, regexp_extract_all(text, {regex}) AS ms, string_split_regex(text, {regex}) AS ps FROM {source} WHERE regexp_matches(text, {regex}))))) WHERE {keep}"""


def found(patterns=PATTERNS, source: str = "docs", literal: bool = False) -> str:
    """``det``: doc_id, pos, and fields of the quick scan; ``scanned``: the same by document as lists."""
    rows = "(VALUES " + ", ".join(f"({k}, {q(t)})" for k, t in LITERALS) + ") v(doc_id, text)" if literal else "documents"
    docs = f"docs AS (SELECT CAST(doc_id AS BIGINT) AS doc_id, regexp_replace(coalesce(text, ''), '\\r\\n?', chr(10), 'g') AS text FROM {rows})"
    each = " UNION ALL ".join(hits(p, k, source) for k, p in enumerate(patterns))
    return f"""{docs}, hits AS ({each}),
ranked AS (SELECT doc_id, list({{'s': s, 'e': e, 'type': type, 'label': label, 'value': value, 'severity': severity, 'confidence': confidence}}
  ORDER BY CASE severity WHEN 'high' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END, s - e, s, ord) AS l
  FROM hits
  GROUP BY doc_id),
kept AS (SELECT doc_id, list_reduce(list_transform(l, lambda x: [x]), lambda acc, x: CASE WHEN len(list_filter(acc, lambda a: a.s < x[1].e
  AND x[1].s < a.e)) > 0 THEN acc ELSE list_concat(acc, x) END) AS l
  FROM ranked),
flat AS (SELECT doc_id, unnest(l) AS f FROM kept),
det AS (SELECT f.doc_id, CAST(row_number() OVER (PARTITION BY f.doc_id
  ORDER BY f.f.s, f.f.type) - 1 AS INT) AS pos, f.f.type AS type, f.f.label AS label, f.f.value AS value, f.f.severity AS severity, f.f.s AS s, f.f.e AS e, f.f.confidence AS confidence, CAST(length(substr(d.text, 1, f.f.s)) - length(replace(substr(d.text, 1, f.f.s), chr(10), '')) + 1 AS INT) AS line
  FROM flat f JOIN docs d ON f.doc_id = d.doc_id)"""


BASE = "WITH " + found()
STAMP = "TIMESTAMP '2024-01-01 00:00:00'"
FILES = f"""files AS (SELECT doc_id AS id, 'doc_' || doc_id || '.txt' AS filename, '/in/doc_' || doc_id || '.txt' AS file_path, n_chars AS file_size, source AS file_format, {STAMP} + to_hours(CAST(doc_id AS INT)) AS upload_date, sha256(coalesce(text, '')) AS file_hash
  FROM documents)"""
ROWS = f"""rows AS (SELECT doc_id * 100000 + s AS id, doc_id AS file_id, 'regex' AS detection_type, type AS pattern_matched, {tracked('value')} AS data_found, 'line ' || line AS location_info, severity AS risk_level, {STAMP} + to_seconds(doc_id * 3600 + s) AS detection_timestamp, type AS entity_type, sha256(type || ':' || trim(value)) AS entity_hash
  FROM det)"""
_WEIGHT = "CASE type " + " ".join(f"WHEN {q(k)} THEN {v}" for k, v in WEIGHTS.items()) + " ELSE 1.0 END"
RISK = f"""sev AS (SELECT doc_id, count(*) AS n, count(*) FILTER (severity = 'high') AS h, count(*) FILTER (severity = 'medium') AS m, count(*) FILTER (severity = 'low') AS w, arg_min(severity, pos) AS first FROM det GROUP BY doc_id),
types AS (SELECT doc_id, type, count(*) AS n, min(pos) AS ord FROM det GROUP BY doc_id, type),
weights AS (SELECT doc_id, sum(n * {_WEIGHT}) AS weighted, array_to_string((list(type ORDER BY n DESC, ord))[1:5], ',') AS top FROM types GROUP BY doc_id),
scores AS (SELECT d.doc_id, coalesce(s.n, 0) AS n, coalesce(s.h, 0) AS h, coalesce(s.m, 0) AS m, coalesce(s.w, 0) AS w, coalesce(t.top, '') AS top,
  CASE WHEN s.n IS NULL THEN 0.0 ELSE CAST(round(least(least(10 * h + 5 * m + 2 * w, 100) + least(2 * t.weighted * CASE first WHEN 'low' THEN 1
  WHEN 'high' THEN 3 ELSE 2 END, 100 - least(10 * h + 5 * m + 2 * w, 100)), 100), 2) AS DOUBLE) END AS score
  FROM docs d LEFT JOIN sev s ON d.doc_id = s.doc_id LEFT JOIN weights t ON d.doc_id = t.doc_id),
levels AS (SELECT *, CASE WHEN score >= 60 THEN 'high' WHEN score >= 25 THEN 'medium' ELSE 'low' END AS level FROM scores)"""
FULL = ", ".join(map(q, FULL_REDACTION))
SWAP = f"CASE WHEN x.type IN ({FULL}) THEN '[REDACTED]' ELSE {partial('x.value')} END"


def of_type(kind: str) -> str:
    k, p = next((k, p) for k, p in enumerate(PATTERNS) if p.type == kind)
    return f"""WITH docs AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '\\r\\n?', chr(10), 'g') AS text FROM documents), hits AS ({hits(p, k, 'docs')})
SELECT h.doc_id, value, {mask('value')} AS masked_value, s AS start, e AS "end",
  CAST(length(substr(text, 1, s)) - length(replace(substr(text, 1, s), chr(10), '')) + 1 AS INT) AS line,
  trim(regexp_replace(substr(text, greatest(s - 80, 0) + 1, e + 80 - greatest(s - 80, 0)), '\\s+', ' ', 'g')) AS context FROM hits h JOIN docs d ON h.doc_id = d.doc_id"""


def verdict(name: str) -> str:
    listed = ", ".join(map(q, FRAMEWORKS[name][0]))
    return f"CASE WHEN count(*) FILTER (type IN ({listed})) = 0 THEN 'Pass' WHEN count(*) FILTER (severity = 'high') > 0 THEN 'Fail' ELSE 'Review' END AS {name.lower()}"


ORACLES = {
    "email_findings": of_type("Email"),
    "phone_findings": of_type("Phone Number"),
    "card_findings_luhn": of_type("Credit Card"),
    "quick_scan": f'{BASE} SELECT doc_id, pos, type, value, {mask("value")} AS masked_value, severity, s AS start, e AS "end", line, confidence FROM det',
    "risk_by_level": f"""{BASE}, {RISK} SELECT level AS risk_level, count(*) AS n_docs, CAST(sum(n) AS BIGINT) AS n_findings, round(avg(score), 6) AS mean_score
  FROM levels
  GROUP BY level""",
    "mask_variants": f"""WITH v AS (SELECT c_name AS value FROM customer UNION SELECT string_split(p_name, ' ')[-1] FROM part UNION SELECT left(reverse(s_name), CAST(s_suppkey % 4 + 1 AS INT)) || '@example.com' FROM supplier UNION SELECT left(n_name, n_nationkey % 7) FROM nation)
SELECT value, {mask("value")} AS regex_mask, {edges("value", 3)} AS edge_mask, {edges("value", 2)} AS short_mask, {tracked("value")} AS tracked_mask, {partial("value")} AS partial_mask FROM v""".replace("string_split(p_name, ' ')[-1]", "string_split(p_name, ' ')[1]"),
    "entity_hashes": "SELECT c_custkey, sha256(c_mktsegment || ':' || c_name) AS entity_hash FROM customer",
    "luhn_checks": f"""WITH o AS (SELECT o_orderkey, '4' || lpad(CAST(o_orderkey * 7919 AS VARCHAR), 15, '0') AS number
  FROM orders) SELECT o_orderkey, {luhn('number')} AS passes, {luhn('(left(number, 4) || substr(number, 5, 9))')} AS short_passes
  FROM o""",
    "pattern_literals": f'WITH {found(literal=True)} SELECT doc_id, pos, type, label, value, severity, s AS start, e AS "end", confidence FROM det',
    "risk_level_cases": f"""{BASE} SELECT doc_id, pos, CASE WHEN type IN ('Credit Card', 'Password', 'API Key', 'ID Number') THEN 'high'
  WHEN confidence >= 0.5 THEN 'medium' ELSE 'low' END AS risk_level
  FROM det""",
    "risk_distribution": f"""{BASE} SELECT count(*) FILTER (type NOT IN ('Credit Card', 'Password', 'API Key', 'ID Number') AND confidence < 0.5) AS low,
  count(*) FILTER (type NOT IN ('Credit Card', 'Password', 'API Key', 'ID Number') AND confidence >= 0.5) AS medium,
  count(*) FILTER (type IN ('Credit Card', 'Password', 'API Key', 'ID Number')) AS high
  FROM det""",
    "doc_risk_scores": f"""{BASE}, {RISK} SELECT doc_id, score AS risk_score, level AS risk_level, CAST(n AS INT) AS total_findings, CAST(h AS INT) AS high_risk_count,
  CAST(m AS INT) AS medium_risk_count, CAST(w AS INT) AS low_risk_count, top AS category_at_risk, CASE
  WHEN n = 0 THEN 'No sensitive information detected. Document appears safe to share.'
  WHEN level = 'high' THEN 'Do NOT share this document without redaction.' WHEN level = 'medium' THEN 'Review recommended before sharing.'
  ELSE 'Document appears safe to share.' END AS recommendation, level = 'low' AS safe_to_share
  FROM levels""",
    "compliance_verdicts": f"{BASE} SELECT d.doc_id, {', '.join(map(verdict, FRAMEWORKS))}, coalesce(array_to_string(list_sort(list(DISTINCT type) FILTER (type IN ({', '.join(map(q, FRAMEWORKS['GDPR'][0]))}))), ','), '') AS gdpr_types FROM docs d LEFT JOIN det t ON d.doc_id = t.doc_id GROUP BY d.doc_id",
    "findings_by_type": f"""{BASE} SELECT type, count(*) AS n, count(*) FILTER (severity = 'high') AS high, count(*) FILTER (severity = 'medium') AS medium,
  count(*) FILTER (severity = 'low') AS low
  FROM det
  GROUP BY type""",
    "overall_stats": f"""{BASE}, {FILES}, {ROWS} SELECT (SELECT count(*)
  FROM files) AS total_files, (SELECT CAST(coalesce(sum(file_size), 0) AS BIGINT)
  FROM files) AS total_size, count(*) AS total_detections, count(*) FILTER (risk_level = 'high') AS high_risk,
  count(*) FILTER (risk_level = 'medium') AS medium_risk, count(*) FILTER (risk_level = 'low') AS low_risk
  FROM rows""",
    "detection_stats": f"""{BASE}, {ROWS} SELECT file_id, 'total' AS what, '' AS name, count(*) AS n
  FROM rows
  GROUP BY 1
  UNION ALL SELECT file_id, 'type', detection_type, count(*)
  FROM rows
  GROUP BY 1, 3
  UNION ALL SELECT file_id, 'level', risk_level, count(*)
  FROM rows
  GROUP BY 1, 3""",
    "entity_tracking": f"{BASE}, {ROWS} SELECT entity_type, count(*) AS n FROM rows GROUP BY 1 ORDER BY n DESC, entity_type LIMIT 25",
    "cross_file_entities": f"""{BASE}, {ROWS} SELECT entity_hash, min(entity_type) AS entity_type, count(*) AS occurrences, count(DISTINCT file_id) AS file_count
  FROM rows
  GROUP BY 1
  HAVING count(*) > 1
  ORDER BY occurrences DESC, file_count DESC, entity_hash LIMIT 25""",
    "risk_analytics": f"{BASE}, {RISK} SELECT level AS risk_level, count(*) AS n FROM levels WHERE level <> 'low' GROUP BY 1",
    "top_entities": f"{BASE} SELECT type AS entity_type, count(*) AS total FROM det GROUP BY 1 ORDER BY total DESC, entity_type LIMIT 10",
    "dashboard": f"{BASE}, {RISK} SELECT count(*) AS scanned_files, CAST(sum(n) AS BIGINT) AS findings, count(*) FILTER (h > 0) AS high_risk_files FROM levels",
    "file_history": f"""{BASE}, {FILES}, {ROWS} SELECT f.id, filename, file_size, upload_date,
  count(r.id) AS detection_count, array_to_string(list_sort(list(DISTINCT r.risk_level) FILTER (r.risk_level IS NOT NULL)), ',') AS risk_levels
  FROM files f
  LEFT
  JOIN rows r ON f.id = r.file_id
  GROUP BY 1, 2, 3, 4""",
    "high_risk_join": f"""{BASE}, {FILES}, {ROWS} SELECT r.id, file_id, filename, pattern_matched, data_found, location_info
  FROM rows r
  JOIN files f ON r.file_id = f.id
  WHERE risk_level = 'high'
  ORDER BY detection_timestamp DESC, r.id DESC LIMIT 100""",
    "recent_files": f"""WITH {FILES} SELECT id, filename, file_size
  FROM files
  WHERE upload_date > TIMESTAMP '2024-01-08 00:00:00' - INTERVAL 7 DAY
  ORDER BY upload_date DESC, id DESC LIMIT 50""",
    "files_by_format": f"WITH {FILES} SELECT id, filename FROM files WHERE file_format = 'src1'",
    "page_offset": f"WITH {FILES} SELECT id, filename FROM files ORDER BY upload_date DESC, id DESC LIMIT 100 OFFSET 50",
    "latest_per_key": """SELECT user_id, event_id AS id, event_type, value
  FROM events
  QUALIFY row_number() OVER (PARTITION BY user_id
  ORDER BY ts DESC, event_id DESC) = 1""",
    "dup_content": f"""WITH {FILES} SELECT a.id, a.file_hash, arg_max(b.id, b.upload_date) AS duplicate_file_id
  FROM files a
  JOIN files b ON a.file_hash = b.file_hash AND a.id <> b.id
  GROUP BY 1, 2""",
    "dedupe_min_id": f"""{BASE}, {ROWS} SELECT id, file_id, data_found, entity_hash
  FROM rows
  QUALIFY row_number() OVER (PARTITION BY file_id, data_found
  ORDER BY id) = 1""",
    "redact_text": f"""{BASE}, lists AS (SELECT doc_id, list({{'s': s, 'e': e, 'type': type, 'value': value}} ORDER BY s) AS l FROM det GROUP BY doc_id),
parts AS (SELECT l.doc_id, len(l) AS n, d.text, array_to_string(list_transform(l, lambda x, i: substr(d.text, (CASE WHEN i = 1 THEN 0
  ELSE l[i - 1].e END) + 1, x.s - (CASE WHEN i = 1 THEN 0 ELSE l[i - 1].e END)) || {SWAP}), '') || substr(d.text, l[-1].e + 1) AS r
  FROM lists l
  JOIN docs d ON l.doc_id = d.doc_id)
SELECT doc_id, CAST(n AS INT) AS n, sha256(r) AS redacted_sha256, CAST(length(text) - length(r) AS INT) AS chars_redacted FROM parts""",
    "findings_by_mode": f"""{BASE} SELECT d.doc_id, CAST(count(t.type) FILTER (type IN ({FULL}) OR severity = 'high') AS INT) AS n_full,
  CAST(count(t.type) FILTER (NOT (type IN ({FULL}) OR severity = 'high')) AS INT) AS n_partial, CAST(count(t.type) AS INT) AS n_auto
  FROM docs d
  LEFT
  JOIN det t ON d.doc_id = t.doc_id
  GROUP BY 1""",
    "recognizer_scan": f"WITH docs AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '\\r\\n?', chr(10), 'g') AS text FROM documents), hits AS ({' UNION ALL '.join(hits(p, k, 'docs').replace(luhn('value'), 'true') for k, p in enumerate(RECOGNIZERS))}) SELECT doc_id, type, label, value, {edges('value', 2)} AS masked_value, s AS start, e AS \"end\", confidence FROM hits",
    "subsumed": f'{BASE} SELECT doc_id, type, s AS start, e AS "end" FROM hits a WHERE NOT EXISTS (SELECT 1 FROM hits b WHERE a.doc_id = b.doc_id AND a.type <> b.type AND b.s <= a.s AND b.e >= a.e AND b.confidence >= a.confidence)',
    "txt_stats": """SELECT doc_id, CAST(len(string_split(text, chr(10))) AS INT) AS lines, CAST(len(regexp_extract_all(text, '\\S+')) AS INT) AS words,
  CAST(length(text) AS INT) AS characters
  FROM documents""",
    "sql_text_stats": """WITH c AS (SELECT conv_id, turn, 'SELECT 1; create table t; ;' || coalesce(text, '') || '; -- created' || chr(10) AS t
  FROM conversations) SELECT conv_id, turn,
  CAST(len(list_filter(string_split(t, ';'), lambda x: regexp_replace(x, '\\s+', '', 'g') <> '')) AS INT) AS queries,
  CAST(len(regexp_extract_all(upper(t), 'SELECT')) AS INT) AS \"select\",
  CAST(len(regexp_extract_all(upper(t), 'CREATE')) AS INT) AS \"create\", CAST(len(regexp_extract_all(upper(t), 'DROP')) AS INT) AS \"drop\"
  FROM c""",
    "file_validity": """WITH p AS (SELECT p_partkey, ['.txt', '.exe', '.sql', '.pdf'][CAST(p_partkey % 4 + 1 AS INT)] AS format, CAST(p_size AS BIGINT) * 2000000 AS size
  FROM part), r AS (SELECT p_partkey, CASE WHEN size IS NULL THEN 'File does not exist' WHEN format = '.exe' THEN 'Unsupported format: .exe'
  WHEN size > 52428800 THEN 'File exceeds 50 MB' END AS why
  FROM p) SELECT p_partkey, why IS NULL AS ok, coalesce(why, 'Valid') AS reason
  FROM r""",
    "upsert_files": f"""WITH {FILES}, fresh AS (SELECT (SELECT max(id)
  FROM files) + row_number() OVER (ORDER BY file_path || '.new') AS id, file_path || '.new' AS file_path, CAST(7 AS BIGINT) AS file_size
  FROM files
  WHERE id % 50 = 1) SELECT id, file_path, CASE WHEN id % 3 = 0 THEN file_size + 1 ELSE file_size END AS file_size
  FROM files
  UNION ALL SELECT *
  FROM fresh""",
    "log_errors": "SELECT event_id AS id, 'ERROR' AS log_level FROM events WHERE event_type = 'error' OR value > 50 ORDER BY ts DESC, event_id DESC LIMIT 50",
    "ocr_statistics": """SELECT count(*) AS total, round(avg(CAST(doc_id % 100 AS DOUBLE)), 4) AS avg_confidence,
  CAST(sum(len(string_split(text, ' '))) AS BIGINT) AS total_words
  FROM documents""",
    "ocr_language_codes": """SELECT CASE lang WHEN 'es' THEN 'es' WHEN 'fr' THEN 'fr' WHEN 'de' THEN 'german' ELSE 'en' END AS language, count(*) AS n
  FROM documents
  GROUP BY 1""",
    "export_report": f"""{BASE}, {FILES}, {ROWS} SELECT f.id, filename, CAST(count(r.id) AS INT) AS n_detections,
  CAST(count(r.id) FILTER (r.risk_level = 'high') AS INT) AS n_redactions, min(d.lang) AS ocr_language
  FROM (SELECT *
  FROM files
  ORDER BY upload_date DESC, id DESC LIMIT 1000) f
  LEFT
  JOIN rows r ON f.id = r.file_id
  JOIN documents d ON d.doc_id = f.id
  GROUP BY 1, 2""",
}
