"""SQL for the merged scan and for redaction by values and by a second scan."""

from __future__ import annotations

import re

from ..operators.patterns import ENGINE_CONFIDENCE, RECOGNIZERS
from .oracles import BASE, FULL, RISK, SWAP, found, hits, luhn, partial, q

#: Findings of the recognizers, by place, after those of the quick scan.
_RHITS = " UNION ALL ".join(hits(p, k, "docs").replace(luhn("value"), "true") for k, p in enumerate(RECOGNIZERS))
BOTH = f"""rhits AS ({_RHITS}),
both_ AS (
  SELECT doc_id, 0 AS grp, pos AS n, type, value, severity, s, e, confidence, line, 'regex' AS engine FROM det
  UNION ALL
  SELECT doc_id, 1, row_number() OVER (PARTITION BY doc_id ORDER BY s, type, ord), type, value, severity, s, e, confidence, 0, 'presidio' FROM rhits WHERE length(trim(value)) >= 3),
input AS (SELECT *, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY grp, n) AS INT) AS i FROM both_)"""

#: A finding joins the first earlier anchor (``a = i``) of its type that it overlaps or whose value it repeats.
_ANCHOR = """list_filter(acc, lambda y: y.a = y.i AND lower(y.type) = lower(x[1].type)
  AND ((y.s < x[1].e AND x[1].s < y.e) OR (y.value <> '' AND y.value = x[1].value)))[1].i"""
_BASE = "CASE engine " + " ".join(f"WHEN {q(k)} THEN {v}" for k, v in ENGINE_CONFIDENCE.items()) + " ELSE 0.6 END"
MERGE = f"""lists_ AS (
  SELECT doc_id, list({{'i': i, 'a': i, 'type': type, 'value': value, 's': s, 'e': e}} ORDER BY i) AS l FROM input GROUP BY doc_id),
anchored AS (
  SELECT doc_id, list_reduce(list_transform(l, lambda x: [x]), lambda acc, x: list_concat(acc,
    [{{'i': x[1].i, 'a': coalesce({_ANCHOR}, x[1].i), 'type': x[1].type, 'value': x[1].value, 's': x[1].s, 'e': x[1].e}}])) AS l FROM lists_),
placed AS (SELECT doc_id, unnest(l) AS m FROM anchored),
members AS (
  SELECT p.doc_id, p.m.a AS a, f.i, f.type, f.value, f.severity, f.s, f.e, f.engine, CASE WHEN f.confidence > 0 THEN least(f.confidence, 1.0) ELSE {_BASE} END AS c
  FROM placed p JOIN input f ON p.doc_id = f.doc_id AND p.m.i = f.i),
records AS (
  SELECT doc_id, a, list(type ORDER BY c DESC, i)[1] AS type, coalesce(nullif(list(value ORDER BY c DESC, i)[1], ''), list(value ORDER BY i)[1], '') AS value, min(s) AS s, max(e) AS e,
    list_sort(list(DISTINCT engine)) AS sources, max(c) AS highest, list_sum(list(c ORDER BY i)) / count(*) AS mean,
    max(CASE severity WHEN 'high' THEN 3 WHEN 'medium' THEN 2 ELSE 1 END) AS top FROM members GROUP BY doc_id, a),
scored AS (
  SELECT *, CAST(round(CAST(CAST(least(1.0, highest * 0.7 + mean * 0.3 + least(0.16, 0.08 * (len(sources) - 1))) AS VARCHAR) AS DECIMAL(20, 18)), 3) AS DOUBLE) AS confidence FROM records),
merged AS (
  SELECT * FROM scored f WHERE NOT EXISTS (SELECT 1 FROM scored o WHERE o.doc_id = f.doc_id AND o.type <> f.type AND o.s <= f.s AND o.e >= f.e AND o.confidence >= f.confidence))"""
STANDARD = f"{BASE}, {BOTH}, {MERGE}"

#: Distinct values of a document's findings, the longest first, each with its replacement.
PAIRS = f"""ordered_ AS (SELECT doc_id, pos, trim(value) AS value, type IN ({FULL}) AS whole, row_number() OVER (PARTITION BY doc_id ORDER BY length(value) DESC, pos) AS k FROM det),
firsts AS (SELECT * FROM ordered_ WHERE value <> '' QUALIFY row_number() OVER (PARTITION BY doc_id, value ORDER BY k) = 1),
pairs AS (SELECT doc_id, list({{'text': '', 'n': CAST(0 AS BIGINT), 'value': value, 'by': CASE WHEN whole THEN '[REDACTED]' ELSE {partial("value")} END}} ORDER BY k) AS l FROM firsts GROUP BY doc_id),
replaced AS (
  SELECT p.doc_id, list_reduce(list_prepend({{'text': d.text, 'n': CAST(0 AS BIGINT), 'value': '', 'by': ''}}, l), lambda acc, x: {{
    'text': replace(acc.text, x.value, x.by), 'n': acc.n + CAST((length(acc.text) - length(replace(acc.text, x.value, ''))) / length(x.value) AS BIGINT), 'value': '', 'by': ''}}) AS r
  FROM pairs p JOIN docs d ON p.doc_id = d.doc_id)"""

#: The quick scan under other names, so that a second one can follow it.
_FIRST = re.sub(r"\b(docs|hits|ranked|kept|flat|det)\b", r"\g<1>_1", found())
_REDACTED = f"""lists_1 AS (SELECT doc_id, list({{'s': s, 'e': e, 'type': type, 'value': value}} ORDER BY s) AS l FROM det_1 GROUP BY doc_id),
redacted AS (
  SELECT d.doc_id, CASE WHEN l IS NULL THEN d.text ELSE array_to_string(list_transform(l, lambda x, i: substr(d.text, (CASE WHEN i = 1 THEN 0 ELSE l[i - 1].e END) + 1, x.s - (CASE WHEN i = 1 THEN 0 ELSE l[i - 1].e END)) || {SWAP}), '') || substr(d.text, l[-1].e + 1) END AS text
  FROM docs_1 d LEFT JOIN lists_1 l ON d.doc_id = l.doc_id)"""
_SECOND = found().replace("FROM documents)", "FROM redacted)", 1)

ORACLES = {
    "standard_scan": f"""{STANDARD} SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY s, type, a) - 1 AS INT) AS pos, type, value, s AS start, e AS "end",
  array_to_string(sources, ',') AS sources, confidence, CAST(len(sources) AS INT) AS engines_count, CASE top WHEN 3 THEN 'high' WHEN 2 THEN 'medium' ELSE 'low' END AS severity FROM merged""",
    "standard_breakdown": f"""{STANDARD}, lasts AS (SELECT m.engine, list(m.c ORDER BY m.i)[-1] AS c FROM members m SEMI JOIN merged g ON m.doc_id = g.doc_id AND m.a = g.a GROUP BY m.doc_id, m.a, m.engine),
sums AS (SELECT engine, count(*) AS n, round(avg(c), 6) AS mean FROM lasts GROUP BY engine),
names AS (SELECT unnest(['regex', 'gliner', 'presidio', 'transformer']) AS source)
SELECT source, coalesce(n, 0) AS count, CASE WHEN source IN ('gliner', 'presidio') THEN coalesce(mean, 0.0) END AS avg_confidence, CASE WHEN source = 'transformer' THEN CAST(0 AS BIGINT) END AS validated
FROM names LEFT JOIN sums ON source = engine""",
    "replacement_map": f"{BASE}, {PAIRS} SELECT doc_id, CAST(r.n AS INT) AS n, sha256(r.text) AS redacted_sha256 FROM replaced",
    "post_redaction": f"WITH {_FIRST}, {_REDACTED}, {_SECOND}, {RISK} SELECT doc_id, score AS post_score, level AS post_level, CAST(n AS INT) AS post_findings FROM levels",
    "aggregate_meta": f"""{STANDARD}, ins AS (SELECT doc_id, count(*) FILTER (engine = 'regex') AS n_regex, count(*) FILTER (engine = 'presidio') AS n_presidio FROM input GROUP BY doc_id),
outs AS (SELECT doc_id, count(*) AS n FROM merged GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(n_regex, 0) + coalesce(n_presidio, 0) AS INT) AS total_inputs,
  '[' || array_to_string(list_sort([(CASE WHEN coalesce(n_regex, 0) > 0 THEN 'regex' ELSE 'engine_0' END) || '=' || coalesce(n_regex, 0), 'engine_1=0', (CASE WHEN coalesce(n_presidio, 0) > 0 THEN 'presidio' ELSE 'engine_2' END) || '=' || coalesce(n_presidio, 0)]), ', ') || ']' AS by_engine,
  CAST(coalesce(o.n, 0) AS INT) AS total_merged FROM docs d LEFT JOIN ins i ON d.doc_id = i.doc_id LEFT JOIN outs o ON d.doc_id = o.doc_id""",
    "deep_scan": f"""{STANDARD} SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY s, type, a) - 1 AS INT) AS pos, type, value, confidence, false AS validated FROM merged""",
}
