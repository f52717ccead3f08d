"""The subpackage's queries, and SQL for those that SQL can express."""

from __future__ import annotations

from . import html_text, licenses, media, mixing, packing, pii, quality, secrets, separators, simhash

QUERIES = {
    "op1_media_chunks": media.op1_media_chunks,
    "op2_separator_scan": separators.op2_separator_scan,
    "op3_quality_rules": quality.op3_quality_rules,
    "op4_text_density": html_text.op4_text_density,
    "op5_simhash": simhash.op5_simhash,
    "op6_secret_scan": secrets.op6_secret_scan,
    "op7_source_mix": mixing.op7_source_mix,
    "op8_vector_best_fit": packing.op8_vector_best_fit,
    "op9_pii": pii.op9_pii,
    "op10_license_rules": licenses.op10_license_rules,
}
ORACLES = {"op10_license_rules": licenses.oracle()}
