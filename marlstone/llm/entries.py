"""The subpackage's queries, and SQL for those that SQL can express on whole tables."""

from __future__ import annotations

from marlstone.llm import decontaminate, fingerprint, language_model, license_scan, pii, quality, sentencepiece_codec, simhash, substring_dedup, url_filter

QUERIES = {
    "op1_quality": quality.op1_quality,
    "op2_license": license_scan.op2_license,
    "op3_url_filter": url_filter.op3_url_filter,
    "op4_sentencepiece": sentencepiece_codec.op4_sentencepiece,
    "op5_substring_dedup": substring_dedup.op5_substring_dedup,
    "op6_decontaminate": decontaminate.op6_decontaminate,
    "op7_fingerprint": fingerprint.op7_fingerprint,
    "op8_simhash": simhash.op8_simhash,
    "op9_pii": pii.op9_pii,
    "op10_language_model": language_model.op10_language_model,
}

ORACLE_SQL = {"op3_url_filter": url_filter.oracle(), "op5_substring_dedup": substring_dedup.ORACLE, "op6_decontaminate": decontaminate.ORACLE}
