"""The registered queries of this package, and their SQL where SQL can express them."""

from __future__ import annotations

from . import chat_format, decontaminate, licenses, line_dedup, lm_scoring, mixing, near_dedup, quality, secrets, url_filter

QUERIES = {
    f.__name__: f
    for f in (
        lm_scoring.op1_lm_scoring,
        near_dedup.op2_minhash_near_dedup,
        mixing.op3_mixing,
        decontaminate.op4_decontamination,
        licenses.op5_license_scans,
        url_filter.op6_url_filters,
        quality.op7_quality_rules,
        secrets.op8_secret_scans,
        line_dedup.op9_line_dedup,
        chat_format.op10_chat_formatting,
    )
}

SQL = {"op3_mixing": mixing.OP3_SQL, "op7_quality_rules": quality.OP7_SQL, "op10_chat_formatting": chat_format.OP10_SQL}
