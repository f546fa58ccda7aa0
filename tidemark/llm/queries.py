"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from . import exact_dedup, html_extract, mixing, packing, ppm, quality_classifier, quality_rules, simhash, toxicity, url_filter

QUERIES = {
    "op1_mixing": mixing.op1_mixing,
    "op2_toxicity": toxicity.op2_toxicity,
    "op3_exact_dedup": exact_dedup.op3_exact_dedup,
    "op4_ppm": ppm.op4_ppm,
    "op5_quality_rules": quality_rules.op5_quality_rules,
    "op6_url_filter": url_filter.op6_url_filter,
    "op7_quality_classifier": quality_classifier.op7_quality_classifier,
    "op8_simhash": simhash.op8_simhash,
    "op9_packing": packing.op9_packing,
    "op10_html_extract": html_extract.op10_html_extract,
}

ORACLES = {
    "op1_mixing": mixing.ORACLE_SQL,
    "op3_exact_dedup": exact_dedup.ORACLE_SQL,
    "op5_quality_rules": quality_rules.ORACLE_SQL,
    "op6_url_filter": url_filter.ORACLE_SQL,
}
