"""The queries of the training-data operators and their SQL."""

from __future__ import annotations

from plinth.llm import decontaminate, imatch, jaccard, license_scan, line_dedup, mixing, secrets_scan, suffix_dedup, toxicity, url_filter

QUERIES = {
    "op1_jaccard": jaccard.op1_jaccard,
    "op2_secrets": secrets_scan.op2_secrets,
    "op3_imatch": imatch.op3_imatch,
    "op4_suffix_dedup": suffix_dedup.op4_suffix_dedup,
    "op5_line_dedup": line_dedup.op5_line_dedup,
    "op6_mix": mixing.op6_mix,
    "op7_licenses": license_scan.op7_licenses,
    "op8_toxicity": toxicity.op8_toxicity,
    "op9_decontaminate": decontaminate.op9_decontaminate,
    "op10_url_filter": url_filter.op10_url_filter,
}

ORACLES = {
    "op1_jaccard": jaccard.OP1_SQL,
    "op2_secrets": secrets_scan.OP2_SQL,
    "op4_suffix_dedup": suffix_dedup.OP4_SQL,
    "op5_line_dedup": line_dedup.OP5_SQL,
    "op6_mix": mixing.OP6_SQL,
    "op7_licenses": license_scan.OP7_SQL,
    "op9_decontaminate": decontaminate.OP9_SQL,
    "op10_url_filter": url_filter.OP10_SQL,
}
