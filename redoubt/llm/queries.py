"""The queries of the training-data operators and their SQL."""

from __future__ import annotations

from . import decontaminate, html_extract, licenses, line_dedup, mixing, secrets, simhash, token_shards, topk, toxicity

QUERIES = {
    "op1_line_dedup": line_dedup.op1_line_dedup,
    "op2_source_mix": mixing.op2_source_mix,
    "op3_simhash_near_dedup": simhash.op3_simhash_near_dedup,
    "op4_toxicity": toxicity.op4_toxicity,
    "op5_html_extraction": html_extract.op5_html_extraction,
    "op6_exact_top_k": topk.op6_exact_top_k,
    "op7_benchmark_decontamination": decontaminate.op7_benchmark_decontamination,
    "op9_secrets": secrets.op9_secrets,
    "op10_license_digests": licenses.op10_license_digests,
    "op8_token_shards": token_shards.op8_token_shards,
}

SQL = {
    "op1_line_dedup": line_dedup.SQL,
    "op2_source_mix": mixing.SQL,
    "op6_exact_top_k": topk.SQL,
    "op10_license_digests": licenses.SQL,
}
