"""Queries of this subpackage, and the SQL that DuckDB runs beside them."""

from __future__ import annotations

from . import exact_dedup, langid, mixing, packing, sharding, simhash, token_counts, topk, toxicity, url_filter

QUERIES = {
    "op1_mixing": mixing.op1_mixing,
    "op2_sharding": sharding.op2_sharding,
    "op3_url_filter": url_filter.op3_url_filter,
    "op4_exact_dedup": exact_dedup.op4_exact_dedup,
    "op5_toxicity": toxicity.op5_toxicity,
    "op6_packing": packing.op6_packing,
    "op7_simhash": simhash.op7_simhash,
    "op8_langid": langid.op8_langid,
    "op9_token_counts": token_counts.op9_token_counts,
    "op10_topk": topk.op10_topk,
}

ORACLES = {
    "op1_mixing": mixing.ORACLE,
    "op2_sharding": sharding.ORACLE,
    "op3_url_filter": url_filter.ORACLE,
    "op4_exact_dedup": exact_dedup.ORACLE,
    "op10_topk": topk.ORACLE,
}
