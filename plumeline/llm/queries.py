"""The queries of this subpackage, by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from . import hnsw, jaccard_join, line_dedup, mixing, packing, quality, sharding, simple8b, topk_search, toxicity

QUERIES = {
    "op1_line_dedup": line_dedup.query,
    "op2_quality": quality.query,
    "op3_exact_topk": topk_search.query,
    "op4_mixing_sources": mixing.query,
    "op5_hnsw": hnsw.query,
    "op6_packing": packing.query,
    "op7_token_files": simple8b.query,
    "op8_toxicity": toxicity.query,
    "op9_ngram_join": jaccard_join.query,
    "op10_rendezvous_sharding": sharding.query,
}

ORACLES: dict[str, str] = {
    "op3_exact_topk": topk_search.ORACLE,
    "op4_mixing_sources": mixing.ORACLE,
}
