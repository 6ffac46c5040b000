"""The queries of this subpackage, by name, and their SQL where SQL can express them."""

from __future__ import annotations

from metaweave.llm import decontamination, mixing, near_dedup, nearest, sharding, substring_dedup, token_counts, token_shards, toxicity, warc

QUERIES = {
    "op1_decontamination": decontamination.query,
    "op2_sharding": sharding.query,
    "op3_token_shards": token_shards.query,
    "op4_toxicity": toxicity.query,
    "op5_mixing": mixing.query,
    "op6_warc": warc.query,
    "op7_substring_dedup": substring_dedup.query,
    "op8_token_counts": token_counts.query,
    "op9_near_dedup": near_dedup.query,
    "op10_nearest": nearest.query,
}
SQL = {
    "op1_decontamination": decontamination.SQL,
    "op6_warc": warc.SQL,
    "op7_substring_dedup": substring_dedup.SQL,
}
