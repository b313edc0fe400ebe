"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from stratus.llm import divergence, line_dedup, mixing, packing, personal_data, quality, rules, simhash, substring_dedup, token_files, vectors, warc, whitening


def all_queries() -> dict:
    return {
        "op1_warc": warc.query,
        "op2_quality_fm": quality.query,
        "op3_substring_dedup": substring_dedup.query,
        "op4_mix_sources": mixing.query,
        "op5_quality_rules": rules.query,
        "op6_multi_index": vectors.query,
        "op7_simhash": simhash.query,
        "op8_token_planes": token_files.query,
        "op9_pack_sequences": packing.query,
        "op10_line_dedup": line_dedup.query,
        "op11_personal_data": personal_data.query,
        "op12_divergence_audit": divergence.query,
        "op13_whitening": whitening.query,
    }


def all_sql() -> dict[str, str]:
    return {
        "op1_warc": warc.SQL,
        "op3_substring_dedup": substring_dedup.SQL,
        "op4_mix_sources": mixing.SQL,
        "op10_line_dedup": line_dedup.SQL,
        "op12_divergence_audit": divergence.SQL,
    }
