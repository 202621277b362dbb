"""The registered queries of this subpackage and, where SQL can say it, the same results as SQL."""

from __future__ import annotations

from wayloom.llm import decontamination, fingerprints, html_extraction, language, line_dedup, merkle, near_join, packing, sharding, spelling, substring_dedup, token_counts, url_filter


def all_queries() -> dict:
    found = (
        fingerprints.op1_document_fingerprints,
        url_filter.op2_url_filter,
        packing.op3_packing,
        near_join.op4_ngram_jaccard_join,
        html_extraction.op5_html_extraction,
        decontamination.op6_benchmark_decontamination,
        language.op7_language_id,
        sharding.op8_sharding,
        substring_dedup.op9_substring_dedup,
        line_dedup.op10_line_dedup,
        spelling.op11_spelling_variants,
        merkle.op12_merkle_manifest,
        token_counts.op13_token_counts,
    )
    return {query.__name__: query for query in found}


def all_oracles() -> dict[str, str]:
    return {
        "op2_url_filter": url_filter.ORACLE,
        "op4_ngram_jaccard_join": near_join.ORACLE,
        "op6_benchmark_decontamination": decontamination.ORACLE,
        "op9_substring_dedup": substring_dedup.ORACLE,
        "op10_line_dedup": line_dedup.ORACLE,
        "op11_spelling_variants": spelling.ORACLE,
        "op12_merkle_manifest": merkle.ORACLE,
        "op12_merkle_manifest": merkle.ORACLE,
    }
