"""Queries and oracle SQL of the training-data operators.

The modules are imported here, at once: where one of their libraries is missing, importing this catalog fails as a whole.
"""

from __future__ import annotations

from evalloom.llm import (
    op1_ngram_join,
    op2_media,
    op3_sstable,
    op4_packing,
    op5_suffix_dedup,
    op6_licenses,
    op7_language,
    op8_decontam,
    op9_urls,
    op10_html,
    op11_alignment,
    op12_spelling,
    op13_neighbours,
)

OPS = {
    "op1_ngram_jaccard_join": op1_ngram_join,
    "op2_media_sniff": op2_media,
    "op3_sstable": op3_sstable,
    "op4_vector_packing": op4_packing,
    "op5_suffix_dedup": op5_suffix_dedup,
    "op6_license_digest": op6_licenses,
    "op7_language_zstd": op7_language,
    "op8_decontamination": op8_decontam,
    "op9_url_vocabulary": op9_urls,
    "op10_tag_path_ratios": op10_html,
    "op11_tokenizer_alignment": op11_alignment,
    "op12_spelling_variants": op12_spelling,
    "op13_dimension_scan": op13_neighbours,
}


def queries() -> dict:
    return {name: module.query for name, module in OPS.items()}


def oracle_sql() -> dict[str, str]:
    found = {name: getattr(module, "ORACLE_SQL", None) for name, module in OPS.items()}
    return {k: v for k, v in found.items() if v}
