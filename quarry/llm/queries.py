"""The driver's queries over the operators of this folder, and their DuckDB twins."""

from __future__ import annotations

from quarry.llm import (op1_quality, op2_html, op3_bpe, op4_records, op5_toxicity, op6_mix, op7_language, op8_near,
                        op9_license, op10_ann, op11_negatives, op12_repair, op13_urls)

QUERIES = {
    "op1_quality_rules": op1_quality.op1_quality_rules,
    "op2_main_text": op2_html.op2_main_text,
    "op3_bpe_round_trip": op3_bpe.op3_bpe_round_trip,
    "op4_token_records": op4_records.op4_token_records,
    "op5_toxicity": op5_toxicity.op5_toxicity,
    "op6_mix_sources": op6_mix.op6_mix_sources,
    "op7_language": op7_language.op7_language,
    "op8_near_duplicates": op8_near.op8_near_duplicates,
    "op9_license_scan": op9_license.op9_license_scan,
    "op10_nearest": op10_ann.op10_nearest,
    "op11_hard_negatives": op11_negatives.op11_hard_negatives,
    "op12_repair": op12_repair.op12_repair,
    "op13_url_filter": op13_urls.op13_url_filter,
}

# The other operators are no SQL (trained models, tokenizers, files, approximate
# search); tests/llm holds them against brute force, round trips and held-out rows.
ORACLE_SQL = {
    "op1_quality_rules": op1_quality.oracle(),
    "op6_mix_sources": op6_mix.oracle(),
}
