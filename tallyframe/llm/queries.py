"""The registered queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from tallyframe.llm import bpe, decontaminate, hard_negatives, html_text, lang_id, license_scan, near_dedup, oracles, quality, substring_dedup, token_store, toxicity, url_filter, whitening

QUERIES = {
    f.__name__: f
    for f in (
        lang_id.op1_language_id, decontaminate.op2_decontaminate, toxicity.op3_toxicity, html_text.op4_main_text, bpe.op5_byte_bpe,
        quality.op6_quality_rules, substring_dedup.op7_substring_dedup, token_store.op8_token_store, near_dedup.op9_near_dedup, url_filter.op10_url_filter,
        whitening.op11_whitening, hard_negatives.op12_hard_negatives, license_scan.op13_license_scan,
    )
}
ORACLES = oracles.ORACLES
