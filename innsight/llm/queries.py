"""The corpus queries and their SQL, by name."""

from __future__ import annotations

from innsight.llm import (
    bpe,
    divergence,
    exact_dedup,
    hard_negatives,
    html_text,
    language,
    licenses,
    lz_fingerprint,
    mixing,
    near_dedup,
    pii,
    pivot_search,
    quality,
)


def queries() -> dict:
    return {
        "op1_license_scan": licenses.op1_license_scan,
        "op2_quality": quality.op2_quality,
        "op3_exact_dedup": exact_dedup.op3_exact_dedup,
        "op4_bpe": bpe.op4_bpe,
        "op5_language_id": language.op5_language_id,
        "op6_fingerprint": lz_fingerprint.op6_fingerprint,
        "op7_mixing": mixing.op7_mixing,
        "op8_near_dedup": near_dedup.op8_near_dedup,
        "op9_html_text": html_text.op9_html_text,
        "op10_pii": pii.op10_pii,
        "op11_hard_negatives": hard_negatives.op11_hard_negatives,
        "op12_divergence": divergence.op12_divergence,
        "op13_top_k": pivot_search.op13_top_k,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op3_exact_dedup": exact_dedup.OP3_SQL,
        "op7_mixing": mixing.OP7_SQL,
        "op8_near_dedup": near_dedup.OP8_SQL,
        "op11_hard_negatives": hard_negatives.OP11_SQL,
        "op12_divergence": divergence.OP12_SQL,
        "op13_top_k": pivot_search.OP13_SQL,
    }
