"""Queries and oracle SQL of the training-data operators."""

from __future__ import annotations

from . import bpe, exact_dedup, language_id, line_dedup, mixing, near_dedup, pii, quality, secrets, spot_sigs


def queries():
    return {
        "op1_line_dedup": line_dedup.op1_line_dedup,
        "op2_language_id": language_id.op2_language_id,
        "op3_mix_sources": mixing.op3_mix_sources,
        "op4_bpe": bpe.op4_bpe,
        "op5_exact_dedup": exact_dedup.op5_exact_dedup,
        "op6_secret_scan": secrets.op6_secret_scan,
        "op7_quality_classifier": quality.op7_quality_classifier,
        "op8_pii": pii.op8_pii,
        "op9_minhash_near_dedup": near_dedup.op9_minhash_near_dedup,
        "op10_document_fingerprints": spot_sigs.op10_document_fingerprints,
    }


def oracle_sql():
    return {
        "op1_line_dedup": line_dedup.ORACLE,
        "op3_mix_sources": mixing.ORACLE,
        "op5_exact_dedup": exact_dedup.ORACLE,
        "op8_pii": pii.ORACLE,
        "op9_minhash_near_dedup": near_dedup.ORACLE,
        "op10_document_fingerprints": spot_sigs.ORACLE,
    }
