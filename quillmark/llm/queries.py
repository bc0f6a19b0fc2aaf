"""The queries of the corpus operators and their SQL."""

from __future__ import annotations

from . import alignment, bpe, fingerprints, language_id, language_model, mixing, ngram_join, periods, pii, quality_model, quality_rules, repeats, toxicity


def queries() -> dict:
    return {
        "op1_bpe": bpe.op1_bpe,
        "op2_quality": quality_model.op2_quality,
        "op3_quality_rules": quality_rules.op3_quality_rules,
        "op4_pii": pii.op4_pii,
        "op5_fingerprints": fingerprints.op5_fingerprints,
        "op6_language_model": language_model.op6_language_model,
        "op7_ngram_jaccard": ngram_join.op7_ngram_jaccard,
        "op8_language_id": language_id.op8_language_id,
        "op9_repeats": repeats.op9_repeats,
        "op10_mixing": mixing.op10_mixing,
        "op11_alignment": alignment.op11_alignment,
        "op12_toxicity": toxicity.op12_toxicity,
        "op13_periodic_runs": periods.op13_periodic_runs,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op3_quality_rules": quality_rules.ORACLE,
        "op7_ngram_jaccard": ngram_join.ORACLE,
        "op10_mixing": mixing.ORACLE,
    }
