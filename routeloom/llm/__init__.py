"""Operators for large-scale training-data pipelines.  Nothing else in the library imports this subpackage."""

from __future__ import annotations

from routeloom.llm import additive_ann, divergence, line_dedup, lz_fingerprint, maxent_lm, mixing, packing, quality, simhash, substring, toxicity, vector_codes, warc_zip


def queries() -> dict:
    return {
        "op1_substring": substring.op1_substring,
        "op2_packing": packing.op2_packing,
        "op3_warc": warc_zip.op3_warc,
        "op4_fingerprint": lz_fingerprint.op4_fingerprint,
        "op5_mixing": mixing.op5_mixing,
        "op6_line_dedup": line_dedup.op6_line_dedup,
        "op7_toxicity": toxicity.op7_toxicity,
        "op8_quality": quality.op8_quality,
        "op9_simhash": simhash.op9_simhash,
        "op10_ann": additive_ann.op10_ann,
        "op11_vector_codes": vector_codes.op11_vector_codes,
        "op12_maxent_lm": maxent_lm.op12_maxent_lm,
        "op13_divergence": divergence.op13_divergence,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op5_mixing": mixing.OP5_SQL,
        "op13_divergence": divergence.OP13_SQL,
    }
