"""The queries of this subpackage by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from . import decontamination, divergence, jaccard, language, licenses, mixing, ppm, quality, sharding, tokens, toxicity, warc, whitening

QUERIES = {
    "op1_token_output": tokens.op1_token_output,
    "op2_lm_scoring": ppm.op2_lm_scoring,
    "op3_quality_rules": quality.op3_quality_rules,
    "op4_licenses": licenses.op4_licenses,
    "op5_decontamination": decontamination.op5_decontamination,
    "op6_language": language.op6_language,
    "op7_toxicity": toxicity.op7_toxicity,
    "op8_mixing": mixing.op8_mixing,
    "op9_warc": warc.op9_warc,
    "op10_jaccard_join": jaccard.op10_jaccard_join,
    "op11_divergence": divergence.op11_divergence,
    "op12_whitening": whitening.op12_whitening,
    "op13_sharding": sharding.op13_sharding,
}

ORACLE_SQL = {
    "op5_decontamination": decontamination.OP5_SQL,
    "op8_mixing": mixing.OP8_SQL,
    "op9_warc": warc.OP9_SQL,
    "op10_jaccard_join": jaccard.OP10_SQL,
    "op11_divergence": divergence.OP11_SQL,
    "op13_sharding": sharding.OP13_SQL,
}
