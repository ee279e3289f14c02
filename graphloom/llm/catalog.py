"""Registered queries of the subpackage and, where SQL can express them, the SQL that checks them."""

import corpus_pipeline
from graphloom.llm import align, decontam, hardneg, jaccard, licenses, linededup, packing, paragraphs, ppm, quality, substrings, tokenpack, toxicity

QUERIES = {
    "op1_line_dedup": linededup.op1_line_dedup,
    "op2_wu_manber": decontam.op2_wu_manber,
    "op3_string_kernel_svm": toxicity.op3_string_kernel_svm,
    "op4_sentence_rules": licenses.op4_sentence_rules,
    "op5_jaccard_join": jaccard.op5_jaccard_join,
    "op6_length_buckets": packing.op6_length_buckets,
    "op7_quality_rules": quality.op7_quality_rules,
    "op8_bwt_merge": substrings.op8_bwt_merge,
    "op9_best_fit_packing": tokenpack.op9_best_fit_packing,
    "op10_paragraph_minhash": paragraphs.op10_paragraph_minhash,
    "op11_score_sort": hardneg.op11_score_sort,
    "op12_ppm_scores": ppm.op12_ppm_scores,
    "op13_token_alignment": align.op13_token_alignment,
    "pipeline": corpus_pipeline.run,
}
ORACLES = {
    "op2_wu_manber": decontam.ORACLE,
    "op4_sentence_rules": licenses.ORACLE,
    "op5_jaccard_join": jaccard.ORACLE,
    "op7_quality_rules": quality.ORACLE,
    "op11_score_sort": hardneg.ORACLE,
}
