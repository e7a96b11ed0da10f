"""Queries of the training-data operators and their SQL."""

from . import conversation_repair, decontaminate, embedding_dedup, embedding_whitening, exact_dedup, html_extract, mixing, ngram_join, packing, quality, substring_dedup, toxicity, warc

QUERIES = {
    "op1_exact_dedup": exact_dedup.op1_exact_dedup,
    "op2_ngram_jaccard_join": ngram_join.op2_ngram_jaccard_join,
    "op3_html_extraction": html_extract.op3_html_extraction,
    "op4_mixing": mixing.op4_mixing,
    "op5_warc": warc.op5_warc,
    "op6_toxicity": toxicity.op6_toxicity,
    "op7_embedding_near_dedup": embedding_dedup.op7_embedding_near_dedup,
    "op8_quality_classifier": quality.op8_quality_classifier,
    "op9_best_fit_packing": packing.op9_best_fit_packing,
    "op10_substring_dedup": substring_dedup.op10_substring_dedup,
    "op11_embedding_whitening": embedding_whitening.op11_embedding_whitening,
    "op12_conversation_repair": conversation_repair.op12_conversation_repair,
    "op13_decontamination": decontaminate.op13_decontamination,
}
ORACLES = {
    "op1_exact_dedup": exact_dedup.ORACLE,
    "op2_ngram_jaccard_join": ngram_join.ORACLE,
    "op4_mixing": mixing.ORACLE,
    "op5_warc": warc.ORACLE,
    "op7_embedding_near_dedup": embedding_dedup.ORACLE,
    "op10_substring_dedup": substring_dedup.ORACLE,
    "op12_conversation_repair": conversation_repair.ORACLE,
    "op13_decontamination": decontaminate.ORACLE,
}
