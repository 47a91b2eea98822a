"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from quaystone.llm import centroid_blocks, context_tree, decontaminate, language, mixing, ngram_join, quality_classifier, quality_rules, secrets, sharding, simhash, vector_codes, warc

QUERIES = {
    "op1_ngram_jaccard_join": ngram_join.query,
    "op2_mixing": mixing.query,
    "op3_decontamination": decontaminate.query,
    "op4_warc": warc.query,
    "op5_secret_scan": secrets.query,
    "op6_language_id": language.query,
    "op7_quality_rules": quality_rules.query,
    "op8_quality_classifier": quality_classifier.query,
    "op9_lm_scoring": context_tree.query,
    "op10_sharding": sharding.query,
    "op11_centroid_clustering": centroid_blocks.query,
    "op12_vector_codes": vector_codes.query,
    "op13_simhash_dedup": simhash.query,
}
ORACLES = {
    "op2_mixing": mixing.ORACLE,
    "op4_warc": warc.ORACLE,
    "op7_quality_rules": quality_rules.ORACLE,
    "op11_centroid_clustering": centroid_blocks.ORACLE,
    "op12_vector_codes": vector_codes.ORACLE,
}
