"""The registered queries of the training-data operators, and their SQL where SQL can express them."""

from quirefold.llm import bpe, fingerprints, html_extract, jaccard_join, language_id, license_scan, mixing, pii, source_divergence, substring_dedup, topk, toxicity, vector_codes

QUERIES = {
    "op1_language_id": language_id.op1,
    "op2_toxicity": toxicity.op2,
    "op3_jaccard_join": jaccard_join.op3,
    "op4_html_extraction": html_extract.op4,
    "op5_bpe": bpe.op5,
    "op6_fingerprints": fingerprints.op6,
    "op7_mixing": mixing.op7,
    "op8_personal_data": pii.op8,
    "op9_substring_dedup": substring_dedup.op9,
    "op10_top_k": topk.op10,
    "op11_vector_codes": vector_codes.op11,
    "op12_license_scan": license_scan.op12,
    "op13_source_divergence": source_divergence.op13,
}
ORACLES = {"op7_mixing": mixing.OP7_SQL, "op10_top_k": topk.OP10_SQL, "op11_vector_codes": vector_codes.OP11_SQL, "op13_source_divergence": source_divergence.OP13_SQL}
