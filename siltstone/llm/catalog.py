"""Queries of this subpackage and, where SQL can express them, their SQL."""

from . import embeddings, extraction, language, line_dedup, minhash, mixing, packing, quality, spotsigs, suffix_dedup

QUERIES = {
    f.__name__: f
    for f in (
        suffix_dedup.op1_suffix_dedup,
        minhash.op2_minhash_near_dedup,
        language.op3_language_id,
        extraction.op4_html_extraction,
        spotsigs.op5_document_fingerprints,
        line_dedup.op6_line_dedup,
        packing.op7_best_fit_packing,
        embeddings.op8_embedding_near_dedup,
        quality.op9_quality_classifier,
        mixing.op10_source_mixing,
    )
}
SQL = {"op6_line_dedup": line_dedup.OP6_SQL, "op8_embedding_near_dedup": embeddings.OP8_SQL, "op10_source_mixing": mixing.OP10_SQL}
