"""The subpackage's queries and oracles."""

from __future__ import annotations

from mendery.llm.bpe_sql import op9_sql_bpe
from mendery.llm.chat import ORACLE_OP8, op8_chat_windows
from mendery.llm.fingerprint import op6_multiset_fingerprints
from mendery.llm.jaccard_join import ORACLE_OP4, op4_group_matrix_join
from mendery.llm.langid import op1_crf_language
from mendery.llm.packing import op3_best_fit_packing
from mendery.llm.quality import op10_crf_quality
from mendery.llm.sharding import op5_hash_tree_shards
from mendery.llm.token_spans import op7_token_attribution
from mendery.llm.vector_search import op2_ivfpq_search

QUERIES = {
    f.__name__: f
    for f in (
        op1_crf_language,
        op2_ivfpq_search,
        op3_best_fit_packing,
        op4_group_matrix_join,
        op5_hash_tree_shards,
        op6_multiset_fingerprints,
        op7_token_attribution,
        op8_chat_windows,
        op9_sql_bpe,
        op10_crf_quality,
    )
}


def pipeline(spark, sf_dir):
    """All stages of corpus_pipeline over documents."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES["pipeline"] = pipeline
ORACLES: dict[str, str] = {"op4_group_matrix_join": ORACLE_OP4, "op8_chat_windows": ORACLE_OP8}
