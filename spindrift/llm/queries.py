"""The queries of this subpackage and the SQL that gives the same rows, where SQL can."""

from . import conversation_repair, divergence, embedding_dedup, exact_dedup, language_id, nearest, ngram_join, packing, piece_codec, quality, sharding, substring_dedup, url_filter

QUERIES = {
    "op1_compact_windows": substring_dedup.query,
    "op2_vector_packing": packing.query,
    "op3_lattice_dedup": embedding_dedup.query,
    "op4_piece_codec": piece_codec.query,
    "op5_url_filter": url_filter.query,
    "op6_exact_dedup": exact_dedup.query,
    "op7_ngram_jaccard_join": ngram_join.query,
    "op8_interleaved_sharding": sharding.query,
    "op9_quality_cotraining": quality.query,
    "op10_language_spans": language_id.query,
    "op11_source_divergence": divergence.query,
    "op12_conversation_repair": conversation_repair.query,
    "op13_inverted_multi_index": nearest.query,
}
SQL = {
    "op5_url_filter": url_filter.SQL,
    "op6_exact_dedup": exact_dedup.SQL,
    "op11_source_divergence": divergence.SQL,
}
