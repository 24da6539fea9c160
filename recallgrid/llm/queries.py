"""The queries of this subpackage and the SQL that states the same results."""

from __future__ import annotations

from . import embedding_tiles, language, lattice_lm, licenses, ngram_join, secrets, sentencepiece_spans, toxicity, wavelet_shards, winnowing

QUERIES = {
    "op1_secret_scan": secrets.op,
    "op2_ngram_jaccard_join": ngram_join.op,
    "op3_toxicity": toxicity.op,
    "op4_token_shards": wavelet_shards.op,
    "op5_benchmark_decontamination": winnowing.op,
    "op6_license_scan": licenses.op,
    "op7_lm_score": lattice_lm.op,
    "op8_sentencepiece": sentencepiece_spans.op,
    "op9_embedding_near_dedup": embedding_tiles.op,
    "op10_language": language.op,
    "embedding_pairs_loose": embedding_tiles.loose,
}

ORACLE_SQL: dict[str, str] = {
    "op2_ngram_jaccard_join": ngram_join.ORACLE,
    "op5_benchmark_decontamination": winnowing.ORACLE,
    "op9_embedding_near_dedup": embedding_tiles.ORACLE,
    "embedding_pairs_loose": embedding_tiles.LOOSE_ORACLE,
}
