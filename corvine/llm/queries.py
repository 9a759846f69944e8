"""The queries of this subpackage and the SQL that some of them equal."""

from __future__ import annotations

from corvine.llm import bpe_automaton, collocations, embedding_dedup, exact_dedup, jaccard_join, line_dedup, merkle, packing, pii, piece_codec, quality, sharding, toxicity

QUERIES = {
    "op1_line_dedup": line_dedup.op1_line_dedup,
    "op2_jaccard_join": jaccard_join.op2_jaccard_join,
    "op3_sharding": sharding.op3_sharding,
    "op4_quality": quality.op4_quality,
    "op5_embedding_dedup": embedding_dedup.op5_embedding_dedup,
    "op6_pii": pii.op6_pii,
    "op7_toxicity": toxicity.op7_toxicity,
    "op8_exact_dedup": exact_dedup.op8_exact_dedup,
    "op9_best_fit_packing": packing.op9_best_fit_packing,
    "op10_sentencepiece": piece_codec.op10_sentencepiece,
    "op11_collocations": collocations.op11_collocations,
    "op12_bpe": bpe_automaton.op12_bpe,
    "op13_merkle": merkle.op13_merkle,
}

SQL = {
    "op2_jaccard_join": jaccard_join.OP2_SQL,
    "op5_embedding_dedup": embedding_dedup.OP5_SQL,
    "op8_exact_dedup": exact_dedup.OP8_SQL,
    "op11_collocations": collocations.OP11_SQL,
    "op13_merkle": merkle.OP13_SQL,
}
