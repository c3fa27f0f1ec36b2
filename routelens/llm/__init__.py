"""Operators for building training data, and their queries with SQL where SQL can state the result."""

from routelens.llm import (
    op1_gated_toxicity,
    op2_closed_syncmers,
    op3_kd_shards,
    op4_minmax_dedup,
    op5_minimum_slack_packing,
    op6_radix_windows,
    op7_neighbour_quality,
    op8_systematic_mixing,
    op9_block_naming,
    op10_transducer_counts,
    op11_kronecker_negatives,
    op12_stable_cosines,
    op13_double_array_trie,
)

QUERIES = {
    "op1_gated_toxicity": op1_gated_toxicity.op1_gated_toxicity,
    "op2_closed_syncmers": op2_closed_syncmers.op2_closed_syncmers,
    "op3_kd_shards": op3_kd_shards.op3_kd_shards,
    "op4_minmax_dedup": op4_minmax_dedup.op4_minmax_dedup,
    "op5_minimum_slack_packing": op5_minimum_slack_packing.op5_minimum_slack_packing,
    "op6_radix_windows": op6_radix_windows.op6_radix_windows,
    "op7_neighbour_quality": op7_neighbour_quality.op7_neighbour_quality,
    "op8_systematic_mixing": op8_systematic_mixing.op8_systematic_mixing,
    "op9_block_naming": op9_block_naming.op9_block_naming,
    "op10_transducer_counts": op10_transducer_counts.op10_transducer_counts,
    "op11_kronecker_negatives": op11_kronecker_negatives.op11_kronecker_negatives,
    "op12_stable_cosines": op12_stable_cosines.op12_stable_cosines,
    "op13_double_array_trie": op13_double_array_trie.op13_double_array_trie,
}
EXPECTED = {
    "op8_systematic_mixing": op8_systematic_mixing.SQL,
    "op9_block_naming": op9_block_naming.SQL,
    "op11_kronecker_negatives": op11_kronecker_negatives.SQL,
    "op12_stable_cosines": op12_stable_cosines.SQL,
    "op13_double_array_trie": op13_double_array_trie.SQL,
}
