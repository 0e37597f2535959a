"""The queries of this subpackage and the SQL that checks them."""

from __future__ import annotations

from papersluice.llm import chat, lines, mixing, near, negatives, packing, quality, search, sharding, simhash, spelling, toxicity, urls

QUERIES = {
    "op1_rendezvous_shards": sharding.op1_rendezvous_shards,
    "op2_winnowed_lines": lines.op2_winnowed_lines,
    "op3_link_graph_filter": urls.op3_link_graph_filter,
    "op4_segment_top_k": search.op4_segment_top_k,
    "op5_incremental_chat": chat.op5_incremental_chat,
    "op6_lsh_forest_join": near.op6_lsh_forest_join,
    "op7_noisy_or_toxicity": toxicity.op7_noisy_or_toxicity,
    "op8_quality_ledger": quality.op8_quality_ledger,
    "op9_best_fit_packing": packing.op9_best_fit_packing,
    "op10_curriculum_mix": mixing.op10_curriculum_mix,
    "op11_hard_negatives": negatives.op11_hard_negatives,
    "op12_simhash_components": simhash.op12_simhash_components,
    "op13_spelling_variants": spelling.op13_spelling_variants,
    "quality_ablations": quality.quality_ablations,
}
SQL = {
    "op4_segment_top_k": search.SQL,
    "op5_incremental_chat": chat.SQL,
    "op8_quality_ledger": quality.SQL,
    "op10_curriculum_mix": mixing.SQL,
    "op11_hard_negatives": negatives.SQL,
    "quality_ablations": quality.ABLATIONS_SQL,
}
