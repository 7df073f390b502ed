"""Queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

import corpus_pipeline

from .chat_tree import op1_chat_prefix_tree
from .cube_mix import op8_cube_mix
from .dual_tree import OP11_SQL, op11_dual_tree_search
from .line_dedup import op6_segment_line_dedup
from .minhash import op4_minhash_near_dedup
from .ngram_join import op13_blocked_ngram_join
from .packing import op10_online_packing
from .quality_gbt import op5_quality_gbt
from .record_files import op9_record_files
from .secret_scan import op2_secret_ownership
from .shard_tree import op3_weighted_hash_tree
from .topk_bsi import OP7_SQL, op7_bit_sliced_topk
from .turn_repair import op12_branch_and_bound_repair

QUERIES = {
    "op1_chat_prefix_tree": op1_chat_prefix_tree,
    "op2_secret_ownership": op2_secret_ownership,
    "op3_weighted_hash_tree": op3_weighted_hash_tree,
    "op4_minhash_near_dedup": op4_minhash_near_dedup,
    "op5_quality_gbt": op5_quality_gbt,
    "op6_segment_line_dedup": op6_segment_line_dedup,
    "op7_bit_sliced_topk": op7_bit_sliced_topk,
    "op8_cube_mix": op8_cube_mix,
    "op9_record_files": op9_record_files,
    "op10_online_packing": op10_online_packing,
    "op11_dual_tree_search": op11_dual_tree_search,
    "op12_branch_and_bound_repair": op12_branch_and_bound_repair,
    "op13_blocked_ngram_join": op13_blocked_ngram_join,
    "pipeline": corpus_pipeline.run,
}
ORACLES: dict[str, str] = {"op7_bit_sliced_topk": OP7_SQL, "op11_dual_tree_search": OP11_SQL}
