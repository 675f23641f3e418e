"""The queries of this subpackage, and their SQL where DuckDB can express them."""

from __future__ import annotations

from .bpe_codec import op3
from .chat_formatting import OP11_SQL, op11
from .collocations import OP12_SQL, op12
from .embedding_graph import op1
from .language_id import op8
from .minhash_dedup import op9
from .packing import op2, packed_conversations
from .ppm_scoring import op5
from .quality_rules import op6
from .sharding import op4
from .token_alignment import op13
from .token_counts import op7
from .toxicity import op10


def queries():
    return {
        "op1_pruned_graph_links": op1,
        "op2_vector_bin_packing": op2,
        "op3_segment_tree_bpe": op3,
        "op4_external_shuffle": op4,
        "op9_min_max_hashing": op9,
        "op10_boosted_toxicity": op10,
        "op8_rank_order_profiles": op8,
        "op5_ppm_scores": op5,
        "op6_robust_outliers": op6,
        "op7_rank_synchronous_counts": op7,
        "packed_conversations": packed_conversations,
        "op11_schema_fingerprints": op11,
        "op12_de_bruijn_phrases": op12,
        "op13_fragment_monoid": op13,
    }


def oracle_sql():
    return {"op11_schema_fingerprints": OP11_SQL, "op12_de_bruijn_phrases": OP12_SQL}
