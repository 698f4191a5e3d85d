"""The registered queries of this subpackage and their DuckDB SQL."""

from __future__ import annotations

from .decontamination import OP8_SQL, op8_decontamination
from .exact_dedup import OP3_SQL, op3_exact_dedup
from .lm_scoring import op7_lm_scoring
from .mixing import op9_mixing
from .near_dedup import OP2_SQL, op2_near_dedup
from .sharding import op4_sharding
from .suffix_dedup import OP10_SQL, op10_suffix_dedup
from .token_counts import op6_token_counts
from .toxicity import op5_toxicity
from .url_filter import OP1_SQL, op1_url_filter

QUERIES = {
    "op1_url_filter": op1_url_filter,
    "op2_near_dedup": op2_near_dedup,
    "op3_exact_dedup": op3_exact_dedup,
    "op4_sharding": op4_sharding,
    "op5_toxicity": op5_toxicity,
    "op6_token_counts": op6_token_counts,
    "op7_lm_scoring": op7_lm_scoring,
    "op8_decontamination": op8_decontamination,
    "op9_mixing": op9_mixing,
    "op10_suffix_dedup": op10_suffix_dedup,
}
ORACLES = {
    "op1_url_filter": OP1_SQL,
    "op2_near_dedup": OP2_SQL,
    "op3_exact_dedup": OP3_SQL,
    "op8_decontamination": OP8_SQL,
    "op10_suffix_dedup": OP10_SQL,
}
