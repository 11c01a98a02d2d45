"""Registered queries of the corpus operators and their SQL where SQL can express them."""

from __future__ import annotations

from .bpe import op1_byte_bpe
from .chat_format import OP7_SQL, op7_chat_format
from .exact_dedup import OP3_SQL, op3_exact_dedup
from .language import op13_language_id
from .media import op6_media_columns
from .mixing import OP2_SQL, op2_source_mixing
from .near_dedup import op8_minhash_dedup
from .periodic import op12_periodic_runs
from .quality import op4_quality
from .substrings import op10_suffix_dedup
from .token_counts import op9_token_counts
from .toxicity import op5_toxicity
from .vector_codes import OP11_SQL, op11_vector_codes

QUERIES = {
    "op1_byte_bpe": op1_byte_bpe,
    "op3_exact_dedup": op3_exact_dedup,
    "op2_source_mixing": op2_source_mixing,
    "op4_quality": op4_quality,
    "op5_toxicity": op5_toxicity,
    "op6_media_columns": op6_media_columns,
    "op7_chat_format": op7_chat_format,
    "op8_minhash_dedup": op8_minhash_dedup,
    "op9_token_counts": op9_token_counts,
    "op10_suffix_dedup": op10_suffix_dedup,
    "op11_vector_codes": op11_vector_codes,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_language_id": op13_language_id,
}

ORACLES = {
    "op2_source_mixing": OP2_SQL,
    "op3_exact_dedup": OP3_SQL,
    "op7_chat_format": OP7_SQL,
    "op11_vector_codes": OP11_SQL,
}
