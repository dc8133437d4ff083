"""Registered queries of the subpackage and their SQL, where SQL can express them."""

from __future__ import annotations

from .byte_bpe import op2_byte_bpe
from .chat_format import OP4_SQL, op4_chat_format
from .decontaminate import op8_decontaminate
from .fill_middle import OP12_SQL, op12_fill_middle
from .langid import op6_langid
from .max_score import OP11_SQL, op11_max_score
from .media import op7_media_columns
from .near_dedup import op5_near_dedup
from .packing import op3_packing
from .pii import op1_pii
from .suffix_dedup import op10_suffix_dedup
from .toxicity import op9_toxicity

QUERIES = {
    "op1_pii": op1_pii,
    "op2_byte_bpe": op2_byte_bpe,
    "op3_packing": op3_packing,
    "op4_chat_format": op4_chat_format,
    "op5_near_dedup": op5_near_dedup,
    "op6_langid": op6_langid,
    "op7_media_columns": op7_media_columns,
    "op8_decontaminate": op8_decontaminate,
    "op9_toxicity": op9_toxicity,
    "op10_suffix_dedup": op10_suffix_dedup,
    "op11_max_score": op11_max_score,
    "op12_fill_middle": op12_fill_middle,
}

SQL: dict[str, str] = {
    "op4_chat_format": OP4_SQL,
    "op11_max_score": OP11_SQL,
    "op12_fill_middle": OP12_SQL,
}
