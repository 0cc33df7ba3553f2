"""The corpus operators' queries and SQL."""

from __future__ import annotations

from .chat_format import OP7_SQL, op7_chat_format
from .conversation_repair import OP12_SQL, op12_conversation_repair
from .exact_dedup import OP9_SQL, op9_exact_dedup
from .near_dedup import op10_near_dedup
from .html_extract import op4_html_extract
from .line_dedup import op8_line_dedup
from .nearest import op2_nearest
from .packing import op1_packing
from .phrases import OP11_SQL, op11_phrases
from .pieces import op5_sentencepiece
from .quality import op3_quality
from .quality_rules import OP13_SQL, op13_quality_rules
from .suffix_dedup import op6_suffix_dedup

QUERIES = {
    "op1_packing": op1_packing,
    "op2_nearest": op2_nearest,
    "op3_quality": op3_quality,
    "op4_html_extract": op4_html_extract,
    "op5_sentencepiece": op5_sentencepiece,
    "op6_suffix_dedup": op6_suffix_dedup,
    "op7_chat_format": op7_chat_format,
    "op8_line_dedup": op8_line_dedup,
    "op9_exact_dedup": op9_exact_dedup,
    "op10_near_dedup": op10_near_dedup,
    "op11_phrases": op11_phrases,
    "op12_conversation_repair": op12_conversation_repair,
    "op13_quality_rules": op13_quality_rules,
}
ORACLE_SQL = {
    "op7_chat_format": OP7_SQL,
    "op9_exact_dedup": OP9_SQL,
    "op11_phrases": OP11_SQL,
    "op12_conversation_repair": OP12_SQL,
    "op13_quality_rules": OP13_SQL,
}
