"""The registered queries of this subpackage and the DuckDB SQL of those that SQL can express."""

from __future__ import annotations

from .bpe import op1_bpe
from .chat import OP3_SQL, op3_chat_format
from .decontaminate import OP7_SQL, op7_decontamination
from .hard_negatives import OP13_SQL, op13_hard_negatives
from .html_text import op5_html_extraction
from .language_id import op6_language_id
from .line_dedup import OP11_SQL, op11_line_dedup
from .minhash import op4_minhash_dedup
from .quality_model import op8_quality_model
from .quality_rules import OP2_SQL, op2_quality_rules
from .role_repair import OP12_SQL, op12_role_repair
from .token_counts import op9_token_counts
from .toxicity import op10_toxicity

QUERIES = {
    "op1_bpe": op1_bpe,
    "op2_quality_rules": op2_quality_rules,
    "op3_chat_format": op3_chat_format,
    "op4_minhash_dedup": op4_minhash_dedup,
    "op7_decontamination": op7_decontamination,
    "op5_html_extraction": op5_html_extraction,
    "op6_language_id": op6_language_id,
    "op8_quality_model": op8_quality_model,
    "op9_token_counts": op9_token_counts,
    "op10_toxicity": op10_toxicity,
    "op11_line_dedup": op11_line_dedup,
    "op12_role_repair": op12_role_repair,
    "op13_hard_negatives": op13_hard_negatives,
}

ORACLES: dict[str, str] = {
    "op2_quality_rules": OP2_SQL,
    "op3_chat_format": OP3_SQL,
    "op7_decontamination": OP7_SQL,
    "op11_line_dedup": OP11_SQL,
    "op12_role_repair": OP12_SQL,
    "op13_hard_negatives": OP13_SQL,
}
