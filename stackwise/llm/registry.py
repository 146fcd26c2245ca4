"""The subpackage's queries, by the names under which the entry module registers them."""

from __future__ import annotations

from . import chat
from .alignment import op11_alignment
from .chat import op10_chat
from .decontaminate import op7_decontaminate
from .language_id import op13_language_id
from .minhash import op2_minhash
from .mixing import op6_mixing
from .pii import op8_pii
from .quality import op4_quality
from .spelling import op12_spelling
from .substring_dedup import op3_substring_dedup
from .suffix_dedup import op1_suffix_dedup
from .token_counts import op5_token_counts
from .toxicity import op9_toxicity

QUERIES = {
    "op1_suffix_dedup": op1_suffix_dedup,
    "op2_minhash": op2_minhash,
    "op3_substring_dedup": op3_substring_dedup,
    "op4_quality": op4_quality,
    "op5_token_counts": op5_token_counts,
    "op6_mixing": op6_mixing,
    "op7_decontaminate": op7_decontaminate,
    "op8_pii": op8_pii,
    "op9_toxicity": op9_toxicity,
    "op10_chat": op10_chat,
    "op11_alignment": op11_alignment,
    "op12_spelling": op12_spelling,
    "op13_language_id": op13_language_id,
}

ORACLES: dict[str, str] = {"op10_chat": chat.SQL}
