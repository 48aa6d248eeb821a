"""The registered queries of the training-data operators and the SQL of those that SQL can express."""

from __future__ import annotations

from sluice.llm.hard_negatives import op11_hard_negatives
from sluice.llm.jaccard import op1_jaccard_join
from sluice.llm.language_model import op9_lm_scoring
from sluice.llm.lexical_search import op12_lexical_search
from sluice.llm.media import op5_media
from sluice.llm.mixing import op8_mixing
from sluice.llm.oracles import OP1, OP3, OP11, OP12, OP13
from sluice.llm.packing import op7_packing
from sluice.llm.quality_model import op6_quality
from sluice.llm.quality_rules import op2_quality_rules
from sluice.llm.secrets import op10_secrets
from sluice.llm.substring_dedup import op13_substring_dedup
from sluice.llm.suffix_dedup import op3_suffix_dedup
from sluice.llm.toxicity import op4_toxicity

QUERIES = {
    "op3_suffix_dedup": op3_suffix_dedup,
    "op9_lm_scoring": op9_lm_scoring,
    "op7_packing": op7_packing,
    "op6_quality": op6_quality,
    "op5_media": op5_media,
    "op4_toxicity": op4_toxicity,
    "op1_jaccard_join": op1_jaccard_join,
    "op2_quality_rules": op2_quality_rules,
    "op8_mixing": op8_mixing,
    "op10_secrets": op10_secrets,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_lexical_search": op12_lexical_search,
    "op13_substring_dedup": op13_substring_dedup,
}

ORACLES: dict[str, str] = {
    "op1_jaccard_join": OP1,
    "op3_suffix_dedup": OP3,
    "op11_hard_negatives": OP11,
    "op12_lexical_search": OP12,
    "op13_substring_dedup": OP13,
}
