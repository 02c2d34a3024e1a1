"""Queries of the training-data operators, by name."""

from __future__ import annotations

from tessera.llm.language import op2_language
from tessera.llm.line_dedup import op7_line_dedup
from tessera.llm.lm import op5_lm
from tessera.llm.media import op9_media
from tessera.llm.merkle import op13_merkle
from tessera.llm.near_dup import op4_near_dup
from tessera.llm.negatives import op12_hard_negatives
from tessera.llm.oracles import ORACLES
from tessera.llm.packing import op1_packing
from tessera.llm.passages import op11_passages
from tessera.llm.pieces import op10_pieces
from tessera.llm.sharding import op3_sharding
from tessera.llm.toxicity import op8_toxicity
from tessera.llm.vector_dup import op6_vector_dup

QUERIES = {
    "op1_packing": op1_packing,
    "op2_language": op2_language,
    "op3_sharding": op3_sharding,
    "op4_near_dup": op4_near_dup,
    "op5_lm": op5_lm,
    "op6_vector_dup": op6_vector_dup,
    "op7_line_dedup": op7_line_dedup,
    "op8_toxicity": op8_toxicity,
    "op9_media": op9_media,
    "op10_pieces": op10_pieces,
    "op11_passages": op11_passages,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_merkle": op13_merkle,
}

__all__ = ["QUERIES", "ORACLES"]
