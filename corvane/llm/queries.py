"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

import corpus_pipeline
from corvane.llm import chat, decontaminate, minhash, mixing, neighbours, pii, quality, substrings, tokens, toxicity

QUERIES = {
    "op1_toxicity": toxicity.op1_toxicity,
    "op2_token_index": tokens.op2_token_index,
    "op3_neighbours": neighbours.op3_neighbours,
    "op4_private_spans": pii.op4_private_spans,
    "op5_chat_windows": chat.op5_chat_windows,
    "op6_repeated_spans": substrings.op6_repeated_spans,
    "op7_near_duplicates": minhash.op7_near_duplicates,
    "op8_decontamination": decontaminate.op8_decontamination,
    "op9_quality": quality.op9_quality,
    "op10_mixing": mixing.op10_mixing,
    "pipeline": corpus_pipeline.run,
}
ORACLE_SQL = {"op5_chat_windows": chat.ORACLE_SQL, "op10_mixing": mixing.ORACLE_SQL}
