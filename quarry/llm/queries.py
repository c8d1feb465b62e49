"""The queries of this subpackage and the SQL that checks them."""

from __future__ import annotations

from quarry.llm import chat, licenses, media, mixing, neardup, packing, quality, suffixes, topk, toxicity

QUERIES = {
    "op1_licenses": licenses.op1_licenses,
    "op2_suffixes": suffixes.op2_suffixes,
    "op3_topk": topk.op3_topk,
    "op4_quality": quality.op4_quality,
    "op5_packing": packing.op5_packing,
    "op6_toxicity": toxicity.op6_toxicity,
    "op7_neardup": neardup.op7_neardup,
    "op8_chat": chat.op8_chat,
    "op9_mixing": mixing.op9_mixing,
    "op10_media": media.op10_media,
}

ORACLES = {
    "op1_licenses": licenses.ORACLE_SQL,
    "op2_suffixes": suffixes.ORACLE_SQL,
    "op3_topk": topk.ORACLE_SQL,
    "op7_neardup": neardup.ORACLE_SQL,
    "op8_chat": chat.ORACLE_SQL,
    "op9_mixing": mixing.ORACLE_SQL,
}
