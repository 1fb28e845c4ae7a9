"""Registered queries of this subpackage, and their SQL where it can express them."""

from __future__ import annotations

import corpus_pipeline

from . import chat, decontaminate, fim, jaccard, langid, license_scan, mixing, quality, spelling, tokenstore, topk, toxicity, warc

QUERIES = {
    "op1_mixing": mixing.op1_mixing,
    "op2_toxicity": toxicity.op2_toxicity,
    "op3_topk": topk.op3_topk,
    "op4_decontaminate": decontaminate.op4_decontaminate,
    "op5_license": license_scan.op5_license,
    "op6_tokens": tokenstore.op6_tokens,
    "op7_langid": langid.op7_langid,
    "op8_chat": chat.op8_chat,
    "op9_jaccard": jaccard.op9_jaccard,
    "op10_warc": warc.op10_warc,
    "op11_fim": fim.op11_fim,
    "op12_spelling": spelling.op12_spelling,
    "op13_quality": quality.op13_quality,
    "pipeline": corpus_pipeline.run,
}

SQL = {"op3_topk": topk.OP3_SQL, "op8_chat": chat.OP8_SQL, "op9_jaccard": jaccard.OP9_SQL, "op10_warc": warc.OP10_SQL, "op11_fim": fim.OP11_SQL}
