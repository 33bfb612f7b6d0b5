"""The queries of the training-data operators, by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from quern.llm import bpe, chat, embeddings, html, packing, simhash, substrings, topk, toxicity, urls

QUERIES = {
    "op1_bpe": bpe.op1_bpe,
    "op2_chat": chat.op2_chat,
    "op3_urls": urls.op3_urls,
    "op4_simhash": simhash.op4_simhash,
    "op5_toxicity": toxicity.op5_toxicity,
    "op6_topk": topk.op6_topk,
    "op7_substrings": substrings.op7_substrings,
    "op8_packing": packing.op8_packing,
    "op9_html": html.op9_html,
    "op10_embeddings": embeddings.op10_embeddings,
}

SQL: dict[str, str] = {"op2_chat": chat.SQL, "op6_topk": topk.SQL, "op10_embeddings": embeddings.SQL}
