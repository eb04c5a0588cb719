"""The operators as queries over the driver's tables: ``QUERIES`` and, where SQL can say the same, ``SQL``."""

from __future__ import annotations

from . import embeddings, html, mixing, packing, simhash, substring, tokencount, topk, toxicity, warc

QUERIES = {
    "op1_html": html.op1_html,
    "op2_substring": substring.op2_substring,
    "op3_token_counts": tokencount.op3_token_counts,
    "op4_warc": warc.op4_warc,
    "op5_pack": packing.op5_pack,
    "op6_embeddings": embeddings.op6_embeddings,
    "op7_topk": topk.op7_topk,
    "op8_toxicity": toxicity.op8_toxicity,
    "op9_simhash": simhash.op9_simhash,
    "op10_mix": mixing.op10_mix,
}
#: The others are tested against brute force, round trips or held-out labels in tests/llm.
SQL = {"op2_substring": substring.SQL, "op4_warc": warc.SQL, "op6_embeddings": embeddings.SQL, "op7_topk": topk.SQL, "op10_mix": mixing.SQL}
