"""The named queries of this subpackage, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from wickframe.llm import chat, covers, fingerprint, jaccard, langid, mixing, packing, suffixes, token_files, topk, toxicity, tries, wand

QUERIES = {
    "op1_mixing": mixing.op1_mixing,
    "op2_language_id": langid.op2_language_id,
    "op3_chat": chat.op3_chat,
    "op4_packing": packing.op4_packing,
    "op5_suffix_dedup": suffixes.op5_suffix_dedup,
    "op6_token_files": token_files.op6_token_files,
    "op7_topk": topk.op7_topk,
    "op8_toxicity": toxicity.op8_toxicity,
    "op9_jaccard": jaccard.op9_jaccard,
    "op10_fingerprint": fingerprint.op10_fingerprint,
    "op11_covers": covers.op11_covers,
    "op12_trie": tries.op12_trie,
    "op13_wand": wand.op13_wand,
}
ORACLE_SQL = {"op1_mixing": mixing.OP1_SQL, "op3_chat": chat.OP3_SQL, "op7_topk": topk.OP7_SQL, "op9_jaccard": jaccard.OP9_SQL, "op11_covers": covers.OP11_SQL, "op12_trie": tries.OP12_SQL, "op13_wand": wand.OP13_SQL}
