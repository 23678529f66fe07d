"""Queries of the operators (``op<N>_<name>``), with DuckDB SQL where SQL
expresses them."""

from __future__ import annotations

from budgetlens.llm import activelloyd, anntree, chat, editcount, kneserney, langid, mixing, passages, spotsigs, superminhash, triefrontier, wumanber
from budgetlens.llm.bpe import op8_byte_bpe

LLM_QUERIES = {
    "op1_kneser_ney": kneserney.op1_kneser_ney,
    "op2_ann_tree": anntree.op2_ann_tree,
    "op3_superminhash": superminhash.op3_superminhash,
    "op4_mixing": mixing.op4_mixing,
    "op5_chat_format": chat.op5_chat_format,
    "op6_language_id": langid.op6_language_id,
    "op7_spotsigs": spotsigs.op7_spotsigs,
    "op8_byte_bpe": op8_byte_bpe,
    "op9_chained_passages": passages.op9_chained_passages,
    "op10_edit_counts": editcount.op10_edit_counts,
    "op11_wu_manber": wumanber.op11_wu_manber,
    "op12_active_lloyd": activelloyd.op12_active_lloyd,
    "op13_trie_frontier": triefrontier.op13_trie_frontier,
}
LLM_ORACLES: dict[str, str] = {
    "op3_superminhash": superminhash.ORACLE,
    "op4_mixing": mixing.ORACLE,
    "op5_chat_format": chat.ORACLE,
    "op11_wu_manber": wumanber.ORACLE,
    "op12_active_lloyd": activelloyd.ORACLE,
    "op13_trie_frontier": triefrontier.ORACLE,
}
