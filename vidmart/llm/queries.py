"""The registered queries of this subpackage and their SQL twins."""

from __future__ import annotations

from vidmart.llm import audit, bpe, chat, knn, lines, neardup, packing, quality, recompress, suffix, toxicity, trie, urls

QUERIES = {
    "op1_bpe_roundtrip": bpe.op1_bpe_roundtrip,
    "op2_topk": knn.op2_topk,
    "op3_quality": quality.op3_quality,
    "op4_toxicity": toxicity.op4_toxicity,
    "op5_near_duplicates": neardup.op5_near_duplicates,
    "op6_chat": chat.op6_chat,
    "op7_substring_dedup": recompress.op7_substring_dedup,
    "op8_line_rules": lines.op8_line_rules,
    "op9_pack": packing.op9_pack,
    "op10_suffix_dedup": suffix.op10_suffix_dedup,
    "op11_filter_audit": audit.op11_filter_audit,
    "op12_prefix_trie": trie.op12_prefix_trie,
    "op13_urls": urls.op13_urls,
}

#: DuckDB SQL, where it can say the same over whole tables.
ORACLE: dict[str, str] = {
    "op2_topk": knn.SQL,
    "op8_line_rules": lines.SQL,
    "op11_filter_audit": audit.SQL,
    "op12_prefix_trie": trie.SQL,
    "op13_urls": urls.SQL,
}
