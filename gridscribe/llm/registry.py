"""The queries of this subpackage and their SQL, for __spark_entry__.py."""

from __future__ import annotations

from . import bpe, chat, lines, mixing, neardup, passages, periodic, quality, timeparts, toxicity, unigram, urls, vectors

QUERIES = {
    "op1_substring_dedup": passages.op1_substring_dedup,
    "op2_bpe": bpe.op2_bpe,
    "op3_minhash_near_dedup": neardup.op3_minhash_near_dedup,
    "op4_quality_rules": quality.op4_quality_rules,
    "op5_url_filters": urls.op5_url_filters,
    "op6_mixing": mixing.op6_mixing,
    "op7_token_counts": unigram.op7_token_counts,
    "op8_toxicity": toxicity.op8_toxicity,
    "op9_embedding_near_dedup": vectors.op9_embedding_near_dedup,
    "op10_line_dedup": lines.op10_line_dedup,
    "op11_chat_formatting": chat.op11_chat_formatting,
    "op12_time_partitions": timeparts.op12_time_partitions,
    "op13_periodic_runs": periodic.op13_periodic_runs,
}

SQL = {
    "op1_substring_dedup": passages.SQL,
    "op3_minhash_near_dedup": neardup.SQL,
    "op4_quality_rules": quality.SQL,
    "op5_url_filters": urls.SQL,
    "op6_mixing": mixing.SQL,
    "op9_embedding_near_dedup": vectors.SQL,
    "op10_line_dedup": lines.SQL,
    "op11_chat_formatting": chat.SQL,
}
