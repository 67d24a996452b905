"""The queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from . import byte_dedup, decontaminate, huffman_ids, ngram_join, pieces, quality, secrets, toxicity, urls, word_dedup

QUERIES = {
    "op1_secrets": secrets.op1_secrets,
    "op2_byte_dedup": byte_dedup.op2_byte_dedup,
    "op3_url_filter": urls.op3_url_filter,
    "op4_pieces": pieces.op4_pieces,
    "op5_word_dedup": word_dedup.op5_word_dedup,
    "op6_quality": quality.op6_quality,
    "op7_toxicity": toxicity.op7_toxicity,
    "op8_ngram_join": ngram_join.op8_ngram_join,
    "op9_huffman_ids": huffman_ids.op9_huffman_ids,
    "op10_decontaminate": decontaminate.op10_decontaminate,
}
ORACLE_SQL = {
    "op3_url_filter": urls.SQL,
    "op5_word_dedup": word_dedup.SQL,
    "op6_quality": quality.SQL,
    "op8_ngram_join": ngram_join.SQL,
    "op10_decontaminate": decontaminate.SQL,
}
