"""The queries of this subpackage and the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from skein.llm import byte_pairs, html_text, jaccard, language_model, lexical, mixing, neighbours, pieces, quality, suffixes, token_counts, turn_trie, urls


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [
        html_text.op1_html_text,
        suffixes.op2_repeated_passages,
        urls.op3_url_filter,
        mixing.op4_source_mix,
        language_model.op5_lm_score,
        pieces.op6_piece_encoding,
        quality.op7_quality_rules,
        neighbours.op8_nearest_neighbours,
        jaccard.op9_jaccard_join,
        token_counts.op10_token_counts,
        token_counts.token_counts_words,
        byte_pairs.op11_byte_pairs,
        lexical.op12_lexical_search,
        turn_trie.op13_turn_trie,
    ]
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op4_source_mix": mixing.ORACLE, "op3_url_filter": urls.ORACLE, "token_counts_words": token_counts.ORACLE, "op12_lexical_search": lexical.ORACLE, "op13_turn_trie": turn_trie.ORACLE}
