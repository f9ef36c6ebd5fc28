"""The queries of this subpackage and their SQL, for __spark_entry__."""

from __future__ import annotations

from . import collocations, exact, html_text, langid, mixing, neardup, packing, parsing, quality, simhash, tokenfile, trie, urls


def queries() -> dict:
    return {
        "op1_language_id": langid.op1_language_id,
        "op2_embedding_near_dedup": neardup.op2_embedding_near_dedup,
        "op3_exact_dedup": exact.op3_exact_dedup,
        "op4_simhash_near_dedup": simhash.op4_simhash_near_dedup,
        "op5_token_ids": tokenfile.op5_token_ids,
        "op6_mixing": mixing.op6_mixing,
        "op7_html_extraction": html_text.op7_html_extraction,
        "op8_best_fit_packing": packing.op8_best_fit_packing,
        "op9_url_filters": urls.op9_url_filters,
        "op10_quality_classifier": quality.op10_quality_classifier,
        "op11_phrase_collocations": collocations.op11_phrase_collocations,
        "op12_document_fingerprints": parsing.op12_document_fingerprints,
        "op13_conversation_trie": trie.op13_conversation_trie,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op3_exact_dedup": exact.ORACLE_SQL,
        "op6_mixing": mixing.ORACLE_SQL,
        "op9_url_filters": urls.ORACLE_SQL,
        "op11_phrase_collocations": collocations.ORACLE_SQL,
        "op13_conversation_trie": trie.ORACLE_SQL,
    }
