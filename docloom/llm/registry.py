"""The queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from docloom.llm import chat, contamination, fingerprints, jaccard, lines, lm, mixing, periods, quality, secrets, substrings, urls, whitening

QUERIES = {
    "op1_quality_rules": quality.op1_quality_rules,
    "op2_chat_format": chat.op2_chat_format,
    "op3_line_dedup": lines.op3_line_dedup,
    "op4_decontamination": contamination.op4_decontamination,
    "op5_source_mix": mixing.op5_source_mix,
    "op6_substring_dedup": substrings.op6_substring_dedup,
    "op7_url_filter": urls.op7_url_filter,
    "op8_secret_scan": secrets.op8_secret_scan,
    "op9_ngram_join": jaccard.op9_ngram_join,
    "op10_lm_scoring": lm.op10_lm_scoring,
    "op11_embedding_whitening": whitening.op11_embedding_whitening,
    "op12_document_fingerprints": fingerprints.op12_document_fingerprints,
    "op13_periodic_runs": periods.op13_periodic_runs,
}

ORACLES = {
    "op1_quality_rules": quality.SQL,
    "op2_chat_format": chat.SQL,
    "op3_line_dedup": lines.SQL,
    "op4_decontamination": contamination.SQL,
    "op5_source_mix": mixing.SQL,
    "op6_substring_dedup": substrings.SQL,
    "op7_url_filter": urls.SQL,
    "op9_ngram_join": jaccard.SQL,
    "op12_document_fingerprints": fingerprints.SQL,
    "op13_periodic_runs": periods.SQL,
}
