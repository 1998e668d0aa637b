"""The queries of this subpackage by name, and their SQL where SQL can express them."""

from __future__ import annotations

from . import decontaminate, langid, mixing, neardup, pii, quality, substring, tokens, urlfilter, warc

QUERIES = {
    "op1_url_filters": urlfilter.query,
    "op2_quality_rules": quality.query,
    "op3_source_mixing": mixing.query,
    "op4_token_counts": tokens.query,
    "op5_warc_writer": warc.query,
    "op6_ngram_jaccard": neardup.query,
    "op7_substring_dedup": substring.query,
    "op8_pii": pii.query,
    "op9_language_id": langid.query,
    "op10_benchmark_decontamination": decontaminate.query,
}
ORACLES = {
    "op1_url_filters": urlfilter.ORACLE,
    "op10_benchmark_decontamination": decontaminate.ORACLE,
}
