"""Queries of the training-data operators and their DuckDB twins."""

import corpus_pipeline
from textmine.llm import (
    byte_bpe, chat_format, decontaminate, ngram_join, periodic_runs, piece_codec, quality_classifier, quality_rules,
    secret_scan, substring_dedup, token_align, url_filter, warc)

QUERIES = {
    "op1_quality_rules": quality_rules.query,
    "op2_secret_scan": secret_scan.query,
    "op3_piece_codec": piece_codec.query,
    "op4_chat_format": chat_format.query,
    "op5_ngram_join": ngram_join.query,
    "op6_decontaminate": decontaminate.query,
    "op7_substring_dedup": substring_dedup.query,
    "op8_quality_classifier": quality_classifier.query,
    "op9_warc": warc.query,
    "op10_url_filter": url_filter.query,
    "op11_token_align": token_align.query,
    "op12_periodic_runs": periodic_runs.query,
    "op13_byte_bpe": byte_bpe.query,
    "pipeline": corpus_pipeline.run,
}
ORACLE = {
    "op1_quality_rules": quality_rules.SQL,
    "op2_secret_scan": secret_scan.SQL,
    "op5_ngram_join": ngram_join.SQL,
    "op7_substring_dedup": substring_dedup.SQL,
    "op9_warc": warc.SQL,
    "op10_url_filter": url_filter.SQL,
}
