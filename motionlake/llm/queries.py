"""The queries of this subpackage and their DuckDB equivalents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontaminate, langid, near_dedup, pieces, quality, resampling, search, secrets, sharding, suffix_dedup, token_counts, url_filters, warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_rules": quality.op1_quality_rules,
    "op2_lsh_forest": near_dedup.op2_lsh_forest,
    "op3_feistel_shards": sharding.op3_feistel_shards,
    "op4_warc_chunks": warc.op4_warc_chunks,
    "op5_column_suffixes": suffix_dedup.op5_column_suffixes,
    "op6_output_codes": langid.op6_output_codes,
    "op7_suffix_pieces": pieces.op7_suffix_pieces,
    "op8_link_trust": url_filters.op8_link_trust,
    "op9_randomness_tests": secrets.op9_randomness_tests,
    "op10_positional_index": decontaminate.op10_positional_index,
    "op10_proximity": decontaminate.op10_proximity,
    "op11_maxscore_search": search.op11_maxscore_search,
    "op12_transducer_counts": token_counts.op12_transducer_counts,
    "op13_crc_resampling": resampling.op13_crc_resampling,
}

ORACLE_SQL: dict[str, str] = {
    "op1_quality_rules": quality.oracle(),
    "op2_lsh_forest": near_dedup.oracle(),
    "op3_feistel_shards": sharding.oracle(),
    "op4_warc_chunks": warc.oracle(),
    "op5_column_suffixes": suffix_dedup.oracle(),
    "op8_link_trust": url_filters.oracle(),
    "op10_positional_index": decontaminate.oracle(),
    "op11_maxscore_search": search.oracle(),
    "op13_crc_resampling": resampling.oracle(),
}
