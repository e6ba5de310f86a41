"""The queries of this subpackage and their SQL, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .ctw_score import op10_ctw_score
from .fill_in_middle import OP12_SQL, op12_fill_in_middle
from .hnsw_dedup import op5_hnsw_dedup
from .html_extract import op3_html_extract
from .mixing import op6_source_mixing
from .ngram_join import op9_ngram_join
from .packing import op2_best_fit_packing
from .quality_rules import op8_quality_rules
from .spelling import OP11_SQL, op11_spelling_variants
from .substring_dedup import op4_substring_dedup
from .token_counts import op7_token_counts
from .url_filter import OP1_SQL, op1_url_filter
from .warc import OP13_SQL, op13_warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_url_filter": op1_url_filter,
    "op2_best_fit_packing": op2_best_fit_packing,
    "op3_html_extract": op3_html_extract,
    "op4_substring_dedup": op4_substring_dedup,
    "op5_hnsw_dedup": op5_hnsw_dedup,
    "op6_source_mixing": op6_source_mixing,
    "op7_token_counts": op7_token_counts,
    "op8_quality_rules": op8_quality_rules,
    "op9_ngram_join": op9_ngram_join,
    "op10_ctw_score": op10_ctw_score,
    "op11_spelling_variants": op11_spelling_variants,
    "op12_fill_in_middle": op12_fill_in_middle,
    "op13_warc": op13_warc,
}

ORACLE_SQL: dict[str, str] = {
    "op1_url_filter": OP1_SQL,
    "op11_spelling_variants": OP11_SQL,
    "op12_fill_in_middle": OP12_SQL,
    "op13_warc": OP13_SQL,
}
