"""The queries of this subpackage and their SQL, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import oracles
from .automata import op8_substring_dedup
from .chroma import op5_chroma_fingerprints
from .cutting_stock import op13_cutting_stock_packing
from .decontaminate import op2_benchmark_decontamination
from .fill_middle import op12_fill_in_middle
from .html import op6_html_extraction
from .jaccard import op7_ngram_jaccard_join
from .language import op1_language_id
from .licenses import op3_license_scan
from .packing import op9_best_fit_packing
from .sharding import op4_lpt_sharding
from .suffix_array import op10_suffix_array_dedup
from .vector_codes import op11_vector_codes

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_language_id,
        op2_benchmark_decontamination,
        op3_license_scan,
        op4_lpt_sharding,
        op5_chroma_fingerprints,
        op6_html_extraction,
        op7_ngram_jaccard_join,
        op8_substring_dedup,
        op9_best_fit_packing,
        op10_suffix_array_dedup,
        op11_vector_codes,
        op12_fill_in_middle,
        op13_cutting_stock_packing,
    )
}

ORACLE_SQL: dict[str, str] = {
    "op1_language_id": oracles.LANGUAGE_ID,
    "op4_lpt_sharding": oracles.LPT_SHARDING,
    "op7_ngram_jaccard_join": oracles.NGRAM_JACCARD_JOIN,
    "op8_substring_dedup": oracles.SUBSTRING_DEDUP,
    "op10_suffix_array_dedup": oracles.SUFFIX_ARRAY_DEDUP,
    "op11_vector_codes": oracles.VECTOR_CODES,
    "op12_fill_in_middle": oracles.FILL_IN_MIDDLE,
}
