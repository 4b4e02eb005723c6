"""Queries of this subpackage, and the SQL that states the same results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from obsward.llm.ann import OP9_SQL, op9_graph_search
from obsward.llm.bpe import op7_byte_bpe
from obsward.llm.line_dedup import OP4_SQL, op4_line_dedup
from obsward.llm.media import op6_chunked_media
from obsward.llm.mixing import OP5_SQL, op5_raked_mixture
from obsward.llm.quality import op10_quality
from obsward.llm.sharding import op3_byte_shards
from obsward.llm.simhash import op1_simhash
from obsward.llm.substring import OP8_SQL, op8_substring
from obsward.llm.suffix_dedup import op2_suffix_dedup

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_simhash": op1_simhash,
    "op2_suffix_dedup": op2_suffix_dedup,
    "op3_byte_shards": op3_byte_shards,
    "op4_line_dedup": op4_line_dedup,
    "op5_raked_mixture": op5_raked_mixture,
    "op6_chunked_media": op6_chunked_media,
    "op7_byte_bpe": op7_byte_bpe,
    "op8_substring": op8_substring,
    "op9_graph_search": op9_graph_search,
    "op10_quality": op10_quality,
}

ORACLE_SQL: dict[str, str] = {
    "op4_line_dedup": OP4_SQL,
    "op5_raked_mixture": OP5_SQL,
    "op8_substring": OP8_SQL,
    "op9_graph_search": OP9_SQL,
}
