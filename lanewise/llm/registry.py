"""The queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import licenses, quality
from .byte_bpe import op6_byte_bpe
from .chat import op9_chat_format
from .mixing import op8_source_mix
from .passages import op10_suffix_dedup
from .pitman_yor import op5_lm_scores
from .shingle_join import op4_ngram_join
from .spotsigs import op1_spotsigs
from .token_shards import op7_token_shards

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_spotsigs": op1_spotsigs,
    "op2_quality_rules": quality.op2_quality_rules,
    "op3_license_scan": licenses.op3_license_scan,
    "op4_ngram_join": op4_ngram_join,
    "op5_lm_scores": op5_lm_scores,
    "op6_byte_bpe": op6_byte_bpe,
    "op7_token_shards": op7_token_shards,
    "op8_source_mix": op8_source_mix,
    "op9_chat_format": op9_chat_format,
    "op10_suffix_dedup": op10_suffix_dedup,
}
ORACLE_SQL: dict[str, str] = {"op2_quality_rules": quality.ORACLE_SQL, "op3_license_scan": licenses.ORACLE_SQL}
