"""Queries of this subpackage by name, and their SQL where SQL can say them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .compression_classifier import op4_compression_quality
from .lexical_search import OP12_SQL, op12_pair_maxscore
from .mixing import OP7_SQL, op7_mixing
from .packing import op3_packing
from .quality_rules import op9_quality_rules
from .quotation import op10_quotation_linking
from .sentencepiece_codec import op2_sentencepiece
from .sharding import op1_shard_bytes
from .simhash import op8_simhash
from .suffix_dedup import op6_suffix_dedup
from .topk import OP5_SQL, op5_segment_topk
from .toxicity import op11_toxicity
from .vector_codes import OP13_SQL, op13_vector_codes

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_shard_bytes": op1_shard_bytes,
    "op2_sentencepiece": op2_sentencepiece,
    "op3_packing": op3_packing,
    "op4_compression_quality": op4_compression_quality,
    "op5_segment_topk": op5_segment_topk,
    "op6_suffix_dedup": op6_suffix_dedup,
    "op7_mixing": op7_mixing,
    "op8_simhash": op8_simhash,
    "op9_quality_rules": op9_quality_rules,
    "op10_quotation_linking": op10_quotation_linking,
    "op11_toxicity": op11_toxicity,
    "op12_pair_maxscore": op12_pair_maxscore,
    "op13_vector_codes": op13_vector_codes,
}

SQL: dict[str, str] = {
    "op5_segment_topk": OP5_SQL,
    "op7_mixing": OP7_SQL,
    "op12_pair_maxscore": OP12_SQL,
    "op13_vector_codes": OP13_SQL,
}
