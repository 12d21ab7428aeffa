"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from millrace.llm.bpe import op6_byte_bpe
from millrace.llm.chat import OP8_SQL, op8_chat_trees
from millrace.llm.extraction import OP12_SQL, op12_tag_path_text
from millrace.llm.language import op1_language_id
from millrace.llm.neardup import op2_minhash_near_dedup
from millrace.llm.negatives import OP13_SQL, op13_multi_index_negatives
from millrace.llm.neighbours import OP4_SQL, op4_hilbert_neighbours
from millrace.llm.packing import op9_packing
from millrace.llm.quality import OP5_SQL, op5_quality_rules
from millrace.llm.sharding import op7_sharding
from millrace.llm.spelling import op11_pivotal_variants
from millrace.llm.substrings import OP10_SQL, op10_substring_dedup
from millrace.llm.toxicity import op3_toxicity

OPERATORS = (
    op1_language_id,
    op2_minhash_near_dedup,
    op3_toxicity,
    op4_hilbert_neighbours,
    op5_quality_rules,
    op6_byte_bpe,
    op7_sharding,
    op8_chat_trees,
    op9_packing,
    op10_substring_dedup,
    op11_pivotal_variants,
    op12_tag_path_text,
    op13_multi_index_negatives,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in OPERATORS}


def oracle_sql() -> dict[str, str]:
    return {
        "op4_hilbert_neighbours": OP4_SQL,
        "op5_quality_rules": OP5_SQL,
        "op8_chat_trees": OP8_SQL,
        "op10_substring_dedup": OP10_SQL,
        "op12_tag_path_text": OP12_SQL,
        "op13_multi_index_negatives": OP13_SQL,
    }
