"""Queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
from pyspark.sql import DataFrame, SparkSession

from .brown import op4_brown_lm
from .embeddings import OP7_SQL, op7_embedding_dedup
from .langid import op3_language_id
from .minhash import OP8_SQL, op8_minhash
from .mixing import OP10_SQL, op10_mixing
from .packing import op12_pattern_packing
from .periodic import op13_periodic_runs
from .phrases import OP2_SQL, benchmark_proximity, op2_decontamination
from .prefixtrie import OP11_SQL, op11_prefix_trie
from .quality import op1_quality
from .suffixes import op6_suffix_dedup
from .toxicity import op9_toxicity
from .warc import OP5_SQL, op5_warc

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    return {
        "op1_quality": op1_quality,
        "op2_decontamination": op2_decontamination,
        "op3_language_id": op3_language_id,
        "op4_brown_lm": op4_brown_lm,
        "op5_warc": op5_warc,
        "op6_suffix_dedup": op6_suffix_dedup,
        "op7_embedding_dedup": op7_embedding_dedup,
        "op8_minhash": op8_minhash,
        "op9_toxicity": op9_toxicity,
        "op10_mixing": op10_mixing,
        "op11_prefix_trie": op11_prefix_trie,
        "op12_pattern_packing": op12_pattern_packing,
        "op13_periodic_runs": op13_periodic_runs,
        "pipeline": corpus_pipeline.run,
        "benchmark_proximity": benchmark_proximity,
    }


def oracle_sql() -> dict[str, str]:
    sql = {
        "op2_decontamination": OP2_SQL,
        "op5_warc": OP5_SQL,
        "op7_embedding_dedup": OP7_SQL,
        "op8_minhash": OP8_SQL,
        "op10_mixing": OP10_SQL,
        "op11_prefix_trie": OP11_SQL,
    }
    return sql | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
