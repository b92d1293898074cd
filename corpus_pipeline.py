"""Corpus pipeline: language ID, near-duplicates, repeated passages, benchmark contamination, mixing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and
read again as the next one's docs.  All stages but the last return the columns of `documents`.

Rows: a null text is rejected by the first stage, as no language can be told.  Rows that share a
doc_id count as one document.  An empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessella.llm.common import Workspace, checkpoint_root, table
from tessella.llm.langid import keep_identified
from tessella.llm.minhash import deduplicate
from tessella.llm.mixing import mix
from tessella.llm.phrases import decontaminate
from tessella.llm.suffixes import remove_repeats


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a recognised language stay."""
    return keep_identified(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: that with the smallest id."""
    return deduplicate(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every string of 200 bytes that the corpus has more than once is cut out of the texts."""
    return remove_repeats(docs)


def contamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which a twentieth or more are benchmark phrases go."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows at the target weights of their sources, once for each epoch; mix_key orders them."""
    return mix(docs)


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("contamination", contamination),
    ("mixture", mixture),
]

#: Learned and set-similarity stages have no SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; between them the rows are written to the shared folder and read again."""
    checkpoint_root(spark)
    docs = table(spark, sf_dir, "documents")
    with Workspace(spark, "pipeline") as ws:
        for k, (name, stage) in enumerate(STAGES):
            docs = ws.save(stage(spark, docs, sf_dir), name)
            if k:
                ws.drop(STAGES[k - 1][0])
        return docs.checkpoint()
