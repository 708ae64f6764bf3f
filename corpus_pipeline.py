"""A training-data pipeline: stages that each rewrite the documents that the one before kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from veldt.llm.common import Stage, scope, table
from veldt.llm.decontaminate import remove
from veldt.llm.mixing import mix
from veldt.llm.ngram_join import keep_one
from veldt.llm.quality_rules import filter_good
from veldt.llm.token_store import store


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    return filter_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of similar ones stays."""
    return keep_one(docs, label="pipeline-keep")


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a passage of the benchmark go."""
    return remove(docs, table(spark, sf_dir, "benchmark"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeat until each source has its share."""
    return mix(docs, label="pipeline-mix")


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files, read back: a row for each document written."""
    return store(docs, public_tokenizers.path("word_bpe_49k.json"), "pipeline-tokens")


STAGES = [
    ("quality rules", quality),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontaminate),
    ("mixing sources to target weights", mixture),
    ("token-ID / binary output", tokens),
]

#: SQL can't express the learned and searching stages; tests compare each with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows for `documents`; each stage's rows are written and read again before the next, and what the stage
    put by on its way is deleted then. Of the last stage the token files and their rows stay, as the result reads them."""
    docs, stage = table(spark, sf_dir, "documents"), Stage(spark, "pipeline", held=True)
    for i, (_, step) in enumerate(STAGES[:-1]):
        with scope(spark):
            docs = stage.put(f"{i}", step(spark, docs, sf_dir))
        if i:
            stage.drop(f"{i - 1}")
    return STAGES[-1][1](spark, docs, sf_dir)
