"""Five stages from raw documents to token ids. Each stage takes all that the one before kept; its result
is written as Parquet and read again as the next one's documents.

All but the last return the columns of documents, and drop rows: failed quality rules, rejected language,
near-duplicates (one document of each component stays, the one with the smallest id), documents that share
a window with a benchmark item. The last returns the documents' ids and token ids.

Nulls, empty and very long texts, ties and repeated rows are each operator's own affair (see their
docstrings). Of rows with the same doc_id in a component one stays. Extra columns, whatever their names, go
through the first four stages as they are.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from skeinflow.llm import byte_bpe, decontamination, jaccard_join, language_id, quality_rules
from skeinflow.llm.common import Scratch, beside, table


def stage_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.kept_documents(docs)


def stage_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The model learns from labelled documents that aren't held out; the label itself stays as it is."""
    model = language_id.train(docs.where(~language_id.held_out()))
    return language_id.identify(beside(docs, text="text"), model).where("not lang_rejected").select("row.*")


def stage_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard_join.without_near_duplicates(docs)


def stage_decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.without_contaminated(docs, table(spark, sf_dir, "benchmark"))


def stage_encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return byte_bpe.encode(docs.select("doc_id", "text"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN).select("doc_id", "n_tokens", "ids")


STAGES = [
    ("quality_rules", stage_quality),
    ("language_id", stage_language),
    ("near_duplicates", stage_near_duplicates),
    ("decontaminate", stage_decontaminate),
    ("encode", stage_encode),
]

#: SQL has no language model and no tokenizer; tests/llm holds run() against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another; what a stage has read is deleted once its result is written."""
    docs, before = table(spark, sf_dir, "documents"), None
    for _, stage in STAGES[:-1]:
        scratch = Scratch(spark)
        docs = scratch.write(stage(spark, docs, sf_dir))
        if before:
            before.drop()
        before = scratch
    return STAGES[-1][1](spark, docs, sf_dir)
