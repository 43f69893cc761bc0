"""A training corpus from ``documents``: filter, deduplicate, mix and pack, each stage one corpus operator.

Each stage takes (spark, docs, sf_dir); its result is written as Parquet and read
as the next one's docs. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import quality
from tidemark.llm.common import stored, work_dir
from tidemark.llm.exact_dedup import drop_copies
from tidemark.llm.mixing import take_mix
from tidemark.llm.packing import pack
from tidemark.llm.queries import tokenizer_path
from tidemark.llm.simhash import one_of_each_group


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores 0.7 or more."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    weights = quality.scoring_weights(quality.labelled_rows(docs, labels, "quality"))
    return quality.keep_good(docs, weights, threshold=0.7)


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text, that with the largest doc_id."""
    return drop_copies(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of texts whose five-word shingles have a similarity of 0.8 or more."""
    return one_of_each_group(docs, words=5, least=0.8)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the capped mix of sources takes it."""
    return take_mix(docs, weights=[3.0, 1.0, 2.0], share=1.5, max_epochs=2.0)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces in sequences of at most 1024."""
    return pack(docs, tokenizer_path("byte_bpe_50k.json"), window=1024, end_id=0)


STAGES = [
    ("quality classifier", quality_stage),
    ("exact dedup", exact_stage),
    ("SimHash near-dedup", near_stage),
    ("mixing sources", mixing_stage),
    ("packing", packing_stage),
]

#: SQL can express neither the classifier nor the fingerprints nor the tokens.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what each keeps is written to the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    work = work_dir(spark, "pipeline")
    for number, (_, stage) in enumerate(STAGES[:-1]):
        docs = stored(stage(spark, docs, sf_dir), f"{work}/stage={number}")
    return STAGES[-1][1](spark, docs, sf_dir)
