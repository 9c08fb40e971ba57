"""The corpus pipeline: five stages from documents to packed sequences.

Each stage works on all that the one before it has kept, and its decisions take effect: toxic
documents go, one document of each group of near copies stays, personal data is masked, documents
are taken by their calibrated probabilities, and what is left is packed.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import free_name, table, written
from tessera.llm.jaccard_join import jaccard_components
from tessera.llm.mixing import mix_sources
from tessera.llm.packing import pack_documents
from tessera.llm.pii import fit_tagger, redact
from tessera.llm.toxicity import fit_toxicity, score_toxicity


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go. Null and empty texts score like a text without words; repeated
    rows and null ids are judged as any row; no rows give no rows. Without labels of both kinds the score is constant."""
    model = fit_toxicity(docs, table(spark, sf_dir, "labels"))
    return score_toxicity(docs, model).where("predicted = 0").select(docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies stays: the one of the least id (null ids last; ties: any one row). Rows are
    compared by their texts alone, whatever their ids; rows without words are groups of their own and stay."""
    row, component = free_name(docs, "row"), free_name(docs, "component")
    numbered = written(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
    groups = jaccard_components(numbered, n=5, percent=80, doc_id=row)
    groups = groups.select(F.col("doc_id").alias(row), F.col("component_id").alias(component))
    ranked = groups.join(numbered.select(row, "doc_id"), row)
    first = ranked.groupBy(component).agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", row)).alias("least"))
    return numbered.join(first.select(F.col(f"least.{row}").alias(row)), row, "left_semi").select(docs.columns)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All spans of personal data and secrets become <KIND>. Every row stays; null texts stay null, empty ones empty."""
    return redact(docs, fit_tagger(docs)).select(docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are taken by the probabilities of their source, language and topic. Nulls are values of their own;
    rows of one id and text are taken or left together; no rows give no rows."""
    return mix_sources(docs).where("taken").select(docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all texts and their places in sequences. Null and empty texts are an end id alone; repeated rows and
    null ids are packed as rows of their own; no rows give no rows."""
    return pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), size=2048, end=0)


STAGES = [("toxicity", drop_toxic), ("near copies", drop_near_copies), ("personal data", mask_personal_data), ("mixing", mix), ("packing", pack)]

#: SQL can express neither the classifiers nor the packing; tests/llm hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}")
    return docs
