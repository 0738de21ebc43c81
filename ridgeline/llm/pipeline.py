"""The corpus pipeline: toxicity, near duplicates, repeated passages, source mix, packing.

Each stage takes (spark, docs, sf_dir), and its result, written as Parquet and
read again, is the next one's docs. All but the last return the columns of
documents.

Defined results, in every stage: a null or empty text is clean, near to nothing,
repeats nothing, has size 0 (a mix takes it as often as the whole source repeats)
and packs as the end id alone; rows without doc_id are judged like others, after all
that have one; rows of one doc_id with different texts are documents of their
own, repeated rows are near duplicates of each other; ties go to the smaller
doc_id; very long texts are read whole; extra columns, whatever their names, pass
through; an empty table gives no rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import minhash, mixing, packing, suffix, tokens, toxicity
from .common import save


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose toxicity is below 0.5; the model learns from the labels outside the held-out fold."""
    model = toxicity.train_model(toxicity.training_rows(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return toxicity.keep_civil(docs, model)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row, the one of smallest doc_id, of each group of near duplicates."""
    return minhash.keep_one_each(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that repeat across documents stay in the first of them only."""
    return suffix.remove_repeats(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of the mix, as often as it takes them."""
    return mixing.mixed_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of 1024 tokens."""
    return packing.pack_documents(docs, tokens.vocabulary_path())


STAGES = [("toxicity", drop_toxic), ("near_dedup", drop_near_duplicates), ("suffix_dedup", cut_repeats), ("source_mix", mix), ("packing", pack)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = save(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
