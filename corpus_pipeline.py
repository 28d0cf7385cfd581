"""The corpus pipeline: toxicity, exact dedup, near dedup, mixing, packing.

Each stage takes all that its predecessor kept, as Parquet, and returns a DataFrame:
documents for all but the last, pieces of training sequences for the last.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from chronaxis.llm.common import shared_folder
from chronaxis.llm.exact_dedup import DigestIndex, drop_copies
from chronaxis.llm.mixing import remix
from chronaxis.llm.packing import pack
from chronaxis.llm.simhash import drop_near_copies
from chronaxis.llm.toxicity import ToxicityModel

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the lexicon model scores below one half, or in which it finds no term at all, quoted or not."""
    model = ToxicityModel.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return model.keep_clean(docs.select(*COLUMNS))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    with DigestIndex.temporary(spark) as index:
        return drop_copies(docs.select(*COLUMNS), index, "documents")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near copies."""
    return drop_near_copies(docs.select(*COLUMNS))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents drawn by source weights; every source whole at least once, none over twice."""
    return remix(docs.select(*COLUMNS), target_entropy=0.98, max_repeats=2.0)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of packed sequences."""
    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("toxicity", toxicity), ("exact_dedup", exact_dedup), ("near_dedup", near_dedup), ("mixing", mixing), ("packing", packing)]

#: SQL can't express the toxicity model, the components or the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to ``documents``, each result written to the shared folder and read again."""
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        out = f"{folder}/{name}"
        stage(spark, docs, sf_dir).write.parquet(out)
        docs = spark.read.parquet(out)
    return docs
