"""A training corpus from raw documents: five stages, each one of the operators in ``locusflow.llm``.

Each stage takes (spark, docs, sf_dir), docs being what its predecessor kept. Nulls, empty and long
texts, repeated rows, extra columns and empty tables are dealt with as the operators' docstrings say.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from locusflow.llm import decontamination, mixing, quality, sharding, simhash
from locusflow.llm.common import checkpoint_dir, documents


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, learnt from the labelled ones, doesn't reject."""
    return quality.keep_good(docs, documents(spark, sf_dir, table="labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that pairs of 5-word Jaccard similarity 0.8 connect: the one of the smallest id."""
    return simhash.keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of the benchmark."""
    return decontamination.remove_documents(docs, documents(spark, sf_dir, table="benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: a row for each whole pass over a document and for each part of one, its text cut to what is taken."""
    whole = docs.select("doc_id", "source", "text", F.struct("*").alias("record"))
    taken = mixing.mixed_rows(mixing.mix(whole), ["record", "text"])
    return taken.select(*[F.col("text") if c == "text" else F.col(f"record.`{c}`") for c in docs.columns])


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every record with its shard and place in it."""
    return sharding.shard(docs)


STAGES = [
    ("quality classifier", keep_quality),
    ("simhash near-dedup", drop_near_duplicates),
    ("benchmark decontamination", decontaminate),
    ("source mixing", mix_sources),
    ("sharding", shard),
]

#: The classifier's scores can't be had in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents of ``sf_dir``; each stage's rows are written, and read by the next."""
    docs = documents(spark, sf_dir)
    place = f"{checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for i, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{place}/{i}")
        docs = spark.read.parquet(f"{place}/{i}")
    return docs
