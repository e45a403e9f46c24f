"""A corpus pipeline of five operators; every stage is written and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenq.llm._store import Scratch
from lumenq.llm.classifier import score, train
from lumenq.llm.decontamination import decontaminate, n_hit
from lumenq.llm.mixing import mix
from lumenq.llm.near_dedup import near_dups
from lumenq.llm.sharding import reshard_slots


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that the quality classifier rejects (score below 0.5)."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    scored = score(docs, *train(docs, labels))
    return scored.filter("score >= 0.5").select("doc.*")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near duplicates, the one of the smallest id."""
    from lumenq.llm._store import BROADCAST_ROWS

    found = Scratch(spark, "stage").save(near_dups(docs.select("doc_id", "text")).filter(~F.col("kept")).select("doc_id"), "dropped")
    drop = found.distinct()
    return docs.join(F.broadcast(drop) if found.count() <= BROADCAST_ROWS else drop, "doc_id", "left_anti").select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that hold a window of a benchmark item."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text")
    return decontaminate(docs, items).filter(n_hit() == 0).select("doc.*")


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat or leave out documents so that sources meet their target weights."""
    mixed = mix(docs).filter("copies > 0")
    return mixed.select("doc", F.explode(F.sequence(F.lit(1), "copies"))).select("doc.*")


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with the shard and slot that resharding gives them."""
    return reshard_slots(docs)


STAGES = [
    ("quality classifier", quality),
    ("near dedup", near_dedup),
    ("decontamination", decontamination),
    ("mixing", mixing),
    ("sharding", sharding),
]
#: Trained weights and hash joins of signatures have no SQL form; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; each reads what the one before wrote."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scratch = Scratch(spark, "pipeline")
    for k, (name, stage) in enumerate(STAGES):
        done = stage(spark, docs, sf_dir)
        if k == len(STAGES) - 1:
            return done
        docs = scratch.save(done, name.replace(" ", "-"))
