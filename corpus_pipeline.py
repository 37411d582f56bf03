"""Corpus pipeline: documents through the operators, stage by stage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftline.llm import decontam, langid, mixing, ngram_join, secrets
from driftline.llm.store import discard, stored


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose language can be told, with it in ``lang``: null texts and texts without a letter go."""
    return langid.known(docs, langid.train(docs.where(langid.fold("doc_id", 4) != 2)))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate component."""
    return ngram_join.one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontam.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets replaced."""
    return secrets.redact(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which the mix takes words, with size, source_size, target and taken; columns of ``docs`` that have these names give way.

    A row and its part of the mix meet by doc_id and a hash of the whole row. Rows alike in all
    columns are one another's equals: each part of theirs comes with one of them.
    """
    made = ("size", "source_size", "target", "taken")
    key = F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns]).alias("__key")
    plan = stored(mixing.mix(docs.select("doc_id", "text", "source", key), carry=("__key",)))
    whole = docs.select(key, F.col("doc_id").alias("__id"), F.struct(*[f"`{c}`" for c in docs.columns if c not in made]).alias("__row"))
    if plan.groupBy("__key", "doc_id").count().where("count > 1").limit(1).count():
        whole = whole.dropDuplicates(["__key", "__id"])
    parts = plan.where("taken > 0").withColumnRenamed("__key", "__of")
    found = parts.join(whole, (F.col("__of") == F.col("__key")) & F.col("doc_id").eqNullSafe(F.col("__id")))
    return found.select("__row.*", *made)


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("secrets", secret_scan),
    ("mixture", mixture),
]
#: Learnt models and connected components: no SQL states these stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's result is written and read again, as the next one's documents, and goes when that one's is written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        before, docs = docs, stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = stored(docs)
            if k:
                discard(before)
    return docs
