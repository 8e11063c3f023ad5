"""The corpus pipeline: five stages over documents, each by one operator of tessellum.llm."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessellum.llm import common, lines, minhash, mixing, packing, toxicity
from tessellum.llm.tokens import tokenizer_path


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a machine trained on the labelled ones among them scores below 0.7; nulls and repeats are scored like any other."""
    common.narrow_batches(spark)
    return toxicity.keep_clean(docs, toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that repeat an earlier one, exactly or nearly; those that keep no line go."""
    return lines.dedupe(docs)


def minhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, by five-word shingles and a similarity of 0.8."""
    common.narrow_batches(spark)
    return minhash.keep_one(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: not at all, once or twice."""
    return mixing.mixed(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of the mix."""
    common.narrow_batches(spark)
    return packing.pack(docs, tokenizer=tokenizer_path("word_bpe_49k.json"))


STAGES = [("toxicity", toxicity_stage), ("line dedup", line_stage), ("minhash near-dedup", minhash_stage), ("mixing", mixing_stage), ("packing", packing_stage)]
#: Kernels, MinHash and tokenizers are not to be said in SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each result written and read again; one row per piece, without its ids' bytes."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = common.store(docs)
    return docs.withColumn("ids_crc32", F.crc32("ids")).drop("ids")
