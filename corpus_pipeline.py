"""Cleaning a corpus in stages, each stage one operator of spanloom.llm.

Every stage works on all that its predecessor kept and reads nothing else but what it names: toxicity learns from
the labels of the documents that it is given.

Null texts count as empty, and empty texts are texts: equal to each other, with fingerprint zero. A null doc_id is below
all others where the largest stays and above them where the smallest stays; repeated rows leave one. Texts are taken whole, however
long. Further columns go through as they are, whatever their names. Without toxic labels to learn from no document
is rejected; empty tables give empty results.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.llm import byte_bpe, exact_dedup, mixing, simhash, toxicity
from spanloom.llm.common import written
from spanloom.shipping import ship_code


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity operator does not reject."""
    ship_code(spark)
    model = toxicity.train_on(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.without_toxic(docs, model)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts, that with the largest doc_id."""
    ship_code(spark)
    return exact_dedup.dedup(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked fingerprints, that with the smallest doc_id."""
    ship_code(spark)
    return simhash.near_dedup(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, as equal rows."""
    ship_code(spark)
    mixed = mixing.mix(docs.withColumnsRenamed({c: f"doc_{i}" for i, c in enumerate(docs.columns)}), **{k: f"doc_{docs.columns.index(k)}" for k in ("doc_id", "text", "source")})
    copies = mixed.where("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return copies.select(*[F.col(f"doc_{i}").alias(c) for i, c in enumerate(docs.columns)])


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Tokens of each row of the mix, and digests of them and of what they decode to."""
    ship_code(spark)
    return byte_bpe.encoded_digests(docs, path=public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("simhash_near_dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("byte_bpe", encode),
]
#: A trained model decides in the first stage, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
