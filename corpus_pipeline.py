"""From raw documents to token ids: toxic documents go, one of each group of near copies stays, personal data is masked,
sources are mixed to their target weights, and the texts are encoded.

Each stage takes (spark, docs, sf_dir); its rows are written as Parquet in the shared checkpoint folder and read again as the
next stage's docs. What a stage wrote is removed once the next one is written; the last one's input stays, as its rows are read later.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from quirefold.llm import bpe, jaccard_join, mixing, pii, toxicity
from quirefold.llm.common import shared_folder


def toxic_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that score as toxic; the scorer is fitted on the stage's own documents and their labels."""
    return toxicity.drop_toxic(docs, toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group that links of 5-word shingles at a similarity of 0.8 connect."""
    return jaccard_join.keep_one(docs)


def masked(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Puts the kind in brackets in place of each span of personal data."""
    return pii.mask_documents(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats and leaves out documents until each source has its target share of the words."""
    return mixing.mix_documents(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each text, with their number and the digests of ids and of the decoded text."""
    return bpe.encode_documents(docs, bpe.tokenizer_path())


STAGES = [
    ("toxicity", toxic_out),
    ("jaccard_join", one_of_each),
    ("personal_data", masked),
    ("mixing", mixed),
    ("bpe", encoded),
]

ORACLE_SQL = None


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder of the shared file system."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents."""
    docs, done = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    folder = f"{shared_folder(spark)}/corpus-{uuid.uuid4().hex}"
    for name, stage in STAGES[:-1]:
        path = f"{folder}/{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if done:
            remove(spark, done)
        done = path
    return STAGES[-1][1](spark, docs, sf_dir)
