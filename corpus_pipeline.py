"""A corpus from raw documents to token shards, in five stages.

Each stage works on all that its predecessor kept; all but the last return the
columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm.decontaminate import keep_clean
from tidemark.llm.jaccard_join import keep_one_of_each
from tidemark.llm.mixing import REPETITION, mixed_documents
from tidemark.llm.quality import keep_good
from tidemark.llm.shared import materialize
from tidemark.llm.token_output import default_tokenizer, token_table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    return keep_good(docs.select(COLUMNS), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by five-word shingles at a similarity of 0.8 or more, the smallest id stays."""
    return keep_one_of_each(docs.select(COLUMNS), k=5, num=80, den=100)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold most of a benchmark item go."""
    return keep_clean(docs.select(COLUMNS), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources are flattened as far as REPETITION allows; every document occurs at least once."""
    return mixed_documents(docs.select(COLUMNS), max_repetition=REPETITION)


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shards of token ids, read back: doc_id, start, n_tokens, ids_crc32."""
    return token_table(docs.select(COLUMNS), default_tokenizer()).select("doc_id", "start", "n_tokens", "ids_crc32")


STAGES = [("quality classifier", quality), ("n-gram Jaccard join", near_duplicates), ("benchmark decontamination", decontamination), ("mixing to target weights", mixing), ("token-ID output", token_output)]

#: Training, trees, tiling and tokenizing can't be said in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = materialize(docs, f"stage-{i}")
    return docs
