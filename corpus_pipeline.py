"""The corpus pipeline: stages over documents, each one reading what the one before it wrote."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from stagelens.session import scratch_path


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents not predicted toxic; learned from the labelled documents of the corpus."""
    from stagelens.llm.toxicity import clean_documents

    known = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return clean_documents(docs, known, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def in_a_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with letters that some learned language compresses better than the others."""
    from stagelens.llm.lang_id import documents_in_a_language

    return documents_in_a_language(docs)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of smallest id of each group linked by five-word n-grams at a similarity of 0.8."""
    from stagelens.llm.ngram_join import distinct_documents

    return distinct_documents(docs, k=5, threshold=80)


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    from stagelens.llm.mixing import mixed_documents

    return mixed_documents(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the ids and of what they decode to."""
    import public_tokenizers

    from stagelens.llm.bpe_words import encode_and_decode

    return encode_and_decode(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("toxicity", without_toxic),
    ("language ID", in_a_language),
    ("n-gram Jaccard join", one_of_each_group),
    ("mixing sources to target weights", mixed_sources),
    ("BPE encoding and decoding", encoded),
]

#: SQL cannot express the trained stages nor the encoding; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn over ``documents``; every stage's result is written below ``spark.checkpoint.dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        path = scratch_path(spark, "stage")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
