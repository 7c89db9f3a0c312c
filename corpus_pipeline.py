"""A pipeline of five operators over ``documents``: classify, dedup twice, decontaminate, encode.

``STAGES`` lists (name, function of (spark, docs, sf_dir)); each result is
written as Parquet and read again as the next function's ``docs``. All but
the last return the columns of ``documents``.

Defined results, as each operator has them: null texts count as empty; rows of
equal id and text are copies, of which one stays; null ids are kept apart by
their texts and never preferred; texts go through every stage whole; ids of
equal copies break ties; an empty table stays empty; further columns of
``documents``, whatever their names, come back up to the last stage, which
returns the encoded rows.
"""

from pyspark.sql import DataFrame, SparkSession

from corpusvitals.llm import bpe, decontaminate, exact_dedup, quality, simhash
from corpusvitals.llm.queries import tokenizer_path
from corpusvitals.session import stage


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    machine = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.keep_good(docs, machine)


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.dedup(docs)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.dedup(docs)


def without_benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.encode(docs, tokenizer_path("word_bpe_49k.json"), ("n_tokens", "ids_sha256", "decoded_sha256"))


STAGES = [
    ("quality", good_documents),
    ("exact_dedup", without_copies),
    ("near_dedup", without_near_copies),
    ("decontaminate", without_benchmarks),
    ("encode", encoded),
]

#: The classifier's decisions cannot be put in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, function) in enumerate(STAGES):
        docs = function(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = stage(docs, name)
    return docs
