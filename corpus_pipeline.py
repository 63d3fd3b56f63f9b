"""The corpus pipeline: stages over ``documents``, each written as Parquet and reread by the next."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyhound.llm import best_fit, exact_dedup, probminhash, quality_ftrl, suffix_dedup
from tallyhound.llm.queries import PACK_TOKENIZER, SEQUENCE, tokenizer_path
from tallyhound.llm.staging import SMALL_PAGES, shared_dir, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    return quality_ftrl.keep_good(docs, quality_ftrl.fit(docs, table(spark, sf_dir, "labels")))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts one row stays, of the smallest doc_id."""
    return exact_dedup.exact_dedup(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near duplicates one row stays, of the smallest doc_id."""
    return probminhash.near_dedup(docs)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bytes covered by a 200-byte string that also starts elsewhere go; n_chars, where there is one, follows the text."""
    cut = suffix_dedup.cut_repeats(docs, 200)
    return cut.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else cut


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The packed pieces of all that is left."""
    return best_fit.pack_documents(docs, tokenizer_path(PACK_TOKENIZER), SEQUENCE)


#: In this order; each writes what it keeps, and the next reads that.
STAGES = [("quality", quality), ("exact", exact), ("near", near), ("repeats", repeats), ("packing", packing)]

#: SQL can't tokenise or train; tests/llm holds the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, base = table(spark, sf_dir, "documents"), f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.options(**SMALL_PAGES).parquet(f"{base}/{name}")
        docs = spark.read.parquet(f"{base}/{name}")
    return docs
