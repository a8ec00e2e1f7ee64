"""Corpus pipeline: each stage works on all that the one before kept.

A stage takes (spark, docs, sf_dir) and returns documents (doc_id, text, lang, source, n_chars); the
last returns packed pieces. Every stage is one of the operators in ``ketspark.llm``, applied to its whole input.

Nulls and repeated rows are treated as the operators say; the near-duplicate stage keeps one row of each class and every row
without an id. Rows of one id and one text are one document; those of one id and different texts are documents of their own, and stay
if no other document is near them.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ketspark.llm import decontaminate, jaccard_join, packing, quality, suffix_dedup
from ketspark.llm.common import small, stored
from ketspark.llm.tokens import default_tokenizer
from ketspark.plans.numbering import numbered

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the outlier test keep."""
    return quality.kept_documents(docs).select(*COLUMNS)


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class, the one with the smallest id (and of equal ids, the text of the smallest hash)."""
    named = F.col("doc_id").isNotNull()
    if docs.where(named).groupBy("doc_id").count().where("count > 1").limit(1).count():
        # numbers in order of ids take their place
        rows = docs.where(named).withColumn("__text", F.sha2("text", 256)).dropDuplicates(["doc_id", "__text"])
        rows = stored(numbered(rows, "doc_id", "__text", name="__row"), "rows")
        found = jaccard_join.near_duplicates(rows, "__row").where(F.col("__row") != F.col("class_id")).select(F.col("__row").alias("__gone"))
        left = rows.join(small(found), F.col("__row") == F.col("__gone"), "left_anti")
        return left.select(*COLUMNS).unionByName(docs.where(~named).select(*COLUMNS))
    found = jaccard_join.near_duplicates(docs)
    gone = found.where(F.col("doc_id") != F.col("class_id")).select(F.col("doc_id").alias("__gone")).distinct()
    left = docs.join(small(gone), F.col("doc_id") == F.col("__gone"), "left_anti")
    return left.select(*COLUMNS)


def suffix_array_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the strings of 400 bytes, and without the passages of over 50 words, that start anywhere else as well."""
    cut = suffix_dedup.remove_strings(docs.select(*COLUMNS), words=51)
    whole = F.col("repeats.n_removed") == 0
    # a cut may fall inside a character: what is left of it goes
    text = F.when(whole, F.col("text")).otherwise(characters(F.col("repeats.kept")))
    return cut.select("doc_id", text.alias("text"), "lang", "source", F.when(whole, F.col("n_chars")).otherwise(F.length(text)).cast("long").alias("n_chars"))


def characters(data: Column) -> Column:
    """Text of UTF-8 bytes, without broken characters."""

    @F.arrow_udf("string")
    def decode(data: pa.Array) -> pa.Array:
        return pa.array([d.as_py().decode("utf-8", "ignore") for d in data], pa.string())

    return decode(data)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.clean_documents(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select(*COLUMNS)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents, packed into sequences of 2048 tokens."""
    return packing.pack(packing.pieces(docs, default_tokenizer(), 2048, 0, "doc_id", "text"))


STAGES = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", ngram_jaccard_join),
    ("suffix-array dedup", suffix_array_dedup),
    ("benchmark decontamination", benchmark_decontamination),
    ("best-fit packing", best_fit_packing),
]

#: The stages can't be expressed in SQL; tests compare them with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = stored(docs, f"stage{k}")
    return docs
