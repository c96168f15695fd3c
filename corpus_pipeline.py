"""The corpus pipeline: quality rules, near-duplicate removal, substring dedup, decontamination, packing.

Every stage takes null ids and texts, empty tables, texts of any length, repeated rows and further columns of any names; all but the last return the columns of their input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lariat.llm.common import store
from lariat.llm.decontamination import remove_contamination
from lariat.llm.ngram_jaccard import keep_one
from lariat.llm.packing import pack
from lariat.llm.quality import keep_good
from lariat.llm.substring_dedup import remove_repeats


def _recounted(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast("bigint")) if "n_chars" in docs.columns else docs


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the learned list reject go: null, empty and short texts too. Equal rows are judged alike; without labels the base rules alone decide; an empty table stays empty."""
    return keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component stays, the one with the smallest id (rows without an id come first, repeated ids are told apart). Texts without words are no near-duplicates of anything and all stay; an empty table stays empty."""
    return keep_one(docs)


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words of repeated windows are cut out, in the order of ids (missing ones first); a document that loses all goes, one that had none stays. n_chars, where there is such a column, is counted again; an empty table stays empty."""
    return _recounted(remove_repeats(docs))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark passages are cut out; every row stays, one that was benchmark text alone with what is left. n_chars is counted again; an empty table or benchmark changes nothing."""
    return _recounted(remove_contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences; null and empty texts are an end id alone, equal rows are packed each, an empty table gives no pieces."""
    return pack(docs)


STAGES = [("quality rules", quality), ("n-gram jaccard join", near_duplicates), ("substring dedup", substrings), ("benchmark decontamination", decontaminate), ("packing", packing)]
#: No SQL expresses learned rules, tokenisers or column generation.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each one's result written as Parquet into the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = store(docs)
    return docs
