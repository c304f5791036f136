"""The corpus pipeline: quality, near-duplicates, decontamination, mixing, token shards.

Each stage takes ``(spark, docs, sf_dir)``. Its result is written as Parquet and read again as the
next one's ``docs``; all but the last return the columns of documents. Stages judge rows and not
ids: where a doc_id is null or has several texts, each text is judged by itself.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrand.llm.common import cut
from lodestrand.llm.decontam import decontaminate
from lodestrand.llm.mixing import mixed_rows
from lodestrand.llm.near_dup import near_duplicates
from lodestrand.llm.quality import quality_filter
from lodestrand.llm.token_shards import token_shards

#: Column that names a row by its text as well, if its doc_id does not do.
ROW = "__lodestrand_row"


def _named(docs: DataFrame) -> DataFrame:
    """``docs`` with a key of the row: the doc_id, or a hash of it and the text where the doc_id is null or has several texts."""
    text = F.xxhash64("text")
    several = cut(
        docs.groupBy("doc_id").agg(F.min(text).alias("lo"), F.max(text).alias("hi")).where("doc_id is null or lo != hi").select("doc_id"), "several"
    )
    own = F.col("doc_id").cast("long")
    if several.isEmpty():
        return docs.withColumn(ROW, own)
    several = several.select(F.col("doc_id").alias(f"{ROW}_id"), F.lit(True).alias(f"{ROW}_several"))
    joined = docs.join(several, F.col("doc_id").eqNullSafe(F.col(f"{ROW}_id")), "left")
    key = F.shiftrightunsigned(F.xxhash64("doc_id", "text"), 2) + (1 << 62)  # beyond all ids, so that these have precedence
    return joined.select(*docs.columns, F.when(F.col(f"{ROW}_several"), key).otherwise(own).alias(ROW))


def _rows(named: DataFrame) -> DataFrame:
    return named.select(F.col(ROW).alias("doc_id"), "text")


def _without(named: DataFrame, rows: DataFrame) -> DataFrame:
    """Rows of ``named`` whose key is not in ``rows``; the texts stay where they are if the keys are few."""
    gone = cut(rows.select(F.col("doc_id").alias(ROW)).distinct(), "removed")
    return named.join(gone, ROW, "left_anti").drop(ROW)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep, whatever their doc_id; null and empty texts go, repeated rows stay."""
    return quality_filter(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component, that of the smallest doc_id; of rows that repeat it and its text one stays.

    A component of rows without a usable doc_id keeps that of the least hash. Texts without words are no
    copies of each other and stay; no rows give no rows.
    """
    named = _named(docs)
    found = cut(near_duplicates(_rows(named)), "components")
    kept = _without(named, found.where("not kept"))
    again = found.where("kept and n_shingles > 0").groupBy("doc_id").count().where("count > 1")
    if again.isEmpty():
        return kept
    again = cut(again.select(F.col("doc_id").alias(ROW)), "repeated")
    kept = named.join(cut(found.where("not kept").select(F.col("doc_id").alias(ROW)).distinct(), "removed"), ROW, "left_anti")
    once = kept.join(again, ROW, "left_semi").dropDuplicates([ROW])
    return kept.join(again, ROW, "left_anti").unionByName(once).drop(ROW)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark passage; null and empty texts stay."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    named = _named(docs)
    return _without(named, decontaminate(_rows(named), benchmark).where("contaminated"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents to the target weights, one row for each epoch."""
    return mixed_rows(docs)


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token shards in training order, a row for each sequence; null and empty texts are an end mark."""
    return token_shards(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality),
    ("minhash_near_dedup", near_dedup),
    ("benchmark_decontamination", decontamination),
    ("mixing", mixing),
    ("token_shards", shards),
]
#: SQL cannot encode token ids; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
