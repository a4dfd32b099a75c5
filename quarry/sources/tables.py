"""The driver's tables as the engine's inputs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions.columns import first_line


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` as corpus rows: five documents make a page, each one a section with its own fragment number."""
    d = read(spark, sf_dir, "documents")
    page, at = F.floor(F.col("doc_id") / 5).cast("long"), F.col("doc_id") % 5
    return d.select(
        F.col("doc_id").alias("ord"), first_line(F.col("text")).alias("title"), F.col("text").alias("content"),
        F.concat(F.lit("docs/p"), page.cast("string"), F.lit(".html#s"), F.floor(at / 2).cast("string")).alias("url"),
        F.concat(F.lit("docs/p"), page.cast("string"), F.lit(".html#s"), F.floor(at / 2).cast("string")).alias("section_id"),
        F.concat((5 - at).cast("string"), F.lit("/5")).alias("chunk_position"), at.cast("int").alias("chunk_id"),
        F.col("source").alias("module"), F.col("lang").alias("doc_category"),
    )


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``benchmark`` as questions."""
    return read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as facts of evaluation runs."""
    e = read(spark, sf_dir, "events")
    metric = F.element_at(F.array(*map(F.lit, ("correctness", "relevance", "groundedness", "retrieval"))), (F.col("event_id") % 4 + 1).cast("int"))
    return e.select(
        (F.col("user_id") % 8).alias("run"), F.col("event_type").alias("mode"), (F.col("event_id") % 94).alias("question_id"), metric.alias("metric"),
        F.least("value", F.lit(10.0)).alias("score"), F.col("value").alias("request_time"), "event_id", "user_id",
    )


def trials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as optimizer trials; those of errors failed."""
    state = F.when(F.col("event_type") == "error", "FAIL").otherwise("COMPLETE")
    return read(spark, sf_dir, "events").select(F.col("event_id").alias("number"), state.alias("state"), "value")
