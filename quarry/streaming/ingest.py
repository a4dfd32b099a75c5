"""Pages as a stream: new files become chunks, and a page that comes again replaces its chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quarry.operators.extraction import chunks
from quarry.sources import snapshots

SCHEMA = "page_id BIGINT, url STRING, html STRING"


def chunk_stream(spark: SparkSession, folder: str, *, category: str = "user", files_per_trigger: int = 100) -> DataFrame:
    """The pages of a folder of Parquet files, as they arrive."""
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def start(pages: DataFrame, out: str, checkpoint: str, *, category: str = "user") -> StreamingQuery:
    """Write each batch's chunks to a folder of its own number, so that a batch that runs again replaces what it wrote."""

    def put(batch: DataFrame, number: int) -> None:
        chunks(batch.select("page_id", "url", "html"), category=category).withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return pages.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def start_snapshots(pages: DataFrame, out: str, checkpoint: str, *, category: str = "user") -> StreamingQuery:
    """Each batch of pages as a change of the corpus at ``out`` (:mod:`quarry.sources.snapshots`): a page that comes again loses all its old chunks, even if it has none now.

    A batch that runs again makes one snapshot more with the same chunks.
    """

    def put(batch: DataFrame, number: int) -> None:
        last = batch.groupBy("url").agg(F.max_by(F.struct("page_id", "html"), "page_id").alias("p")).select("url", "p.*")
        snapshots.upsert(chunks(last, category=category), out, removed=last.select(F.coalesce("url", F.lit("")).alias("file")))

    return pages.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current(spark: SparkSession, out: str) -> DataFrame:
    """Of each page the chunks of the last batch that had it."""
    rows = spark.read.parquet(out)
    last = rows.groupBy(F.col("page_id").alias("p")).agg(F.max("batch").alias("b"))
    return rows.join(last, (F.col("page_id") == F.col("p")) & (F.col("batch") == F.col("b"))).drop("p", "b")
