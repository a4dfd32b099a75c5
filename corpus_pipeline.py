"""The pipeline over documents: each stage works on all that the one before it kept.

quality classifier -> line dedup -> near-dedup -> mixing to target weights -> best-fit packing

Every stage but the last returns the columns of ``documents``. Rows that share a doc_id, or have none, are documents of
their own, told apart by their texts; null texts are empty texts; an empty table passes through as an empty table; other columns are dropped by the first stage, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.llm import quality
from quarry.llm.line_dedup import apply_bitmaps, keep_bitmaps
from quarry.llm.mixing import mix
from quarry.llm.packing import pack, pieces
from quarry.llm.queries import tokenizer_path
from quarry.llm.scratch import stored
from quarry.llm.similar import similar_documents, text_key

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
QUALITY = 0.3
CAPACITY = 2048
#: Shingles of the near-dedup, and the Jaccard similarity of near copies in per cent.
WORDS, SIMILAR = 5, 80


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier scores at ``QUALITY`` or above; the others go."""
    docs = docs.select(COLUMNS)
    model = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), max_rows=10_000)
    return docs.filter(quality.score_column(docs, model)(F.col("text")) >= QUALITY)


def drop_common_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines found in ten documents or more stay only where they are first, so that no text is lost altogether."""
    docs = docs.select(COLUMNS)
    out = apply_bitmaps(docs, keep_bitmaps(docs, min_docs=10, keep_first=True))
    return out.select("doc_id", F.col("kept_text").alias("text"), "lang", "source", F.length("kept_text").cast("long").alias("n_chars"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near copies, the document with the smallest doc_id.

    The SimHash trie join finds the pairs, by shingles of ``WORDS`` words; those are near copies whose shingles are ``SIMILAR`` % alike (Jaccard).
    Rows are told apart by doc_id and text: other texts of one doc_id stay, rows with the same doc_id and text are one.
    """
    docs = docs.select(COLUMNS)
    row = F.xxhash64("doc_id", text_key(F.col("text")))
    first = similar_documents(docs, words=WORDS, percent=SIMILAR).groupBy("root").agg(F.min(F.struct("doc_id", "key")).alias("first")).select("first.*")
    kept = docs.withColumn("row", row).join(first.select(F.xxhash64("doc_id", "key").alias("f_row")), F.col("row") == F.col("f_row"), "left_semi")
    same = Window.partitionBy("row").orderBy("source", "lang", "n_chars")
    return kept.withColumn("row_no", F.row_number().over(same)).filter("row_no = 1").select(COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as many times as the mix takes it."""
    docs = docs.select(COLUMNS)
    taken = mix(docs).groupBy(F.col("doc_id").alias("t_id"), F.col("source").alias("t_source")).agg(F.sum("copies").alias("copies"), F.count("*").alias("rows"))
    same = Window.partitionBy("doc_id", "source").orderBy(F.xxhash64("text"))
    out = docs.withColumn("row_no", F.row_number().over(same)).join(taken.filter("copies > 0"), F.col("doc_id").eqNullSafe(F.col("t_id")) & F.col("source").eqNullSafe(F.col("t_source")))
    # rows that share a doc_id and a source share their copies evenly
    mine = F.floor((F.col("copies") + F.col("rows") - F.col("row_no")) / F.col("rows")).cast("int")
    return out.withColumn("mine", mine).filter("mine > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("mine")))).select(COLUMNS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents' ids, each with its sequence and the place in it."""
    return pack(pieces(docs.select("doc_id", "text"), tokenizer_path("word_bpe_49k.json"), capacity=CAPACITY), capacity=CAPACITY)


STAGES = [
    ("quality", keep_quality),
    ("line_dedup", drop_common_lines),
    ("near_dedup", drop_near_copies),
    ("mix", mix_sources),
    ("pack", pack_sequences),
]

#: The first stage is a trained model and the third a connected component: SQL can't express them.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each one's rows are written to the shared folder before the next reads them."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = stored(docs, f"stage-{name}")
    return docs
