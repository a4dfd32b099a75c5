"""What tasks hold, and what is shuffled, at larger sizes."""

from __future__ import annotations

import tracemalloc

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from quarry.operators import grounding, keyword_index, vector_index
from quarry.operators import retrieval as R


def peak(run, batches) -> float:
    """Megabytes that a task's function needs at once, its input aside."""
    tracemalloc.start()
    try:
        for _ in run(iter(batches)):
            pass
        return tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()


def test_products_of_many_questions_are_bounded(spark):
    rng = np.random.default_rng(1)
    asked = spark.range(4000).select(F.col("id").alias("query_id"), F.array(*(F.sin(F.col("id") * i) for i in range(1, 5))).alias("q"))
    v = rng.normal(size=(4096, 4))
    batch = pa.RecordBatch.from_arrays([pa.array(np.arange(4096)), pa.array(list(v)), pa.array(np.zeros(4096, np.int32))], ["ord", "v", "cell"])
    assert peak(R._multiplied(asked, 3), [batch]) < 60  # 4000 x 4096 products alone are 131 MB
    names, q = R.gathered(asked)
    assert peak(vector_index._cells(spark, names, q, np.zeros((4000, 1), np.int64), 3), [batch]) < 60
    got = {(r.query_id, r.rank): r.ord for r in R.dense_search(spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "ord long, embedding array<double>"), asked.select("query_id", F.col("q").alias("q_vec")), 3).filter("query_id % 500 = 7").collect()}
    unit, q = v / np.linalg.norm(v, axis=1, keepdims=True), np.sin(np.arange(4000)[:, None] * np.arange(1, 5))
    for i in range(7, 4000, 500):
        assert [got[i, k] for k in range(3)] == np.argsort(-(unit @ q[i]), kind="stable")[:3].tolist()


def shuffled(spark) -> int:
    context = spark.sparkContext
    stages = context._jsc.sc().statusStore().stageList(None, False, False, context._gateway.new_array(context._jvm.double, 0), None).iterator()
    total = 0
    while stages.hasNext():
        total += stages.next().shuffleWriteRecords()
    return total


def test_a_scan_shuffles_neither_postings_nor_scores(spark):
    words = F.concat_ws(" ", *(F.concat(F.lit("w"), F.pmod(F.xxhash64("id", F.lit(i)), F.lit(40)).cast("string")) for i in range(12)))
    corpus = spark.range(3000).select(F.col("id").alias("ord"), words.alias("content"), F.lit("m").alias("module"), F.lit("c").alias("doc_category"))
    questions = spark.createDataFrame([(i, f"w{i} w{i + 1} w{i + 2} nowhere w{i}") for i in range(30)], "query_id long, query string")
    before = shuffled(spark)
    got = R.bm25_search(corpus, questions, 5).collect()
    assert shuffled(spark) - before < 3000  # postings of the questions' words alone are some 30,000
    want = R.ranked(R.bm25_scores(corpus, questions), 5).select("query_id", "rank", "ord", "score").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want))


class Kept:
    """In place of a table: keeps the function that tasks would run."""

    def __init__(self):
        self.schema = {"doc_id": self}
        self.dataType = self

    def select(self, *_):
        return self

    def simpleString(self):
        return "bigint"

    def mapInArrow(self, run, _):
        return run


def test_flags_of_a_batch_are_made_in_parts():
    answer = "```cpp\n" + "".join(f"name{i}(1);\n" for i in range(300)) + "```"
    batch = pa.RecordBatch.from_arrays([pa.array(range(600)), pa.array([answer] * 600), pa.array(["seen"] * 600)], ["doc_id", "answer", "observations"])
    run = grounding.flags(Kept(), ["doc_id"])
    assert sum(b.num_rows for b in run(iter([batch]))) == 600 * 300
    assert peak(run, [batch]) < 8


def test_an_index_shuffles_its_postings_once(spark, tmp_path):
    words = F.concat_ws(" ", *(F.concat(F.lit("w"), F.pmod(F.xxhash64("id", F.lit(i)), F.lit(50)).cast("string")) for i in range(20)))
    corpus = spark.range(2000).select(F.col("id").alias("ord"), words.alias("content"))
    context = spark.sparkContext
    stages = lambda: list(context._gateway.jvm.scala.jdk.javaapi.CollectionConverters.asJava(context._jsc.sc().statusStore().stageList(None, False, False, context._gateway.new_array(context._jvm.double, 0), None)))
    before = {x.stageId() for x in stages()}
    keyword_index.write_index(corpus, str(tmp_path / "i"), width=16)
    blocks = keyword_index.open_index(spark, str(tmp_path / "i")).blocks
    n, postings = blocks.agg(F.count("*"), F.sum("n")).head()
    assert n > 4000 and postings == corpus.select(F.explode(F.array_distinct(F.split("content", " ")))).count()
    assert sum(x.shuffleWriteRecords() >= n for x in stages() if x.stageId() not in before) == 1
