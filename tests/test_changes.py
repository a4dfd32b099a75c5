"""SQL table functions, trials that are looked at while they run, corpora changed page by page, sketches."""

import random
import threading

import pytest
from pyspark.sql import functions as F

from quarry.functions import sql
from quarry.operators import chunking
from quarry.operators import evaluation as E
from quarry.sources import snapshots
from quarry.streaming import trials


def test_table_functions_in_sql(spark):
    sql.register(spark, scorers={"overlap": lambda questions, texts: [len(set(q.split()) & set(t.split())) for q, t in zip(questions, texts, strict=True)]})
    long = "Sentence of words. " * 200
    spark.createDataFrame([(1, long), (2, "short"), (3, None)], "doc_id int, text string").createOrReplaceTempView("t_docs")
    got = [(r.doc_id, r.pos, r.total, r.chunk) for r in spark.sql("SELECT d.doc_id, c.* FROM t_docs d, LATERAL chunk_text(d.text, 1000, 200) c ORDER BY 1, 2").collect()]
    want = [(r.doc_id, r.pos, r.total, r.chunk) for r in chunking.chunk_rows(spark.table("t_docs")).orderBy("doc_id", "pos").collect()]
    assert got == want and len(got) > 4
    pages = spark.sql("SELECT s.* FROM (SELECT '<article><p>a<h2>B</h2><p>c</article>' AS html) p, LATERAL page_sections(p.html, 'user') s ORDER BY ord").collect()
    assert [(r.heading, r.text) for r in pages] == [(None, "a"), ("B", "c")]
    calls = spark.sql("SELECT c.call FROM (SELECT '```python\nf(g(1))\n```' AS a) x, LATERAL calls_in(x.a) c ORDER BY pos").collect()
    assert [r.call for r in calls] == ["f", "g"]
    assert spark.sql("SELECT overlap('a b c', 'c d a') AS n").head().n == 2.0


def test_a_stream_prunes_as_finished_trials_do(spark, tmp_path):
    rng = random.Random(4)
    answers = [(t, at, rng.random() * (1 + t % 3)) for at in range(24) for t in range(7)]
    folder = str(tmp_path / "in")
    schema = "trial int, at int, value double"
    for lo in (0, 60, 100):  # three times something arrives, each time the stream goes on from its state
        part = answers[lo : {0: 60, 60: 100, 100: None}[lo]]
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(folder)
        stream = spark.readStream.schema(schema).parquet(folder)
        trials.start(stream, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    steps = spark.createDataFrame(answers, schema)
    want = E.prune(E.running_mean(steps, "trial", "at", "value"), first=5, interval=4)
    got = trials.decisions(spark, str(tmp_path / "out"), first=5, interval=4)
    key = lambda df: sorted(map(tuple, df.select("trial", "step", "best_so_far", "cut", "pruned").collect()))
    assert key(got) == key(want) and any(r[-1] for r in key(got))


CHUNKS = "file string, url string, section_id string, chunk_position string, content string"


def chunks(spark, page, n, mark):
    return spark.createDataFrame([(page, f"h/{page}", f"h/{page}#s", f"{i + 1}/{n}", f"{mark}{i}") for i in range(n)], CHUNKS)


def contents(df):
    return sorted((r.file, r.content) for r in df.collect())


def test_pages_are_replaced_and_removed(spark, tmp_path):
    path = f"file://{tmp_path}/c"
    assert snapshots.read(spark, path) is None
    assert snapshots.upsert(chunks(spark, "a", 3, "old").unionByName(chunks(spark, "b", 2, "b")), path) == 1
    assert snapshots.upsert(chunks(spark, "a", 1, "new"), path) == 2  # the page shrinks
    assert contents(snapshots.read(spark, path)) == [("a", "new0"), ("b", "b0"), ("b", "b1")]
    assert snapshots.upsert(chunks(spark, "c", 1, "c"), path, removed=spark.createDataFrame([("b",)], "file string")) == 3
    assert contents(snapshots.read(spark, path)) == [("a", "new0"), ("c", "c0")] and len(contents(snapshots.read(spark, path, 1))) == 5
    assert snapshots.compact(spark, path) == 4
    assert contents(snapshots.read(spark, path)) == [("a", "new0"), ("c", "c0")] and contents(snapshots.read(spark, path, 2))[0] == ("a", "new0")


def test_writers_at_once_lose_nothing(spark, tmp_path):
    path = f"file://{tmp_path}/c"
    done = []
    writers = [threading.Thread(target=lambda i=i: done.append(snapshots.upsert(chunks(spark, f"p{i}", 1, "x"), path))) for i in range(4)]
    for w in writers:
        w.start()
    for w in writers:
        w.join()
    assert sorted(done) == [1, 2, 3, 4] and len(contents(snapshots.read(spark, path))) == 4
    assert snapshots.versions(spark, path) == [1, 2, 3, 4]


def test_lock_of_a_writer_that_died(spark, tmp_path, monkeypatch):
    path = f"file://{tmp_path}/c"
    (tmp_path / "c" / "manifest.lock").mkdir(parents=True)
    with pytest.raises(RuntimeError):
        snapshots.upsert(chunks(spark, "a", 1, "x"), path, tries=2)
    monkeypatch.setattr(snapshots, "STALE", -1.0)
    assert snapshots.upsert(chunks(spark, "a", 1, "x"), path) == 1


def test_sketches_keep_their_error(spark):
    facts = spark.range(200_000).select((F.col("id") % 4).alias("run"), (F.col("id") % 3).alias("metric"), (F.col("id") * 7919 % 200_003).cast("double").alias("score"))
    parts = E.score_sketches(facts, "run", "metric")
    merged = {r.metric: r for r in E.sketched_quartiles(E.merged_sketches(parts, "metric")).collect()}
    for metric in range(3):
        scores = sorted(r.score for r in facts.filter(F.col("metric") == metric).collect())
        for i, p in enumerate((0.25, 0.5, 0.75)):
            at = sum(s <= merged[metric][f"q{i + 1}"] for s in scores) / len(scores)
            assert abs(at - p) <= E.RANK_ERROR
        assert merged[metric].n == len(scores)
    assert E.sketched_quartiles(E.score_sketches(facts.limit(0), "run")).count() == 0


def test_pages_as_a_stream_of_changes(spark, tmp_path):
    from quarry.streaming import ingest

    page = lambda words: f"<article><h1>T</h1><p>{words * 200}</p></article>"
    out = f"file://{tmp_path}/corpus"
    for rows in ([(1, "a.html", page("many words here ")), (2, "b.html", page("other words there "))], [(3, "a.html", page("one "))], [(4, "b.html", "<p>short</p>")]):
        spark.createDataFrame(rows, ingest.SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        ingest.start_snapshots(ingest.chunk_stream(spark, f"{tmp_path}/in"), out, f"{tmp_path}/cp").awaitTermination()
    assert snapshots.versions(spark, out) == [1, 2, 3]
    now = snapshots.read(spark, out).collect()
    assert {r.file for r in now} == {"a.html"} and all("many" not in r.content for r in now)
    assert {r.file for r in snapshots.read(spark, out, 1).collect()} == {"a.html", "b.html"}
