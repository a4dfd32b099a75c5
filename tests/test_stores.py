"""What is stored and read again: indexes, positions, JSON files, built corpora, and a corpus that goes from pages to answers."""

import json
import random
import threading
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.operators import evaluation as E
from quarry.operators import extraction, keyword_index, vector_index
from quarry.operators import retrieval as R
from quarry.operators.best import Best
from quarry.plans import answers, config
from quarry.sources import files, store

WORDS = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(200)]
CORPUS = "ord long, title string, content string, url string, section_id string, chunk_position string, chunk_id int, module string, doc_category string"


def text(rng, n):
    return " ".join(WORDS[min(int(rng.expovariate(0.03)), 199)] for _ in range(n))


@pytest.fixture(scope="module")
def library(spark):
    rng = random.Random(8)
    rows = [(i, text(rng, rng.randint(1, 3)), text(rng, rng.randint(0, 60)) if i % 17 else None, f"p{i // 3}.html#{i % 3}" if i % 11 else "", "s", f"{3 - i % 3}/3", i % 3, f"m{i % 3}", "dev" if i % 2 else "user") for i in range(900)]
    rows += [(5000 + i, "hot", " ".join(WORDS[:40]) + " rare", f"h{i}.html", "s", "1/1", 0, "m0", "dev") for i in range(40)]
    return spark.createDataFrame(rows, CORPUS).repartition(5).cache()


@pytest.fixture(scope="module")
def asked(spark):
    rng = random.Random(1)
    return spark.createDataFrame([(i, text(rng, rng.randint(1, 6))) for i in range(12)] + [(20, "rare waa waa"), (21, "unheardof"), (22, ""), (23, None)], "query_id long, query string")


def rows_of(df):
    return sorted((r.query_id, r["rank"], r.ord, r.score) for r in df.collect())


def indexed(spark, corpus, path, column="content", **options):
    keyword_index.write_index(corpus, str(path), column, **options)
    return keyword_index.open_index(spark, str(path))


def test_index_finds_what_a_scan_finds(spark, library, asked, tmp_path):
    index = indexed(spark, library, tmp_path / "i", buckets=8, width=16)
    titles = indexed(spark, library, tmp_path / "t", "title", buckets=3, width=64)
    for k in (1, 7, 2000):
        assert rows_of(keyword_index.search(index, asked, k)) == rows_of(R.bm25_search(library, asked, k))
    for options in ({"module": "m1"}, {"module": "m0", "category": "dev"}, {"category": "All"}):
        assert rows_of(R.bm25_search(library, asked, 5, index=index, **options)) == rows_of(R.bm25_search(library, asked, 5, **options))
    assert rows_of(R.title_search(library, asked, 6, index=titles)) == rows_of(R.title_search(library, asked, 6))
    assert {(r.term, r.df, round(r.idf, 9)) for r in index.terms.collect()} == {(r.term, r.df, round(r.idf, 9)) for r in R.idf_table(library).collect()}
    weights, blocks = keyword_index._weights(index, asked.filter("query_id = 20"))
    scorer, _ = keyword_index.scorer_of(index, weights, 2)
    met = blocks.join(weights.select("term"), "term", "left_semi").select("range", F.lit(1).alias("kind"), "term", "top", "ords", "tfs", "dls").orderBy(F.col("range").desc(), "term")
    keyword_index._ranges(met.toArrow().to_batches(), scorer, False)
    assert scorer.visited < scorer.there // 2  # blocks are passed over
    assert index.rows == 940 and index.blocks.filter("n > 16").count() == 0


def test_index_reads_no_texts_and_only_its_folders(spark, library, asked, tmp_path):
    library.write.parquet(str(tmp_path / "c"))
    corpus = spark.read.parquet(str(tmp_path / "c"))
    index = indexed(spark, corpus, tmp_path / "i", buckets=64)
    plan = R.bm25_search(corpus, asked.filter("query_id = 20"), 3, module="m0", index=index)._jdf.queryExecution().toString()
    physical = plan.split("== Physical Plan ==")[1]
    assert "content" not in physical and "PartitionFilters: [" in physical and "bucket" in physical


def test_index_of_nothing(spark, library, asked, tmp_path):
    index = indexed(spark, library.limit(0), tmp_path / "e")
    assert keyword_index.search(index, asked, 3).count() == 0 and index.rows == 0


def test_pool_from_indexes_is_the_same(spark, library, asked, tmp_path):
    q = asked.filter("query_id < 4")
    stores = {"texts": indexed(spark, library, tmp_path / "a"), "titles": indexed(spark, library, tmp_path / "b", "title")}
    settings = config.Settings(title_boost_enabled=True)
    key = lambda df: sorted(map(tuple, df.select("query_id", "rank", "ord").collect()))
    assert key(answers.retrieve(library, q, settings, **stores)) == key(answers.retrieve(library, q, settings))


def test_vector_cells(spark, tmp_path):
    rng = np.random.default_rng(2)
    centre = rng.normal(size=(12, 16)) * 3
    v = centre[rng.integers(0, 12, 1500)] + rng.normal(size=(1500, 16))
    rows = [(i, x.tolist(), i % 4) for i, x in enumerate(v)] + [(9000, None, 1), (9001, [0.0] * 16, 1), (9002, [1.0], 1)]
    df = spark.createDataFrame(rows, "ord long, embedding array<double>, label int")
    q = df.filter("ord % 50 = 0").select(F.col("ord").alias("query_id"), F.col("embedding").alias("q_vec"))
    vector_index.write_index(df, str(tmp_path / "v"), cells=24, keep=("label",))
    index = vector_index.open_index(spark, str(tmp_path / "v"))
    exact = rows_of(R.dense_search(df, q, 8))
    assert rows_of(vector_index.search(index, q, 8)) == exact and index.rows.count() == 1500
    assert rows_of(vector_index.search(index, q, 8, allowed=F.col("label") == 2)) == rows_of(R.dense_search(df, q, 8, F.col("label") == 2))
    few = vector_index.search(index, q, 8, probes=4)
    found = {(a, c) for a, _, c, _ in rows_of(few)}
    assert len(found & {(a, c) for a, _, c, _ in exact}) >= 0.9 * len(exact)
    one = vector_index.search(index, q.limit(1), 8, probes=2)
    assert "PartitionFilters: [cell#" in one._jdf.queryExecution().executedPlan().toString()  # the other cells' files aren't read
    vector_index.write_index(df.limit(0), str(tmp_path / "n"))
    assert vector_index.search(vector_index.open_index(spark, str(tmp_path / "n")), q, 3).count() == 0


def test_best_of_a_task():
    rng = np.random.default_rng(0)
    scores = rng.integers(0, 6, size=(300, 90)).astype(float)
    scores[5] = np.inf
    best = Best(300, 4)
    for lo in range(0, 90, 25):
        best.add(np.arange(300), scores[:, lo : lo + 25], np.arange(lo, min(lo + 25, 90)))
    want = [(q, int(o)) for q in range(300) if q != 5 for o in np.lexsort((np.arange(90), scores[q]))[:4]]
    assert list(zip(best.q.tolist(), best.ord.tolist(), strict=True)) == want


def test_max_sim_by_blocks(spark):
    rng = np.random.default_rng(5)
    q = [(a, i, rng.normal(size=4).tolist()) for a in (1, 2) for i in range(3)]
    d = [(f"d{i % 7}", rng.normal(size=4).tolist()) for i in range(60)]
    asked, docs = spark.createDataFrame(q, "query_id int, q_pos int, q_vec array<double>"), spark.createDataFrame(d, "doc_id string, d_vec array<double>")
    got = {(r.query_id, r.doc_id): r.score for r in R.max_sim(asked, docs).collect()}
    want = {(a, n): sum(max(float(np.dot(x, y)) for m, y in d if m == n) for b, _, x in q if b == a) for a in (1, 2) for n in {m for m, _ in d}}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-8 for k in want)
    own = docs.withColumn("query_id", F.lit(1))
    assert {(r.query_id, r.doc_id): r.score for r in R.max_sim(asked, own).collect()} == {k: v for k, v in got.items() if k[0] == 1}


def test_positions_are_dense(spark):
    df = spark.range(0, 1000, 1, 7).select((F.col("id") * 7919 % 1000).alias("a"), F.lit(1).alias("n"))
    got = store.with_positions(df, "a").collect()
    assert sorted((r.ord, r.a) for r in got) == [(i, i) for i in range(1000)]
    assert store.with_positions(df.limit(0), "a").count() == 0


def overlapped(parts):
    """The rule for fragments from its definition."""
    acc = ""
    for title, content in parts:
        body = content or ""
        if acc and body.startswith(f"{title}\n\n"):
            body = body[len(title) + 2 :]
        size = next((n for n in range(min(500, len(acc), len(body)), 0, -1) if acc.endswith(body[:n])), 0)
        acc += body[size:]
    return acc


def test_fragments_are_joined_in_linear_time(spark):
    rng = random.Random(3)
    for _ in range(300):
        parts = [("T", rng.choice(["", "T\n\n"]) + "".join(rng.choice("ab") for _ in range(rng.randint(0, 12)))) for _ in range(rng.randint(1, 6))]
        assert R.joined(parts) == overlapped(parts)
    long = [("T", "a" * 700), ("T", "a" * 900), ("T", None), (None, "x" * 600 + "a" * 450), ("T", "a" * 450 + "b")]
    assert R.joined(long) == overlapped(long)
    began = time.time()
    text = R.joined([("T", f"{i:09d} " * 100) for i in range(20_000)])
    assert len(text) == 20_000_000 and time.time() - began < 20  # the whole text is looked at once
    rows = [("s", "T", c, f"{i + 1}/3", 10 - i) for i, c in enumerate(("one two", "T\n\ntwo three", "three four"))]
    got = R.rebuild(spark.createDataFrame(rows, "section_id string, title string, content string, chunk_position string, ord long")).head()
    assert (got.text, got.ord) == ("one two three four", 8)


PRETTY = [{"filepath": f"a/{i}.html", "filename": f"{i}.html", "title": 'br[ack]ets "quoted" \\ {' + str(i), "module": "m", "doc_category": "dev"} for i in range(300)]


@pytest.mark.parametrize("dump", [lambda x: json.dumps(x, indent=2), lambda x: json.dumps(x), lambda x: "[\n" + ",\n".join(json.dumps(e) for e in x) + "\n]\n", lambda x: "\n\n".join(json.dumps(e) for e in x), lambda x: json.dumps(x, indent=1).replace("[\n {", "[{").replace("}\n]", "}]")])
def test_json_lists_are_split(spark, tmp_path, dump):
    (tmp_path / "list.json").write_text(dump(PRETTY))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        got = files.page_index(spark, f"file://{tmp_path}/list.json").orderBy("ord").collect()
        several = spark.read.text(f"file://{tmp_path}/list.json").rdd.getNumPartitions()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert [(r.filepath, r.title, r.ord) for r in got] == [(p["filepath"], p["title"], i) for i, p in enumerate(PRETTY)] and several > 1


def test_questions_are_numbered_and_limited_before_they_are_shuffled(spark, tmp_path):
    (tmp_path / "q.json").write_text(json.dumps([{"inputs": {"question": f"q{i}"}, "outputs": {"answer": f"a{i}"}, "tags": ["easy"] if i % 2 else None} for i in range(30)], indent=2))
    path = f"file://{tmp_path}/q.json"
    assert [(r.question_id, r.inputs.question, r.place) for r in files.questions(spark, path, 3).orderBy("place").collect()] == [(i + 1, f"q{i}", i) for i in range(3)]
    mixed = files.questions(spark, path, 10, seed=5).orderBy("place").collect()
    assert {r.question_id for r in mixed} == set(range(1, 11)) and [r.question_id for r in mixed] != list(range(1, 11)) and [r.place for r in mixed] == list(range(10))
    assert [r.question_id for r in files.questions(spark, path, 10, seed=5).orderBy("place").collect()] == [r.question_id for r in mixed]
    made = spark.createDataFrame([(r.question_id, "x") for r in mixed[:5]], "question_id long, answer string")
    assert [r.question_id for r in E.in_dataset_order(made, files.questions(spark, path, 10, seed=5)).collect()] == [r.question_id for r in mixed]


FACTS = "run int, mode string, configuration map<string,string>, question_id int, question string, tags array<string>, metric string, score double, explanation string, request_time double"


def test_results_round_trip(spark, tmp_path):
    facts = [(r, "rag", {"k": str(r)} if r else {}, q, f"question {q}", ["easy", "howto", "m1"], m, float(q + r) if q else None, 'said "so"\n', 0.5 * q) for r in range(3) for q in range(5) for m in ("correctness", "relevance")]
    df = spark.createDataFrame(facts, FACTS)
    folder = f"file://{tmp_path}/runs"
    assert files.latest(spark, folder, "benchmark_") is None
    for stamp in ("2024", "2025"):
        files.write_results(files.runs_of(df), folder, "benchmark", stamp, "run")
    path = files.latest(spark, folder, "benchmark_")
    assert path.endswith("benchmark_2025.json") and [p[-9:-5] for p in files.listed(spark, folder, "benchmark_")] == ["2025", "2024"]
    whole = json.loads((tmp_path / "runs" / "benchmark_2025.json").read_text())
    assert whole["metadata"] == {"timestamp": "2025", "total_questions": 5} and [len(r["questions"]) for r in whole["results"]] == [5, 5, 5]
    got = sorted((r.run, r.config, r.question_id, tuple(r.tags), r.metric, r.score, r.explanation, r.request_time) for r in files.run_facts(spark, path).fillna(-1.0, "score").collect())
    assert got == sorted((r, f"k={r}" if r else "default", q, tuple(t), m, -1.0 if s is None else s, x, time) for r, _, _, q, _, t, m, s, x, time in facts)
    table = files.compare(spark, folder).orderBy("file", "run").collect()
    assert [(r.file, r.timestamp, r.run, r.config, r.overall) for r in table][:2] == [("benchmark_2024.json", "2024", 0, "default", 2.0), ("benchmark_2024.json", "2024", 1, "k=1", 2.8)] and len(table) == 6
    tags = {(r.dimension, r.label) for r in E.by_tags(files.run_facts(spark, path)).collect()}
    assert tags == {("difficulty", "easy"), ("language", "unspecified"), ("type", "howto"), ("module", "m1")}
    files.write_results(files.runs_of(df.limit(0)), folder, "benchmark", "2026")
    assert json.loads((tmp_path / "runs" / "benchmark_2026.json").read_text())["results"] == []


def test_statistics_are_one_file(spark, tmp_path):
    chunks = spark.createDataFrame([("a", "dev"), ("a", "user"), ("b", "other")], "module string, doc_category string")
    known = spark.createDataFrame([("a", "first"), ("c", None)], "module string, description string")
    for _ in range(2):  # the second takes the place of the first
        files.write_statistics(E.module_statistics(chunks, known), f"file://{tmp_path}/statistics.json")
    got = json.loads((tmp_path / "statistics.json").read_text())
    assert got == {"total_chunks": 3, "modules": {"a": {"total_chunks": 2, "dev_chunks": 1, "user_chunks": 1, "methodology_chunks": 0, "description": "first"}, "c": {"total_chunks": 0, "dev_chunks": 0, "user_chunks": 0, "methodology_chunks": 0, "description": ""}}}


def test_two_builders_build_once(spark, tmp_path):
    made, out = [], []

    def build():
        made.append(1)
        time.sleep(2)
        return spark.range(4)

    builders = [threading.Thread(target=lambda: out.append(files.built_once(spark, f"file://{tmp_path}/c", {"a": 1}, build).count())) for _ in range(3)]
    for b in builders:
        b.start()
    for b in builders:
        b.join()
    assert made == [1] and out == [4, 4, 4]
    with pytest.raises(ZeroDivisionError):
        files.built_once(spark, f"file://{tmp_path}/c", {"a": 2}, lambda: 1 / 0)
    assert files.built_once(spark, f"file://{tmp_path}/c", {"a": 2}, build).count() == 4  # a failed builder leaves no lock


def test_from_pages_to_answers(spark, tmp_path):
    """Folders of pages become a corpus, vectors, indexes, and answers, each from what the step before wrote."""
    for kind, topic in (("user", "mesh"), ("dev", "solver")):
        for i in range(3):
            (tmp_path / kind).mkdir(exist_ok=True)
            (tmp_path / kind / f"{topic}{i}.html").write_text(f"<article><h1>{topic} page {i}</h1>" + "".join(f"<h2>Part {j}</h2><p>{f'{topic} part{j} number{i} ' * 60}</p>" for j in range(3)) + "</article>")
    roots = [{"module": "M", "doc_category": c, "path": f"file://{tmp_path}/{c}", "base_url": "http://h/"} for c in ("user", "dev")]
    built = extraction.build_corpus(spark, roots)
    files.write_corpus(built, f"file://{tmp_path}/corpus")
    corpus = spark.read.parquet(f"file://{tmp_path}/corpus/chunks.parquet")
    rows = corpus.orderBy("ord").collect()
    assert [r.ord for r in rows] == list(range(len(rows))) and [r.doc_category for r in rows] == sorted((r.doc_category for r in rows), key=extraction.CATEGORIES.index)

    def embed(texts):
        return [[t.count("mesh") + 0.1, t.count("solver") + 0.1, t.count("part1") + 0.1] for t in texts]

    files.write_vector_index(corpus, f"file://{tmp_path}/vectors", embed)
    vectors = spark.read.parquet(f"file://{tmp_path}/vectors").select("ord", "embedding")
    texts = indexed(spark, corpus, f"file://{tmp_path}/texts")
    q = spark.createDataFrame([(1, "mesh part1 number2"), (2, "solver part2")], "query_id long, query string")
    got = {r.query_id: r for r in answers.answer(corpus, q, config.Settings(), vectors=vectors, embed=embed, texts=texts, generate=lambda queries, contexts: [c[:40] for c in contexts]).collect()}
    vector_index.write_index(corpus.select("ord").join(spark.read.parquet(f"file://{tmp_path}/vectors").select("ord", "embedding", "module", "doc_category"), "ord"), f"file://{tmp_path}/cells", cells=4, keep=("module", "doc_category"))
    cells = vector_index.open_index(spark, f"file://{tmp_path}/cells")
    pool = lambda **how: sorted(map(tuple, answers.retrieve(corpus, q, config.Settings(), embed=embed, texts=texts, **how).select("query_id", "rank", "ord").collect()))
    assert pool(cells=cells) == pool(vectors=vectors) and pool(cells=cells, category="dev") == pool(vectors=vectors, category="dev")
    assert "mesh2.html" in got[1].sources and json.loads(got[2].sources)[0]["url"].startswith("http://h/solver") and got[1].answer and got[1].error is None


def test_last_and_first_page_of_a_name(spark):
    index = spark.createDataFrame([("z/d/a.html", "a.html", 0), ("b/d/a.html", "a.html", 1), ("c/e/a.html", "a.html", 2)], "filepath string, filename string, ord long")
    rows = spark.createDataFrame([(1, "http://h/d/a.html#x"), (2, "http://h/q/a.html"), (3, "http://h/e/a.html"), (4, "none.html")], "id int, url string")
    assert {r.id: r.filepath for r in answers.page_of(rows, index).collect()} == {1: "b/d/a.html", 2: "z/d/a.html", 3: "c/e/a.html"}


def test_titles_of_rows_without_an_address(spark):
    rows = [(0, "Same", "x", "", "s", "1/1", 0, "m", "dev", "f1"), (1, "Same", "x", None, "s", "1/1", 0, "m", "dev", "f2"), (2, "Same", "x", "", "s", "2/2", 1, "m", "dev", "f1"), (3, "Other", "x", "u", "s", "1/1", 0, "m", "dev", "f3")]
    c = spark.createDataFrame(rows, CORPUS + ", file string")
    q = spark.createDataFrame([(0, "same")], "query_id long, query string")
    assert sorted(r.ord for r in R.title_search(c, q, 5).collect()) == [0, 1]


def test_judges_get_batches_and_replies_fall_back_to_their_text(spark):
    calls = []

    @E.batched
    def judge(questions, answers_, references, documents):
        calls.append(len(questions))
        if "bad" in questions:
            raise RuntimeError("down")
        return [{"score": len(a), "explanation": q} for q, a in zip(questions, answers_, strict=True)]

    rows = spark.createDataFrame([(i, f"q{i}", "a" * i, "r", ["d"] if i % 2 else None) for i in range(6)], "question_id int, question string, answer string, reference string, documents array<string>")
    got = {(r.question_id, r.metric): (r.score, r.explanation) for r in E.run_metrics(rows, {"relevance": judge, "groundedness": judge}, ("relevance", "groundedness")).collect()}
    assert got[3, "relevance"] == (3.0, "q3") and got[2, "groundedness"] == (0.0, "no documents") and got[5, "groundedness"] == (5.0, "q5")
    bad = E.run_metrics(rows.withColumn("question", F.lit("bad")), {"relevance": judge}, ("relevance",)).collect()
    assert {(r.score, r.explanation) for r in bad} == {(0.0, "error: down")}
    replies = spark.createDataFrame([('{"score": 3, "explanation": "x"}',), ("only words",)], "raw string").select(E.parse_reply(F.col("raw")).alias("r")).collect()
    assert [(r.r.score, r.r.content) for r in replies] == [("3", None), (None, "only words")]


def test_labels_and_lengths(spark):
    from quarry.functions import columns as C

    entries = F.array(F.struct(F.lit("b").alias("k"), F.lit("2").alias("v")), F.struct(F.lit("a").alias("k"), F.lit("1").alias("v")))
    got = spark.range(1).select(C.config_label(entries).alias("a"), C.config_label(F.slice(entries, 1, 0)).alias("b")).head()
    assert (got.a, got.b) == ("b=2, a=1", "default")
    assert extraction.short_enough("a b c", str.split, 3) and not extraction.short_enough("a b c d", str.split, 3) and extraction.short_enough("x " * 999, None)


def test_sections_of_a_stored_corpus_are_not_moved(spark, library, tmp_path):
    spark.sql("CREATE DATABASE IF NOT EXISTS shelves LOCATION '" + str(tmp_path / "shelves") + "'")
    sectioned = library.withColumn("section_id", F.when(F.col("ord") % 13 == 0, F.lit("")).otherwise(F.concat(F.lit("s"), (F.col("ord") % 120).cast("string"))))
    table = files.write_sections(sectioned, "shelves.sections", 8)
    pool = spark.createDataFrame([(q, r, q * 40 + r) for q in range(3) for r in range(20)], "query_id long, rank int, ord long")
    settings = config.Settings(top_n_after_rerank=9, expansion_char_budget=3000)
    key = lambda df: sorted(map(tuple, df.select("query_id", "rank", "ord", "content").collect()))
    assert key(answers.select_context(table, pool, settings)) == key(answers.select_context(sectioned, pool, settings))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        met = answers._sections(table, sectioned.filter("ord < 50").select("section_id"))
        rebuilt = R.rebuild(met, "section_key")
        lines = rebuilt._jdf.queryExecution().executedPlan().toString().split("\n")
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    scan = next(i for i, x in enumerate(lines) if "Scan parquet" in x and "shelves.sections" in x)
    above, depth = [], lines[scan].index("- ") if "- " in lines[scan] else 0
    for x in reversed(lines[:scan]):
        at = x.index("- ") if "- " in x else 0
        if at < depth:
            above.append(x)
            depth = at
    assert not [x for x in above if "Exchange" in x], "\n".join(lines)
