"""The operators of retrieval, extraction, grounding and evaluation on small tables of our own."""

import math

import pytest
from pyspark.sql import functions as F

from quarry.functions import columns as C
from quarry.operators import chunking, extraction, grounding
from quarry.operators import evaluation as E
from quarry.operators import retrieval as R
from quarry.operators.html_tree import parse
from quarry.plans import answers, config

CORPUS = "ord long, title string, content string, url string, section_id string, chunk_position string, chunk_id int, module string, doc_category string"


def corpus(spark, rows):
    return spark.createDataFrame([(i, t, c, u, s, p, n, m, k) for i, (t, c, u, s, p, n, m, k) in enumerate(rows)], CORPUS)


@pytest.fixture(scope="module")
def docs(spark):
    return corpus(
        spark,
        [
            ("Solver", "alpha beta gamma", "p1.html#a", "p1.html#a", "2/2", 1, "m1", "dev"),
            ("Solver", "alpha delta_x ns::name", "p1.html#a", "p1.html#a", "1/2", 0, "m1", "dev"),
            ("Mesh solver", "beta beta zeta", "p2.html#b", "p2.html#b", "1/1", 0, "m2", "user"),
            ("Mesh", "", "p3.html", "", None, None, "m2", "user"),
        ],
    )


def ask(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "query_id long, query string")


def value(spark, column):
    return spark.range(1).select(column.alias("v")).head()["v"]


def test_tokens(spark):
    assert value(spark, C.tokens(F.lit("Émile's ns::a_b 3x"))) == ["émile", "s", "ns", "a_b", "3x"]


def test_bm25_scores_and_ties(spark, docs):
    rows = R.bm25_search(docs, ask(spark, "beta beta", "nothing here"), 10).orderBy("rank").collect()
    n, avgdl = 4, (3 + 4 + 3 + 0) / 4  # delta_x, ns and name are words of the second
    idf = {t: math.log(n - d + 0.5) - math.log(d + 0.5) for t, d in {"alpha": 2, "beta": 2, "gamma": 1, "delta_x": 1, "ns": 1, "name": 1, "zeta": 1}.items()}
    part = lambda tf, dl: idf["beta"] * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))
    assert [(r.query_id, r.ord) for r in rows] == [(0, 0), (0, 2)]  # in half of all rows: weight 0, kept all the same
    assert [r.score for r in rows] == [round(2 * part(1, 3), 9), round(2 * part(2, 3), 9)] == [0.0, 0.0]


def test_bm25_filters_and_empty(spark, docs):
    assert [r.ord for r in R.bm25_search(docs, ask(spark, "alpha zeta"), 5, module="m2", category="All").collect()] == [2]
    assert R.bm25_search(docs.limit(0), ask(spark, "alpha"), 5).count() == 0


def test_titles_one_row_a_page(spark, docs):
    got = [(r.rank, r.ord) for r in R.title_search(docs, ask(spark, "solver"), 5).orderBy("rank").collect()]
    assert sorted(o for _, o in got) == [1, 2]


def test_fusion(spark):
    rows = [(0, 0, 0, 7, "a"), (0, 0, 1, 8, "b"), (0, 1, 0, 8, "b"), (0, 1, 1, 9, "c"), (0, 1, 2, 9, "c")]
    got = R.fuse(spark.createDataFrame(rows, "query_id long, channel int, rank int, ord long, key string"), ["key"]).orderBy("rank").collect()
    assert [(r.ord, r.score) for r in got] == [(8, round(1 / 62 + 1 / 61, 12)), (9, round(1 / 62 + 1 / 63, 12)), (7, round(1 / 61, 12))]


def test_copies_collapse(spark):
    rows = [(0, 0, 10, "x", None, False), (0, 1, 11, "y", "A", False), (0, 2, 12, "x", None, False), (0, 3, 13, "z", "A", True), (0, 4, 14, "q", "A", False)]
    got = R.collapse_copies(spark.createDataFrame(rows, "query_id long, rank int, ord long, content string, anchor_id string, declares boolean")).orderBy("rank").collect()
    assert [(r.ord, r.copies) for r in got] == [(10, 2), (13, 3)]


def test_budget_passes_over(spark):
    rows = [(0, i, i, c) for i, c in enumerate((50, 80, 30, 40, 5))]
    got = R.spend_budget(spark.createDataFrame(rows, "query_id long, rank int, ord long, cost long"), 100).orderBy("rank").collect()
    assert [r.spent for r in got] == [50, 0, 30, 0, 5]


def test_sections_are_rebuilt(spark):
    text = "T\n\n" + "".join(f"sentence {i}. " for i in range(60))
    parts = chunking.char_windows(text, 300, 100)
    rows = [("s", "T", p if i == 0 else f"T\n\n{p}", f"{i + 1}/{len(parts)}", 100 - i) for i, p in enumerate(parts)]
    got = R.rebuild(spark.createDataFrame(rows, "section_id string, title string, content string, chunk_position string, ord long")).head()
    assert got.text.replace(" ", "") == text.strip().replace(" ", "")


def test_chunks_cover_and_end():
    text = "word " * 500 + "end."
    parts = chunking.char_windows(text)
    assert all(len(p) <= 1000 for p in parts) and parts[-1].endswith("end.") and chunking.char_windows("  short ") == ["  short "]
    with pytest.raises(ValueError):
        chunking.char_windows(text, 250, 200)
    tokens = chunking.token_windows("a b c d e f g h", lambda t: t.split(), " ".join, 4, 2)
    assert tokens == ["a b c d", "c d e f", "e f g h"]


def test_scalar_functions(spark):
    path = lambda p: value(spark, C.is_generated(F.lit(p)))
    assert [path(p) for p in ("a/genindex.html", "my_genindex.html", "functions_x.html", "functions.htm", "dir_0a.html", "dir_xyz.html", "a/_modules/x.html", "a/my_modules/x.html", "b_source.html")] == [True, False, True, False, True, False, True, False, True]
    assert value(spark, C.section_id(F.lit("u"), F.lit("A b-Ç!"))) == "u#a_b_ç_" and value(spark, C.section_id(F.lit("u"), F.lit(None).cast("string"))) == "u#root"
    assert value(spark, C.qualified_name(F.lit("http://h/a/b.html?x#y"))) == "a/b.html" and value(spark, C.qualified_name(F.lit("b.html"))) == "b.html"
    assert value(spark, C.declaring_files(F.lit("My_C::run"))) == ["classMy__C.html", "structMy__C.html", "interfaceMy__C.html"]
    last = value(spark, C.declaring_files(F.lit("std::shared_ptr< Model_R > Model_F::last")))
    assert last[0] == "classModel__F.html" and value(spark, C.declaring_files(F.lit("plain"))) == []
    assert value(spark, C.declares(F.lit("x/structMy__C.html#a"), F.lit("My_C::~My_C "))) and not value(spark, C.declares(F.lit("classOther.html"), F.lit("My_C::run")))
    assert value(spark, C.strip(F.lit("\n\u00a0 a b\t\u2003"))) == "a b" and not value(spark, C.passes_gate(F.lit("w\n" * 20), F.lit("\n" * 20), min_score=0.0))
    assert [value(spark, C.duration(F.lit(s))) for s in (5, 65, 3725)] == ["5s", "1m05s", "1h02m05s"]
    assert value(spark, C.citation_base(F.create_map(F.lit("dev"), F.lit(""), F.lit("user"), F.lit("b/")), F.lit("dev"))) == "b/"
    tags = value(spark, C.tag_dimensions(F.array(*map(F.lit, ("howto", "Easy", "En", "m1", "m2")))))
    assert (tags.difficulty, tags.language, tags.type, tags.modules) == ("Easy", "En", "howto", ["m1", "m2"])
    assert value(spark, C.quality_score(F.lit(" \n "), F.lit("t"))) == 0.0 and value(spark, C.quality_score(F.lit("w " * 300), F.lit("t"))) == 1.0


DEV = """<html><head><title>x</title></head><body><div class="contents"><div class="textblock"><p>About the class.</p></div>
<table class="memberdecls"><tr class="heading"><td><h2>Public</h2></td></tr><tr class="memitem:a1"><td>void</td><td><a href="q.html#zz">T</a> <a href="c.html#a1">run</a> (int x)</td></tr><tr class="memdesc:a1"><td>Runs it.</td></tr>
<tr class="memitem:b2"><td>int</td><td><a href="c.html#b2">old</a> ()</td></tr></table>
<a id="a1"></a><div class="memitem"><div class="memproto"><table><tr><td class="memname">void C::run</td><td>(int x)</td></tr></table></div><div class="memdoc"><p>Runs the inherited thing.</p><pre>code_block_here()</pre></div></div>
<a id="b2"></a><div class="memitem"><div class="memproto"><span class="inherited">inherited</span><td class="memname">int B::old</td></div><div class="memdoc">Old.</div></div></div></body></html>"""


def test_symbols_and_summary():
    tree = parse(DEV)
    own = extraction.symbols(tree)
    assert [(s["anchor"], s["name"]) for s in own] == [("a1", "void C::run")]
    assert extraction.class_of(["void C::run", "D::a", "C::b"]) == "C"
    summary = extraction.class_summary(tree, {"a1"}, "C")
    assert summary == "About the class.\n\nPublic\nC::run  void T run (int x)  Runs it."
    assert extraction.class_summary(parse("<div class=textblock>About</div>"), set(), "C") == "" and extraction.has_symbols(tree) and not extraction.has_symbols(parse("<p>a"))
    chunks = extraction.page_chunks(DEV, "classC.html", "dev")
    assert [c["section"] for c in chunks] == ["__summary", "a1"] and [c["chunk_id"] for c in chunks] == [0, 1]
    assert chunks[1]["content"].endswith("Runs the inherited thing.\ncode_block_here()") and chunks[1]["code_blocks"] == ["code_block_here()"]
    kept = extraction.page_chunks("<article><h1>T</h1><p>" + "one two three. " * 200 + "</p></article>", "t.html", "user", encode=lambda t: t.split() * (10 if t.startswith("T") else 1))
    assert [(c["chunk_id"], c["pos"]) for c in kept][:2] == [(0, 2), (1, 3)]  # the first is too long and leaves a gap
    by_tokens = extraction.chunker(use_tokens=True, tokenizer=(str.split, " ".join), max_tokens=4, overlap_tokens=2)
    assert by_tokens("a b c d e f") == ["a b c d", "c d e f"] and extraction.chunker(use_tokens=True)("a b") == ["a b"]


def test_sections_titles_and_text():
    page = "<html><head><title>Tt</title><style>p{}</style></head><body><nav>menu</nav><div role=main><p>Before.<h2>One</h2><p>First <b>part</b><script>x()</script><h3>Two</h3><ul><li>a<li>b</ul></div><footer>f</footer></body></html>"
    tree = parse(page)
    assert extraction.split_sections(tree, "user") == [(None, "Before."), ("One", "First\npart"), ("Two", "a\nb")]
    assert extraction.page_title(tree, "x/y.html") == "Tt" and extraction.page_title(parse("<p>a"), "x/name.html#q") == "name"
    assert extraction.page_text(tree, "user", 10).endswith(extraction.CUT)
    assert extraction.markdown(parse("<h1>A</h1><p>x <i>y</i></p><ul><li>q</li></ul><pre>c\nd</pre>")) == "# A\n\nx *y*\n\n- q\n\n```\nc\nd\n```"
    assert extraction.page_chunks("", "e.html", "user") == [] or all(c["content"].strip() for c in extraction.page_chunks("", "e.html", "user"))


def test_pages_to_chunks(spark):
    rows = [(1, "a.html", "<article><h1>T</h1>" + "<p>" + "many words here " * 100 + "</p></article>"), (2, "b.html", "<p>short</p>"), (3, None, None)]
    got = extraction.chunks(spark.createDataFrame(rows, "page_id long, url string, html string")).orderBy("page_id", "chunk_id").collect()
    assert {r.page_id for r in got} == {1} and [r.chunk_id for r in got] == list(range(len(got))) and got[0].chunk_position.startswith("1/")


def test_grounding(spark):
    seen = "call foo(a, b) or foo\n(\na\n) and bar(x(1, 2))"
    answer = "```python\nfoo(1)\nbar(2)\nprint(3)\nmissing(4)\nmissing(5)\n```"
    assert [(c, k) for c, k, _ in grounding.check(answer, seen)] == [("foo", "ambiguous_overload"), ("missing", "unknown_name")]
    assert grounding.check("just prose about things", seen) == [] and grounding.check("```cpp\nif (x) baz(1);\n```", seen)[0][0] == "baz"
    assert grounding.check(answer, seen, known=lambda n: True)[0][0] == "foo"
    assert grounding.arities("f", "f() f ( ) f(a,(b,c)) f(a, b") == [0, 2] and grounding.arities("f", "F(a, b) f([1, 2])") == [2]
    assert grounding.check('```cpp\nprintf("x"); assert(y); while (a) cout(1);\n```', "") == []

    def failing(name):
        raise RuntimeError

    assert grounding.check("```cpp\nbaz(1);\n```", "", known=failing)[0][1] == "unknown_name"
    rows = spark.createDataFrame([(1, answer, seen), (2, None, None)], "id long, answer string, observations string")
    assert grounding.flags(rows, ["id"]).count() == 2


def test_judge_replies(spark):
    raw = ['{"explanation": "a", "score": 7}', 'x ```json\n{"explanation": "b", "score": "3"}\n```', '{"explanation": no quote", "score": 5}', "prose", '{"explanation": "c", "score": "bad"}', '{"explanation": "z", "score": 0}']
    df = spark.createDataFrame([(i, r) for i, r in enumerate(raw)], "i int, raw string")
    got = [r.g for r in df.select("i", E.grade(E.parse_reply(F.col("raw"))).alias("g")).orderBy("i").collect()]
    assert [(g.score, g.is_error) for g in got] == [(7.0, False), (3.0, False), (5.0, False), (0.0, True), (0.0, True), (0.0, False)]


def test_evaluation(spark):
    facts = spark.createDataFrame([(0, "rag", 1, "a", 4.0, 1.0), (0, "rag", 1, "b", None, 1.0), (1, "rag", 1, "a", 4.0, 3.0), (1, "rag", 1, "b", 0.0, 3.0), (2, "no-rag", 1, "a", 9.0, 2.0)], "run int, mode string, question_id int, metric string, score double, request_time double")
    assert {r.run: r.overall for r in E.overall(facts, "run").collect()} == {0: 2.0, 1: 2.0, 2: 9.0}
    best = E.best_and_worst(facts).head()
    assert (best.best_run, best.worst_run) == (2, 0)
    modes = {(r["mode"], r.metric): r.mean_score for r in E.mode_comparison(facts).collect()}
    assert modes[("no-rag", "b")] == 0.0
    ends = E.extremes(E.overall(facts, "run"), "run")
    assert ends.count() == 6
    trials = spark.createDataFrame([(0, "COMPLETE", 1.0), (1, "FAIL", None), (2, "PRUNED", 9.0), (1500, "COMPLETE", 3.0), (1501, "COMPLETE", 2.0)], "number long, state string, value double")
    assert [r.best for r in E.best_so_far(trials).orderBy("number").collect()] == [1.0, 1.0, 3.0, 3.0]
    assert E.validation(spark.createDataFrame([(1, 5.0)], "trial int, value double")).head().sd == 0.0


def test_settings(tmp_path):
    assert config.build(config.Settings, {"_note": 1, "k_standard": 10, "agentic": None}).agentic is None
    assert config.Settings(k_retrieve=80).depth() == (80, 40) and config.Settings(k_retrieve=80).depth(deep_dive=True) == (60, 60)
    for bad in ({"nope": 1}, {"project_name": "a b"}):
        with pytest.raises(ValueError):
            config.build(config.Settings, bad)
    assert config.set_dotted({"a": {"b": 1}}, "a.c", 2) == {"a": {"b": 1, "c": 2}}
    assert config.config_hash({"a": 1, "b": 2, "_c": 3}) == config.config_hash({"b": 2, "a": 1}) and len(config.config_hash({})) == 12
    assert config.combinations({"a": [1, 2], "b": [3]}) == [{"a": 1, "b": 3}, {"a": 2, "b": 3}] and config.combinations({}) == [{}]
    space = {"k_standard": {"type": "int", "low": 1, "high": 3}, "temperature": {"type": "float", "low": 0, "high": 1}}
    config.check_space(space, {"hyde_enabled": True})
    assert config.sample_space(space, {"hyde_enabled": True}, 2, 1) == config.sample_space(space, {"hyde_enabled": True}, 2, 1)
    for bad in ({"k_standard": {"type": "int", "low": 3, "high": 1}}, {"zzz": {"type": "bool"}}, {"k_standard": {"type": "odd"}}):
        with pytest.raises(ValueError):
            config.check_space(bad, {})


def test_rounding_like_the_exact_value(spark):
    values = [0.125, 0.375, 1.005, 2.675, 0.615, 0.285, 0.0, 1.0, 0.999, 0.995, *[i / 997 for i in range(200)]]
    got = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double").select("i", C.round2(F.col("v")).alias("r")).orderBy("i").collect()
    assert [r.r for r in got] == [round(v, 2) for v in values]


def test_pruning_looks_at_other_trials(spark):
    rows = [(t, s, float(t)) for t in range(5) for s in range(1, 23)] + [(9, 23, 1.0)]
    got = E.prune(spark.createDataFrame(rows, "trial int, step int, mean_so_far double"), first=10, interval=5).collect()
    assert {r.step for r in got} == {10, 15, 20, 23}
    at = {r.trial: (r.cut, r.pruned) for r in got if r.step == 10}
    # of the others 0, 1, 2, 3 the 75th percentile is 2.25; of 1, 2, 3, 4 it is 3.25
    assert at[4] == (2.25, False) and at[0] == (3.25, True) and at[3] == (2.5, False)
    assert [(r.cut, r.pruned) for r in got if r.step == 23] == [(None, False)]


def test_trials_schema_and_cache(spark, tmp_path):
    from typing import Annotated, TypedDict

    from quarry.sources import files

    space = {"mode": {"choices": ["rag", "agentic"]}, "rag": {"k": {"type": "int", "low": 2, "high": 8, "step": 3}}, "agentic": {"k": {"type": "int", "low": 100, "high": 100}}, "model": {"t": {"type": "float", "low": 0.01, "high": 1, "log": True}}}
    trials = config.sample_trials(space, {"rag": {"f": 1}}, 30, 3)
    assert trials == config.sample_trials(space, {"rag": {"f": 1}}, 30, 3) and {t["mode"] for t in trials} == {"rag", "agentic"}
    for t in trials:
        assert t["params"].keys() == ({"k", "t", "f"} if t["mode"] == "rag" else {"k", "t"}) and t["extraction"] is None
        assert t["params"]["k"] in ((2, 5, 8) if t["mode"] == "rag" else (100,)) and f"{t['mode']}__k" in t["names"] and 0.01 <= t["params"]["t"] <= 1

    class Grade(TypedDict):
        score: Annotated[float, ..., "from 0 to 10"]
        explanation: str

    schema = config.json_schema(Grade, "grade")["schema"]
    assert schema["properties"] == {"score": {"type": "number", "description": "from 0 to 10"}, "explanation": {"type": "string"}} and schema["required"] == ["score", "explanation"]
    made = []
    for settings in ({"a": 1}, {"a": 1, "_b": 2}, {"a": 2}):
        assert files.built_once(spark, f"{tmp_path}/cache", settings, lambda: made.append(1) or spark.range(3)).count() == 3
    assert len(made) == 2


def test_evaluation_of_answers(spark):
    rows = [({"a": 4.0, "b": None}, 1.0, 3, None), ({"a": 2.0}, 3.0, None, None)]
    got = E.summary(spark.createDataFrame(rows, "scores map<string,double>, request_time double, steps int, tokens long")).head()
    assert (got.examples, got.mean_s, got.mean_steps, got.mean_tokens, got.averages, got.overall) == (2, 2.0, 3.0, None, {"a": 3.0, "b": 0.0}, 1.5)
    asked = spark.createDataFrame([(1, "q", "x", "r", ["d"]), (2, "q", "x", "r", None)], "question_id int, question string, answer string, reference string, documents array<string>")

    def judge(question, answer, reference, documents):
        return {"score": "8", "explanation": None}

    graded = {(r.question_id, r.metric): (r.score, r.explanation) for r in E.run_metrics(asked, {"groundedness": judge, "relevance": lambda *a: {"score": 11}, "correctness": lambda *a: 1 / 0}).collect()}
    assert graded[1, "groundedness"] == (8.0, "") and graded[2, "groundedness"] == (0.0, "no documents") and graded[1, "relevance"][0] == 0.0
    assert graded[1, "correctness"][1].startswith("error: ") and graded[1, "retrieval_relevance"][1].startswith("unknown metric")
    assert {r.metric for r in E.run_metrics(asked, {"relevance": judge}, ("relevance",)).collect()} == {"relevance"}


def test_answers(spark, docs):
    q = ask(spark, "zeta mesh", "gamma")
    got = {r.query_id: r for r in answers.answer(docs, q, config.Settings(), generate=lambda queries, contexts: [f"{len(c)}" for c in contexts]).collect()}
    assert got[1].error is None and "p1.html" in got[1].sources and int(got[1].answer) == got[1].context_chars
    assert answers.answer(docs, q, config.Settings(), module="none").collect()[0].error == "unknown module: none"
    index = spark.createDataFrame([("x/p1.html", "p1.html")], "filepath string, filename string")
    assert {r.filepath for r in answers.search_pages(docs, index, q, 5).collect()} == {"x/p1.html"}
    assert answers.search_pages(docs, index, q, 5, exclude=["x/p1.html"]).count() == 0
    dive = answers.deep_dive(docs, answers.retrieve(docs, q, config.Settings()), q, lambda queries, texts: [f"{a}:{len(t)}" for a, t in zip(queries, texts)], size=1)
    assert {r.query_id: r.summary for r in dive.collect()}[1].count("gamma:") == 1


def section_corpus(spark, pages):
    """A corpus from ``{section_id: [texts of its fragments]}`` in that order."""
    rows, n = [], 0
    for section, parts in pages.items():
        for i, text in enumerate(parts):
            rows.append((n, "T", text, section, section, f"{i + 1}/{len(parts)}", i, "m", "user", f"short {n}"))
            n += 1
    return spark.createDataFrame(rows, CORPUS + ", section_text string")


def test_expansion_takes_short_pages_once_and_sections_of_long_ones(spark):
    c = section_corpus(spark, {"a.html#1": ["one"], "a.html#2": ["two"], "b.html#1": ["x" * 900], "b.html#2": ["y" * 300], "c.html#1": ["z" * 700]})
    pool = spark.createDataFrame([(0, r, o) for r, o in enumerate((1, 0, 2, 3, 4))], "query_id long, rank int, ord long")
    rows = answers.expand_pages(c, pool, max_page=1000, char_budget=1020, top_n=4).orderBy("rank").collect()
    # page a once; b is long: its first section fits, the second doesn't; c is short and doesn't fit either
    assert [(r.ord, r.took) for r in rows] == [(1, "page"), (2, "section"), (3, "capped"), (4, "capped")]
    assert rows[0].text == "one\n\ntwo" and rows[1].text == "x" * 900 and rows[2].text == "short 3"
    bare = answers.expand_pages(c.drop("section_text"), pool, max_page=1000, char_budget=1020, top_n=4).orderBy("rank").collect()
    assert [(r.ord, r.took) for r in bare] == [(1, "page"), (2, "section"), (3, "chunk")]  # a page that doesn't fit is left out
    assert answers.expand_pages(c, pool, top_n=1).count() == 1


def test_context_prefers_the_declaring_page(spark):
    rows = [(0, "sub.html#a1", "My_C::run"), (1, "classMy__C.html#a1", "My_C::run"), (2, "sub2.html#a1", "My_C::run"), (3, "page.html", "")]
    made = [(o, "t", f"text {o}", u, f"s{o}", "1/1", 0, "m", "dev", "a1" if "#" in u else "", h) for o, u, h in rows]
    c = spark.createDataFrame(made, CORPUS + ", anchor_id string, hierarchy string")
    pool = spark.createDataFrame([(0, r, r) for r in range(4)], "query_id long, rank int, ord long")
    assert [(r.rank, r.ord) for r in answers.representatives(c, pool).orderBy("rank").collect()] == [(0, 1), (1, 3)]
    q = ask(spark, "which")
    worst_first = answers.representatives(c, pool, questions=q, scorer=lambda queries, texts: [int(t[-1]) for t in texts]).orderBy("rank").collect()
    assert [r.ord for r in worst_first] == [3, 1]


def test_page_search_by_sections_and_rerank(spark):
    c = section_corpus(spark, {"d/a.html#1": ["alpha beta"], "d/a.html#2": ["alpha"], "d/b.html#1": ["alpha gamma gamma"], "d/x.html#1": ["nothing here at all"]})
    index = spark.createDataFrame([(f"root/d/{n}.html", f"{n}.html", n, "m", "user") for n in "abx"], "filepath string, filename string, title string, module string, doc_category string")
    q = ask(spark, "beta gamma")
    pages = answers.search_pages(c, index, q, 5).orderBy("rank").collect()
    assert {r.filepath for r in pages} == {"root/d/a.html", "root/d/b.html"}
    best = answers.search_pages(c, index, q, 5, scorer=lambda queries, texts: [float("beta" in t) for t in texts]).orderBy("rank").collect()
    assert best[0].filepath == "root/d/a.html"
    found = answers.search_pages(c, index, q, 5, by_section=True)
    text = answers.listing(found, index).head().listing
    assert text.startswith("[1] ") and "a.html | a | m/user\nalpha beta\n\nalpha" in text and text.count("[") == 2


def test_models_are_batched_and_may_fail(spark, docs):
    q = ask(spark, "one", "two")

    def broken(texts):
        raise RuntimeError

    assert [r.query for r in answers.rewritten(q, broken).orderBy("query_id").collect()] == ["one", "two"]
    assert [r.query for r in answers.rewritten(q, lambda texts: [t.upper() for t in texts]).orderBy("query_id").collect()] == ["ONE", "TWO"]
    vectors = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [0.6, 0.8])], "ord long, embedding array<float>")
    settings = config.Settings(bm25_enabled=False, hyde_enabled=True, k_standard=1)
    pool = answers.retrieve(docs, q, settings, vectors=vectors, embed=lambda texts: [[1.0, 0.0] if t == "ONE" else [0.0, 1.0] for t in texts], rewrite=lambda texts: [t.upper() for t in texts])
    assert [(r.query_id, r.ord) for r in pool.orderBy("query_id").collect()] == [(0, 0), (1, 1)]
    assert answers.stages(settings, deep_dive=True, has_scorer=True)["bypassed_by_deep_dive"] == ["reranker"]
    assert answers.stages(config.Settings(), has_rewrite=True) == {"reranker": False, "hyde": False, "bm25": True, "title_boost": True}


def test_dense_search_is_exact(spark):
    import numpy as np

    v = np.random.default_rng(0).normal(size=(60, 5))
    v[7] = v[3]
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)] + [(60, None), (61, [0.0] * 5), (62, [1.0])], "ord long, embedding array<double>")
    asked = df.filter("ord < 4").withColumnsRenamed({"ord": "query_id", "embedding": "q_vec"})
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    want = [(q, r, int(o)) for q in range(4) for r, o in enumerate(np.lexsort((np.arange(60), -np.round(u @ u[q], 9)))[:5])]
    assert [(r.query_id, r.rank, r.ord) for r in R.dense_search(df, asked, 5).orderBy("query_id", "rank").collect()] == want


def test_prompt_and_emitted(spark):
    import json

    assert value(spark, answers.prompt(F.lit("Q?"), F.lit("ctx"), "docs", ["m"])).endswith("Documentation:\nctx\n\nQuestion: Q?\n\nAnswer:")
    rows = [(1, "a", None, None, [("t", "long", "short", "secret")]), (2, None, "bad", {"k": "v"}, None)]
    df = spark.createDataFrame(rows, "query_id long, answer string, error string, filters map<string,string>, sources array<struct<title:string,full_content:string,content:string,private:string>>")
    got = [json.loads(r.json) for r in answers.emitted(df).orderBy("query_id").collect()]
    assert got[0]["sources"] == [{"title": "t", "module": None, "doc_category": None, "doc_type": None, "url": None, "content": "long"}] and got[0]["filters"] == {}
    assert got[1] == {"answer": None, "error": "bad", "filters": {"k": "v"}, "sources": []}


def test_files_and_stream(spark, tmp_path):
    from quarry.sources import files
    from quarry.streaming import ingest

    (tmp_path / "html" / "a").mkdir(parents=True)
    (tmp_path / "html" / "a" / "x.html").write_bytes(b"<p>ok \xff</p>")
    (tmp_path / "html" / "genindex.html").write_text("<p>no</p>")
    assert [(r.url, r.html) for r in files.html_pages(spark, f"file://{tmp_path}/html").collect()] == [("a/x.html", "<p>ok </p>")]
    (tmp_path / "c.jsonl").write_text('{"title":"t","content":"c","metadata":{"section_id":"s"}}\n\n{"title":"u","content":null}\n')
    flat = files.flat(files.chunks(spark, f"file://{tmp_path}/c.jsonl")).orderBy("ord").collect()
    (tmp_path / "many").mkdir()
    for name in ("b", "a", "c"):
        (tmp_path / "many" / f"{name}.jsonl").write_text("".join(f'{{"title":"{name}{i:03d}"}}\n\n' for i in range(30 if name == "a" else 7)))
    many = files.chunks(spark, f"file://{tmp_path}/many").orderBy("ord").collect()
    assert [r.ord for r in many] == list(range(44)) and [r.title for r in many] == sorted(r.title for r in many)
    index = spark.createDataFrame([("x/a.html", "a.html", "A", "m", "dev")], files.PAGE_INDEX)
    files.write_page_index(index, f"{tmp_path}/pages.json")
    assert files.page_index(spark, f"file://{tmp_path}/pages.json").drop("ord").collect() == index.collect()
    (tmp_path / "list.json").write_text('[{"filepath": "p", "filename": "q"}]')
    assert files.page_index(spark, f"file://{tmp_path}/list.json").head().filepath == "p"
    (tmp_path / "bad.json").write_text("[{")
    for path, error in (("none.json", FileNotFoundError), ("bad.json", ValueError)):
        with pytest.raises(error):
            files.page_index(spark, f"file://{tmp_path}/{path}")
    said = [("r", "2024_1", "q", {"k": "v"}, i, "ai", f"m{i}", None, None, (1, 2) if i else None) for i in range(3)]
    messages = spark.createDataFrame(said, "run string, timestamp string, question string, metadata map<string,string>, index int, role string, content string, tool_calls array<struct<name:string,args:string>>, tool_name string, usage struct<input_tokens:long,output_tokens:long>")
    files.write_traces(files.serialised(messages), f"{tmp_path}/traces")
    trace = files.traces(spark, f"file://{tmp_path}/traces").collect()
    assert len(trace) == 1 and trace[0].total_tokens == 6 and [m.content for m in trace[0].messages] == ["m0", "m1", "m2"]
    corpus_ = spark.createDataFrame([(0, "c", "m"), (1_000_000, "d", "m")], "ord long, content string, module string")
    files.write_vector_index(corpus_, f"{tmp_path}/vectors", lambda texts: [[1.0] for _ in texts])
    assert sorted(r.id for r in spark.read.parquet(f"{tmp_path}/vectors").collect()) == ["000000", "1000000"]
    assert "bench_1.json" in files.write_results(index, str(tmp_path), "bench", "1")
    roots = [{"module": "m", "doc_category": c, "path": f"file://{tmp_path}/html", "base_url": "http://h/"} for c in ("user", "dev")]
    (tmp_path / "html" / "a" / "y.html").write_text("<article><h1>T</h1><p>" + "many words here " * 100 + "</p></article>")
    built = extraction.build_corpus(spark, roots).orderBy("ord").collect()
    assert [r.doc_category for r in built] == sorted((r.doc_category for r in built), key=extraction.CATEGORIES.index) and built[0].url == "http://h/a/y.html" and built[0].section_id == "http://h/a/y.html#root"
    assert [(r.title, r.content, r.section_id, r.has_code, r.anchor_id) for r in flat] == [("t", "c", "s", False, None), ("u", "", "", False, None)]
    page = spark.createDataFrame([(1, "a.html", "<article><h1>T</h1><p>" + "many words here " * 100 + "</p></article>")], "page_id long, url string, html string")
    page.write.parquet(f"{tmp_path}/in")
    ingest.start(ingest.chunk_stream(spark, f"{tmp_path}/in"), f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination()
    assert ingest.current(spark, f"{tmp_path}/out").count() > 0
