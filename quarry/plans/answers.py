"""The way of a batch of questions from channels to context and sources.

Models are plug-ins that get batches: ``rewrite`` may replace the texts for the vector channel, ``embed`` makes their vectors, ``scorer`` scores
pairs of question and text, ``summarise`` shortens lots of texts, ``generate`` makes answers. Without them the plan is relational from end to end.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.columns import declares, preview, qualified_name, strip
from quarry.operators import retrieval as R
from quarry.operators import vector_index
from quarry.operators.keyword_index import KeywordIndex
from quarry.operators.vector_index import VectorIndex
from quarry.plans.config import Settings
from quarry.sources.store import stored

Texts = Callable[[list[str]], list[str]]
Scorer = Callable[[list[str], list[str]], list[float]]


def _batched(rows: DataFrame, column: str, made: str, kind: str, run_one: Callable[[pa.RecordBatch], list]) -> DataFrame:
    """``rows`` with a column that a function makes of whole batches; ``column`` is dropped."""
    kept = [c for c in rows.columns if c != column]
    types = {"string": pa.string(), "array<float>": pa.list_(pa.float32())}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([*(b[c] for c in kept), pa.array(run_one(b), types[kind])], [*kept, made])

    schema = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in kept)
    return rows.mapInArrow(run, f"{schema}, {made} {kind}")


def rewritten(questions: DataFrame, rewrite: Texts) -> DataFrame:
    """``query_id, query`` with the texts that a model makes of the questions; where it fails, a batch keeps its questions."""

    def one(b: pa.RecordBatch) -> list[str]:
        asked = [x or "" for x in b["asked"].to_pylist()]
        try:
            return [new or old for new, old in zip(rewrite(asked), asked, strict=True)]
        except Exception:  # a model behind a network
            return asked

    return _batched(questions.select("query_id", F.col("query").alias("asked")), "asked", "query", "string", one)


def stages(settings: Settings, *, deep_dive: bool = False, reranker: bool = True, hyde: bool = True, bm25: bool = True, title_boost: bool = True, has_scorer: bool = False, has_rewrite: bool = False) -> dict:
    """Which stages run; in a deep dive, which of those that would have run it passes over."""
    want = {"reranker": reranker and has_scorer, "hyde": hyde and settings.hyde_enabled and has_rewrite, "bm25": bm25 and settings.bm25_enabled, "title_boost": title_boost and settings.title_boost_enabled and settings.bm25_enabled}
    out: dict = {k: v and not deep_dive for k, v in want.items()}
    if deep_dive and any(want.values()):
        out["bypassed_by_deep_dive"] = [k for k, v in want.items() if v]
    return out


def embedded(questions: DataFrame, embed: Callable[[list[str]], list[list[float]]]) -> DataFrame:
    """``query_id, q_vec`` of the questions' texts."""
    return _batched(questions.select("query_id", "query"), "query", "q_vec", "array<float>", lambda b: embed([x or "" for x in b["query"].to_pylist()]))


def retrieve(
    corpus: DataFrame, questions: DataFrame, settings: Settings, *, dense: DataFrame | None = None, vectors: DataFrame | None = None,
    embed: Callable[[list[str]], list[list[float]]] | None = None, rewrite: Texts | None = None, deep_dive: bool = False, module: str | None = None, category: str | None = None,
    texts: KeywordIndex | None = None, titles: KeywordIndex | None = None, cells: VectorIndex | None = None, probes: int | None = None,
) -> DataFrame:
    """``query_id, rank, ord``: the fused pool of the channels that are switched on; a single channel is left as it is.

    ``dense`` is the vector channel's ranked list, if there is one, or it is made from ``vectors(ord, embedding)`` with the ``embed`` model,
    for the text that ``rewrite`` makes of the question where that is switched on. Keywords always are the question's own; with stored indexes
    of ``texts`` and ``titles`` the corpus's texts aren't read for them. ``cells`` is a stored index of the vectors, with ``module`` and ``doc_category`` among its columns, of which
    each question reads the nearest ``probes``, or all.
    """
    depth, pool = settings.depth(deep_dive=deep_dive)
    if dense is None and embed is not None and (vectors is not None or cells is not None):
        asked = rewritten(questions, rewrite) if rewrite is not None and settings.hyde_enabled and not deep_dive else questions
        if cells is not None:
            dense = vector_index.search(cells, embedded(asked, embed), depth, probes=probes, allowed=R.equal_filters(module, category))
        else:
            allowed = corpus.filter(R.equal_filters(module, category)).select("ord")
            dense = R.dense_search(vectors.join(allowed, "ord", "left_semi"), embedded(asked, embed), depth)
    lists = [] if dense is None else [dense.filter(F.col("rank") < depth)]
    if (settings.bm25_enabled and not (deep_dive and lists)) or dense is None:
        lists.append(R.bm25_search(corpus, questions, depth, module=module, category=category, index=texts))
        if settings.title_boost_enabled:
            lists.append(R.title_search(corpus, questions, 10, module=module, category=category, index=titles))
    if len(lists) == 1:
        return lists[0].select("query_id", "rank", "ord").filter(F.col("rank") < pool)
    return fused(corpus, lists, pool)


def fused(corpus: DataFrame, lists: list[DataFrame], k: int | None = None) -> DataFrame:
    """``query_id, rank, ord``: ranked lists of chunks, fused by their address, section and place."""
    union = None
    for i, one in enumerate(lists):
        part = one.select("query_id", F.lit(i).alias("channel"), "rank", "ord")
        union = part if union is None else union.unionByName(part)
    keyed = union.join(corpus.select("ord", "url", "section_id", "chunk_position"), "ord")
    return R.fuse(keyed, ["url", "section_id", "chunk_position"], k).select("query_id", "rank", "ord")


def _field(corpus: DataFrame, name: str) -> Column:
    """A column that a corpus may lack, empty there."""
    return F.coalesce(F.col(name), F.lit("")).alias(name) if name in corpus.columns else F.lit("").alias(name)


def representatives(corpus: DataFrame, pool: DataFrame, *, questions: DataFrame | None = None, scorer: Scorer | None = None) -> DataFrame:
    """``query_id, rank, ord, section_id``: copies of a symbol collapsed (the one on its declaring page stands for all), reranked or not, one row a section."""
    pool = stored(pool.select("query_id", "rank", "ord"), "pool")
    rows = pool.join(corpus.select("ord", "content", _field(corpus, "anchor_id"), _field(corpus, "hierarchy"), _field(corpus, "url")), "ord")
    one = R.collapse_copies(rows.withColumn("declares", declares(F.col("url"), F.col("hierarchy")))).select("query_id", "rank", "ord")
    if scorer is not None and questions is not None:
        one = R.rerank(one, corpus, questions, scorer).select("query_id", "rank", "ord")
    one = R.first_of(one.join(corpus.select("ord", "section_id"), "ord"), "section_id")
    place = Window.partitionBy("query_id").orderBy("rank")
    return one.withColumn("rank", (F.row_number().over(place) - 1).cast("int")).select("query_id", "rank", "ord", "section_id")


def _sections(corpus: DataFrame, one: DataFrame) -> DataFrame:
    """The rows of the corpus in the sections of ``one``; a corpus stored by :func:`quarry.sources.files.write_sections` isn't moved for that."""
    wanted = one.filter(F.coalesce("section_id", F.lit("")) != "").select(F.col("section_id").alias("w_section")).distinct()
    key = "section_key" if "section_key" in corpus.columns else "section_id"
    return corpus.join(wanted, F.col(key) == F.col("w_section"), "left_semi")


def select_context(corpus: DataFrame, pool: DataFrame, settings: Settings, *, questions: DataFrame | None = None, scorer: Scorer | None = None) -> DataFrame:
    """``query_id, rank, ord, content``: the first representatives, each its whole section where the budget lasts, else the corpus's ``section_text`` or the chunk.

    Only sections of the representatives are put together. The representatives are written before they meet the corpus, so that Spark knows
    their size, and sends them to the corpus where they are few.
    """
    one = stored(representatives(corpus, pool, questions=questions, scorer=scorer).filter(F.col("rank") < settings.top_n_after_rerank), "representatives")
    met = _sections(corpus, one)
    sections = R.rebuild(met, "section_key" if "section_key" in corpus.columns else "section_id").toDF("section_id", "s_ord", "section").drop("s_ord")
    full = one.join(sections, "section_id", "left").join(corpus.select("ord", "content", _field(corpus, "section_text")), "ord")
    known = F.coalesce(F.nullif("section_id", F.lit("")).isNotNull() & (F.coalesce("section", F.lit("")) != ""), F.lit(False))
    full = full.withColumns({"full": F.when(known, F.length("section")), "capped": F.length("section_text")})
    spent = _spend(full, settings.expansion_char_budget)
    text = F.when(F.col("took") == "full", F.col("section")).when(F.col("took") == "capped", F.col("section_text")).otherwise(F.col("content"))
    return full.join(spent, ["query_id", "ord"]).select("query_id", "rank", "ord", text.alias("content"))


def _spend(rows: DataFrame, budget: int) -> DataFrame:
    """``query_id, ord, took`` of ``(query_id, rank, ord, full, capped)``: in order of rank, the whole section if it fits what is left, else the capped text, which may overdraw it, else nothing."""
    out = "array<struct<ord:bigint,took:string>>"
    start = F.struct(F.lit(budget).cast("long").alias("left"), F.array().cast(out).alias("out"))

    def step(acc: Column, x: Column) -> Column:
        took = F.when(x["full"] <= acc["left"], "full").when(x["capped"] > 0, "capped").otherwise("chunk")
        cost = F.when(took == "full", x["full"]).when(took == "capped", x["capped"]).otherwise(0)
        return F.struct((acc["left"] - cost).cast("long").alias("left"), F.concat(acc["out"], F.array(F.struct(x["ord"].cast("long").alias("ord"), took.alias("took")))).alias("out"))

    items = F.array_sort(F.collect_list(F.struct("rank", "ord", F.col("full").cast("long").alias("full"), F.col("capped").cast("long").alias("capped"))))
    folded = rows.groupBy("query_id").agg(items.alias("items"))
    return folded.select("query_id", F.explode(F.aggregate("items", start, step)["out"]).alias("o")).select("query_id", "o.ord", "o.took")


def expand_pages(corpus: DataFrame, pool: DataFrame, *, top_n: int = 5, char_budget: int = 15000, max_page: int = 8000, questions: DataFrame | None = None, scorer: Scorer | None = None) -> DataFrame:
    """``query_id, rank, ord, section_id, page, took, text``: of each representative its whole page if that is short, else its section, until there are ``top_n``.

    A short page is taken once, and where it doesn't fit the rest of the budget the corpus's ``section_text`` stands for it, or nothing. A section that
    doesn't fit is replaced by ``section_text``, or by the chunk at no cost.
    """
    one = representatives(corpus, pool, questions=questions, scorer=scorer).withColumn("page", F.substring_index(F.coalesce("section_id", F.lit("")), "#", 1))
    wanted = one.filter("page <> ''").select("page").distinct()
    met = corpus.withColumn("page", F.substring_index(F.coalesce("section_id", F.lit("")), "#", 1)).join(wanted, "page", "left_semi").drop("page")
    whole = R.rebuild_pages(met).withColumnRenamed("text", "page_text")
    sections = R.rebuild(met).select("section_id", F.col("text").alias("section"))
    rows = one.join(whole, "page", "left").join(sections, "section_id", "left").join(corpus.select("ord", "content", _field(corpus, "section_text")), "ord")
    size = lambda c: F.coalesce(F.length(c), F.lit(0)).cast("long")
    items = F.array_sort(F.collect_list(F.struct("rank", F.col("ord").cast("long").alias("ord"), "page", size("page_text").alias("whole"), size("section").alias("full"), size("section_text").alias("capped"))))
    out = "array<struct<rank:int,ord:bigint,took:string>>"
    start = F.struct(F.lit(char_budget).cast("long").alias("left"), F.array().cast("array<string>").alias("seen"), F.array().cast(out).alias("out"))

    def step(acc: Column, x: Column) -> Column:
        open_ = F.size(acc["out"]) < top_n
        short = (x["whole"] > 0) & (x["whole"] <= max_page)
        again = short & F.array_contains(acc["seen"], x["page"])
        from_page = F.when(x["whole"] <= acc["left"], "page").when(x["capped"] > 0, "capped")
        from_section = F.when((x["full"] > 0) & (x["full"] <= acc["left"]), "section").when(x["capped"] > 0, "capped").otherwise("chunk")
        took = F.when(open_ & ~again, F.when(short, from_page).otherwise(from_section))
        cost = F.coalesce(F.when(took == "page", x["whole"]).when(took == "section", x["full"]).when(took == "capped", x["capped"]), F.lit(0))
        item = F.array(F.struct(x["rank"].cast("int").alias("rank"), x["ord"].alias("ord"), took.alias("took")))
        return F.struct(
            (acc["left"] - cost).cast("long").alias("left"),
            F.when(open_ & short, F.array_union(acc["seen"], F.array(x["page"]))).otherwise(acc["seen"]).alias("seen"),
            F.when(took.isNotNull(), F.concat(acc["out"], item.cast(out))).otherwise(acc["out"]).alias("out"),
        )

    folded = rows.groupBy("query_id").agg(items.alias("items"))
    taken = folded.select("query_id", F.explode(F.aggregate("items", start, step)["out"]).alias("o")).select("query_id", "o.ord", "o.took")
    text = F.when(F.col("took") == "page", F.col("page_text")).when(F.col("took") == "section", F.col("section")).when(F.col("took") == "capped", F.col("section_text")).otherwise(F.col("content"))
    return rows.join(taken, ["query_id", "ord"]).select("query_id", "rank", "ord", "section_id", "page", "took", text.alias("text"))


def page_of(rows: DataFrame, page_index: DataFrame) -> DataFrame:
    """``rows`` with ``filepath`` of the page that their ``url`` is on, by the last two parts of the address, else by the bare name; rows of no known page go.

    Of pages with the same two parts the last row of the index counts, of those with the same name the first: in the order of its column ``ord``, or of its
    paths where it has none. The index has a row for each page, a small share of the chunks; Spark broadcasts it where its size allows.
    """
    at = F.col("ord") if "ord" in page_index.columns else F.col("filepath")
    index = page_index.select("filepath", qualified_name(F.col("filepath")).alias("full"), F.col("filename").alias("bare"), F.struct(at, F.col("filepath")).alias("at"))
    full = index.groupBy("full").agg(F.max_by("filepath", "at").alias("p1"))
    bare = index.groupBy("bare").agg(F.min_by("filepath", "at").alias("p2"))
    met = rows.withColumn("full", qualified_name(F.col("url"))).withColumn("bare", F.substring_index("full", "/", -1))
    met = met.join(full, "full", "left").join(bare, "bare", "left").withColumn("filepath", F.coalesce("p1", "p2"))
    return met.filter(F.col("filepath").isNotNull()).drop("full", "bare", "p1", "p2")


def search_pages(
    corpus: DataFrame, page_index: DataFrame, questions: DataFrame, k: int = 50, *, dense: DataFrame | None = None, title_boost: bool = False,
    exclude: list[str] | None = None, scorer: Scorer | None = None, by_section: bool = False, top_n: int = 5, char_budget: int = 15000,
    texts: KeywordIndex | None = None, titles: KeywordIndex | None = None,
) -> DataFrame:
    """``query_id, rank, filepath`` of the ``k`` best pages, by all channels four times as deep, fused whole, copies of symbols collapsed.

    A page stands where its first chunk does, or by the score of that chunk. With ``by_section`` the results are ``top_n`` expanded
    sections, at most one for each page, with ``section_id`` and ``section_text``. ``texts`` and ``titles`` may be stored keyword indexes.
    """
    deep = 4 * k
    lists = [] if dense is None else [dense.filter(F.col("rank") < deep)]
    lists.append(R.bm25_search(corpus, questions, deep, index=texts))
    if title_boost:
        lists.append(R.title_search(corpus, questions, deep, index=titles))
    pool = lists[0].select("query_id", "rank", "ord") if len(lists) == 1 else fused(corpus, lists)
    # written first, so that Spark knows that it is small, and sends it to the corpus rather than texts to it
    pool = stored(pool.select("query_id", "rank", "ord"), "pool")
    if by_section:
        found = expand_pages(corpus, pool, top_n=top_n, char_budget=char_budget, questions=questions, scorer=scorer).withColumnRenamed("text", "section_text")
    else:
        rows = pool.join(corpus.select("ord", "content", _field(corpus, "anchor_id"), _field(corpus, "hierarchy"), _field(corpus, "url")), "ord")
        found = R.collapse_copies(rows.withColumn("declares", declares(F.col("url"), F.col("hierarchy"))))
    found = page_of(found.join(corpus.select("ord", _field(corpus, "url")), "ord"), page_index)
    if exclude:
        found = found.filter(~F.col("filepath").isin(*exclude))
    found = R.first_of(found, "filepath")
    place = Window.partitionBy("query_id").orderBy("rank", "ord")
    found = found.withColumn("rank", F.row_number().over(place) - 1)
    if by_section:
        return found.select("query_id", "rank", "filepath", "section_id", "section_text")
    found = found.filter(F.col("rank") < k)
    if scorer is not None:
        scored = R.rerank(found, corpus, questions, scorer)
        found = scored.join(found.select("query_id", "ord", "filepath"), ["query_id", "ord"])
    return found.select("query_id", "rank", "filepath")


def listing(found: DataFrame, page_index: DataFrame) -> DataFrame:
    """``query_id, listing``: sections found, numbered, each with its page's name, title, module and category above its text."""
    rows = found.join(page_index.select("filepath", "filename", "title", "module", "doc_category"), "filepath")
    item = F.concat(F.lit("["), (F.col("rank") + 1).cast("string"), F.lit("] "), F.col("filename"), F.lit(" | "), F.col("title"), F.lit(" | "), F.col("module"), F.lit("/"), F.col("doc_category"), F.lit("\n"), F.coalesce("section_text", F.lit("")))
    items = F.transform(F.array_sort(F.collect_list(F.struct("rank", item.alias("item")))), lambda x: x["item"])
    return rows.groupBy("query_id").agg(F.array_join(items, "\n\n").alias("listing"))


def new_sections(found: DataFrame) -> DataFrame:
    """Of sections found at several steps, ``(query_id, step, rank, filepath, section_id, ...)``, the first time that each is; a section without an id is its page."""
    key = F.coalesce(F.nullif("section_id", F.lit("")), F.col("filepath"))
    at = Window.partitionBy("query_id", "key").orderBy("step", "rank")
    return found.withColumn("key", key).withColumn("at", F.row_number().over(at)).filter("at = 1").drop("key", "at")


def merge_sources(read: DataFrame, sections: DataFrame) -> DataFrame:
    """``query_id, place, filepath, content``: pages read, then sections found, each page once, in the order in which they came.

    From ``read(query_id, seq, filepath, content)`` and ``sections(query_id, seq, filepath, section_text)``.
    """
    both = read.select("query_id", F.lit(0).alias("kind"), "seq", "filepath", F.coalesce("content", F.lit("")).alias("content"))
    both = both.unionByName(sections.select("query_id", F.lit(1).alias("kind"), "seq", "filepath", F.coalesce("section_text", F.lit("")).alias("content")))
    first = both.groupBy("query_id", "filepath").agg(F.min_by("content", F.struct("kind", "seq")).alias("content"), F.min(F.struct("kind", "seq")).alias("at"))
    place = Window.partitionBy("query_id").orderBy("at")
    return first.select("query_id", (F.row_number().over(place) - 1).alias("place"), "filepath", "content")


def prompt(question: Column, context: Column | None, project: str, modules: list[str]) -> Column:
    """The text for a model: what to rest on, the modules, the context and the question; without a context, the question with a warning."""
    if context is None:
        rules = f"You know the documentation of {project}. Answer from what you have learned. Say so if you are not sure, and decline what is about something else."
        return F.concat(F.lit(f"{rules}\n\nQuestion: "), question, F.lit("\n\nAnswer:"))
    listed = "\n".join(f"- {m}" for m in modules)
    rules = f"You answer questions about {project}. Its modules:\n{listed}\n\nRest on the documentation below and on nothing else; say which module and kind of page you cite; say so if it does not hold the answer; decline what is about something else."
    return F.concat(F.lit(f"{rules}\n\nDocumentation:\n"), F.coalesce(context, F.lit("")), F.lit("\n\nQuestion: "), question, F.lit("\n\nAnswer:"))


def deep_dive(corpus: DataFrame, pool: DataFrame, questions: DataFrame, summarise: Scorer, size: int = 10) -> DataFrame:
    """``query_id, summary``: the pool in lots of ``size``, a summary of each for the question (from lists of questions and of joined texts), put together."""
    lot = F.floor(F.col("rank") / size).cast("int").alias("lot")
    rows = pool.join(corpus.select("ord", "content"), "ord").select("query_id", lot, "rank", "content")
    texts = F.transform(F.array_sort(F.collect_list(F.struct("rank", "content"))), lambda x: x["content"])
    lots = rows.groupBy("query_id", "lot").agg(F.array_join(texts, "\n\n").alias("text")).join(questions.select("query_id", "query"), "query_id")
    made = _batched(lots, "text", "summary", "string", lambda b: summarise([x or "" for x in b["query"].to_pylist()], [x or "" for x in b["text"].to_pylist()]))
    parts = F.transform(F.array_sort(F.collect_list(F.struct("lot", "summary"))), lambda x: x["summary"])
    return made.groupBy("query_id").agg(strip(F.array_join(parts, "\n\n")).alias("summary"))


#: What of a source goes into an answer's JSON.
SOURCE_KEYS = ("title", "module", "doc_category", "doc_type", "url")


def emitted(answers: DataFrame) -> DataFrame:
    """``query_id, json`` from ``(query_id, answer, error, filters, sources array<struct<...>>)``: the keys that may be shown and no others; ``full_content`` goes before ``content``."""
    kind = {f.name for f in answers.schema["sources"].dataType.elementType.fields}

    def shown(x: Column) -> Column:
        full = F.nullif(x["full_content"], F.lit("")) if "full_content" in kind else F.lit(None).cast("string")
        own = [(x[c] if c in kind else F.lit(None).cast("string")).alias(c) for c in SOURCE_KEYS]
        return F.struct(*own, F.coalesce(full, x["content"] if "content" in kind else F.lit(None)).alias("content"))

    sources = F.coalesce(F.transform("sources", shown), F.transform(F.array().cast(answers.schema["sources"].dataType), shown))
    out = F.struct("answer", "error", F.coalesce("filters", F.create_map().cast("map<string,string>")).alias("filters"), sources.alias("sources"))
    return answers.select("query_id", F.to_json(out, {"ignoreNullFields": "false"}).alias("json"))


def answer(corpus: DataFrame, questions: DataFrame, settings: Settings, *, generate: Callable[[list[str], list[str]], list[str]] | None = None, scorer: Scorer | None = None, module: str | None = None, category: str | None = None, **channels) -> DataFrame:
    """``query_id, answer, context_chars, sources, error`` for each question; without ``generate`` (of lists of questions and contexts) the answer is null.

    A module that the corpus doesn't have is an error in the row, not an exception.
    """
    known = module is None or module.lower() == "all" or not corpus.filter(F.col("module") == module).isEmpty()
    if not known:
        return questions.select("query_id", F.lit(None).cast("string").alias("answer"), F.lit(0).alias("context_chars"), F.lit(None).cast("string").alias("sources"), F.lit(f"unknown module: {module}").alias("error"))
    pool = retrieve(corpus, questions, settings, module=module, category=category, **channels)
    chosen = select_context(corpus, pool, settings, questions=questions, scorer=scorer)
    cited = chosen.join(corpus.select("ord", "title", "url", "module", "doc_category"), "ord")
    items = F.array_sort(F.collect_list(F.struct("rank", "title", "module", "doc_category", "url", preview(F.col("content")).alias("content"))))
    out = questions.join(R.assemble(chosen), "query_id", "left").join(cited.groupBy("query_id").agg(F.to_json(items).alias("sources")), "query_id", "left")
    out = out.select("query_id", "query", F.coalesce("context", F.lit("")).alias("context"), F.coalesce("context_chars", F.lit(0)).alias("context_chars"), "sources", F.lit(None).cast("string").alias("error"))
    if generate is None:
        out = out.withColumn("answer", F.lit(None).cast("string"))
    else:
        out = _batched(out.withColumn("unused", F.lit(0)), "unused", "answer", "string", lambda b: generate(b["query"].to_pylist(), b["context"].to_pylist()))
    return out.select("query_id", "answer", "context_chars", "sources", "error")
