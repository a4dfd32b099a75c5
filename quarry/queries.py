"""Queries over the driver's tables, one for each operator, and the same in DuckDB's SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.functions import columns as C
from quarry.functions import sql
from quarry.operators import chunking, extraction, grounding
from quarry.operators import evaluation as E
from quarry.operators import keyword_index, vector_index
from quarry.operators import retrieval as R
from quarry.plans import answers as A
from quarry.plans.config import Settings
from quarry.sources import files
from quarry.sources import store
from quarry.sources import tables as T
from quarry.streaming import trials

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name, with its SQL if there is any."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


TOK = r"regexp_extract_all(lower(coalesce({0}, '')), '[\p{{L}}\p{{N}}_]+')"
CORPUS = """corpus AS (
  SELECT doc_id AS ord, split_part(coalesce(text, ''), chr(10), 1) AS title, text AS content,
         'docs/p' || (doc_id // 5)::VARCHAR || '.html#s' || ((doc_id % 5) // 2)::VARCHAR AS url,
         'docs/p' || (doc_id // 5)::VARCHAR || '.html#s' || ((doc_id % 5) // 2)::VARCHAR AS section_id,
         5 - doc_id % 5 AS pos, doc_id % 5 AS chunk_id, source AS module, lang AS doc_category
  FROM documents)"""
ASKED = f"""asked AS (SELECT query_id, term, count(*) AS qtf FROM (SELECT item_id AS query_id, unnest({TOK.format("text")}) AS term FROM benchmark) GROUP BY ALL)"""


def bm25_sql(field: str, name: str) -> str:
    return f"""
{name}_words AS (SELECT ord, {TOK.format(field)} AS w FROM corpus),
{name}_df AS (SELECT term, count(DISTINCT ord) AS df FROM (SELECT ord, unnest(w) AS term FROM {name}_words) GROUP BY term),
{name}_n AS (SELECT count(*) AS n, avg(len(w)) AS avgdl FROM {name}_words),
{name}_idf0 AS (SELECT term, df, ln(n - df + 0.5) - ln(df + 0.5) AS idf0 FROM {name}_df, {name}_n),
{name}_idf AS (SELECT term, df, CASE WHEN idf0 >= 0 THEN idf0 ELSE 0.25 * (SELECT avg(idf0) FROM {name}_idf0) END AS idf FROM {name}_idf0),
{name}_tf AS (SELECT ord, dl, term, count(*) AS tf FROM (SELECT ord, len(w) AS dl, unnest(w) AS term FROM {name}_words) WHERE term IN (SELECT term FROM asked) GROUP BY ALL),
{name}_score AS (
  SELECT query_id, ord, round(sum(qtf * idf * (tf * 2.5::DOUBLE) / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl))), 9) AS score
  FROM {name}_tf JOIN {name}_idf USING (term) JOIN asked USING (term), {name}_n GROUP BY query_id, ord)"""


BODY = f"WITH {CORPUS}, {ASKED}, {bm25_sql('content', 'body')}"
#: Scores are compared at 6 places; ranks follow the scores at 9.
RANKED = "SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, ord) - 1 AS rank, ord, score FROM"


def shown(df: DataFrame) -> DataFrame:
    return df.select("query_id", "rank", "ord", F.round("score", 6).alias("score"))


@query(f"{BODY} SELECT query_id, rank, ord, round(score, 6) AS score FROM ({RANKED} body_score) WHERE rank < 10")
def bm25_topk(spark, d):
    """The ten best documents for each question."""
    return shown(R.bm25_search(T.corpus(spark, d), T.questions(spark, d), 10))


@query(f"{BODY} SELECT query_id, rank, ord, round(score, 6) AS score FROM ({RANKED} body_score SEMI JOIN (SELECT ord FROM corpus WHERE module = 'src7' AND doc_category = 'en') USING (ord)) WHERE rank < 10")
def bm25_filtered_topk(spark, d):
    """Statistics of all documents, results of one module and category."""
    return shown(R.bm25_search(T.corpus(spark, d), T.questions(spark, d), 10, module="src7", category="en"))


@query(f"""WITH {CORPUS}, {ASKED}, {bm25_sql("title", "t")},
pages AS (SELECT split_part(url, '#', 1) AS page, arg_min(ord, pos * 100000000000 + chunk_id * 10000000000 + ord) AS ord, arg_min(url, pos * 100000000000 + chunk_id * 10000000000 + ord) AS url FROM corpus GROUP BY 1)
SELECT query_id, rank, ord, round(score, 6) AS score FROM (
  SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, url, ord) - 1 AS rank, ord, score FROM t_score JOIN pages USING (ord)) WHERE rank < 10""")
def bm25_title_pages(spark, d):
    """The ten best pages by title for each question."""
    return shown(R.title_search(T.corpus(spark, d), T.questions(spark, d), 10))


@query(f"""WITH {CORPUS}, df AS (SELECT term, count(DISTINCT ord) AS df FROM (SELECT ord, unnest({TOK.format("content")}) AS term FROM corpus) GROUP BY term),
raw AS MATERIALIZED (SELECT term, df, ln((SELECT count(*) FROM corpus) - df + 0.5) - ln(df + 0.5) AS idf0 FROM df)
SELECT term, df, round(CASE WHEN idf0 >= 0 THEN idf0 ELSE 0.25 * (SELECT avg(idf0) FROM raw) END, 6) AS idf FROM raw""")
def idf_table(spark, d):
    """§2.6.1: document frequency and floored weight of each word."""
    return R.idf_table(T.corpus(spark, d)).select("term", "df", F.round("idf", 6).alias("idf"))


def text_index(spark, d, text="content"):
    """A keyword index of the corpus, in the shared folder."""
    path = store.shared_path(spark, f"{text}-index")
    keyword_index.write_index(T.corpus(spark, d), path, text)
    return keyword_index.open_index(spark, path)


@query(ORACLES["bm25_topk"])
def bm25_index_topk(spark, d):
    """The ten best documents for each question, from a stored inverted index whose blocks are passed over by their maxima."""
    return shown(keyword_index.search(text_index(spark, d), T.questions(spark, d), 10))


@query(ORACLES["bm25_filtered_topk"])
def bm25_index_filtered_topk(spark, d):
    """The same, statistics of all documents, results of one module and category."""
    return shown(R.bm25_search(T.corpus(spark, d), T.questions(spark, d), 10, module="src7", category="en", index=text_index(spark, d)))


@query(ORACLES["bm25_title_pages"])
def title_index_pages(spark, d):
    """The ten best pages by title for each question, from a stored index of titles."""
    return shown(R.title_search(T.corpus(spark, d), T.questions(spark, d), 10, index=text_index(spark, d, "title")))


@query(f"WITH {CORPUS} SELECT ord, len({TOK.format('content')}) AS dl FROM corpus")
def doc_lengths(spark, d):
    """words of each document."""
    return R.lengths(T.corpus(spark, d))


VECTORS = "q AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS q, label AS q_label FROM embeddings WHERE vec_id % 20 = 0)"
DENSE = "SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, ord) - 1 AS rank, ord, score FROM (SELECT query_id, vec_id AS ord, round(list_cosine_similarity(q, embedding::DOUBLE[]), 9) AS score FROM q, embeddings {0})"


def vectors(spark, d):
    v = T.read(spark, d, "embeddings").select(F.col("vec_id").alias("ord"), "embedding", "label")
    return v, v.filter(F.col("ord") % 20 == 0).select(F.col("ord").alias("query_id"), F.col("embedding").alias("q_vec"))


@query(f"WITH {VECTORS} SELECT query_id, rank, ord, round(score, 6) AS score FROM ({DENSE.format('')}) WHERE rank < 10")
def dense_topk(spark, d):
    """The ten nearest vectors by cosine."""
    return shown(R.dense_search(*vectors(spark, d), 10))


@query(f"WITH {VECTORS} SELECT query_id, rank, ord, round(score, 6) AS score FROM ({DENSE.format('WHERE label = 3')}) WHERE rank < 10")
def dense_filtered_topk(spark, d):
    """The same with a filter on the candidates."""
    return shown(R.dense_search(*vectors(spark, d), 10, F.col("label") == 3))


def cells(spark, d):
    """A vector index of ``embeddings``, in the shared folder, and its questions."""
    v, q = vectors(spark, d)
    path = store.shared_path(spark, "vector-index")
    vector_index.write_index(v, path, cells=32, keep=("label",))
    return vector_index.open_index(spark, path), q


@query(ORACLES["dense_topk"])
def vector_index_topk(spark, d):
    """The ten nearest vectors by cosine, from a stored index of cells, all of which are read."""
    return shown(vector_index.search(*cells(spark, d), 10))


@query(ORACLES["dense_filtered_topk"])
def vector_index_filtered_topk(spark, d):
    """The same with a filter on the stored rows."""
    return shown(vector_index.search(*cells(spark, d), 10, allowed=F.col("label") == 3))


@query("""WITH q AS (SELECT label AS query_id, vec_id AS q_pos, embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id % 20 = 0)
SELECT query_id, doc_id, round(sum(best), 6) AS score FROM (
  SELECT query_id, q_pos, label AS doc_id, max(list_dot_product(q, embedding::DOUBLE[])) AS best FROM q, embeddings GROUP BY ALL) GROUP BY ALL""")
def maxsim_by_label(spark, d):
    """Late interaction between groups of vectors."""
    e = T.read(spark, d, "embeddings")
    q = e.filter(F.col("vec_id") % 20 == 0).select(F.col("label").alias("query_id"), F.col("vec_id").alias("q_pos"), F.col("embedding").alias("q_vec"))
    out = R.max_sim(q, e.select(F.col("label").alias("doc_id"), F.col("embedding").alias("d_vec")))
    return out.select("query_id", "doc_id", F.round("score", 6).alias("score"))


HYBRID = f"""{BODY}, {bm25_sql("title", "t")},
body AS (SELECT query_id, 0 AS channel, rank, ord FROM ({RANKED} body_score) WHERE rank < 40),
pages AS (SELECT split_part(url, '#', 1) AS page, arg_min(ord, pos * 100000000000 + chunk_id * 10000000000 + ord) AS ord, arg_min(url, pos * 100000000000 + chunk_id * 10000000000 + ord) AS url FROM corpus GROUP BY 1),
title AS (SELECT * FROM (SELECT query_id, 1 AS channel, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, url, ord) - 1 AS rank, ord FROM t_score JOIN pages USING (ord)) WHERE rank < 10),
lists AS (FROM body UNION ALL FROM title),
keyed AS (SELECT l.*, c.section_id, c.pos, 1.0::DOUBLE / (61 + rank) AS part FROM lists l JOIN corpus c USING (ord)),
fused AS (SELECT query_id, arg_min(ord, channel * 1000 + rank) AS ord, round(sum(part), 12) AS score, min(channel * 1000 + rank) AS first FROM keyed GROUP BY query_id, section_id, pos),
pool AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, first) - 1 AS rank, ord, score FROM fused)"""


def hybrid(spark, d, k=None):
    c, q = T.corpus(spark, d), T.questions(spark, d)
    lists = [R.bm25_search(c, q, 40), R.title_search(c, q, 10)]
    lists = [x.select("query_id", F.lit(i).alias("channel"), "rank", "ord") for i, x in enumerate(lists)]
    keyed = lists[0].unionByName(lists[1]).join(c.select("ord", "section_id", "chunk_position"), "ord")
    return R.fuse(keyed, ["section_id", "chunk_position"], k)


@query(f"{HYBRID} SELECT query_id, rank, ord, round(score, 6) AS score FROM pool WHERE rank < 15")
def rrf_two_channel(spark, d):
    """Body and title channels, fused and cut."""
    return shown(hybrid(spark, d, 15))


@query(f"{HYBRID} SELECT query_id, rank, ord, round(score, 6) AS score FROM pool")
def rrf_full(spark, d):
    """The same without a cut."""
    return shown(hybrid(spark, d))


@query("""WITH q AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id % 20 = 0),
s AS (SELECT query_id, vec_id AS ord, label, round(list_cosine_similarity(q, embedding::DOUBLE[]), 9) AS score FROM q, embeddings),
a AS (SELECT query_id, 0 AS channel, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, ord) - 1 AS rank, ord FROM s),
b AS (SELECT query_id, 1 AS channel, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, ord) - 1 AS rank, ord FROM s WHERE label < 5),
c AS (SELECT query_id, 2 AS channel, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, ord) - 1 AS rank, ord FROM s WHERE label >= 5),
l AS (SELECT * FROM a WHERE rank < 80 UNION ALL SELECT * FROM b WHERE rank < 40 UNION ALL SELECT * FROM c WHERE rank < 10),
f AS (SELECT query_id, ord, round(list_sum(list(1.0::DOUBLE / (61 + rank) ORDER BY channel, rank)), 12) AS score, min(channel * 1000 + rank) AS first FROM l GROUP BY ALL)
SELECT * EXCLUDE score, round(score, 6) AS score FROM (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, first) - 1 AS rank, ord, score FROM f) WHERE rank < 40""")
def rrf_three_channel(spark, d):
    """Three vector channels of different depth, pooled to forty."""
    v, q = vectors(spark, d)
    deep = R.dense_search(v, q, 80), R.dense_search(v, q, 40, F.col("label") < 5), R.dense_search(v, q, 10, F.col("label") >= 5)
    lists = [x.select("query_id", F.lit(i).alias("channel"), "rank", "ord", F.col("ord").alias("key")) for i, x in enumerate(deep)]
    return shown(R.fuse(lists[0].unionByName(lists[1]).unionByName(lists[2]), ["key"], 40))


ALL_RANKED = f"WITH {CORPUS}, r AS (SELECT module AS query_id, row_number() OVER (PARTITION BY module ORDER BY ord) - 1 AS rank, * FROM corpus)"


def by_module(spark, d):
    """All documents as ranked lists, one for each module. Only ids and short columns are sorted; a hash stands for the text."""
    c = T.corpus(spark, d).select("ord", "url", "module", F.sha1(F.coalesce("content", F.lit(""))).alias("content"))
    return c.withColumn("query_id", F.col("module")).withColumn("rank", F.row_number().over(Window.partitionBy("module").orderBy("ord")) - 1)


@query(f"""{ALL_RANKED},
g AS (SELECT query_id, sha1(content) AS key, min(rank) AS pos, coalesce(arg_max(ord, rank) FILTER (WHERE ord % 7 = 0), arg_min(ord, rank)) AS ord, count(*) AS copies FROM r GROUP BY ALL)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY pos) - 1 AS rank, ord, copies FROM g""")
def symbol_dedup(spark, d):
    """Copies of a text in a ranked list become one, at the first one's place."""
    r = by_module(spark, d).withColumns({"anchor_id": F.lit(None).cast("string"), "declares": F.col("ord") % 7 == 0})
    return R.collapse_copies(r)


@query(f"{ALL_RANKED} SELECT query_id, rank, ord FROM r QUALIFY row_number() OVER (PARTITION BY query_id, split_part(url, '#', 1) ORDER BY rank, ord) = 1")
def section_representative(spark, d):
    """The first row of each page in a ranked list."""
    return R.first_of(by_module(spark, d).withColumn("page", C.page_key(F.col("url"), F.lit(""))), "page").select("query_id", "rank", "ord")


@query(f"""WITH RECURSIVE {CORPUS},
r AS (SELECT (ord // 10) AS query_id, (ord % 10)::INT AS rank, ord, length(content) AS cost FROM corpus),
fold AS (
  SELECT query_id, rank, ord, CASE WHEN cost <= 6000 THEN cost ELSE 0 END AS spent, 6000 - CASE WHEN cost <= 6000 THEN cost ELSE 0 END AS rest FROM r WHERE rank = 0
  UNION ALL
  SELECT r.query_id, r.rank, r.ord, CASE WHEN cost <= rest THEN cost ELSE 0 END, rest - CASE WHEN cost <= rest THEN cost ELSE 0 END
  FROM fold JOIN r ON r.query_id = fold.query_id AND r.rank = fold.rank + 1)
SELECT query_id, rank, ord, spent FROM fold""")
def budget_expand(spark, d):
    """Ten candidates each, taken greedily under a budget of 6000 characters."""
    c = T.corpus(spark, d)
    return R.spend_budget(c.select(F.floor(F.col("ord") / 10).alias("query_id"), (F.col("ord") % 10).alias("rank"), "ord", F.length("content").alias("cost")), 6000)


CHUNKS = """RECURSIVE t AS (SELECT doc_id, text, length(text) AS n FROM documents),
cuts AS (
  SELECT doc_id, 0 AS pos, 0::BIGINT AS s, n, 1000::BIGINT AS raw_end FROM t
  UNION ALL
  SELECT c.doc_id, c.pos + 1, c.e - 200, c.n, c.e - 200 + 1000
  FROM (SELECT cuts.*, {end} AS e FROM cuts JOIN t USING (doc_id)) c WHERE c.n > 1000 AND c.e - 200 < c.n)"""
END = """CASE WHEN cuts.raw_end >= cuts.n OR cuts.n <= 1000 THEN cuts.raw_end ELSE
  CASE WHEN greatest(strpos(reverse(substr(text, cuts.raw_end - 100 + 1, 100)), '.'), strpos(reverse(substr(text, cuts.raw_end - 100 + 1, 100)), chr(10))) = 0 THEN cuts.raw_end
  ELSE cuts.raw_end - least(CASE WHEN strpos(reverse(substr(text, cuts.raw_end - 100 + 1, 100)), '.') = 0 THEN 1000 ELSE strpos(reverse(substr(text, cuts.raw_end - 100 + 1, 100)), '.') END,
    CASE WHEN strpos(reverse(substr(text, cuts.raw_end - 100 + 1, 100)), chr(10)) = 0 THEN 1000 ELSE strpos(reverse(substr(text, cuts.raw_end - 100 + 1, 100)), chr(10)) END) + 1 END END"""


WHITE_SQL = "'" + C.WHITE + "'"
#: Sections of these tables have two fragments at most.
SECTIONS = f"""frags AS (SELECT section_id, ord, title, coalesce(content, '') AS c, row_number() OVER (PARTITION BY section_id ORDER BY pos, ord) AS i FROM corpus),
pairs AS (SELECT a.section_id, a.c AS a, CASE WHEN a.c <> '' AND starts_with(b.c, b.title || chr(10) || chr(10)) THEN substr(b.c, length(b.title) + 3) ELSE b.c END AS b, least(a.ord, coalesce(b.ord, a.ord)) AS ord
  FROM frags a LEFT JOIN frags b ON a.section_id = b.section_id AND b.i = 2 WHERE a.i = 1),
sections AS (SELECT section_id, ord, trim(a || coalesce(substr(b, 1 + coalesce(list_max(list_filter(range(1, least(500, length(a), length(b)) + 1), lambda n: right(a, n::INT) = left(b, n::INT))), 0)::INT), ''), {WHITE_SQL}) AS text FROM pairs)"""


@query(f"WITH {CORPUS}, {SECTIONS} SELECT section_id, ord, length(text) AS n_chars, sha256(text) AS sha256 FROM sections")
def section_rebuild(spark, d):
    """Sections put together again from their fragments."""
    return R.rebuild(T.corpus(spark, d)).select("section_id", "ord", F.length("text").alias("n_chars"), F.sha2("text", 256).alias("sha256"))


@query(f"""WITH {CHUNKS.format(end=END)}, pieces AS (SELECT doc_id, pos, CASE WHEN cuts.n > 1000 THEN trim(substr(text, s + 1, ({END}) - s), {WHITE_SQL}) ELSE text END AS c FROM cuts JOIN t USING (doc_id)),
fold AS (
  SELECT doc_id, pos, c AS acc FROM pieces WHERE pos = 0
  UNION ALL
  SELECT f.doc_id, p.pos, acc || substr(c, 1 + coalesce(list_max(list_filter(range(1, least(500, length(acc), length(c)) + 1), lambda n: right(acc, n::INT) = left(c, n::INT))), 0)::INT) FROM fold f JOIN pieces p ON p.doc_id = f.doc_id AND p.pos = f.pos + 1)
SELECT doc_id, pos + 1 AS fragments, length(trim(acc, {WHITE_SQL})) AS n_chars, sha256(trim(acc, {WHITE_SQL})) AS sha256 FROM fold QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY pos DESC) = 1""")
def chunks_rebuilt(spark, d):
    """Documents cut into overlapping chunks and put together again, of as many fragments as there are."""
    c = chunking.chunk_rows(T.read(spark, d, "documents").select("doc_id", "text"))
    place = F.concat((F.col("pos") + 1).cast("string"), F.lit("/"), F.col("total").cast("string"))
    parts = c.select("doc_id", F.lit("").alias("title"), F.col("chunk").alias("content"), place.alias("chunk_position"), F.col("pos").alias("ord"), "total")
    counts = parts.groupBy("doc_id").agg(F.count("*").cast("int").alias("fragments"))
    return R.rebuild(parts, "doc_id").join(counts, "doc_id").select("doc_id", "fragments", F.length("text").alias("n_chars"), F.sha2("text", 256).alias("sha256"))


@query(f"""WITH {CORPUS}, {SECTIONS}, p AS (SELECT split_part(section_id, '#', 1) AS page, trim(string_agg(text, chr(10) || chr(10) ORDER BY ord), {WHITE_SQL}) AS text FROM sections WHERE text <> '' GROUP BY 1)
SELECT page, length(text) AS n_chars, sha256(text) AS sha256 FROM p""")
def page_rebuild(spark, d):
    """Whole pages put together again from their sections."""
    return R.rebuild_pages(T.corpus(spark, d)).select("page", F.length("text").alias("n_chars"), F.sha2("text", 256).alias("sha256"))


SYMBOLS = """symbols AS (SELECT doc_id AS ord, text AS content, 'a' || (doc_id % 5)::VARCHAR || '_' || (doc_id % 7)::VARCHAR AS anchor_id, 'void Mod_' || (doc_id % 7)::VARCHAR || '::m' || (doc_id % 5)::VARCHAR AS hierarchy,
  'docs/' || ['class', 'struct', 'page'][doc_id % 3 + 1] || 'Mod__' || (doc_id % 11)::VARCHAR || '.html#a' || (doc_id % 5)::VARCHAR AS url, 'docs/p' || (doc_id % 13)::VARCHAR || '.html#s' || (doc_id % 2)::VARCHAR AS section_id FROM documents)"""


def symbols(spark, d):
    """``documents`` as copies of symbols, some of them on the page that declares theirs."""
    i = F.col("doc_id")
    text = lambda n: (i % n).cast("string")
    kind = F.element_at(F.array(*map(F.lit, ("class", "struct", "page"))), (i % 3 + 1).cast("int"))
    return T.read(spark, d, "documents").select(
        i.alias("ord"), F.col("text").alias("content"), F.concat(F.lit("a"), text(5), F.lit("_"), text(7)).alias("anchor_id"), F.concat(F.lit("void Mod_"), text(7), F.lit("::m"), text(5)).alias("hierarchy"),
        F.concat(F.lit("docs/"), kind, F.lit("Mod__"), text(11), F.lit(".html#a"), text(5)).alias("url"), F.concat(F.lit("docs/p"), text(13), F.lit(".html#s"), text(2)).alias("section_id"),
    )


@query(f"""WITH {SYMBOLS}, r AS (SELECT ord // 100 AS query_id, ord % 100 AS rank, *, split_part(split_part(url, '#', 1), '/', 2) IN ('class' || 'Mod__' || (ord % 7)::VARCHAR || '.html', 'structMod__' || (ord % 7)::VARCHAR || '.html', 'interfaceMod__' || (ord % 7)::VARCHAR || '.html') AS declares FROM symbols),
g AS (SELECT query_id, anchor_id, min(rank) AS pos, coalesce(arg_max(ord, rank) FILTER (WHERE declares), arg_min(ord, rank)) AS ord FROM r GROUP BY ALL),
o AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY pos) - 1 AS rank, g.ord, section_id FROM g JOIN symbols USING (ord)),
f AS (SELECT * FROM o QUALIFY row_number() OVER (PARTITION BY query_id, section_id ORDER BY rank) = 1)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY rank) - 1 AS rank, ord, section_id FROM f""")
def context_representatives(spark, d):
    """Copies of a symbol are represented by the one on its declaring page, sections by their first row."""
    c = symbols(spark, d)
    return A.representatives(c, c.select(F.floor(F.col("ord") / 100).alias("query_id"), (F.col("ord") % 100).alias("rank"), "ord"))


@query(f"""WITH {CORPUS}, {SECTIONS}, one AS (SELECT ord // 20 AS query_id, ord % 20 AS spot, ord, section_id, content, 'short ' || ord::VARCHAR AS capped, row_number() OVER (PARTITION BY ord // 20, sha1(content) ORDER BY ord) AS copy FROM corpus),
first_copy AS (SELECT *, row_number() OVER (PARTITION BY query_id, section_id ORDER BY spot) AS k FROM one WHERE copy = 1),
picked AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY spot) - 1 AS rank, ord, section_id, capped FROM first_copy WHERE k = 1),
rows_ AS (SELECT p.*, s.text FROM picked p JOIN sections s USING (section_id) WHERE rank < 8),
fold AS (SELECT query_id, rank, ord, CASE WHEN length(text) <= 9000 THEN text ELSE capped END AS content, 9000 - length(CASE WHEN length(text) <= 9000 THEN text ELSE capped END) AS rest FROM rows_ WHERE rank = 0
  UNION ALL SELECT r.query_id, r.rank, r.ord, CASE WHEN length(r.text) <= rest THEN r.text ELSE r.capped END, rest - length(CASE WHEN length(r.text) <= rest THEN r.text ELSE r.capped END) FROM fold JOIN rows_ r ON r.query_id = fold.query_id AND r.rank = fold.rank + 1)
SELECT query_id, rank, ord, length(content) AS n_chars, sha256(content) AS sha256 FROM fold""".replace("WITH corpus", "WITH RECURSIVE corpus"))
def context_selection(spark, d):
    """Representatives, each as its whole section while a budget of 9000 characters lasts, else as a short text."""
    c = T.corpus(spark, d).withColumn("section_text", F.concat(F.lit("short "), F.col("ord").cast("string")))
    pool = c.select(F.floor(F.col("ord") / 20).alias("query_id"), (F.col("ord") % 20).cast("int").alias("rank"), "ord")
    out = A.select_context(c, pool, Settings(top_n_after_rerank=8, expansion_char_budget=9000))
    return out.select("query_id", "rank", "ord", F.length("content").alias("n_chars"), F.sha2("content", 256).alias("sha256"))


@query(f"""{BODY}, found AS (SELECT * FROM ({RANKED} body_score) WHERE rank < 40),
copies AS (SELECT query_id, sha1(content) AS h, min(rank) AS rank, arg_min(ord, rank) AS ord FROM found JOIN corpus USING (ord) GROUP BY ALL),
found_pages AS (SELECT query_id, split_part(url, '#', 1) AS filepath, min(rank) AS rank FROM copies c JOIN corpus USING (ord) GROUP BY ALL)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY rank) - 1 AS rank, filepath FROM found_pages QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY rank) <= 10""")
def page_search(spark, d):
    """The ten best pages for each question, by chunks four times as deep."""
    c = T.corpus(spark, d)
    return A.search_pages(c, page_index(c), T.questions(spark, d), 10)


def page_index(c):
    path = F.substring_index("url", "#", 1)
    return c.groupBy(path.alias("filepath")).agg(F.min_by("title", "ord").alias("title"), F.min("module").alias("module"), F.min("doc_category").alias("doc_category")).withColumn("filename", C.file_name(F.col("filepath")))


@query(f"""{BODY.replace('WITH corpus', 'WITH RECURSIVE corpus', 1)}, {SECTIONS}, found AS (SELECT * FROM ({RANKED} body_score) WHERE rank < 60),
whole_pages AS (SELECT split_part(section_id, '#', 1) AS page, trim(string_agg(text, chr(10) || chr(10) ORDER BY ord), {WHITE_SQL}) AS page_text FROM sections WHERE text <> '' GROUP BY 1),
copies AS (SELECT query_id, sha1(content) AS h, min(rank) AS spot, arg_min(ord, rank) AS ord FROM found JOIN corpus USING (ord) GROUP BY ALL),
firsts AS (SELECT query_id, spot, ord, section_id, content FROM copies JOIN corpus USING (ord) QUALIFY row_number() OVER (PARTITION BY query_id, section_id ORDER BY spot, ord) = 1),
cand AS (SELECT f.*, row_number() OVER (PARTITION BY query_id ORDER BY spot) AS k, split_part(section_id, '#', 1) AS page, page_text, s.text AS section, coalesce(length(page_text), 0) AS whole, coalesce(length(s.text), 0) AS full_n
  FROM firsts f LEFT JOIN whole_pages p ON p.page = split_part(f.section_id, '#', 1) LEFT JOIN sections s USING (section_id)),
choice AS (SELECT *, whole > 0 AND whole <= 8000 AS short FROM cand),
fold AS (
  SELECT DISTINCT query_id, 0::BIGINT AS k, 15000::BIGINT AS rest, []::VARCHAR[] AS seen, 0 AS n, NULL::VARCHAR AS took FROM choice
  UNION ALL
  SELECT query_id, k, rest - CASE took WHEN 'page' THEN whole WHEN 'section' THEN full_n ELSE 0 END, CASE WHEN n < 5 AND short THEN list_append(seen, page) ELSE seen END, n + (took IS NOT NULL)::INT, took
  FROM (SELECT f.query_id, c.k, f.rest, f.seen, f.n, c.short, c.whole, c.full_n, c.page,
          CASE WHEN f.n >= 5 OR (c.short AND list_contains(f.seen, c.page)) THEN NULL WHEN c.short THEN CASE WHEN c.whole <= f.rest THEN 'page' END WHEN c.full_n > 0 AND c.full_n <= f.rest THEN 'section' ELSE 'chunk' END AS took
        FROM fold f JOIN choice c ON c.query_id = f.query_id AND c.k = f.k + 1)),
taken AS (SELECT c.query_id, c.page, row_number() OVER (PARTITION BY c.query_id ORDER BY c.k) AS i, CASE took WHEN 'page' THEN page_text WHEN 'section' THEN section ELSE content END AS text
  FROM choice c JOIN fold f ON f.query_id = c.query_id AND f.k = c.k WHERE took IS NOT NULL QUALIFY row_number() OVER (PARTITION BY c.query_id, c.page ORDER BY c.k) = 1),
about AS (SELECT split_part(url, '#', 1) AS page, arg_min(title, ord) AS title, min(module) AS module, min(doc_category) AS doc_category FROM corpus GROUP BY 1),
items AS (SELECT query_id, i, '[' || (row_number() OVER (PARTITION BY query_id ORDER BY i))::VARCHAR || '] ' || split_part(page, '/', -1) || ' | ' || title || ' | ' || module || '/' || doc_category || chr(10) || coalesce(text, '') AS item FROM taken JOIN about USING (page))
SELECT query_id, length(l) AS n_chars, sha256(l) AS sha256 FROM (SELECT query_id, string_agg(item, chr(10) || chr(10) ORDER BY i) AS l FROM items GROUP BY query_id)""")
def page_search_sections(spark, d):
    """The sections or short pages found for each question, as a numbered listing."""
    c = T.corpus(spark, d)
    found = A.search_pages(c, page_index(c), T.questions(spark, d), 15, by_section=True, texts=text_index(spark, d))
    return A.listing(found, page_index(c)).select("query_id", F.length("listing").alias("n_chars"), F.sha2("listing", 256).alias("sha256"))


@query(f"{ALL_RANKED} SELECT query_id, rank // 10 AS batch, count(*) AS n, string_agg(ord::VARCHAR, ',' ORDER BY rank) AS ords FROM r GROUP BY ALL")
def deep_dive_batches(spark, d):
    """Ranked rows in lots of ten."""
    return R.batches(by_module(spark, d))


@query("""SELECT (doc_id // 10) AS query_id, count(*) AS context_docs, length(string_agg(text, chr(10) || chr(10) ORDER BY doc_id)) AS context_chars, sha256(string_agg(text, chr(10) || chr(10) ORDER BY doc_id)) AS sha256 FROM documents GROUP BY 1""")
def context_assembly(spark, d):
    """Contexts of ten documents each."""
    c = T.corpus(spark, d).select(F.floor(F.col("ord") / 10).alias("query_id"), (F.col("ord") % 10).alias("rank"), "content")
    return R.assemble(c).select("query_id", "context_docs", "context_chars", F.sha2("context", 256).alias("sha256"))


NAME = "split_part(regexp_replace(url, '[#?].*$', ''), '/', -1)"


@query(f"""WITH p AS (SELECT page_id, regexp_replace(url, '[#?].*$', '') AS u FROM pages), s AS (SELECT page_id, list_filter(string_split(u, '/'), lambda x: x <> '') AS parts FROM p)
SELECT page_id, array_to_string(list_slice(parts, greatest(1, len(parts) - 1), len(parts)), '/') AS name FROM s""")
def qualified_filename(spark, d):
    """the last two parts of each address."""
    return T.read(spark, d, "pages").select("page_id", C.qualified_name(F.col("url")).alias("name"))


@query("""WITH s AS (SELECT page_id, url, list_filter(string_split(regexp_replace(url, '[#?].*$', ''), '/'), lambda x: x <> '') AS parts FROM pages),
n AS (SELECT page_id, array_to_string(list_slice(parts, greatest(1, len(parts) - 1), len(parts)), '/') AS full_name, parts[-1] AS bare FROM s),
q AS (SELECT full_name, max(page_id) AS page_id FROM n GROUP BY 1), b AS (SELECT bare, min(page_id) AS page_id FROM n GROUP BY 1),
chunks AS (SELECT doc_id AS ord, 'en/' || (doc_id % 1000)::VARCHAR AS full_name, (doc_id % 1000)::VARCHAR AS bare FROM documents)
SELECT ord, coalesce(q.page_id, b.page_id) AS page_id FROM chunks LEFT JOIN q USING (full_name) LEFT JOIN b USING (bare) WHERE coalesce(q.page_id, b.page_id) IS NOT NULL""")
def qualified_filename_join(spark, d):
    """Chunks meet the page index by qualified name, else by bare name; without either they go."""
    n = T.read(spark, d, "pages").select("page_id", C.qualified_name(F.col("url")).alias("full_name"))
    n = n.withColumn("bare", F.substring_index("full_name", "/", -1))
    by_full, by_bare = n.groupBy("full_name").agg(F.max("page_id").alias("p1")), n.groupBy("bare").agg(F.min("page_id").alias("p2"))
    at = (F.col("doc_id") % 1000).cast("string")
    chunks = T.read(spark, d, "documents").select(F.col("doc_id").alias("ord"), F.concat(F.lit("en/"), at).alias("full_name"), at.alias("bare"))
    out = chunks.join(by_full, "full_name", "left").join(by_bare, "bare", "left").withColumn("page_id", F.coalesce("p1", "p2"))
    return out.filter(F.col("page_id").isNotNull()).select("ord", "page_id")


PATHS = """paths AS (SELECT doc_id, CASE doc_id % 9 WHEN 0 THEN 'a/functions_' || lang || '.html' WHEN 1 THEN 'a/_modules/x.html' WHEN 2 THEN 'class_' || source || '.html' WHEN 3 THEN 'dir_0a' || (doc_id % 7)::VARCHAR || '.html'
  WHEN 4 THEN 'b/' || ['genindex', 'classes', 'my_classes', 'todo', 'search', 'research', 'py-modindex'][doc_id % 7 + 1] || '.html' WHEN 5 THEN 'my_genindex.html' WHEN 6 THEN 'tutorial_' || source || '.html' WHEN 7 THEN 'x/api/how' || lang || '.html' ELSE 'a/file_8h_source.html' END AS path FROM documents)"""


def paths(spark, d):
    t = T.read(spark, d, "documents")
    i, lang, src = F.col("doc_id") % 9, F.col("lang"), F.col("source")
    out = F.when(i == 0, F.concat(F.lit("a/functions_"), lang, F.lit(".html"))).when(i == 1, "a/_modules/x.html").when(i == 2, F.concat(F.lit("class_"), src, F.lit(".html")))
    out = out.when(i == 3, F.concat(F.lit("dir_0a"), (F.col("doc_id") % 7).cast("string"), F.lit(".html"))).when(i == 4, F.concat(F.lit("b/"), F.element_at(F.array(*map(F.lit, ("genindex", "classes", "my_classes", "todo", "search", "research", "py-modindex"))), (F.col("doc_id") % 7 + 1).cast("int")), F.lit(".html"))).when(i == 5, "my_genindex.html")
    out = out.when(i == 6, F.concat(F.lit("tutorial_"), src, F.lit(".html"))).when(i == 7, F.concat(F.lit("x/api/how"), lang, F.lit(".html"))).otherwise("a/file_8h_source.html")
    return t.select("doc_id", out.alias("path"))


@query(f"""WITH {PATHS} SELECT doc_id, path FROM paths WHERE NOT (split_part(path, '/', -1) IN ({", ".join(f"'{n}'" for n in C.GENERATED_NAMES)})
  OR regexp_matches(split_part(path, '/', -1), '^([^/]*_source|(functions|globals|namespacemembers|classmembers)_[A-Za-z0-9_]*|dir_[0-9a-f]+)\\.html$') OR list_contains(string_split(path, '/'), '_modules'))""")
def generated_page_antifilter(spark, d):
    """Pages that no generator wrote for navigation."""
    return paths(spark, d).filter(~C.is_generated(F.col("path")))


@query(f"""WITH {PATHS}, n AS (SELECT doc_id, lower(split_part(path, '/', -1)) AS n FROM paths)
SELECT doc_id, CASE WHEN n LIKE 'class%' OR n LIKE 'struct%' THEN 'class' WHEN n LIKE 'namespace%' THEN 'namespace' WHEN contains(n, 'modules') OR contains(n, 'group') THEN 'module' ELSE 'page' END AS dev_type,
  CASE WHEN contains(n, 'tutorial') THEN 'tutorial' WHEN contains(n, 'guide') OR contains(n, 'howto') THEN 'guide' WHEN contains(n, 'api') OR contains(n, 'reference') THEN 'reference' ELSE 'page' END AS user_type FROM n""")
def doc_type_classify(spark, d):
    """kinds of pages."""
    n = C.file_name(F.col("path"))
    return paths(spark, d).select("doc_id", C.doc_type(n, F.lit("dev")).alias("dev_type"), C.doc_type(n, F.lit("user")).alias("user_type"))


SCORE = f"""scored AS (SELECT doc_id, title, text, CASE WHEN trim(text, {WHITE_SQL}) = '' THEN 0 ELSE least(1.0::DOUBLE, least(w / 200.0::DOUBLE, 1.0::DOUBLE)
  + CASE WHEN trim(title, {WHITE_SQL}) <> '' THEN 0.1::DOUBLE ELSE 0.0::DOUBLE END + CASE WHEN w > 50 THEN 0.1::DOUBLE ELSE 0.0::DOUBLE END + CASE WHEN w > 100 THEN 0.1::DOUBLE ELSE 0.0::DOUBLE END) END AS q
  FROM (SELECT doc_id, text, split_part(text, chr(10), 1) AS title, len({TOK.format("text")}) AS w FROM documents))"""


@query(f"WITH {SCORE} SELECT doc_id, round(q, 6) AS score FROM scored")
def quality_score(spark, d):
    """Length-based quality."""
    t = T.read(spark, d, "documents")
    return t.select("doc_id", F.round(C.quality_score(F.col("text"), C.first_line(F.col("text"))), 6).alias("score"))


@query(f"WITH {SCORE} SELECT doc_id FROM scored WHERE q >= 0.6 AND length(trim(title || chr(10) || chr(10) || text, {WHITE_SQL})) >= 50")
def quality_gate(spark, d):
    """pages long and good enough."""
    return T.read(spark, d, "documents").filter(C.passes_gate(F.col("text"), C.first_line(F.col("text")), min_score=0.6)).select("doc_id")


@query("""WITH r AS (SELECT DISTINCT source AS module, 'about ' || source AS description FROM documents UNION ALL SELECT 'unused', 'no chunks'),
c AS (SELECT source AS module, count(*) FILTER (WHERE lang = 'en') AS en, count(*) FILTER (WHERE lang = 'fr') AS fr, count(*) FILTER (WHERE lang = 'de') AS de, count(*) AS total FROM documents GROUP BY source)
SELECT module, description, coalesce(en, 0) AS en, coalesce(fr, 0) AS fr, coalesce(de, 0) AS de, coalesce(total, 0) AS total FROM r LEFT JOIN c USING (module)
UNION ALL SELECT NULL, NULL, sum(en)::BIGINT, sum(fr)::BIGINT, sum(de)::BIGINT, sum(total)::BIGINT FROM c""")
def module_stats(spark, d):
    """A1, A2, A4: chunks of each registered module by category, and in all."""
    c = T.corpus(spark, d)
    registered = c.select("module", F.concat(F.lit("about "), F.col("module")).alias("description")).distinct().unionByName(spark.createDataFrame([("unused", "no chunks")], "module string, description string"))
    return E.module_statistics(c, registered, ("en", "fr", "de"))


@query("SELECT DISTINCT source AS module FROM documents")
def module_distinct(spark, d):
    """A3: the modules."""
    return T.read(spark, d, "documents").select(F.col("source").alias("module")).distinct()


@query("""SELECT lang, count(*) AS documents, count(DISTINCT text) AS texts, sum(length(text))::BIGINT AS chars FROM documents GROUP BY lang""")
def copies_by_category(spark, d):
    """§2.12: different texts by hash."""
    g = T.read(spark, d, "documents").groupBy("lang", F.sha2("text", 256).alias("h")).agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("c"))
    return g.groupBy("lang").agg(F.sum("n").alias("documents"), F.count("*").alias("texts"), F.sum("c").alias("chars"))


@query(f"WITH {CHUNKS.format(end=END)} SELECT doc_id, pos, length(trim(substr(text, s + 1, ({END}) - s), ' ' || chr(10) || chr(9) || chr(13))) AS n_chars FROM cuts JOIN t USING (doc_id)")
def char_chunks(spark, d):
    """Overlapping chunks of characters that end at a full stop or line if they can."""
    return chunking.chunk_rows(T.read(spark, d, "documents").select("doc_id", "text")).select("doc_id", "pos", F.when(F.col("total") > 1, F.length("chunk")).otherwise(F.length(F.btrim("chunk", F.lit(" \n\t\r")))).alias("n_chars"))


@query(ORACLES["char_chunks"])
def sql_char_chunks(spark, d):
    """The same by a table function in Spark SQL."""
    sql.register(spark)
    T.read(spark, d, "documents").createOrReplaceTempView("quarry_documents")
    white = " \\n\\t\\r"
    return spark.sql(f"""SELECT d.doc_id, c.pos, CASE WHEN c.total > 1 THEN length(c.chunk) ELSE length(btrim(c.chunk, '{white}')) END AS n_chars FROM quarry_documents d, LATERAL chunk_text(d.text, 1000, 200) c""")


@query(f"WITH {CHUNKS.format(end=END)} SELECT source, count(*) AS chunks, count(DISTINCT doc_id) AS documents FROM cuts JOIN documents USING (doc_id) GROUP BY source")
def chunk_stats(spark, d):
    """Chunks of each module."""
    c = chunking.chunk_rows(T.read(spark, d, "documents").select("doc_id", "text", "source"), keep=["source"])
    return c.groupBy("source").agg(F.count("*").alias("chunks"), F.count_if(F.col("pos") == 0).alias("documents"))


@query(r"SELECT page_id, replace(replace(replace(replace(t, '&lt;', '<'), '&gt;', '>'), '&quot;', chr(34)), '&amp;', '&') AS title FROM (SELECT page_id, trim(regexp_replace(regexp_extract(html, '<h1[^>]*>(.*?)</h1>', 1, 's'), '\s+', ' ', 'g')) AS t FROM pages)")
def page_titles(spark, d):
    """Headings or titles of pages."""
    return extraction.pages(T.read(spark, d, "pages")).select("page_id", "title")


#: Pages of these tables hold one article without second level headings.
PAGE_SQL = f"""bodies AS (SELECT page_id, string_split(regexp_replace(regexp_extract(html, '<article[^>]*>(.*)</article>', 1, 's'), '<[^>]*>', chr(1), 'g'), chr(1)) AS parts,
  trim(regexp_replace(regexp_extract(html, '<h1[^>]*>(.*?)</h1>', 1, 's'), '\\s+', ' ', 'g')) AS raw_title FROM pages),
texts AS (SELECT page_id, array_to_string(list_filter(list_transform(parts, lambda x: trim(replace(replace(replace(replace(x, '&lt;', '<'), '&gt;', '>'), '&quot;', chr(34)), '&amp;', '&'), {WHITE_SQL})), lambda x: x <> ''), chr(10)) AS text,
  replace(replace(replace(replace(raw_title, '&lt;', '<'), '&gt;', '>'), '&quot;', chr(34)), '&amp;', '&') AS title FROM bodies)"""


@query(f"WITH {PAGE_SQL}, c AS (SELECT page_id, CASE WHEN length(text) > 8000 THEN left(text, 8000) || chr(10) || '[cut]' ELSE text END AS t FROM texts) SELECT page_id, length(t) AS n_chars, sha256(t) AS sha256 FROM c")
def page_text(spark, d):
    """Text of pages, cut at 8000 characters."""
    return extraction.pages(T.read(spark, d, "pages")).select("page_id", F.length("text").alias("n_chars"), F.sha2("text", 256).alias("sha256"))


@query(f"WITH {PAGE_SQL} SELECT page_id, 0 AS ord, page_id::VARCHAR || '#root' AS section, length(text) AS n_chars FROM texts")
def section_split(spark, d):
    """Sections of pages."""
    return extraction.sections(T.read(spark, d, "pages"))


PAGE_CHUNKS = CHUNKS.format(end=END).replace("FROM documents)", "FROM (SELECT page_id AS doc_id, title || chr(10) || chr(10) || text AS text FROM good))", 1).replace("RECURSIVE t AS", f"""RECURSIVE {PAGE_SQL},
words AS (SELECT *, len({TOK.format("text")}) AS w FROM texts),
scored AS (SELECT *, CASE WHEN trim(text, {WHITE_SQL}) = '' THEN 0 ELSE least(1.0::DOUBLE, least(w / 200.0::DOUBLE, 1.0::DOUBLE) + CASE WHEN title <> '' THEN 0.1::DOUBLE ELSE 0.0::DOUBLE END + CASE WHEN w > 50 THEN 0.1::DOUBLE ELSE 0.0::DOUBLE END + CASE WHEN w > 100 THEN 0.1::DOUBLE ELSE 0.0::DOUBLE END) END AS q FROM words),
good AS (SELECT * FROM scored WHERE q >= 0.3 AND length(trim(title || chr(10) || chr(10) || text, {WHITE_SQL})) >= 50),
t AS""", 1)


@query(f"""WITH {PAGE_CHUNKS}, c AS (SELECT doc_id AS page_id, pos, cuts.n, substr(t.text, s + 1, ({END}) - s) AS raw FROM cuts JOIN t USING (doc_id))
SELECT page_id, pos AS chunk_id, (pos + 1)::VARCHAR || '/' || (count(*) OVER (PARTITION BY page_id))::VARCHAR AS chunk_position, sha256(CASE WHEN c.n > 1000 THEN trim(raw, {WHITE_SQL}) ELSE raw END) AS sha256, p.url || '#root' AS section_id FROM c JOIN pages p USING (page_id)""")
def page_chunks(spark, d):
    """Pages as enriched chunks."""
    out = extraction.chunks(T.read(spark, d, "pages"), category="user")
    return out.select("page_id", "chunk_id", "chunk_position", F.sha2("content", 256).alias("sha256"), "section_id")


@query("""SELECT conv_id, CASE WHEN count(u) = 0 THEN NULL ELSE sum(u) END AS total_tokens, sum(u) FILTER (WHERE role = 'user') AS input_tokens, sum(u) FILTER (WHERE role = 'assistant') AS output_tokens, count(*) AS messages
FROM (SELECT conv_id, role, CASE WHEN turn % 5 = 4 THEN NULL ELSE length(text) END AS u FROM conversations) GROUP BY conv_id""")
def token_usage_by_conv(spark, d):
    """A5: usage of each conversation; unreported stays null."""
    u = F.when(F.col("turn") % 5 != 4, F.length("text").cast("long"))
    return E.token_usage(T.read(spark, d, "conversations").withColumn("tokens", u), "conv_id")


@query("SELECT event_id, CASE WHEN event_id % 4 = 3 THEN 0.0::DOUBLE ELSE least(value, 10.0::DOUBLE) END AS score, event_id % 4 = 3 AS is_error FROM events")
def judge_json_parse(spark, d):
    """judges' replies, whole, fenced, damaged or useless."""
    e, i = T.read(spark, d, "events"), F.col("event_id") % 4
    body = F.concat(F.lit('{"explanation": "fine", "score": '), F.least("value", F.lit(10.0)).cast("string"), F.lit("}"))
    raw = F.when(i == 0, body).when(i == 1, F.concat(F.lit("So:\n```json\n"), body, F.lit("\n```"))).when(i == 2, F.replace(body, F.lit(': "fine'), F.lit(": fine"))).otherwise("no idea")
    g = E.grade(E.parse_reply(raw))
    return e.select("event_id", g["score"].alias("score"), g["is_error"].alias("is_error"))


FACTS = "facts AS (SELECT user_id % 8 AS run, event_type AS mode, event_id % 94 AS question_id, ['correctness', 'relevance', 'groundedness', 'retrieval'][event_id % 4 + 1] AS metric, least(value, 10.0::DOUBLE) AS score, value AS request_time, event_id, user_id FROM events)"
MEANS = f"{FACTS}, means AS (SELECT run, metric, round(avg(score), 6) AS mean_score, count(*) AS n FROM facts GROUP BY ALL)"
OVERALL = f"{FACTS}, overall AS (SELECT run, round(avg(m), 6) AS overall FROM (SELECT run, metric, avg(score) AS m FROM facts GROUP BY ALL) GROUP BY run)"


@query(f"WITH {MEANS} SELECT * FROM means")
def metric_averages(spark, d):
    """Means by run and metric."""
    return E.metric_means(T.facts(spark, d), "run")


@query(f"WITH {OVERALL} SELECT * FROM overall")
def overall_by_config(spark, d):
    """Means of means by run."""
    return E.overall(T.facts(spark, d), "run")


@query(f"""WITH {OVERALL}, r AS (SELECT *, row_number() OVER (ORDER BY overall DESC, run) AS a, row_number() OVER (ORDER BY overall, run DESC) AS b FROM overall)
SELECT 'top' AS side, run, overall FROM r WHERE a <= 3 UNION ALL SELECT 'bottom', run, overall FROM r WHERE b <= 3""")
def top_bottom_configs(spark, d):
    """The three best and the three worst runs."""
    return E.extremes(E.overall(T.facts(spark, d), "run"), "run")


@query(f"""WITH {FACTS}, s AS (SELECT question_id, run, round(avg(m), 6) AS o FROM (SELECT question_id, run, metric, avg(score) AS m FROM facts GROUP BY ALL) GROUP BY ALL)
SELECT question_id, first(run ORDER BY o DESC, run) AS best_run, max(o) AS best, first(run ORDER BY o, run) AS worst_run, min(o) AS worst FROM s GROUP BY question_id""")
def best_worst_per_question(spark, d):
    """Best and worst run for each question."""
    return E.best_and_worst(T.facts(spark, d))


@query(f"""WITH {FACTS}, c AS (SELECT * FROM (SELECT DISTINCT mode, run FROM facts), (SELECT DISTINCT metric FROM facts)), m AS (SELECT mode, run, metric, avg(score) AS m FROM facts GROUP BY ALL)
SELECT mode, metric, round(avg(coalesce(m, 0)), 6) AS mean_score, count(*) AS runs FROM c LEFT JOIN m USING (mode, run, metric) GROUP BY ALL""")
def mode_comparison(spark, d):
    """Means by mode."""
    return E.mode_comparison(T.facts(spark, d))


@query(f"WITH {MEANS} SELECT metric, min(mean_score) AS low, max(mean_score) AS high, round(avg(mean_score), 6) AS mean, round(max(mean_score) - min(mean_score), 6) AS spread FROM means GROUP BY metric")
def metric_statistics(spark, d):
    """A10: range of the runs' means."""
    return E.metric_statistics(T.facts(spark, d))


@query(f"WITH {FACTS} SELECT run, round(avg(request_time), 6) AS mean_s, min(request_time) AS min_s, max(request_time) AS max_s FROM facts GROUP BY run")
def time_by_config(spark, d):
    """Times by run."""
    return E.time_by(T.facts(spark, d), "run")


@query(f"""WITH {FACTS}, t AS (SELECT question_id, mode, round(avg(request_time), 6) AS t FROM facts GROUP BY ALL)
SELECT question_id, round(avg(t), 6) AS mean_s, min(t) AS min_s, max(t) AS max_s, first(mode ORDER BY t, mode) AS fastest, first(mode ORDER BY t DESC, mode) AS slowest FROM t GROUP BY question_id""")
def time_by_question(spark, d):
    """Times by question."""
    return E.time_by_question(T.facts(spark, d))


@query(f"""WITH {FACTS} SELECT run, metric, count(score) AS n, round(quantile_cont(score, 0.25), 6) AS q1, round(quantile_cont(score, 0.5), 6) AS q2, round(quantile_cont(score, 0.75), 6) AS q3 FROM facts GROUP BY ALL""")
def score_quartiles(spark, d):
    """Quartiles by run and metric."""
    return E.quartiles(T.facts(spark, d))


@query(f"""WITH {FACTS}, x AS (SELECT run, metric, score, 'mode' AS dimension, mode AS label FROM facts UNION ALL SELECT run, metric, score, 'level', (question_id % 3)::VARCHAR FROM facts)
SELECT run, metric, dimension, label, round(avg(score), 6) AS mean_score, count(*) AS n FROM x GROUP BY ALL""")
def scores_by_tag(spark, d):
    """Means along dimensions of the questions."""
    return E.by_dimensions(T.facts(spark, d).withColumn("level", F.col("question_id") % 3), ["mode", "level"])


TAGS = """CASE question_id % 4 WHEN 0 THEN ['Easy', 'En', 'howto', 'm' || (question_id % 5)::VARCHAR, 'core'] WHEN 1 THEN ['hard', 'api'] WHEN 2 THEN ['Fr'] ELSE [] END"""


@query(f"""WITH {FACTS}, t AS (SELECT * REPLACE (floor(score) AS score), {TAGS} AS tags FROM facts), r AS (SELECT *, list_filter(tags, lambda x: lower(x) NOT IN ('easy', 'medium', 'hard') AND x NOT IN ('Fr', 'En')) AS others FROM t),
x AS (SELECT run, metric, score, 'difficulty' AS dimension, coalesce(list_filter(tags, lambda x: lower(x) IN ('easy', 'medium', 'hard'))[1], 'unspecified') AS label FROM r
  UNION ALL SELECT run, metric, score, 'language', coalesce(list_filter(tags, lambda x: x IN ('Fr', 'En'))[1], 'unspecified') FROM r
  UNION ALL SELECT run, metric, score, 'type', coalesce(others[1], CASE WHEN len(tags) = 0 THEN 'untagged' ELSE 'unspecified' END) FROM r
  UNION ALL SELECT run, metric, score, 'module', unnest(CASE WHEN len(others) > 1 THEN others[2:] ELSE ['unspecified'] END) FROM r)
SELECT run, metric, dimension, label, round(avg(score), 6) AS mean_score, count(*) AS n FROM x GROUP BY ALL""")
def scores_by_question_tags(spark, d):
    """Means along what the questions' own tags say."""
    i = F.col("question_id") % 4
    tags = F.when(i == 0, F.array(F.lit("Easy"), F.lit("En"), F.lit("howto"), F.concat(F.lit("m"), (F.col("question_id") % 5).cast("string")), F.lit("core")))
    tags = tags.when(i == 1, F.array(F.lit("hard"), F.lit("api"))).when(i == 2, F.array(F.lit("Fr"))).otherwise(F.array().cast("array<string>"))
    return E.by_tags(T.facts(spark, d).withColumns({"tags": tags, "score": F.floor("score").cast("double")}))


@query(f"WITH {FACTS}, m AS (SELECT run, metric, avg(score) AS m FROM facts GROUP BY ALL) SELECT run, metric, round(m - avg(m) OVER (PARTITION BY metric), 6) AS deviation FROM m")
def deviation_matrix(spark, d):
    """Deviation of each run from the mean."""
    return E.deviations(T.facts(spark, d))


@query(f"WITH {OVERALL}, t AS (SELECT run, round(avg(request_time), 6) AS mean_s FROM facts GROUP BY run) SELECT * FROM overall JOIN t USING (run)")
def quality_time_scatter(spark, d):
    """Score and time of each run."""
    return E.quality_and_time(T.facts(spark, d))


@query("""SELECT number, value, best FROM (SELECT event_id AS number, value, max(CASE WHEN event_type <> 'error' THEN value END) OVER (ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS best FROM events) WHERE value IS NOT NULL""")
def best_so_far(spark, d):
    """The best value until each trial."""
    return E.best_so_far(T.trials(spark, d))


@query("SELECT user_id, event_id, row_number() OVER w AS step, round(avg(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING), 9) AS mean_so_far FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)")
def running_mean(spark, d):
    """Running means of each trial."""
    return E.running_mean(T.read(spark, d, "events"), "user_id", "event_id", "value")


@query("""WITH s AS (SELECT user_id AS trial, row_number() OVER w AS step, round(avg(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING), 9) AS m FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
b AS (SELECT *, max(m) OVER (PARTITION BY trial ORDER BY step ROWS UNBOUNDED PRECEDING) AS best_so_far FROM s), c AS (SELECT * FROM b WHERE step >= 10 AND (step % 5 = 0 OR step = (SELECT max(step) FROM s))),
k AS (SELECT x.trial, x.step, round(quantile_cont(y.m, 0.75), 6) AS cut FROM c x LEFT JOIN c y ON x.step = y.step AND x.trial <> y.trial GROUP BY ALL)
SELECT trial, step, best_so_far, cut, coalesce(best_so_far < cut, false) AS pruned FROM c JOIN k USING (trial, step)""")
def percentile_prune(spark, d):
    """Which trials are pruned at which step."""
    m = E.running_mean(T.read(spark, d, "events"), "user_id", "event_id", "value").withColumnRenamed("user_id", "trial")
    return E.prune(m)


@query(ORACLES["percentile_prune"])
def streamed_prune(spark, d):
    """The same decisions from a stream of answers with keyed state."""
    rows = T.read(spark, d, "events").select(F.col("user_id").alias("trial"), F.col("event_id").alias("at"), "value")
    path, out = store.shared_path(spark, "answers"), store.shared_path(spark, "steps")
    rows.write.parquet(path)
    trials.start(spark.readStream.schema(rows.schema).parquet(path), out, store.shared_path(spark, "stream")).awaitTermination()
    return trials.decisions(spark, out)


@query("SELECT user_id AS trial, round(avg(value), 6) AS mean, round(coalesce(stddev_samp(value), 0), 6) AS sd, count(*) AS runs FROM events GROUP BY user_id")
def validation_mean_sd(spark, d):
    """Mean and deviation of repeated runs."""
    return E.validation(T.read(spark, d, "events").select(F.col("user_id").alias("trial"), "value"))


@query("""SELECT mode, k, metric, row_number() OVER (PARTITION BY mode ORDER BY k, metric) AS label FROM (SELECT DISTINCT event_type AS mode FROM events), (SELECT unnest([20, 40, 60]) AS k), (SELECT unnest(['a', 'b']) AS metric)""")
def grid_product(spark, d):
    """All combinations of parameters, numbered within a mode."""
    modes = T.read(spark, d, "events").select(F.col("event_type").alias("mode")).distinct()
    ks, ms = (spark.createDataFrame([(x,) for x in v], f"{n} {t}") for n, t, v in (("k", "int", (20, 40, 60)), ("metric", "string", ("a", "b"))))
    return E.numbered(E.grid(mode=modes, k=ks, metric=ms), "mode", "k", "metric")


@query("""WITH b AS (SELECT conv_id AS query_id, CASE role WHEN 'user' THEN 0 ELSE 1 END AS kind, turn AS seq, 'p' || (length(text) % 3)::VARCHAR || '.html' AS filepath, text AS content FROM conversations),
f AS (SELECT *, row_number() OVER (PARTITION BY query_id, filepath ORDER BY kind, seq) AS k FROM b)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY kind, seq) - 1 AS place, filepath, sha256(content) AS sha256 FROM f WHERE k = 1""")
def source_merge(spark, d):
    """Pages read (here what users said), then sections found, each page once."""
    c = T.read(spark, d, "conversations").select(F.col("conv_id").alias("query_id"), F.col("turn").alias("seq"), F.concat(F.lit("p"), (F.length("text") % 3).cast("string"), F.lit(".html")).alias("filepath"), "text", "role")
    read, found = c.filter("role = 'user'").withColumnRenamed("text", "content"), c.filter("role <> 'user'").withColumnRenamed("text", "section_text")
    return A.merge_sources(read, found).select("query_id", "place", "filepath", F.sha2("content", 256).alias("sha256"))


@query("""WITH s AS (SELECT conv_id AS query_id, turn // 2 AS step, turn % 2 AS rank, 'p' || (length(text) % 3)::VARCHAR AS filepath, CASE WHEN length(text) % 4 = 0 THEN '' ELSE 's' || (length(text) % 4)::VARCHAR END AS section_id FROM conversations)
SELECT query_id, step, rank, filepath, section_id FROM s QUALIFY row_number() OVER (PARTITION BY query_id, CASE WHEN section_id = '' THEN filepath ELSE section_id END ORDER BY step, rank) = 1""")
def sections_seen(spark, d):
    """Of sections found at several steps, each the first time only."""
    n, turn = F.length("text"), F.col("turn")
    section = F.when(n % 4 == 0, "").otherwise(F.concat(F.lit("s"), (n % 4).cast("string")))
    c = T.read(spark, d, "conversations").select(F.col("conv_id").alias("query_id"), F.floor(turn / 2).alias("step"), (turn % 2).alias("rank"), F.concat(F.lit("p"), (n % 3).cast("string")).alias("filepath"), section.alias("section_id"))
    return A.new_sections(c)


@query("""WITH m AS (SELECT string_agg('- ' || source, chr(10) ORDER BY source) AS listed FROM (SELECT DISTINCT source FROM documents WHERE source IS NOT NULL)),
c AS (SELECT item_id, b.text AS question, coalesce(d.text, '') AS context FROM benchmark b LEFT JOIN documents d ON d.doc_id = b.item_id)
SELECT item_id AS query_id, length(p) AS n_chars, sha256(p) AS sha256 FROM (SELECT item_id, 'You answer questions about docs. Its modules:' || chr(10) || listed || chr(10) || chr(10) || 'Rest on the documentation below and on nothing else; say which module and kind of page you cite; say so if it does not hold the answer; decline what is about something else.'
  || chr(10) || chr(10) || 'Documentation:' || chr(10) || context || chr(10) || chr(10) || 'Question: ' || question || chr(10) || chr(10) || 'Answer:' AS p FROM c, m)""")
def prompt_build(spark, d):
    """Prompts with the corpus's modules, a document as context, and the question."""
    docs = T.read(spark, d, "documents")
    modules = [r[0] for r in docs.select("source").filter("source IS NOT NULL").distinct().orderBy("source").collect()]
    q = T.questions(spark, d).join(docs.select(F.col("doc_id").alias("query_id"), F.col("text").alias("context")), "query_id", "left")
    return q.select("query_id", A.prompt(F.col("query"), F.col("context"), "docs", modules).alias("p")).select("query_id", F.length("p").alias("n_chars"), F.sha2("p", 256).alias("sha256"))


@query("""SELECT lpad(doc_id::VARCHAR, 6, '0') AS id, doc_id AS ord, round(length(text) / 7.0::DOUBLE, 3) AS first, 2 AS width FROM documents""")
def vector_index_rows(spark, d):
    """Ids and vectors of chunks, by a stand-in for an embedding model."""
    out = files.vector_index(T.corpus(spark, d).select("ord", "content"), lambda texts: [[round(len(t) / 7, 3), 1.0] for t in texts])
    return out.select("id", "ord", F.round(F.col("embedding")[0].cast("double"), 3).alias("first"), F.size("embedding").alias("width"))


@query("""WITH m AS (SELECT conv_id, turn, text, turn % 3 = 0 AS bare FROM conversations), x AS (SELECT conv_id, turn, text, bare, unnest(['correctness', 'relevance', 'groundedness', 'retrieval_relevance']) AS metric FROM m)
SELECT conv_id * 1000 + turn AS question_id, metric, CASE WHEN bare AND metric IN ('groundedness', 'retrieval_relevance') THEN 0.0::DOUBLE WHEN metric = 'relevance' AND turn % 2 = 0 THEN 0.0::DOUBLE WHEN metric = 'retrieval_relevance' THEN 0.0::DOUBLE ELSE (length(text) % 11)::DOUBLE END AS score,
  CASE WHEN bare AND metric IN ('groundedness', 'retrieval_relevance') THEN 'no documents' WHEN metric = 'relevance' AND turn % 2 = 0 THEN 'error: failed' WHEN metric = 'retrieval_relevance' THEN 'unknown metric: retrieval_relevance' ELSE 'fine' END AS explanation FROM x""")
def judged_metrics(spark, d):
    """K5, K6: four metrics of each answer, by stand-ins for judges, one of which fails at times and one of which is missing."""

    def length(question, answer, reference, documents):
        return {"score": len(answer) % 11, "explanation": "fine"}

    def failing(question, answer, reference, documents):
        if question == "even":
            raise RuntimeError("failed")
        return length(question, answer, reference, documents)

    turn = F.col("turn")
    rows = T.read(spark, d, "conversations").select(
        (F.col("conv_id") * 1000 + turn).alias("question_id"), F.when(turn % 2 == 0, "even").otherwise("odd").alias("question"), F.col("text").alias("answer"), F.lit("r").alias("reference"),
        F.when(turn % 3 == 0, F.array().cast("array<string>")).otherwise(F.array("text")).alias("documents"),
    )
    return E.run_metrics(rows, {"correctness": length, "relevance": failing, "groundedness": length})


@query("""SELECT count(*) AS examples, round(avg(length(text)), 6) AS mean_s, round(avg(CASE WHEN turn % 2 = 0 THEN turn END), 6) AS mean_steps, NULL::DOUBLE AS mean_tokens, round((avg(length(text) % 11) + avg(coalesce(CASE WHEN turn % 3 > 0 THEN turn % 11 END, 0))) / 2, 6) AS overall FROM conversations""")
def run_summary(spark, d):
    """Means over all answers, and of steps and tokens over those that report them."""
    turn, n = F.col("turn"), F.length("text")
    scores = F.create_map(F.lit("a"), (n % 11).cast("double"), F.lit("b"), F.when(turn % 3 > 0, (turn % 11).cast("double")))
    rows = T.read(spark, d, "conversations").select(scores.alias("scores"), n.cast("double").alias("request_time"), F.when(turn % 2 == 0, turn).alias("steps"), F.lit(None).cast("long").alias("tokens"))
    return E.summary(rows).select("examples", "mean_s", "mean_steps", "mean_tokens", "overall")


@query("""WITH t AS (SELECT event_id AS number, value FROM events WHERE event_type <> 'error' AND value IS NOT NULL ORDER BY value DESC, event_id LIMIT 20),
v AS (SELECT event_id % 500 AS trial, avg(value) AS m, stddev_samp(value) AS s, count(*) AS runs FROM events GROUP BY 1)
SELECT number, value, round(m, 6) AS mean, round(coalesce(s, 0), 6) AS sd, runs, row_number() OVER (ORDER BY round(m, 6) DESC NULLS LAST, value DESC, number) AS place FROM (SELECT t.number, t.value, v.m, CASE WHEN v.trial IS NULL THEN NULL ELSE coalesce(v.s, 0) END AS s0, v.s, v.runs FROM t LEFT JOIN v ON t.number = v.trial)""".replace("round(coalesce(s, 0), 6) AS sd", "round(s0, 6) AS sd"))
def validated_trials(spark, d):
    """The twenty best trials, by the mean of their validation runs."""
    runs = T.read(spark, d, "events").select((F.col("event_id") % 500).alias("trial"), "value")
    return E.validated(T.trials(spark, d), runs, 20)


@query(f"WITH {FACTS} SELECT run, metric, question_id, score, event_id FROM facts WHERE question_id IN (SELECT DISTINCT question_id FROM facts ORDER BY question_id LIMIT 10)")
def first_questions(spark, d):
    """T4: facts of the first ten questions."""
    return E.first_groups(T.facts(spark, d), "question_id", 10).select("run", "metric", "question_id", "score", "event_id")


@query("""SELECT b.item_id AS question_id, count(c.turn) AS answers FROM benchmark b LEFT JOIN conversations c ON c.conv_id = b.item_id GROUP BY ALL""")
def dataset_order(spark, d):
    """T5: answers in the dataset's order, questions without one too."""
    a = T.read(spark, d, "conversations").groupBy(F.col("conv_id").alias("question_id")).agg(F.count("*").alias("answers"))
    return E.in_dataset_order(a, T.questions(spark, d).withColumnRenamed("query_id", "question_id")).select("question_id", F.coalesce("answers", F.lit(0)).alias("answers"))


@query("SELECT doc_id, CASE WHEN length(text) > 200 THEN left(text, 200) || '...' ELSE text END AS preview FROM documents")
def answer_preview(spark, d):
    """Previews of sources."""
    return T.read(spark, d, "documents").select("doc_id", C.preview(F.col("text")).alias("preview"))


@query("""WITH s AS (SELECT event_id, floor(value * 10)::INT AS s FROM events) SELECT event_id, CASE WHEN s >= 3600 THEN printf('%dh%02dm%02ds', s // 3600, s % 3600 // 60, s % 60) WHEN s >= 60 THEN printf('%dm%02ds', s // 60, s % 60) ELSE printf('%ds', s) END AS duration FROM s""")
def duration_format(spark, d):
    """seconds as text."""
    return T.read(spark, d, "events").select("event_id", C.duration(F.col("value") * 10).alias("duration"))


@query("SELECT item_id, 'http://x#' || left(regexp_replace(lower(text), '[^\\p{L}\\p{N}_]', '_', 'g'), 50) AS section_id FROM benchmark")
def section_ids(spark, d):
    """slugs of headings."""
    return T.read(spark, d, "benchmark").select("item_id", C.section_id(F.lit("http://x"), F.col("text")).alias("section_id"))


NOT_CALLS = ", ".join(f"'{n}'" for n in sorted(grounding.BUILTINS))


@query(f"""WITH w AS (SELECT doc_id, list_distinct(regexp_extract_all(coalesce(text, ''), '[A-Za-z]{{3,12}}')) AS w FROM documents),
seen AS (SELECT a.doc_id, a.w, coalesce(b.text, '') || coalesce((SELECT string_agg(chr(10) || x || '(x) ' || x || ' ( x, y )', '') FROM (SELECT unnest(list_filter(a.w, lambda x: length(x) = 5)) AS x)), '') AS seen FROM w a LEFT JOIN documents b ON b.doc_id = a.doc_id + 1),
calls AS (SELECT doc_id, unnest(w) AS name, seen FROM seen),
n AS (SELECT doc_id, name, contains(lower(seen), lower(name)) AS known, len(list_distinct(list_transform(regexp_extract_all(seen, name || '\\s*\\(([^()]*)\\)', 1), lambda x: length(x) - length(replace(x, ',', ''))))) AS counts FROM calls WHERE name NOT IN ({NOT_CALLS}))
SELECT doc_id, name AS call, CASE WHEN known THEN 'ambiguous_overload' ELSE 'unknown_name' END AS kind FROM n WHERE NOT known OR counts > 1""")
def grounding_flags(spark, d):
    """An answer calls all words of a document, what was seen is the next document and its own five-letter words with one and two arguments; calls that it doesn't mention, or mentions with several numbers of arguments."""
    w = F.array_distinct(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit("[A-Za-z]{3,12}"), F.lit(0)))
    t = T.read(spark, d, "documents").select("doc_id", w.alias("w"))
    after = T.read(spark, d, "documents").select((F.col("doc_id") - 1).alias("doc_id"), F.col("text").alias("after"))
    answer = F.concat(F.lit("Use:\n```cpp\n"), F.array_join(F.transform("w", lambda x: F.concat(x, F.lit("(1);\n"))), ""), F.lit("```\n"))
    twice = F.transform(F.filter("w", lambda x: F.length(x) == 5), lambda x: F.concat(F.lit("\n"), x, F.lit("(x) "), x, F.lit(" ( x, y )")))
    seen = F.concat(F.coalesce("after", F.lit("")), F.array_join(twice, ""))
    rows = t.join(after, "doc_id", "left").select("doc_id", answer.alias("answer"), seen.alias("observations"))
    return grounding.flags(rows, ["doc_id"]).select("doc_id", "call", "kind")
