"""Files in and out: pages, JSON lines, evaluation runs, message traces, page index."""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.functions.columns import is_generated
from quarry.plans.config import config_hash
from quarry.sources.store import acquire, hadoop, release, stored, with_positions

CHUNK = """title STRING, content STRING, url STRING, doc_type STRING, hierarchy STRING, chunk_id INT, module STRING, doc_category STRING,
metadata STRUCT<parent_doc_id:STRING, chunk_position:STRING, total_chunks:INT, quality_score:DOUBLE, has_code:BOOLEAN, code_blocks:ARRAY<STRING>, section_id:STRING,
section_text:STRING, source:STRING, file:STRING, module_description:STRING, symbol_name:STRING, anchor_id:STRING>"""
QUESTION = "question_id:INT, question:STRING, tags:ARRAY<STRING>, reference_answer:STRING, generated_answer:STRING, evaluations:MAP<STRING,STRUCT<explanation:STRING,score:DOUBLE>>, request_time:DOUBLE"
RUNS = f"""metadata STRUCT<timestamp:STRING,total_questions:INT>, results ARRAY<STRUCT<mode:STRING, configuration:MAP<STRING,STRING>, extraction:MAP<STRING,STRING>,
questions:ARRAY<STRUCT<{QUESTION}>>, average_scores:MAP<STRING,DOUBLE>, average_request_time:DOUBLE>>"""
TRACE = """timestamp STRING, question STRING, metadata MAP<STRING,STRING>, total_tokens BIGINT, messages ARRAY<STRUCT<index:INT, role:STRING, content:STRING,
tool_calls:ARRAY<STRUCT<name:STRING,args:STRING>>, tool_name:STRING, usage:STRUCT<input_tokens:BIGINT,output_tokens:BIGINT>>>"""
PAGE_INDEX = "filepath STRING, filename STRING, title STRING, module STRING, doc_category STRING"


def html_pages(spark: SparkSession, root: str) -> DataFrame:
    """``url, html`` of all pages below a folder that no generator wrote for navigation; bytes that aren't UTF-8 are left out."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.html").load(root)
    base = root.rstrip("/").split(":", 1)[-1].lstrip("/")
    path = F.regexp_replace(F.regexp_replace("path", r"^[a-z0-9]+:/+", "/"), f"^/*{base}/", "")
    return files.select(path.alias("url"), F.replace(F.make_valid_utf8(F.col("content").cast("string")), F.lit("\ufffd"), F.lit("")).alias("html")).filter(~is_generated(F.col("url")))


def chunks(spark: SparkSession, path: str) -> DataFrame:
    """Chunks of JSON lines with ``ord`` from 0, which follows the files' names and the lines in them; blank lines are no rows.

    A file may be read in several splits and a task may read several files, so rows are numbered within their split, and
    the splits, of which one row each is gathered, in the order of their files and starts.
    """
    lines = spark.read.schema(CHUNK).json(path).filter("title IS NOT NULL OR content IS NOT NULL OR url IS NOT NULL")
    lines = lines.select("*", F.col("_metadata.file_path").alias("file_path"), F.col("_metadata.file_block_start").alias("file_start"), F.monotonically_increasing_id().alias("row"))
    splits = lines.groupBy("file_path", "file_start").agg(F.min("row").alias("first"), F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("file_path", "file_start").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = splits.select("file_path", "file_start", (before - F.col("first")).alias("offset"))
    return lines.join(offsets, ["file_path", "file_start"]).withColumn("ord", F.col("row") + F.col("offset")).drop("file_path", "file_start", "row", "offset")


def flat(chunks_: DataFrame) -> DataFrame:
    """Corpus rows from chunks: what is missing is empty, zero or false, but for symbol and anchor."""
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    m = lambda c: F.coalesce(F.col(f"metadata.{c}"), F.lit(""))
    return chunks_.select(
        "ord", text("title").alias("title"), text("content").alias("content"), text("url").alias("url"), text("doc_type").alias("doc_type"), text("hierarchy").alias("hierarchy"),
        F.coalesce("chunk_id", F.lit(0)).alias("chunk_id"), text("module").alias("module"), text("doc_category").alias("doc_category"), m("section_id").alias("section_id"),
        m("chunk_position").alias("chunk_position"), m("file").alias("file"), F.coalesce("metadata.quality_score", F.lit(0.0)).alias("quality_score"),
        F.coalesce("metadata.has_code", F.lit(False)).alias("has_code"), "metadata.symbol_name", "metadata.anchor_id",
    )


def write_corpus(chunks_: DataFrame, path: str) -> None:
    """Chunks as Parquet by module, and as JSON lines beside it."""
    chunks_.write.mode("overwrite").partitionBy("module").parquet(f"{path}/chunks.parquet")
    chunks_.write.mode("overwrite").json(f"{path}/chunks.jsonl")


def publish(lines: DataFrame, path: str, *order: str, first: str = "", last: str = "", between: str = "") -> None:
    """The column ``line`` as one named text file, in the order of ``order``, in place of what is there.

    One task writes all lines, as they come from a sort that may spill; so this is for reports and run files, not for corpora. It is written to a folder beside
    and renamed when it is whole, so that a reader sees the old file or the new one. ``between`` stands at the end of each line but the last.
    """
    spark = lines.sparkSession
    ends = [F.lit(None).cast(lines.schema[c].dataType).alias(c) for c in order]
    rows = lines.select(F.lit(1).alias("__kind"), *order, "line")
    for kind, text in ((0, first), (2, last)):
        if text:
            rows = rows.unionByName(spark.range(1).select(F.lit(kind).alias("__kind"), *ends, F.lit(text).alias("line")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for b in batches:
            out = []
            for kind, line in zip(b["__kind"].to_pylist(), b["line"].to_pylist(), strict=True):
                if held:
                    out.append(held[1] + between if held[0] == kind == 1 else held[1])
                held = kind, line
            yield pa.RecordBatch.from_pydict({"value": out}, schema=pa.schema([("value", pa.string())]))
        if held:
            yield pa.RecordBatch.from_pydict({"value": [held[1]]})

    made = f"{path}.{uuid.uuid4().hex}"
    one = rows.repartition(1).sortWithinPartitions("__kind", *order)
    one.select("__kind", "line").mapInArrow(run, "value string").write.text(made)
    files, at = hadoop(spark, path)
    parts = files.globStatus(at(f"{made}/part-*"))
    files.delete(at(path), True)
    if not files.rename(parts[0].getPath(), at(path)):
        raise OSError(f"{path}: could not be put in place")
    files.delete(at(made), True)


def json_list(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """``file, record, pos`` and the columns of ``schema`` for each element of the JSON lists, or lines, in files; a missing path is an error at once.

    Long lists are read in several splits. A string can't go on in the next line, so a line's brackets can be counted by itself; running
    sums over the splits give the depth at which each line begins, and lines from one at the list's own depth to the next belong to the same elements. What
    isn't JSON gives a row of nulls, with its text in ``_bad``.
    """
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("row"))
    bare = F.regexp_replace("value", r'"(?:[^"\\]|\\.)*"?', "")
    count = lambda c: F.length(bare) - F.length(F.translate(bare, c, ""))
    lines = stored(lines.withColumn("turn", count("[{") - count("]}")), "json-lines")
    in_split = Window.partitionBy("file", "split").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)
    splits_before = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)

    def running(rows: DataFrame, what: str, name: str) -> DataFrame:
        """The sum of a column over all lines of the file before."""
        sums = rows.groupBy("file", "split").agg(F.sum(what).alias("s"))
        sums = sums.select("file", "split", F.coalesce(F.sum("s").over(splits_before), F.lit(0)).alias("s"))
        return rows.join(sums, ["file", "split"]).withColumn(name, F.col("s") + F.coalesce(F.sum(what).over(in_split), F.lit(0))).drop("s")

    lines = running(lines, "turn", "depth").withColumn("opens", (F.col("depth") <= 1).cast("int"))
    lines = running(lines, "opens", "before").withColumn("record", F.col("before") + F.col("opens"))
    parts = F.array_sort(F.collect_list(F.struct("split", "row", "value", "depth", "turn")))
    whole = lines.groupBy("file", "record").agg(parts.alias("p"))
    text = F.array_join(F.col("p.value"), "\n")
    text = F.when(F.col("p")[0]["depth"] == 0, F.regexp_replace(text, r"^\s*\[", "")).otherwise(text)
    end = F.element_at("p", -1)
    whole = whole.select("file", "record", text.alias("text"), ((end["depth"] + end["turn"] == 0) & F.rtrim(end["value"]).endswith("]")).alias("ends"))
    body = F.when(F.col("ends"), F.regexp_replace("text", r"\]\s*$", "")).otherwise(F.col("text"))
    whole = whole.withColumn("text", F.regexp_replace(body, r"^[\s,]+|[\s,]+$", "")).filter("text <> ''")
    read = F.from_json(F.concat(F.lit("["), F.col("text"), F.lit("]")), f"array<struct<{_fields(schema)}>>")
    rows = whole.select("file", "record", "text", F.posexplode_outer(read).alias("pos", "e"))
    return rows.select("file", "record", F.coalesce("pos", F.lit(0)).alias("pos"), "e.*", F.when(F.col("e").isNull(), F.col("text")).alias("_bad"))


def _fields(schema: str) -> str:
    """A table's columns as the fields of a struct."""
    from pyspark.sql.types import StructType

    return ", ".join(f"`{f.name}`: {f.dataType.simpleString()}" for f in StructType.fromDDL(schema))


#: Seconds after which the lock of a builder that died may be taken, and between two looks at it.
STALE, LOOK = 3600.0, 0.2


def built_once(spark: SparkSession, folder: str, settings: dict, build: Callable[[], DataFrame]) -> DataFrame:
    """The corpus that ``build`` makes for these settings, from the folder named by their hash if it is there already.

    Only one builder gets the lock beside it: others wait until the corpus is there, and don't build. A lock older than ``STALE`` is
    taken over. The corpus is written to a folder of its own first and then renamed, so it is whole or not there.
    """
    path = f"{folder.rstrip('/')}/{config_hash(settings)}"
    files, at = hadoop(spark, path)
    while not files.exists(at(path)):
        if not acquire(spark, f"{path}.lock", STALE):
            time.sleep(LOOK)
            continue
        try:
            if not files.exists(at(path)):
                made = f"{path}.{uuid.uuid4().hex}"
                build().write.parquet(made)
                if not files.rename(at(made), at(path)):
                    raise OSError(f"{path}: could not be put in place")
        finally:
            release(spark, f"{path}.lock")
    return spark.read.parquet(path)


def write_sections(chunks_: DataFrame, name: str, buckets: int = 64) -> DataFrame:
    """The corpus as table ``name`` in the warehouse, in ``buckets`` by section: what asks for sections of it, or puts them together, doesn't move it.

    A section is a few chunks, so no bucket gets much more than others; chunks without a section are spread by their number.
    """
    by = F.coalesce(F.nullif("section_id", F.lit("")), F.concat(F.lit("\x00"), F.col("ord").cast("string")))
    rows = chunks_.withColumn("section_key", by)
    rows.repartition(buckets, "section_key").write.mode("overwrite").bucketBy(buckets, "section_key").sortBy("section_key", "ord").saveAsTable(name)
    return chunks_.sparkSession.table(name)


def write_statistics(stats: DataFrame, path: str) -> None:
    """``statistics.json``: from :func:`quarry.operators.evaluation.module_statistics`, one JSON object with the total and, by module, its counts and description."""
    counts = [c for c in stats.columns if c not in ("module", "description", "total")]
    own = F.struct(F.col("total").alias("total_chunks"), *[F.col(c).alias(f"{c}_chunks") for c in counts], F.coalesce("description", F.lit("")).alias("description"))
    total = F.max(F.when(F.col("module").isNull(), F.col("total"))).alias("total_chunks")
    modules = F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col("module").isNotNull(), F.struct("module", own.alias("s")))))).alias("modules")
    publish(stats.agg(total, modules).select(F.to_json(F.struct("total_chunks", "modules")).alias("line")), path)


def vector_index(chunks_: DataFrame, embed: Callable[[list[str]], list[list[float]]] | None = None) -> DataFrame:
    """``id, embedding`` and the chunk's columns: ids are places in the corpus with six digits at least, ``embed`` gets batches of texts.

    Without ``embed`` the rows have a null embedding, for a model that runs elsewhere.
    """
    rows = chunks_.withColumn("id", F.when(F.col("ord") < 1_000_000, F.lpad(F.col("ord").cast("string"), 6, "0")).otherwise(F.col("ord").cast("string")))
    if embed is None:
        return rows.withColumn("embedding", F.lit(None).cast("array<float>"))
    names = rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in (whole.slice(i, 100) for i in range(0, whole.num_rows, 100)):
                made = embed([x or "" for x in b["content"].to_pylist()])
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(made, pa.list_(pa.float32()))], [*names, "embedding"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(run, f"{schema}, embedding array<float>")


def write_vector_index(chunks_: DataFrame, path: str, embed: Callable[[list[str]], list[list[float]]] | None = None) -> None:
    """The vector index as Parquet by module, in place of what is there."""
    vector_index(chunks_, embed).write.mode("overwrite").partitionBy("module").parquet(path)


def write_page_index(pages: DataFrame, path: str) -> None:
    """``filepath, filename, title, module, doc_category`` of each page as JSON lines."""
    pages.select("filepath", "filename", "title", "module", "doc_category").write.mode("overwrite").json(path)


def page_index(spark: SparkSession, path: str) -> DataFrame:
    """The page index with ``ord``, its rows' order, from a JSON list or JSON lines. A missing one is a FileNotFoundError, one that isn't JSON a ValueError."""
    try:
        rows = json_list(spark, path, PAGE_INDEX)
    except AnalysisException as e:
        raise FileNotFoundError(path) from e
    rows = with_positions(rows, "file", "record", "pos")
    if rows.filter("_bad IS NOT NULL OR filepath IS NULL").limit(1).collect():
        raise ValueError(f"{path}: not a page index")
    return rows.select("filepath", "filename", "title", "module", "doc_category", "ord")


def write_results(rows: DataFrame, folder: str, prefix: str, stamp: str, *order: str) -> str:
    """Runs as ``<folder>/<prefix>_<stamp>.json``, one JSON object ``{metadata, results}`` with a run on each line; the path.

    ``rows`` have the fields of a run as columns: ``mode, configuration, extraction, questions``, and averages if there are any; without ``order`` their own order is kept.
    """
    path = f"{folder.rstrip('/')}/{prefix}_{stamp}.json"
    rows = rows if order else rows.withColumn("__at", F.monotonically_increasing_id())
    fields = [c for c in rows.columns if c != "__at"]
    lines = rows.select(*(order or ("__at",)), F.to_json(F.struct(*fields)).alias("line"))
    questions = rows.select(F.max(F.size("questions"))).head()[0] if "questions" in fields else 0
    about = json.dumps({"timestamp": stamp, "total_questions": max(0, questions or 0)})
    publish(lines, path, *(order or ("__at",)), first=f'{{"metadata": {about}, "results": [', last="]}", between=",")
    return path


def runs_of(facts: DataFrame) -> DataFrame:
    """The runs of facts ``run, mode, configuration, question_id, question, tags, metric, score, explanation, request_time``, one row each with its questions, averages by metric, and mean time."""
    one = F.map_from_entries(F.array_sort(F.collect_list(F.struct("metric", F.struct("explanation", "score")))))
    asked = facts.groupBy("run", "mode", "configuration", "question_id").agg(F.first("question").alias("question"), F.first("tags").alias("tags"), one.alias("evaluations"), F.first("request_time").alias("request_time"))
    by_id = lambda a, b: F.when(a["question_id"] < b["question_id"], -1).when(a["question_id"] > b["question_id"], 1).otherwise(0)
    listed = F.array_sort(F.collect_list(F.struct("question_id", "question", "tags", "evaluations", "request_time")), by_id)
    runs = asked.groupBy("run", "mode", "configuration").agg(listed.alias("questions"), F.avg("request_time").alias("average_request_time"))
    means = facts.groupBy("run", "metric").agg(F.avg(F.coalesce("score", F.lit(0.0))).alias("m")).groupBy("run").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("metric", "m")))).alias("average_scores"))
    return runs.join(means, "run")


def serialised(messages: DataFrame) -> DataFrame:
    """One trace for each run from ``run, timestamp, question, metadata, index, role, content, tool_calls, tool_name, usage``: messages in order, and their tokens in all (null if none reports any)."""
    used = F.col("usage.input_tokens") + F.col("usage.output_tokens")
    one = F.struct(*[F.col(c) for c in ("index", "role", "content", "tool_calls", "tool_name", "usage")])
    return messages.groupBy("run", "timestamp", "question", "metadata").agg(F.sum(used).alias("total_tokens"), F.array_sort(F.collect_list(F.struct(F.col("index").alias("at"), one.alias("m")))).alias("m")).select(
        "timestamp", "question", "metadata", "total_tokens", F.transform("m", lambda x: x["m"]).alias("messages")
    )


def write_traces(traces_: DataFrame, folder: str) -> None:
    """Traces as JSON lines, a folder ``trace_<timestamp>.json`` for each timestamp."""
    name = F.concat(F.lit("trace_"), F.col("timestamp"), F.lit(".json"))
    traces_.withColumn("trace", name).write.mode("append").partitionBy("trace").json(folder)


def _label(configuration: str, extraction: str):
    """The configuration's label, which includes the extraction's."""
    entries = lambda c: F.array_join(F.transform(F.map_entries(c), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ", ")
    label = F.concat_ws("; ", F.nullif(entries(F.col(configuration)), F.lit("")), F.nullif(entries(F.col(extraction)), F.lit("")))
    return F.coalesce(F.nullif(label, F.lit("")), F.lit("default"))


def _runs(spark: SparkSession, path: str) -> DataFrame:
    """``file, timestamp, total_questions, run, r``: a row for each run of each file. A file is one record, read by one task."""
    r = spark.read.schema(RUNS).option("multiLine", True).json(path).select(F.col("_metadata.file_name").alias("file"), "metadata.timestamp", "metadata.total_questions", F.posexplode("results").alias("run", "r"))
    return r


def run_facts(spark: SparkSession, path: str) -> DataFrame:
    """Facts from run files: one row for each metric of each answer."""
    q = _runs(spark, path).select("file", "run", F.col("r.mode").alias("mode"), _label("r.configuration", "r.extraction").alias("config"), F.explode("r.questions").alias("q"))
    rows = q.select("file", "run", "mode", "config", "q.question_id", "q.tags", "q.request_time", F.explode_outer("q.evaluations").alias("metric", "g"))
    return rows.select("file", "run", "mode", "config", "question_id", "tags", "metric", F.col("g.score").alias("score"), F.col("g.explanation").alias("explanation"), "request_time")


def compare(spark: SparkSession, folder: str, prefix: str = "benchmark_") -> DataFrame:
    """``file, timestamp, total_questions, run, mode, config, overall`` of all run files of a folder: overall is the mean of a run's averages, 0 where it has none."""
    r = _runs(spark, f"{folder.rstrip('/')}/{prefix}*.json")
    values = F.map_values("r.average_scores")
    mean = F.aggregate(values, F.lit(0.0), lambda s, x: s + F.coalesce(x, F.lit(0.0))) / F.size(values)
    overall = F.coalesce(F.when(F.size(values) > 0, F.round(mean, 6)), F.lit(0.0))
    return r.select("file", "timestamp", "total_questions", "run", F.col("r.mode").alias("mode"), _label("r.configuration", "r.extraction").alias("config"), overall.alias("overall"))


def listed(spark: SparkSession, folder: str, prefix: str) -> list[str]:
    """The paths of a folder's run files by name, the last first."""
    files, at = hadoop(spark, folder)
    found = files.globStatus(at(f"{folder.rstrip('/')}/{prefix}*.json")) or []
    return sorted((f.getPath().toString() for f in found if f.isFile()), reverse=True)


def latest(spark: SparkSession, folder: str, prefix: str) -> str | None:
    """The path of the last of a folder's files by name that begin with ``prefix``."""
    return next(iter(listed(spark, folder, prefix)), None)


def traces(spark: SparkSession, path: str) -> DataFrame:
    """Traces of a folder, one a file, in the order of their timestamps."""
    return spark.read.schema(TRACE).option("recursiveFileLookup", True).option("multiLine", True).json(path).filter("timestamp IS NOT NULL").orderBy("timestamp")


def questions(spark: SparkSession, path: str, limit: int | None = None, seed: int | None = None) -> DataFrame:
    """Evaluation examples of a JSON list, numbered from 1; the first ``limit`` are taken before they are shuffled. ``place`` is their order."""
    e = with_positions(json_list(spark, path, "inputs STRUCT<question:STRING>, outputs STRUCT<answer:STRING>, tags ARRAY<STRING>"), "file", "record", "pos")
    e = e.select("inputs", "outputs", "tags", (F.col("ord") + 1).alias("question_id"))
    e = e if limit is None else e.filter(F.col("question_id") <= limit)
    if seed is None:
        return e.withColumn("place", F.col("question_id") - 1)
    return with_positions(e, F.xxhash64(F.lit(seed), F.col("question_id")), "question_id", name="place")
