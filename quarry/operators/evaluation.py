"""Analytics over evaluation runs.

Facts are rows ``run, mode, question_id, metric, score, request_time`` (one for each metric of an answer), trials rows ``number, state, value``.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.columns import tag_dimensions

#: A side of at most so many rows is broadcast.
FEW = 10_000
P = 6


def small(frame: DataFrame) -> DataFrame:
    """A frame to broadcast if it has few rows."""
    return F.broadcast(frame) if frame.limit(FEW + 1).count() <= FEW else frame



def metric_means(facts: DataFrame, *by: str) -> DataFrame:
    """Mean of each metric; a missing score counts 0."""
    return facts.groupBy(*by, "metric").agg(F.round(F.avg(F.coalesce("score", F.lit(0.0))), P).alias("mean_score"), F.count("*").alias("n"))


def overall(facts: DataFrame, *by: str) -> DataFrame:
    """Unweighted mean of the metrics' means."""
    first = facts.groupBy(*by, "metric").agg(F.avg(F.coalesce("score", F.lit(0.0))).alias("m"))
    return first.groupBy(*by).agg(F.round(F.avg("m"), P).alias("overall"))


def extremes(scored: DataFrame, by: str, n: int = 3) -> DataFrame:
    """The ``n`` best and the ``n`` worst of (by, overall); the two sets overlap where there are few."""
    up, down = [F.col("overall").desc(), F.col(by)], [F.col("overall"), F.col(by).desc()]
    end = lambda name, order: scored.orderBy(*order).limit(n).select(F.lit(name).alias("side"), by, "overall")
    return end("top", up).unionByName(end("bottom", down))


def top_trials(trials: DataFrame, k: int) -> DataFrame:
    """The ``k`` completed trials with the highest values, the first of equals; each task keeps no more than ``k``."""
    return trials.filter((F.col("state") == "COMPLETE") & F.col("value").isNotNull()).orderBy(F.col("value").desc(), "number").limit(k)


def validated(trials: DataFrame, runs: DataFrame, k: int) -> DataFrame:
    """``number, value, mean, sd, runs`` of the ``k`` best trials, by the mean of their validation runs ``(trial, value)``, those without any last."""
    out = top_trials(trials, k).join(validation(runs).withColumnRenamed("trial", "number"), "number", "left")
    place = Window.orderBy(F.col("mean").desc_nulls_last(), F.col("value").desc(), "number")
    return out.select("number", "value", "mean", "sd", "runs", F.row_number().over(place).alias("place"))


def module_statistics(chunks: DataFrame, registered: DataFrame, categories: tuple[str, ...] = ("dev", "user", "methodology")) -> DataFrame:
    """A row for each registered ``(module, description)``, those without chunks too, with its chunks by category and in all, and one in all with a null module."""
    counts = [F.count_if(F.col("doc_category") == c).alias(c) for c in categories]
    found = chunks.groupBy(F.col("module").alias("c_module")).agg(*counts, F.count("*").alias("total"))
    names = [*categories, "total"]
    each = registered.join(found, F.col("module") == F.col("c_module"), "left").select("module", "description", *[F.coalesce(c, F.lit(0)).alias(c) for c in names])
    whole = found.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in names]).select(F.lit(None).cast("string").alias("module"), F.lit(None).cast("string").alias("description"), *names)
    return each.unionByName(whole)


def token_usage(messages: DataFrame, by: str) -> DataFrame:
    """Tokens of each conversation from ``(<by>, role, tokens)``, in all and by side; null where no message reports any."""
    side = lambda r: F.sum(F.when(F.col("role") == r, F.col("tokens")))
    return messages.groupBy(by).agg(F.sum("tokens").alias("total_tokens"), side("user").alias("input_tokens"), side("assistant").alias("output_tokens"), F.count("*").alias("messages"))


def numbered(rows: DataFrame, within: str, *order: str) -> DataFrame:
    """Rows with ``label``, their number within a mode."""
    return rows.withColumn("label", F.row_number().over(Window.partitionBy(within).orderBy(*order)))


def first_groups(rows: DataFrame, by: str, n: int) -> DataFrame:
    """The rows of the first ``n`` values of a column, as a plot shows them."""
    return rows.join(F.broadcast(rows.select(by).distinct().orderBy(by).limit(n)), by, "left_semi")


def in_dataset_order(answers: DataFrame, dataset: DataFrame) -> DataFrame:
    """Answers, made in any order, in that of the dataset: of its ``place``, where it was shuffled, else of ``question_id``; questions without an answer are rows of nulls."""
    if "place" not in dataset.columns:
        return dataset.select("question_id").join(answers, "question_id", "left").orderBy("question_id")
    return dataset.select("question_id", F.col("place").alias("__place")).join(answers, "question_id", "left").orderBy("__place").drop("__place")


def summary(answers: DataFrame) -> DataFrame:
    """One row over ``(scores map, request_time, steps, tokens)``: means of metrics and time over all answers, of steps and tokens over those that report them (null if none does)."""
    metrics = answers.select(F.explode("scores").alias("metric", "score")).groupBy("metric").agg(F.avg(F.coalesce("score", F.lit(0.0))).alias("m"))
    by_metric = metrics.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("metric", F.round("m", P))))).alias("averages"), F.round(F.avg("m"), P).alias("overall"))
    rest = answers.agg(F.count("*").alias("examples"), F.round(F.avg("request_time"), P).alias("mean_s"), F.round(F.avg("steps"), P).alias("mean_steps"), F.round(F.avg("tokens"), P).alias("mean_tokens"))
    return rest.crossJoin(by_metric)


#: The metrics, and those that are graded by retrieved documents.
METRICS = ("correctness", "relevance", "groundedness", "retrieval_relevance")
BY_DOCUMENTS = ("groundedness", "retrieval_relevance")


def batched(judge):
    """Marks a judge that gets whole batches: lists of questions, answers, references and documents, for a list of mappings."""
    judge.batched = True
    return judge


def run_metrics(answers: DataFrame, judges: dict, metrics: tuple[str, ...] = METRICS, size: int = 64) -> DataFrame:
    """``question_id, metric, score, explanation`` from ``(question_id, question, answer, reference, documents array<string>)``.

    A judge is a function from ``(question, answer, reference, documents)`` to a mapping with score and explanation, or one marked by :func:`batched`, which
    gets ``size`` answers at a time. What is graded by documents gets 0 without a call where there are none; a judge that fails, or gives no
    number from 0 to 10, gives 0 with the reason (for all of its batch if the whole call fails); an unknown metric, too.
    """
    rows = answers.select("question_id", "question", "answer", "reference", "documents")

    def one_by_one(judge):
        def run(*lists):
            for args in zip(*lists, strict=True):
                try:
                    yield judge(*args)
                except Exception as e:  # a judge is a model behind a network
                    yield e

        return run

    def checked(made) -> tuple[float, str]:
        try:
            if isinstance(made, Exception):
                raise made
            score = float(made["score"])
            return (score, str(made.get("explanation") or "")) if 0 <= score <= 10 else (0.0, "no usable grade")
        except Exception as e:
            return 0.0, f"error: {e}"

    def graded(metric: str, batch: list[dict]) -> list[tuple[float, str]]:
        if metric not in judges:
            missing = 0.0, f"unknown metric: {metric}"
            return [(0.0, "no documents") if metric in BY_DOCUMENTS and not r["documents"] else missing for r in batch]
        asked = [r for r in batch if metric not in BY_DOCUMENTS or r["documents"]]
        judge = judges[metric] if getattr(judges[metric], "batched", False) else one_by_one(judges[metric])
        try:
            made = list(judge(*([r[c] for r in asked] for c in ("question", "answer", "reference")), [r["documents"] or [] for r in asked])) if asked else []
            if len(made) != len(asked):
                raise ValueError("another number of grades than answers")
        except Exception as e:
            made = [e] * len(asked)
        given = iter(made)
        return [checked(next(given)) if metric not in BY_DOCUMENTS or r["documents"] else (0.0, "no documents") for r in batch]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in (whole.slice(i, size) for i in range(0, whole.num_rows, size)):
                batch = b.to_pylist()
                made = [(r["question_id"], m, *g) for m in metrics for r, g in zip(batch, graded(m, batch), strict=True)]
                kinds = [b.schema.field("question_id").type, pa.string(), pa.float64(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in made], t) for i, t in enumerate(kinds)], ["question_id", "metric", "score", "explanation"])

    return rows.mapInArrow(run, f"question_id {rows.schema['question_id'].dataType.simpleString()}, metric string, score double, explanation string")


def best_and_worst(facts: DataFrame) -> DataFrame:
    """For each question the first run with the highest and the first with the lowest overall score."""
    s = overall(facts, "question_id", "run")
    return s.groupBy("question_id").agg(
        F.min_by("run", F.struct(-F.col("overall"), "run")).alias("best_run"), F.max("overall").alias("best"),
        F.min_by("run", F.struct("overall", "run")).alias("worst_run"), F.min("overall").alias("worst"),
    )


def mode_comparison(facts: DataFrame) -> DataFrame:
    """Mean over a mode's runs of the runs' means by metric; a run without a metric counts 0 for it."""
    runs = facts.select("mode", "run").distinct().crossJoin(small(facts.select("metric").distinct()))
    means = facts.groupBy("mode", "run", "metric").agg(F.avg(F.coalesce("score", F.lit(0.0))).alias("m"))
    joined = runs.join(means, ["mode", "run", "metric"], "left")
    return joined.groupBy("mode", "metric").agg(F.round(F.avg(F.coalesce("m", F.lit(0.0))), P).alias("mean_score"), F.count("*").alias("runs"))


def metric_statistics(facts: DataFrame) -> DataFrame:
    """Range and mean of the runs' means, by metric."""
    m = metric_means(facts, "run")
    return m.groupBy("metric").agg(F.min("mean_score").alias("low"), F.max("mean_score").alias("high"), F.round(F.avg("mean_score"), P).alias("mean"), F.round(F.max("mean_score") - F.min("mean_score"), P).alias("spread"))


def time_by(facts: DataFrame, by: str) -> DataFrame:
    return facts.groupBy(by).agg(F.round(F.avg("request_time"), P).alias("mean_s"), F.min("request_time").alias("min_s"), F.max("request_time").alias("max_s"))


def time_by_question(facts: DataFrame) -> DataFrame:
    """Times of each question, with the fastest and the slowest mode (the first in order where equal)."""
    t = facts.groupBy("question_id", "mode").agg(F.avg("request_time").alias("raw")).withColumn("t", F.round("raw", P))
    return t.groupBy("question_id").agg(
        F.round(F.avg("t"), P).alias("mean_s"), F.min("t").alias("min_s"), F.max("t").alias("max_s"),
        F.min_by("mode", F.struct("t", "mode")).alias("fastest"), F.min_by("mode", F.struct(-F.col("t"), "mode")).alias("slowest"),
    )


def quartiles(facts: DataFrame) -> DataFrame:
    """Quartiles of the scores by run and metric, interpolated; exact, so a group's different scores are held together. :func:`score_sketches` are for groups beyond that."""
    q = F.percentile("score", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    return facts.groupBy("run", "metric").agg(q.alias("q"), F.count("score").alias("n")).select("run", "metric", "n", *[F.round(F.col("q")[i], P).alias(f"q{i + 1}") for i in range(3)])


#: Size parameter of quantile sketches, and the share of a group by which the rank of their quantiles is off at most (with a probability of 99 %).
SKETCH, RANK_ERROR = 800, 0.0043


def score_sketches(facts: DataFrame, *by: str) -> DataFrame:
    """``<by>, sketch, n``: a mergeable sketch of each group's scores, of bounded size however many there are; sketches of parts are put together by :func:`merged_sketches`."""
    known = facts.filter(F.col("score").isNotNull())
    return known.groupBy(*by).agg(F.kll_sketch_agg_double(F.col("score").cast("double"), F.lit(SKETCH)).alias("sketch"), F.count("*").alias("n"))


def merged_sketches(sketches: DataFrame, *by: str) -> DataFrame:
    """The sketches of coarser groups."""
    return sketches.groupBy(*by).agg(F.kll_merge_agg_double("sketch", F.lit(SKETCH)).alias("sketch"), F.sum("n").alias("n"))


def sketched_quartiles(sketches: DataFrame) -> DataFrame:
    """``q1, q2, q3`` of each sketch: values whose rank is within ``RANK_ERROR`` of the quartile's."""
    q = [F.kll_sketch_get_quantile_double("sketch", F.lit(p)).alias(f"q{i + 1}") for i, p in enumerate((0.25, 0.5, 0.75))]
    return sketches.select(*[c for c in sketches.columns if c != "sketch"], *q)


def by_dimensions(facts: DataFrame, dimensions: list[str]) -> DataFrame:
    """Mean scores by run and metric along each dimension, all in one pass over the facts."""
    sides = F.explode(F.array(*[F.struct(F.lit(d).alias("dimension"), F.col(d).cast("string").alias("label")) for d in dimensions]))
    rows = facts.select("run", "metric", "score", sides.alias("d"))
    return rows.groupBy("run", "metric", "d.dimension", "d.label").agg(F.round(F.avg(F.coalesce("score", F.lit(0.0))), P).alias("mean_score"), F.count("*").alias("n"))


def by_tags(facts: DataFrame) -> DataFrame:
    """Mean scores by run and metric along what the questions' ``tags`` say: difficulty, language, type, and each of their modules."""
    d = tag_dimensions(F.col("tags"))
    one = [F.struct(F.lit(c).alias("dimension"), d[c].alias("label")) for c in ("difficulty", "language", "type")]
    modules = F.transform(d["modules"], lambda m: F.struct(F.lit("module").alias("dimension"), m.alias("label")))
    rows = facts.select("run", "metric", "score", F.explode(F.concat(F.array(*one), modules)).alias("d"))
    return rows.groupBy("run", "metric", "d.dimension", "d.label").agg(F.round(F.avg(F.coalesce("score", F.lit(0.0))), P).alias("mean_score"), F.count("*").alias("n"))


def deviations(facts: DataFrame) -> DataFrame:
    """How far each run's mean is from the mean of all runs, by metric; rounded at the end only."""
    m = facts.groupBy("run", "metric").agg(F.avg(F.coalesce("score", F.lit(0.0))).alias("m"))
    return m.select("run", "metric", F.round(F.col("m") - F.avg("m").over(Window.partitionBy("metric")), P).alias("deviation"))


def quality_and_time(facts: DataFrame) -> DataFrame:
    return overall(facts, "run").join(time_by(facts, "run").select("run", "mean_s"), "run")


def best_so_far(trials: DataFrame) -> DataFrame:
    """For each trial with a value, the best value of the trials completed until then.

    Bests of ranges of a thousand trials come first, so no window sees more than one range or all the ranges' bests.
    """
    lot = trials.withColumn("lot", F.floor(F.col("number") / 1000)).withColumn("v", F.when(F.col("state") == "COMPLETE", F.col("value")))
    tops = lot.groupBy("lot").agg(F.max("v").alias("top"))
    tops = tops.select("lot", F.max("top").over(Window.orderBy("lot").rowsBetween(Window.unboundedPreceding, -1)).alias("before"))
    inside = Window.partitionBy("lot").orderBy("number").rowsBetween(Window.unboundedPreceding, 0)
    out = lot.join(tops, "lot").withColumn("best", F.greatest("before", F.max("v").over(inside)))
    return out.filter(F.col("value").isNotNull()).select("number", "value", "best")


def running_mean(facts: DataFrame, by: str, order: str, value: str) -> DataFrame:
    """The mean of the values until each step of each trial."""
    upto = Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return facts.select(by, order, F.row_number().over(Window.partitionBy(by).orderBy(order)).alias("step"), F.round(F.avg(value).over(upto), 9).alias("mean_so_far"))


def prune(steps: DataFrame, *, keep_top_pct: float = 25.0, first: int = 10, interval: int = 5) -> DataFrame:
    """``trial, step, best_so_far, cut, pruned`` of ``(trial, step, mean_so_far)``: from ``first`` on at each ``interval``-th step, and at the last of
    all, a trial whose best value until then is below the share to keep of the other trials' values at the step is pruned; without others none is.
    """
    upto = Window.partitionBy("trial").orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    last = steps.agg(F.max("step").alias("last"))
    s = steps.withColumn("best_so_far", F.max("mean_so_far").over(upto)).crossJoin(F.broadcast(last))
    s = s.filter((F.col("step") >= first) & ((F.col("step") % interval == 0) | (F.col("step") == F.col("last")))).drop("last")
    # the percentile of the others' sorted values: those from a trial's own place on move down by one
    at = Window.partitionBy("step").orderBy("mean_so_far", "trial")
    s = s.withColumns({"i": F.row_number().over(at) - 1, "n": F.count("*").over(Window.partitionBy("step"))})
    s = s.withColumn("h", (1 - keep_top_pct / 100) * (F.col("n") - 2)).withColumn("lo", F.floor("h").cast("int"))
    near = [F.max(F.when(F.col("i") == F.col("lo") + k, F.col("mean_so_far"))).alias(f"s{k}") for k in range(3)]
    s = s.join(s.groupBy(F.col("step").alias("c_step")).agg(*near), F.col("step") == F.col("c_step"))
    low = F.when(F.col("lo") < F.col("i"), F.col("s0")).otherwise(F.col("s1"))
    high = F.coalesce(F.when(F.col("lo") + 1 < F.col("i"), F.col("s1")).otherwise(F.col("s2")), low)
    cut = F.when(F.col("n") > 1, F.round(low + (F.col("h") - F.col("lo")) * (high - low), P))
    return s.withColumn("cut", cut).select("trial", "step", "best_so_far", "cut", F.coalesce(F.col("best_so_far") < F.col("cut"), F.lit(False)).alias("pruned"))


def validation(runs: DataFrame) -> DataFrame:
    """Mean and sample deviation of a candidate's repeated runs; 0 for a single run."""
    return runs.groupBy("trial").agg(F.round(F.avg("value"), P).alias("mean"), F.round(F.coalesce(F.stddev_samp("value"), F.lit(0.0)), P).alias("sd"), F.count("*").alias("runs"))


def grid(**choices: DataFrame) -> DataFrame:
    """All combinations of the parameters' values; without parameters, one empty one."""
    out = None
    for frame in choices.values():
        out = frame if out is None else out.crossJoin(small(frame))
    if out is None:
        raise ValueError("a grid needs the session: give it at least one parameter")
    return out


def parse_reply(raw, schema: str = "explanation string, score string"):
    """A judge's reply as a struct: whole, from a fenced block, or with the explanation's missing quote put in; else its ``content``, as it came."""
    fenced = F.regexp_extract(raw, r"(?s)```(?:json)?\s*(\{.*?\})\s*```", 1)
    repaired = F.regexp_replace(raw, r'"explanation"\s*:\s*(?!")', '"explanation": "')
    read = lambda c: F.from_json(c, schema)
    ok = lambda s: F.when(s["score"].isNotNull() | s["explanation"].isNotNull(), s)
    raw_only = F.from_json(F.to_json(F.struct(raw.alias("content"))), f"{schema}, content string")
    found = F.coalesce(ok(read(raw)), ok(read(fenced)), ok(read(repaired)))
    return F.coalesce(found.withField("content", F.lit(None).cast("string")), raw_only)


def grade(reply):
    """Score from 0 to 10 and whether it had to be made up: what is missing or no number counts 0 and is marked."""
    score = reply["score"].try_cast("double")
    return F.struct(F.coalesce(score, F.lit(0.0)).alias("score"), score.isNull().alias("is_error"), F.coalesce(reply["explanation"], F.lit("no usable grade")).alias("explanation"))
