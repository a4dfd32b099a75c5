"""Quality rules whose cutoffs are certified on labelled documents. DataFrame operations only.

Two kinds of rule. The base rule is fixed: too few words, or too many of them in windows of three words that recur. The others
compare a severity (an integer for each document, higher is worse) with a cutoff for each stratum, learned as follows.

Labelled documents that pass the base rule are halved by a hash of their ids. On the first half a cutoff's worth is

    (share of bad documents that it rejects) - ``gain`` * (share of good documents that it rejects).

On the other half, the holdout, a cutoff is certified: with n good documents in the stratum, of which it rejects k, it is used only
if a binomial variable of n trials and rate ``limit / rules`` is at most k with a probability of at most ``error / (strata * rules)``. That is the
exact (Clopper-Pearson) bound on the rate of false rejections, with Bonferroni's correction for all strata and rules. Cutoffs of one rule are
tested from the mildest on, up to the first that fails: their rejections are nested, so this order needs no further correction. With probability
1 - ``error`` therefore, in every stratum all rules together reject at most ``limit`` of the good documents that pass the base rule. Of
the certified cutoffs the one of greatest worth is taken, the mildest of equals; a rule without a certified cutoff of positive worth does nothing in that stratum.

What is counted for this is a histogram: documents by stratum, rule, half, label and severity, and severities are at most ``MOST``.

Defined results: null text has no words and fails the base rule; strata are languages, null is ``''``; strata without labels, or with too few, use the base
rule alone; labels other than 0 and 1 and those without an id are ignored, a document with both labels counts as good; rows that share an id
are documents of their own with the same label; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.scratch import stored
from quarry.llm.text import SPACES

#: Characters that count as symbols.
SYMBOLS = "#*$%&|<>"
#: Severities are 0 to this.
MOST = 5000
RULES = ("symbols", "long_words", "short_words", "repeated_lines", "repeated_words")


def _next(c: str) -> Column:
    """The array without its first element."""
    return F.slice(c, 2, F.greatest(F.size(c), F.lit(1)))


def features(docs: DataFrame) -> DataFrame:
    """``doc_id, lang`` and the counts of each row of ``docs(doc_id, lang, text)``: words, their characters, symbols, repeated lines, words in repeated windows.

    Arrays are columns of their own before they are used twice, so that no expression is computed again for each of its elements.
    """
    text = F.coalesce("text", F.lit(""))
    flat, bare = text, text
    for c in SPACES[:-1]:
        flat = F.replace(flat, F.lit(c), F.lit(" "))
    for c in SYMBOLS:
        bare = F.replace(bare, F.lit(c), F.lit(""))
    rows = docs.select("doc_id", F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("lang"), text.alias("text"), flat.alias("flat"))
    lines = F.filter(F.split("text", "\n"), lambda x: F.btrim(x, F.lit(SPACES)) != "")
    rows = rows.select(
        "doc_id", "lang", F.array_remove(F.split("flat", " "), "").alias("w"), F.length(F.replace("flat", F.lit(" "), F.lit(""))).cast("long").alias("word_chars"),
        (F.length("text") - F.length(bare)).cast("long").alias("n_symbols"), lines.alias("lines"),
    )
    # windows of three words, each with its place, in the order of their words; in the last two places words are missing, so they equal none
    n = F.greatest(F.size("w"), F.lit(1))
    placed = F.sort_array(F.arrays_zip(F.col("w"), F.slice("w", 2, n), F.slice("w", 3, n), F.sequence(F.lit(0), n - 1)))
    rows = rows.select(
        "doc_id", "lang", F.size("w").cast("long").alias("n_words"), "word_chars", "n_symbols", F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"), placed.alias("s"),
    )
    counts = "doc_id", "lang", "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines"
    # equal windows are neighbours now
    pair = F.arrays_zip(F.col("s"), _next("s"))
    equal = F.filter(pair, lambda x: (x["s"]["w"] == x["1"]["w"]) & (x["s"]["1"] == x["1"]["1"]) & (x["s"]["2"] == x["1"]["2"]))
    places = F.flatten(F.transform(equal, lambda x: F.array(x["s"]["3"], x["1"]["3"])))
    rows = rows.select(*counts, F.sort_array(F.array_distinct(places)).alias("q"))
    covered = F.zip_with("q", _next("q"), lambda a, b: F.least(F.lit(3), F.coalesce(b - a, F.lit(3))))
    return rows.select(*counts, F.aggregate(covered, F.lit(0).cast("long"), lambda s, x: s + x).alias("n_repeat_words"))


def base_failed(least_words: int = 50, most_repeated: int = 50) -> Column:
    """Fewer words than ``least_words``, or more than ``most_repeated`` percent of them in repeated windows."""
    return (F.col("n_words") < least_words) | (100 * F.col("n_repeat_words") > most_repeated * F.col("n_words"))


def severities() -> dict[str, Column]:
    """For each rule its severity, from :func:`features` of a document with words: per thousand words or lines, and hundredths of a character a word."""
    per = lambda a, b, times: F.least(F.lit(MOST).cast("long"), F.expr(f"{times} * {a} div greatest({b}, 1)"))
    long = per("word_chars", "n_words", 100)
    out = per("n_symbols", "n_words", 1000), long, MOST - long, per("n_dup_lines", "n_lines", 1000), per("n_repeat_words", "n_words", 1000)
    return dict(zip(RULES, out, strict=True))


def most_rejected(n: Column, rate: float, error: Column) -> Column:
    """The largest k with P(Binomial(n, ``rate``) <= k) <= ``error``, -1 if there is none. It is below n * rate, so the sum ends there.

    Terms are added from 0 on, each made from the logarithm of the one before.
    """
    start = F.struct((n * F.log(F.lit(1 - rate))).alias("l"), F.lit(0.0).alias("c"), F.lit(-1).cast("long").alias("k"))

    def step(acc: Column, i: Column) -> Column:
        more = F.when(i == 0, F.lit(0.0)).otherwise(F.log((n - i + 1) / i) + F.log(F.lit(rate / (1 - rate))))
        total = acc["c"] + F.exp(acc["l"] + more)
        return F.struct((acc["l"] + more).alias("l"), total.alias("c"), F.when(total <= error, i).otherwise(acc["k"]).alias("k"))

    return F.aggregate(F.sequence(F.lit(0).cast("long"), F.floor(n * F.lit(rate)).cast("long")), start, step, lambda acc: acc["k"])


def cutoffs(counted: DataFrame, labels: DataFrame, *, limit: float = 0.01, error: float = 0.05, gain: int = 10) -> DataFrame:
    """``stratum`` and, for each rule, its cutoff (null: none), one row for each stratum that has one. From :func:`features` and ``labels(doc_id, quality)``."""
    known = labels.filter(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("l_id")).agg(F.max("quality").alias("good"))
    rows = counted.filter(~base_failed()).join(known, F.col("doc_id") == F.col("l_id"))
    each = F.array(*[F.struct(F.lit(r).alias("rule"), s.cast("long").alias("severity")) for r, s in severities().items()])
    held = (F.md5(F.col("doc_id").cast("string").cast("binary")) >= "8").cast("int")
    rows = rows.select(F.col("lang").alias("stratum"), "good", held.alias("held"), F.explode(each).alias("e"))
    count = lambda good, held: F.count_if((F.col("good") == good) & (F.col("held") == held))
    levels = rows.groupBy("stratum", "e.rule", "e.severity").agg(count(1, 1).alias("k"), count(1, 0).alias("g"), count(0, 0).alias("b"))
    levels = stored(levels, "rule-levels")
    # documents at or beyond each severity, and all of the stratum
    whole = Window.partitionBy("stratum", "rule")
    beyond = whole.orderBy(F.col("severity").desc()).rowsBetween(Window.unboundedPreceding, 0)
    totals = {c.upper() + "_all": F.sum(c).over(whole) for c in ("g", "b")}
    levels = levels.withColumns(totals | {f"{c}_cut": F.sum(c).over(beyond) for c in ("k", "g", "b")})
    strata = stored(rows.filter((F.col("e.rule") == RULES[0])).groupBy("stratum").agg(count(1, 1).alias("n")), "rule-strata")
    tests = strata.agg((F.lit(error) / (F.count("*") * len(RULES))).alias("level"))
    allowed = strata.crossJoin(F.broadcast(tests)).select("stratum", most_rejected(F.col("n"), limit / len(RULES), F.col("level")).alias("k_most"))
    worth = F.col("b_cut") * F.col("G_all") - gain * F.col("g_cut") * F.col("B_all")
    sure = levels.join(allowed, "stratum").withColumn("worth", worth).filter("k_cut <= k_most AND worth > 0")
    best = sure.groupBy("stratum", "rule").agg(F.max_by("severity", F.struct("worth", "severity")).alias("cut"))
    return best.groupBy("stratum").agg(*[F.max(F.when(F.col("rule") == r, F.col("cut"))).alias(f"cut_{r}") for r in RULES])


def judged(docs: DataFrame, labels: DataFrame, **limits) -> DataFrame:
    """:func:`features` of each row of ``docs(doc_id, lang, text)`` with ``base_failed``, ``kept`` and ``rejected_by``, the names of the rules that reject it."""
    counted = stored(features(docs), "rule-features")
    cuts = cutoffs(counted, labels, **limits)
    rows = counted.join(cuts, F.col("lang") == F.col("stratum"), "left").withColumn("base_failed", base_failed())
    hits = [F.when(s >= F.col(f"cut_{r}"), F.lit(r)) for r, s in severities().items()]
    by = F.when(F.col("base_failed"), F.array(F.lit("base"))).otherwise(F.array_compact(F.array(*hits)))
    rows = rows.withColumn("rejected_by", by).withColumn("kept", F.size("rejected_by") == 0)
    return rows.select("doc_id", "lang", "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rejected_by")
