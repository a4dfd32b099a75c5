"""Mixing sources to target weights by weighted fair queueing. DataFrame operations only.

Each source is a queue of its documents in a shuffled order that depends on the
document alone. A source whose target is above its size is queued again, in the
same order, up to ``max_repeats`` times. The n-th copy of a document has the
virtual finish time

    (words queued by its source up to and including it) / (target of the source)

so that at any time t every source has delivered t times its target. Copies are
taken in the order of finish times until the total budget is spent.

No window here sees a whole source: running sums are taken over hash ranges of
the shuffle key (first over the ranges' totals, then inside one range), and the
cut is found from the totals of finish-time ranges, then inside the one range
that holds it. A source with a third of all rows is so spread over all tasks.

Defined results: null text has size 0; null is a source of its own, after all
others; empty tables give no rows; rows that repeat a doc_id are separate
documents of the queue, and rows that repeat entirely are told apart by a number,
so each gets its own ``taken``; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.scratch import stored, tasks
from quarry.llm.text import n_words


def shuffle_key(doc_id: Column, seed: str) -> Column:
    """A pseudo-random string that depends on the document's id and the seed alone."""
    return F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(seed)).cast("binary"))


def key_range(key: Column, ranges: int) -> Column:
    """The number of the hash range of a hex key, in the order of the keys."""
    return F.floor(F.conv(F.substring(key, 1, 8), 16, 10).cast("long") * F.lit(ranges) / F.lit(1 << 32)).cast("int")


def targets(sizes: DataFrame, weights: Sequence[int], max_repeats: int) -> DataFrame:
    """``source, source_size, target`` from one row ``source, source_size`` for each source.

    Sources by code point, null last, weigh ``weights`` in turn. All share the sum of
    sizes; no target is above ``max_repeats`` times the source's size, and what that
    leaves over goes to the others by weight: with the sources sorted by limit per unit of weight,
    those below the water level get their limit, the rest weight times level.
    """
    # Spark and DuckDB both order strings by their UTF-8 bytes, which is the order of code points
    w = sizes.withColumn("i", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    w = w.withColumn("weight", F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("i") % len(weights) + 1).cast("int")))
    w = w.withColumn("most", (F.col("source_size") * max_repeats).cast("double")).withColumn("ratio", F.col("most") / F.col("weight"))
    asc, whole = Window.orderBy("ratio", "i"), Window.partitionBy()
    before = asc.rowsBetween(Window.unboundedPreceding, -1)
    w = w.withColumn("left", F.sum("source_size").over(whole).cast("double") - F.coalesce(F.sum("most").over(before), F.lit(0.0)))
    w = w.withColumn("level", F.col("left") / (F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))))
    w = w.withColumn("final", F.min(F.when(F.col("ratio") >= F.col("level"), F.struct("ratio", "i", "level"))).over(whole)["level"])
    return w.select("source", "source_size", F.least(F.col("most"), F.coalesce(F.col("weight") * F.col("final"), F.col("most"))).alias("target"))


def mix(
    docs: DataFrame, *, weights: Sequence[int] = (5, 2, 1), max_repeats: int = 3, seed: str = "mix", size: Column | None = None
) -> DataFrame:
    """For each row of ``docs(doc_id, text, source)``: its size, its source's size and target, the copies and words taken.

    Returns ``doc_id, source, row_no, size, source_size, target, copies, taken, first_finish``, one row
    for each row of ``docs``. ``row_no`` tells rows with the same doc_id and source apart.
    """
    spark = docs.sparkSession
    ranges = 8 * tasks(spark)
    rows = stored(docs.select("doc_id", "source", (n_words(F.col("text")) if size is None else size).cast("long").alias("size")), "mix-sizes")
    rows = rows.withColumn("key", shuffle_key(F.col("doc_id"), seed)).withColumn("part", key_range(F.col("key"), ranges))

    # one row for each source and hash range: its words, and the words of the ranges before it
    cells = stored(rows.groupBy("source", "part").agg(F.sum("size").alias("words")), "mix-cells")
    sizes = cells.groupBy("source").agg(F.sum("words").alias("source_size"))
    goals = stored(targets(sizes, weights, max_repeats), "mix-targets")
    total = goals.agg(F.sum("source_size")).head()[0] or 0
    by_source = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.withColumn("before", F.coalesce(F.sum("words").over(by_source), F.lit(0)))
    cells = cells.join(F.broadcast(goals) if goals.count() < 10_000 else goals, cells["source"].eqNullSafe(goals["source"]), "inner").drop(goals["source"])
    cells = cells.select(F.col("source").alias("c_source"), F.col("part").alias("c_part"), "before", "source_size", "target")

    inside = Window.partitionBy("source", "part").orderBy("key", "doc_id", "size")
    queued = rows.withColumn("row_no", F.row_number().over(inside)).withColumn("upto", F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    queued = queued.join(cells, queued["source"].eqNullSafe(cells["c_source"]) & (F.col("part") == F.col("c_part")))
    queued = stored(
        queued.select("doc_id", "source", "part", "key", "row_no", "size", "source_size", "target", (F.col("before") + F.col("upto")).alias("served")), "mix-queue"
    )

    # the n-th copy finishes at (n * source_size + served) / target; the budget is spent at about 1
    copies = (
        queued.filter("size > 0")
        .withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(max_repeats - 1))))
        .withColumn("finish", (F.col("copy") * F.col("source_size") + F.col("served")).cast("double") / F.col("target"))
        .withColumn("slot", F.floor(F.least(F.col("finish"), F.lit(2.0)) * ranges).cast("long"))
    )
    slots = copies.groupBy("slot").agg(F.sum("size").alias("words"))
    upto = Window.orderBy("slot").rowsBetween(Window.unboundedPreceding, 0)
    # ranges wholly inside the budget, and the one that holds the cut
    slots = slots.withColumn("upto", F.sum("words").over(upto))
    cut = slots.filter(F.col("upto") > total).orderBy("slot").select("slot", (F.col("upto") - F.col("words")).alias("base")).head()
    if cut is not None:
        order = Window.partitionBy("slot").orderBy("finish", F.col("source").asc_nulls_last(), "key", "doc_id", "row_no", "copy")
        edge = copies.filter(F.col("slot") == cut["slot"]).withColumn("run", F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0)))
        edge = edge.filter(F.col("run") + F.lit(cut["base"]) <= total)
        copies = copies.filter(F.col("slot") < cut["slot"]).unionByName(edge.drop("run"))
    taken = copies.groupBy("source", "doc_id", "part", "row_no").agg(F.count("*").alias("copies"), F.min("finish").alias("first_finish"))
    taken = taken.select(*[F.col(c).alias(f"t_{c}") for c in ("source", "doc_id", "part", "row_no")], "copies", "first_finish")
    out = queued.join(
        taken,
        F.col("source").eqNullSafe(F.col("t_source")) & F.col("doc_id").eqNullSafe(F.col("t_doc_id")) & (F.col("part") == F.col("t_part")) & (F.col("row_no") == F.col("t_row_no")),
        "left",
    )
    n = F.coalesce(F.col("copies"), F.lit(0))
    return out.select("doc_id", "source", "row_no", "size", "source_size", "target", n.alias("copies"), (n * F.col("size")).cast("long").alias("taken"), "first_finish")

