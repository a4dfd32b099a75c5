"""Connected components of a graph given as a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from quarry.llm.scratch import stored


def connected(edges: DataFrame, *, rounds: int = 200) -> DataFrame:
    """``node, root`` for every node of ``edges(src, dst)`` of longs: the component's smallest node.

    Alternates the large-star and the small-star step, which both keep the components
    and need a number of rounds about the logarithm of the longest path. Each round's table
    is written to the shared folder. Self-links and repeated links are allowed.
    """
    edges, now = _written(_both(edges).filter("src > dst").distinct())
    for _ in range(rounds):
        if not now[0]:
            break
        before = now
        edges, now = _written(_small_star(_large_star(edges)))
        if now == before:
            break
    else:
        raise RuntimeError(f"components not found in {rounds} rounds")
    # all links are now from a node to its root
    nodes = edges.select(F.col("src").alias("node"), F.col("dst").alias("root"))
    return nodes.unionByName(edges.select(F.col("dst").alias("node"), F.col("dst").alias("root")).distinct())


def _written(edges: DataFrame) -> tuple[DataFrame, tuple]:
    """The links as a table, and sums over them that are counted as it is written, so that two rounds with equal ones are told by no job of their own."""
    seen = Observation()
    number = lambda c: F.coalesce(F.sum(c.cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)"))
    sums = [F.count("*").alias("n"), number(F.col("src")).alias("s"), number(F.col("dst")).alias("d"), number(F.xxhash64("src", "dst")).alias("h")]
    table = stored(edges.observe(seen, *sums), "links")
    got = seen.get
    return table, tuple(got[k] for k in ("n", "s", "d", "h"))


def _both(edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node links its larger neighbours to the smallest of its neighbours and itself."""
    near = _both(edges)
    least = near.groupBy(F.col("src").alias("m_src")).agg(F.min("dst").alias("low")).select("m_src", F.least("m_src", "low").alias("low"))
    return near.filter("dst > src").join(least, F.col("src") == F.col("m_src")).select(F.col("dst").alias("src"), F.col("low").alias("dst")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node links its smaller neighbours and itself to the smallest of them."""
    least = edges.groupBy(F.col("src").alias("m_src")).agg(F.min("dst").alias("low"))
    moved = edges.join(least, F.col("src") == F.col("m_src")).select(F.col("dst").alias("src"), F.col("low").alias("dst"))
    return moved.filter("src <> dst").unionByName(least.select(F.col("m_src").alias("src"), F.col("low").alias("dst"))).distinct()
