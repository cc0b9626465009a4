"""Connected components of a table of links, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from signalsift.session import released, staged

#: Rounds after which something must be wrong; each one shortens all paths.
MAX_ROUNDS = 60


def _both(links: DataFrame) -> DataFrame:
    ends = F.array(F.struct(F.col("a"), F.col("b")), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))
    return links.select(F.inline(ends))


def _large_star(links: DataFrame) -> DataFrame:
    """Each larger neighbour of a node is linked with the node's smallest neighbour."""
    ends = _both(links)
    least = ends.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return ends.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(links: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are linked with the smallest of them."""
    down = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b")
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least, "a")
    return moved.select(
        F.inline(
            F.array(
                F.struct(F.col("b").alias("a"), F.col("m").alias("b")),
                F.struct(F.col("a"), F.col("m").alias("b")),
            )
        )
    )


def components(links: DataFrame) -> DataFrame:
    """``(node, component)`` of every linked node; the component is its smallest node.

    ``links`` has two columns of integers, in any order and with repeats; rows
    with a null are no links. Nodes only linked with themselves do not appear.
    Each round is written to the shared checkpoint folder, and the driver sees
    no more than a row count and a sum per round.
    """
    first, second = links.columns
    now = links.select(F.col(first).cast("long").alias("a"), F.col(second).cast("long").alias("b"))
    now = staged(now.where("a <> b").distinct(), "links")
    seen = None
    for _ in range(MAX_ROUNDS):
        stars = _small_star(_large_star(now)).where("a <> b").distinct()
        last, now = now, staged(stars, "links")
        released(last)
        sums = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(sums) == seen:
            return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
                now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
            )
        seen = tuple(sums)
    raise RuntimeError(f"components are not settled after {MAX_ROUNDS} rounds")
