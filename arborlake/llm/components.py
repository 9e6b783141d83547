"""Connected components of a table of links.

Alternating large-star and small-star steps: in a large-star step every node hands its
larger neighbours to the smallest node it knows, in a small-star step its smaller ones.
The links shrink to one star per component in a number of rounds that grows with the
logarithm of the component's size. A node's least neighbour is an aggregate that combines
before the shuffle, and neighbours are never gathered into one row, so a hub may hold any
part of the links. Every round is written and read again, until all links are stars. A round never
adds links; while there are few, as counted, the least neighbours are broadcast and the links
are shuffled only to find them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arborlake.llm.store import BROADCAST_ROWS, drop, in_tasks, keep


def _large_star(links: DataFrame, few: bool) -> DataFrame:
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("least"))
    moved = both.join(least.hint("broadcast") if few else least, "a").where(F.col("b") > F.col("a"))
    moved = moved.select(F.col("b").alias("a"), F.col("least").alias("b")).where(F.col("a") != F.col("b"))
    # the small star drops repeated links as well
    return moved if few else moved.distinct()


def _small_star(links: DataFrame, few: bool) -> DataFrame:
    """``links`` point from the larger node ``a`` to the smaller ``b``."""
    least = links.groupBy("a").agg(F.min("b").alias("least"))
    moved = links.join(least.hint("broadcast") if few else least, "a").where(F.col("b") != F.col("least"))
    moved = moved.select(F.col("b").alias("a"), F.col("least").alias("b"))
    return moved.unionByName(least.select("a", F.col("least").alias("b"))).distinct()


def _state(links: DataFrame) -> tuple:
    """Number of links ``a, b``, and of nodes that keep them from being stars of one centre ``b`` each."""
    end = lambda node, up: links.select(F.col(node).alias("node"), F.lit(up).alias("up"), F.lit(1 - up).alias("down"))
    nodes = end("a", 1).unionByName(end("b", 0)).groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    row = nodes.agg(F.sum("up").alias("links"), F.count(F.when(F.col("up") + F.col("down") > 1, 1)).alias("open")).first()
    return row["links"] or 0, row["open"]


def components(links: DataFrame) -> DataFrame:
    """``node, root`` for every node of the links ``a, b``; the root is the least node."""
    directed = links.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    table = keep(in_tasks(directed, links.count()), "links")
    rows, unsettled = _state(table)
    while unsettled:
        few = rows <= BROADCAST_ROWS
        found = _small_star(_large_star(table, few), few)
        after = keep(in_tasks(found, rows), "links")
        drop(table)
        table = after
        rows, unsettled = _state(table)
    roots = table.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return in_tasks(table.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots), 2 * rows)
