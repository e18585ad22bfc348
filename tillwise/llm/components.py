"""Connected components of a graph of links, as joins and aggregations.

Large-star and small-star steps in turn move every node next to the smallest of its component, until
each node that isn't the smallest has one link, to a node that is. No node's neighbours are gathered:
a step takes minima, with partial ones before the shuffle, and joins them back, where adaptive
execution splits the links of a hot node.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillwise.llm.common import keep_few


def _pair(a: str, b: str | Column) -> Column:
    return F.struct(F.col(a).alias("a"), (F.col(b) if isinstance(b, str) else b).alias("b"))


def _each(links: DataFrame, *pairs: Column) -> DataFrame:
    """The pairs (a, b) that a row gives, in one reading of the rows."""
    return links.select(F.inline(F.array(*pairs)).alias("a", "b"))


def _large_star(links: DataFrame) -> DataFrame:
    both = _each(links, _pair("a", "b"), _pair("b", "a"))
    least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
    moved = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.where("a <> b")


def _small_star(links: DataFrame) -> DataFrame:
    down = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = _each(down.join(least, "a"), _pair("a", "m"), _pair("b", "m"))
    return moved.where("a <> b").distinct()


def _settled(links: DataFrame) -> bool:
    """Whether each node is either at the upper end of links to one node or at their lower end."""
    none = F.lit(None).cast("long")
    ends = _each(links, _pair("a", "b"), _pair("b", none)).groupBy("a").agg(
        F.min("b").alias("least"), F.max("b").alias("most"), F.max(F.col("b").isNull()).alias("lower")
    )
    return ends.where("least <> most OR (lower AND least IS NOT NULL)").isEmpty()


def connected(links: DataFrame) -> DataFrame:
    """(node, component) of the nodes of links (a, b), component being its smallest node. Nodes
    that are the smallest of their component are left out."""
    links = links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    current = keep_few(links.distinct())
    while not _settled(current):
        current = keep_few(_small_star(_large_star(current)))
    return current.select(F.col("a").alias("node"), F.col("b").alias("component"))
