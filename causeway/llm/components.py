"""Connected components of a graph given as a table of links, by alternating large and small stars.

Each round is two minimum-aggregations (combined before the shuffle) and two joins on the node. Rows of a
node with more than a thousandth of all links don't meet in one task: they are joined with its one row by broadcast, and there
are a thousand such nodes at most. Rounds needed grow with the logarithm of the number of nodes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from causeway.runtime import forget, settled

_HOT = 1000


def joined(rows: DataFrame, of: DataFrame, key: str | list[str], total: int) -> DataFrame:
    """Inner join of ``total`` rows with ``of``, one row for each key, whose column _n is the number of rows that have the key.

    Keys of more than a thousandth of the rows are joined by broadcast; there are a thousand at most.
    """
    most = max(_HOT, total // _HOT)
    if total <= most:
        return rows.join(of.drop("_n"), key)
    hot, names = F.broadcast(of.where(F.col("_n") > most).drop("_n")), [key] if isinstance(key, str) else key
    cold = rows.join(F.broadcast(of.where(F.col("_n") > most).select(names)), key, "left_anti").join(of.where(F.col("_n") <= most).drop("_n").hint("merge"), key)
    return rows.join(hot, key).unionByName(cold)


def with_group(rows: DataFrame, key: str | list[str], total: int, *values: Column) -> DataFrame:
    """``rows`` (``total`` of them) with aggregates over all rows of the same key."""
    names = [key] if isinstance(key, str) else key
    return joined(rows, rows.groupBy(*names).agg(F.count("*").alias("_n"), *values), key, total)


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of ``links`` (columns a, b): component is the smallest node reachable.

    Loops and repeated links change nothing; links with a null end are left out; no links, no rows.
    """
    links = links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    links = settled(links, "links")
    before, n = None, links.count()
    while True:
        both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        both = with_group(both, "a", 2 * n, F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
        large = both.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = settled(large.union(both.where("a > m").select("a", F.col("m").alias("b"))).distinct(), "large")
        small = with_group(large, "a", large.count(), F.min("b").alias("m"))
        small = small.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(small.select("a", F.col("m").alias("b")))
        old, links = links, settled(small.distinct(), "links")
        forget(old, large)
        now = links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before, n = now, now[0]
    return links.select(F.col("a").alias("node"), F.col("b").alias("component")).union(links.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
