"""Connected components of an edge table, by alternating star contraction, and joins that hot keys do not skew."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitchlake.llm.shared import cut_at, remove

#: A key is hot if it has more than one in so many of the rows; so there are fewer hot keys than this.
HOT = 50_000


def spread_join(rows: DataFrame, named: DataFrame, on: str, key: str, total: int) -> DataFrame:
    """Inner join of rows with named by rows.on = named.key, where named has each key once and, in `n`, how many rows have it.

    Keys that more than a HOT-th of all `total` rows have, fewer than HOT by that, are broadcast and
    their rows stay where they are; all others are joined by a shuffle, whose groups are thus small.
    """
    is_hot = F.col("n").cast("decimal(38,0)") * HOT > total
    hot = F.broadcast(named.filter(is_hot))
    there = rows.join(hot, F.col(on) == F.col(key))
    rest = rows.join(F.broadcast(named.filter(is_hot).select(F.col(key).alias("__hot"))), F.col(on) == F.col("__hot"), "left_anti")
    return there.unionByName(rest.join(named.filter(~is_hot), F.col(on) == F.col(key)))


def chain_ends(steps: DataFrame) -> DataFrame:
    """(node, next) long or string, each node once and no circles -> (node, root): the last of each node's chain.

    Every round doubles the steps taken at once, so the rounds grow with the logarithm of the longest
    chain; each is written to the shared folder, and one bit a round reaches the driver.
    """
    now, path = cut_at(steps.select("node", F.col("next").alias("root")))
    while True:
        ahead = now.select(F.col("node").alias("w"), F.col("root").alias("r"))
        further, done = cut_at(now.join(ahead, F.col("root") == F.col("w"), "left").select("node", F.coalesce("r", "root").alias("root"), F.col("r").isNotNull().alias("moved")))
        remove(now.sparkSession, path)
        path, moved, now = done, not further.filter("moved").isEmpty(), further.drop("moved")
        if not moved:
            return now


def components(edges: DataFrame) -> DataFrame:
    """(a, b) long -> (node, root): the smallest node of each node's component, for nodes with an edge.

    Each round ties every node's larger neighbours to its smallest one (large star) and then its
    smaller ones (small star); components become stars in a number of rounds that grows with the
    logarithm of their size, squared. A round is a few shuffles of the edges, written to the shared
    folder, so neither lineage nor the driver grows; only two numbers a round reach the driver. Of
    each node's neighbours an aggregate keeps the smallest one and joins go by spread_join(), so a
    node with very many edges is no group. Loops and repeated edges do no harm; no edges give no rows.
    """
    now, path = cut_at(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    seen = None
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy(F.col("a").alias("k")).agg(F.least(F.min("b"), F.first("a")).alias("m"), F.count("*").alias("n"))
        # Large star: a larger neighbour of a node goes to the smallest of the node and its neighbours.
        large = spread_join(both.filter("b > a"), least, "a", "k", 2 * now.count()).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large, large_path = cut_at(large)
        # Small star: a node and its smaller neighbours go to the smallest of them.
        least = large.groupBy(F.col("a").alias("k")).agg(F.min("b").alias("m"), F.count("*").alias("n"))
        tied = spread_join(large, least, "a", "k", large.count())
        small = tied.filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select(F.col("k").alias("a"), F.col("m").alias("b"))).distinct()
        old = path
        now, path = cut_at(small)
        for done in (old, large_path):
            remove(now.sparkSession, done)
        count, total = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).head()
        if (count, total) == seen:
            break
        seen = (count, total)
    nodes = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return nodes.unionByName(nodes.select(F.col("root").alias("node"), "root").distinct())
