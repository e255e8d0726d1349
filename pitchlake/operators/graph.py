"""The transfer network: edges, node roles, PageRank, routes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pitchlake.sources.shared import cut


#: Rounds of PageRank.
ROUNDS = 60


def edges(transfers: DataFrame, prestige: DataFrame) -> DataFrame:
    """(src, dst, w, moves): for each pair of clubs the sum of max(0.1, rise in prestige + 0.2) * ln(1 + fee)."""
    p = F.broadcast(prestige.select("club", "prestige"))
    t = (
        transfers.filter(F.col("from_club") != F.col("to_club")).join(p.withColumnsRenamed({"club": "from_club", "prestige": "ps"}), "from_club")
        .join(p.withColumnsRenamed({"club": "to_club", "prestige": "pd"}), "to_club")
    )
    w = F.greatest(F.lit(0.1), F.col("pd") - F.col("ps") + 0.2) * F.ln(1.0 + F.coalesce("fee", F.lit(0.0)))
    t = t.groupBy(F.col("from_club").alias("src"), F.col("to_club").alias("dst")).agg(F.count("*").alias("moves"), F.sum(F.round(w, 6).cast("decimal(20,6)")).cast("double").alias("w"))
    return t.select("src", "dst", "moves", F.round("w", 4).alias("w"))


def pagerank(edge: DataFrame, rounds: int = ROUNDS, damping: float = 0.85) -> DataFrame:
    """(node, rank) after exactly `rounds` rounds; a node without outgoing weight gives its rank to all.

    A round is one join and one sum on the nodes; its ranks are written to shared storage and read
    back, so the plan stays short, and one number, the rank that goes to all, reaches the driver.
    """
    edge = cut(edge)
    nodes = edge.select(F.col("src").alias("node")).union(edge.select("dst")).distinct()
    n = nodes.count()
    share = cut(edge.withColumn("f", F.col("w") / F.sum("w").over(Window.partitionBy("src"))).select("src", "dst", "f"))
    sinks = nodes.join(edge.select(F.col("src").alias("node")).distinct(), "node", "left_anti")
    ranks = cut(nodes.withColumn("rank", F.lit(1.0 / max(n, 1))))
    for _ in range(rounds):
        loose = ranks.join(sinks, "node", "left_semi").agg(F.coalesce(F.sum("rank"), F.lit(0.0))).head()[0]
        given = ranks.join(share, F.col("node") == F.col("src")).groupBy(F.col("dst").alias("to")).agg(F.sum(F.col("rank") * F.col("f")).alias("got"))
        rank = F.lit((1 - damping) / n) + damping * (F.coalesce("got", F.lit(0.0)) + F.lit(loose / n))
        ranks = cut(ranks.select("node").join(given, F.col("node") == F.col("to"), "left").select("node", rank.alias("rank")))
    return ranks


def node_stats(edge: DataFrame, prestige: DataFrame) -> DataFrame:
    """Degrees, springboard value and role of each club, and its five heaviest destinations."""
    p = prestige.select("club", "prestige")
    out = edge.join(F.broadcast(p.withColumnRenamed("prestige", "pd")), F.col("dst") == F.col("club")).groupBy(F.col("src").alias("node")).agg(
        F.count("*").alias("out_clubs"), F.sum("moves").alias("out_moves"), F.sum(F.round(F.col("w") * F.col("pd"), 6).cast("decimal(24,6)")).cast("double").alias("lift"),
        F.slice(F.array_sort(F.collect_list(F.struct((-F.col("w")).alias("nw"), "dst"))), 1, 5).alias("top"),
    )
    into = edge.groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("in_clubs"), F.sum("moves").alias("in_moves"))
    t = p.withColumnRenamed("club", "node").join(out, "node", "left").join(into, "node", "left")
    z = lambda c: F.coalesce(F.col(c), F.lit(0))
    spring = F.round(z("lift") / (F.col("prestige") + 0.1) / (z("out_clubs") + 1), 3)
    t = t.withColumn("springboard", spring)
    role = F.when((F.col("prestige") < 0.4) & (z("out_moves") >= z("in_moves")), "exporter").when(F.col("prestige") >= 0.8, "destination").when(F.col("springboard") > 10, "springboard").otherwise("bridge")
    return t.select("node", z("out_clubs").alias("out_clubs"), z("in_clubs").alias("in_clubs"), z("out_moves").alias("out_moves"), z("in_moves").alias("in_moves"), "springboard", role.alias("role"), F.array_join(F.transform("top", lambda x: x["dst"]), ",").alias("top_clubs"))


def routes(edge: DataFrame, prestige: DataFrame, hops: int = 3, step: float = 0.05) -> DataFrame:
    """(start, route): at each club, the first of its five heaviest edges that leads at least `step` above the start's prestige."""
    p = F.broadcast(prestige.select("club", "prestige"))
    w = Window.partitionBy("src").orderBy(F.desc("w"), "dst")
    top = edge.withColumn("i", F.row_number().over(w)).filter("i <= 5").join(p.withColumnsRenamed({"club": "c", "prestige": "pd"}), F.col("dst") == F.col("c")).select("src", "dst", "i", "pd")
    now = p.select(F.col("club").alias("start"), F.col("club").alias("at"), "prestige", F.array("club").alias("route"))
    for _ in range(hops):
        fits = (F.col("at") == F.col("src")) & (F.col("pd") > F.col("prestige") + step) & ~F.array_contains("route", F.col("dst"))
        moved = now.join(top, fits).groupBy("start").agg(F.min_by("dst", "i").alias("next"))
        now = now.join(moved, "start", "left").select("start", F.coalesce("next", "at").alias("at"), "prestige", F.when(F.col("next").isNotNull(), F.concat("route", F.array("next"))).otherwise(F.col("route")).alias("route"))
    return now.select("start", (F.size("route") - 1).alias("hops"), F.array_join("route", " > ").alias("route"))
