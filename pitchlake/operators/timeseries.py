"""Per-player series over appearances: spikes, drift, gaps, trends, slopes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from pitchlake.functions import exprs as X
from pitchlake.operators.features import earliest_first, latest_first


def series() -> WindowSpec:
    return Window.partitionBy("player_key").orderBy(*earliest_first())


def spikes(stats: DataFrame, metrics: tuple[str, ...] = ("goals", "assists", "shots", "minutes"), window: int = 5, least: int = 4, limit: float = 3.0) -> DataFrame:
    """Values far from the mean of up to `window` earlier ones, once there are `least` of those and five rows in all."""
    w = Window.partitionBy("player_key").orderBy(*earliest_first())
    before = w.rowsBetween(-window, -1)
    marked = stats.select("player_key", "seq", F.row_number().over(w).alias("k"), *[F.struct(F.lit(m).alias("metric"), F.coalesce(F.col(m), F.lit(0)).cast("double").alias("v"), F.avg(F.coalesce(m, F.lit(0)).cast("double")).over(before).alias("mean"), F.coalesce(F.stddev_samp(F.coalesce(m, F.lit(0)).cast("double")).over(before), F.lit(0.0)).alias("sd")).alias(f"s_{m}") for m in metrics])
    long = marked.filter(F.col("k") > least).select("player_key", "seq", F.explode(F.array(*[f"s_{m}" for m in metrics])).alias("s")).select("player_key", "seq", "s.*")
    z = F.round((F.col("v") - F.col("mean")) / (F.col("sd") + 0.5), 3)
    found = long.withColumn("z", z).withColumn("kind", F.when(F.col("z") > limit, "spike").when((F.col("z") < -limit) & (F.col("mean") > 0.5), "drop"))
    return found.filter("kind is not null").select("player_key", "seq", "metric", "kind", "z")


def career_drift(stats: DataFrame, window: int = 5) -> DataFrame:
    """Means of the last `window` rows less those of the `window` before; stable without two windows."""
    w = Window.partitionBy("player_key").orderBy(*latest_first())
    rows = stats.select("player_key", "goals", "assists", "minutes", F.row_number().over(w).alias("rn")).filter(F.col("rn") <= 2 * window)
    new = F.col("rn") <= window

    def shift(c: str) -> Column:
        return (F.sum(F.when(new, F.col(c)).otherwise(-F.col(c))) / window).alias(c)

    t = rows.groupBy("player_key").agg(F.count("*").alias("n"), shift("goals"), shift("assists"), shift("minutes"))
    full = F.col("n") == 2 * window
    both = (F.col("goals") / 0.5 + F.col("assists") / 0.4 + F.col("minutes") / 30.0) / 3.0
    t = t.withColumn("combined", F.round(F.when(full, both).otherwise(0.0), 6))
    return t.select(
        "player_key",
        *[F.round(F.when(full, F.col(c)).otherwise(0.0), d).alias(f"{c}_drift") for c, d in (("goals", 4), ("assists", 4), ("minutes", 2))],
        F.when(F.col("combined") > 0.15, "improving").when(F.col("combined") < -0.15, "declining").otherwise("stable").alias("direction"),
        F.round(F.least(F.lit(1.0), F.abs("combined")), 4).alias("magnitude"),
    )


def gap_days(stats: DataFrame) -> DataFrame:
    """Longest and mean number of days between a player's dates."""
    gaps = stats.filter(F.col("match_date").isNotNull()).select("player_key", F.datediff("match_date", F.lag("match_date").over(series())).alias("gap"))
    return gaps.groupBy("player_key").agg(F.max("gap").cast("double").alias("max_gap"), F.round(F.avg("gap"), 3).alias("mean_gap"))


def minutes_trend(stats: DataFrame, limit: float = 100.0) -> DataFrame:
    """Mean step between consecutive minutes, and its direction beyond the limit."""
    steps = stats.select("player_key", (F.col("minutes") - F.lag("minutes").over(series())).alias("step"))
    t = steps.groupBy("player_key").agg(F.coalesce(F.round(F.avg("step"), 1), F.lit(0.0)).alias("delta"))
    return t.withColumn("trend", F.when(F.col("delta") > limit, "ascending").when(F.col("delta") < -limit, "declining").otherwise("stable"))


def contribution(stats: DataFrame) -> DataFrame:
    """(player_key, k, n, y): each row's contribution per 90, in order; minutes 0 count as 1."""
    per = F.greatest(X.or_default("minutes", 1) / 90.0, F.lit(0.1))
    y = F.round(((F.col("goals") + F.col("assists")) * 2.5 + F.col("shots") * 0.2 + F.coalesce(F.col("xg"), F.lit(0.0)) * 1.5) / per, 3)
    return stats.select("player_key", F.row_number().over(series()).alias("k"), F.count("*").over(Window.partitionBy("player_key")).alias("n"), y.alias("y"), "match_date", "seq")


def score_slope(stats: DataFrame) -> DataFrame:
    """Least-squares slope of the history: complete means of three rows, or the rows themselves if fewer."""
    rows = contribution(stats)
    three = series().rowsBetween(-2, 0)
    h = rows.withColumn("h", F.when(F.col("n") >= 3, F.avg("y").over(three)).otherwise(F.col("y"))).filter((F.col("n") < 3) | (F.col("k") >= 3))
    t = h.groupBy("player_key").agg(F.count("*").alias("points"), F.coalesce(F.round(F.regr_slope(F.col("h"), F.col("k").cast("double")), 3), F.lit(0.0)).alias("slope"))
    return t


def value_spells(history: DataFrame) -> DataFrame:
    """Runs of consecutive rows at one club (player_key, ord, club, value, age) -> one row per run.

    ord numbers the runs; peak value, the middle row's age, and the relative change from first to last.
    """
    w = Window.partitionBy("player_key").orderBy("ord")
    new = (F.lag("club").over(w).isNull() | (F.lag("club").over(w) != F.col("club"))).cast("int")
    runs = history.withColumn("new", new).withColumn("spell", F.sum("new").over(w))
    t = runs.groupBy("player_key", "spell").agg(
        F.first("club").alias("club"), F.count("*").alias("rows"), F.max("value").alias("peak"),
        F.array_sort(F.collect_list(F.struct("ord", "age"))).alias("ages"), F.min_by("value", "ord").alias("first_value"), F.max_by("value", "ord").alias("last_value"),
    )
    return t.select(
        "player_key", "spell", "club", "rows", "peak", F.element_at("ages", (F.floor(F.col("rows") / 2) + 1).cast("int"))["age"].alias("mid_age"),
        F.round((F.col("last_value") - F.col("first_value")) / F.nullif("first_value", F.lit(0.0)), 4).alias("change"),
    )


def drift_report(players: DataFrame, spiked: DataFrame, drift: DataFrame) -> DataFrame:
    """For each player the spikes and drops of single matches, their number, the drift of the career and the number of all.

    anomalies is an array of structs (seq, metric, kind, z), by match and metric. The total is one row, broadcast.
    """
    listed = spiked.groupBy("player_key").agg(F.array_sort(F.collect_list(F.struct("seq", "metric", "kind", "z"))).alias("anomalies"))
    total = spiked.agg(F.count("*").alias("total_anomalies"))
    t = players.select("player_key").distinct().join(listed, "player_key", "left").join(drift.select("player_key", "direction", "magnitude"), "player_key", "left")
    return t.withColumn("anomaly_count", F.coalesce(F.size("anomalies"), F.lit(0))).withColumn("anomaly_count", F.greatest("anomaly_count", F.lit(0)).cast("long")).crossJoin(F.broadcast(total))
