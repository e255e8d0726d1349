"""Per-player and per-match features from appearance rows.

Appearances have player_key, seq, match_date, competition, source, minutes, goals, assists,
shots, passes, yellow, red and xg. Orders within a player are (match_date, seq), nulls first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pitchlake.functions import exprs as X


def latest_first() -> list[Column]:
    return [F.col("match_date").desc_nulls_last(), F.col("seq").desc()]


def earliest_first() -> list[Column]:
    return [F.col("match_date").asc_nulls_first(), F.col("seq").asc()]


def minutes_bucket(minutes: Column) -> Column:
    return X.tiers(minutes, [(1800, "starter"), (900, "rotation"), (1, "fringe")], "none", "none")


def player_totals(stats: DataFrame) -> DataFrame:
    """One row per player: counts, sums and what follows from them. Nulls count as 0."""
    z = lambda c: F.coalesce(F.sum(c), F.lit(0))
    t = stats.groupBy("player_key").agg(
        F.count("*").alias("matches"), *[z(c).alias(c) for c in ("minutes", "goals", "assists", "shots", "yellow", "red")]
    )
    return t.select(
        "*",
        (F.col("goals") + F.col("assists")).alias("goal_contributions"),
        X.per_90("goals", "minutes").alias("goals_per_90"),
        X.per_90(F.col("goals") + F.col("assists"), "minutes").alias("gc_per_90"),
        (F.col("yellow") + 2 * F.col("red")).alias("discipline"),
        minutes_bucket(F.col("minutes")).alias("minutes_bucket"),
    )


def match_features(matches: DataFrame) -> DataFrame:
    """Score difference, draw flag and total goals, null if either score is."""
    return matches.select(
        "match_id",
        (F.col("home_score") - F.col("away_score")).alias("score_difference"),
        (F.col("home_score") == F.col("away_score")).alias("is_draw"),
        (F.col("home_score") + F.col("away_score")).alias("total_goals"),
    )


def latest(stats: DataFrame, n: int) -> DataFrame:
    """The last n rows of each player, with rn = 1 for the last one."""
    w = Window.partitionBy("player_key").orderBy(*latest_first())
    return stats.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= n)


def rolling_form(stats: DataFrame, metrics: tuple[str, ...] = ("goals", "assists", "minutes"), windows: tuple[int, ...] = (3, 5, 10)) -> DataFrame:
    """Mean of the last n values that are not null, for each metric and n; null if there are none."""
    out = None
    for m in metrics:
        w = Window.partitionBy("player_key").orderBy(*latest_first())
        ranked = stats.filter(F.col(m).isNotNull()).select("player_key", F.col(m).alias("v"), F.row_number().over(w).alias("rn")).filter(F.col("rn") <= max(windows))
        means = ranked.groupBy("player_key").agg(*[F.round(F.avg(F.when(F.col("rn") <= n, F.col("v"))), 3).alias(f"{m}_last_{n}") for n in windows])
        out = means if out is None else out.join(means, "player_key", "full")
    return out


def consistency(stats: DataFrame, n: int = 5, scale: float = 25.0) -> DataFrame:
    """100 less `scale` times the deviation of contributions per 90 over the last n rows, within 0 and 100."""
    last = latest(stats, n).withColumn("gc", X.per_90(F.col("goals") + F.col("assists"), "minutes"))
    score = F.round(X.clamp(100.0 - F.stddev_pop("gc") * scale, 0, 100), 3)
    return last.groupBy("player_key").agg(F.coalesce(score, F.lit(0.0)).alias("consistency"))


def kpi(stats: DataFrame, players: DataFrame, on: Column, confidence: DataFrame | None = None) -> DataFrame:
    """Base score from contributions, shots, passes and consistency; adjusted by age and confidence.

    Where a player has no recorded shots or passes they are estimated from goals and minutes by role.
    """
    z = lambda c: F.coalesce(F.sum(c), F.lit(0))
    t = stats.groupBy("player_key").agg(F.count("*").alias("matches"), *[z(c).alias(c) for c in ("minutes", "goals", "assists", "shots", "passes")])
    t = t.join(consistency(stats), "player_key").join(players.select("player_key", "position", "dob"), "player_key", "left")
    role = X.role("position")
    finishing = F.when(role == "forward", 0.18).when(role.isin("defender", "goalkeeper"), 0.08).otherwise(0.14)
    passing = F.when(role == "forward", 35).when(role.isin("defender", "goalkeeper"), 52).otherwise(45)
    t = t.withColumns(
        {
            "shots": F.when(F.col("shots") > 0, F.col("shots")).otherwise(F.round(F.col("goals") / finishing).cast("long")),
            "passes": F.when(F.col("passes") > 0, F.col("passes")).otherwise(F.round(F.col("minutes") / 90 * passing).cast("long")),
            "age": X.age_at("dob", on),
        }
    )
    p = lambda c: F.coalesce(X.per_90(c, "minutes"), F.lit(0.0))
    base = F.round(p(F.col("goals") + F.col("assists")) * 0.45 + p("shots") * 0.20 + p("passes") * 0.15 + F.col("consistency") / 100.0 * 0.20, 3)
    t = t.withColumn("base_kpi", base).withColumn("age_kpi", F.round(F.col("base_kpi") * X.age_multiplier("age"), 3))
    if confidence is None:
        t = t.withColumn("confidence", F.lit(None).cast("double"))
    else:
        t = t.join(confidence.select("player_key", "confidence"), "player_key", "left")
    return t.select(
        "player_key", "matches", "minutes", "goals", "assists", "shots", "passes", "age", "consistency", "base_kpi",
        F.round(F.col("age_kpi") * X.or_default("confidence", 1.0), 3).alias("age_adjusted_kpi"),
    )


def expected_metrics(stats: DataFrame) -> DataFrame:
    """Expected goals and assists, threat, possession and on-ball proxies; recorded xg comes first.

    There are no set-piece, header or key-pass columns here; they count as 0.
    """
    t = stats.groupBy("player_key").agg(
        *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("minutes", "goals", "assists", "shots", "passes")],
        F.sum(F.round(F.col("xg") * 100).cast("long")).alias("xg100"),
        F.max(F.col("xg").isNotNull()).alias("has_xg"),
    )
    estimated = F.when(F.col("shots") > 0, 0.6 * (F.col("shots") * 0.10) + 0.4 * F.col("goals"))
    xg = F.round(F.when(F.col("has_xg"), F.col("xg100") / 100.0).otherwise(estimated), 3)
    moves = F.col("passes") * 0.05
    return t.select(
        "player_key",
        xg.alias("xg"),
        F.round(F.col("assists") * 0.85, 3).alias("xa"),
        F.when(F.col("passes") > 0, X.per_90(moves, "minutes")).alias("xt_per_90"),
        X.per_90(F.col("goals") * 2.0 + F.col("assists") * 1.5 + F.col("shots") * 0.08, "minutes").alias("epv_per_90"),
        F.round(F.col("goals") * 2.5 + F.col("assists") * 1.8 + F.col("shots") * 0.15, 3).alias("obv"),
        X.per_90(xg, "minutes").alias("xg_per_90"),
        X.per_90(F.round(F.col("assists") * 0.85, 3), "minutes").alias("xa_per_90"),
        F.least(F.lit(10.0), F.round(10.0 * X.per_90(F.col("goals") + F.col("assists"), "minutes"), 3)).alias("progression"),
    )


def expected_metrics_v1(stats: DataFrame) -> DataFrame:
    """Totals and their differences from the expected; progression weighs passes and shots per 90."""
    t = stats.groupBy("player_key").agg(
        *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("minutes", "goals", "assists", "shots", "passes")],
        (F.coalesce(F.sum(F.round(F.col("xg") * 100).cast("long")), F.lit(0)) / 100.0).alias("xg"),
    )
    return t.select(
        "player_key", "minutes", "goals", "assists", "xg",
        F.round(F.col("goals") - F.col("xg"), 3).alias("goals_minus_xg"),
        X.per_90("passes", "minutes").alias("passes_per_90"),
        X.per_90("shots", "minutes").alias("shots_per_90"),
        F.round(F.coalesce(X.per_90("passes", "minutes"), F.lit(0.0)) * 0.5 + F.coalesce(X.per_90("shots", "minutes"), F.lit(0.0)) * 0.3 + F.coalesce(X.per_90("assists", "minutes"), F.lit(0.0)) * 0.2, 3).alias("progression"),
    )


def transfer_features(transfers: DataFrame) -> DataFrame:
    """Per player: transfers, total and mean fee without loans, first and last fee, resale multiple.

    Ordered by date and the line's keys. Fees are summed as decimals, so the order of rows does not matter.
    """
    at = F.struct("date", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    paid = ~F.col("loan")
    t = transfers.groupBy("player_key").agg(
        F.count("*").alias("transfers"),
        F.count_if("loan").alias("loans"),
        F.sum(F.when(paid, F.col("fee").cast("decimal(18,2)"))).cast("double").alias("total_fee"),
        F.count_if(paid).alias("paid"),
        F.min_by(F.when(paid, F.col("fee")), F.when(paid, at)).alias("first_fee"),
        F.max_by(F.when(paid, F.col("fee")), F.when(paid, at)).alias("last_fee"),
        F.array_sort(F.collect_set("to_club")).alias("clubs"),
    )
    return t.select(
        "player_key", "transfers", "loans", "total_fee",
        F.round(F.col("total_fee") / F.nullif("paid", F.lit(0)), 2).alias("mean_fee"),
        "first_fee", "last_fee",
        F.round(F.col("last_fee") / F.nullif("first_fee", F.lit(0.0)), 3).alias("resale_multiple"),
        F.array_join("clubs", ",").alias("clubs"),
    )


def mode_value(stats: DataFrame, column: str, out: str) -> DataFrame:
    """The most frequent value of each player; of equal ones the one seen first."""
    counted = stats.filter(F.col(column).isNotNull()).groupBy("player_key", column).agg(F.count("*").alias("n"), F.min(F.struct("match_date", "seq")).alias("first"))
    best = F.max_by(F.col(column), F.struct("n", (-F.datediff("first.match_date", F.lit("1970-01-01"))).alias("d"), (-F.col("first.seq")).alias("s")))
    return counted.groupBy("player_key").agg(best.alias(out))
