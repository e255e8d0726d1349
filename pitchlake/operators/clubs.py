"""Clubs: benchmark, development, fit of players, projections into leagues."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pitchlake.functions import exprs as X


def live_metrics(kpi: DataFrame, players: DataFrame, tracked: DataFrame) -> DataFrame:
    """Players, mean score and mean consistency of each tracked club; live = false for clubs without any."""
    joined = players.select("player_key", "club").join(kpi.select("player_key", "base_kpi", "consistency"), "player_key")
    t = joined.groupBy("club").agg(F.count("*").alias("players"), F.round(F.avg("base_kpi"), 2).alias("mean_kpi"), F.round(F.avg("consistency"), 3).alias("mean_consistency"))
    return tracked.select("club").join(t, "club", "left").select("club", F.coalesce("players", F.lit(0)).alias("players"), "mean_kpi", "mean_consistency", F.col("players").isNotNull().alias("live"))


def against_baseline(metrics: DataFrame, baseline: str, columns: tuple[str, ...] = ("mean_kpi", "mean_consistency", "players")) -> DataFrame:
    """Difference from and ratio to the baseline club, whose single row is broadcast."""
    row = metrics.filter(F.col("club") == baseline).limit(1).select(*[F.col(c).alias(f"__{c}") for c in columns])
    t = metrics.crossJoin(F.broadcast(row))
    out = []
    for c in columns:
        out += [F.round(F.col(c) - F.col(f"__{c}"), 3).alias(f"{c}_delta"), F.round(F.col(c) / F.nullif(F.col(f"__{c}").cast("double"), F.lit(0.0)), 3).alias(f"{c}_ratio")]
    return t.select("club", "players", "mean_kpi", "mean_consistency", "live", *out, (F.col("club") == baseline).alias("is_baseline"))


def destination_quality(transfers: DataFrame, weights: DataFrame, least: float = 8.0, most: float = 25.0) -> DataFrame:
    """Per club: outbound moves, and the capped sum over them of the destination's weight, `least` at least."""
    out = transfers.filter(F.col("from_club") != F.col("to_club"))
    t = out.join(F.broadcast(weights.select(F.col("club").alias("to_club"), "weight")), "to_club", "left").withColumn("w", F.greatest(F.lit(least), F.coalesce("weight", F.lit(0.0))))
    return t.groupBy(F.col("from_club").alias("club")).agg(F.count("*").alias("outbound"), F.least(F.lit(most), F.sum(F.col("w").cast("decimal(18,4)")).cast("double")).alias("quality"))


def development(players: DataFrame, kpi: DataFrame, valued: DataFrame, totals: DataFrame, moves: DataFrame) -> DataFrame:
    """Development, resale and confidence of clubs from their young players (24 or less, or unknown age; else all)."""
    t = (
        players.select("player_key", "club").join(kpi.select("player_key", "base_kpi", "age"), "player_key", "left")
        .join(valued.select("player_key", F.col("score").alias("value_score")), "player_key", "left").join(totals.select("player_key", "minutes"), "player_key", "left")
    )
    young = F.col("age").isNull() | (F.col("age") <= 24)
    pool = lambda c: F.coalesce(F.avg(F.when(young, F.col(c))), F.avg(c), F.lit(0.0))
    t = t.groupBy("club").agg(F.count("*").alias("squad"), F.count_if(young).alias("young"), pool("value_score").alias("v"), pool("base_kpi").alias("k"), pool("minutes").alias("m"))
    t = t.join(moves, "club", "left").withColumns({"n": F.coalesce("outbound", F.lit(0)), "q": F.coalesce("quality", F.lit(0.0))})
    dev = F.least(F.lit(40.0), 0.4 * F.col("v")) + F.least(F.lit(35.0), 7.0 * F.col("k")) + F.least(F.lit(25.0), F.col("m") / 1800.0 * 25.0)
    resale = F.least(F.lit(45.0), 15.0 * F.col("n")) + F.col("q") + F.least(F.lit(30.0), 0.3 * F.col("v"))
    t = t.withColumns({"development": F.round(dev, 2), "resale": F.round(resale, 2)})
    t = t.withColumns({"overall": F.round(0.6 * F.col("development") + 0.4 * F.col("resale"), 2), "confidence": F.round(F.least(F.lit(1.0), F.col("squad") / 25.0), 3)})
    # One row per club: a dimension, so ranking it in one task is safe.
    rank = F.row_number().over(Window.orderBy(F.desc("overall"), F.desc("confidence"), F.desc("development"), "club"))
    return t.select("club", "squad", "young", "development", "resale", "overall", "confidence", rank.alias("rank"))


WEIGHTS = {"role": 0.25, "age": 0.20, "league": 0.18, "value": 0.12, "tactical": 0.12, "pathway": 0.08, "demand": 0.05}


def _step_up(delta: Column) -> Column:
    return F.round(F.when(delta < -0.1, F.greatest(F.lit(0.1), 0.5 + delta)).when(delta <= 0.40, F.least(F.lit(1.0), 0.5 + delta * 1.5)).otherwise(F.greatest(F.lit(0.3), 0.5 - (delta - 0.40))), 4)


def _affordable(ratio: Column) -> Column:
    return F.when(ratio <= 1.0, F.round(1.0 - ratio * 0.3, 4)).when(ratio <= 2.0, F.round(0.7 - (ratio - 1.0) * 0.4, 4)).otherwise(F.greatest(F.lit(0.1), F.round(0.3 - (ratio - 2.0) * 0.1, 4)))


def club_fit(profiles: DataFrame, clubs: DataFrame, role: Column, demand: Column, top: int = 5) -> DataFrame:
    """The `top` best clubs of each player.

    profiles: player_key, age, home prestige, value, score, kpi, position. clubs is a dimension of
    fixed size and is broadcast; each player meets each club once and only the best rows go on.
    """
    t = profiles.crossJoin(F.broadcast(clubs))
    age = F.col("age")
    mid, sigma = (F.col("buy_age_low") + F.col("buy_age_high")) / 2.0, (F.col("buy_age_high") - F.col("buy_age_low")) / 2.0 + 1.5
    age_fit = F.when(age.isNull(), 0.5).when(age.between(F.col("buy_age_low"), F.col("buy_age_high")), 1.0).otherwise(F.round(F.exp(-((age - mid) * (age - mid)) / (2 * sigma * sigma)), 4))
    technical, physical = F.least(F.lit(1.0), X.or_default("score", 55.0) / 80.0), F.least(F.lit(1.0), X.or_default("kpi", 8.5) / 12.0)
    tactical = F.round((1.0 - F.abs(technical - F.col("technical")) * 0.8) * 0.45 + (1.0 - F.abs(physical - F.col("physical")) * 0.6) * 0.30 + (1.0 - F.abs(physical - F.col("pressing")) * 0.5) * 0.25, 4)
    t = t.withColumns(
        {
            "f_role": role, "f_age": age_fit, "f_league": _step_up(F.col("prestige") - F.col("home_prestige")), "f_value": _affordable(X.or_default("value", 3e6) / F.greatest("spend", F.lit(1.0))),
            "f_tactical": tactical, "f_pathway": F.col("pathway_score"), "f_demand": demand,
        }
    )
    total = sum([F.col(f"f_{k}") * w for k, w in WEIGHTS.items()][1:], F.col("f_role") * WEIGHTS["role"])
    t = t.withColumn("fit", F.round(total, 4))
    w = Window.partitionBy("player_key").orderBy(F.desc("fit"), "ord")
    return t.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= top).select("player_key", "rank", "club", "league", "fit")


def league_projection(profiles: DataFrame, leagues: DataFrame, fits: DataFrame) -> DataFrame:
    """Each player in each league of the dimension: projected score, kpi, value, minutes, adaptation and confidence.

    profiles: player_key, age, home_prestige, kpi, score, trajectory; fits: player_key, league, fit.
    """
    t = profiles.crossJoin(F.broadcast(leagues)).join(fits, ["player_key", "league"], "left").withColumn("fit", F.coalesce("fit", F.lit(0.5)))
    age, traj = F.col("age"), F.col("trajectory")
    delta = F.col("prestige") - F.col("home_prestige")
    gap = F.greatest(F.lit(0.0), delta)
    t = t.withColumns({"gap": gap, "difficulty": F.round(F.when(delta <= 0, 1.0 + 0.15 * F.abs(delta)).otherwise(F.greatest(F.lit(0.55), 1.0 - 0.55 * delta - 0.15 * delta * delta)), 4)})
    g = F.col("gap")
    perf = X.or_default("score", 50.0)
    minutes = (
        X.clamp((perf - 50.0) / 50.0 + 0.55, 0.30, 0.95)
        + F.when(age < 20, -0.10).when(age > 28, -0.05 * (age - 28)).otherwise(0.0)
        + F.when(g > 0.40, -0.15 * (g - 0.4) / 0.6).when(g > 0.20, -0.05).otherwise(0.05)
    )
    months = 3 + F.when(g >= 0.50, 5).when(g >= 0.30, 3).when(g >= 0.10, 1).otherwise(0) + F.when(age < 21, 1).when(age > 28, 2).otherwise(0)
    months = F.when(traj == "improving", F.greatest(F.lit(2), months - 1)).when(traj == "declining", months + 2).otherwise(months)
    momentum = F.when((traj == "improving") & (age <= 25), 1.05).when((traj == "improving") & (age <= 28), 1.02).when((traj == "declining") & (age >= 28), 0.95).when(traj == "declining", 0.97).otherwise(1.0)
    t = t.withColumns({"minutes_p": F.round(X.clamp(minutes, 0.25, 0.95), 4), "months": F.least(F.lit(12), F.greatest(F.lit(2), months)), "factor": F.col("difficulty") * (F.col("fit") * 0.10 + 0.95) * momentum})
    kpi = F.round(X.or_default("kpi", 8.0) * F.when(F.col("difficulty") > 1.0, 1.05).otherwise(0.95) * F.col("factor") * F.pow("minutes_p", F.lit(0.3)), 3)
    t = t.withColumns({"projected_kpi": X.clamp(kpi, 5, 14), "projected_score": X.clamp(F.round(perf * F.pow("factor", F.lit(0.7)), 2), 20, 95)})
    value = F.col("prestige") * 20e6 * F.pow(F.col("projected_score") / 50.0, F.lit(1.4)) * F.coalesce(X.gauss(age, 24.0, 4.5), F.lit(0.8))
    sure = F.least(F.lit(1.0), F.round(0.50 + 0.20 * (1.0 - g) + 0.15 * F.col("minutes_p") + 0.15 * F.col("fit"), 4))
    return t.select("player_key", "league", "ord", "projected_kpi", "projected_score", F.round(value, 0).alias("projected_value"), "minutes_p", "months", sure.alias("confidence"))


def best_league(projected: DataFrame) -> DataFrame:
    best = F.max_by(F.struct("league", "projected_kpi", "projected_value", "confidence"), F.struct("projected_value", (-F.col("ord")).alias("o")))
    return projected.groupBy("player_key").agg(best.alias("b")).select("player_key", "b.*")


def canonical_club(name: Column, aliases: dict[str, str], inside: bool = True) -> Column:
    """The club's one name: that of an alias equal to the folded text, else of the first alias in it, else the trimmed text.

    Null for null and blank text. inside=False asks for equality only. The aliases are a table of
    fixed size, in the order in which they are looked for.
    """
    text = F.trim(name)
    folded = F.lower(text)
    out = F.when(F.coalesce(text, F.lit("")) == "", F.lit(None).cast("string"))
    for alias, club in aliases.items():
        out = out.when(folded == alias, club)
    for alias, club in aliases.items() if inside else ():
        out = out.when(folded.contains(alias), club)
    return out.otherwise(text)
