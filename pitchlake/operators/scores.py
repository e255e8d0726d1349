"""Confidence, risk, valuation, pathway and transfer scores of players."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pitchlake.functions import exprs as X
from pitchlake.operators import timeseries

# --- confidence -------------------------------------------------------------------------------

AGREEMENT_WEIGHTS = {"goals": 0.30, "assists": 0.25, "minutes": 0.30, "appearances": 0.15}


def source_agreement(stats: DataFrame) -> DataFrame:
    """How far the totals of a player's first two sources agree, weighted; 0.65 for one source."""
    by = stats.groupBy("player_key", "source").agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("goals", "assists", "minutes")], F.count("*").alias("appearances"), F.min(F.struct("match_date", "seq")).alias("seen"))
    two = by.withColumn("i", F.row_number().over(Window.partitionBy("player_key").orderBy("seen"))).filter("i <= 2")
    value = lambda m, i: F.coalesce(F.max(F.when(F.col("i") == i, F.col(m))), F.lit(0)).cast("double")
    t = two.groupBy("player_key").agg(F.max("i").alias("sources"), *[value(m, i).alias(f"{m}{i}") for m in AGREEMENT_WEIGHTS for i in (1, 2)])
    total = weight = F.lit(0.0)
    for m, w in AGREEMENT_WEIGHTS.items():
        a, b = F.col(f"{m}1"), F.col(f"{m}2")
        any_ = (a > 0) | (b > 0)
        total = total + F.when(any_, w * (1.0 - F.abs(a - b) / F.greatest(a, b, F.lit(1.0)))).otherwise(0.0)
        weight = weight + F.when(any_, w).otherwise(0.0)
    return t.select("player_key", F.when((F.col("sources") < 2) | (weight <= 0), 0.65).otherwise(F.round(total / weight, 4)).alias("agreement"))


def internal_consistency(stats: DataFrame) -> DataFrame:
    """1 less half the variation of contributions over rows of more than 10 minutes."""
    played = F.col("minutes") > 10
    gc = F.when(played, (F.col("goals") + F.col("assists")).cast("double"))
    t = stats.groupBy("player_key").agg(F.count(gc).alias("n"), F.avg(gc).alias("mean"), F.stddev_samp(gc).alias("sd"))
    score = F.when(F.col("n") < 2, 0.70).when(F.col("mean") <= 0, 0.80).otherwise(F.round(X.clamp(1.0 - F.col("sd") / F.col("mean") / 2.0, 0, 1), 4))
    return t.select("player_key", score.alias("internal"))


def coverage(stats: DataFrame, players: DataFrame, stat_fields: tuple[str, ...] = ("goals", "assists", "minutes", "shots", "xg"), player_fields: tuple[str, ...] = ("position", "dob")) -> DataFrame:
    """Share of the fields that are known for a player, in the profile or in any row."""
    t = stats.groupBy("player_key").agg(*[F.max(F.col(c).isNotNull().cast("int")).alias(c) for c in stat_fields]).join(players.select("player_key", *player_fields), "player_key", "left")
    known = sum([F.col(c) for c in stat_fields], F.lit(0)) + sum([F.col(c).isNotNull().cast("int") for c in player_fields], F.lit(0))
    return t.select("player_key", F.round(known / (len(stat_fields) + len(player_fields)), 4).alias("coverage"))


def confidence(stats: DataFrame, players: DataFrame) -> DataFrame:
    """Half agreement, a fifth internal consistency, three tenths coverage; and the first flag that holds."""
    counts = stats.groupBy("player_key").agg(F.coalesce(F.sum("minutes"), F.lit(0)).alias("minutes"), F.count_distinct("competition").alias("competitions"), F.count_distinct("source").alias("sources"))
    t = counts.join(source_agreement(stats), "player_key").join(internal_consistency(stats), "player_key").join(coverage(stats, players), "player_key")
    score = F.round(0.50 * F.col("agreement") + 0.20 * F.col("internal") + 0.30 * F.col("coverage"), 4)
    t = t.withColumn("confidence", score)
    flag = F.when((F.col("competitions") < 2) | (F.col("minutes") < 500), "LOW_SAMPLE").when(F.col("confidence") < 0.60, "LOW_CONFIDENCE").when(F.col("sources") < 2, "SINGLE_SOURCE").otherwise("OK")
    return t.select("player_key", "agreement", "internal", "coverage", "sources", "confidence", flag.alias("flag"))


def confident_split(rows: DataFrame, index: DataFrame, least: float = 0.60) -> DataFrame:
    """rows with kept and reason: rows of at most one source stay; others need the least confidence."""
    t = rows.join(index.select("player_key", "sources", "confidence"), "player_key", "left")
    kept = F.col("sources").isNull() | (F.col("sources") <= 1) | (F.col("confidence") >= least)
    return t.withColumn("kept", kept).withColumn("reason", F.when(~F.col("kept"), F.lit("low_confidence")))


# --- risk -------------------------------------------------------------------------------------


def risk(stats: DataFrame, players: DataFrame, on: Column, consistency: DataFrame) -> DataFrame:
    """Injury (0.45), volatility (0.40) and discipline (0.15) from ages, gaps and spreads."""
    s = stats.withColumns({"gc": F.coalesce(X.per_90(F.col("goals") + F.col("assists"), "minutes"), F.lit(0.0)), "sh": F.coalesce(X.per_90("shots", "minutes"), F.lit(0.0)), "m": F.coalesce("minutes", F.lit(0)).cast("double")})
    t = s.groupBy("player_key").agg(
        F.count("*").alias("n"),
        *[f(c).alias(f"{c}_{k}") for c in ("gc", "sh", "m") for k, f in (("mean", F.avg), ("sd", F.stddev_pop))],
        F.avg((F.col("m") < 30).cast("int")).alias("low"),
        F.coalesce(F.sum(F.col("yellow") + 2 * F.col("red")), F.lit(0)).alias("discipline_raw"),
    )
    t = t.join(timeseries.gap_days(stats), "player_key", "left").join(players.select("player_key", "dob"), "player_key", "left").join(consistency, "player_key", "left")
    cv = lambda c, floor: X.variation(F.col(f"{c}_mean"), F.col(f"{c}_sd"), F.col("n"), floor)
    age = X.age_at("dob", on)
    age_part = F.when(age.isNull(), 8.0).when(age <= 21, 6.0).when(age <= 27, 8.0).when(age <= 30, 12.0).when(age <= 33, 16.0).otherwise(20.0)
    gap_part = F.coalesce(X.clamp(0.8 * F.greatest(F.lit(0.0), F.col("max_gap") - 10.0) + 0.9 * F.greatest(F.lit(0.0), F.col("mean_gap") - 7.0), 0, 35), F.lit(0.0))
    unsteady = X.clamp(18.0 * cv("m", 15.0) + 10.0 * F.col("low"), 0, 25)
    few = F.when(F.col("n") >= 8, 0.0).when(F.col("n") >= 5, 3.0).when(F.col("n") >= 3, 6.0).when(F.col("n") == 2, 10.0).otherwise(14.0)
    part = lambda c, scale, floor: X.clamp(cv(c, floor) * scale, 0, 40)
    penalty = F.when(F.col("consistency").isNull(), 6.0).otherwise(X.clamp(0.25 * (60.0 - F.col("consistency")), 0, 15))
    t = t.withColumns(
        {
            "injury": F.round(X.clamp(age_part + gap_part + unsteady + few, 0, 100), 3),
            "volatility": F.round(X.clamp(0.45 * part("gc", 24.0, 0.35) + 0.30 * part("sh", 18.0, 0.5) + 0.25 * part("m", 16.0, 30.0) + penalty, 0, 100), 3),
            "discipline": F.round(X.clamp(6.0 * F.col("discipline_raw"), 0, 100), 3),
        }
    )
    t = t.withColumn("risk", F.round(0.45 * F.col("injury") + 0.40 * F.col("volatility") + 0.15 * F.col("discipline"), 3))
    return t.select("player_key", "injury", "volatility", "discipline", "risk", X.tiers(F.col("risk"), [(75, "high"), (50, "elevated"), (25, "moderate")], "low").alias("tier"))


# --- valuation --------------------------------------------------------------------------------


@dataclass(frozen=True)
class Weights:
    """Shares of the valuation's parts; they must add up to 1."""

    performance: float = 0.35
    age: float = 0.20
    minutes: float = 0.15
    league: float = 0.15
    club: float = 0.10
    risk: float = 0.05

    def __post_init__(self):
        if abs(self.performance + self.age + self.minutes + self.league + self.club + self.risk - 1.0) > 1e-6:
            raise ValueError("weights must add up to 1")


def potential_multiplier(age: Column) -> Column:
    a = X.or_default(age, 25)
    return F.when(a <= 19, 1.35).when(a <= 21, 1.20).when(a <= 23, 1.10).when(a <= 25, 1.05).otherwise(1.0)


def valuation(kpi: DataFrame, expected: DataFrame, totals: DataFrame, risk_: DataFrame, players: DataFrame, league_points: DataFrame, club_points: DataFrame, weights: Weights = Weights(), ageless: float = 50.0) -> DataFrame:
    """Weighted score of 0 to 100, its EUR equivalent, and the gap to the stated market value.

    league_points has player_key and points of -10 to 15; club_points has club and score, 50 if unknown.
    ageless is the age part of players whose age is unknown, such as those without appearances.
    """
    t = (
        players.select("player_key", "club", "market_value")
        .join(kpi.select("player_key", "age", "base_kpi"), "player_key", "left")
        .join(expected.select("player_key", "xg_per_90", "xa", "progression"), "player_key", "left")
        .join(totals.select("player_key", "matches", "minutes", "gc_per_90"), "player_key", "left")
        .join(risk_.select("player_key", "risk"), "player_key", "left")
        .join(league_points, "player_key", "left")
        .join(F.broadcast(club_points), "club", "left")
    )
    z = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    xa_90 = F.coalesce(X.per_90("xa", "minutes"), F.lit(0.0))
    part = {
        "performance": F.round(X.clamp(0.4 * z("base_kpi") + F.least(F.lit(25.0), 25.0 * z("xg_per_90")) + F.least(F.lit(20.0), 20.0 * xa_90) + F.least(F.lit(15.0), 15.0 * z("progression")) + F.least(F.lit(10.0), 10.0 * z("gc_per_90")), 0, 100), 2),
        "age_part": F.when(F.col("age").isNull(), ageless).otherwise(X.age_curve_score("age")),
        "minutes_part": F.when((z("minutes") > 0) & (z("matches") > 0), F.round(X.clamp(100.0 * F.col("minutes") / (F.col("matches") * 90.0), 0, 100), 2)).otherwise(40.0),
        "league_part": X.clamp(F.coalesce("points", F.lit(0.0)) * 6.67, 0, 100),
        "club_part": F.coalesce("score", F.lit(50.0)),
        "risk_part": F.coalesce(F.round(X.clamp(0.25 * F.col("risk"), 0, 25), 2), F.lit(5.0)),
    }
    t = t.withColumns(part)
    w = weights
    raw = F.col("performance") * w.performance + F.col("age_part") * w.age + F.col("minutes_part") * w.minutes + F.col("league_part") * w.league + F.col("club_part") * w.club - F.col("risk_part") * w.risk
    t = t.withColumn("score", F.round(X.clamp(raw, 0, 100), 2))
    t = t.withColumn("computed_value", F.when(F.col("score") > 0, F.round(5e6 * F.exp((F.col("score") - 50.0) / 10.0), 0)).otherwise(0.0))
    gap = F.when((F.col("market_value") > 0) & (F.col("computed_value") > 0), F.round((F.col("computed_value") - F.col("market_value")) / F.col("market_value") * 100, 1))
    return t.select(
        "player_key", "club", "age", "performance", "score", "market_value", "computed_value", gap.alias("gap_pct"),
        (F.col("market_value").isNotNull() & (F.col("computed_value") > F.col("market_value"))).alias("undervalued"),
        X.tiers(F.col("score"), [(80, "elite"), (65, "high"), (50, "mid"), (35, "developing")], "low").alias("tier"),
        F.round(F.least(F.lit(100.0), F.col("score") * potential_multiplier(F.col("age"))), 2).alias("potential"),
    )


def projection(valued: DataFrame, trajectory: Column) -> DataFrame:
    """Scores in two and five years by the age curve's ratio and the trajectory."""
    m = F.when(trajectory == "ascending", 1.08).when(trajectory == "declining", 0.90).otherwise(1.0)
    now = X.or_default("age", 25)
    curve = lambda k: X.age_curve_score(now + k) / F.greatest(X.age_curve_score(now), F.lit(1.0))
    gap = F.abs(25 - now)
    return valued.select(
        "player_key", "score", "potential", F.round(X.clamp(F.col("score") * curve(2) * m, 0, 100), 2).alias("in_2y"), F.round(X.clamp(F.col("score") * curve(5) * m * m, 0, 100), 2).alias("in_5y"),
        F.greatest(F.lit(18), 25 - gap).cast("int").alias("peak_from"), F.least(F.lit(35), 28 + gap).cast("int").alias("peak_to"),
    )


def valuation_v1(kpi: DataFrame, old: DataFrame, totals: DataFrame, club_points: Column, league_points: Column) -> DataFrame:
    """The earlier additive score: performance up to 45, age, minutes up to 15, club and league, less risk."""
    t = kpi.select("player_key", "age", "base_kpi", "consistency").join(old.select("player_key", F.col("progression").alias("prog")), "player_key", "left").join(totals.select("player_key", "minutes", "matches", "discipline"), "player_key", "left")
    age = F.when(F.col("age").isNull(), 8.0).when(F.col("age") <= 20, 15.0).when(F.col("age") <= 24, 12.0).when(F.col("age") <= 28, 9.0).otherwise(5.0)
    per_match = F.col("discipline") / F.greatest(F.col("matches"), F.lit(1))
    deduct = F.least(F.lit(12.0), 1.5 * per_match + 0.08 * F.greatest(F.lit(0.0), 60.0 - F.col("consistency")))
    performance = F.least(F.lit(45.0), 8.0 * F.col("base_kpi") + 0.12 * F.coalesce("prog", F.lit(0.0)))
    score = F.round(X.clamp(performance + age + F.least(F.lit(15.0), 3.0 * F.col("minutes") / 900.0) + club_points + league_points - deduct, 0, 100), 2)
    return t.select("player_key", score.alias("score"), X.tiers(score, [(75, "A"), (60, "B"), (45, "C")], "D").alias("tier"))


# --- pathway and transfers --------------------------------------------------------------------


def pathway(kpi: DataFrame, slopes: DataFrame, valued: DataFrame, trend: DataFrame) -> DataFrame:
    """Percentile for age, trajectory, velocity, next step and chance of success."""
    t = kpi.select("player_key", "age", "base_kpi").join(slopes, "player_key", "left").join(valued.select("player_key", "score"), "player_key", "left").join(trend.select("player_key", "trend"), "player_key", "left")
    t = t.withColumns({"slope": F.coalesce("slope", F.lit(0.0)), "score": X.or_default("score", 50.0)})
    age, slope = F.col("age"), F.col("slope")
    expected = F.when(age <= 26, 8.0 + age / 26.0 * 6.0).otherwise(F.greatest(F.lit(6.0), 14.0 - (age - 26.0) * 0.4))
    percentile = F.when(age.isNull() | F.col("base_kpi").isNull(), 50.0).otherwise(F.round(X.clamp(50.0 * F.col("base_kpi") / F.greatest(expected, F.lit(1.0)), 1, 99), 1))
    trajectory = F.when(F.coalesce("points", F.lit(0)) < 2, F.when(age <= 22, "ascending").when(age >= 32, "declining").otherwise("stable")).otherwise(
        F.when((age > 30) & (slope <= 0), "declining").when(slope > 0.5, "ascending").when(slope >= -0.3, "stable").otherwise("declining")
    )
    t = t.withColumns({"percentile": percentile, "trajectory": trajectory})
    velocity = F.when(age.isNull(), slope).otherwise(slope * F.greatest(F.lit(0.5), 1.5 - F.greatest(F.lit(0), age - 20) * 0.05))
    a = X.or_default(age, 25)
    chance = F.col("score") / 100.0 * F.when(F.col("trajectory") == "ascending", 1.2).when(F.col("trajectory") == "declining", 0.7).otherwise(1.0) * F.when(a <= 24, 1.0).otherwise(F.greatest(F.lit(0.5), 1.0 - (a - 24) * 0.04)) * (F.col("percentile") / 100.0 * 0.5 + 0.5)
    step = F.when(F.col("score") >= 70, F.array(F.lit("tier-1 league"))).when(F.col("score") >= 50, F.array(F.lit("tier-2 league"), F.lit("continental cup"))).otherwise(F.array(F.lit("domestic league")))
    return t.select(
        "player_key", "trajectory", "percentile", "slope", F.round(velocity, 3).alias("velocity"), F.coalesce("trend", F.lit("unknown")).alias("minutes_trend"),
        F.array_join(step, " > ").alias("next_step"), F.round(X.clamp(chance, 0, 1), 3).alias("success"),
        F.when(a < 21, "prospect").when(a < 24, "emerging").when(a < 29, "peak").otherwise("veteran").alias("stage"),
    )


def share_below(rows: DataFrame, value: str, out: str = "share_below", parts: int = 256) -> DataFrame:
    """rows with the share of rows whose value is strictly smaller; null has none.

    Distinct values are counted first. Their running sum is taken inside ranges between quantiles of
    the distinct values, so that a far-off value does not put all others into one, and only one
    total per range is summed across ranges. The cuts, `parts` numbers, pass through the driver.
    """
    counts = rows.filter(F.col(value).isNotNull()).groupBy(value).agg(F.count("*").alias("__n"))
    cuts, total = counts.agg(F.percentile_approx(value, [i / parts for i in range(1, parts)], 100 * parts), F.coalesce(F.sum("__n"), F.lit(0))).head()
    edges = F.array(*[F.lit(float(c)) for c in sorted(set(cuts or []))]).cast("array<double>")
    counts = counts.withColumn("__part", F.size(F.filter(edges, lambda c: c <= F.col(value))))
    sizes = counts.groupBy("__part").agg(F.sum("__n").alias("__size"))
    sizes = sizes.select("__part", F.coalesce(F.sum("__size").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    inside = F.coalesce(F.sum("__n").over(Window.partitionBy("__part").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    below = counts.withColumn("__inside", inside).join(F.broadcast(sizes), "__part").select(F.col(value).alias("__value"), (F.col("__inside") + F.col("__before")).alias("__below"))
    return rows.join(below, F.col(value) == F.col("__value"), "left").withColumn(out, F.col("__below") / F.lit(float(max(total, 1)))).drop("__value", "__below")


def transfer_probability(kpi: DataFrame, drift: DataFrame, players: DataFrame, visibility: Column, export: Column, penalty: Column) -> DataFrame:
    """Chance of a move within one and two years; z adds percentile, visibility, export rate and penalty."""
    t = share_below(kpi.select("player_key", "age", "base_kpi"), "base_kpi", "percentile").join(drift.select("player_key", "direction", "magnitude"), "player_key", "left").join(players, "player_key", "left")
    z = (F.coalesce("percentile", F.lit(0.5)) - 0.5) / 0.15 + visibility + export + penalty
    t = t.withColumn("p1", F.round(X.sigmoid(z), 4))
    decay = F.greatest(F.lit(0.7), 1.0 - F.greatest(F.lit(0.0), X.or_default("age", 25) - 25.0) * 0.04)
    m = F.least(F.coalesce("magnitude", F.lit(0.0)), F.lit(1.0)) * 0.4
    pressure = F.when(F.col("age").between(22, 26) & (F.col("market_value").isNull() | (F.col("market_value") < 5e6)), 0.8).when(F.col("age").between(20, 28), 0.3).otherwise(0.0)
    return t.select(
        "player_key", "age", F.round("percentile", 4).alias("percentile"), "p1",
        F.least(F.lit(0.98), F.round(1.0 - (1.0 - F.col("p1")) * (1.0 - F.col("p1") * decay), 4)).alias("p2"),
        X.tiers(F.col("p1"), [(0.72, "imminent"), (0.50, "likely"), (0.28, "possible")], "unlikely").alias("category"),
        F.round(F.when(F.col("direction") == "improving", 0.6 + m).when(F.col("direction") == "declining", 0.4 - m).otherwise(0.5), 4).alias("trajectory_score"),
        pressure.alias("contract_pressure"),
    )


