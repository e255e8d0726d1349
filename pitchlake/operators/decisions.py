"""Alerts, buy / sell / hold decisions, shortlists, feature store, reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pitchlake.functions import exprs as X
from pitchlake.operators.features import latest
from pitchlake.operators.similarity import min_max


def severity(x: Column, critical: float, high: float, medium: float) -> Column:
    return F.when(x >= critical, "critical").when(x >= high, "high").when(x >= medium, "medium").otherwise("low")


def alerts(valued: DataFrame, kpi: DataFrame, drift: DataFrame, confidence: DataFrame) -> DataFrame:
    """(player_key, kind, severity, measure) of undervalued, breakout and decline alerts."""
    v = valued.join(confidence.select("player_key", "confidence"), "player_key", "left")
    worth = F.col("computed_value") * X.or_default("confidence", 1.0)
    priced = F.col("market_value") > 0
    gap = F.round((worth / F.col("market_value") - 1.0) * 100, 1)
    under = v.filter(priced & (worth / F.col("market_value") >= 1.25)).select("player_key", F.lit("UNDERVALUED").alias("kind"), severity(gap, 100, 60, 30).alias("severity"), gap.alias("measure"))
    unpriced = v.filter(F.coalesce(~priced, F.lit(True)) & (F.col("score") >= 55)).select("player_key", F.lit("UNDERVALUED").alias("kind"), F.lit("medium").alias("severity"), F.col("score").alias("measure"))
    k = kpi.select("player_key", "age", "age_adjusted_kpi").join(drift.select("player_key", "direction", "magnitude"), "player_key")
    up = k.filter((F.coalesce("age", F.lit(99)) <= 23) & (F.col("age_adjusted_kpi") >= 8) & (F.col("direction") == "improving"))
    down = k.filter((F.coalesce("age", F.lit(0)) >= 26) & (F.col("direction") == "declining") & (F.col("magnitude") >= 0.25))
    return (
        under.unionByName(unpriced)
        .unionByName(up.select("player_key", F.lit("BREAKOUT").alias("kind"), severity(F.col("magnitude"), 0.8, 0.5, 0.25).alias("severity"), F.col("magnitude").alias("measure")))
        .unionByName(down.select("player_key", F.lit("DECLINE").alias("kind"), severity(F.col("magnitude"), 0.8, 0.55, 0.25).alias("severity"), F.col("magnitude").alias("measure")))
    )


def recent_trend(stats: DataFrame, n: int = 5) -> DataFrame:
    """Mean minutes of the last n rows, of all rows, and the difference."""
    t = stats.groupBy("player_key").agg(F.avg("minutes").alias("season")).join(latest(stats, n).groupBy("player_key").agg(F.avg("minutes").alias("recent")), "player_key")
    return t.select("player_key", F.round("recent", 2).alias("recent"), F.round("season", 2).alias("season"), F.round(F.col("recent") - F.col("season"), 2).alias("trend"))


def serving_alerts(valued: DataFrame, trend: DataFrame) -> DataFrame:
    """Undervalued players: critical breakouts if young and on the rise, else high."""
    t = valued.filter("undervalued").join(trend, "player_key", "left")
    hot = (F.col("trend") > 5) & (F.col("age") < 24)
    return t.select("player_key", F.when(hot, "BREAKOUT").otherwise("UNDERVALUED").alias("kind"), F.when(hot, "critical").otherwise("high").alias("severity"), "trend")


BUY = {"undervalued": 0.30, "potential": 0.25, "transfer": 0.20, "fit": 0.15, "confidence": 0.10}
SELL = {"market": 0.30, "declining": 0.25, "age": 0.20, "injury": 0.15, "peak": 0.10}


def decisions(rows: DataFrame) -> DataFrame:
    """BUY, SELL or HOLD with both scores, the decision's confidence and the reasons.

    rows: player_key, age, gap_pct, score, potential, p1, fit, confidence, blended_value, direction,
    magnitude, risk, kpi.
    """
    c = X.clamp
    gap, age, value = F.col("gap_pct"), F.col("age"), F.col("blended_value")
    mag = F.least(F.lit(1.0), F.coalesce("magnitude", F.lit(0.0)))
    part = {
        "b_undervalued": F.when(gap.isNull(), c((F.col("score") - 40) / 40, 0, 1)).when(gap <= 0, 0.0).otherwise(F.least(F.lit(1.0), gap / 200 + 0.20)),
        "b_potential": c((F.coalesce("potential", "score", F.lit(50.0)) - 30) / 70, 0, 1),
        "b_transfer": c(F.coalesce("p1", F.lit(0.0)), 0, 1),
        "b_fit": F.coalesce("fit", F.lit(0.0)),
        "b_confidence": X.or_default("confidence", 0.70),
        "s_market": F.when(F.coalesce(value, F.lit(0.0)) <= 0, 0.0).otherwise(F.least(F.lit(1.0), F.log10(F.greatest(value, F.lit(1e6))) / X.LOG10_50M)),
        "s_declining": F.when(F.col("direction") == "declining", 0.5 + 0.5 * mag).when(F.col("direction") == "stable", 0.2).otherwise(0.0),
        "s_age": F.when(age.isNull(), 0.2).when(age < 24, 0.0).when(age <= 27, (age - 24) / 6.0).when(age <= 30, 0.5 + (age - 27) / 8.0).otherwise(F.least(F.lit(1.0), 0.875 + 0.06 * (age - 30))),
        "s_injury": c(F.when(F.col("risk") > 1, F.col("risk") / 100).otherwise(F.coalesce("risk", F.lit(0.0))), 0, 1),
        "s_peak": F.when(age.isNull(), 0.2).when(age.between(26, 28) & F.col("direction").isin("stable", "declining") & (F.col("kpi") >= 9), F.least(F.lit(1.0), 0.5 + (F.col("kpi") - 9) / 10)).otherwise(0.1),
    }
    t = rows.withColumns(part)
    weigh = lambda weights, p: F.round(sum([F.col(p + k) * w for k, w in weights.items()], F.lit(0.0)), 4)
    t = t.withColumns({"buy": weigh(BUY, "b_"), "sell": weigh(SELL, "s_")})
    t = t.withColumn("decision", F.when((F.col("buy") >= 0.62) & (F.col("buy") > F.col("sell")), "BUY").when((F.col("sell") >= 0.55) & (F.col("sell") >= F.col("buy")), "SELL").otherwise("HOLD"))
    d = F.col("decision")
    sure = F.when(d == "BUY", F.least(F.lit(1.0), F.col("buy") / 0.9)).when(d == "SELL", F.least(F.lit(1.0), F.col("sell") / 0.9)).otherwise(1.0 - F.abs(F.col("buy") - F.col("sell")))
    why = lambda when, cond, text: F.when((d == when) & cond, text)
    reasons = F.concat_ws(
        "; ",
        why("BUY", F.col("b_undervalued") > 0.4, "undervalued"), why("BUY", F.col("b_potential") > 0.6, "high potential"), why("BUY", F.col("b_transfer") > 0.5, "likely to move"), why("BUY", F.col("b_fit") > 0.7, "strong club fit"),
        why("SELL", F.col("s_market") > 0.5, "strong market value"), why("SELL", F.col("s_declining") > 0.4, "declining"), why("SELL", F.col("s_age") > 0.5, "age"), why("SELL", F.col("s_injury") > 0.5, "injury risk"), why("SELL", F.col("s_peak") > 0.5, "near peak value"),
        why("HOLD", F.col("buy") > 0.4, "close to buying"), why("HOLD", F.col("sell") > 0.4, "some pressure to sell"), why("HOLD", F.lit(True), "no strong signal"),
    )
    return t.select("player_key", "buy", "sell", "decision", F.round(sure, 3).alias("sure"), reasons.alias("reasons"))


def decision_order(c: str = "decision") -> Column:
    return F.when(F.col(c) == "BUY", 0).when(F.col(c) == "HOLD", 1).otherwise(2)


def shortlist(valued: DataFrame, kpi: DataFrame, transfer: DataFrame, players: DataFrame, position: str | None = None, max_age: int | None = None, max_value: float | None = None, top: int = 15) -> DataFrame:
    """The `top` candidates: 0.4 form, 0.3 price gap, 0.3 chance of a move."""
    t = (
        valued.select("player_key", "computed_value", "market_value", "undervalued", "age").join(kpi.select("player_key", F.col("base_kpi").alias("kpi")), "player_key", "left")
        .join(transfer.select("player_key", "p1"), "player_key", "left").join(players.select("player_key", "player_name", "position"), "player_key", "left")
    )
    t = t.withColumns({"age": X.or_default("age", 24), "kpi": X.or_default("kpi", 7.5), "p1": X.or_default("p1", 0.65), "position": F.coalesce("position", F.lit("CM")), "market": X.or_default("market_value", F.col("computed_value"))})
    if position:
        t = t.filter(F.lower("position").contains(position.lower()))
    if max_age is not None:
        t = t.filter(F.col("age") <= max_age)
    if max_value is not None:
        t = t.filter(F.col("market") <= max_value)
    form = X.clamp(12 * F.col("kpi"), 0, 100)
    gap = F.when((F.col("market") <= 0) | (F.col("computed_value") <= F.col("market")), 25.0).otherwise(X.clamp((F.col("computed_value") - F.col("market")) / F.col("market") * 100, 0, 100))
    t = t.withColumn("points", F.round(0.4 * form + 0.3 * gap + 0.3 * 100 * F.col("p1"), 2))
    out = t.select("player_key", "player_name", "position", "age", "points", F.round(0.85 + F.col("points") / 500, 3).alias("fit"), F.when(F.col("undervalued"), "low").otherwise("medium").alias("risk_label"))
    return out.orderBy(F.desc("points"), "player_key").limit(top)


def feature_store(keys: DataFrame, tables: list[DataFrame], normalize: list[str]) -> DataFrame:
    """keys left-joined with every table on player_key, and *_norm of the named columns: 0..1, null without a range."""
    t = keys
    for other in tables:
        t = t.join(other, "player_key", "left")
    span = t.agg(*[F.min(c).alias(f"__lo_{c}") for c in normalize], *[F.max(c).alias(f"__hi_{c}") for c in normalize])
    norm = {f"{c}_norm": F.round((F.col(c) - F.col(f"__lo_{c}")) / F.nullif(F.col(f"__hi_{c}") - F.col(f"__lo_{c}"), F.lit(0)), 4) for c in normalize}
    return t.crossJoin(F.broadcast(span)).withColumns(norm).select(*t.columns, *norm)


def report_lines(rows: DataFrame) -> DataFrame:
    """A text per player from name, club, position, age, score, tier, value, risk tier and decision."""
    line = lambda label, c: F.concat(F.lit(f"{label}: "), F.coalesce(c.cast("string"), F.lit("n/a")))
    text = F.concat_ws(
        "\n",
        F.concat(F.lit("# "), F.col("player_name")), line("Club", F.col("club")), line("Position", F.col("position")), line("Age", F.col("age")),
        line("Tier", F.col("tier")), F.concat(F.lit("Value: EUR "), X.eur_text("computed_value")), line("Risk", F.col("risk_tier")), line("Decision", F.col("decision")),
    )
    return rows.select("player_key", text.alias("report"))


def normalized(rows: DataFrame, columns: list[str]) -> DataFrame:
    return min_max(rows, columns)
