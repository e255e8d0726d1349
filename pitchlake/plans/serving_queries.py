"""Serving reads over the derived tables: filter, sort, page."""

from __future__ import annotations

from pyspark.sql import functions as F

from pitchlake.functions import exprs as X
from pitchlake.operators import decisions, features, identity, serving
from pitchlake.plans.club_queries import alerts_of, decisions_of, projected_of
from pitchlake.plans.data_queries import changed_keys, edges_of, market_value_analytic
from pitchlake.plans.registry import ORACLES, VIEWS, query
from pitchlake.plans.score_queries import drift_of, kpi_of, pathway_of, risk_of, transfer_of, valuation_of
from pitchlake.sources import driver_views as D


def _named(spark, sf_dir, rows):
    return rows.join(D.players(spark, sf_dir).select("player_key", "player_name"), "player_key")


@query("value_listing", "SELECT player_key, score, computed_value, tier FROM v_value WHERE tier = 'mid' ORDER BY score DESC, player_key LIMIT 25 OFFSET 5")
def value_listing(spark, sf_dir):
    t = serving.listing(valuation_of(spark, sf_dir), {"tier": "mid"})
    return serving.page(t, [F.desc("score"), F.col("player_key")], 5, 25).select("player_key", "score", "computed_value", "tier")


@query("pathway_page", "SELECT player_key, trajectory, success, stage FROM v_pathway ORDER BY success DESC, player_key LIMIT 30")
def pathway_page(spark, sf_dir):
    return serving.page(pathway_of(spark, sf_dir), [F.desc("success"), F.col("player_key")], 0, 30).select("player_key", "trajectory", "success", "stage")


@query("alerts_page", """SELECT player_key, kind, severity, measure FROM v_alerts WHERE kind = 'DECLINE'
ORDER BY CASE severity WHEN 'critical' THEN 0 WHEN 'high' THEN 1 WHEN 'medium' THEN 2 ELSE 3 END, measure DESC, player_key LIMIT 40""")
def alerts_page(spark, sf_dir):
    order = F.when(F.col("severity") == "critical", 0).when(F.col("severity") == "high", 1).when(F.col("severity") == "medium", 2).otherwise(3)
    return serving.page(serving.listing(alerts_of(spark, sf_dir), {"kind": "DECLINE"}), [order, F.desc("measure"), F.col("player_key")], 0, 40)


@query("decisions_page", """SELECT player_key, player_name, decision, sure FROM v_decisions JOIN v_players USING (player_key) WHERE sure >= 0.6 AND player_name LIKE '%2%'
ORDER BY CASE decision WHEN 'BUY' THEN 0 WHEN 'HOLD' THEN 1 ELSE 2 END, sure DESC, player_key LIMIT 40""")
def decisions_page(spark, sf_dir):
    t = serving.named(serving.listing(_named(spark, sf_dir, decisions_of(spark, sf_dir)), None, {"sure": 0.6}), "2")
    return serving.page(t, [decisions.decision_order(), F.desc("sure"), F.col("player_key")], 0, 40).select("player_key", "player_name", "decision", "sure")


@query("decision_or_default", """SELECT player_key, coalesce(decision, CASE WHEN coalesce(nullif(computed_value, 0.0), 12e6) > coalesce(nullif(market_value, 0.0), 15e6) THEN 'BUY' ELSE 'HOLD' END) AS decision
FROM v_value LEFT JOIN (SELECT player_key, decision FROM v_decisions WHERE player_key % 2 = 0) d USING (player_key)""")
def decision_or_default(spark, sf_dir):
    """The stored decision, here of every other player, else BUY where the computed value is above the market's."""
    stored = decisions_of(spark, sf_dir).filter("player_key % 2 = 0").select("player_key", "decision")
    t = valuation_of(spark, sf_dir).join(stored, "player_key", "left")
    other = F.when(X.or_default("computed_value", 12e6) > X.or_default("market_value", 15e6), "BUY").otherwise("HOLD")
    return t.select("player_key", F.coalesce("decision", other).alias("decision"))


@query("player_profile", """SELECT player_key, player_name, score, base_kpi, risk, recent, season, trend FROM v_players JOIN (SELECT player_key, score FROM v_value) USING (player_key) JOIN (SELECT player_key, base_kpi FROM v_kpi0) USING (player_key)
JOIN (SELECT player_key, risk FROM v_risk) USING (player_key) JOIN v_recent USING (player_key) WHERE player_key = 11""")
def player_profile(spark, sf_dir):
    one = lambda t: serving.listing(t, {"player_key": 11})
    return (
        one(D.players(spark, sf_dir)).select("player_key", "player_name").join(one(valuation_of(spark, sf_dir)).select("player_key", "score"), "player_key").join(one(kpi_of(spark, sf_dir)).select("player_key", "base_kpi"), "player_key")
        .join(one(risk_of(spark, sf_dir)).select("player_key", "risk"), "player_key").join(decisions.recent_trend(one(D.appearances(spark, sf_dir))), "player_key")
    )


VIEWS["v_analytic"] = ORACLES["market_value_analytic"]


@query("market_value_page", "SELECT player_key, player_name, club, analytic FROM v_players JOIN v_analytic USING (player_key) WHERE player_name LIKE '%77%' ORDER BY player_key LIMIT 10")
def market_value_page(spark, sf_dir):
    t = serving.named(D.players(spark, sf_dir), "77").join(market_value_analytic(spark, sf_dir), "player_key")
    return serving.page(t, [F.col("player_key")], 0, 10).select("player_key", "player_name", "club", "analytic")


@query("projection_of_player", "SELECT league, projected_kpi, projected_value, months FROM v_projected WHERE player_key = 3")
def projection_of_player(spark, sf_dir):
    return serving.listing(projected_of(spark, sf_dir), {"player_key": 3}).select("league", "projected_kpi", "projected_value", "months")


@query("risk_listing", "SELECT player_key, risk, tier FROM v_risk WHERE tier = 'elevated' ORDER BY risk DESC, player_key LIMIT 50")
def risk_listing(spark, sf_dir):
    return serving.page(serving.listing(risk_of(spark, sf_dir), {"tier": "elevated"}), [F.desc("risk"), F.col("player_key")], 0, 50).select("player_key", "risk", "tier")


@query("advanced_page", "SELECT player_key, xg, xa, obv FROM v_expected ORDER BY obv DESC NULLS LAST, player_key LIMIT 20 OFFSET 20")
def advanced_page(spark, sf_dir):
    return serving.page(features.expected_metrics(D.appearances(spark, sf_dir)), [serving.sort_key("-obv"), F.col("player_key")], 20, 20).select("player_key", "xg", "xa", "obv")


@query("neighbour_enrichment", "SELECT src, dst, w, mean_score FROM v_edges LEFT JOIN (SELECT club, round(avg(score), 3) AS mean_score FROM v_value GROUP BY club) ON dst = club")
def neighbour_enrichment(spark, sf_dir):
    """Edges with the mean valuation at their destination, where it is known."""
    mean = valuation_of(spark, sf_dir).groupBy(F.col("club").alias("dst")).agg(F.round(F.avg("score"), 3).alias("mean_score"))
    return edges_of(spark, sf_dir).join(mean, "dst", "left").select("src", "dst", "w", "mean_score")


_SAMPLED = (("players", "v_players", ("player_key",)), ("matches", "v_matches", ("match_id",)), ("stats", "v_app", ("seq", "player_key")), ("transfers", "v_transfers", ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "fee")))


def _sampled_sql(entity: str, view: str, keys: tuple[str, ...]) -> str:
    text = " || '/' || ".join(f"{k}::VARCHAR" for k in keys[:4])
    return f"SELECT '{entity}' AS entity, n AS rows, i, sample FROM (SELECT count(*) AS n FROM {view}), (SELECT row_number() OVER (ORDER BY {', '.join(keys)}) AS i, {text} AS sample FROM {view} ORDER BY {', '.join(keys)} LIMIT 5)"


@query("load_verification", " UNION ALL ".join(_sampled_sql(*t) for t in _SAMPLED))
def load_verification(spark, sf_dir):
    """How many rows each table has, and its first five."""
    tables = {"players": D.players, "matches": D.matches, "stats": D.appearances, "transfers": D.transfers}
    out = None
    for entity, _, keys in _SAMPLED:
        t = tables[entity](spark, sf_dir)
        few = identity.smallest(t, keys, 5, [F.concat_ws("/", *[F.col(k).cast("string") for k in keys[:4]]).alias("sample")])
        part = t.agg(F.lit(entity).alias("entity"), F.count("*").alias("rows")).crossJoin(F.broadcast(few))  # five rows
        out = part if out is None else out.unionByName(part)
    return out.select("entity", "rows", F.col("i").cast("long").alias("i"), "sample")


@query("batch_summary", "SELECT count(*) AS changed, count(*) FILTER (event_id % 7 = 0) AS new_keys, count(*) FILTER (event_id % 7 <> 0) AS updated_keys FROM events WHERE event_id % 7 IN (0, 1)")
def batch_summary(spark, sf_dir):
    return changed_keys(spark, sf_dir).agg(F.count("*").alias("changed"), F.count_if("is_new").alias("new_keys"), F.count_if(~F.col("is_new")).alias("updated_keys"))


@query("known_and_unknown", "SELECT user_id, count(*) AS events FROM events WHERE user_id NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 2 = 0) GROUP BY user_id")
def known_and_unknown(spark, sf_dir):
    known = D.table(spark, sf_dir, "customer").filter("c_custkey % 2 = 0").select(F.col("c_custkey").alias("user_id"))
    return D.table(spark, sf_dir, "events").join(known, "user_id", "left_anti").groupBy("user_id").agg(F.count("*").alias("events"))


@query("competition_totals", "SELECT competition, count(*) AS rows, sum(goals)::BIGINT AS goals, count(DISTINCT player_key) AS players FROM v_app GROUP BY competition")
def competition_totals(spark, sf_dir):
    return D.appearances(spark, sf_dir).groupBy("competition").agg(F.count("*").alias("rows"), F.sum("goals").alias("goals"), F.count_distinct("player_key").alias("players"))


@query("drift_summary", "SELECT direction, count(*) AS players, round(avg(magnitude), 4) AS magnitude FROM v_drift GROUP BY direction")
def drift_summary(spark, sf_dir):
    return drift_of(spark, sf_dir).groupBy("direction").agg(F.count("*").alias("players"), F.round(F.avg("magnitude"), 4).alias("magnitude"))


@query("likely_by_club", "SELECT club, count(*) FILTER (p1 >= 0.5) AS likely, count(*) AS players FROM v_transfer_p JOIN v_players USING (player_key) GROUP BY club")
def likely_by_club(spark, sf_dir):
    t = transfer_of(spark, sf_dir).select("player_key", "p1").join(D.players(spark, sf_dir).select("player_key", "club"), "player_key")
    return t.groupBy("club").agg(F.count_if(F.col("p1") >= 0.5).alias("likely"), F.count("*").alias("players"))
