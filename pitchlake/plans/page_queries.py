"""Pages of one entity or of a list: first name match, stored or generated, neighbours, reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from pitchlake.operators import clubs, quality, serving, similarity, timeseries
from pitchlake.plans.club_queries import FEATURES, decisions_of, feature_store, features_of, fit_of, projected_of, reports, similar_top5_v1
from pitchlake.plans.data_queries import success_of
from pitchlake.plans.registry import ORACLES, VIEWS, query
from pitchlake.plans.score_queries import drift_of, pathway_of, valuation_of
from pitchlake.sources import driver_views as D
from pitchlake.sources.shared import cut

VIEWS["v_near"] = ORACLES["similar_top5_v1"]
VIEWS["v_store"] = ORACLES["feature_store"]
VIEWS["v_reports"] = ORACLES["reports"]


def _names(spark, sf_dir):
    return D.players(spark, sf_dir).select("player_key", "player_name")


@query("neighbours_page", """SELECT a.player_key, CASE WHEN p.player_key IS NULL THEN 'unknown' WHEN n.player_key IS NULL THEN 'no_vector' ELSE 'ok' END AS state, rank, other, distance
FROM (SELECT unnest([11, 12, 77, 999999999])::BIGINT AS player_key) a LEFT JOIN v_players p ON a.player_key = p.player_key LEFT JOIN v_norm n ON a.player_key = n.player_key LEFT JOIN v_near s ON a.player_key = s.key AND rank <= 3""")
def neighbours_page(spark, sf_dir):
    """Three neighbours of players that are known, without a vector or unknown."""
    asked = spark.createDataFrame([(11,), (12,), (77,), (999999999,)], "player_key long")
    found = features_of(spark, sf_dir)
    scaled = similarity.min_max(found, FEATURES).select(F.col("player_key").alias("key"), F.array(*FEATURES).alias("v"))
    near = similarity.nearest(scaled.join(F.broadcast(asked), F.col("key") == F.col("player_key"), "left_semi"), 3, others=scaled)
    return serving.neighbours_of(asked, D.players(spark, sf_dir), found, near, 3)


@query("pathway_of_player", "SELECT player_key, trajectory, success, stage FROM v_pathway WHERE player_key = 11")
def pathway_of_player(spark, sf_dir):
    return serving.listing(pathway_of(spark, sf_dir), {"player_key": 11}).select("player_key", "trajectory", "success", "stage")


@query("club_fit_first_named", "SELECT f.player_key, player_name, rank, f.club, fit FROM v_fit f JOIN v_players p ON f.player_key = p.player_key WHERE player_name LIKE '%77%' ORDER BY f.player_key, rank LIMIT 1")
def club_fit_first_named(spark, sf_dir):
    t = fit_of(spark, sf_dir).join(_names(spark, sf_dir), "player_key")
    return serving.first_named(t, "77", [F.col("player_key"), F.col("rank")]).select("player_key", "player_name", "rank", "club", "fit")


@query("club_fit_page", "SELECT player_key, rank, club, fit FROM v_fit ORDER BY player_key, rank LIMIT 30 OFFSET 10")
def club_fit_page(spark, sf_dir):
    return serving.page(fit_of(spark, sf_dir), [F.col("player_key"), F.col("rank")], 10, 30).select("player_key", "rank", "club", "fit")


@query("feature_store_page", "SELECT player_key, player_name, base_kpi, score, risk, p1, score_norm FROM v_store WHERE player_name LIKE '%1%' ORDER BY player_key LIMIT 20 OFFSET 5")
def feature_store_page(spark, sf_dir):
    t = serving.named(feature_store(spark, sf_dir), "1")
    return serving.page(t, [F.col("player_key")], 5, 20).select("player_key", "player_name", "base_kpi", "score", "risk", "p1", "score_norm")


@query("decision_first_named", "SELECT player_key, player_name, decision, sure FROM v_decisions JOIN v_players USING (player_key) WHERE player_name LIKE '%77%' ORDER BY player_key LIMIT 1")
def decision_first_named(spark, sf_dir):
    t = decisions_of(spark, sf_dir).join(_names(spark, sf_dir), "player_key")
    return serving.first_named(t, "77", [F.col("player_key")]).select("player_key", "player_name", "decision", "sure")


@query("simulations_page", "SELECT j.player_key, player_name, league, projected_kpi, projected_value FROM v_projected j JOIN v_players p ON j.player_key = p.player_key WHERE player_name LIKE '%77%' ORDER BY j.player_key, ord LIMIT 12 OFFSET 2")
def simulations_page(spark, sf_dir):
    t = serving.named(projected_of(spark, sf_dir).join(_names(spark, sf_dir), "player_key"), "77")
    return serving.page(t, [F.col("player_key"), F.col("ord")], 2, 12).select("player_key", "player_name", "league", "projected_kpi", "projected_value")


@query("reports_page", "SELECT player_key, decision, report FROM v_reports JOIN v_decisions USING (player_key) WHERE decision = 'HOLD' ORDER BY player_key LIMIT 10 OFFSET 3")
def reports_page(spark, sf_dir):
    t = reports(spark, sf_dir).join(serving.listing(decisions_of(spark, sf_dir), {"decision": "HOLD"}).select("player_key", "decision"), "player_key")
    return serving.page(t, [F.col("player_key")], 3, 10).select("player_key", "decision", "report")


@query("report_stored_or_generated", "SELECT player_key, report, CASE WHEN player_key % 2 = 0 THEN 'stored' ELSE 'generated' END AS origin FROM v_reports JOIN v_players USING (player_key) WHERE player_name LIKE '%7%' AND report IS NOT NULL")
def report_stored_or_generated(spark, sf_dir):
    """Reports of players by name; here those of even keys are stored, and the others generated."""
    made = cut(reports(spark, sf_dir))  # read twice
    keys = serving.named(_names(spark, sf_dir), "7").select("player_key")
    return serving.stored_or_made(keys, made.filter("player_key % 2 = 0"), made, "report")


@query("decision_of_player", "SELECT player_key, decision, buy, sell, sure, reasons FROM v_decisions WHERE player_key = 11")
def decision_of_player(spark, sf_dir):
    return serving.listing(decisions_of(spark, sf_dir), {"player_key": 11}).select("player_key", "decision", "buy", "sell", "sure", "reasons")


@query("pathway_learning_page")
def pathway_learning_page(spark, sf_dir):
    """Learned chances of players by name; the trees are beyond SQL."""
    asked = serving.named(_names(spark, sf_dir), "77")
    t = success_of(spark, sf_dir, asked.select("player_key")).join(asked, "player_key")
    return serving.page(t, [F.desc("success"), F.col("player_key")], 0, 20)


@query("enriched_neighbours", """SELECT key, rank, other, distance, p.position, p.club, v.score, v.tier
FROM v_near s LEFT JOIN v_players p ON other = p.player_key LEFT JOIN (SELECT player_key, score, tier FROM v_value) v ON other = v.player_key""")
def enriched_neighbours(spark, sf_dir):
    """Neighbours with the valuation of the other; position (of every other player) and club are filled in where they lack."""
    near = similar_top5_v1(spark, sf_dir)
    given = D.players(spark, sf_dir).filter("player_key % 2 = 0").select(F.col("player_key").alias("other"), "position")
    rows = near.join(given, "other", "left").withColumn("club", F.lit("")).select("key", "rank", "other", "distance", "position", "club")
    lookup = D.players(spark, sf_dir).select("player_key", "position", "club").join(valuation_of(spark, sf_dir).select("player_key", "score", "tier"), "player_key", "left").withColumnRenamed("player_key", "other")
    return serving.enriched(rows, lookup, "other", ["score", "tier"], ["position", "club"])


_ALIASES = {"nation_1": "First United", "nation_2": "Second City", "nation_24": "Never reached: nation_2 is in it", "tion_7": "Seventh"}


_EQUAL = "".join(f"WHEN lower(trim(text)) = '{a}' THEN '{c}' " for a, c in _ALIASES.items())
_INSIDE = "".join(f"WHEN contains(lower(trim(text)), '{a}') THEN '{c}' " for a, c in _ALIASES.items())


@query("club_aliases", f"""SELECT id, text, CASE WHEN trim(text) = '' THEN NULL {_EQUAL} {_INSIDE} ELSE trim(text) END AS canonical, CASE WHEN trim(text) = '' THEN NULL {_EQUAL} ELSE trim(text) END AS exact
FROM (SELECT n_nationkey AS id, CASE n_nationkey % 3 WHEN 0 THEN '  ' || n_name WHEN 1 THEN n_name || ' FC ' ELSE lower(n_name) END AS text FROM nation UNION ALL SELECT -1, '  ')""")
def club_aliases(spark, sf_dir):
    n = D.table(spark, sf_dir, "nation")
    k = F.col("n_nationkey") % 3
    text = F.when(k == 0, F.concat(F.lit("  "), "n_name")).when(k == 1, F.concat("n_name", F.lit(" FC "))).otherwise(F.lower("n_name"))
    t = n.select(F.col("n_nationkey").cast("long").alias("id"), text.alias("text")).unionByName(spark.createDataFrame([(-1, "  ")], "id long, text string"))
    return t.select("id", "text", clubs.canonical_club(F.col("text"), _ALIASES).alias("canonical"), clubs.canonical_club(F.col("text"), _ALIASES, False).alias("exact"))


@query("drift_report", """SELECT p.player_key, coalesce(anomalies, '') AS anomalies, coalesce(n, 0) AS anomaly_count, direction, magnitude, (SELECT count(*) FROM v_spikes) AS total_anomalies FROM v_players p
LEFT JOIN (SELECT player_key, count(*) AS n, string_agg(seq::VARCHAR || ':' || metric || ':' || kind, ',' ORDER BY seq, metric, kind) AS anomalies FROM v_spikes GROUP BY player_key) s ON p.player_key = s.player_key LEFT JOIN v_drift d ON p.player_key = d.player_key""")
def drift_report(spark, sf_dir):
    t = timeseries.drift_report(D.players(spark, sf_dir), timeseries.spikes(D.appearances(spark, sf_dir)), drift_of(spark, sf_dir))
    text = F.array_join(F.transform("anomalies", lambda a: F.concat_ws(":", a["seq"].cast("string"), a["metric"], a["kind"])), ",")
    return t.withColumn("anomalies", F.coalesce(text, F.lit(""))).select("player_key", "anomalies", "anomaly_count", "direction", "magnitude", "total_anomalies")


@query("global_total", "SELECT count(*) AS players, sum(market_value::DECIMAL(18,2))::DOUBLE AS market_value FROM v_players")
def global_total(spark, sf_dir):
    return D.players(spark, sf_dir).agg(F.count("*").alias("players"), F.sum(F.col("market_value").cast("decimal(18,2)")).cast("double").alias("market_value"))


@query("type_rules", "SELECT c_custkey AS id, concat_ws(',', CASE WHEN part IS NOT NULL AND NOT regexp_full_match(part, '[0-9]+') THEN 'part_not_int' END, CASE WHEN day IS NOT NULL AND TRY_CAST(day AS DATE) IS NULL THEN 'day_not_date' END) AS issues FROM (SELECT c_custkey, substr(c_name, 1 + c_custkey::INT % 14, 5) AS part, '2001-' || lpad((c_custkey % 14)::VARCHAR, 2, '0') || '-01' AS day FROM customer)")
def type_rules(spark, sf_dir):
    k = F.col("c_custkey")
    t = D.table(spark, sf_dir, "customer").select(k.alias("id"), F.col("c_name").substr((k % 14 + 1).cast("int"), F.lit(5)).alias("part"), F.concat(F.lit("2001-"), F.lpad((k % 14).cast("string"), 2, "0"), F.lit("-01")).alias("day"))
    return quality.type_issues(t, {"part": "int", "day": "date"}).select("id", F.array_join("type_issues", ",").alias("issues"))
