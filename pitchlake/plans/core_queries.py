"""Queries over appearances: totals, form, scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from pitchlake.operators import features
from pitchlake.plans.registry import VIEWS, query
from pitchlake.sources import driver_views as D


def on_date():
    return F.lit(D.REFERENCE_DATE).cast("date")


VIEWS["v_app"] = """
SELECT o_custkey AS player_key, o_orderkey AS seq, o_orderdate::DATE AS match_date, o_orderpriority AS competition, o_orderstatus AS source,
  sum(l_quantity)::BIGINT % 96 AS minutes, count(*) FILTER (l_returnflag = 'R' AND l_linestatus = 'F') AS goals,
  count(*) FILTER (l_returnflag = 'A' AND l_linestatus = 'F') AS assists, count(*) AS shots, sum(l_linenumber)::BIGINT AS passes,
  count(*) FILTER (l_discount >= 0.09) AS yellow, count(*) FILTER (l_tax >= 0.08) AS red,
  CASE WHEN o_orderstatus <> 'P' THEN sum(round(l_tax * 100)::BIGINT)::BIGINT / 100.0::DOUBLE END AS xg
FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_custkey, o_orderkey, o_orderdate, o_orderpriority, o_orderstatus"""
VIEWS["v_players"] = """
SELECT c_custkey AS player_key, c_name AS player_name, c_mktsegment AS position, n_name AS club,
  DATE '1965-01-01' + (c_custkey * 37 % 7665)::INTEGER AS dob, round(abs(c_acctbal) * 1000, 2) AS market_value
FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey"""
VIEWS["v_matches"] = """
SELECT o_orderkey AS match_id, o_orderdate::DATE AS match_date, o_orderpriority AS competition, h.n_name AS home_club, a.n_name AS away_club, home_score, away_score
FROM orders JOIN (SELECT l_orderkey, arg_min(l_suppkey, (l_linenumber, l_suppkey)) AS away_supp, count(*) FILTER (l_returnflag = 'R') AS home_score,
    count(*) FILTER (l_returnflag = 'A') AS away_score FROM lineitem GROUP BY 1) s ON o_orderkey = l_orderkey
  LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN supplier ON away_supp = s_suppkey
  LEFT JOIN nation h ON c_nationkey = h.n_nationkey LEFT JOIN nation a ON s_nationkey = a.n_nationkey"""
VIEWS["v_transfers"] = """
SELECT o_custkey AS player_key, l_shipdate::DATE AS date, year(l_shipdate) AS season, l_orderkey, l_linenumber, l_partkey, l_suppkey,
  h.n_name AS from_club, a.n_name AS to_club, l_extendedprice AS fee, l_returnflag = 'N' AS loan
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey
  JOIN nation h ON c_nationkey = h.n_nationkey JOIN nation a ON s_nationkey = a.n_nationkey"""
VIEWS["v_totals"] = """
SELECT player_key, count(*) AS matches, sum(minutes)::BIGINT AS minutes, sum(goals)::BIGINT AS goals, sum(assists)::BIGINT AS assists,
  sum(shots)::BIGINT AS shots, sum(passes)::BIGINT AS passes, sum(yellow)::BIGINT AS yellow, sum(red)::BIGINT AS red
FROM v_app GROUP BY player_key"""
VIEWS["v_ranked"] = """
SELECT *, row_number() OVER (PARTITION BY player_key ORDER BY match_date DESC NULLS LAST, seq DESC) AS rn,
  row_number() OVER (PARTITION BY player_key ORDER BY match_date NULLS FIRST, seq) AS k, count(*) OVER (PARTITION BY player_key) AS n,
  CASE WHEN minutes > 0 THEN round((goals + assists)::DOUBLE / minutes * 90.0, 3) END AS gc
FROM v_app"""
VIEWS["v_consistency"] = """
SELECT player_key, coalesce(round(least(100.0::DOUBLE, greatest(0.0::DOUBLE, 100.0 - stddev_pop(gc) * 25.0)), 3), 0.0) AS consistency
FROM v_ranked WHERE rn <= 5 GROUP BY player_key"""
P90 = "CASE WHEN minutes > 0 THEN round(({})::DOUBLE / minutes * 90.0, 3) END"
AGE = "(2002 - year(dob) - CASE WHEN month(dob) = 1 AND day(dob) = 1 THEN 0 ELSE 1 END)::INTEGER"
VIEWS["v_kpi0"] = f"""
SELECT *, round(base_kpi * CASE WHEN age IS NULL THEN 1.0::DOUBLE WHEN age < 21 THEN 1.10::DOUBLE WHEN age < 25 THEN 1.05::DOUBLE WHEN age < 30 THEN 1.0::DOUBLE ELSE 0.95::DOUBLE END, 3) AS age_kpi
FROM (SELECT t.*, {AGE} AS age, consistency,
  round(coalesce({P90.format('goals + assists')}, 0.0) * 0.45::DOUBLE + coalesce({P90.format('shots')}, 0.0) * 0.20::DOUBLE + coalesce({P90.format('passes')}, 0.0) * 0.15::DOUBLE
    + consistency / 100.0::DOUBLE * 0.20::DOUBLE, 3) AS base_kpi
  FROM v_totals t JOIN v_consistency USING (player_key) LEFT JOIN v_players USING (player_key))"""
BUCKET = "CASE WHEN minutes >= 1800 THEN 'starter' WHEN minutes >= 900 THEN 'rotation' WHEN minutes >= 1 THEN 'fringe' ELSE 'none' END"


@query(
    "player_totals",
    f"""SELECT player_key, matches, minutes, goals, assists, shots, yellow, red, goals + assists AS goal_contributions, {P90.format('goals')} AS goals_per_90,
  {P90.format('goals + assists')} AS gc_per_90, yellow + 2 * red AS discipline, {BUCKET} AS minutes_bucket FROM v_totals""",
)
def player_totals(spark, sf_dir):
    return features.player_totals(D.appearances(spark, sf_dir))


@query("match_features", "SELECT match_id, home_score - away_score AS score_difference, home_score = away_score AS is_draw, home_score + away_score AS total_goals FROM v_matches")
def match_features(spark, sf_dir):
    return features.match_features(D.matches(spark, sf_dir))


@query(
    "transfer_features",
    """SELECT player_key, count(*) AS transfers, count(*) FILTER (loan) AS loans, (sum(fee::DECIMAL(18,2)) FILTER (NOT loan))::DOUBLE AS total_fee,
  round((sum(fee::DECIMAL(18,2)) FILTER (NOT loan))::DOUBLE / nullif(count(*) FILTER (NOT loan), 0), 2) AS mean_fee,
  arg_min(fee, (date, l_orderkey, l_linenumber, l_partkey, l_suppkey)) FILTER (NOT loan) AS first_fee,
  arg_max(fee, (date, l_orderkey, l_linenumber, l_partkey, l_suppkey)) FILTER (NOT loan) AS last_fee,
  round(arg_max(fee, (date, l_orderkey, l_linenumber, l_partkey, l_suppkey)) FILTER (NOT loan)
    / nullif(arg_min(fee, (date, l_orderkey, l_linenumber, l_partkey, l_suppkey)) FILTER (NOT loan), 0.0), 3) AS resale_multiple,
  array_to_string(list_sort(list_distinct(list(to_club))), ',') AS clubs
FROM v_transfers GROUP BY player_key""",
)
def transfer_features(spark, sf_dir):
    return features.transfer_features(D.transfers(spark, sf_dir))


def _form_sql() -> str:
    parts = [
        f"round(avg({m}) FILTER (r_{m} <= {n}), 3) AS {m}_last_{n}" for m in ("xg", "assists", "minutes") for n in (3, 5, 10)
    ]
    ranks = ", ".join(
        f"CASE WHEN {m} IS NOT NULL THEN row_number() OVER (PARTITION BY player_key, {m} IS NULL ORDER BY match_date DESC NULLS LAST, seq DESC) END AS r_{m}" for m in ("xg", "assists", "minutes")
    )
    return f"SELECT player_key, {', '.join(parts)} FROM (SELECT *, {ranks} FROM v_app) GROUP BY player_key"


@query("rolling_form", _form_sql())
def rolling_form(spark, sf_dir):
    return features.rolling_form(D.appearances(spark, sf_dir), ("xg", "assists", "minutes"))


@query("consistency", "SELECT player_key, consistency FROM v_consistency")
def consistency(spark, sf_dir):
    return features.consistency(D.appearances(spark, sf_dir))


@query("kpi", "SELECT player_key, matches, minutes, goals, assists, shots, passes, age, consistency, base_kpi, age_kpi AS age_adjusted_kpi FROM v_kpi0")
def kpi(spark, sf_dir):
    return features.kpi(D.appearances(spark, sf_dir), D.players(spark, sf_dir), on_date())


VIEWS["v_xg"] = """
SELECT player_key, sum(round(xg * 100)::BIGINT)::BIGINT AS xg100, max(CASE WHEN xg IS NOT NULL THEN 1 ELSE 0 END) = 1 AS has_xg FROM v_app GROUP BY player_key"""
VIEWS["v_expected"] = f"""
SELECT player_key, xg, round(assists * 0.85::DOUBLE, 3) AS xa, CASE WHEN passes > 0 THEN {P90.format('passes * 0.05::DOUBLE')} END AS xt_per_90,
  {P90.format('goals * 2.0::DOUBLE + assists * 1.5::DOUBLE + shots * 0.08::DOUBLE')} AS epv_per_90,
  round(goals * 2.5::DOUBLE + assists * 1.8::DOUBLE + shots * 0.15::DOUBLE, 3) AS obv, {P90.format('xg')} AS xg_per_90, {P90.format('round(assists * 0.85::DOUBLE, 3)')} AS xa_per_90,
  CASE WHEN minutes > 0 THEN least(10.0::DOUBLE, round(10.0::DOUBLE * {P90.format('goals + assists')}, 3)) ELSE 10.0::DOUBLE END AS progression
FROM (SELECT t.*, round(CASE WHEN has_xg THEN xg100 / 100.0::DOUBLE WHEN shots > 0 THEN 0.6::DOUBLE * (shots * 0.10::DOUBLE) + 0.4::DOUBLE * goals END, 3) AS xg
  FROM v_totals t JOIN v_xg USING (player_key))"""


@query("expected_metrics", "SELECT * FROM v_expected")
def expected_metrics(spark, sf_dir):
    return features.expected_metrics(D.appearances(spark, sf_dir))


@query(
    "expected_metrics_v1",
    f"""SELECT player_key, minutes, goals, assists, xg, round(goals - xg, 3) AS goals_minus_xg, {P90.format('passes')} AS passes_per_90, {P90.format('shots')} AS shots_per_90,
  round(coalesce({P90.format('passes')}, 0.0) * 0.5::DOUBLE + coalesce({P90.format('shots')}, 0.0) * 0.3::DOUBLE + coalesce({P90.format('assists')}, 0.0) * 0.2::DOUBLE, 3) AS progression
FROM (SELECT t.*, coalesce(xg100, 0) / 100.0::DOUBLE AS xg FROM v_totals t JOIN v_xg USING (player_key))""",
)
def expected_metrics_v1(spark, sf_dir):
    return features.expected_metrics_v1(D.appearances(spark, sf_dir))


VIEWS["v_mode"] = """
SELECT player_key, competition FROM (SELECT player_key, competition, row_number() OVER (PARTITION BY player_key ORDER BY count(*) DESC, min((match_date, seq))) AS i
  FROM v_app GROUP BY player_key, competition) WHERE i = 1"""


@query("main_competition", "SELECT * FROM v_mode")
def main_competition(spark, sf_dir):
    return features.mode_value(D.appearances(spark, sf_dir), "competition", "competition")
