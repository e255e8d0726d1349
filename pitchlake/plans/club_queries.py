"""Queries over clubs, similarity, alerts, decisions and serving views."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitchlake.functions import exprs as X
from pitchlake.operators import clubs, decisions, features, scores, similarity, timeseries
from pitchlake.plans.core_queries import P90, on_date
from pitchlake.plans.registry import ORACLES, VIEWS, once, query
from pitchlake.plans.score_queries import AGELESS, TREND_LIMIT, base, club_points, league_points, transfer_from, confidence_index, drift_of, kpi_of, pathway_of, risk_of, transfer_of, valuation_of
from pitchlake.sources import driver_views as D
from pitchlake.sources.shared import cut
from pitchlake.streaming.cascade import Derived, rebuild

BASELINE = "NATION_0"


def moves_of(spark, sf_dir):
    weights = D.clubs(spark, sf_dir).select("club", (F.col("ord") * 1.0).alias("weight"))
    return clubs.destination_quality(D.transfers(spark, sf_dir), weights, most=250_000.0)


VIEWS["v_live"] = """
SELECT c.club, coalesce(players, 0) AS players, mean_kpi, mean_consistency, players IS NOT NULL AS live FROM v_clubs c LEFT JOIN (
  SELECT club, count(*) AS players, round(avg(base_kpi), 2) AS mean_kpi, round(avg(consistency), 3) AS mean_consistency FROM v_players JOIN v_kpi0 USING (player_key) GROUP BY club) l ON c.club = l.club"""


@query(
    "club_benchmark",
    f"""SELECT l.*, round(l.mean_kpi - b.mean_kpi, 3) AS mean_kpi_delta, round(l.mean_kpi / nullif(b.mean_kpi, 0.0), 3) AS mean_kpi_ratio,
  round(l.mean_consistency - b.mean_consistency, 3) AS mean_consistency_delta, round(l.mean_consistency / nullif(b.mean_consistency, 0.0), 3) AS mean_consistency_ratio,
  l.players - b.players AS players_delta, round(l.players / nullif(b.players::DOUBLE, 0.0), 3) AS players_ratio, l.club = '{BASELINE}' AS is_baseline
FROM v_live l CROSS JOIN (SELECT * FROM v_live WHERE club = '{BASELINE}') b""",
)
def club_benchmark(spark, sf_dir):
    live = clubs.live_metrics(kpi_of(spark, sf_dir), D.players(spark, sf_dir), D.clubs(spark, sf_dir))
    return clubs.against_baseline(live, BASELINE)


VIEWS["v_moves"] = """
SELECT from_club AS club, count(*) AS outbound, least(250000.0::DOUBLE, sum(greatest(8.0::DOUBLE, n_nationkey * 1.0::DOUBLE)::DECIMAL(18,4))::DOUBLE) AS quality
FROM v_transfers JOIN nation ON n_name = to_club WHERE from_club <> to_club GROUP BY from_club"""


@query("destination_quality", "SELECT * FROM v_moves")
def destination_quality(spark, sf_dir):
    return moves_of(spark, sf_dir)


@query(
    "club_development",
    """SELECT club, squad, young, development, resale, overall, confidence, row_number() OVER (ORDER BY overall DESC, confidence DESC, development DESC, club)::INTEGER AS rank FROM (
 SELECT *, round(0.6::DOUBLE * development + 0.4::DOUBLE * resale, 2) AS overall, round(least(1.0::DOUBLE, squad / 25.0::DOUBLE), 3) AS confidence FROM (
  SELECT p.club, squad, young, round(least(40.0::DOUBLE, 0.4::DOUBLE * v) + least(35.0::DOUBLE, 7.0::DOUBLE * k) + least(25.0::DOUBLE, m / 1800.0::DOUBLE * 25.0::DOUBLE), 2) AS development,
   round(least(45.0::DOUBLE, 15.0::DOUBLE * coalesce(outbound, 0)) + coalesce(quality, 0.0) + least(30.0::DOUBLE, 0.3::DOUBLE * v), 2) AS resale
  FROM (SELECT club, count(*) AS squad, count(*) FILTER (y) AS young, coalesce(avg(vs) FILTER (y), avg(vs), 0.0) AS v, coalesce(avg(base_kpi) FILTER (y), avg(base_kpi), 0.0) AS k,
      coalesce(avg(minutes) FILTER (y), avg(minutes), 0.0) AS m
    FROM (SELECT p.club, k.base_kpi, v.score AS vs, k.minutes, k.age IS NULL OR k.age <= 24 AS y FROM v_players p LEFT JOIN v_kpi0 k ON p.player_key = k.player_key LEFT JOIN v_value v ON p.player_key = v.player_key)
    GROUP BY club) p LEFT JOIN v_moves t ON p.club = t.club))""",
)
def club_development(spark, sf_dir):
    stats, players = base(spark, sf_dir)
    return clubs.development(players, kpi_of(spark, sf_dir), valuation_of(spark, sf_dir), features.player_totals(stats), moves_of(spark, sf_dir))


def profiles_of(spark, sf_dir):
    home = D.clubs(spark, sf_dir).select("club", F.col("prestige").alias("home_prestige"), F.col("league").alias("home_league"))
    valued = valuation_of(spark, sf_dir).select("player_key", "club", "score", F.col("computed_value").alias("value"), "market_value")
    kpi = kpi_of(spark, sf_dir).select("player_key", "age", F.col("age_adjusted_kpi").alias("kpi"))
    return valued.join(kpi, "player_key").join(D.players(spark, sf_dir).select("player_key", "position"), "player_key").join(F.broadcast(home), "club", "left")


@once
def fit_of(spark, sf_dir):
    n = F.length("position")
    dims = D.clubs(spark, sf_dir).withColumnRenamed("club", "to_club")
    p = profiles_of(spark, sf_dir).drop("club", "market_value", "home_league")
    fits = clubs.club_fit(p, dims.withColumnRenamed("to_club", "club"), F.when(n % 3 == F.col("ord") % 3, 1.0).otherwise(0.5), (F.col("ord") + n) % 10 / 10.0)
    return fits


VIEWS["v_profiles"] = """
SELECT v.player_key, v.club, v.score, v.computed_value AS value, v.market_value, k.age, k.age_kpi AS kpi, p.position, c.prestige AS home_prestige, c.league AS home_league
FROM v_value v JOIN v_kpi0 k USING (player_key) JOIN v_players p USING (player_key) LEFT JOIN v_clubs c ON v.club = c.club"""
_RATIO = "(CASE WHEN value IS NULL OR value = 0 THEN 3e6::DOUBLE ELSE value END / greatest(spend, 1.0::DOUBLE))"
_TECH = "least(1.0::DOUBLE, (CASE WHEN score IS NULL OR score = 0 THEN 55.0::DOUBLE ELSE score END) / 80.0::DOUBLE)"
_PHYS = "least(1.0::DOUBLE, (CASE WHEN kpi IS NULL OR kpi = 0 THEN 8.5::DOUBLE ELSE kpi END) / 12.0::DOUBLE)"
_MID, _SIG = "((buy_age_low + buy_age_high) / 2.0::DOUBLE)", "((buy_age_high - buy_age_low) / 2.0::DOUBLE + 1.5::DOUBLE)"
VIEWS["v_fit"] = f"""
SELECT player_key, rank::INTEGER AS rank, club, league, fit FROM (SELECT *, row_number() OVER (PARTITION BY player_key ORDER BY fit DESC, ord) AS rank FROM (
 SELECT player_key, club, league, ord, round(f_role * 0.25::DOUBLE + f_age * 0.20::DOUBLE + f_league * 0.18::DOUBLE + f_value * 0.12::DOUBLE + f_tactical * 0.12::DOUBLE + f_pathway * 0.08::DOUBLE + f_demand * 0.05::DOUBLE, 4) AS fit FROM (
  SELECT p.player_key, c.club, c.league, c.ord, CASE WHEN length(position) % 3 = ord % 3 THEN 1.0::DOUBLE ELSE 0.5::DOUBLE END AS f_role,
   CASE WHEN age IS NULL THEN 0.5::DOUBLE WHEN age BETWEEN buy_age_low AND buy_age_high THEN 1.0::DOUBLE ELSE round(exp(-((age - {_MID}) * (age - {_MID})) / (2 * {_SIG} * {_SIG})), 4) END AS f_age,
   round(CASE WHEN c.prestige - home_prestige < -0.1 THEN greatest(0.1::DOUBLE, 0.5::DOUBLE + (c.prestige - home_prestige)) WHEN c.prestige - home_prestige <= 0.40 THEN least(1.0::DOUBLE, 0.5::DOUBLE + (c.prestige - home_prestige) * 1.5::DOUBLE)
     ELSE greatest(0.3::DOUBLE, 0.5::DOUBLE - ((c.prestige - home_prestige) - 0.40::DOUBLE)) END, 4) AS f_league,
   CASE WHEN {_RATIO} <= 1.0 THEN round(1.0::DOUBLE - {_RATIO} * 0.3::DOUBLE, 4) WHEN {_RATIO} <= 2.0 THEN round(0.7::DOUBLE - ({_RATIO} - 1.0::DOUBLE) * 0.4::DOUBLE, 4)
     ELSE greatest(0.1::DOUBLE, round(0.3::DOUBLE - ({_RATIO} - 2.0::DOUBLE) * 0.1::DOUBLE, 4)) END AS f_value,
   round((1.0::DOUBLE - abs({_TECH} - technical) * 0.8::DOUBLE) * 0.45::DOUBLE + (1.0::DOUBLE - abs({_PHYS} - physical) * 0.6::DOUBLE) * 0.30::DOUBLE + (1.0::DOUBLE - abs({_PHYS} - pressing) * 0.5::DOUBLE) * 0.25::DOUBLE, 4) AS f_tactical,
   pathway_score AS f_pathway, (ord + length(position)) % 10 / 10.0::DOUBLE AS f_demand
  FROM v_profiles p CROSS JOIN v_clubs c))) WHERE rank <= 5"""


@query("club_fit_top5", "SELECT * FROM v_fit")
def club_fit_top5(spark, sf_dir):
    return fit_of(spark, sf_dir)


@query("club_fit_one", "SELECT player_key, rank, fit FROM v_fit WHERE club = 'NATION_24'")
def club_fit_one(spark, sf_dir):
    return fit_of(spark, sf_dir).filter("club = 'NATION_24'").select("player_key", "rank", "fit")


def projected_of(spark, sf_dir):
    leagues = D.leagues(spark, sf_dir)
    home = leagues.select(F.col("league").alias("home_league"), F.col("prestige").alias("home"))
    p = profiles_of(spark, sf_dir).join(F.broadcast(home), "home_league", "left").join(drift_of(spark, sf_dir).select("player_key", F.col("direction").alias("trajectory")), "player_key", "left")
    fits = fit_of(spark, sf_dir).groupBy("player_key", "league").agg(F.max_by("fit", "rank").alias("fit"))
    return clubs.league_projection(p.select("player_key", "age", F.col("home").alias("home_prestige"), "kpi", "score", "trajectory"), leagues, fits)


_D = "(l.prestige - h.prestige)"
VIEWS["v_leagues"] = "SELECT r_name AS league, r_regionkey AS ord, (r_regionkey + 1) / 6.0::DOUBLE AS prestige FROM region"
VIEWS["v_projected"] = f"""
SELECT player_key, league, ord, projected_kpi, projected_score, round(prestige * 20e6::DOUBLE * pow(projected_score / 50.0::DOUBLE, 1.4::DOUBLE) * coalesce(exp(-((age - 24.0::DOUBLE) * (age - 24.0::DOUBLE)) / 40.5::DOUBLE), 0.8::DOUBLE), 0) AS projected_value,
  minutes_p, months, least(1.0::DOUBLE, round(0.50::DOUBLE + 0.20::DOUBLE * (1.0::DOUBLE - gap) + 0.15::DOUBLE * minutes_p + 0.15::DOUBLE * fit, 4)) AS confidence
FROM (SELECT *, least(14.0::DOUBLE, greatest(5.0::DOUBLE, round((CASE WHEN kpi IS NULL OR kpi = 0 THEN 8.0::DOUBLE ELSE kpi END) * (CASE WHEN difficulty > 1.0 THEN 1.05::DOUBLE ELSE 0.95::DOUBLE END) * factor * pow(minutes_p, 0.3::DOUBLE), 3))) AS projected_kpi,
  least(95.0::DOUBLE, greatest(20.0::DOUBLE, round(perf * pow(factor, 0.7::DOUBLE), 2))) AS projected_score
 FROM (SELECT *, round(least(0.95::DOUBLE, greatest(0.25::DOUBLE, least(0.95::DOUBLE, greatest(0.30::DOUBLE, (perf - 50.0::DOUBLE) / 50.0::DOUBLE + 0.55::DOUBLE))
     + CASE WHEN age < 20 THEN -0.10::DOUBLE WHEN age > 28 THEN -0.05::DOUBLE * (age - 28) ELSE 0.0::DOUBLE END
     + CASE WHEN gap > 0.40 THEN -0.15::DOUBLE * (gap - 0.4::DOUBLE) / 0.6::DOUBLE WHEN gap > 0.20 THEN -0.05::DOUBLE ELSE 0.05::DOUBLE END)), 4) AS minutes_p,
   least(12, greatest(2, CASE direction WHEN 'improving' THEN greatest(2, m0 - 1) WHEN 'declining' THEN m0 + 2 ELSE m0 END))::INTEGER AS months,
   difficulty * (fit * 0.10::DOUBLE + 0.95::DOUBLE) * CASE WHEN direction = 'improving' AND age <= 25 THEN 1.05::DOUBLE WHEN direction = 'improving' AND age <= 28 THEN 1.02::DOUBLE WHEN direction = 'declining' AND age >= 28 THEN 0.95::DOUBLE WHEN direction = 'declining' THEN 0.97::DOUBLE ELSE 1.0::DOUBLE END AS factor
  FROM (SELECT p.*, l.league, l.ord, l.prestige, direction, coalesce(f.fit, 0.5::DOUBLE) AS fit, greatest(0.0::DOUBLE, {_D}) AS gap, CASE WHEN score IS NULL OR score = 0 THEN 50.0::DOUBLE ELSE score END AS perf,
    round(CASE WHEN {_D} <= 0 THEN 1.0::DOUBLE + 0.15::DOUBLE * abs({_D}) ELSE greatest(0.55::DOUBLE, 1.0::DOUBLE - 0.55::DOUBLE * {_D} - 0.15::DOUBLE * {_D} * {_D}) END, 4) AS difficulty,
    3 + CASE WHEN greatest(0.0::DOUBLE, {_D}) >= 0.50 THEN 5 WHEN greatest(0.0::DOUBLE, {_D}) >= 0.30 THEN 3 WHEN greatest(0.0::DOUBLE, {_D}) >= 0.10 THEN 1 ELSE 0 END + CASE WHEN age < 21 THEN 1 WHEN age > 28 THEN 2 ELSE 0 END AS m0
   FROM v_profiles p LEFT JOIN v_leagues h ON home_league = h.league CROSS JOIN v_leagues l LEFT JOIN v_drift d ON p.player_key = d.player_key
    LEFT JOIN (SELECT player_key, league, arg_max(fit, rank) AS fit FROM v_fit GROUP BY ALL) f ON f.player_key = p.player_key AND f.league = l.league)))"""


@query("league_projection", "SELECT * FROM v_projected")
def league_projection(spark, sf_dir):
    return projected_of(spark, sf_dir)


@query("best_league", "SELECT player_key, league, projected_kpi, projected_value, confidence FROM (SELECT *, row_number() OVER (PARTITION BY player_key ORDER BY projected_value DESC, ord) AS i FROM v_projected) WHERE i = 1")
def best_league(spark, sf_dir):
    return clubs.best_league(projected_of(spark, sf_dir))


FEATURES = ["base_kpi", "consistency", "xg_per_90", "epv_per_90", "obv", "score"]


def features_of(spark, sf_dir):
    stats, _ = base(spark, sf_dir)
    return kpi_of(spark, sf_dir).select("player_key", "base_kpi", "consistency").join(features.expected_metrics(stats).select("player_key", "xg_per_90", "epv_per_90", "obv"), "player_key").join(valuation_of(spark, sf_dir).select("player_key", "score"), "player_key")


VIEWS["v_feat"] = "SELECT k.player_key, base_kpi, consistency, xg_per_90, epv_per_90, obv, score FROM v_kpi0 k JOIN v_expected USING (player_key) JOIN v_value USING (player_key)"
VIEWS["v_norm"] = "SELECT player_key, [" + ", ".join(f"CASE WHEN max(coalesce({c}, 0.0)) OVER () > min(coalesce({c}, 0.0)) OVER () THEN round((coalesce({c}, 0.0) - min(coalesce({c}, 0.0)) OVER ()) / (max(coalesce({c}, 0.0)) OVER () - min(coalesce({c}, 0.0)) OVER ()), 6) ELSE 0.0 END" for c in FEATURES) + "] AS v FROM v_feat"


@query(
    "similar_top5_v1",
    """SELECT key, rank::INTEGER AS rank, other, distance FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY distance, other) AS rank FROM (
  SELECT a.player_key AS key, b.player_key AS other, round(list_distance(a.v, b.v), 6) AS distance FROM v_norm a JOIN v_norm b ON a.player_key <> b.player_key)) WHERE rank <= 5""",
)
def similar_top5_v1(spark, sf_dir):
    scaled = similarity.min_max(features_of(spark, sf_dir), FEATURES)
    return similarity.nearest(scaled.select(F.col("player_key").alias("key"), F.array(*FEATURES).alias("v")), 5)


#: Positions that the market segments stand for where roles matter.
POSITIONS = {"AUTOMOBILE": "Centre Forward", "BUILDING": "CM", "FURNITURE": "Left-Back", "HOUSEHOLD": "Goalkeeper"}
_PROFILE = {"gc_per_90": P90.format("goals + assists"), "shots": "shots", "minutes": "minutes", "base_kpi": "base_kpi", "consistency": "consistency", "discipline": "yellow + 2 * red", "xg_per_90": "xg_per_90", "xa_per_90": "xa_per_90", "progression": "progression"}
_RANGE = "max({0}) OVER () > min({0}) OVER () THEN round(({0} - min({0}) OVER ()) / (max({0}) OVER () - min({0}) OVER ()) + 1e-9::DOUBLE, 6) ELSE 0.0 END"
VIEWS["v_profile"] = f"""SELECT player_key, CASE position WHEN 'AUTOMOBILE' THEN 'forward' WHEN 'BUILDING' THEN 'midfielder' WHEN 'FURNITURE' THEN 'defender' WHEN 'HOUSEHOLD' THEN 'goalkeeper' ELSE 'default' END AS role,
  [{", ".join("CASE WHEN " + _RANGE.format(c) for c in _PROFILE)}] AS v
FROM (SELECT k.player_key, position, {", ".join(f"coalesce({e}, 0)::DOUBLE AS {c}" for c, e in _PROFILE.items())} FROM v_kpi0 k JOIN v_expected e USING (player_key) LEFT JOIN v_players p ON k.player_key = p.player_key)"""


def profile_from(totals, kpi, expected, players):
    """(key, role and the nine features scaled) of every player with appearances."""
    position = F.create_map(*[F.lit(x) for kv in POSITIONS.items() for x in kv])[F.col("position")]
    t = totals.select("player_key", "shots", "minutes", "gc_per_90", "discipline")
    t = t.join(kpi.select("player_key", "base_kpi", "consistency"), "player_key").join(expected.select("player_key", "xg_per_90", "xa_per_90", "progression"), "player_key")
    t = t.join(players.select("player_key", similarity.profile_role(position).alias("role")), "player_key", "left")
    return similarity.min_max(t.withColumn("role", F.coalesce("role", F.lit("default"))), list(similarity.PROFILE), shift=1e-9).withColumnRenamed("player_key", "key")


def similar_from(totals, kpi, expected, players, pathway, valuation):
    """Nine features, weighed by the role of the player whose neighbours these are, and the trajectory."""
    scaled = cut(profile_from(totals, kpi, expected, players))
    about = scaled.select(F.col("key").alias("player_key")).join(pathway.select("player_key", "trajectory"), "player_key", "left").join(valuation.select("player_key", "score"), "player_key", "left")
    about = cut(about.withColumn("score", X.or_default("score", 50.0)))  # read six times
    up = lambda c: F.coalesce(F.col(c).isin("ascending", "stable"), F.lit(False))
    same = F.when(F.col("ta").eqNullSafe(F.col("tb")), 1.0).when(up("ta") & up("tb"), 0.7).otherwise(0.3)
    own, every = similarity.in_role(scaled, F.col("role")), similarity.in_role(scaled, F.lit(None).cast("string"))
    near = similarity.nearest_adjusted(own, about.select(F.col("player_key").alias("key"), F.col("trajectory").alias("class")), same, 5, others=every)
    a = about.select(F.col("player_key").alias("key"), F.col("score").alias("sa"))
    b = about.select(F.col("player_key").alias("other"), F.col("trajectory").alias("tb"), F.col("score").alias("sb"))
    t = near.join(a, "key").join(b, "other")
    is_now = lambda v: F.coalesce(F.col("tb") == v, F.lit(False))
    comp = F.when((F.col("sb") >= 1.1 * F.col("sa")) | is_now("ascending"), "successful").when((F.col("sb") < 0.7 * F.col("sa")) | is_now("declining"), "failed").otherwise("neutral")
    return t.select("key", "rank", "other", "adjusted", F.round(1.0 - F.col("adjusted"), 4).alias("similarity"), comp.alias("comp"))


@query(
    "similar_top5",
    f"""WITH w AS (SELECT unnest({list(similarity.ROLE_WEIGHTS)}) AS space, unnest({[similarity.weights_of(r) for r in similarity.ROLE_WEIGHTS]}) AS w),
s AS MATERIALIZED (SELECT player_key, role, space, list_transform(list_zip(v, w), lambda z: z[1] * sqrt(z[2]::DOUBLE)) AS v, trajectory, score FROM v_profile n CROSS JOIN w LEFT JOIN (SELECT player_key, trajectory FROM v_pathway) USING (player_key) LEFT JOIN (SELECT player_key, score FROM v_value) USING (player_key)),
near AS (
  SELECT a.player_key AS key, b.player_key AS other, round(list_distance(a.v, b.v), 6) AS distance, a.trajectory AS ta, b.trajectory AS tb, a.score AS sa, b.score AS sb FROM s a JOIN s b ON a.space = b.space AND a.player_key <> b.player_key WHERE a.role = a.space),
adj AS (SELECT *, round(0.85::DOUBLE * distance + 0.15::DOUBLE * (1.0::DOUBLE - CASE WHEN ta IS NOT DISTINCT FROM tb THEN 1.0::DOUBLE WHEN ta IN ('ascending', 'stable') AND tb IN ('ascending', 'stable') THEN 0.7::DOUBLE ELSE 0.3::DOUBLE END), 6) AS adjusted FROM near)
SELECT key, rank::INTEGER AS rank, other, adjusted, round(1.0::DOUBLE - adjusted, 4) AS similarity,
  CASE WHEN coalesce(sb, 50.0) >= 1.1::DOUBLE * coalesce(sa, 50.0) OR tb = 'ascending' THEN 'successful' WHEN coalesce(sb, 50.0) < 0.7::DOUBLE * coalesce(sa, 50.0) OR tb = 'declining' THEN 'failed' ELSE 'neutral' END AS comp
FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY adjusted, other) AS rank FROM adj) WHERE rank <= 5""",
)
def similar_top5(spark, sf_dir):
    stats, players = base(spark, sf_dir)
    return similar_from(features.player_totals(stats), kpi_of(spark, sf_dir), features.expected_metrics(stats), players, pathway_of(spark, sf_dir), valuation_of(spark, sf_dir))


# --- the eight derived tables -------------------------------------------------------------------


def derived_tables(spark, sf_dir):
    """What is made of appearances and players, in order of dependence; players, clubs and leagues are as they are."""
    clubs_ = D.clubs(spark, sf_dir)
    return [
        Derived("totals", ("stats",), features.player_totals),
        Derived("kpi", ("stats", "players"), lambda s, p: features.kpi(s, p, on_date())),
        Derived("expected", ("stats",), features.expected_metrics),
        Derived("risk", ("stats", "players"), lambda s, p: scores.risk(s, p, on_date(), features.consistency(s))),
        Derived("valuation", ("kpi", "expected", "totals", "risk", "players", "stats"), lambda k, e, t, r, p, s: scores.valuation(k, e, t, r, p, league_points(spark, s), club_points(spark, sf_dir), ageless=AGELESS)),
        Derived("pathway", ("kpi", "stats", "valuation"), lambda k, s, v: scores.pathway(k, timeseries.score_slope(s), v, timeseries.minutes_trend(s, TREND_LIMIT))),
        Derived("similarity", ("totals", "kpi", "expected", "players", "pathway", "valuation"), lambda *t: similar_from(*t).withColumnRenamed("key", "player_key"), whole=True),
        Derived("transfer", ("kpi", "stats", "players"), lambda k, s, p: transfer_from(k, timeseries.career_drift(s), p, clubs_), whole=True),
    ]


#: What is shown of each table.
_SHOWN = {"totals": ("minutes", "gc_per_90"), "kpi": ("base_kpi", "consistency"), "expected": ("xg", "obv"), "risk": ("injury", "risk"), "valuation": ("score", "computed_value"), "pathway": ("percentile", "success"), "transfer": ("p1", "p2")}
_SHOWN_FROM = {"totals": "v_totals", "kpi": "v_kpi0", "expected": "v_expected", "risk": "v_risk", "valuation": "v_value", "pathway": "v_pathway", "transfer": "v_transfer_p"}
VIEWS["v_similar"] = ORACLES["similar_top5"]


def _shown_sql(name: str, column: str) -> str:
    value = P90.format("goals + assists") if column == "gc_per_90" else column
    return f"SELECT '{name}' AS name, player_key, '{column}' AS item, ({value})::DOUBLE AS value FROM {_SHOWN_FROM[name]}"


@query("derived_refresh", " UNION ALL ".join(_shown_sql(n, c) for n, cs in _SHOWN.items() for c in cs) + " UNION ALL SELECT 'similarity', key, 'other' || rank::VARCHAR, other::DOUBLE FROM v_similar UNION ALL SELECT 'similarity', key, 'adjusted' || rank::VARCHAR, adjusted FROM v_similar")
def derived_refresh(spark, sf_dir):
    """All eight tables as stored before the last hundredth of the matches, then brought up to date for the players of these, about a tenth."""
    stats, players = base(spark, sf_dir)
    day = F.unix_date("match_date")
    since = stats.agg(F.percentile_approx(day, 0.99, 10_000)).head()[0]
    tables, stored = derived_tables(spark, sf_dir), {}
    for t in tables:
        before = {"stats": stats.filter(day < since), "players": players, **stored}
        stored[t.name] = cut(t.build(*[before[n] for n in t.needs]))
    keys = stats.filter(day >= since).select("player_key").distinct()
    now, _ = rebuild(tables, {"stats": stats, "players": players}, {"stats": keys}, stored)
    parts = [t.select(F.lit(name).alias("name"), "player_key", F.explode(F.array(*[F.struct(F.lit(c).alias("item"), F.col(c).cast("double").alias("value")) for c in _SHOWN[name]])).alias("s")) for name, t in now.items() if name in _SHOWN]
    rank = F.col("rank").cast("string")
    near = F.array(F.struct(F.concat(F.lit("other"), rank).alias("item"), F.col("other").cast("double").alias("value")), F.struct(F.concat(F.lit("adjusted"), rank).alias("item"), F.col("adjusted").alias("value")))
    parts.append(now["similarity"].select(F.lit("similarity").alias("name"), "player_key", F.explode(near).alias("s")))
    return functools.reduce(DataFrame.unionByName, parts).select("name", "player_key", "s.item", "s.value")


VIEWS["v_alerts"] = """
SELECT player_key, 'UNDERVALUED' AS kind, CASE WHEN measure >= 100 THEN 'critical' WHEN measure >= 60 THEN 'high' WHEN measure >= 30 THEN 'medium' ELSE 'low' END AS severity, measure FROM (
  SELECT player_key, round((worth / market_value - 1.0::DOUBLE) * 100, 1) AS measure FROM (SELECT v.*, computed_value * CASE WHEN confidence IS NULL OR confidence = 0 THEN 1.0::DOUBLE ELSE confidence END AS worth FROM v_value v LEFT JOIN v_confidence USING (player_key))
  WHERE market_value > 0 AND worth / market_value >= 1.25)
UNION ALL SELECT player_key, 'UNDERVALUED', 'medium', score FROM v_value WHERE coalesce(NOT market_value > 0, TRUE) AND score >= 55
UNION ALL SELECT player_key, 'BREAKOUT', CASE WHEN magnitude >= 0.8 THEN 'critical' WHEN magnitude >= 0.5 THEN 'high' WHEN magnitude >= 0.25 THEN 'medium' ELSE 'low' END, magnitude FROM v_kpi0 JOIN v_drift USING (player_key) WHERE coalesce(age, 99) <= 23 AND age_kpi >= 8 AND direction = 'improving'
UNION ALL SELECT player_key, 'DECLINE', CASE WHEN magnitude >= 0.8 THEN 'critical' WHEN magnitude >= 0.55 THEN 'high' WHEN magnitude >= 0.25 THEN 'medium' ELSE 'low' END, magnitude FROM v_kpi0 JOIN v_drift USING (player_key) WHERE coalesce(age, 0) >= 26 AND direction = 'declining' AND magnitude >= 0.25"""


def alerts_of(spark, sf_dir):
    return decisions.alerts(valuation_of(spark, sf_dir), kpi_of(spark, sf_dir), drift_of(spark, sf_dir), confidence_index(spark, sf_dir))


@query("alerts", "SELECT * FROM v_alerts")
def alerts(spark, sf_dir):
    return alerts_of(spark, sf_dir)


@query("alert_summary", "SELECT kind, severity, count(*) AS alerts FROM v_alerts GROUP BY kind, severity")
def alert_summary(spark, sf_dir):
    return alerts_of(spark, sf_dir).groupBy("kind", "severity").agg(F.count("*").alias("alerts"))


VIEWS["v_recent"] = """
SELECT player_key, round(avg(minutes) FILTER (rn <= 5), 2) AS recent, round(avg(minutes), 2) AS season, round(avg(minutes) FILTER (rn <= 5) - avg(minutes), 2) AS trend FROM v_ranked GROUP BY player_key"""


@query("serving_alerts", """SELECT player_key, CASE WHEN trend > 5 AND age < 24 THEN 'BREAKOUT' ELSE 'UNDERVALUED' END AS kind, CASE WHEN trend > 5 AND age < 24 THEN 'critical' ELSE 'high' END AS severity, trend
FROM v_value LEFT JOIN v_recent USING (player_key) WHERE undervalued""")
def serving_alerts(spark, sf_dir):
    return decisions.serving_alerts(valuation_of(spark, sf_dir), decisions.recent_trend(D.appearances(spark, sf_dir)))


def decisions_of(spark, sf_dir):
    v = valuation_of(spark, sf_dir)
    rows = (
        v.select("player_key", "gap_pct", "score", "potential", F.round(0.7 * F.col("computed_value") + 0.3 * F.col("market_value"), 0).alias("blended_value"))
        .join(kpi_of(spark, sf_dir).select("player_key", "age", F.col("age_adjusted_kpi").alias("kpi")), "player_key", "left")
        .join(transfer_of(spark, sf_dir).select("player_key", "p1"), "player_key", "left")
        .join(fit_of(spark, sf_dir).filter("rank = 1").select("player_key", "fit"), "player_key", "left")
        .join(confidence_index(spark, sf_dir).select("player_key", "confidence"), "player_key", "left")
        .join(drift_of(spark, sf_dir).select("player_key", "direction", "magnitude"), "player_key", "left")
        .join(risk_of(spark, sf_dir).select("player_key", "risk"), "player_key", "left")
    )
    return decisions.decisions(rows)


VIEWS["v_decision_parts"] = """
SELECT v.player_key, k.age,
  CASE WHEN gap_pct IS NULL THEN least(1.0::DOUBLE, greatest(0.0::DOUBLE, (v.score - 40) / 40)) WHEN gap_pct <= 0 THEN 0.0::DOUBLE ELSE least(1.0::DOUBLE, gap_pct / 200 + 0.20::DOUBLE) END AS b1,
  least(1.0::DOUBLE, greatest(0.0::DOUBLE, (coalesce(potential, v.score, 50.0::DOUBLE) - 30) / 70)) AS b2, least(1.0::DOUBLE, greatest(0.0::DOUBLE, coalesce(p1, 0.0::DOUBLE))) AS b3, coalesce(fit, 0.0::DOUBLE) AS b4,
  CASE WHEN confidence IS NULL OR confidence = 0 THEN 0.70::DOUBLE ELSE confidence END AS b5,
  CASE WHEN coalesce(round(0.7::DOUBLE * computed_value + 0.3::DOUBLE * v.market_value, 0), 0.0) <= 0 THEN 0.0::DOUBLE ELSE least(1.0::DOUBLE, log10(greatest(round(0.7::DOUBLE * computed_value + 0.3::DOUBLE * v.market_value, 0), 1e6::DOUBLE)) / 7.698970004336019::DOUBLE) END AS s1,
  CASE direction WHEN 'declining' THEN 0.5::DOUBLE + 0.5::DOUBLE * least(1.0::DOUBLE, coalesce(magnitude, 0.0)) WHEN 'stable' THEN 0.2::DOUBLE ELSE 0.0::DOUBLE END AS s2,
  CASE WHEN k.age IS NULL THEN 0.2::DOUBLE WHEN k.age < 24 THEN 0.0::DOUBLE WHEN k.age <= 27 THEN (k.age - 24) / 6.0::DOUBLE WHEN k.age <= 30 THEN 0.5::DOUBLE + (k.age - 27) / 8.0::DOUBLE ELSE least(1.0::DOUBLE, 0.875::DOUBLE + 0.06::DOUBLE * (k.age - 30)) END AS s3,
  least(1.0::DOUBLE, greatest(0.0::DOUBLE, CASE WHEN risk > 1 THEN risk / 100 ELSE coalesce(risk, 0.0) END)) AS s4,
  CASE WHEN k.age IS NULL THEN 0.2::DOUBLE WHEN k.age BETWEEN 26 AND 28 AND direction IN ('stable', 'declining') AND k.age_kpi >= 9 THEN least(1.0::DOUBLE, 0.5::DOUBLE + (k.age_kpi - 9) / 10) ELSE 0.1::DOUBLE END AS s5
FROM v_value v LEFT JOIN v_kpi0 k ON v.player_key = k.player_key LEFT JOIN v_transfer_p t ON v.player_key = t.player_key LEFT JOIN (SELECT player_key, fit FROM v_fit WHERE rank = 1) f ON v.player_key = f.player_key
  LEFT JOIN v_confidence c ON v.player_key = c.player_key LEFT JOIN v_drift d ON v.player_key = d.player_key LEFT JOIN v_risk r ON v.player_key = r.player_key"""
VIEWS["v_decisions"] = """
SELECT player_key, buy, sell, decision, round(CASE decision WHEN 'BUY' THEN least(1.0::DOUBLE, buy / 0.9::DOUBLE) WHEN 'SELL' THEN least(1.0::DOUBLE, sell / 0.9::DOUBLE) ELSE 1.0::DOUBLE - abs(buy - sell) END, 3) AS sure,
  concat_ws('; ', CASE WHEN decision = 'BUY' AND b1 > 0.4 THEN 'undervalued' END, CASE WHEN decision = 'BUY' AND b2 > 0.6 THEN 'high potential' END, CASE WHEN decision = 'BUY' AND b3 > 0.5 THEN 'likely to move' END, CASE WHEN decision = 'BUY' AND b4 > 0.7 THEN 'strong club fit' END,
    CASE WHEN decision = 'SELL' AND s1 > 0.5 THEN 'strong market value' END, CASE WHEN decision = 'SELL' AND s2 > 0.4 THEN 'declining' END, CASE WHEN decision = 'SELL' AND s3 > 0.5 THEN 'age' END, CASE WHEN decision = 'SELL' AND s4 > 0.5 THEN 'injury risk' END, CASE WHEN decision = 'SELL' AND s5 > 0.5 THEN 'near peak value' END,
    CASE WHEN decision = 'HOLD' AND buy > 0.4 THEN 'close to buying' END, CASE WHEN decision = 'HOLD' AND sell > 0.4 THEN 'some pressure to sell' END, CASE WHEN decision = 'HOLD' THEN 'no strong signal' END) AS reasons
FROM (SELECT *, CASE WHEN buy >= 0.62 AND buy > sell THEN 'BUY' WHEN sell >= 0.55 AND sell >= buy THEN 'SELL' ELSE 'HOLD' END AS decision FROM (
  SELECT *, round(0.0::DOUBLE + b1 * 0.30::DOUBLE + b2 * 0.25::DOUBLE + b3 * 0.20::DOUBLE + b4 * 0.15::DOUBLE + b5 * 0.10::DOUBLE, 4) AS buy, round(0.0::DOUBLE + s1 * 0.30::DOUBLE + s2 * 0.25::DOUBLE + s3 * 0.20::DOUBLE + s4 * 0.15::DOUBLE + s5 * 0.10::DOUBLE, 4) AS sell FROM v_decision_parts))"""


@query("decisions", "SELECT * FROM v_decisions")
def decisions_query(spark, sf_dir):
    return decisions_of(spark, sf_dir)


@query("decision_summary", "SELECT decision, count(*) AS players, round(avg(sure), 4) AS mean_sure FROM v_decisions GROUP BY decision")
def decision_summary(spark, sf_dir):
    return decisions_of(spark, sf_dir).groupBy("decision").agg(F.count("*").alias("players"), F.round(F.avg("sure"), 4).alias("mean_sure"))


@query(
    "shortlist",
    """SELECT player_key, player_name, position, age, points, round(0.85::DOUBLE + points / 500, 3) AS fit, CASE WHEN undervalued THEN 'low' ELSE 'medium' END AS risk_label FROM (
 SELECT *, round(0.4::DOUBLE * least(100.0::DOUBLE, greatest(0.0::DOUBLE, 12 * kpi)) + 0.3::DOUBLE * (CASE WHEN market <= 0 OR computed_value <= market THEN 25.0::DOUBLE ELSE least(100.0::DOUBLE, greatest(0.0::DOUBLE, (computed_value - market) / market * 100)) END) + 0.3::DOUBLE * 100 * p1, 2) AS points FROM (
  SELECT v.player_key, player_name, coalesce(p.position, 'CM') AS position, CASE WHEN v.age IS NULL OR v.age = 0 THEN 24 ELSE v.age END AS age, undervalued, computed_value,
   CASE WHEN base_kpi IS NULL OR base_kpi = 0 THEN 7.5::DOUBLE ELSE base_kpi END AS kpi, CASE WHEN p1 IS NULL OR p1 = 0 THEN 0.65::DOUBLE ELSE p1 END AS p1, CASE WHEN v.market_value IS NULL OR v.market_value = 0 THEN computed_value ELSE v.market_value END AS market
  FROM v_value v LEFT JOIN v_kpi0 k ON v.player_key = k.player_key LEFT JOIN v_transfer_p t ON v.player_key = t.player_key LEFT JOIN v_players p ON v.player_key = p.player_key)
 WHERE lower(position) LIKE '%build%' AND age <= 30 AND market <= 5000000) ORDER BY points DESC, player_key LIMIT 15""",
)
def shortlist(spark, sf_dir):
    return decisions.shortlist(valuation_of(spark, sf_dir), kpi_of(spark, sf_dir), transfer_of(spark, sf_dir), D.players(spark, sf_dir), "build", 30, 5_000_000.0)


@query("undervalued", """SELECT player_key, score, gap_pct, CASE WHEN gap_pct >= 10 THEN 'market_gap' ELSE 'score_only' END AS gap_type FROM v_value
WHERE gap_pct >= 10 OR (market_value IS NULL AND score >= 60) ORDER BY coalesce(nullif(gap_pct, 0.0), score) DESC, player_key LIMIT 50 OFFSET 10""")
def undervalued(spark, sf_dir):
    v = valuation_of(spark, sf_dir)
    gap = F.col("gap_pct") >= 10
    t = v.filter(gap | (F.col("market_value").isNull() & (F.col("score") >= 60))).select("player_key", "score", "gap_pct", F.when(gap, "market_gap").otherwise("score_only").alias("gap_type"))
    return t.orderBy(F.coalesce(F.nullif("gap_pct", F.lit(0.0)), "score").desc(), "player_key").offset(10).limit(50)


_STORE = ["base_kpi", "score", "risk", "p1"]


@query("feature_store", "SELECT *, " + ", ".join(f"round(({c} - min({c}) OVER ()) / nullif(max({c}) OVER () - min({c}) OVER (), 0), 4) AS {c}_norm" for c in _STORE) + """ FROM (
  SELECT p.player_key, player_name, p.club, base_kpi, consistency, score, potential, risk, p1, percentile, confidence, direction, xg, obv, trajectory
  FROM v_players p LEFT JOIN v_kpi0 k ON p.player_key = k.player_key LEFT JOIN v_value v ON p.player_key = v.player_key LEFT JOIN v_risk r ON p.player_key = r.player_key LEFT JOIN v_transfer_p t ON p.player_key = t.player_key
  LEFT JOIN v_confidence c ON p.player_key = c.player_key LEFT JOIN v_drift d ON p.player_key = d.player_key LEFT JOIN v_expected e ON p.player_key = e.player_key LEFT JOIN (SELECT player_key, trajectory FROM v_pathway) w ON p.player_key = w.player_key)""")
def feature_store(spark, sf_dir):
    stats, players = base(spark, sf_dir)
    tables = [
        kpi_of(spark, sf_dir).select("player_key", "base_kpi", "consistency"), valuation_of(spark, sf_dir).select("player_key", "score", "potential"), risk_of(spark, sf_dir).select("player_key", "risk"),
        transfer_of(spark, sf_dir).select("player_key", "p1", "percentile"), scores.confidence(stats, players).select("player_key", "confidence"), drift_of(spark, sf_dir).select("player_key", "direction"),
        features.expected_metrics(stats).select("player_key", "xg", "obv"), pathway_of(spark, sf_dir).select("player_key", "trajectory"),
    ]
    return decisions.feature_store(players.select("player_key", "player_name", "club"), tables, _STORE)


_EUR = "CASE WHEN computed_value IS NULL THEN 'n/a' WHEN computed_value >= 1e6 THEN (computed_value / 1e6)::DOUBLE::VARCHAR::DECIMAL(20,1)::VARCHAR || 'M' WHEN computed_value >= 1e3 THEN (computed_value / 1e3)::DOUBLE::VARCHAR::DECIMAL(20,0)::BIGINT::VARCHAR || 'K' ELSE computed_value::BIGINT::VARCHAR END"


@query("reports", f"""SELECT p.player_key, concat_ws(chr(10), '# ' || player_name, 'Club: ' || coalesce(p.club, 'n/a'), 'Position: ' || coalesce(position, 'n/a'), 'Age: ' || coalesce(k.age::VARCHAR, 'n/a'), 'Tier: ' || coalesce(v.tier, 'n/a'),
  'Value: EUR ' || {_EUR}, 'Risk: ' || coalesce(r.tier, 'n/a'), 'Decision: ' || coalesce(decision, 'n/a')) AS report
FROM v_players p LEFT JOIN v_kpi0 k ON p.player_key = k.player_key LEFT JOIN v_value v ON p.player_key = v.player_key LEFT JOIN v_risk r ON p.player_key = r.player_key LEFT JOIN v_decisions d ON p.player_key = d.player_key""")
def reports(spark, sf_dir):
    players = D.players(spark, sf_dir)
    rows = (
        players.select("player_key", "player_name", "club", "position").join(kpi_of(spark, sf_dir).select("player_key", "age"), "player_key", "left")
        .join(valuation_of(spark, sf_dir).select("player_key", "tier", "computed_value"), "player_key", "left").join(risk_of(spark, sf_dir).select("player_key", F.col("tier").alias("risk_tier")), "player_key", "left")
        .join(decisions_of(spark, sf_dir).select("player_key", "decision"), "player_key", "left")
    )
    return decisions.report_lines(rows)
