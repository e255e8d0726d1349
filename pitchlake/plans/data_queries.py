"""Queries over scalars, quality rules, merges, graph, models, pages, matching and refresh."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from pitchlake.functions import exprs as X
from pitchlake.operators import features, graph, identity, models, pages, quality, resolution, serving, warehouse
from pitchlake.plans.core_queries import P90
from pitchlake.plans.registry import VIEWS, once, query
from pitchlake.plans.score_queries import confidence_index, drift_of, kpi_of, spells_of, transfer_of, valuation_of
from pitchlake.sources import documents, driver_views as D
from pitchlake.sources.shared import cut, folder
from pitchlake.streaming import refresh

# --- scalars ----------------------------------------------------------------------------------

VIEWS["v_money"] = """
SELECT c_custkey AS id, CASE c_custkey % 6 WHEN 0 THEN '€' || (c_custkey % 90)::VARCHAR || '.5m' WHEN 1 THEN (c_custkey % 900)::VARCHAR || 'k' WHEN 2 THEN 'free' WHEN 3 THEN '£1,' || lpad((c_custkey % 1000)::VARCHAR, 3, '0')
  WHEN 4 THEN '1.' || (c_custkey % 10)::VARCHAR || 'bn' ELSE '-' END AS text FROM customer"""


def money_texts(spark, sf_dir):
    k = F.col("c_custkey")
    s = lambda x: x.cast("string")
    text = (
        F.when(k % 6 == 0, F.concat(F.lit("€"), s(k % 90), F.lit(".5m"))).when(k % 6 == 1, F.concat(s(k % 900), F.lit("k"))).when(k % 6 == 2, "free")
        .when(k % 6 == 3, F.concat(F.lit("£1,"), F.lpad(s(k % 1000), 3, "0"))).when(k % 6 == 4, F.concat(F.lit("1."), s(k % 10), F.lit("bn"))).otherwise("-")
    )
    return D.table(spark, sf_dir, "customer").select(k.alias("id"), text.alias("text"))


@query("money_parse", """SELECT id, round(TRY_CAST(regexp_replace(regexp_replace(lower(text), '[,€£$ ]', '', 'g'), '(bn|m|k)$', '') AS DOUBLE)
  * CASE WHEN text LIKE '%bn' THEN 1e9 WHEN text LIKE '%m' THEN 1e6 WHEN text LIKE '%k' THEN 1e3 ELSE 1.0 END, 2) AS eur FROM v_money""")
def money_parse(spark, sf_dir):
    return money_texts(spark, sf_dir).select("id", F.round(X.money("text"), 2).alias("eur"))


@query("age_years", """SELECT player_key, dob::VARCHAR AS parsed, (2002 - year(dob) - CASE WHEN month(dob) = 1 AND day(dob) = 1 THEN 0 ELSE 1 END)::INTEGER AS age FROM v_players""")
def age_years(spark, sf_dir):
    k = F.col("player_key")
    text = F.when(k % 4 == 0, F.date_format("dob", "yyyy-MM-dd")).when(k % 4 == 1, F.date_format("dob", "dd/MM/yyyy")).when(k % 4 == 2, F.date_format("dob", "MMM d, yyyy")).otherwise(F.date_format("dob", "d MMMM yyyy"))
    t = D.players(spark, sf_dir).select("player_key", X.birth_date(text).alias("parsed"))
    return t.select("player_key", F.col("parsed").cast("string").alias("parsed"), X.age_at("parsed", F.lit(D.REFERENCE_DATE).cast("date")).alias("age"))


@query("clean_scalars", """SELECT p_partkey AS id, nullif(trim(regexp_replace('  ' || p_name || '   x ', '\\s+', ' ', 'g')), '') AS name,
  trunc(TRY_CAST(replace((p_partkey % 9)::VARCHAR || ',' || lpad((p_partkey % 1000)::VARCHAR, 3, '0') || '.7', ',', '') AS DOUBLE))::BIGINT AS whole, TRY_CAST(replace(p_type, ',', '') AS DOUBLE) AS number FROM part""")
def clean_scalars(spark, sf_dir):
    k = F.col("p_partkey")
    text = F.concat((k % 9).cast("string"), F.lit(","), F.lpad((k % 1000).cast("string"), 3, "0"), F.lit(".7"))
    return D.table(spark, sf_dir, "part").select(k.alias("id"), X.clean_text(F.concat(F.lit("  "), "p_name", F.lit("   x "))).alias("name"), X.clean_int(text).alias("whole"), X.clean_number("p_type").alias("number"))


@query("slug_fold", """SELECT c_custkey AS id, trim(regexp_replace(regexp_replace(lower(strip_accents(t)), '[-_]', ' ', 'g'), '\\s+', ' ', 'g')) AS folded,
  coalesce(nullif(trim(regexp_replace(lower(strip_accents(trim(t))), '[^a-z0-9]+', '-', 'g'), '-'), ''), 'unknown-player') AS slug
FROM (SELECT c_custkey, replace(c_name, '#', ' José-Ñúñez_Müller Dvořák Świątek Szőke-Ěrdűs Nguyễn Ạn  ') AS t FROM customer)""")
def slug_fold(spark, sf_dir):
    t = F.replace("c_name", F.lit("#"), F.lit(" José-Ñúñez_Müller Dvořák Świątek Szőke-Ěrdűs Nguyễn Ạn  "))
    return D.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), X.fold(t).alias("folded"), X.slug(t).alias("slug"))


_NS = "6ba7b8109dad11d180b400c04fd430c8"


@query("uuid5_ids", f"""SELECT id, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || substr('89ab', (strpos('0123456789abcdef', substr(h, 17, 1)) - 1) % 4 + 1, 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12) AS uuid
FROM (SELECT c_custkey AS id, sha1(unhex('{_NS}') || encode('source:' || c_custkey::VARCHAR)) AS h FROM customer)""")
def uuid5_ids(spark, sf_dir):
    return D.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), X.uuid5(_NS, F.concat(F.lit("source:"), F.col("c_custkey").cast("string"))).alias("uuid"))


@query("content_hash", """SELECT n_nationkey AS id, sha256('{"n_name":"' || n_name || '","n_regionkey":' || n_regionkey::VARCHAR || '}') AS hash, substr(sha256('{"n_name":"' || n_name || '"}'), 1, 16) AS short_hash,
  substr(md5('{"n_comment":null,"n_name":"x=1|y=' || n_nationkey::VARCHAR || '"}'), 1, 12) AS job_id FROM nation""")
def content_hash(spark, sf_dir):
    return D.table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"), X.content_hash(["n_regionkey", "n_name"]).alias("hash"), X.content_hash(["n_name"], 16).alias("short_hash"), "n_nationkey").select(
        "id", "hash", "short_hash", F.lit(None).cast("string").alias("n_comment"), F.concat(F.lit("x=1|y="), F.col("n_nationkey").cast("string")).alias("n_name")).select("id", "hash", "short_hash", X.content_hash(["n_comment", "n_name"], 12, md5=True).alias("job_id"))


@query("tier_buckets", """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, CASE WHEN l_quantity >= 40 THEN 'high' WHEN l_quantity >= 20 THEN 'mid' ELSE 'low' END AS tier,
  round(exp(-((l_quantity - 25.0::DOUBLE) * (l_quantity - 25.0::DOUBLE)) / 50.0::DOUBLE), 4) AS curve, round(1.0::DOUBLE / (1.0::DOUBLE + exp(-(l_quantity - 25.0::DOUBLE))), 4) AS sigmoid FROM lineitem""")
def tier_buckets(spark, sf_dir):
    q = F.col("l_quantity")
    return D.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", X.tiers(q, [(40, "high"), (20, "mid")], "low").alias("tier"), F.round(X.gauss(q, 25.0, 5.0), 4).alias("curve"), F.round(X.sigmoid(q - 25.0), 4).alias("sigmoid"))


@query("role_map", "SELECT position, CASE WHEN lower(position) LIKE '%back%' OR lower(position) LIKE '%defender%' THEN 'defender' ELSE 'unknown' END AS role, count(*) AS players FROM v_players GROUP BY 1, 2")
def role_map(spark, sf_dir):
    return D.players(spark, sf_dir).groupBy("position", X.role("position").alias("role")).agg(F.count("*").alias("players"))


# --- quality ----------------------------------------------------------------------------------


def _flags(*rules: tuple[str, str]) -> str:
    return "array_to_string(list_filter([" + ", ".join(f"CASE WHEN {c} THEN '{n}' END" for c, n in rules) + "], lambda x: x IS NOT NULL), ',')"


#: Bounds that some rows of these tables break; the library's own are quality.STAT_RANGES.
TABLE_RANGES = (
    quality.Range("minutes", 0, 130), quality.Range("goals", 0, 10, 4), quality.Range("assists", 0, 10, 4), quality.Range("shots", 0, 30, 6), quality.Range("passes", 0, 250, 24),
    quality.Range("yellow", 0, 2), quality.Range("red", 0, 1), quality.Range("xg", 0, 6, 0.3),
)
_ISSUES, _ODD, _COST = [("player_key IS NULL", "missing_player_key")], [], ["CASE WHEN player_key IS NULL THEN 50 ELSE 0 END"]
for _r in TABLE_RANGES:
    _ISSUES += [(f"{_r.column} < {_r.low}", f"{_r.column}_below_range"), (f"{_r.column} > {_r.high}", f"{_r.column}_above_range")]
    _COST += [f"CASE WHEN {_r.column} < {_r.low} THEN 20 ELSE 0 END", f"CASE WHEN {_r.column} > {_r.high} THEN 15 ELSE 0 END"]
    if _r.odd is not None:
        _ODD.append((f"{_r.column} > {_r.odd}", f"{_r.column}_unusual"))
        _COST.append(f"CASE WHEN {_r.column} > {_r.odd} THEN 5 ELSE 0 END")
_ISSUES.append(("minutes <= 0", "no_minutes"))
_ODD.append(("goals > 0 AND coalesce(minutes, 0) <= 0", "goals_without_minutes"))
_COST += ["CASE WHEN minutes <= 0 THEN 30 ELSE 0 END", "CASE WHEN goals > 0 AND coalesce(minutes, 0) <= 0 THEN 10 ELSE 0 END"]
VIEWS["v_stat_checks"] = f"SELECT player_key, seq, {_flags(*_ISSUES)} AS issues, {_flags(*_ODD)} AS anomalies, greatest(0, 100 - ({' + '.join(_COST)})) / 100.0::DOUBLE AS confidence FROM v_app"
VIEWS["v_profile_checks"] = f"SELECT player_key, {_flags(('player_name IS NULL', 'missing_player_name'), ('length(trim(player_name)) < 2', 'short_name'))} AS issues, {_flags(('regexp_matches(player_name, chr(92) || chr(100) || chr(123) || chr(52) || chr(125))', 'digits_in_name'), ('year(dob) < 1966', 'odd_birth_year'))} AS anomalies FROM v_players"


@query("row_validation", "SELECT player_key, seq, issues, anomalies, confidence, issues = '' AS valid FROM v_stat_checks")
def row_validation(spark, sf_dir):
    t = quality.validate_stats(D.appearances(spark, sf_dir), TABLE_RANGES)
    return t.select("player_key", "seq", F.array_join("issues", ",").alias("issues"), F.array_join("anomalies", ",").alias("anomalies"), "confidence", "valid")


def _checked(spark, sf_dir):
    return {"stats": quality.validate_stats(D.appearances(spark, sf_dir), TABLE_RANGES), "players": quality.validate_profiles(D.players(spark, sf_dir))}


_N = "CASE WHEN anomalies = '' THEN 0 ELSE length(anomalies) - length(replace(anomalies, ',', '')) + 1 END"


@query("validation_summary", " UNION ALL ".join(f"""SELECT '{n}' AS "table", count(*) AS rows, count(*) FILTER (issues = '') AS valid_rows, count(*) FILTER (issues <> '') AS invalid_rows, sum({_N})::BIGINT AS anomalies,
  round(avg((issues = '')::INT), 4) AS share_valid, min({k}) FILTER (issues <> '') AS first_invalid, (SELECT string_agg({k}::VARCHAR, ',' ORDER BY {k}) FROM (SELECT {k} FROM {v} WHERE issues <> '' ORDER BY {k} LIMIT 10)) AS samples FROM {v}""" for n, k, v in (("stats", "seq", "v_stat_checks"), ("players", "player_key", "v_profile_checks"))))
def validation_summary(spark, sf_dir):
    return quality.summary(_checked(spark, sf_dir), {"stats": "seq", "players": "player_key"})


@query("quality_score", "SELECT round(avg((issues = '')::INT), 4) AS score, count(*) AS rows FROM (SELECT issues FROM v_stat_checks UNION ALL SELECT issues FROM v_profile_checks)")
def quality_score(spark, sf_dir):
    return quality.quality_score(list(_checked(spark, sf_dir).values()))


@query("distribution_checks", """WITH t AS (SELECT count(*) AS n, max(score) - min(score) AS spread, stddev_samp(score) AS sd, count(*) - count(DISTINCT player_key) AS repeats FROM v_value)
SELECT 'rows' AS "check", n::DOUBLE AS value, CASE WHEN n >= 150 THEN 'PASS' ELSE 'FAIL' END AS status FROM t UNION ALL SELECT 'spread', round(spread, 3), CASE WHEN spread > 5 THEN 'PASS' ELSE 'WARN' END FROM t
UNION ALL SELECT 'deviation', round(sd, 3), CASE WHEN sd > 1 THEN 'PASS' ELSE 'WARN' END FROM t UNION ALL SELECT 'repeated_keys', repeats::DOUBLE, CASE WHEN repeats = 0 THEN 'PASS' ELSE 'FAIL' END FROM t""")
def distribution_checks(spark, sf_dir):
    return quality.distribution_checks(valuation_of(spark, sf_dir), "score", "player_key", 150, 5.0, 1.0)


_REQUIRED = {"customer": ("c_custkey", "c_name"), "orders": ("o_orderkey",), "lineitem": ("l_orderkey", "no_such_column"), "absent_table": ("x",)}


@query("table_readiness", """SELECT 'customer' AS "table", CASE WHEN count(*) = 0 THEN 'empty' ELSE 'ready' END AS state, count(*) AS rows FROM customer UNION ALL SELECT 'orders', CASE WHEN count(*) = 0 THEN 'empty' ELSE 'ready' END, count(*) FROM orders
UNION ALL SELECT 'lineitem', 'invalid', count(*) FROM lineitem UNION ALL SELECT 'absent_table', 'missing', 0""")
def table_readiness(spark, sf_dir):
    return quality.readiness(spark, sf_dir, _REQUIRED)


# --- merges and dimensions --------------------------------------------------------------------


@query("upsert_merge", "SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN round(c_acctbal + 1, 2) ELSE c_acctbal END AS c_acctbal FROM customer")
def upsert_merge(spark, sf_dir):
    old = D.table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal")
    new = old.filter("c_custkey % 3 = 0").select("c_custkey", F.round(F.col("c_acctbal") + 1, 2).alias("c_acctbal"))
    return warehouse.upsert(old, new, ["c_custkey"])


@query("dedupe_first", "SELECT user_id, event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS i FROM events) WHERE i = 1")
def dedupe_first(spark, sf_dir):
    return warehouse.first_by(D.table(spark, sf_dir, "events"), ["user_id", "event_type"], [F.col("ts"), F.col("event_id")]).select("user_id", "event_type", "event_id")


@query("merge_entities", """SELECT user_id, arg_max(event_type, event_id) FILTER (event_type <> '') AS event_type, arg_max(CASE WHEN value > 10 THEN value END, CASE WHEN value > 10 THEN event_id END) AS big_value FROM events GROUP BY user_id""")
def merge_entities(spark, sf_dir):
    t = D.table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", F.when(F.col("value") > 10, F.col("value")).alias("big_value"))
    return warehouse.merge_fields(t, "user_id", "event_id").select("user_id", "event_type", "big_value")


def _dims(spark, sf_dir):
    m = D.matches(spark, sf_dir)
    clubs = warehouse.club_dimension([D.players(spark, sf_dir).select("club"), m.select("home_club"), m.select("away_club")])
    return clubs, m


VIEWS["v_club_dim"] = """SELECT name, CASE WHEN i = 1 THEN base ELSE base || i::VARCHAR END AS short_code FROM (
  SELECT name, base, row_number() OVER (PARTITION BY base ORDER BY name) AS i FROM (SELECT DISTINCT name, left(split_part(upper(replace(name, '_', ' ')), ' ', 1), 1) || left(split_part(upper(replace(name, '_', ' ')), ' ', 2), 1) AS base FROM (
    SELECT club AS name FROM v_players UNION ALL SELECT home_club FROM v_matches UNION ALL SELECT away_club FROM v_matches) WHERE name IS NOT NULL))"""


@query("dim_load", "SELECT name, short_code FROM v_club_dim")
def dim_load(spark, sf_dir):
    return _dims(spark, sf_dir)[0].select("name", "short_code")


def _facts(spark, sf_dir):
    clubs, m = _dims(spark, sf_dir)
    p = D.players(spark, sf_dir).withColumn("club", F.when(F.col("player_key") % 50 == 7, "No such club").otherwise(F.col("club")))
    good, bad = warehouse.player_dimension(p, clubs)
    return (good, bad), warehouse.stat_facts(D.appearances(spark, sf_dir), good, m)


@query("fact_load", "SELECT player_key, seq, minutes, goals FROM v_app WHERE player_key % 50 <> 7")
def fact_load(spark, sf_dir):
    return _facts(spark, sf_dir)[1][0].select("player_key", "seq", "minutes", "goals")


@query("load_report", """SELECT 'players' AS entity, count(*) FILTER (player_key % 50 <> 7) AS inserted, count(*) FILTER (player_key % 50 = 7) AS failed, 'success_partial' AS status FROM v_players
UNION ALL SELECT 'stats', count(*) FILTER (player_key % 50 <> 7), count(*) FILTER (player_key % 50 = 7), 'success_partial' FROM v_app""")
def load_report(spark, sf_dir):
    players, stats = _facts(spark, sf_dir)
    return warehouse.load_report({"players": players, "stats": stats})


_KEYS = (("external_id",), ("match_date", "home_club", "away_club", "competition"))
VIEWS["v_stored_matches"] = "SELECT match_id, CASE WHEN match_id % 3 <> 0 THEN 'm' || match_id::VARCHAR END AS external_id, match_date, home_club, away_club, competition, home_score, away_score FROM v_matches QUALIFY row_number() OVER (PARTITION BY match_date, home_club, away_club, competition ORDER BY match_id) = 1"
VIEWS["v_match_rows"] = """
SELECT match_id * 10 AS line, external_id, NULL::DATE AS match_date, NULL::VARCHAR AS home_club, NULL::VARCHAR AS away_club, NULL::VARCHAR AS competition, home_score + 1 AS home_score, NULL::BIGINT AS away_score FROM v_stored_matches WHERE match_id % 5 = 0
UNION ALL SELECT match_id * 10, NULL, match_date, home_club, away_club, competition, NULL, away_score + 2 FROM v_stored_matches WHERE match_id % 5 = 1
UNION ALL SELECT match_id * 10, 'n' || match_id::VARCHAR, match_date + 10000, home_club, away_club, competition, home_score, NULL FROM v_stored_matches WHERE match_id % 5 = 2
UNION ALL SELECT match_id * 10 + 1, NULL, match_date + 10000, home_club, away_club, competition, NULL, 7 FROM v_stored_matches WHERE match_id % 5 = 2
UNION ALL SELECT a.match_id * 10, a.external_id, b.match_date, b.home_club, b.away_club, b.competition, 99, 99 FROM v_stored_matches a CROSS JOIN (SELECT * FROM v_stored_matches WHERE match_id % 5 = 4 ORDER BY match_id LIMIT 1) b WHERE a.match_id % 5 = 3 AND a.external_id IS NOT NULL"""
VIEWS["v_match_told"] = """
SELECT r.*, a.match_id AS by_id, b.match_id AS by_place, CASE WHEN r.external_id IS NULL AND r.match_date IS NULL THEN 'failed' WHEN a.match_id <> b.match_id THEN 'conflict' WHEN coalesce(a.match_id, b.match_id) IS NOT NULL THEN 'update' ELSE 'insert' END AS action,
  CASE WHEN coalesce(a.match_id, b.match_id) IS NOT NULL THEN coalesce(a.match_id, b.match_id)::VARCHAR ELSE 'new:n' || (line // 10)::VARCHAR END AS id
FROM v_match_rows r LEFT JOIN v_stored_matches a ON r.external_id = a.external_id LEFT JOIN v_stored_matches b ON r.match_date = b.match_date AND r.home_club = b.home_club AND r.away_club = b.away_club AND r.competition = b.competition"""


@once
def match_rows(spark, sf_dir):
    """(stored matches, rows to load): corrections by id or by date and clubs, new matches in two parts, rows whose keys differ, rows without a key."""
    first = Window.partitionBy("match_date", "home_club", "away_club", "competition").orderBy("match_id")
    m = D.matches(spark, sf_dir).withColumn("n", F.row_number().over(first)).filter("n = 1").drop("n")
    return m.withColumn("external_id", F.when(F.col("match_id") % 3 != 0, F.concat(F.lit("m"), F.col("match_id").cast("string"))))


def _match_load(spark, sf_dir):
    m = match_rows(spark, sf_dir)
    text, whole = F.lit(None).cast("string"), F.lit(None).cast("long")
    of = lambda k, at, ext, place, home, away, src=m: src.filter(F.col("match_id") % 5 == k).select((F.col("match_id") * 10 + at).alias("line"), ext.alias("external_id"), *[p.alias(c) for p, c in zip(place, _KEYS[1], strict=True)], home.alias("home_score"), away.alias("away_score"))
    place, later = [F.col(c) for c in _KEYS[1]], [F.date_add("match_date", 10000), *[F.col(c) for c in _KEYS[1][1:]]]
    none = [F.lit(None).cast("date"), text, text, text]
    other = m.filter("match_id % 5 = 4").orderBy("match_id").limit(1).select(*[F.col(c).alias(f"o_{c}") for c in _KEYS[1]])
    new = of(0, 0, F.col("external_id"), none, F.col("home_score") + 1, whole)
    new = new.unionByName(of(1, 0, text, place, whole, F.col("away_score") + 2))
    new = new.unionByName(of(2, 0, F.concat(F.lit("n"), F.col("match_id").cast("string")), later, F.col("home_score"), whole))
    new = new.unionByName(of(2, 1, text, later, whole, F.lit(7).cast("long")))
    clash = m.filter("external_id is not null").crossJoin(F.broadcast(other))  # one row
    new = new.unionByName(of(3, 0, F.col("external_id"), [F.col(f"o_{c}") for c in _KEYS[1]], F.lit(99).cast("long"), F.lit(99).cast("long"), clash))
    stored = m.select(F.col("match_id").cast("string").alias("match_id"), "external_id", *_KEYS[1], F.col("home_score").cast("long").alias("home_score"), F.col("away_score").cast("long").alias("away_score"))
    return identity.upsert_by(stored, new, "line", _KEYS, "match_id")


@query("match_upsert", """SELECT coalesce(s.match_id::VARCHAR, u.id) AS match_id, coalesce(u.external_id, s.external_id) AS external_id, coalesce(u.match_date, s.match_date)::VARCHAR AS match_date, coalesce(u.home_score, s.home_score) AS home_score, coalesce(u.away_score, s.away_score) AS away_score
FROM v_stored_matches s FULL JOIN (SELECT id, arg_max(external_id, line) AS external_id, arg_max(match_date, line) AS match_date, arg_max(home_score, line) AS home_score, arg_max(away_score, line) AS away_score FROM v_match_told WHERE action IN ('update', 'insert') GROUP BY id) u ON s.match_id::VARCHAR = u.id""")
def match_upsert(spark, sf_dir):
    table, _ = _match_load(spark, sf_dir)
    return table.select("match_id", "external_id", F.col("match_date").cast("string").alias("match_date"), "home_score", "away_score")


@query("match_upsert_report", """SELECT 'matches' AS entity, count(*) AS attempted, count(DISTINCT CASE WHEN action = 'insert' THEN id END) AS inserted, count(*) FILTER (action IN ('insert', 'update')) - count(DISTINCT CASE WHEN action = 'insert' THEN id END) AS updated,
  count(*) FILTER (action = 'conflict') AS skipped, count(*) FILTER (action = 'failed') AS failed, 'success_partial' AS status FROM v_match_told""")
def match_upsert_report(spark, sf_dir):
    return identity.upsert_report(_match_load(spark, sf_dir)[1], "matches")


@query("match_upsert_errors", "SELECT line, CASE action WHEN 'conflict' THEN 'keys name different rows' ELSE 'no key has all its columns' END AS reason FROM v_match_told WHERE action IN ('conflict', 'failed') ORDER BY line LIMIT 10")
def match_upsert_errors(spark, sf_dir):
    return identity.error_rows(_match_load(spark, sf_dir)[1], "line")


@query("match_fallback", """SELECT a.player_key, a.seq, coalesce(CASE WHEN a.seq % 2 = 0 THEN a.seq END, m.match_id) AS found_match FROM v_app a JOIN v_players p USING (player_key) LEFT JOIN (
  SELECT match_date, club, min(match_id) AS match_id FROM (SELECT match_date, home_club AS club, match_id FROM v_matches UNION ALL SELECT match_date, away_club, match_id FROM v_matches) GROUP BY ALL) m ON m.match_date = a.match_date AND m.club = p.club""")
def match_fallback(spark, sf_dir):
    s = D.appearances(spark, sf_dir).select("player_key", "seq", "match_date", F.when(F.col("seq") % 2 == 0, F.col("seq")).alias("external_id")).join(D.players(spark, sf_dir).select("player_key", "club"), "player_key")
    return warehouse.match_lookup(s, D.matches(spark, sf_dir)).select("player_key", "seq", "found_match")


@query("changed_keys", """SELECT event_id, sha256('{"event_type":"' || event_type || '","value":' || value::VARCHAR || '}') AS hash, event_id % 7 = 0 AS is_new FROM events WHERE event_id % 7 IN (0, 1)""")
def changed_keys(spark, sf_dir):
    new = D.table(spark, sf_dir, "events").select("event_id", "event_type", "value")
    own = X.content_hash(["event_type", "value"])
    old = new.filter("event_id % 7 <> 0").select("event_id", F.when(F.col("event_id") % 7 == 1, F.lit("old")).otherwise(own).alias("hash"))
    return warehouse.changed(new, old, "event_id", ["event_type", "value"])


@query("fresh_filter", "SELECT event_id FROM events WHERE ts IS NULL OR epoch(TIMESTAMP '2024-01-15 00:00:00') - epoch(date_trunc('second', ts)) >= 86400")
def fresh_filter(spark, sf_dir):
    return warehouse.stale(D.table(spark, sf_dir, "events"), "ts", F.lit("2024-01-15 00:00:00").cast("timestamp")).select("event_id")


@query("incremental_refresh", "SELECT player_key, matches, minutes, goals, assists, yellow + 2 * red AS discipline FROM v_totals")
def incremental_refresh(spark, sf_dir):
    """Totals as stored before the last year, with the players who played in it built anew."""
    stats = D.appearances(spark, sf_dir)
    last = F.col("match_date") >= F.lit("1998-01-01").cast("date")
    stored = features.player_totals(stats.filter(~last))
    t = refresh.refresh_totals(stats, stored, stats.filter(last).select("player_key").distinct())
    return t.select("player_key", "matches", "minutes", "goals", "assists", "discipline")


@query("stream_totals", "SELECT player_key, matches, minutes, goals, assists, yellow + 2 * red AS discipline FROM v_totals")
def stream_totals(spark, sf_dir):
    """Totals kept by a stream to which all appearances come as files, four batches one behind the other."""
    work = folder(spark)
    stats = D.appearances(spark, sf_dir)
    stats.repartition(4, "seq").write.parquet(f"{work}/arrived")
    stream = refresh.TotalsStream(spark, f"{work}/arrived", work, stats.schema, buckets=8)
    stream.run()
    return stream.current().select("player_key", "matches", "minutes", "goals", "assists", "discipline")


@query("event_windows", "SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS start, event_type, count(*) AS events, sum(value::DECIMAL(18,4))::DOUBLE AS value FROM events GROUP BY 1, 2")
def event_windows(spark, sf_dir):
    return refresh.event_windows(D.table(spark, sf_dir, "events")).withColumn("start", F.date_format("start", "yyyy-MM-dd"))


# --- graph ------------------------------------------------------------------------------------

VIEWS["v_edges"] = """SELECT from_club AS src, to_club AS dst, count(*) AS moves, round(sum(round(greatest(0.1::DOUBLE, b.prestige - a.prestige + 0.2::DOUBLE) * ln(1.0::DOUBLE + fee), 6)::DECIMAL(20,6))::DOUBLE, 4) AS w
FROM v_transfers JOIN v_clubs a ON from_club = a.club JOIN v_clubs b ON to_club = b.club WHERE from_club <> to_club GROUP BY 1, 2"""


def edges_of(spark, sf_dir):
    return graph.edges(D.transfers(spark, sf_dir), D.clubs(spark, sf_dir))


@query("edges", "SELECT * FROM v_edges")
def edges(spark, sf_dir):
    return edges_of(spark, sf_dir)


@query("node_roles", """SELECT c.club AS node, coalesce(out_clubs, 0) AS out_clubs, coalesce(in_clubs, 0) AS in_clubs, coalesce(out_moves, 0)::BIGINT AS out_moves, coalesce(in_moves, 0)::BIGINT AS in_moves, springboard,
  CASE WHEN prestige < 0.4 AND coalesce(out_moves, 0) >= coalesce(in_moves, 0) THEN 'exporter' WHEN prestige >= 0.8 THEN 'destination' WHEN springboard > 10 THEN 'springboard' ELSE 'bridge' END AS role, top_clubs
FROM (SELECT c.*, o.* EXCLUDE (src), i.* EXCLUDE (dst), round(coalesce(lift, 0.0) / (prestige + 0.1::DOUBLE) / (coalesce(out_clubs, 0) + 1), 3) AS springboard FROM v_clubs c
  LEFT JOIN (SELECT src, count(*) AS out_clubs, sum(moves) AS out_moves, sum(round(w * prestige, 6)::DECIMAL(24,6))::DOUBLE AS lift, array_to_string(list(dst ORDER BY w DESC, dst)[1:5], ',') AS top_clubs FROM v_edges JOIN v_clubs ON dst = club GROUP BY src) o ON c.club = src
  LEFT JOIN (SELECT dst, count(*) AS in_clubs, sum(moves) AS in_moves FROM v_edges GROUP BY dst) i ON c.club = dst) c""")
def node_roles(spark, sf_dir):
    return graph.node_stats(edges_of(spark, sf_dir), D.clubs(spark, sf_dir))


_ROUNDS = 60


def _pagerank_sql() -> str:
    parts = ["e AS MATERIALIZED (SELECT src, dst, w / sum(w) OVER (PARTITION BY src) AS f FROM v_edges)", "n AS MATERIALIZED (SELECT src AS node FROM v_edges UNION SELECT dst FROM v_edges)", "r0 AS MATERIALIZED (SELECT node, 1.0::DOUBLE / (SELECT count(*) FROM n) AS rank FROM n)"]
    for k in range(_ROUNDS):
        parts.append(f"""r{k + 1} AS MATERIALIZED (SELECT n.node, 0.15::DOUBLE / (SELECT count(*) FROM n) + 0.85::DOUBLE * (coalesce(got, 0.0::DOUBLE) + (SELECT coalesce(sum(rank), 0.0::DOUBLE) FROM r{k} WHERE node NOT IN (SELECT src FROM e)) / (SELECT count(*) FROM n)) AS rank
  FROM n LEFT JOIN (SELECT dst, sum(rank * f) AS got FROM r{k} JOIN e ON node = src GROUP BY dst) g ON n.node = dst)""")
    return "WITH " + ",\n".join(parts) + f"\nSELECT node, round(rank, 6) AS rank FROM r{_ROUNDS}"


@query("pagerank", _pagerank_sql())
def pagerank(spark, sf_dir):
    return graph.pagerank(edges_of(spark, sf_dir), _ROUNDS).select("node", F.round("rank", 6).alias("rank"))


def _routes_sql() -> str:
    parts = ["t AS MATERIALIZED (SELECT src, dst, i, prestige AS pd FROM (SELECT src, dst, row_number() OVER (PARTITION BY src ORDER BY w DESC, dst) AS i FROM v_edges) JOIN v_clubs ON dst = club WHERE i <= 5)", "h0 AS (SELECT club AS start, club AS here, prestige, [club] AS route FROM v_clubs)"]
    for k in range(3):
        parts.append(f"""h{k + 1} AS (SELECT h.start, coalesce(next, here) AS here, prestige, CASE WHEN next IS NULL THEN route ELSE list_append(route, next) END AS route FROM h{k} h
  LEFT JOIN (SELECT start, arg_min(dst, i) AS next FROM h{k} JOIN t ON here = src AND pd > prestige + 0.05::DOUBLE AND NOT list_contains(route, dst) GROUP BY start) m ON h.start = m.start)""")
    return "WITH " + ",\n".join(parts) + "\nSELECT start, (len(route) - 1)::INTEGER AS hops, array_to_string(route, ' > ') AS route FROM h3"


@query("routes", _routes_sql())
def routes(spark, sf_dir):
    return graph.routes(edges_of(spark, sf_dir), D.clubs(spark, sf_dir))


# --- models -----------------------------------------------------------------------------------


@query("training_set", """SELECT *, CASE WHEN age <= 24 AND prestige < 0.60 AND trajectory >= 0.5 THEN 0.70::DOUBLE WHEN age <= 27 THEN 0.50::DOUBLE ELSE 0.30::DOUBLE END AS p1, 0.85::DOUBLE AS minutes_ratio FROM (
SELECT s.player_key, s.spell, coalesce(mid_age::DOUBLE, 23.0) AS age, round(40 + 60 * peak / max(peak) OVER (PARTITION BY s.player_key), 4) AS score, round(coalesce(prestige, 0.4), 4) AS prestige,
  CASE WHEN change > 0.1 THEN 1.0::DOUBLE WHEN change < -0.1 THEN 0.0::DOUBLE ELSE 0.5::DOUBLE END AS trajectory, round(log10(peak), 4) AS label FROM v_spells s LEFT JOIN v_clubs c ON s.club = c.club)""")
def training_set(spark, sf_dir):
    return models.training_set(spells_of(spark, sf_dir), D.clubs(spark, sf_dir))


def _league_base(spark, sf_dir):
    clubs = D.clubs(spark, sf_dir).select("club", F.round(F.col("prestige") * 20e6, 2).alias("base_value"), "prestige")
    v = valuation_of(spark, sf_dir).select("player_key", "club", "score", "age", "market_value")
    return v.join(F.broadcast(clubs), "club", "left").join(transfer_of(spark, sf_dir).select("player_key", "p1"), "player_key", "left").join(drift_of(spark, sf_dir).select("player_key", "direction"), "player_key", "left")


def _analytic(spark, sf_dir):
    t = _league_base(spark, sf_dir)
    return t.withColumn("analytic", models.analytic_value(F.col("base_value"), F.col("score"), F.col("age"), F.col("p1"), F.col("direction")))


@query("market_value_analytic", """SELECT v.player_key, round(round(prestige * 20e6::DOUBLE, 2) * pow(least(100.0::DOUBLE, greatest(0.0::DOUBLE, CASE WHEN score IS NULL OR score = 0 THEN 50.0::DOUBLE ELSE score END)) / 50.0::DOUBLE, 1.4::DOUBLE)
  * coalesce(exp(-((v.age - 24.0::DOUBLE) * (v.age - 24.0::DOUBLE)) / 40.5::DOUBLE), 0.8::DOUBLE) * (1.0::DOUBLE + 0.30::DOUBLE * coalesce(p1, 0.0::DOUBLE) + CASE direction WHEN 'improving' THEN 0.15::DOUBLE WHEN 'declining' THEN -0.10::DOUBLE ELSE 0.0::DOUBLE END), 0) AS analytic
FROM v_value v LEFT JOIN v_clubs c ON v.club = c.club LEFT JOIN v_transfer_p t ON v.player_key = t.player_key LEFT JOIN v_drift d ON v.player_key = d.player_key""")
def market_value_analytic(spark, sf_dir):
    return _analytic(spark, sf_dir).select("player_key", "analytic")


_INPUTS = ["age", "score", "prestige", "trajectory", "p1", "minutes_ratio"]


@query("market_value")
def market_value(spark, sf_dir):
    """Boosted trees over all spells, mixed with the analytic form and the stated value, with an interval and how far it is trusted."""
    samples = cut(training_set(spark, sf_dir))
    model = models.fit_value_model(samples, _INPUTS)
    error = models.log_error(model, samples)
    stats = features.player_totals(D.appearances(spark, sf_dir)).select("player_key", F.least(F.lit(1.0), F.col("minutes") / (F.col("matches") * 90.0)).alias("minutes_ratio"))
    sure = confidence_index(spark, sf_dir).select("player_key", "confidence", "sources")
    t = _analytic(spark, sf_dir).join(stats, "player_key", "left").join(sure, "player_key", "left")
    t = t.withColumns({"trajectory": F.when(F.col("direction") == "improving", 1.0).when(F.col("direction") == "declining", 0.0).otherwise(0.5), "age": F.col("age").cast("double")})
    t = model.transform(t.fillna({"age": 23.0, "score": 50.0, "prestige": 0.4, "p1": 0.0, "minutes_ratio": 0.80}))
    predicted = F.pow(F.lit(10.0), F.col("prediction"))
    t = t.withColumn("blended", models.blended(predicted, F.col("analytic"), F.col("market_value")))
    low, high = models.interval(F.col("blended"), error, F.col("confidence"))
    trust = models.value_confidence(F.col("confidence"), F.col("market_value"), F.coalesce(F.col("sources") >= 2, F.lit(False)))
    return t.select("player_key", F.round(predicted, 0).alias("predicted"), "analytic", "blended", low.alias("low"), high.alias("high"), trust.alias("confidence"))


def success_of(spark, sf_dir, keys=None):
    """Best destination league of every player, or of those of keys; learned from all spells either way."""
    samples = cut(training_set(spark, sf_dir).withColumn("label", (F.col("trajectory") == 1.0).cast("double")))
    model = models.fit_success_model(samples, ["age", "score", "prestige"])
    leagues = D.leagues(spark, sf_dir).select("league", "ord", F.col("prestige").alias("prestige"))
    rows = valuation_of(spark, sf_dir).select("player_key", F.coalesce(F.col("age").cast("double"), F.lit(24.0)).alias("age"), "score")
    rows = (rows if keys is None else rows.join(keys, "player_key", "left_semi")).crossJoin(F.broadcast(leagues))
    scored = models.success(model, rows)
    best = F.max_by(F.struct("league", "success"), F.struct("success", (-F.col("ord")).alias("o")))
    return scored.groupBy("player_key").agg(best.alias("b"), F.count_if(F.col("success") >= 0.60).alias("recommended")).select("player_key", "b.league", "b.success", "recommended")


@query("pathway_success")
def pathway_success(spark, sf_dir):
    """Chance that a spell ends higher than it began, from all spells; the best destination league per player."""
    return success_of(spark, sf_dir)


_DIMS = 64
_START = "SELECT vec_id AS cluster, embedding::DOUBLE[] AS c FROM embeddings WHERE vec_id < 5"


def _lloyd_sql() -> str:
    parts = [f"c0 AS MATERIALIZED ({_START})", "x AS MATERIALIZED (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings)"]
    for k in range(3):
        parts.append(f"a{k} AS MATERIALIZED (SELECT vec_id, cluster, d AS distance FROM (SELECT vec_id, cluster, d, row_number() OVER (PARTITION BY vec_id ORDER BY d, cluster) AS i FROM (SELECT vec_id, cluster, round(list_sum(list_transform(list_zip(v, c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), 6) AS d FROM x, c{k})) WHERE i = 1)")
        if k < 2:
            parts.append(f"c{k + 1} AS MATERIALIZED (SELECT cluster, list(m ORDER BY i) AS c FROM (SELECT cluster, i, round(avg(v[i]), 6) AS m FROM a{k} JOIN x USING (vec_id), range(1, {_DIMS + 1}) t(i) GROUP BY cluster, i) GROUP BY cluster)")
    return "WITH " + ",\n".join(parts) + "\nSELECT vec_id, cluster, distance FROM a2"


@query("lloyd_fixed", _lloyd_sql())
def lloyd_fixed(spark, sf_dir):
    rows = D.table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    return models.lloyd(rows, "vec_id", "v", rows.filter("vec_id < 5").select(F.col("vec_id").alias("cluster"), F.col("v").alias("c")), 2)


def cluster_rows(spark, sf_dir):
    """(key, v): the eight features of every player with appearances, in millionths of their fixed ranges."""
    stats = D.appearances(spark, sf_dir)
    t = kpi_of(spark, sf_dir).select("player_key", "age", "minutes", X.per_90("goals", "minutes").alias("goals_per_90"), X.per_90("assists", "minutes").alias("assists_per_90"), X.per_90("shots", "minutes").alias("shots_per_90"), X.per_90("passes", "minutes").alias("passes_per_90"))
    t = t.join(features.expected_metrics(stats).select("player_key", "xg_per_90", "xa_per_90"), "player_key", "left")
    return t.select(F.col("player_key").alias("key"), models.in_ranges(t).alias("v"))


VIEWS["v_cluster_rows"] = "SELECT k.player_key, [" + ", ".join(
    f"round(least(1.0::DOUBLE, greatest(0.0::DOUBLE, (CASE WHEN coalesce({e}, 0) = 0 THEN {models.DEFAULT_AGE if c == 'age' else 0.0}::DOUBLE ELSE ({e})::DOUBLE END - {low}::DOUBLE) / ({high}::DOUBLE - {low}::DOUBLE))) * 1000000.0::DOUBLE)::BIGINT"
    for (c, (low, high)), e in zip(models.CLUSTER_RANGES.items(), (*(P90.format(x) for x in ("goals", "assists", "shots", "passes")), "xg_per_90", "xa_per_90", "minutes", "age"), strict=True)
) + "] AS v FROM v_kpi0 k LEFT JOIN (SELECT player_key, xg_per_90, xa_per_90 FROM v_expected) e ON k.player_key = e.player_key"


@query("kmeans")
def kmeans(spark, sf_dir):
    """Five clusters of eight features, centres drawn by distance, up to a hundred rounds."""
    found, _ = models.seeded_clusters(cluster_rows(spark, sf_dir))
    names = F.array(*[F.lit(a) for a in models.ARCHETYPES])
    return found.select(F.col("key").alias("player_key"), "cluster", F.get(names, F.col("cluster")).alias("archetype"))


@query("cluster_features", "SELECT player_key, " + ", ".join(f"v[{i + 1}] AS {c}" for i, c in enumerate(models.CLUSTER_RANGES)) + " FROM v_cluster_rows")
def cluster_features(spark, sf_dir):
    return cluster_rows(spark, sf_dir).select(F.col("key").alias("player_key"), *[F.get("v", F.lit(i)).alias(c) for i, c in enumerate(models.CLUSTER_RANGES)])


@query("cluster_profile", """SELECT label AS cluster, count(*) AS size, """ + ", ".join(f"round(avg(embedding[{i + 1}]::DOUBLE), 4) AS d{i}" for i in range(_DIMS)) + """, CASE greatest(""" + ", ".join(f"round(avg(embedding[{i + 1}]::DOUBLE), 4)" for i in range(_DIMS)) + ") " + " ".join(f"WHEN round(avg(embedding[{i + 1}]::DOUBLE), 4) THEN 'd{i}'" for i in range(_DIMS)) + " END AS label FROM embeddings GROUP BY embeddings.label")
def cluster_profile(spark, sf_dir):
    dims = [f"d{i}" for i in range(_DIMS)]
    t = D.table(spark, sf_dir, "embeddings").select(F.col("label").alias("cluster"), *[F.get("embedding", F.lit(i)).cast("double").alias(d) for i, d in enumerate(dims)])
    return models.cluster_profile(t, dims)


# --- pages ------------------------------------------------------------------------------------


@query("page_titles", """SELECT page_id, nullif(trim(regexp_replace(regexp_replace(trim(regexp_extract(html, '(?s)<title[^>]*>(.*?)</title>', 1)), '\\s+[-|]\\s+.*$', ''), '\\s+', ' ', 'g')), '') AS title FROM pages""")
def page_titles(spark, sf_dir):
    return D.table(spark, sf_dir, "pages").select("page_id", pages.title(F.col("html")).alias("title"))


VIEWS["v_links"] = """SELECT page_id, unnest(regexp_extract_all(html, '(?s)<a\\s[^>]*href="([^"]*)"[^>]*>.*?</a>', 1)) AS href, unnest(regexp_extract_all(html, '(?s)<a\\s[^>]*href="[^"]*"[^>]*>(.*?)</a>', 1)) AS label,
  unnest(range(len(regexp_extract_all(html, '(?s)<a\\s[^>]*href="[^"]*"[^>]*>.*?</a>')))) AS position FROM pages"""


@query("page_links", """SELECT page_id, href, label, position::INTEGER AS position FROM (SELECT *, row_number() OVER (PARTITION BY page_id, href ORDER BY position) AS i FROM v_links WHERE href LIKE '/%' AND length(label) > 1 AND href NOT LIKE '%the%') WHERE i = 1""")
def page_links(spark, sf_dir):
    return pages.links(D.table(spark, sf_dir, "pages"), "^/", ("the",)).select("page_id", "href", "label", "position")


@query("page_class", """SELECT page_id, CASE WHEN markers > 0 THEN 'challenge' WHEN trim(b) = '' THEN 'empty_body' WHEN regexp_matches(b, '(?s)<!--[^>]*<article') THEN 'comment_wrapped' WHEN contains(b, '<article') THEN 'ok' ELSE 'selector_missing' END AS kind, markers
FROM (SELECT page_id, lower(coalesce(html, '')) AS b, """ + " + ".join(f"contains(lower(coalesce(html, '')), '{m}')::INTEGER" for m in pages.CHALLENGE) + " AS markers FROM pages)")
def page_class(spark, sf_dir):
    return pages.classify(D.table(spark, sf_dir, "pages"))


def stat_pages(spark, sf_dir):
    """A match page per order, written from the appearances: what player_stats() must read back."""
    a = D.appearances(spark, sf_dir).join(D.players(spark, sf_dir).select("player_key", "player_name"), "player_key")
    cell = lambda n, c: F.concat(F.lit(f'<td data-stat="{n}">'), F.coalesce(c.cast("string"), F.lit("")), F.lit("</td>"))
    head = F.lit('<!-- <table class="x" id="stats_match"><tr><th>Player</th></tr>')
    row = F.concat(F.lit("<tr>"), cell("player", F.col("player_name")), cell("min", F.col("minutes")), cell("goals", F.col("goals")), cell("assists", F.col("assists")), cell("shots", F.col("shots")), cell("xg", F.col("xg")), cell("goals_per90", X.per_90("goals", "minutes")), F.lit("</tr>"))
    page = F.concat(F.lit("<html><title>A "), F.col("goals").cast("string"), F.lit("–"), F.col("assists").cast("string"), F.lit(" B</title>"), head, row, F.lit("</table> --></html>"))
    return a.select(F.col("seq").alias("page_id"), F.concat(F.lit("https://example.org/matches/m"), F.col("seq").cast("string"), F.lit("/x")).alias("url"), page.alias("html"))


@query("stat_tables", "SELECT seq AS page_id, player_name, minutes, goals, assists, shots, round(xg, 3) AS xg FROM v_app JOIN v_players USING (player_key)")
def stat_tables(spark, sf_dir):
    return pages.player_stats(stat_pages(spark, sf_dir)).select("page_id", "player_name", "minutes", "goals", "assists", "shots", "xg")


@query("per_90_tables", "SELECT seq AS page_id, round(goals::DOUBLE / minutes * 90.0, 3) AS goals_per90 FROM v_app WHERE minutes > 0")
def per_90_tables(spark, sf_dir):
    m = pages.per_90_maps(stat_pages(spark, sf_dir))
    return m.select("page_id", F.col("metrics")["goals_per90"].cast("double").alias("goals_per90")).filter("goals_per90 is not null")


@query("match_headers", "SELECT seq AS page_id, 'm' || seq::VARCHAR AS external_id, 'A' AS home_club, 'B' AS away_club, goals::INTEGER AS home_score, assists::INTEGER AS away_score FROM v_app")
def match_headers(spark, sf_dir):
    return pages.match_header(stat_pages(spark, sf_dir)).select("page_id", "external_id", "home_club", "away_club", "home_score", "away_score")


_BLOB = """'{"id": ' || page_id::VARCHAR || ', "note": "a };{ \\" }", "deep": {"rows": [1, {"t": "}"}, {}], "size": ' || length(html)::VARCHAR || '}}'"""


@query("embedded_blobs", f"""SELECT page_id, block, json, json->>'$.note' AS note, (json->>'$.deep.size')::BIGINT AS size, json_array_length(json->'$.deep.rows')::BIGINT AS items FROM (
  SELECT page_id, 0 AS block, {_BLOB} AS json FROM pages UNION ALL SELECT page_id, 1, '{{"other": ' || page_id::VARCHAR || '}}' FROM pages)""")
def embedded_blobs(spark, sf_dir):
    """Objects that scripts of the pages assign: braces within braces and in strings, one cut off, one that is no JSON."""
    s = lambda c: F.col(c).cast("string")
    blob = F.concat(F.lit('{"id": '), s("page_id"), F.lit(', "note": "a };{ \\" }", "deep": {"rows": [1, {"t": "}"}, {}], "size": '), F.length("html").cast("string"), F.lit("}}"))
    text = F.concat("html", F.lit("<script>window.__data = "), blob, F.lit(";</script><script>__DATA__={no json};</script><script> __NEXT_DATA__  =\n"), F.concat(F.lit('{"other": '), s("page_id"), F.lit("}")), F.lit(' ; window.__data = {"open": {"x": 1}</script>'))
    t = pages.embedded_objects(D.table(spark, sf_dir, "pages").withColumn("html", text))
    v = F.parse_json("json")
    rows = F.try_variant_get(v, "$.deep.rows", "array<variant>")
    return t.select("page_id", "block", "json", F.try_variant_get(v, "$.note", "string").alias("note"), F.try_variant_get(v, "$.deep.size", "bigint").alias("size"), F.when(rows.isNotNull(), F.size(rows)).cast("long").alias("items"))


# --- documents, matching, serving -------------------------------------------------------------


def nested_players(spark, sf_dir):
    """A nested document per player, with its spells as history and its moves as transfers."""
    t = D.transfers(spark, sf_dir)
    moves = t.groupBy("player_key").agg(F.array_sort(F.collect_list(F.struct(F.col("date").cast("string").alias("date"), F.col("season").cast("string").alias("season"), "from_club", "to_club", F.when(F.col("loan"), "loan").otherwise(F.col("fee").cast("string")).alias("fee")))).alias("transfers"))
    return D.players(spark, sf_dir).join(moves, "player_key").select(F.col("player_key").cast("string").alias("file"), F.struct(F.concat(F.lit("  "), "player_name").alias("player_name")).alias("profile"), "transfers")


@query("document_transfers", """SELECT player_name, from_club, to_club, CASE WHEN NOT loan THEN round(fee, 2) END AS fee_eur, season::VARCHAR AS season, loan, CASE WHEN loan THEN 'loan' ELSE 'permanent' END AS transfer_type FROM v_transfers JOIN v_players USING (player_key)""")
def document_transfers(spark, sf_dir):
    raw = documents.document_transfers(nested_players(spark, sf_dir))
    return documents.normalized_transfers(raw).select(X.clean_text("player_name").alias("player_name"), "from_club", "to_club", F.round("fee_eur", 2).alias("fee_eur"), "season", "loan", "transfer_type")


@query("registry_union", """SELECT c_custkey AS key, CASE WHEN c_custkey % 2 = 0 THEN 'new/' || c_custkey::VARCHAR WHEN c_custkey % 3 = 0 THEN 'https://example.org/' || c_custkey::VARCHAR ELSE 'old/' || c_custkey::VARCHAR END AS url FROM customer""")
def registry_union(spark, sf_dir):
    k = D.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"))
    s = F.col("key").cast("string")
    old = k.select("key", F.when(F.col("key") % 3 != 0, F.concat(F.lit("old/"), s)).alias("url"))
    return documents.registry([(0, old), (1, k.filter("key % 2 = 0").select("key", F.concat(F.lit("new/"), s).alias("url")))], "key", "https://example.org/")


_SIM = "CASE WHEN n = m THEN 1.0::DOUBLE WHEN contains(n, m) OR contains(m, n) THEN greatest(0.85::DOUBLE, 1.0::DOUBLE - levenshtein(n, m)::DOUBLE / greatest(length(n), length(m), 1)) ELSE 1.0::DOUBLE - levenshtein(n, m)::DOUBLE / greatest(length(n), length(m), 1) END"
_CODES = ["ST", "cm", "CB ", "goalkeeper", "coach"]


def named_parts(spark, sf_dir):
    """(records, known): every part as a known entity, and again under a name that differs in every word, a club or age that may be missing, and another position."""
    part = D.table(spark, sf_dir, "part")
    k = F.col("p_partkey")
    code = lambda i: F.get(F.array(*[F.lit(c) for c in _CODES]), (i % 6).cast("int"))
    known = part.select(k.alias("slug"), F.col("p_name").alias("name"), F.when(k % 11 != 0, F.col("p_size")).alias("age"), F.col("p_brand").alias("club"), code(F.col("p_size")).alias("position"))
    name = F.when(k % 4 == 0, F.concat("p_name", F.lit("s"))).when(k % 4 == 1, F.expr("substr(p_name, 2)")).when(k % 4 == 2, F.replace("p_name", F.lit(" "), F.lit("-x"))).otherwise(F.upper("p_name"))
    records = part.select(k.alias("record_id"), name.alias("name"), (F.col("p_size") + k % 3).alias("age"), F.when(k % 7 != 0, F.col("p_brand")).alias("club"), code(F.col("p_size") + k % 2).alias("position"))
    return records, known


def _plain_sql(c: str) -> str:
    return f"trim(regexp_replace(regexp_replace(lower(strip_accents({c})), '[^\\w\\s]', '', 'g'), '\\s+', ' ', 'g'))"


_CODE_SQL = "list_extract(['fw', 'mf', 'df', 'gk', 'other'], (({}) % 6 + 1)::INTEGER)"


VIEWS["v_entity"] = f"""WITH k AS (SELECT p_partkey AS slug, {_plain_sql("p_name")} AS m, CASE WHEN p_partkey % 11 <> 0 THEN p_size END AS k_age, {_plain_sql("p_brand")} AS k_club, {_CODE_SQL.format("p_size")} AS k_position FROM part),
r AS (SELECT p_partkey AS record_id, {_plain_sql("CASE p_partkey % 4 WHEN 0 THEN p_name || 's' WHEN 1 THEN substr(p_name, 2) WHEN 2 THEN replace(p_name, ' ', '-x') ELSE upper(p_name) END")} AS n,
  p_size + p_partkey % 3 AS r_age, CASE WHEN p_partkey % 7 <> 0 THEN {_plain_sql("p_brand")} END AS r_club, {_CODE_SQL.format("p_size + p_partkey % 2")} AS r_position FROM part),
p AS MATERIALIZED (SELECT * FROM (SELECT n, m, {_SIM} AS sim FROM (SELECT DISTINCT n FROM r), (SELECT DISTINCT m FROM k)) WHERE sim >= 0.80),
s AS (SELECT record_id, slug, round(least(0.60::DOUBLE * sim + CASE WHEN coalesce(abs(r_age - k_age) <= 1, TRUE) THEN 0.20::DOUBLE ELSE 0.0 END + CASE WHEN coalesce(r_club = k_club, TRUE) THEN 0.12::DOUBLE ELSE 0.0 END
  + CASE WHEN coalesce(r_position = k_position, TRUE) THEN 0.08::DOUBLE ELSE 0.0 END, 1.0::DOUBLE), 4) AS score FROM r JOIN p USING (n) JOIN k USING (m))
SELECT record_id, slug, score, CASE WHEN score >= 0.88 THEN 'confident' ELSE 'low' END AS level FROM (SELECT record_id, slug, score, row_number() OVER (PARTITION BY record_id ORDER BY score DESC, slug) AS i FROM s) WHERE i = 1 AND score >= 0.80"""


@query("entity_match", "SELECT * FROM v_entity")
def entity_match(spark, sf_dir):
    """Every part's record against every part, by edit distance, which SQL has too."""
    return resolution.resolve(*named_parts(spark, sf_dir), measure="edit")


@query("entity_match_ratio")
def entity_match_ratio(spark, sf_dir):
    """The same by the ratio of matching blocks, which SQL lacks."""
    return resolution.resolve(*named_parts(spark, sf_dir))


@query("discovered", """SELECT p_partkey AS record_id, name, coalesce(slug::VARCHAR, trim(regexp_replace(lower(name), '[^a-z0-9]+', '-', 'g'), '-')) AS slug, slug IS NULL AS is_new
FROM (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN p_name || 's' WHEN 1 THEN substr(p_name, 2) WHEN 2 THEN replace(p_name, ' ', '-x') ELSE upper(p_name) END AS name FROM part) LEFT JOIN v_entity ON record_id = p_partkey""")
def discovered(spark, sf_dir):
    """Every part's record with the slug of the part that it resolves to, or a new one from its name."""
    records, known = named_parts(spark, sf_dir)
    return resolution.known_or_new(records, resolution.resolve(records, known, measure="edit"))


@query("player_page", """SELECT player_key, player_name, club, base_kpi, score FROM v_players JOIN v_kpi0 USING (player_key) JOIN (SELECT player_key, score FROM v_value) USING (player_key) WHERE player_name LIKE '%1%' AND position = 'BUILDING' ORDER BY score DESC NULLS LAST, player_key LIMIT 20 OFFSET 5""")
def player_page(spark, sf_dir):
    t = D.players(spark, sf_dir).join(kpi_of(spark, sf_dir).select("player_key", "base_kpi"), "player_key").join(valuation_of(spark, sf_dir).select("player_key", "score"), "player_key")
    t = serving.listing(serving.named(t, "1"), {"position": "BUILDING"})
    return serving.page(t, [serving.sort_key("-score"), F.col("player_key")], 5, 20).select("player_key", "player_name", "club", "base_kpi", "score")


@query("player_stats_page", "SELECT player_key, seq, match_date::VARCHAR AS match_date, minutes, goals, xg FROM v_app WHERE player_key = 7 ORDER BY xg NULLS FIRST, seq LIMIT 10")
def player_stats_page(spark, sf_dir):
    t = serving.listing(D.appearances(spark, sf_dir), {"player_key": 7})
    return serving.page(t, [serving.sort_key("xg"), F.col("seq")], 0, 10).select("player_key", "seq", F.col("match_date").cast("string").alias("match_date"), "minutes", "goals", "xg")


@query("transfer_listing", "SELECT player_key, p1, p2, category FROM v_transfer_p WHERE p1 >= 0.5 ORDER BY p1 DESC, player_key LIMIT 50")
def transfer_listing(spark, sf_dir):
    return serving.page(serving.listing(transfer_of(spark, sf_dir), None, {"p1": 0.5}), [F.desc("p1"), F.col("player_key")], 0, 50).select("player_key", "p1", "p2", "category")


@query("compare_players", " UNION ALL ".join(f"""SELECT '{m}' AS metric, max(CASE WHEN player_key = 1 THEN {m}::DOUBLE END) AS first, max(CASE WHEN player_key = 2 THEN {m}::DOUBLE END) AS second,
  CASE WHEN max(CASE WHEN player_key = 1 THEN {m}::DOUBLE END) > max(CASE WHEN player_key = 2 THEN {m}::DOUBLE END) THEN 'first' WHEN max(CASE WHEN player_key = 2 THEN {m}::DOUBLE END) > max(CASE WHEN player_key = 1 THEN {m}::DOUBLE END) THEN 'second' END AS winner FROM v_kpi0""" for m in ("base_kpi", "consistency", "minutes")))
def compare_players(spark, sf_dir):
    return serving.side_by_side(kpi_of(spark, sf_dir), "player_key", 1, 2, ["base_kpi", "consistency", "minutes"])


@query("value_trend", "SELECT user_id, count(*) AS events, round(regr_slope(value, k::DOUBLE), 4) AS slope FROM (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events) GROUP BY user_id HAVING count(*) > 1")
def value_trend(spark, sf_dir):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    t = D.table(spark, sf_dir, "events").select("user_id", "value", F.row_number().over(w).cast("double").alias("k"))
    return t.groupBy("user_id").agg(F.count("*").alias("events"), F.round(F.regr_slope("value", "k"), 4).alias("slope")).filter("events > 1")
