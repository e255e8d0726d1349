"""Nested documents written from the tables, read back with unreadable ones among them, exploded and published."""

from __future__ import annotations

from pyspark.sql import functions as F

from pitchlake.operators import features
from pitchlake.plans.registry import VIEWS, once, query
from pitchlake.sources import documents
from pitchlake.sources import driver_views as D
from pitchlake.sources.shared import folder

def _text(c):
    return F.col(c).cast("string")


def _written(docs, spark, broken: bool = True, files: int | None = 3, compression: str = "none") -> str:
    """A folder with so many files of documents (None: as docs are dealt, without a shuffle), a line each, and one file of what is no document."""
    path = folder(spark)
    (docs.repartition(files) if files else docs).write.option("compression", compression).json(path)
    if broken:
        spark.createDataFrame([('{"profile": {"player_name": "cut',), ("[1, 2]",)], "value string").coalesce(1).write.mode("append").text(path)
    return path


def player_documents(spark, sf_dir):
    """A document per player: profile, moves, and seasons, one of them without games."""
    seasons = D.appearances(spark, sf_dir).groupBy("player_key", F.year("match_date").cast("string").alias("season")).agg(
        F.count("*").cast("int").alias("games_played"), *[F.sum(c).cast("int").alias(n) for c, n in (("goals", "goals"), ("assists", "assists"), ("yellow", "yellow_cards"), ("red", "red_cards"), ("minutes", "minutes_played"))]
    )
    fields = ("season", "games_played", "goals", "assists", "yellow_cards", "red_cards", "minutes_played")
    none = F.struct(F.lit("none").alias("season"), *[F.lit(0).alias(c) for c in fields[1:]])
    played = seasons.groupBy("player_key").agg(F.concat(F.array_sort(F.collect_list(F.struct(*fields))), F.array(none)).alias("performance_stats"))
    moves = D.transfers(spark, sf_dir).groupBy("player_key").agg(F.array_sort(F.collect_list(F.struct(F.col("date").cast("string").alias("date"), _text("season").alias("season"), "from_club", "to_club", F.when(F.col("loan"), "loan").otherwise(_text("fee")).alias("fee")))).alias("transfers"))
    profile = F.struct(F.concat(F.lit("  "), F.replace("player_name", F.lit("#"), F.lit("   #"))).alias("player_name"), "position", _text("dob").alias("date_of_birth"), F.col("club").alias("current_club"), F.concat(F.lit("€"), F.round(F.col("market_value") / 1000).cast("long").cast("string"), F.lit("k")).alias("market_value"))
    return D.players(spark, sf_dir).join(played, "player_key", "left").join(moves, "player_key", "left").select(profile.alias("profile"), "transfers", "performance_stats")


def match_documents(spark, sf_dir):
    """A document per match: header, the rows of its players, and their numbers per 90 minutes."""
    stats = D.appearances(spark, sf_dir).join(D.players(spark, sf_dir).select("player_key", "player_name", F.col("club").alias("club_name")), "player_key")
    row = F.struct("player_name", "club_name", *[F.col(c).cast("int").alias(n) for c, n in (("minutes", "minutes"), ("goals", "goals"), ("assists", "assists"), ("yellow", "yellow_cards"), ("red", "red_cards"), ("shots", "shots"), ("passes", "passes_completed"))], "xg")
    per_90 = F.struct("player_name", "club_name", F.create_map(F.lit("goals"), _text("goals"), F.lit("shots"), _text("shots")).alias("metrics"))
    rows = stats.groupBy("seq").agg(F.array_sort(F.collect_list(row)).alias("player_match_stats"), F.collect_list(per_90).alias("player_per_90"))
    match = F.struct(_text("match_id").alias("external_id"), "competition", F.year("match_date").cast("string").alias("season"), _text("match_date").alias("match_date"), "home_club", "away_club", F.col("home_score").cast("int").alias("home_score"), F.col("away_score").cast("int").alias("away_score"))
    return D.matches(spark, sf_dir).join(rows, F.col("match_id") == F.col("seq")).select(match.alias("match"), "player_match_stats", "player_per_90")


@once
def read_players(spark, sf_dir):
    return documents.read_documents(spark, _written(player_documents(spark, sf_dir), spark, files=None, compression="gzip"), documents.PLAYER, lines=True)[0]


@once
def read_matches(spark, sf_dir):
    return documents.read_documents(spark, _written(match_documents(spark, sf_dir), spark, files=None, compression="gzip"), documents.MATCH, lines=True)[0]


@query("doc_players", "SELECT replace(c_name, '#', ' #') AS player_name, c_mktsegment AS position, dob::VARCHAR AS date_of_birth, club AS current_club, round(market_value / 1000.0)::BIGINT * 1000.0::DOUBLE AS market_value_eur FROM v_players JOIN customer ON c_custkey = player_key")
def doc_players(spark, sf_dir):
    return documents.players(read_players(spark, sf_dir)).select("player_name", "position", "date_of_birth", "current_club", "market_value_eur")


@query("doc_transfers", "SELECT player_name, from_club, to_club, CASE WHEN NOT loan THEN round(fee, 2) END AS fee_eur, loan FROM v_transfers JOIN v_players USING (player_key)")
def doc_transfers(spark, sf_dir):
    raw = documents.normalized_transfers(documents.document_transfers(read_players(spark, sf_dir)))
    return raw.select(F.regexp_replace(F.trim("player_name"), r"\s+", "").alias("player_name"), "from_club", "to_club", F.round("fee_eur", 2).alias("fee_eur"), "loan")


@query("doc_season_stats", """SELECT player_name, year(match_date)::VARCHAR AS season, count(*)::INTEGER AS games_played, sum(goals)::INTEGER AS goals, sum(assists)::INTEGER AS assists, sum(minutes)::INTEGER AS minutes_played
FROM v_app JOIN v_players USING (player_key) GROUP BY player_key, player_name, year(match_date)""")
def doc_season_stats(spark, sf_dir):
    """Seasons with games; the document's one without is left out."""
    t = documents.season_stats(read_players(spark, sf_dir))
    return t.select(F.regexp_replace(F.trim("player_name"), r"\s+", "").alias("player_name"), "season", "games_played", "goals", "assists", "minutes_played")


VIEWS["v_match_rows_of"] = "SELECT match_id::VARCHAR AS external_id, m.match_date::VARCHAR AS match_date, m.competition, player_name, p.club AS club_name, minutes::INTEGER AS minutes, goals::INTEGER AS goals, shots::INTEGER AS shots, xg FROM v_matches m JOIN v_app a ON a.seq = m.match_id JOIN v_players p ON a.player_key = p.player_key"


@query("doc_match_stats", "SELECT external_id, match_date, competition, player_name, club_name, minutes, goals, xg FROM v_match_rows_of")
def doc_match_stats(spark, sf_dir):
    return documents.match_stats(read_matches(spark, sf_dir)).select("external_id", "match_date", "competition", "player_name", "club_name", "minutes", "goals", "xg")


@query("doc_per_90", "SELECT external_id, player_name, 'goals' AS metric, goals::VARCHAR AS value FROM v_match_rows_of UNION ALL SELECT external_id, player_name, 'shots', shots::VARCHAR FROM v_match_rows_of")
def doc_per_90(spark, sf_dir):
    return documents.match_per_90(read_matches(spark, sf_dir)).select("external_id", "player_name", F.explode("metrics").alias("metric", "value"))


@query("doc_union", """SELECT 'match' AS kind, count(*) AS rows, count(xg) AS with_xg, 0 AS with_rating, sum(minutes)::BIGINT AS minutes FROM v_match_rows_of
UNION ALL SELECT 'other', count(*), 0, count(*) FILTER (seq % 2 = 0), NULL FROM v_app""")
def doc_union(spark, sf_dir):
    """Rows of the match documents and of a source with another set of columns."""
    other = D.appearances(spark, sf_dir).select(F.lit("other").alias("kind"), _text("seq").alias("external_id"), F.when(F.col("seq") % 2 == 0, F.col("goals") / 2).alias("rating"))
    every = documents.union_stats(documents.match_stats(read_matches(spark, sf_dir)).withColumn("kind", F.lit("match")), other)
    return every.groupBy("kind").agg(F.count("*").alias("rows"), F.count("xg").alias("with_xg"), F.count("rating").cast("int").alias("with_rating"), F.sum("minutes").alias("minutes"))


@query("doc_inventory", "SELECT 'players' AS source, 'json' AS type, 3 AS files, TRUE AS with_bytes FROM (SELECT 1 FROM customer LIMIT 1) UNION ALL SELECT 'players', 'txt', 1, TRUE")
def doc_inventory(spark, sf_dir):
    """What files the players' documents came in, by kind."""
    t = documents.inventory(spark, _written(player_documents(spark, sf_dir), spark), "players").filter("type in ('json', 'txt')")
    return t.groupBy("source", "type").agg(F.count("*").cast("int").alias("files"), (F.min("bytes") > 0).alias("with_bytes"))


@query("doc_unreadable", "SELECT count(*) + 2 AS lines, count(*) AS documents, 2::BIGINT AS unreadable FROM v_players")
def doc_unreadable(spark, sf_dir):
    good, bad = documents.read_documents(spark, _written(player_documents(spark, sf_dir), spark), documents.PLAYER, lines=True)
    n = good.agg(F.count("*").alias("documents")).crossJoin(bad.agg(F.count("*").alias("unreadable")))  # one row each
    return n.select((F.col("documents") + F.col("unreadable")).alias("lines"), "documents", "unreadable")


@query("doc_publish", "SELECT 'transfers' AS name, count(*) AS rows, 'published' AS state FROM v_transfers UNION ALL SELECT 'transfer_features', count(DISTINCT player_key), 'published' FROM v_transfers")
def doc_publish(spark, sf_dir):
    """Transfers from the documents and the features of each player's: both are published, or neither."""
    parts = {"transfers": documents.normalized_transfers(documents.document_transfers(read_players(spark, sf_dir))), "transfer_features": features.transfer_features(D.transfers(spark, sf_dir))}
    return documents.publish(parts, folder(spark))
