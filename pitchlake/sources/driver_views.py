"""The benchmark's star-schema tables seen as players, matches, appearances and transfers.

Customers are players, nations clubs, regions leagues, orders matches and their lines what a
player did in them. The keys are numbers here; operators only ask for equality of player_key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: "Today" of every age and freshness rule over these tables.
REFERENCE_DATE = "2002-01-01"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def appearances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per player and match: what SURVEY calls player_match_stats."""
    orders, lines = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    done = lines.groupBy("l_orderkey").agg(
        (F.sum("l_quantity").cast("long") % 96).alias("minutes"),
        F.count_if((F.col("l_returnflag") == "R") & (F.col("l_linestatus") == "F")).alias("goals"),
        F.count_if((F.col("l_returnflag") == "A") & (F.col("l_linestatus") == "F")).alias("assists"),
        F.count("*").alias("shots"),
        F.sum("l_linenumber").cast("long").alias("passes"),
        F.count_if(F.col("l_discount") >= 0.09).alias("yellow"),
        F.count_if(F.col("l_tax") >= 0.08).alias("red"),
        F.sum(F.round(F.col("l_tax") * 100).cast("long")).alias("xg100"),
    )
    return orders.join(done, F.col("o_orderkey") == F.col("l_orderkey")).select(
        F.col("o_custkey").alias("player_key"),
        F.col("o_orderkey").alias("seq"),
        F.to_date("o_orderdate").alias("match_date"),
        F.col("o_orderpriority").alias("competition"),
        F.col("o_orderstatus").alias("source"),
        "minutes", "goals", "assists", "shots", "passes", "yellow", "red",
        F.when(F.col("o_orderstatus") != "P", F.col("xg100") / 100.0).alias("xg"),
    )


def players(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer, nation = table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation")
    return customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey"), "left").select(
        F.col("c_custkey").alias("player_key"),
        F.col("c_name").alias("player_name"),
        F.col("c_mktsegment").alias("position"),
        F.col("n_name").alias("club"),
        F.date_add(F.lit("1965-01-01").cast("date"), (F.col("c_custkey") * 37 % 7665).cast("int")).alias("dob"),
        F.round(F.abs("c_acctbal") * 1000, 2).alias("market_value"),
    )


def matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per order with lines: home is the customer's nation, away that of the first line's supplier."""
    orders, lines, customer, supplier, nation = (table(spark, sf_dir, n) for n in ("orders", "lineitem", "customer", "supplier", "nation"))
    score = lines.groupBy("l_orderkey").agg(
        F.min(F.struct("l_linenumber", "l_suppkey"))["l_suppkey"].alias("away_supp"),
        F.count_if(F.col("l_returnflag") == "R").alias("home_score"),
        F.count_if(F.col("l_returnflag") == "A").alias("away_score"),
    )
    home, away = nation.select(F.col("n_nationkey").alias("hk"), F.col("n_name").alias("home_club")), nation.select(F.col("n_nationkey").alias("ak"), F.col("n_name").alias("away_club"))
    return (
        orders.join(score, F.col("o_orderkey") == F.col("l_orderkey"))
        .join(customer.select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"), "left")
        .join(supplier.select("s_suppkey", "s_nationkey"), F.col("away_supp") == F.col("s_suppkey"), "left")
        .join(home, F.col("c_nationkey") == F.col("hk"), "left")
        .join(away, F.col("s_nationkey") == F.col("ak"), "left")
        .select(
            F.col("o_orderkey").alias("match_id"), F.to_date("o_orderdate").alias("match_date"), F.col("o_orderpriority").alias("competition"),
            "home_club", "away_club", "home_score", "away_score",
        )
    )


def transfers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per order line: from the customer's nation to the supplier's."""
    orders, lines, customer, supplier, nation = (table(spark, sf_dir, n) for n in ("orders", "lineitem", "customer", "supplier", "nation"))
    src, dst = nation.select(F.col("n_nationkey").alias("hk"), F.col("n_name").alias("from_club")), nation.select(F.col("n_nationkey").alias("ak"), F.col("n_name").alias("to_club"))
    return (
        lines.join(orders.select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
        .join(customer.select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
        .join(supplier.select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))
        .join(F.broadcast(src), F.col("c_nationkey") == F.col("hk"))
        .join(F.broadcast(dst), F.col("s_nationkey") == F.col("ak"))
        .select(
            F.col("o_custkey").alias("player_key"), F.to_date("l_shipdate").alias("date"), F.year("l_shipdate").alias("season"), "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
            "from_club", "to_club", F.col("l_extendedprice").alias("fee"), (F.col("l_returnflag") == "N").alias("loan"),
        )
    )


def leagues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(league, ord, prestige) for each region; a dimension of fixed size."""
    return table(spark, sf_dir, "region").select(F.col("r_name").alias("league"), F.col("r_regionkey").alias("ord"), ((F.col("r_regionkey") + 1) / 6.0).alias("prestige"))


def clubs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(club, league, ord, prestige, ...) for each nation; a dimension of fixed size."""
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    k = F.col("n_nationkey")
    return nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(
        F.col("n_name").alias("club"), F.col("r_name").alias("league"), k.alias("ord"), ((k + 1) / 26.0).alias("prestige"),
        (k % 5 + 17).alias("buy_age_low"), (k % 5 + 23).alias("buy_age_high"), ((k % 7 + 1) * 1000000.0).alias("spend"), (k % 10 / 10.0).alias("pathway_score"),
        (0.5 + k % 4 / 10.0).alias("pressing"), (0.5 + k % 5 / 10.0).alias("physical"), (0.5 + k % 3 / 10.0).alias("technical"),
    )
