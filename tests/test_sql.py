"""Queries against their SQL on small tables with rows that the given ones lack: players without appearances."""

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__

DATA = "/root/testdata/sf0.001"
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")


@pytest.fixture(scope="module")
def idle(spark, tmp_path_factory):
    """sf0.001 with ten customers who have no orders, of small, middling and large balances."""
    path = str(tmp_path_factory.mktemp("idle"))
    for name in TABLES:
        t = spark.read.parquet(f"{DATA}/{name}.parquet")
        if name == "customer":
            balance = F.element_at(F.array(*[F.lit(x) for x in (0.2, 200.0, 250.0, 5000.0)]), (F.col("c_custkey") % 4 + 1).cast("int"))
            more = t.filter("c_custkey < 10").withColumn("c_acctbal", balance).withColumn("c_custkey", F.col("c_custkey") + 100_000).withColumn("c_name", F.concat(F.lit("Customer#000"), F.col("c_custkey").cast("string")))
            t = t.unionByName(more)
        t.coalesce(1).write.parquet(f"{path}/{name}.parquet")
    return path


def differences(spark, path, name):
    """Rows of the query that its SQL lacks, and the other way round."""
    rows = __spark_entry__.queries()[name](spark, path)
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}/{t}.parquet/*.parquet')")
    found = [tuple(r) for r in rows.collect()]
    right = con.execute(f"SELECT {', '.join(chr(34) + c + chr(34) for c in rows.columns)} FROM ({__spark_entry__.oracle_sql()[name]})").fetchall()
    return set(found) ^ set(right), len(found) - len(right)


@pytest.mark.parametrize("name", ["valuation", "alerts", "alert_summary", "decision_or_default", "decisions", "distribution_checks", "feature_store", "feature_store_page", "market_value_analytic", "serving_alerts", "potential", "reports"])
def test_players_without_appearances(spark, idle, name):
    assert differences(spark, idle, name) == (set(), 0)
