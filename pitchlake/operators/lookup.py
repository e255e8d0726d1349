"""Ordered substring lookups, done on distinct values only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def ordered_lookup(rows: DataFrame, column: str, rules: DataFrame, out: str, default: object = None) -> DataFrame:
    """rows with `out`: the value of the rule that equals the column, else of the first that it contains.

    rules (ord, key, value) is a dimension of fixed size. The distinct values of the column are
    matched against it, and the answer is joined back by equality.
    """
    text = F.lower(F.trim(F.col(column)))
    values = rows.select(text.alias("__v")).filter("__v is not null and __v <> ''").distinct()
    met = values.join(F.broadcast(rules.select("ord", F.lower("key").alias("__k"), "value")), F.col("__v").contains(F.col("__k")))
    best = met.groupBy("__v").agg(F.min_by("value", F.struct(F.col("__v") != F.col("__k"), F.col("ord"))).alias(out))
    joined = rows.withColumn("__t", text).join(best, F.col("__t") == F.col("__v"), "left").drop("__t", "__v")
    return joined if default is None else joined.withColumn(out, F.coalesce(out, F.lit(default)))


def across_leagues(rows: DataFrame, stat: str, coefficient: str, out: str, baseline: float = 5.0) -> DataFrame:
    """The stat at a baseline league: weaker leagues count for more; unchanged where the coefficient is not positive."""
    c = F.col(coefficient)
    return rows.withColumn(out, F.round(F.when(c > 0, F.col(stat) * baseline / F.greatest(c, F.lit(1.0))).otherwise(F.col(stat)), 3))
