"""Filtered, sorted and paged reads over tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pitchlake.functions import exprs as X


def page(rows: DataFrame, order: list[Column], offset: int, limit: int) -> DataFrame:
    """`limit` rows behind `offset`; the order must end in a key."""
    return rows.orderBy(*order).offset(offset).limit(limit)


def page_with_total(rows: DataFrame, order: list[Column], offset: int, limit: int) -> tuple[DataFrame, int]:
    return page(rows, order, offset, limit), rows.count()


def sort_key(name: str) -> Column:
    """'-column' descends; nulls are smallest."""
    return F.col(name[1:]).desc_nulls_last() if name.startswith("-") else F.col(name).asc_nulls_first()


def named(rows: DataFrame, text: str, column: str = "player_name") -> DataFrame:
    """Rows whose folded name holds the folded text."""
    return rows.filter(X.fold(column).contains(X.fold(F.lit(text))))


def listing(rows: DataFrame, equal: dict[str, object] | None = None, least: dict[str, float] | None = None) -> DataFrame:
    for c, v in (equal or {}).items():
        if v is not None:
            rows = rows.filter(F.col(c) == v)
    for c, v in (least or {}).items():
        if v is not None:
            rows = rows.filter(F.col(c) >= v)
    return rows


def first_named(rows: DataFrame, text: str, order: list[Column]) -> DataFrame:
    return named(rows, text).orderBy(*order).limit(1)


def side_by_side(rows: DataFrame, key: str, one: object, other: object, metrics: list[str]) -> DataFrame:
    """(metric, first, second, winner) of two rows; equal values have no winner."""
    value = lambda k, m: F.max(F.when(F.col(key) == k, F.col(m).cast("double")))
    t = rows.filter(F.col(key).isin([one, other])).agg(F.array(*[F.struct(F.lit(m).alias("metric"), value(one, m).alias("first"), value(other, m).alias("second")) for m in metrics]).alias("a"))
    t = t.select(F.explode("a").alias("a")).select("a.*")
    return t.withColumn("winner", F.when(F.col("first") > F.col("second"), "first").when(F.col("second") > F.col("first"), "second"))


def neighbours_of(asked: DataFrame, players: DataFrame, vectors: DataFrame, near: DataFrame, limit: int) -> DataFrame:
    """(player_key, state, rank, other, distance): the first `limit` stored neighbours of each player that is asked for.

    state is 'unknown' for keys that players does not have, 'no_vector' for players without one,
    else 'ok'; without neighbours there is one row, of nulls.
    """
    mark = lambda t, c: t.select("player_key", F.lit(True).alias(c)).distinct()
    t = asked.distinct().join(mark(players, "__known"), "player_key", "left").join(mark(vectors, "__vector"), "player_key", "left")
    t = t.join(near.filter(F.col("rank") <= limit).withColumnRenamed("key", "player_key"), "player_key", "left")
    state = F.when(F.col("__known").isNull(), "unknown").when(F.col("__vector").isNull(), "no_vector").otherwise("ok")
    return t.select("player_key", state.alias("state"), "rank", "other", "distance")


def enriched(rows: DataFrame, lookup: DataFrame, key: str, add: list[str], fill: list[str]) -> DataFrame:
    """rows left-joined with lookup (one row for each key): the columns `add`, and `fill` where rows have null or nothing."""
    known = lookup.select(F.col(key).alias("__key"), *[F.col(c).alias(f"__{c}") for c in (*add, *fill)])
    filled = {c: F.coalesce(F.nullif(F.col(c), F.lit("")), F.col(f"__{c}"), F.col(c)) for c in fill}
    t = rows.join(known, F.col(key) == F.col("__key"), "left")
    return t.withColumns({**filled, **{c: F.col(f"__{c}") for c in add}}).select(*rows.columns, *add)


def stored_or_made(keys: DataFrame, stored: DataFrame, made: DataFrame, column: str) -> DataFrame:
    """keys (player_key) with `column` as stored, else as made, and where it is from; nothing for keys without either."""
    t = keys.join(stored.select("player_key", F.col(column).alias("__stored")), "player_key", "left").join(made.select("player_key", F.col(column).alias("__made")), "player_key", "left")
    return t.select("player_key", F.coalesce("__stored", "__made").alias(column), F.when(F.col("__stored").isNotNull(), "stored").otherwise("generated").alias("origin")).filter(F.col(column).isNotNull())
