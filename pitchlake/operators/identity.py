"""Upserts where a row may be known by any of several keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pitchlake.sources.shared import cut

Keys = Sequence[Sequence[str]]


def key_texts(keys: Keys) -> Column:
    """array<struct<rank, text>> of the keys of which the row has every column; text: the values, joined."""
    whole = lambda columns: F.forall(F.array(*[F.col(c).isNotNull() for c in columns]), lambda x: x)
    return F.array_compact(F.array(*[F.when(whole(k), F.struct(F.lit(i).alias("rank"), F.concat_ws("|", *[F.col(c).cast("string") for c in k]).alias("text"))) for i, k in enumerate(keys)]))


def _by_key(rows: DataFrame, row: str, keys: Keys) -> DataFrame:
    return rows.select(row, F.explode(key_texts(keys)).alias("k")).select(row, "k.rank", "k.text")


def connected(rows: DataFrame, row: str, keys: Keys) -> DataFrame:
    """(row, first): rows that share a key, directly or through others, have the same `first`, the smallest of their numbers.

    Rows without a key are not in it. Each round gives every key the smallest `first` of its rows and
    every row that of its keys; there are as many rounds as links between the ends of the longest chain.
    Keys and rows meet by equality only, after their smallest values are aggregated.
    """
    by_key = cut(_by_key(rows, row, keys))
    now = cut(by_key.select(row, F.col(row).alias("first")).distinct())
    while True:
        least = by_key.join(now, row).groupBy("rank", "text").agg(F.min("first").alias("least"))
        moved = by_key.join(least, ["rank", "text"]).groupBy(row).agg(F.min("least").alias("least"))
        moved = cut(now.join(moved, row).select(row, F.least("first", "least").alias("first"), (F.col("least") < F.col("first")).alias("changed")))
        now = moved.drop("changed")
        if moved.filter("changed").isEmpty():
            return now


def identified(existing: DataFrame, new: DataFrame, row: str, keys: Keys, id_col: str) -> DataFrame:
    """new with `id` of the existing row that its first known key names, null if none does, and `action`.

    action: update, insert, conflict (its keys name different existing rows) or failed (no key has all
    its columns). Of several existing rows with one key the smallest id counts.
    """
    known = _by_key(existing, id_col, keys).groupBy("rank", "text").agg(F.min(id_col).alias("known"))
    hits = _by_key(new, row, keys).join(known, ["rank", "text"], "left").groupBy(row).agg(F.min(F.when(F.col("known").isNotNull(), F.struct("rank", "known")))["known"].alias("id"), F.count_distinct("known").alias("several"))
    action = F.when(F.col("several").isNull(), "failed").when(F.col("several") > 1, "conflict").when(F.col("several") == 1, "update").otherwise("insert")
    return new.join(hits, row, "left").withColumn("action", action).drop("several")


def upsert_by(existing: DataFrame, new: DataFrame, row: str, keys: Keys, id_col: str) -> tuple[DataFrame, DataFrame]:
    """(the table as it is then, (row, id, action) of every new row).

    existing has id_col, text and each once, and the columns of new but `row`, a number that
    tells new rows apart and in which order they apply. A new row changes the existing row that its
    keys name, or makes one; new rows that share a key make one together, named 'new:' and its first
    key. The last value that is not null counts, else what was stored stays. Conflicts and rows
    without a key change nothing. No new rows leave the table as it was.
    """
    columns = [c for c in existing.columns if c != id_col]
    told = cut(identified(existing, new.select(row, *columns), row, keys, id_col))
    fresh = told.filter("action = 'insert'")
    groups = connected(fresh, row, keys)
    named = _by_key(fresh, row, keys).join(groups, row).groupBy("first").agg(F.concat(F.lit("new:"), F.min(F.struct("rank", "text"))["text"]).alias("name"))
    to = told.join(groups.join(named, "first").select(row, "name"), row, "left").withColumn("id", F.when(F.col("action") == "update", F.col("id")).when(F.col("action") == "insert", F.col("name"))).drop("name")
    to = cut(to)
    last = to.filter("id is not null").groupBy(F.col("id").alias("__id")).agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), F.col(row))).alias(c) for c in columns])
    stored = existing.select(id_col, *[F.col(c).alias(f"__{c}") for c in columns]).join(last, F.col(id_col) == F.col("__id"), "full")
    table = stored.select(F.coalesce(id_col, "__id").alias(id_col), *[F.coalesce(c, f"__{c}").alias(c) for c in columns])
    return table, to.select(row, "id", "action")


def upsert_report(told: DataFrame, entity: str) -> DataFrame:
    """(entity, attempted, inserted, updated, skipped, failed, status) of (id, action) rows; what joins an inserted row is an update of it."""
    n = lambda *a: F.count_if(F.col("action").isin(*a))
    t = told.agg(F.lit(entity).alias("entity"), F.count("*").alias("attempted"), F.count_distinct(F.when(F.col("action") == "insert", F.col("id"))).alias("inserted"), n("update").alias("updates"), n("insert").alias("inserts"), n("conflict").alias("skipped"), n("failed").alias("failed"))
    status = F.when((F.col("failed") > 0) & (F.col("failed") == F.col("attempted")), "validation_failed").when(F.col("failed") + F.col("skipped") > 0, "success_partial").otherwise("success_complete")
    return t.select("entity", "attempted", "inserted", (F.col("updates") + F.col("inserts") - F.col("inserted")).alias("updated"), "skipped", "failed", status.alias("status"))


def error_rows(told: DataFrame, row: str, most: int = 10) -> DataFrame:
    """The first `most` rows that changed nothing, with why."""
    reason = F.when(F.col("action") == "conflict", "keys name different rows").otherwise("no key has all its columns")
    return told.filter(F.col("action").isin("conflict", "failed")).orderBy(row).limit(most).select(row, reason.alias("reason"))


def smallest(rows: DataFrame, by: Sequence[str], most: int, columns: Sequence[str]) -> DataFrame:
    """The first `most` rows by `by`, numbered from 1; a task keeps no more than that many."""
    few = rows.orderBy(*by).limit(most)
    return few.select(F.row_number().over(Window.orderBy(*by)).alias("i"), *columns)
