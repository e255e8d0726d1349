"""Incremental refresh of per-player tables, as a batch and as a stream."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pitchlake.operators import features
from pitchlake.operators.warehouse import upsert
from pitchlake.streaming.store import BucketTable


def partial(rows: DataFrame, keys: DataFrame, build: Callable[[DataFrame], DataFrame], stored: DataFrame) -> DataFrame:
    """stored with the rows of `keys` built anew from their own input rows only."""
    return upsert(stored, build(rows.join(keys, "player_key", "left_semi")), ["player_key"])


def refresh_totals(stats: DataFrame, stored: DataFrame, keys: DataFrame) -> DataFrame:
    return partial(stats, keys, features.player_totals, stored)


class TotalsStream:
    """Keeps a table of per-player totals up to date while appearance files arrive.

    All rows seen and the totals are bucket tables by player. A batch is appended to the rows of its
    players' buckets, and the totals of these buckets are made anew from them: its cost follows the
    batch and the buckets that it touches, not what was seen before. A batch that runs again finds its
    version in either table and changes nothing there.
    """

    def __init__(self, spark: SparkSession, source: str, work: str, schema, buckets: int = 64):
        self.spark, self.source, self.work, self.schema = spark, source, work, schema
        totals = features.player_totals(spark.createDataFrame([], schema)).schema
        self.seen = BucketTable(spark, f"{work}/seen", "player_key", schema, buckets)
        self.totals = BucketTable(spark, f"{work}/totals", "player_key", totals, buckets)

    def path(self, version: int) -> str:
        """Where the totals of a version are: one path that names the folders of all buckets."""
        inside = ",".join(p.removeprefix(f"{self.work}/totals/") for p in self.totals.paths(version=version))
        return f"{self.work}/totals/{{{inside}}}"

    def current(self) -> DataFrame:
        return self.totals.read()

    def apply(self, batch: DataFrame, batch_id: int) -> None:
        self.seen.append(batch_id, batch)
        if batch_id <= self.totals.version():
            return
        rows = batch.select("player_key").distinct().persist()
        touched = self.totals.touched(rows)
        fresh = features.player_totals(self.seen.read(touched, batch_id).join(rows, "player_key", "left_semi"))
        self.totals.replace(batch_id, upsert(self.totals.read(touched), fresh, ["player_key"]), touched)
        rows.unpersist()

    def run(self, files_per_batch: int = 1) -> int:
        """Processes what has arrived; returns the current version, -1 if there is none."""
        stream = self.spark.readStream.schema(self.schema).option("maxFilesPerTrigger", files_per_batch).parquet(self.source)
        query = stream.writeStream.foreachBatch(self.apply).option("checkpointLocation", f"{self.work}/checkpoint").trigger(availableNow=True).start()
        query.awaitTermination()
        return self.totals.version()


def event_windows(events: DataFrame, size: str = "1 day", late: str = "2 days") -> DataFrame:
    """Events, distinct users' lower bound and value per window and type; the same plan for batch and stream."""
    marked = events.withWatermark("ts", late) if events.isStreaming else events
    return marked.groupBy(F.window("ts", size).alias("w"), "event_type").agg(F.count("*").alias("events"), F.sum(F.col("value").cast("decimal(18,4)")).cast("double").alias("value")).select(F.col("w.start").alias("start"), "event_type", "events", "value")
