"""Nested source documents: reading, exploding, inventory, verified writing."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pitchlake.functions import exprs as X

_S, _I, _D = T.StringType(), T.IntegerType(), T.DoubleType()


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


PLAYER = _struct(
    profile=_struct(**dict.fromkeys(("tm_id", "player_name", "preferred_name", "date_of_birth", "nationality", "height", "position", "foot", "current_club", "contract_expires", "market_value", "source", "source_url"), _S), age=_I, market_value_eur=_D),
    transfers=T.ArrayType(_struct(**dict.fromkeys(("season", "date", "from_club", "to_club", "market_value", "fee", "source_url"), _S))),
    mv_history=T.ArrayType(_struct(date=_S, value_eur=T.LongType(), value_str=_S, club=_S, age=_S)),
    performance_stats=T.ArrayType(_struct(competition=_S, season=_S, games_played=_I, goals=_I, assists=_I, yellow_cards=_I, red_cards=_I, minutes_played=_I)),
)
MATCH = _struct(
    match=_struct(**dict.fromkeys(("external_id", "competition", "season", "match_date", "home_club", "away_club", "venue", "source_url"), _S), home_score=_I, away_score=_I),
    player_match_stats=T.ArrayType(_struct(player_name=_S, club_name=_S, minutes=_I, goals=_I, assists=_I, yellow_cards=_I, red_cards=_I, shots=_I, passes_completed=_I, xg=_D, xa=_D)),
    player_per_90=T.ArrayType(_struct(player_name=_S, club_name=_S, metrics=T.MapType(_S, _S))),
)


def read_documents(spark: SparkSession, path: str, schema: T.StructType, lines: bool = False) -> tuple[DataFrame, DataFrame]:
    """(documents with their file, files of the unreadable ones). One JSON object per file, or per line.

    Millions of documents want lines: a file for each is a task's worth of listing and opening.
    """
    read = spark.read.schema(T.StructType([*schema.fields, T.StructField("_corrupt", _S)])).option("multiLine", not lines).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").json(path)
    t = read.select("*", F.col("_metadata.file_path").alias("file"))
    empty = F.lit(True)
    for f in schema.fields:
        empty = empty & F.col(f.name).isNull()
    bad = F.col("_corrupt").isNotNull() | empty
    return t.filter(~bad).drop("_corrupt"), t.filter(bad).select("file")


def players(docs: DataFrame) -> DataFrame:
    t = docs.select("file", "profile.*")
    return t.select("file", *[X.clean_text(c).alias(c) for c in ("player_name", "position", "date_of_birth", "nationality", "current_club", "market_value", "source", "source_url")], F.coalesce("market_value_eur", X.money("market_value")).alias("market_value_eur"), "age")


def document_transfers(docs: DataFrame) -> DataFrame:
    return docs.select("file", F.col("profile.player_name").alias("player_name"), F.posexplode("transfers").alias("pos", "t")).select("file", "pos", "player_name", "t.*")


def normalized_transfers(raw: DataFrame) -> DataFrame:
    """Clean names, the fee in EUR, and whether it is a loan."""
    text = F.lower(F.coalesce("fee", F.lit("")))
    loan = text.contains("loan")
    return raw.select("player_name", X.clean_text("from_club").alias("from_club"), X.clean_text("to_club").alias("to_club"), X.money("fee").alias("fee_eur"), "season", F.when(loan, "loan").otherwise("permanent").alias("transfer_type"), loan.alias("loan"))


def season_stats(docs: DataFrame) -> DataFrame:
    """Season aggregates with at least one game."""
    return docs.select("file", F.col("profile.player_name").alias("player_name"), F.posexplode("performance_stats").alias("pos", "s")).select("file", "pos", "player_name", "s.*").filter("games_played > 0")


def value_history(docs: DataFrame) -> DataFrame:
    return docs.select("file", F.col("profile.player_name").alias("player_name"), F.posexplode("mv_history").alias("pos", "h")).select("file", "pos", "player_name", F.to_date("h.date").alias("date"), "h.value_eur", "h.club", F.col("h.age").try_cast("int").alias("age"))


def matches(docs: DataFrame) -> DataFrame:
    return docs.select("file", "match.*")


def match_stats(docs: DataFrame) -> DataFrame:
    """Stat rows with their match's id, date and competition."""
    m = [F.col(f"match.{c}").alias(c) for c in ("external_id", "match_date", "competition")]
    return docs.select("file", *m, F.posexplode("player_match_stats").alias("pos", "s")).select("file", "pos", "external_id", "match_date", "competition", "s.*")


def match_per_90(docs: DataFrame) -> DataFrame:
    return docs.select("file", F.col("match.external_id").alias("external_id"), F.posexplode("player_per_90").alias("pos", "s")).select("file", "pos", "external_id", "s.*")


def union_stats(*parts: DataFrame) -> DataFrame:
    """Rows of all sources, with whatever columns they have."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def inventory(spark: SparkSession, path: str, source: str) -> DataFrame:
    """(source, type, slug, bytes, captured_at) of every file; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "modificationTime", "length")
    return files.select(F.lit(source).alias("source"), F.regexp_extract("path", r"\.([^./]+)$", 1).alias("type"), F.regexp_extract("path", r"([^/]+)\.[^./]+$", 1).alias("slug"), F.col("length").alias("bytes"), F.col("modificationTime").alias("captured_at"))


def write_verified(df: DataFrame, path: str) -> int:
    """Writes Parquet and compares what was written with what can be read; raises if they differ."""
    observed = Observation("written")
    df.observe(observed, F.count(F.lit(1)).alias("n")).write.mode("overwrite").parquet(path)
    n = observed.get["n"]
    found = df.sparkSession.read.schema(df.schema).parquet(path).count()
    if n != found:
        raise ValueError(f"{path}: {n} rows were written, {found} can be read")
    return found


def publish(tables: dict[str, DataFrame], path: str) -> DataFrame:
    """(name, rows, state) of tables that are published together: all of them, or, if one fails, none.

    Each is written and verified under path/staged; only when all are is path/published written, which
    names them, and which readers go by.
    """
    spark = next(iter(tables.values())).sparkSession
    done, failed = [], False
    for name, t in tables.items():
        try:
            done.append((name, write_verified(t, f"{path}/staged/{name}")))
        except ValueError:  # what was read back differs
            done.append((name, -1))
            failed = True
    state = "withheld" if failed else "published"
    report = spark.createDataFrame([(name, n, state) for name, n in done], "name string, rows long, state string")
    if not failed:
        report.coalesce(1).write.mode("overwrite").parquet(f"{path}/published")
    return report


def published(spark: SparkSession, path: str, name: str) -> DataFrame:
    """A table that was published under path; an error if it was not."""
    if not spark.read.parquet(f"{path}/published").filter(F.col("name") == name).count():
        raise ValueError(f"{name} is not published in {path}")
    return spark.read.parquet(f"{path}/staged/{name}")


def registry(parts: list[tuple[int, DataFrame]], key: str, prefix: str) -> DataFrame:
    """Union of registries (key, url): of one key the highest priority stays; a missing url is built from the key."""
    every = None
    for priority, p in parts:
        t = p.select(key, "url").withColumn("priority", F.lit(priority))
        every = t if every is None else every.unionByName(t)
    best = every.groupBy(key).agg(F.max_by("url", F.struct("priority", F.coalesce("url", F.lit("")))).alias("url"))
    return best.select(key, F.coalesce("url", F.concat(F.lit(prefix), F.col(key).cast("string"))).alias("url"))
