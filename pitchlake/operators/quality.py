"""Row rules, summaries and readiness of tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Range:
    """Allowed range of a column and, above `odd`, an anomaly."""

    column: str
    low: float
    high: float
    odd: float | None = None


def validate(rows: DataFrame, required: dict[str, float], ranges: tuple[Range, ...], extra: tuple[tuple[Column, str, float, bool], ...] = ()) -> DataFrame:
    """rows with issues, anomalies, confidence (1 less penalties, 0 at least) and valid.

    Missing required columns cost what the dict says, values below a range 0.2, above it 0.15,
    anomalies 0.05. extra: (condition, name, penalty, is an issue).
    """
    checks: list[tuple[Column, str, float, bool]] = [(F.col(c).isNull() | (F.trim(F.col(c).cast("string")) == ""), f"missing_{c}", p, True) for c, p in required.items()]
    for r in ranges:
        v = F.col(r.column)
        checks += [(v < r.low, f"{r.column}_below_range", 0.2, True), (v > r.high, f"{r.column}_above_range", 0.15, True)]
        if r.odd is not None:
            checks.append((v > r.odd, f"{r.column}_unusual", 0.05, False))
    checks += list(extra)
    gather = lambda issue: F.array_compact(F.array(*[F.when(c, F.lit(n)) for c, n, _, i in checks if i is issue], F.lit(None).cast("string")))
    penalty = sum([F.when(c, F.lit(int(round(p * 100)))).otherwise(0) for c, _, p, _ in checks], F.lit(0))
    t = rows.withColumns({"issues": gather(True), "anomalies": gather(False), "confidence": F.greatest(F.lit(0), 100 - penalty) / 100.0})
    return t.withColumn("valid", F.size("issues") == 0)


#: What a player can do in one match, and from where on it is unusual.
STAT_RANGES = (
    Range("goals", 0, 10, 5), Range("assists", 0, 10, 4), Range("minutes", 0, 120, 95), Range("shots", 0, 20, 15), Range("yellow", 0, 2), Range("red", 0, 1),
    Range("passes", 0, 200), Range("xg", 0.0, 5.0, 3.0), Range("xa", 0.0, 5.0), Range("progressive_carries", 0, 50), Range("progressive_passes", 0, 100),
)


def validate_stats(stats: DataFrame, ranges: tuple[Range, ...] = STAT_RANGES) -> DataFrame:
    """validate() with the rules of match rows; ranges of columns that stats does not have are left out."""
    idle = (F.col("minutes") <= 0, "no_minutes", 0.3, True)
    impossible = ((F.col("goals") > 0) & (F.coalesce("minutes", F.lit(0)) <= 0), "goals_without_minutes", 0.1, False)
    return validate(stats, {"player_key": 0.5}, tuple(r for r in ranges if r.column in stats.columns), (idle, impossible))


def type_issues(rows: DataFrame, types: dict[str, str]) -> DataFrame:
    """rows with `type_issues`: <column>_not_<type> for each named column whose text is no value of the type; nulls pass."""
    wrong = [F.when(F.col(c).isNotNull() & F.col(c).cast("string").try_cast(t).isNull(), F.lit(f"{c}_not_{t}")) for c, t in types.items()]
    return rows.withColumn("type_issues", F.array_compact(F.array(*wrong, F.lit(None).cast("string"))))


def validate_profiles(players: DataFrame) -> DataFrame:
    name = F.col("player_name")
    extra = ((F.length(F.trim(name)) < 2, "short_name", 0.2, True), (name.rlike(r"\d{4}"), "digits_in_name", 0.05, False), (F.year("dob") < 1966, "odd_birth_year", 0.05, False))
    return validate(players, {"player_name": 0.5}, (), extra)


def split_valid(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    return rows.filter("valid"), rows.filter("not valid")


def summary(tables: dict[str, DataFrame], keys: dict[str, str], samples: int = 10) -> DataFrame:
    """Per table: rows, valid and invalid ones, anomalies, share valid, the smallest key of an invalid row and the `samples` smallest, joined.

    A task keeps no more than `samples` keys, so that many rows for each task are all that is sent.
    """
    out = None
    for name, t in tables.items():
        k = F.col(keys[name])
        part = t.agg(
            F.lit(name).alias("table"), F.count("*").alias("rows"), F.count_if("valid").alias("valid_rows"), F.count_if(~F.col("valid")).alias("invalid_rows"), F.coalesce(F.sum(F.size("anomalies")), F.lit(0)).alias("anomalies"),
            F.round(F.avg(F.col("valid").cast("int")), 4).alias("share_valid"), F.min(F.when(~F.col("valid"), k)).alias("first_invalid"),
        )
        few = t.filter(~F.col("valid")).select(k.alias("k")).orderBy("k").limit(samples).agg(F.concat_ws(",", F.transform(F.array_sort(F.collect_list("k")), lambda x: x.cast("string"))).alias("samples"))
        part = part.crossJoin(few.select(F.nullif("samples", F.lit("")).alias("samples")))  # one row each
        out = part if out is None else out.unionByName(part)
    return out


def quality_score(tables: list[DataFrame]) -> DataFrame:
    """Valid rows over all rows of all tables; 1 if there are none."""
    flags = None
    for t in tables:
        flags = t.select("valid") if flags is None else flags.unionByName(t.select("valid"))
    return flags.agg(F.coalesce(F.round(F.avg(F.col("valid").cast("int")), 4), F.lit(1.0)).alias("score"), F.count("*").alias("rows"))


def distribution_checks(rows: DataFrame, column: str, key: str, least_rows: int, least_spread: float, least_deviation: float) -> DataFrame:
    """(check, value, status): enough rows, spread and deviation, and no repeated key."""
    t = rows.agg(F.count("*").alias("n"), (F.max(column) - F.min(column)).alias("spread"), F.stddev_samp(column).alias("sd"), (F.count("*") - F.count_distinct(key)).alias("repeats"))
    tests = [("rows", F.col("n").cast("double"), F.col("n") >= least_rows, "FAIL"), ("spread", F.col("spread"), F.col("spread") > least_spread, "WARN"), ("deviation", F.col("sd"), F.col("sd") > least_deviation, "WARN"), ("repeated_keys", F.col("repeats").cast("double"), F.col("repeats") == 0, "FAIL")]
    checks = F.array(*[F.struct(F.lit(n).alias("check"), F.round(v, 3).alias("value"), F.when(ok, "PASS").otherwise(bad).alias("status")) for n, v, ok, bad in tests])
    return t.select(F.explode(checks).alias("c")).select("c.*")


def readiness(spark: SparkSession, sf_dir: str, required: dict[str, tuple[str, ...]]) -> DataFrame:
    """(table, state, rows) for each required table: missing, invalid (columns absent), empty or ready."""
    out = None
    for name, columns in required.items():
        try:
            t = spark.read.parquet(f"{sf_dir}/{name}.parquet")
        except Exception as e:  # the reader's own error says that the path is absent
            if "PATH_NOT_FOUND" not in str(e):
                raise
            part = spark.range(1).select(F.lit(name).alias("table"), F.lit("missing").alias("state"), F.lit(0).cast("long").alias("rows"))
        else:
            if set(columns) - set(t.columns):
                part = t.agg(F.lit(name).alias("table"), F.lit("invalid").alias("state"), F.count("*").alias("rows"))
            else:
                part = t.agg(F.lit(name).alias("table"), F.when(F.count("*") == 0, "empty").otherwise("ready").alias("state"), F.count("*").alias("rows"))
        out = part if out is None else out.unionByName(part)
    return out


def overall(states: DataFrame) -> DataFrame:
    """invalid over missing over empty (all) over partial over ready."""
    t = states.agg(*[F.count_if(F.col("state") == s).alias(s) for s in ("invalid", "missing", "empty", "ready")], F.count("*").alias("n"))
    return t.select(F.when(F.col("invalid") > 0, "invalid").when(F.col("missing") > 0, "missing").when(F.col("empty") == F.col("n"), "empty").when(F.col("empty") > 0, "partial").otherwise("ready").alias("status"))
