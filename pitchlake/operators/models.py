"""Clusters and learned models on pyspark.ml."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import Bucketizer, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pitchlake.functions import exprs as X
from pitchlake.sources.shared import cut


def k_means(rows: DataFrame, columns: list[str], k: int = 5, seed: int = 42, rounds: int = 100) -> DataFrame:
    """rows with `cluster`; with at most k rows each is its own cluster."""
    if rows.count() <= k:
        return rows.withColumn("cluster", (F.row_number().over(Window.orderBy(*columns)) - 1).cast("int"))
    stages = [VectorAssembler(inputCols=columns, outputCol="__v"), KMeans(featuresCol="__v", predictionCol="cluster", k=k, seed=seed, maxIter=rounds)]
    return Pipeline(stages=stages).fit(rows).transform(rows).drop("__v")


#: The features of player clusters with the ranges that scale them, clusters, rounds, and what the clusters are called.
CLUSTER_RANGES = {"goals_per_90": (0.0, 1.2), "assists_per_90": (0.0, 0.8), "shots_per_90": (0.0, 6.0), "passes_per_90": (0.0, 80.0), "xg_per_90": (0.0, 0.8), "xa_per_90": (0.0, 0.5), "minutes": (0.0, 3000.0), "age": (15.0, 38.0)}
CLUSTERS, CLUSTER_ROUNDS, CLUSTER_SEED, DEFAULT_AGE = 5, 100, 42, 22
ARCHETYPES = ("clinical_striker", "playmaker", "engine", "wide_creator", "defensive_anchor")
_UNITS = 1_000_000


def in_ranges(rows: DataFrame, ranges: dict[str, tuple[float, float]] = CLUSTER_RANGES) -> Column:
    """array<bigint>: each column within its range, as millionths of it; null and 0 count as 0, an age as DEFAULT_AGE."""
    value = lambda c: X.or_default(c, DEFAULT_AGE if c == "age" else 0.0).cast("double")
    return F.array(*[F.round(X.clamp((value(c) - low) / (high - low), 0, 1) * _UNITS).cast("long") for c, (low, high) in ranges.items()])


def _drawn(seed: int, step: int, key: str) -> Column:
    """A number above 0 and up to 1, from a hash of seed, step and key."""
    return (F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.lit(str(step)), F.col(key).cast("string"))), 1, 13), 16, 10).cast("double") + 1.0) / float(1 << 52)


def _apart(v: str, centre: list[int]) -> Column:
    out = F.lit(0).cast("long")
    for i, c in enumerate(centre):
        out = out + (F.get(F.col(v), F.lit(i)) - F.lit(int(c))) * (F.get(F.col(v), F.lit(i)) - F.lit(int(c)))
    return out


def first_centres(rows: DataFrame, k: int, key: str = "key", v: str = "v", seed: int = CLUSTER_SEED) -> list[list[int]]:
    """k vectors of rows, each drawn with a chance in proportion to the squared distance from the nearest before it.

    A row's draw u is a hash, and the row of the smallest -ln(u) / distance is taken: that draws by
    weight, in one pass whose answer does not depend on the rows' order. Where all distances are 0
    the smallest u is.
    """
    centres: list[list[int]] = []
    for step in range(k):
        u = _drawn(seed, step, key)
        least = F.least(*[_apart(v, c) for c in centres]) if len(centres) > 1 else _apart(v, centres[0]) if centres else F.lit(1).cast("long")
        race = F.when(least > 0, -F.log(u) / least).otherwise(float("inf"))
        centres.append(list(rows.agg(F.min(F.struct(race.alias("race"), u.alias("u"), F.col(key), F.col(v).alias("v")))["v"]).head()[0]))
    return centres


def _nearest(centres: list[list[int]], v: str) -> Column:
    """The number of the nearest centre, the smaller one of equally near ones."""
    return F.array_min(F.array(*[F.struct(_apart(v, c).alias("d"), F.lit(j).alias("j")) for j, c in enumerate(centres)]))["j"]


def seeded_clusters(rows: DataFrame, k: int = CLUSTERS, rounds: int = CLUSTER_ROUNDS, key: str = "key", v: str = "v", seed: int = CLUSTER_SEED) -> tuple[DataFrame, list[list[int]]]:
    """((key, cluster), centres) of rows of whole-number vectors: drawn centres, then rounds until none moves.

    A centre moves to its rows' mean, rounded half up to whole numbers; empty ones stay. Keys are
    whole and each once. With at most k rows each is its own cluster, by key. A round is one pass
    over the rows, of which k rows reach the driver.
    """
    rows = cut(rows.select(key, v))
    n = rows.count()
    if n <= k:
        own = rows.select(key, (F.row_number().over(Window.orderBy(key)) - 1).cast("int").alias("cluster"))  # at most k rows
        return own, [list(r[0]) for r in rows.orderBy(key).select(v).collect()]
    centres = first_centres(rows, k, key, v, seed)
    size = len(centres[0])
    for _ in range(rounds):
        sums = rows.groupBy(_nearest(centres, v).alias("j")).agg(F.count("*").alias("n"), *[F.sum(F.get(F.col(v), F.lit(i)).cast("decimal(38,0)")).alias(f"s{i}") for i in range(size)]).collect()
        moved = list(centres)
        for r in sums:
            moved[r["j"]] = [(2 * int(r[f"s{i}"]) + r["n"]) // (2 * r["n"]) for i in range(size)]
        if moved == centres:
            break
        centres = moved
    return rows.select(key, _nearest(centres, v).cast("int").alias("cluster")), centres


def lloyd(rows: DataFrame, key: str, v: str, centers: DataFrame, rounds: int) -> DataFrame:
    """(key, cluster, distance) after `rounds` rounds from given (cluster, c) centers.

    Squared distances are rounded to six digits and ties go to the smaller cluster; the centers,
    k rows, are broadcast in each round.
    """
    for step in range(rounds + 1):
        sq = F.round(F.aggregate(F.zip_with(F.col(v), F.col("c"), lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x), 6)
        near = rows.crossJoin(F.broadcast(centers)).groupBy(key).agg(F.min(F.struct(sq.alias("d"), "cluster")).alias("m"))
        near = near.select(key, F.col("m.cluster").alias("cluster"), F.col("m.d").alias("distance"))
        if step == rounds:
            return near
        long = near.join(rows, key).select("cluster", F.posexplode(v).alias("i", "x"))
        mean = long.groupBy("cluster", "i").agg(F.round(F.avg(F.col("x").cast("double")), 6).alias("x"))
        centers = mean.groupBy("cluster").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda p: p["x"]).alias("c"))
    return near


def cluster_profile(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Size, centroid and dominant column of each cluster."""
    t = rows.groupBy("cluster").agg(F.count("*").alias("size"), *[F.round(F.avg(c), 4).alias(c) for c in columns])
    values = F.array(*columns)
    return t.withColumn("label", F.element_at(F.array(*[F.lit(c) for c in columns]), F.array_position(values, F.array_max(values)).cast("int")))


def training_set(spells: DataFrame, prestige: DataFrame) -> DataFrame:
    """One sample per spell: middle age, 40 + 60 * peak / career peak, prestige, direction, log10 of the peak.

    The chance of a move and the share of minutes are not known of past spells: a proxy by age,
    prestige and direction, and a constant.
    """
    career = spells.groupBy("player_key").agg(F.max("peak").alias("career_peak"))
    t = spells.join(career, "player_key").join(F.broadcast(prestige.select("club", "prestige")), "club", "left").filter("peak > 0")
    t = t.select(
        "player_key", "spell", F.coalesce(F.col("mid_age").cast("double"), F.lit(23.0)).alias("age"), F.round(40 + 60 * F.col("peak") / F.col("career_peak"), 4).alias("score"), F.round(F.coalesce("prestige", F.lit(0.4)), 4).alias("prestige"),
        F.when(F.col("change") > 0.1, 1.0).when(F.col("change") < -0.1, 0.0).otherwise(0.5).alias("trajectory"), F.round(F.log10("peak"), 4).alias("label"),
    )
    likely = F.when((F.col("age") <= 24) & (F.col("prestige") < 0.60) & (F.col("trajectory") >= 0.5), 0.70).when(F.col("age") <= 27, 0.50).otherwise(0.30)
    return t.withColumns({"p1": likely, "minutes_ratio": F.lit(0.85)})


#: The bins that trees tell values of a column apart by (Spark's own number), and the lots of alike rows.
BINS, LOTS = 32, 8


def bins_of(samples: DataFrame, columns: list[str]) -> Bucketizer:
    """Each column in BINS bins at most: every value its own if there are so few, else between quantiles over all rows."""
    values = [F.col(c).cast("double") for c in columns]
    shape = samples.agg(*[F.approx_count_distinct(v) for v in values], *[F.percentile_approx(v, [i / BINS for i in range(1, BINS)], 10_000) for v in values]).head()
    splits = []
    for i, c in enumerate(columns):
        cuts = shape[len(columns) + i] or []
        if shape[i] <= 2 * BINS:
            every = sorted(r[0] for r in samples.select(values[i].alias(c)).filter(F.col(c).isNotNull()).distinct().limit(4 * BINS).collect())
            cuts = every[1:] if len(every) <= BINS else cuts
        splits.append([float("-inf"), *sorted(set(cuts)), float("inf")])
        if len(splits[-1]) < 3:
            splits[-1].insert(1, 0.0)  # a bucketizer wants two buckets at least
    return Bucketizer(inputCols=columns, outputCols=[f"__bin_{c}" for c in columns], splitsArray=splits, handleInvalid="keep")


def alike(samples: DataFrame, bins: Bucketizer, by: list[Column]) -> DataFrame:
    """Rows of the same bins and the same `by` as one: its columns' smallest values, mean label, its square's and the number of rows as weight.

    Trees see bins only, and a mean with its weight gives the gradients' sums that its rows give.
    """
    t = bins.transform(samples.withColumn("label", F.col("label").cast("double")))
    return t.groupBy(*bins.getOutputCols(), *by).agg(*[F.min(c).alias(c) for c in bins.getInputCols()], F.avg("label").alias("label"), F.avg(F.col("label") * F.col("label")).alias("label2"), F.count("*").cast("double").alias("weight")).drop(*bins.getOutputCols())


def _lot(samples: DataFrame) -> Column:
    return F.pmod(F.xxhash64(*sorted(samples.columns)), F.lit(LOTS)).alias("lot")


def log_error(model: PipelineModel, samples: DataFrame) -> float:
    """Root of the mean squared error of the predicted log10, which is the width of the interval; 0.35 without samples.

    Rows of the same bins have one prediction, which is made once.
    """
    t = model.transform(alike(samples, model.stages[0], []))
    square = F.col("label2") - 2 * F.col("label") * F.col("prediction") + F.col("prediction") * F.col("prediction")
    found = t.agg(F.sqrt(F.greatest(F.sum(square * F.col("weight")) / F.sum("weight"), F.lit(0.0))), F.count("*")).head()
    return float(found[0]) if found[1] else 0.35


def value_confidence(data: Column, market: Column, second_source: Column) -> Column:
    """Confidence in the data (0.70 if unknown) and what a stated value and a second source add, 1 at most."""
    return F.round(F.least(F.lit(1.0), X.or_default(data, 0.70) + F.when(market > 0, 0.15).otherwise(0.0) + F.when(second_source, 0.10).otherwise(0.0)), 4)


def interval(value: Column, error: float, data: Column) -> tuple[Column, Column]:
    """(low, high) around a value: the model's error in log10, up to half as much again where the data are not trusted."""
    width = F.lit(error) * (1.0 + (1.0 - X.or_default(data, 0.70)) * 0.5)
    return F.round(value * F.pow(F.lit(10.0), -width), 0), F.round(value * F.pow(F.lit(10.0), width), 0)


def _fit(samples: DataFrame, columns: list[str], trees, by: list[Column]) -> PipelineModel:
    """Standardized bins of the columns and boosted trees, over all rows, those alike as one with its weight.

    A tree draws its rows by lots: those of the same bins in one of LOTS, by a hash of the row. So the
    table that trees are grown on grows with the bins that are met, not with the rows.
    """
    bins = bins_of(samples, [c for c in columns if c in samples.columns])
    rows = cut(alike(samples, bins, [*by, _lot(samples)]))
    stages = [bins, VectorAssembler(inputCols=[f"__bin_{c}" for c in columns], outputCol="raw", handleInvalid="keep"), StandardScaler(inputCol="raw", outputCol="features", withMean=True), trees]
    return Pipeline(stages=stages).fit(rows)


def fit_value_model(samples: DataFrame, columns: list[str], trees: int = 300, seed: int = 42) -> PipelineModel:
    """Standardized features and boosted regression trees."""
    return _fit(samples, columns, GBTRegressor(featuresCol="features", labelCol="label", weightCol="weight", maxIter=trees, maxDepth=4, stepSize=0.04, subsamplingRate=0.8, minInstancesPerNode=3, maxBins=BINS + 1, seed=seed), [])


def fit_success_model(samples: DataFrame, columns: list[str], trees: int = 200, seed: int = 42) -> PipelineModel:
    """The same with classification trees; rows alike have the same label."""
    return _fit(samples, columns, GBTClassifier(featuresCol="features", labelCol="label", weightCol="weight", maxIter=trees, maxDepth=4, stepSize=0.05, subsamplingRate=0.8, minInstancesPerNode=3, maxBins=BINS + 1, seed=seed), [F.col("label").alias("class")])


def load_or_fit(path: str, version: str, fit) -> PipelineModel:
    """The stored model of this version, else a new one, which is stored."""
    where = f"{path}/{version}"
    try:
        return PipelineModel.load(where)
    except Exception as e:  # nothing stored under this version
        if "does not exist" not in str(e) and "PATH_NOT_FOUND" not in str(e):
            raise
    model = fit()
    model.write().overwrite().save(where)
    return model


def success(model: PipelineModel, rows: DataFrame) -> DataFrame:
    return model.transform(rows).withColumn("success", F.round(vector_to_array("probability")[1], 4)).drop(*model.stages[0].getOutputCols(), "raw", "features", "rawPrediction", "probability", "prediction")


def analytic_value(base_value: Column, score: Column, age: Column, p1: Column, direction: Column) -> Column:
    """Base value of the league, by score, age and demand."""
    performance = F.pow(X.clamp(X.or_default(score, 50.0), 0, 100) / 50.0, F.lit(1.4))
    demand = 1.0 + 0.30 * F.coalesce(p1, F.lit(0.0)) + F.when(direction == "improving", 0.15).when(direction == "declining", -0.10).otherwise(0.0)
    return F.round(base_value * performance * F.coalesce(X.gauss(age, 24.0, 4.5), F.lit(0.8)) * demand, 0)


def blended(predicted: Column, analytic: Column, market: Column) -> Column:
    both = 0.75 * predicted + 0.25 * analytic
    return F.round(F.when(market > 0, 0.7 * both + 0.3 * market).otherwise(both), 0)
