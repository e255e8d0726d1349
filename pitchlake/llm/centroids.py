"""Exact integer k-means whose nearest centroid comes from a tournament of bisectors.

For two centroids a < b the sign of 2 v.(b - a) - (|b|^2 - |a|^2) says which is nearer to v: above
zero it is b, else a, so equal distances go to the smaller number. Normals and thresholds of all pairs
are made once a round; a vector then takes k - 1 such tests, each against the one that is still in,
and only the last one's distance is computed. All of it is whole numbers, so reruns and other
partitionings give the same rows.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pitchlake.llm.shared import cut_at

#: Fixed values of the query: centroids, rounds, components, units to 1, and the text before an id in the hash that chooses the start.
K, ROUNDS, SIZE, SCALE, SALT = 8, 10, 64, 1024, "3:"
_BATCH = 8192


def largest(size: int) -> int:
    """Whole components below this have squared distances, and bisector sums, of `size` components within a long."""
    return math.isqrt((1 << 60) // max(size, 1))


def whole_vectors(vectors: DataFrame, size: int = SIZE, scale: int = SCALE, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(vec_id, v array<bigint>, fits) of the rows with exactly `size` finite components: floor(scale * x) of each.

    Where a component is largest(size) or more either way, fits is false and v null.
    """
    odd = F.exists("x", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    kept = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("x")).filter((F.size("x") == size) & ~odd)
    fits = F.forall("x", lambda c: F.abs(c) * scale < largest(size))
    return kept.select("vec_id", F.when(fits, F.transform("x", lambda c: F.floor(c * scale).cast("long"))).alias("v"), fits.alias("fits"))


def bisectors(centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(normals, thresholds): for a < b, normals[a, b].v > thresholds[a, b] where b is nearer to v than a."""
    squares = (centroids * centroids).sum(1)
    return 2 * (centroids[None] - centroids[:, None]), squares[None] - squares[:, None]


def tournament(v: np.ndarray, normals: np.ndarray, thresholds: np.ndarray) -> np.ndarray:
    """The number of each vector's nearest centroid, after k - 1 sign tests."""
    best = np.zeros(len(v), np.int32)
    for b in range(1, len(normals)):
        for a in np.unique(best).tolist():
            rows = np.flatnonzero(best == a)
            best[rows[v[rows] @ normals[a, b] > thresholds[a, b]]] = b
    return best


def _batches(column: pa.Array, size: int) -> Iterator[tuple[int, np.ndarray]]:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64, copy=False).reshape(len(column), size)
    for at in range(0, len(flat), _BATCH):
        yield at, flat[at : at + _BATCH]


def assigned(whole: DataFrame, centroids: np.ndarray) -> DataFrame:
    """(vec_id, cluster, distance) of each vector."""
    normals, thresholds = bisectors(centroids)
    schema = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("cluster", T.IntegerType()), T.StructField("distance", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, v in _batches(batch.column(1), centroids.shape[1]):
                best = tournament(v, normals, thresholds)
                yield pa.record_batch([batch.column(0).slice(at, len(v)), pa.array(best), pa.array(((v - centroids[best]) ** 2).sum(1))], names=schema.names)

    return whole.select("vec_id", "v").mapInArrow(run, schema)


def moved(whole: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Each centroid replaced by its vectors' floor(sum / count); empty ones stay.

    A task sums its own vectors, so a row for each task and centroid is shuffled, and k rows reach the driver.
    """
    normals, thresholds = bisectors(centroids)
    k, size = centroids.shape
    schema = T.StructType([T.StructField("cluster", T.IntegerType()), T.StructField("n", T.LongType()), T.StructField("sums", T.ArrayType(T.LongType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros((k, size), np.int64), np.zeros(k, np.int64)
        for batch in batches:
            for _, v in _batches(batch.column(0), size):
                best = tournament(v, normals, thresholds)
                counts += np.bincount(best, minlength=k)
                for c in np.unique(best).tolist():
                    sums[c] += v[best == c].sum(0)
        full = np.flatnonzero(counts)
        yield pa.record_batch([pa.array(full.astype(np.int32)), pa.array(counts[full]), pa.array([sums[c] for c in full], pa.list_(pa.int64()))], names=schema.names)

    parts = whole.select("v").mapInArrow(run, schema)
    wide = parts.groupBy("cluster").agg(F.sum("n").alias("n"), *[F.sum(F.get("sums", F.lit(i)).cast("decimal(38,0)")).alias(f"s{i}") for i in range(size)])
    out = centroids.copy()
    for row in wide.collect():
        out[row["cluster"]] = [int(row[f"s{i}"]) // row["n"] for i in range(size)]
    return out


def text_of(centroid: np.ndarray) -> str:
    return ",".join(map(str, centroid.tolist()))


def cluster(vectors: DataFrame, k: int = K, rounds: int = ROUNDS, size: int = SIZE, scale: int = SCALE, salt: str = SALT, id_col: str = "vec_id", vec_col: str = "embedding") -> tuple[DataFrame, np.ndarray]:
    """(rows, centroids) of k-means over the vectors of exactly `size` finite components.

    Rows: vec_id, cluster, distance, one for each such row of vectors, repeated ones too. Centroids
    start as the k vectors whose ids have the smallest hashes; fewer vectors are fewer centroids, and none
    give no rows. Rows of one id order by their components. A null id counts as the empty text in the
    hash. Rows of other sizes, with null or non-finite components, or null, are left out. A
    vector with a component of largest(size) units or more has no distance that a long can hold: it takes no
    part, and its cluster and distance are null. Other columns are not read. The whole vectors are
    written to the shared folder once and read in each round.
    """
    whole, _ = cut_at(whole_vectors(vectors, size, scale, id_col, vec_col))
    fits = whole.filter("fits")
    first = fits.select("v", F.sha2(F.concat(F.lit(salt), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256).alias("h")).orderBy("h", "v").limit(k).collect()
    if not first:
        return whole.select("vec_id", F.lit(None).cast("int").alias("cluster"), F.lit(None).cast("long").alias("distance")), np.zeros((0, size), np.int64)
    centroids = np.array([row["v"] for row in first], np.int64)
    for _ in range(rounds):
        now = moved(fits, centroids)
        if np.array_equal(now, centroids):
            break  # so would all rounds be that follow
        centroids = now
    beyond = whole.filter("not fits").select("vec_id", F.lit(None).cast("int").alias("cluster"), F.lit(None).cast("long").alias("distance"))
    return assigned(fits, centroids).unionByName(beyond), centroids


def with_inertia(rows: DataFrame, centroids: np.ndarray) -> DataFrame:
    """rows of cluster() with cluster_inertia, inertia and centroid_sha256, null where no cluster is.

    A sum beyond a long is null. The table joined to the rows has one row for each centroid.
    """
    spark = rows.sparkSession
    rows, _ = cut_at(rows)
    sums = {r["cluster"]: r["s"] for r in rows.filter("cluster is not null").groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    as_long = lambda n: int(n) if n < 1 << 63 else None
    total = as_long(sum(sums.values()))
    about = [(c, as_long(s), total, hashlib.sha256(text_of(centroids[c]).encode()).hexdigest()) for c, s in sorted(sums.items())]
    facts = spark.createDataFrame(about, "__c int, cluster_inertia long, inertia long, centroid_sha256 string")
    return rows.join(F.broadcast(facts), F.col("cluster") == F.col("__c"), "left").drop("__c")


def _round_sql(i: int) -> str:
    """Centroids c{i} from the assignment to c{i - 1}."""
    return f""", a{i - 1} AS MATERIALIZED ({_assign_sql(f"c{i - 1}")}),
m{i} AS MATERIALIZED (SELECT cluster, list(m ORDER BY j) AS v FROM (
  SELECT cluster, j, (sum(x)::HUGEINT - (((sum(x)::HUGEINT % count(*)) + count(*)) % count(*))) // count(*) AS m
  FROM (SELECT cluster, generate_subscripts(v, 1) AS j, unnest(v) AS x FROM a{i - 1}) GROUP BY cluster, j) GROUP BY cluster),
c{i} AS MATERIALIZED (SELECT c{i - 1}.cluster, coalesce(m{i}.v::BIGINT[], c{i - 1}.v) AS v FROM c{i - 1} LEFT JOIN m{i} USING (cluster))"""


def _assign_sql(table: str) -> str:
    return f"""SELECT n, vec_id, v, arg_min(cluster, (d, cluster)) AS cluster, min(d) AS distance FROM (
  SELECT w.n, w.vec_id, w.v, {table}.cluster, list_sum(list_transform(list_zip(w.v, {table}.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d
  FROM w, {table}) GROUP BY n, vec_id, v"""


#: DuckDB SQL for the query's rows, from distances to all centroids.
CLUSTER_SQL = f"""WITH w AS MATERIALIZED (SELECT row_number() OVER () AS n, vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE len(embedding) = {SIZE} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {SIZE}),
c0 AS MATERIALIZED (SELECT (row_number() OVER (ORDER BY sha256('{SALT}' || coalesce(vec_id::VARCHAR, '')), v) - 1)::INT AS cluster, v FROM w
  QUALIFY row_number() OVER (ORDER BY sha256('{SALT}' || coalesce(vec_id::VARCHAR, '')), v) <= {K})
{"".join(_round_sql(i) for i in range(1, ROUNDS + 1))},
fin AS MATERIALIZED ({_assign_sql(f"c{ROUNDS}")})
SELECT vec_id, fin.cluster::INT AS cluster, distance, (sum(distance) OVER (PARTITION BY fin.cluster))::BIGINT AS cluster_inertia, (sum(distance) OVER ())::BIGINT AS inertia,
  sha256(array_to_string(c{ROUNDS}.v, ',')) AS centroid_sha256 FROM fin JOIN c{ROUNDS} USING (cluster)"""
