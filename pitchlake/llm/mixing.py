"""Mixing sources to target weights.

Tokens are summed per source, each source gets a target share of the mixture, and every
document is emitted floor(rate) times plus once more with probability rate - floor(rate),
decided by a hash of its id and a seed, so that reruns agree without any random state.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pitchlake.llm.shared import WORD, cut, quoted

WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3
SEED = "mix-1"


def source_targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """(source, source_size) -> + weight, target.

    Sources in code-point order, null last, get the weights in turn and share the sum of all
    sizes by weight. A target stops at max_epochs times its source's size; what is left over is
    shared again by weight among the others until none is above. Each round only brings two
    sums to the driver. `sizes` has one row per source, so ordering it is not ordering the corpus.
    An empty table gives an empty table; a source of size 0 gets target 0.
    """
    turn = (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights)
    ranked = cut(sizes.withColumn("weight", F.element_at(F.array(*[F.lit(int(w)) for w in weights]), (turn + 1).cast("int"))))
    most = F.col("source_size") * max_epochs
    total = ranked.agg(F.sum("source_size")).head()[0] or 0
    rest, share = float(total), float(ranked.agg(F.sum("weight")).head()[0] or 1)
    while True:
        fair = F.col("weight") * F.lit(rest) / F.lit(share)
        held, free = ranked.agg(
            F.coalesce(F.sum(F.when(fair > most, most)), F.lit(0)), F.coalesce(F.sum(F.when(fair <= most, F.col("weight"))), F.lit(0))
        ).head()
        if not free or (float(total - held), float(free)) == (rest, share):
            break
        rest, share = float(total - held), float(free)
    return ranked.withColumn("target", F.least(fair, most.cast("double")))


def mix(
    docs: DataFrame, weights: Sequence[int] = WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: str = SEED, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source"
) -> DataFrame:
    """One row per input row: id, size (words), source, source_size, target, copies, taken.

    Null or empty text has size 0 and is taken as often as any other document of its source
    (a source without any word gets no copies). Rows that share an id share their draw. Null
    sources form one source of their own, placed last. Columns of docs beyond the three named
    are not read.
    """
    sized = docs.select(
        F.col(id_col).alias("doc_id"),
        F.col(source_col).cast("string").alias("source"),
        F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
    )
    sized = cut(sized)
    targets = source_targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, max_epochs).withColumnRenamed("source", "mixed_source")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    draw = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), F.col("doc_id").cast("string"))), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))
    return (
        sized.join(targets, F.col("source").eqNullSafe(F.col("mixed_source")))
        .withColumn("copies", (F.floor(rate) + F.when(draw < rate - F.floor(rate), 1).otherwise(0)).cast("long"))
        .select("doc_id", "size", "source", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"))
    )


def emit(docs: DataFrame, weights: Sequence[int] = WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: str = SEED) -> DataFrame:
    """The mixture itself: every row of docs, with its columns, as many times as mix() says."""
    per_source = docs.groupBy(F.col("source").cast("string").alias("source")).agg(F.coalesce(F.sum(F.regexp_count("text", F.lit(WORD))), F.lit(0)).cast("long").alias("source_size"))
    targets = source_targets(per_source, weights, max_epochs).select(
        F.col("source").alias("__mix_source"), F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0)).alias("__mix_rate")
    )
    draw = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), F.col("doc_id").cast("string"))), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))
    rate = F.col("__mix_rate")
    copies = (F.floor(rate) + F.when(draw < rate - F.floor(rate), 1).otherwise(0)).cast("int")
    return (
        docs.join(targets, F.col("source").cast("string").eqNullSafe(F.col("__mix_source")))
        .withColumn("__mix_copy", F.explode(F.array_repeat(F.lit(1), copies)))
        .select(*[docs[quoted(c)] for c in docs.columns])
    )


MIX_SQL = """
WITH RECURSIVE d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source
), w AS (
  SELECT source, source_size, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight FROM s
), fill(k, rest, share) AS (
  SELECT 0, sum(source_size)::DOUBLE, sum(weight)::DOUBLE FROM w
  UNION ALL
  SELECT f.k + 1,
    ((SELECT sum(source_size) FROM w) - coalesce((SELECT sum(3 * source_size) FROM w WHERE weight * f.rest / f.share > 3 * source_size), 0))::DOUBLE,
    (SELECT sum(weight) FROM w WHERE weight * f.rest / f.share <= 3 * source_size)::DOUBLE
  FROM fill f WHERE f.k < (SELECT count(*) FROM w)
), lvl AS (SELECT rest, share FROM fill WHERE share IS NOT NULL ORDER BY k DESC LIMIT 1
), t AS (
  SELECT source, source_size, least(weight * rest / share, (3 * source_size)::DOUBLE) AS target FROM w, lvl
), r AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0.0 END AS rate,
    ('0x' || substr(md5(concat_ws(':', 'mix-1', d.doc_id::VARCHAR)), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0 AS draw
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target, (size * (floor(rate) + CASE WHEN draw < rate - floor(rate) THEN 1 ELSE 0 END))::BIGINT AS taken FROM r
"""
