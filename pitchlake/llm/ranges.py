"""Ranges of ids: numbers that grow with the id, with about equally many rows each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def ranged(ids: DataFrame, *frames: DataFrame, rows: int, id_col: str = "doc_id", out: str = "range") -> list[DataFrame]:
    """Each of frames with the column `out`; null ids are in range -1.

    Up to 256 cuts are the ids' percentiles; each such part is divided evenly by id, so that the
    number of ranges has no bound while only the cuts pass through the driver.
    """
    n, low, high, cuts = ids.agg(F.count(id_col), F.min(id_col), F.max(id_col), F.percentile_approx(id_col, [i / 256 for i in range(1, 256)], 100_000)).head()
    if not n:
        return [f.withColumn(out, F.lit(-1).cast("long")) for f in frames]
    parts = max(1, min(256, -(-n // rows)))
    inner = sorted({int(cuts[round(i * 256 / parts) - 1]) for i in range(1, parts)}) if parts > 1 else []
    edges = [int(low), *[c for c in inner if c > low], int(high) + 1]
    fan = max(1, -(-n // (rows * 256)))
    of = F.col(id_col)

    def leaf(i: int) -> Column:
        width = max(1, -(-(edges[i + 1] - edges[i]) // fan))
        return F.lit(i * fan).cast("long") + F.floor((of - edges[i]) / width)

    def tree(a: int, b: int) -> Column:
        if b - a == 1:
            return leaf(a)
        m = (a + b) // 2
        return F.when(of < edges[m], tree(a, m)).otherwise(tree(m, b))

    column = F.when(of.isNull(), F.lit(-1).cast("long")).otherwise(tree(0, len(edges) - 1))
    return [f.withColumn(out, column) for f in frames]
