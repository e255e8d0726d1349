"""Where intermediate tables go, and small helpers that all text operators use."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a run of characters that are neither space nor one of TAB LF VT FF CR.
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir, which driver and executors share.

    Only in local mode (tests, notebooks), where that setting is absent, one is made and set; on a
    cluster a folder of one machine would be read by nobody else, so its absence is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="pitchlake-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/pitchlake-{uuid.uuid4().hex}"


def _hadoop(spark: SparkSession, path: str) -> tuple:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def exists(spark: SparkSession, path: str) -> bool:
    files, where = _hadoop(spark, path)
    return files.exists(where)


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder that this library wrote."""
    files, where = _hadoop(spark, path)
    files.delete(where, True)


def cut_at(df: DataFrame, parts: int | None = None, compression: str = "snappy") -> tuple[DataFrame, str]:
    """cut(), and the folder, for those who remove() it when all that reads it is written."""
    spark = df.sparkSession
    path = shared_dir(spark)
    (df if parts is None else df.coalesce(parts)).write.option("compression", compression).parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def cut(df: DataFrame, parts: int | None = None, compression: str = "snappy") -> DataFrame:
    """Writes df as a table in the shared folder and reads it back.

    This ends the lineage: if an executor is lost later, what was written stays.
    """
    return cut_at(df, parts, compression)[0]


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def crc_of_id(doc_id: str = "doc_id") -> Column:
    """crc32 of the id's decimal text; that of the empty text, 0, for a null id."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary"))


def quoted(name: str) -> str:
    """A column's name as select() takes it, whatever characters it has."""
    return "`" + name.replace("`", "``") + "`"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once for each row, not wherever, or as often in a lambda as, body names it."""
    return F.get(F.transform(F.array(value), body), 0)


def running(x: Column, block: int = 256) -> Column:
    """array<int> of the running sums of an array<int>, in steps that grow with its length.

    Sums are appended block by block, and each block's sums raised by those of the blocks before, so
    that only `block` values are copied for each new one.
    """

    def sums(of: Column) -> Column:
        return F.aggregate(of, F.array().cast("array<int>"), lambda a, v: F.concat(a, F.array((F.coalesce(F.get(a, F.size(a) - 1), F.lit(0)) + v).cast("int"))))

    def raised(parts: Column) -> Column:
        totals = sums(F.transform(parts, lambda p: F.aggregate(p, F.lit(0), lambda a, v: a + v)))
        return let(totals, lambda before: F.flatten(F.transform(parts, lambda p, i: let(F.coalesce(F.get(before, i - 1), F.lit(0)), lambda b: F.transform(sums(p), lambda v: v + b)))))

    def blocks(x: Column) -> Column:
        starts = F.sequence(F.lit(0), F.floor((F.greatest(F.size(x), F.lit(1)) - 1) / block).cast("int"))
        return F.transform(starts, lambda i: F.slice(x, i * block + 1, block))

    return let(let(x, blocks), raised)
