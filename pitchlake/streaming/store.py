"""Keyed tables in buckets: a batch reads and writes only the buckets that its keys are in.

A table is a folder. `data/version=V/bucket=B` has the rows that version V wrote of bucket B, and
`manifest/version=V` says for each bucket which versions' folders make it up. A version counts once its
manifest is whole, so a batch that breaks off leaves the table as it was, and one that runs again
finds its version and changes nothing. Folders that no kept manifest names are deleted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_MANIFEST = "bucket int, versions array<long>"


class BucketTable:
    """See the module's text. `merge`: folders of a bucket, at most, before append() writes them as one."""

    def __init__(self, spark: SparkSession, path: str, key: str, schema: T.StructType, buckets: int = 64, keep: int = 2, merge: int = 16):
        self.spark, self.path, self.key, self.schema = spark, path.rstrip("/"), key, schema
        self.buckets, self.keep, self.merge = buckets, keep, merge

    # --- versions ---------------------------------------------------------------------------------

    def _fs(self, path: str) -> tuple:
        where = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), where

    def _folders(self, under: str) -> list[int]:
        fs, where = self._fs(f"{self.path}/{under}")
        return sorted(int(s.getPath().getName().split("=")[1]) for s in fs.listStatus(where) if "=" in s.getPath().getName()) if fs.exists(where) else []

    def versions(self) -> list[int]:
        """Versions whose manifest was written to its end."""
        return [v for v in self._folders("manifest") if (f := self._fs(f"{self.path}/manifest/version={v}/_SUCCESS"))[0].exists(f[1])]

    def version(self) -> int:
        """The current version; -1: nothing was written yet."""
        return max(self.versions(), default=-1)

    def manifest(self, version: int | None = None) -> dict[int, list[int]]:
        """The versions that make up each bucket that has rows; one row for each bucket is read."""
        version = self.version() if version is None else version
        if version < 0:
            return {}
        return {r["bucket"]: list(r["versions"]) for r in self.spark.read.schema(_MANIFEST).parquet(f"{self.path}/manifest/version={version}").collect()}

    # --- rows -------------------------------------------------------------------------------------

    def bucketed(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn("bucket", F.pmod(F.xxhash64(F.col(self.key).cast("string")), F.lit(self.buckets)).cast("int"))

    def touched(self, rows: DataFrame) -> list[int]:
        """The buckets of the rows' keys: no more numbers than there are buckets."""
        return sorted(r[0] for r in self.bucketed(rows.select(self.key)).select("bucket").distinct().collect())

    def paths(self, buckets: list[int] | None = None, version: int | None = None) -> list[str]:
        return [f"{self.path}/data/version={v}/bucket={b}" for b, made in sorted(self.manifest(version).items()) if buckets is None or b in buckets for v in made]

    def read(self, buckets: list[int] | None = None, version: int | None = None) -> DataFrame:
        """All rows, or those of some buckets, whose folders alone are read."""
        paths = self.paths(buckets, version)
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def _write(self, rows: DataFrame, version: int) -> list[int]:
        at = f"{self.path}/data/version={version}"
        # A hot key's rows are one bucket but several files.
        self.bucketed(rows.select(*self.schema.names)).hint("rebalance", "bucket").write.mode("overwrite").partitionBy("bucket").parquet(at)
        fs, where = self._fs(at)
        return [int(s.getPath().getName().split("=")[1]) for s in fs.listStatus(where) if s.getPath().getName().startswith("bucket=")]

    def _commit(self, version: int, manifest: dict[int, list[int]]) -> None:
        rows = self.spark.createDataFrame([(b, v) for b, v in sorted(manifest.items()) if v], _MANIFEST)
        rows.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/manifest/version={version}")
        self._drop_old(version)

    def _drop_old(self, version: int) -> None:
        kept = [v for v in self.versions() if v <= version][-self.keep :]
        used = {v for k in kept for made in self.manifest(k).values() for v in made}
        for v in self._folders("manifest"):
            if v < kept[0]:
                fs, where = self._fs(f"{self.path}/manifest/version={v}")
                fs.delete(where, True)
        for v in self._folders("data"):
            if v not in used and v < version:
                fs, where = self._fs(f"{self.path}/data/version={v}")
                fs.delete(where, True)

    def append(self, version: int, rows: DataFrame) -> bool:
        """Adds rows as `version`; False, and no change, if that version is there."""
        if version <= self.version():
            return False
        manifest = self.manifest()
        many = [b for b, made in manifest.items() if len(made) >= self.merge]
        many = [b for b in many if b in self.touched(rows)] if many else []
        written = self._write(rows.select(*self.schema.names).unionByName(self.read(many)) if many else rows, version)
        for b in written:
            manifest[b] = [version] if b in many else [*manifest.get(b, []), version]
        self._commit(version, manifest)
        return True

    def replace(self, version: int, rows: DataFrame, buckets: list[int]) -> bool:
        """Puts rows in place of all that these buckets had; False, and no change, if that version is there."""
        if version <= self.version():
            return False
        manifest = self.manifest()
        written = self._write(rows, version)
        if set(written) - set(buckets):
            raise ValueError(f"rows of other buckets than those to be replaced: {sorted(set(written) - set(buckets))}")
        for b in buckets:
            manifest[b] = [version] if b in written else []
        self._commit(version, manifest)
        return True
