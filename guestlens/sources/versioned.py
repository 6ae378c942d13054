"""Versioned Parquet tables with a commit manifest.

Layout: ``<root>/data/<key>=<n>/...`` holds each version's rows and
``<root>/manifest/<key>=<n>/`` marks the version as committed.  The manifest
entry is written only after the data write succeeded, and readers only trust
versions listed in the manifest - so a job that dies half-way through a write
(lost executor, killed driver) leaves no half version visible, and a retry
simply overwrites the unlisted data folder.  A version may hold several named
parts, which one manifest entry commits together, and a tag that names the work it
came from (a micro-batch of a checkpoint), so that work is never applied twice.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.utils import AnalysisException


class VersionedTable:
    def __init__(self, spark: SparkSession, root: str, key: str = "version"):
        self.spark, self.root, self.key = spark, root.rstrip("/"), key

    def _data(self, n: int) -> str:
        return f"{self.root}/data/{self.key}={n}"

    def _manifest(self) -> list[tuple[int, str | None]]:
        try:
            m = self.spark.read.parquet(f"{self.root}/manifest")
        except AnalysisException:
            return []
        return sorted((int(r[0]), r[1]) for r in m.select(self.key, "tag").distinct().collect())

    def versions(self) -> list[int]:
        return [n for n, _ in self._manifest()]

    def tags(self) -> set[str]:
        return {tag for _, tag in self._manifest() if tag is not None}

    def committed(self, n: int, tag: str) -> bool:
        """Whether version ``n`` was committed for this work; reads its own entry only, however many there are."""
        try:
            m = self.spark.read.parquet(f"{self.root}/manifest/{self.key}={n}")
        except AnalysisException:
            return False
        return any(r[0] == tag for r in m.select("tag").collect())

    def has(self, n: int) -> bool:
        return n in self.versions()

    def latest_version(self, below: int | None = None) -> int | None:
        """The newest committed version, of those below a number if one is given."""
        v = [n for n in self.versions() if below is None or n < below]
        return v[-1] if v else None

    def read(self, n: int, part: str | None = None) -> DataFrame:
        return self.spark.read.parquet(self._data(n) + (f"/{part}" if part else ""))

    def latest(self, below: int | None = None, part: str | None = None) -> DataFrame | None:
        n = self.latest_version(below)
        return None if n is None else self.read(n, part)

    def read_all(self, part: str | None = None) -> DataFrame | None:
        """Rows of every committed version (for append-style tables), or of one part of it."""
        v = self.versions()
        if not v:
            return None
        if part is None:
            return self.spark.read.parquet(*[self._data(n) for n in v])
        return reduce(DataFrame.unionByName, [self.read(n, part) for n in v])

    def write(self, df: DataFrame, n: int, partition_by: tuple[str, ...] = (), tag: str | None = None) -> None:
        w = df.write.mode("overwrite")
        if partition_by:
            w = w.partitionBy(*partition_by)
        w.parquet(self._data(n))
        self.commit(n, tag)

    def write_part(self, df: DataFrame, n: int, part: str, partition_by: tuple[str, ...] = ()) -> DataFrame:
        """One part of a version that is not committed yet."""
        w = df.write.mode("overwrite")
        if partition_by:
            w = w.partitionBy(*partition_by)
        w.parquet(f"{self._data(n)}/{part}")
        return self.read(n, part)

    def commit(self, n: int, tag: str | None = None) -> None:
        marker = self.spark.createDataFrame([(n, tag)], "committed long, tag string")
        marker.write.mode("overwrite").parquet(f"{self.root}/manifest/{self.key}={n}")
