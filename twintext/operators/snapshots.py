"""Several tables published together: versions in a shared folder, each named by one small manifest.

A commit writes its tables to new folders and then renames a manifest into
place. Until that rename readers see the old version, so a job that fails
halfway changes nothing; of two commits from one version the second is refused.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession


class ConflictError(RuntimeError):
    """Another commit came first."""


class Snapshots:
    """Versions of a set of tables under ``root``, a folder that Spark reads and writes."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._path(f"{self.root}/versions"))

    def version(self) -> int:
        """The newest version; 0 before the first commit."""
        names = [f.getPath().getName() for f in self._fs.listStatus(self._path(f"{self.root}/versions"))]
        return max((int(n) for n in names if n.isdigit()), default=0)

    def _manifest(self, version: int) -> dict[str, str]:
        if not version:
            return {}
        path = self._path(f"{self.root}/versions/{version:012d}")
        stream = self._fs.open(path)
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def read(self, name: str, version: int | None = None) -> DataFrame:
        return self.spark.read.parquet(self._manifest(self.version() if version is None else version)[name])

    def commit(self, tables: dict[str, DataFrame], base: int) -> int:
        """Publishes ``tables`` on top of the version ``base``, which must be the newest; other tables stay as they are there."""
        manifest = self._manifest(base)
        for name, df in tables.items():
            manifest[name] = f"{self.root}/tables/{name}-{uuid.uuid4().hex}"
            df.write.option("compression", "zstd").parquet(manifest[name])
        draft = self._path(f"{self.root}/draft-{uuid.uuid4().hex}")
        stream = self._fs.create(draft, False)
        stream.writeBytes(json.dumps(manifest))
        stream.close()
        final = self._path(f"{self.root}/versions/{base + 1:012d}")
        # A rename doesn't replace what is there.
        if self.version() != base or self._fs.exists(final) or not self._fs.rename(draft, final):
            self._fs.delete(draft, False)
            raise ConflictError(f"version {base} is no longer the newest")
        return base + 1
