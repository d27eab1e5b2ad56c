"""A table as numbered snapshots in the shared folder, changed by one writer at a time."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.sources.tables import _files


class Conflict(Exception):
    """Another writer committed first; nothing of this one's is seen."""


class Snapshots:
    """Versions 1, 2, ... of one table below a folder.

    Data goes to a folder of its own; a version comes into being with a small file of its number, made only if there is none
    yet, that names the folder. So a version is seen whole or not at all, and of two writers that start from one version one
    loses. That needs a file system that can refuse to replace a file (local disks, HDFS); object stores without such a write
    can't hold these tables. Folders of writers that lost are deleted. Old versions stay until forget().
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _listed(self) -> list[int]:
        at, files = _files(self.spark, f"{self.folder}/versions")
        if not files.exists(at):
            return []
        return sorted(int(s.getPath().getName()) for s in files.listStatus(at) if s.getPath().getName().isdigit())

    def version(self) -> int:
        """The newest version, 0 if there is none."""
        return max(self._listed(), default=0)

    def _data(self, version: int) -> str:
        at, files = _files(self.spark, f"{self.folder}/versions/{version:09d}")
        stream = files.open(at)
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def read(self, version: int | None = None) -> DataFrame | None:
        """The newest version, or the one asked for; None if there is none at all."""
        n = self.version() if version is None else version
        return self.spark.read.parquet(f"{self.folder}/data/{self._data(n)}") if n else None

    def commit(self, rows: DataFrame, base: int) -> int:
        """Make rows the version after `base`. Raises Conflict if that exists by now."""
        name = uuid.uuid4().hex
        rows.write.parquet(f"{self.folder}/data/{name}")
        at, files = _files(self.spark, f"{self.folder}/versions/{base + 1:09d}")
        try:
            if files.exists(at):
                raise FileExistsError
            stream = files.create(at, False)
        except Exception as e:
            data, _ = _files(self.spark, f"{self.folder}/data/{name}")
            files.delete(data, True)
            raise Conflict(f"version {base + 1}") from e
        stream.write(bytearray(name.encode()))
        stream.close()
        return base + 1

    def upsert(self, changes: DataFrame, key: list[str], order: str, tries: int = 3) -> int:
        """Replace rows by those of the same key in changes, and add new keys. Of several changes of one key the last by `order` counts.

        Null keys equal each other. A writer that lost reads again what the other one wrote and tries again, so no row of
        either gets lost; after `tries` times Conflict is raised.
        """
        names = [c for c in changes.columns if c not in key]
        last = changes.groupBy(*key).agg(F.max_by(F.struct(*names), order).alias("_row")).select(*key, "_row.*").select(*changes.columns)
        for left in range(tries - 1, -1, -1):
            base = self.version()
            rows = last
            if base:
                old, new = self.read(base).alias("old"), last.select(*key).alias("new")
                kept = old.join(new, [F.col(f"old.{k}").eqNullSafe(F.col(f"new.{k}")) for k in key], "left_anti")
                rows = kept.unionByName(last)
            try:
                return self.commit(rows, base)
            except Conflict:
                if not left:
                    raise
        return 0

    def forget(self, keep: int = 2) -> None:
        """Delete all but the newest `keep` versions."""
        for n in self._listed()[: -keep or None]:
            for path in (f"{self.folder}/data/{self._data(n)}", f"{self.folder}/versions/{n:09d}"):
                at, files = _files(self.spark, path)
                files.delete(at, True)
