"""A folder tree as a Spark data source: folders are pruned while listing, files are opened last."""

from __future__ import annotations

import os
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, StringStartsWith

from corpusloom.functions.text import glob_regex

SCHEMA = "path string, size long, status string, text string"
#: Bytes of a file in which a NUL tells that it is binary, and bytes of text that a task reads (about).
HEAD, TASK_BYTES = 8192, 32_000_000


@dataclass
class Files(InputPartition):
    """(path, size, status) of some files; status is None for those that are still to be opened."""

    rows: list[tuple[str, int | None, str | None]]


def _matches(path: str, globs: list[str]) -> bool:
    return any(re.match(glob_regex(g), p) for g in globs for p in (path, path.rpartition("/")[2]))


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.root = options["path"].removeprefix("file://")
        listed = lambda name: [x for x in options.get(name, "").split("\n") if x]
        self.suffixes, self.prune, self.include, self.exclude = map(listed, ("suffixes", "prune", "include", "exclude"))
        self.most = int(options.get("maxbytes", "1000000"))
        self.statuses: set[str] | None = None
        self.prefix = ""

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            wanted = {f.value} if isinstance(f, EqualTo) and f.attribute == ("status",) else set(f.value) if isinstance(f, In) and f.attribute == ("status",) else None
            if wanted is not None:
                self.statuses = wanted if self.statuses is None else self.statuses & wanted
            elif isinstance(f, StringStartsWith) and f.attribute == ("path",) and not self.prefix:
                self.prefix = f.value
            elif isinstance(f, EqualTo) and f.attribute == ("path",) and not self.prefix:
                self.prefix = f.value
                yield f
            else:
                yield f

    def _status(self, path: str, entry: os.DirEntry) -> tuple[int | None, str | None]:
        if entry.is_symlink():
            return None, "link"
        if os.path.splitext(entry.name)[1].lower() not in self.suffixes:
            return None, "suffix"
        if _matches(path, self.exclude) or self.include and not _matches(path, self.include):
            return None, "excluded"
        try:
            size = entry.stat(follow_symlinks=False).st_size
        except OSError:
            return None, "unreadable"
        return size, "large" if size > self.most else None

    def _walk(self, folder: str) -> Iterator[tuple[str, int | None, str | None]]:
        with os.scandir(os.path.join(self.root, folder)) as entries:
            found = sorted(entries, key=lambda e: e.name)
        for e in found:
            path = f"{folder}/{e.name}" if folder else e.name
            if e.is_dir(follow_symlinks=False):
                inside = f"{path}/"
                if not (inside.startswith(self.prefix) or self.prefix.startswith(inside)):
                    continue
                if e.name in self.prune or _matches(path, self.exclude):
                    yield path, None, "pruned"
                else:
                    yield from self._walk(path)
            elif path.startswith(self.prefix):
                # A link to a folder is a link, and isn't followed.
                yield path, *self._status(path, e)

    def partitions(self) -> list[Files]:
        out, size = [Files([])], 0
        for row in self._walk(""):
            if row[2] is not None and self.statuses is not None and row[2] not in self.statuses:
                continue
            if row[2] is None and self.statuses is not None and not self.statuses & {"kept", "binary", "unreadable"}:
                continue
            if size > TASK_BYTES or len(out[-1].rows) >= 10_000:
                out.append(Files([]))
                size = 0
            out[-1].rows.append(row)
            size += (row[1] or 0) if row[2] is None else 0
        return out

    def read(self, partition: Files) -> Iterator[tuple[str, int | None, str, str | None]]:
        for path, size, status in partition.rows:
            text = None
            if status is None:
                try:
                    with open(os.path.join(self.root, path), "rb") as f:
                        head = f.read(HEAD)
                        status = "binary" if b"\0" in head else "kept"
                        text = (head + f.read()).decode("utf-8", "replace") if status == "kept" else None
                except OSError:
                    status = "unreadable"
            if self.statuses is None or status in self.statuses:
                yield path, size, status, text


class FileTree(DataSource):
    """Format `file_tree`. Options: path, and, one a line, suffixes, prune, include, exclude; maxBytes."""

    @classmethod
    def name(cls) -> str:
        return "file_tree"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> _Reader:
        return _Reader(dict(self.options))


def scan_tree(spark: SparkSession, root: str, suffixes: list[str], prune: tuple[str, ...] = (), include: tuple[str, ...] = (), exclude: tuple[str, ...] = (), max_bytes: int = 1_000_000) -> DataFrame:
    """(path below root, size, status, text) of the files under root, a folder that all machines mount.

    status: `pruned` (a folder of that name, or that an exclude glob meets; what is in it is not even listed), `link` (links
    are not followed), `suffix`, `excluded` (by the globs), `large`, `unreadable`, `binary` (NUL in the first 8192 bytes),
    else `kept`. Only kept files have a text, bad bytes as U+FFFD; sizes are known of files that passed the globs. Files are
    opened by tasks, last of all, and only if no filter on status or on the path's start, which are pushed down, leaves them
    out. Counting rows by status gives the counters of a scan.
    """
    spark.dataSource.register(FileTree)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    lines = {name: "\n".join(x) for name, x in (("suffixes", suffixes), ("prune", prune), ("include", include), ("exclude", exclude))}
    return spark.read.format("file_tree").options(**lines, maxBytes=str(max_bytes)).load(root)
