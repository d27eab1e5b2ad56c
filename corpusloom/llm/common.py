"""Shared pieces of the training-data operators: folds, stored tables, words in Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.sources.tables import discard, shared_dir, stored  # noqa: F401  (for the operators)

#: Words are runs of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"
#: Text handed to one numpy step, in bytes. It bounds a worker's memory and changes no result.
SLICE_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(key: str | Column, n: int) -> Column:
    """crc32 of the key as text, modulo n. A null key counts as empty text."""
    return F.crc32(F.coalesce(F.col(key) if isinstance(key, str) else key, F.lit("")).cast("string").cast("binary")) % n


def small(df: DataFrame, rows: int) -> DataFrame:
    """A stored table, marked for broadcast if it is counted to have `rows` rows at most; joins shuffle it otherwise."""
    return F.broadcast(df) if df.count() <= rows else df


def running(df: DataFrame, order: list[Column], sums: dict[str, Column] | None = None) -> DataFrame:
    """df, stored, with `at`, each row's place from 0 in this order, and the sums of these columns over the rows before it.

    Rows are sorted in parallel; only a row for each task that sorted passes through one window.
    """
    s = stored(df.withColumns(dict(sums or {})).orderBy(*order).withColumn("_m", F.monotonically_increasing_id()), "order")
    s = s.withColumn("_part", F.shiftright("_m", 33))
    names = list(sums or {})
    before = lambda c: F.coalesce(F.sum(c).over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = s.groupBy("_part").agg(F.count("*").alias("_rows"), *(F.sum(x).alias(x) for x in names))
    parts = parts.select("_part", before("_rows").alias("_rows"), *(before(x).alias(f"_before_{x}") for x in names))
    own = Window.partitionBy("_part").orderBy("_m").rowsBetween(Window.unboundedPreceding, -1)
    s = s.withColumns({x: F.coalesce(F.sum(x).over(own), F.lit(0)) for x in names}).join(parts, "_part")
    place = F.col("_rows") + F.col("_m").bitwiseAND(F.lit((1 << 33) - 1))
    return s.withColumns({"at": place} | {x: F.col(x) + F.col(f"_before_{x}") for x in names}).drop("_m", "_part", "_rows", *(f"_before_{x}" for x in names))


def slices(batches: Iterator[pa.RecordBatch], text: str = "text") -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches into runs of rows with about SLICE_BYTES of text each (one row at least)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
        at, ends = 0, np.cumsum(sizes, dtype=np.int64)
        while at < batch.num_rows:
            to = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + SLICE_BYTES, "right"))
            to = min(max(to, at + 1), batch.num_rows)
            yield batch.slice(at, to - at)
            at = to


def _powers(n: int, odd: int) -> np.ndarray:
    out = np.full(n, odd, np.uint64)
    out[0] = 1
    return np.cumprod(out)


_ODD = 0x9E3779B97F4A7C15
_BYTE = np.random.default_rng(7).integers(0, 1 << 64, 256, np.uint64)
_BYTE[65:91] = _BYTE[97:123]  # A-Z count as a-z
_BLANK = np.isin(np.arange(256), [32, 9, 10, 11, 12, 13])
_POWERS: list[np.ndarray] = [np.ones(1, np.uint64)] * 2


def powers(n: int) -> list[np.ndarray]:
    """At least n powers of _ODD and of its inverse. Workers make them on first use; the driver, which hashes nothing, never."""
    if n > len(_POWERS[0]):
        _POWERS[:] = [_powers(2 * max(n, SLICE_BYTES), x) for x in (_ODD, pow(_ODD, -1, 1 << 64))]
    return _POWERS


def _bytes_of(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts in a row, and where each text starts. Null counts as empty."""
    text = pc.fill_null(text.cast(pa.large_string()), "")
    if isinstance(text, pa.ChunkedArray):
        text = text.combine_chunks()
    if not len(text):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1]
    data = np.frombuffer(text.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def words_of(text: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words of all texts in a row: their bytes' holder, start and end in it, and each text's first word.

    Null, empty and blank texts have no words. bounds has one entry more than there are texts.
    """
    data, at = _bytes_of(text)
    full = ~_BLANK[data]
    first = np.zeros(len(data) + 1, bool)
    first[at] = True
    before = np.concatenate([[True], ~full[:-1]]) if len(full) else full
    starts = np.flatnonzero(full & (before | first[:-1]))
    after = np.concatenate([~full[1:], [True]]) if len(full) else full
    ends = np.flatnonzero(full & (after | first[1:])) + 1
    return data, starts, ends, np.searchsorted(starts, at)


def word_hashes(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of each word, A-Z lower-cased, the same in every process, and each text's first word."""
    data, starts, ends, bounds = words_of(text)
    up, down = powers(len(data))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTE[data] * up[: len(data)])])
    h = (sums[ends] - sums[starts]) * down[starts]
    return mix(h + (ends - starts).astype(np.uint64)), bounds


def mix(x: np.ndarray) -> np.ndarray:
    """Scramble 64-bit integers (a finaliser of the murmur kind)."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))
