"""Best-fit packing of documents into fixed-length token sequences by the sum-of-squares rule.

Documents are tokenised where they lie; only (id, piece, length, checksum) rows are shuffled.
Pieces are dealt to shards by a hash, so that neither a long document nor a hot source fills
one task, and each shard packs its pieces, longest first: a piece goes where the sum of the
squared counts of open sequences per remaining gap becomes smallest. A new sequence is opened
only for a piece that fits no open one, since there are to be few. A shard keeps its open
sequences only, never its pieces.
"""

from __future__ import annotations

import base64
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import slices

#: Pieces in a shard (about): open sequences left at a shard's end are the price of packing in parallel.
SHARD_DOCS = 20_000


@lru_cache(maxsize=2)
def encoder(path: str):
    """text -> token ids of the byte-level BPE in a tokenizers file, without special tokens around it.

    Where a ranks file of the same name and vocabulary lies beside it, ids come from that,
    which gives the same ids in a quarter of the time. Texts that hold the string of a special
    token, which the tokenizers library reads as that token, go through the library.
    """
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    slow = lambda t: np.array(tok.encode(t, add_special_tokens=False).ids, np.uint32)
    try:
        lines = open(re.sub(r"\.json$", ".tiktoken", path), "rb").read().splitlines()
    except FileNotFoundError:
        return slow
    import public_tokenizers
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    quick = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    special = [t.content for t in tok.get_added_tokens_decoder().values()]
    return lambda t: slow(t) if any(x in t for x in special) else np.array(quick.encode_ordinary(t), np.uint32)


def pieces(docs: DataFrame, path: str, capacity: int, end_id: int) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): each document's ids and end_id, cut so that only the first piece may be short."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        for b in slices(batches):
            cols: list[list] = [[], [], [], [], []]
            for doc, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
                ids = np.append(encode(text or ""), np.uint32(end_id)).astype("<u4")
                first = len(ids) % capacity or capacity
                edges = [0, *range(first, len(ids) + 1, capacity)]
                for k, (x, y) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
                    for c, v in zip(cols, (doc, k, x, y - x, zlib.crc32(ids[x:y].tobytes())), strict=True):
                        c.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return docs.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


class SumOfSquares:
    """Open sequences by their gap; place() returns (sequence, offset) of a piece."""

    def __init__(self, capacity: int):
        self.capacity, self.made = capacity, 0
        self.count = np.zeros(capacity + 1, np.int64)  # open sequences per gap; a full one isn't open
        self.open: list[list[int]] = [[] for _ in range(capacity + 1)]

    def place(self, length: int) -> tuple[int, int]:
        n, c = self.count, self.capacity
        # Change of the sum when a sequence of gap g becomes one of gap g - length. Ties: the smallest gap.
        change = 2 * (n[: c - length + 1] - n[length:]) + 2
        change[0] -= 1  # filled up, it leaves the counts
        change[n[length:] == 0] = np.iinfo(np.int64).max
        at = int(change.argmin())
        if n[at + length]:
            gap = at + length
            sequence = self.open[gap].pop()
            n[gap] -= 1
        else:
            gap, sequence, self.made = c, self.made, self.made + 1
        if gap > length:
            self.open[gap - length].append(sequence)
            n[gap - length] += 1
        return sequence, c - gap


def pack(parts: DataFrame, capacity: int, shards: int) -> DataFrame:
    """Add sequence_id and offset to pieces with a length of 1 to capacity."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shard, packer = None, SumOfSquares(capacity)
        for frame in frames:
            placed = []
            for s, length in zip(frame["shard"].tolist(), frame["length"].tolist(), strict=True):
                if s != shard:
                    shard, packer = s, SumOfSquares(capacity)
                sequence, offset = packer.place(length)
                placed.append(((s << 40) + sequence, offset))
            frame["sequence_id"], frame["offset"] = np.array(placed, np.int64).reshape(-1, 2).T
            yield frame.drop(columns="shard")

    dealt = parts.withColumn("shard", F.expr(f"pmod(xxhash64(doc_id, piece, ids_crc32), {shards})").cast("long"))
    dealt = dealt.repartition(shards, "shard").sortWithinPartitions("shard", F.desc("length"), "doc_id", "piece", "ids_crc32")
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in parts.schema)
    return dealt.mapInPandas(run, f"{fields}, sequence_id long, offset long")


def best_fit(docs: DataFrame, tokenizer: str, capacity: int = 1024, end_id: int = 2) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) of every piece of docs(doc_id, text, ...).

    Null and empty texts are one piece with the end id alone. Documents of more than capacity
    ids are cut into pieces of capacity, the first of which may be shorter; others stay whole.
    Rows that repeat are packed as often as they occur; a null doc_id stays null. An empty
    table gives an empty result. Reruns give the same places for the same rows. Other columns
    are dropped.
    """
    return pack(pieces(docs, tokenizer, capacity, end_id), capacity, max(1, round(docs.count() / SHARD_DOCS)))
