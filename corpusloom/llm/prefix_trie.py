"""The trie of all conversations' prefixes, from sorted turn sequences and sparse tables.

Sequences of turn hashes are sorted, so that those which start alike stand together. A block of
sorted sequences has their LCPs with the one before and a sparse table of range minima over them.
Each prefix of each sequence that the one before lacks is a candidate; it binary-searches, in the
sparse table, how far its members reach to the left and to the right, independently of all other
prefixes and with no stack. A member interval gives the number of members, their smallest id
(a second sparse table) and, since candidates in this order stand in preorder, the sums of a subtree.

Prefixes that reach a block's first or last row may go on in other blocks: those pieces, two rows'
prefixes a block at most, are added up by the prefix's digest. Conversations are cut into segments
of SEG turns, keyed by the digest of all turns before, so that no row grows with a conversation.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm.common import running, stored

#: Turns of a segment, and sequences of a block.
SEG = 256
BLOCK_BITS = 12
#: Hosts lend up to HEADS - 1 first turns to the conversations of their hundred.
HEADS, HUNDRED = 6, 100

PARTS = (
    "pid string, ppid string, path array<string>, block long, rep long, seg long, depth long, conv_id long, parent_conv_id long, n_convs long, n_children long, "
    "n_leaves long, saved_tokens long, own_saved long, own_leaf long, points long, ends string, chunk string, next_key string"
)


def turns_of(conversations: DataFrame) -> DataFrame:
    """conv_id, pos (place from 0 by turn, null first; then by hash), h1, h2 (of role and text, null as empty), points (code points of the text). Turns without a conv_id are left out."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    rows = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long"), "turn", F.xxhash64(F.lit(1), role, text).alias("h1"), F.xxhash64(F.lit(2), text, role).alias("h2"), F.char_length(text).cast("long").alias("points"))
    placed = running(rows, [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("h1"), F.col("h2")])
    first = placed.groupBy("conv_id").agg(F.min("at").alias("_first"))
    return placed.join(first, "conv_id").select("conv_id", (F.col("at") - F.col("_first")).alias("pos"), "h1", "h2", "points")


def rebuilt(turns: DataFrame) -> DataFrame:
    """The turns of every conversation c with the first h of conversation c - c % 100 in place of its own first h; h = crc32(c) % 6. A turnless one has one row of a null pos."""
    convs = turns.groupBy("conv_id").agg(F.max("pos").alias("_last")).select("conv_id", (F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEADS).alias("_h"), (F.col("conv_id") - F.col("conv_id") % HUNDRED).alias("_host"))
    heads = turns.where(F.col("pos") < HEADS - 1).groupBy(F.col("conv_id").alias("_host")).agg(F.sort_array(F.collect_list(F.struct("pos", "h1", "h2", "points"))).alias("_heads"))
    heads = heads.where(F.col("_host") % HUNDRED == 0)
    lent = stored(convs.join(heads, "_host", "left").select("conv_id", "_h", F.slice(F.coalesce("_heads", F.expr("array()")), 1, F.col("_h").cast("int")).alias("_lent")), "lent")
    own = turns.join(lent.select("conv_id", "_h", F.size("_lent").alias("_k")), "conv_id").where(F.col("pos") >= F.col("_h"))
    own = own.select("conv_id", (F.col("pos") - F.col("_h") + F.col("_k")).alias("pos"), "h1", "h2", "points")
    return own.unionByName(lent.select("conv_id", F.explode_outer("_lent").alias("x")).select("conv_id", "x.*"))


def segments(turns: DataFrame, seg: int = SEG) -> DataFrame:
    """A row for each segment of each conversation: its turns in order, a key of all turns before it and the points of the last of these.

    A conversation whose last segment is full has an empty one after it.
    """
    turn = F.struct("pos", "h1", "h2", "points")
    place = F.coalesce(F.floor(F.col("pos") / seg), F.lit(0)).cast("long")
    after = turns.where((F.col("pos") + 1) % seg == 0).select("conv_id", F.expr(f"(pos + 1) div {seg}").alias("seg"), F.lit(None).cast("long").alias("pos"), *(F.lit(None).cast("long").alias(c) for c in ("h1", "h2", "points")))
    rows = turns.select("conv_id", place.alias("seg"), "pos", "h1", "h2", "points").unionByName(after)
    rows = rows.groupBy("conv_id", "seg").agg(F.sort_array(F.collect_list(F.when(F.col("pos").isNotNull(), turn))).alias("turns"))
    big = F.col("conv_id").isNull() | (F.col("seg") > 0) | (F.size("turns") == seg)
    rows = stored(rows.withColumn("_long", big), "segments")
    # Keys of long conversations: sums of the digests of segments and their places, 120 bits.
    digest = [F.pmod(F.xxhash64(F.lit(k), "seg", "turns.h1", "turns.h2"), F.lit(1 << 40)) for k in range(3)]
    order = Window.partitionBy("conv_id").orderBy("seg")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    keyed = rows.where("_long").withColumns({f"_d{k}": d for k, d in enumerate(digest)})
    sums = [F.coalesce(F.sum(f"_d{k}").over(before), F.lit(0)) for k in range(3)]
    name = lambda at, add: F.concat_ws(":", at.cast("string"), *((s + (F.col(f"_d{k}") if add else F.lit(0))).cast("string") for k, s in enumerate(sums)))
    key = F.when(F.col("seg") == 0, F.lit("")).otherwise(name(F.col("seg"), False))
    keyed = keyed.select("conv_id", "seg", "turns", key.alias("key"), name(F.col("seg") + 1, True).alias("next_key"), F.coalesce(F.lag(F.try_element_at("turns.points", F.lit(-1))).over(order), F.lit(0)).alias("key_points"))
    short = rows.where("not _long").select("conv_id", "seg", "turns", F.lit("").alias("key"), F.lit("").alias("next_key"), F.lit(0).cast("long").alias("key_points"))
    return short.unionByName(keyed).select("conv_id", "seg", "key", "next_key", "key_points", F.col("turns.h1").alias("h1"), F.col("turns.h2").alias("h2"), F.col("turns.points").alias("points"))


def _minima(x: np.ndarray) -> list[np.ndarray]:
    """Sparse table: least of 1, 2, 4, ... entries from each place."""
    out = [x]
    while 2 << (len(out) - 1) <= len(x):
        last, half = out[-1], 1 << (len(out) - 1)
        out.append(np.minimum(last[: len(last) - half], last[half:]))
    return out


def _extents(table: list[np.ndarray], at: np.ndarray, depth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last row around `at` that share `depth` turns, by two binary searches in the sparse table of LCPs."""
    n = len(table[0])
    left, right = at.copy(), at.copy()
    for k in range(len(table) - 1, -1, -1):
        row, w = table[k], 1 << k
        go = left - w + 1 >= 1
        go &= row[np.where(go, left - w + 1, 0)] >= depth
        left = left - np.where(go, w, 0)
        go = right + w <= n - 1
        go &= row[np.where(go, right + 1, 0)] >= depth
        right = right + np.where(go, w, 0)
    return left, right


def _least(table: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Least entry of each range."""
    k = np.frexp((right - left + 1).astype(np.float64))[1] - 1
    out = np.empty(len(left), np.int64)
    for j in np.unique(k):
        own = k == j
        out[own] = np.minimum(table[j][left[own]], table[j][right[own] - (1 << j) + 1])
    return out


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values of all lists in a row, and where each list starts."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    offsets = column.offsets.to_numpy()
    return column.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]], (offsets - offsets[0]).astype(np.int64)


def _digest(so_far: bytes, *parts: object) -> bytes:
    return hashlib.blake2b(so_far + repr(parts).encode(), digest_size=16).digest()


def block_nodes(rows: pa.Table, seg_turns: int) -> pa.RecordBatch:
    """The nodes of one block of sorted segments: finished ones, and pieces (with a pid) of those that reach its first or last row.

    Of a piece, n_children, n_leaves and saved_tokens count only what is finished below it in this block.
    """
    n = rows.num_rows
    column = lambda c: rows.column(c).to_numpy()
    conv, seg, x_saved, x_leaves, key_points = (column(c).astype(np.int64) for c in ("conv_id", "seg", "x_saved", "x_leaves", "key_points"))
    keys, next_keys = rows.column("key").to_pylist(), rows.column("next_key").to_pylist()
    block = int(column("block")[0])
    h1, at = _lists(rows.column("h1"))
    h2, points = _lists(rows.column("h2"))[0], _lists(rows.column("points"))[0]
    size = np.diff(at)
    # LCP with the row before; -1 where another segment's or key's rows begin, and at the block's first row.
    lcp = np.full(n, -1, np.int64)
    near = np.minimum(size[1:], size[:-1])
    same_key = np.array([seg[i] == seg[i - 1] and keys[i] == keys[i - 1] for i in range(1, n)], bool)
    width = int(near.max(initial=0))
    step = np.arange(width)
    inside = step < near[:, None]
    a, b = np.where(inside, at[1:-1, None] + step, 0), np.where(inside, at[:-2, None] + step, 0)
    if width and len(h1):
        equal = inside & (h1[a] == h1[b]) & (h2[a] == h2[b])
        shared = np.where(equal.all(1), width, np.argmin(equal, 1))
    else:
        shared = np.zeros(n - 1, np.int64)
    lcp[1:] = np.where(same_key, shared, -1)
    table, ids = _minima(lcp), _minima(conv)
    # Candidates: each row's prefixes that the row before lacks, by row and depth, which is preorder.
    count = size - lcp
    row = np.repeat(np.arange(n), count)
    depth = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count) + lcp[row] + 1
    left, right = _extents(table, row, depth)
    parent_left, parent_right = _extents(table, row, np.maximum(depth - 1, 0))
    conv_min, parent_min = _least(ids, left, right), _least(ids, parent_left, parent_right)
    members = right - left + 1
    opened = (left == 0) | (right == n - 1)
    parent_open = (depth > 0) & ((parent_left == 0) | (parent_right == n - 1))
    bridge = depth == seg_turns  # counted as the first node of the next segment
    point = np.where(depth > 0, points[np.where(depth > 0, at[row] + depth - 1, 0)] if len(points) else 0, key_points[row])
    # Children, told by their parent's left end and depth.
    wide = seg_turns + 2
    code = left * wide + depth
    order = np.argsort(code, kind="stable")
    sorted_code = code[order]
    child = np.flatnonzero(depth > 0)
    found = order[np.searchsorted(sorted_code, parent_left[child] * wide + depth[child] - 1)]
    mine = ~(opened[child] & opened[found])  # an open child of an open parent is counted when pieces are added up
    children = np.bincount(found[mine], minlength=len(row))
    own_saved = np.where(bridge | opened, 0, (members - 1) * point)
    own_leaf = np.where(bridge | opened, 0, children == 0).astype(np.int64)
    total = lambda x: np.concatenate([[0], np.cumsum(x)])
    end = np.cumsum(count)[right]
    start = np.arange(len(row))

    def below(own: np.ndarray, more: np.ndarray) -> np.ndarray:
        nodes, longer = total(own), total(more)
        return nodes[end] - nodes[start] + longer[right + 1] - longer[left]

    saved, leaves = below(own_saved, x_saved), below(own_leaf, x_leaves)
    # Names of the prefixes of the first and the last row.
    names: dict[int, str] = {}
    paths: dict[int, list[str]] = {}
    for r in {0, n - 1}:
        so_far, path = b"", []
        for d in range(int(size[r]) + 1):
            so_far = _digest(so_far, int(seg[r]), keys[r]) if d == 0 else _digest(so_far, int(h1[at[r] + d - 1]), int(h2[at[r] + d - 1]))
            lo, _ = _extents(table, np.array([r]), np.array([d]))
            k = int(order[np.searchsorted(sorted_code, int(lo[0]) * wide + d)])
            names[k], paths[k] = so_far.hex(), list(path)
            path.append(so_far.hex())
    parent = np.full(len(row), -1, np.int64)
    parent[child] = found
    # Equal rows stand together, by id: those that end at a prefix are the first of its rows.
    last_equal = np.arange(n)
    equal_next = np.concatenate([(lcp[1:] == size[1:]) & (size[1:] == size[:-1]), [False]])
    breaks = np.flatnonzero(~equal_next)
    last_equal = breaks[np.searchsorted(breaks, last_equal)]
    out: list[tuple] = []
    for k, (i, d) in enumerate(zip(row.tolist(), depth.tolist(), strict=True)):
        pid, up = names.get(k), names.get(int(parent[k]))
        path = paths.get(k)
        above = int(parent_min[k]) if d > 0 and not up else None
        if bridge[k]:
            out.append((pid, up, path, block, None, int(seg[i]), None, None, above, *[None] * 9, next_keys[i]))
            continue
        listed = ",".join(map(str, conv[i : last_equal[i] + 1].tolist())) if size[i] == d else ""
        ends, chunk = (None, listed) if pid else (hashlib.sha256(listed.encode()).hexdigest(), None)
        sums = (int(x[k]) for x in (members, children, leaves, saved, own_saved, own_leaf, point))
        out.append((pid, up, path, block, int(conv[i]), int(seg[i]), int(seg[i]) * seg_turns + d, int(conv_min[k]), above, *sums, ends, chunk, keys[i] if d == 0 and seg[i] else None))
    schema = pa.schema([pa.field(c.split()[0], {"string": pa.string(), "long": pa.int64(), "array<string>": pa.list_(pa.string())}[c.split()[1]]) for c in PARTS.split(", ")])
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)


def _ends(parts: DataFrame) -> DataFrame:
    """pid, ends: the digest of the ids listed in a prefix's pieces, block after block. The text of ids is never held as a whole."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, state, empty = None, hashlib.sha256(), True
        for batch in batches:
            done: list[tuple[str, str]] = []
            for pid, chunk in zip(batch.column("pid").to_pylist(), batch.column("chunk").to_pylist(), strict=True):
                if pid != of:
                    if of is not None:
                        done.append((of, state.hexdigest()))
                    of, state, empty = pid, hashlib.sha256(), True
                if chunk:
                    state.update(chunk.encode() if empty else b"," + chunk.encode())
                    empty = False
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in done], pa.string()), pa.array([x[1] for x in done], pa.string())], ["pid", "ends"])
        if of is not None:
            yield pa.RecordBatch.from_arrays([pa.array([of]), pa.array([state.hexdigest()])], ["pid", "ends"])

    return parts.select("pid", "block", "chunk").repartition("pid").sortWithinPartitions("pid", "block").mapInArrow(work, "pid string, ends string")


def _nodes(rows: DataFrame, seg: int, block_bits: int) -> DataFrame:
    """All nodes of these segments; x_saved and x_leaves are what lies below each row in later segments."""
    ordered = rows.orderBy("seg", "key", F.arrays_zip("h1", "h2"), "conv_id").withColumn("_m", F.monotonically_increasing_id())
    rows = stored(ordered, "sorted").withColumn("block", F.shiftright("_m", block_bits))

    def work(table: pa.Table) -> pa.Table:
        return pa.Table.from_batches([block_nodes(table.sort_by("_m"), seg)])

    parts = stored(rows.groupBy("block").applyInArrow(work, PARTS), "parts")
    pieces = parts.where("pid is not null and depth is not null")
    first = ["seg", "depth", "points", "ppid", "path"]
    merged = pieces.groupBy("pid").agg(
        *(F.max(c).alias(c) for c in first), F.min("conv_id").alias("conv_id"), F.sum("n_convs").alias("n_convs"), F.sum("n_children").alias("n_children"),
        F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens"), F.max("next_key").alias("next_key"), F.min_by("rep", F.struct("block", "rep")).alias("rep"),
    )
    more = parts.where("pid is not null and ppid is not null").select("pid", "ppid").distinct().groupBy(F.col("ppid").alias("pid")).agg(F.count("*").alias("_more"))
    merged = merged.join(more, "pid", "left").withColumn("n_children", F.col("n_children") + F.coalesce("_more", F.lit(0))).drop("_more")
    merged = merged.withColumns({"own_saved": (F.col("n_convs") - 1) * F.col("points"), "own_leaf": (F.col("n_children") == 0).cast("long")})
    merged = stored(merged.join(_ends(pieces), "pid"), "merged")
    up = merged.select(F.explode(F.concat("path", F.array("pid"))).alias("pid"), "own_saved", "own_leaf").groupBy("pid").agg(F.sum("own_saved").alias("_s"), F.sum("own_leaf").alias("_l"))
    merged = merged.join(up, "pid").withColumns({"saved_tokens": F.col("saved_tokens") + F.col("_s"), "n_leaves": F.col("n_leaves") + F.col("_l"), "parent_conv_id": F.lit(None).cast("long")})
    keep = ["seg", "rep", "depth", "conv_id", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "own_saved", "own_leaf", "ends", "next_key", "ppid", "pid"]
    every = parts.where("pid is null or depth is null").select(*keep).unionByName(merged.select(*keep))
    every = stored(every, "every")
    parents = merged.select(F.col("pid").alias("ppid"), F.col("conv_id").alias("_p"))
    return _filled(every, "ppid", parents).drop("ppid")


def _filled(nodes: DataFrame, key: str, parents: DataFrame) -> DataFrame:
    """nodes with the parents(key, _p) of those that have a key. Most have none, so those stay out of the join, where they would be one key."""
    found = nodes.where(f"{key} is not null").join(parents, key, "left").withColumn("parent_conv_id", F.coalesce("parent_conv_id", "_p"))
    return nodes.where(f"{key} is null").unionByName(found.select(*nodes.columns))


def prefix_trie(conversations: DataFrame, seg: int = SEG, block_bits: int = BLOCK_BITS) -> DataFrame:
    """A row for each distinct sequence of first turns of the rebuilt conversations (see `rebuilt`): members, children, leaves, tokens saved by sharing, digest of the members that end there.

    A null role or text counts as empty, and turns of one number are ordered by a hash; equal rows are turns of their own.
    Turns without a conv_id take no part. A conversation may have no turn left: it is a member of the root. No rows give no
    nodes. Turns that hash alike in 128 bits count as equal. Other columns are not looked at. The ids below one prefix's
    digest are hashed by one task, in order, a piece for each block: that digest can't be computed in parallel.
    """
    rows = stored(segments(rebuilt(stored(turns_of(conversations), "turns")), seg), "keyed")
    zero = F.lit(0).cast("long")
    late = rows.where("seg > 0")
    if late.limit(1).count():
        # What lies below a row in later segments: nodes are credited to one of their members each.
        credit = _nodes(late.withColumns({"x_saved": zero, "x_leaves": zero}), seg, block_bits).where("depth is not null").groupBy(F.col("rep").alias("conv_id"), "seg").agg(F.sum("own_saved").alias("_s"), F.sum("own_leaf").alias("_l"))
        after = Window.partitionBy("conv_id").orderBy(F.desc("seg")).rowsBetween(Window.unboundedPreceding, -1)
        both = rows.join(late.select("conv_id").distinct(), "conv_id", "left_semi").join(credit, ["conv_id", "seg"], "left")
        below = both.select("conv_id", "seg", *(F.coalesce(F.sum(c).over(after), F.lit(0)).alias(x) for c, x in (("_s", "x_saved"), ("_l", "x_leaves"))))
        rows = rows.join(below, ["conv_id", "seg"], "left").fillna(0, ["x_saved", "x_leaves"])
    else:
        rows = rows.withColumns({"x_saved": zero, "x_leaves": zero})
    nodes = stored(_nodes(rows, seg, block_bits), "nodes")
    # The parent of a later segment's first node is the last but one of the segment before.
    bridges = nodes.where("depth is null").groupBy("next_key").agg(F.min("parent_conv_id").alias("_p"))
    nodes = _filled(nodes.where("depth is not null"), "next_key", bridges)
    return nodes.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.col("ends").alias("ends_sha256"))
