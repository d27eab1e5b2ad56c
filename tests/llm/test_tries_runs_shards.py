"""Prefix trie, periodic runs and sharding against plain versions, on odd rows and empty tables."""

import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.llm import prefix_trie, queries, runs, sharding

SF = "/root/testdata/sf0.001"
TURNS = "conv_id long, turn int, role string, text string, depth int, at string, block long, _m long"


def plain_trie(rows):
    """Every prefix of every rebuilt conversation, with its members counted one by one."""
    own = {}
    for conv, turn, role, text, *_ in rows:
        if conv is not None:
            own.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(v)] for c, v in own.items()}
    built = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        built[c] = tuple(own.get(c - int(math.fmod(c, 100)), [])[:h] + turns[h:])
    members = {}
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            members.setdefault(turns[:d], set()).add(c)
    out = []
    for p, who in members.items():
        under = [q for q in members if q[: len(p)] == p]
        leaves = sum(not any(len(r) == len(q) + 1 and r[: len(q)] == q for r in members) for q in under)
        saved = sum((len(members[q]) - 1) * len(q[-1][1]) for q in under if q)
        ends = ",".join(str(c) for c in sorted(who) if built[c] == p)
        out.append((min(who), len(p), min(members[p[:-1]]) if p else None, len(who), sum(len(q) == len(p) + 1 for q in under), leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(map(str, out))


def as_rows(df):
    return sorted(str(tuple(r)) for r in df.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256").collect())


@pytest.mark.parametrize(("seg", "bits"), [(prefix_trie.SEG, prefix_trie.BLOCK_BITS), (2, 2), (3, 1)])
def test_trie_against_all_prefixes(spark, seg, bits):
    """Short segments and small blocks split long conversations and hot prefixes; the nodes stay the same."""
    rng, rows = random.Random(5), [(None, 1, "user", "no id", 0, "", 0, 0)]
    for c in [*range(30), 100, 101, 150, 205, -3]:
        for t in range(rng.choice([0, 1, 2, 3, 5, 7, 12])):
            rows.append((c, t if t or c % 3 else None, rng.choice(["u", None, ""]), rng.choice(["", "é" * 9, "a", "a", None]), 1, "x", 2, 3))
    # Very long copies: 8 conversations of 40 equal turns, host and guests.
    rows += [(300 + c, t, "u", "same", 1, "x", 2, 3) for c in range(8) for t in range(40)]
    df = spark.createDataFrame(rows, TURNS)
    assert as_rows(prefix_trie.prefix_trie(df, seg, bits)) == plain_trie(rows)


def test_trie_of_repeated_and_no_turns(spark):
    none = spark.createDataFrame([], TURNS)
    assert prefix_trie.prefix_trie(none).count() == 0
    # Turns that tie are ordered by a hash; equal rows stay turns of their own.
    rows = [(7, 1, "u", "b", 0, "", 0, 0), (7, 1, "u", "a", 0, "", 0, 0), (7, 1, "u", "a", 0, "", 0, 0), (None, None, None, None, 0, "", 0, 0)]
    nodes = prefix_trie.prefix_trie(spark.createDataFrame(rows, TURNS)).collect()
    kept = 3 - zlib.crc32(b"7") % 6 if zlib.crc32(b"7") % 6 < 3 else 0
    assert len(nodes) == kept + 1 and all(n.n_convs == 1 for n in nodes)


def test_registered_trie(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert as_rows(queries.op11_prefix_trie(spark, SF)) == plain_trie(rows)


def plain_runs(s, least):
    """All maximal runs by comparing the words with those p later, for every p."""
    found = {}
    for p in range(1, len(s) // 2 + 1):
        i = 0
        while i + p < len(s):
            j = i
            while j + p < len(s) and s[j] == s[j + p]:
                j += 1
            if j + p - i >= max(least, 2 * p):
                found.setdefault((i, j + p - i), p)
            i = max(j, i + 1)
    return sorted(((i, n, p) for (i, n), p in found.items()), key=lambda x: (x[0], x[2]))


def test_runs_against_all_periods():
    rng = random.Random(3)
    for _ in range(600):
        n, letters = rng.randint(0, 70), rng.randint(1, 4)
        s = [rng.randrange(letters) for _ in range(n)]
        if n and rng.random() < 0.5:
            s = (s[: rng.randint(1, n)] * 70)[:n]
            s[rng.randrange(n)] = rng.choice([s[0], 9])
        least = rng.choice([1, 2, 5, 12])
        assert list(zip(*map(np.ndarray.tolist, runs.runs(np.array(s, np.int64), least)), strict=True)) == plain_runs(s, least)


def test_runs_of_long_words_that_repeat():
    """A square of every period ends at the last word, and Fibonacci words hold a run almost everywhere: neither takes long."""
    n = 50_000
    assert [x.tolist() for x in runs.runs(np.zeros(n, np.int64))] == [[0], [n], [1]]
    assert [x.tolist() for x in runs.runs(np.arange(n) % 777)] == [[0], [n], [777]]
    a, b = [0], [0, 1]
    while len(b) < 2000:
        a, b = b, b + a
    got = runs.runs(np.array(b[:2000]), 1)
    assert list(zip(*map(np.ndarray.tolist, got), strict=True)) == plain_runs(b[:2000], 1)


def plain_row(doc_id, text, looped):
    words = [w for w in (text or "").encode().split()]
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    if looped and doc_id is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    found = plain_runs(words, 12)
    gone = {i for s, m, p in found for i in range(s + p, s + m)}
    best = max(found, key=lambda x: (x[1], -x[0], -x[2]), default=None)
    listed = "".join(f"{s},{m},{p}\n" for s, m, p in found)
    kept = b" ".join(w for i, w in enumerate(words) if i not in gone)
    return (doc_id, len(found), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(kept).hexdigest())


def test_registered_runs(spark):
    docs = [r for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect() if len(r.text) < 12_000]
    got = {r.doc_id: tuple(r) for r in queries.op12_periodic_runs(spark, SF).collect()}
    assert len(got) == spark.read.parquet(f"{SF}/documents.parquet").count()
    assert all(got[r.doc_id] == plain_row(r.doc_id, r.text, True) for r in docs)
    assert sum(x[1] > 0 for x in got.values()) > len(got) // 20


def test_runs_of_odd_rows(spark, odd, none):
    got = sorted(map(tuple, runs.periodic_runs(odd.withColumn("start", F.lit("x")), looped=True).collect()), key=str)
    want = sorted((plain_row(r.doc_id, r.text, True) for r in odd.collect() if r.doc_id != 6), key=str)
    assert [r for r in got if r[0] != 6] == want
    assert [r[1:6] for r in got if r[0] == 6] == [(1, 0, 30_000, 1, 30_000_000)]
    assert runs.periodic_runs(none).count() == 0


@pytest.mark.parametrize(("total", "good", "n"), [(12, 5, 4), (100, 40, 60), (90, 70, 50), (1000, 300, 400)])
def test_hypergeometric_draws(spark, total, good, n):
    """Drawn counts against the exact probabilities: chi-square within five standard deviations."""
    draws = 40_000
    counts = Counter(r[0] for r in spark.range(draws).select(sharding.hypergeometric(*(F.lit(x).cast("long") for x in (total, good, n)), F.xxhash64("id"))).collect())
    law = {k: draws * math.comb(good, k) * math.comb(total - good, n - k) / math.comb(total, n) for k in range(max(0, good + n - total), min(good, n) + 1)}
    assert set(counts) <= set(law)
    large = {k: x for k, x in law.items() if x >= 5}
    chi = sum((counts[k] - x) ** 2 / x for k, x in large.items())
    assert chi < len(large) + 5 * math.sqrt(2 * len(large))


def test_edges_of_draws(spark):
    cases = [(0, 0, 0), (5, 0, 3), (5, 5, 3), (50, 49, 50), (10**12, 1, 10**12), (10**10, 10**9, 10**7)]
    df = spark.createDataFrame(cases, "t long, g long, n long").select("t", "g", "n", sharding.hypergeometric(F.col("t"), F.col("g"), F.col("n"), F.lit(1).cast("long")).alias("k"))
    got = [r.k for r in df.collect()]
    assert got[:5] == [0, 0, 3, 49, 1] and abs(got[5] - 10**6) < 10**4


def test_matrix_has_exact_sums(spark):
    sizes = [k % 7 * 5 for k in range(2100)]
    base, extra = divmod(sum(sizes), 5)
    capacity = [base + (k < extra) for k in range(5)]
    blocks = spark.createDataFrame(list(enumerate(sizes)), "block long, n long")
    rows = {r.block: r.counts for r in sharding.communication_matrix(blocks, capacity, 3).collect()}
    assert [sum(rows[k]) for k in range(2100)] == sizes and [sum(x) for x in zip(*rows.values(), strict=True)] == capacity
    assert min(min(x) for x in rows.values()) >= 0
    # Blocks of 30 rows give a shard 6 of them, with the variance of draws without putting back.
    own = [x[2] for k, x in rows.items() if sizes[k] == 30]
    assert abs(np.mean(own) - 6) < 0.5 and 3.5 < np.var(own) < 6.3


def test_shards_are_exact_and_uniform(spark, odd, none):
    rows = spark.range(4000, numPartitions=5).select(F.col("id").alias("doc_id"), F.lit("x").alias("slot"))
    got = sharding.shuffle_shards(rows, 7, seed=2).toPandas()
    assert sorted(got.doc_id) == list(range(4000)) and sorted(Counter(got.shard).values()) == [571] * 4 + [572] * 3
    assert all(sorted(x.slot) == list(range(len(x))) for _, x in got.groupby("shard"))
    # Neither the shard nor the slot tells where a row came from.
    assert abs(np.corrcoef(got.doc_id, got.shard)[0, 1]) < 0.06 and abs(np.corrcoef(got.doc_id, got.slot)[0, 1]) < 0.06
    again, other = sharding.shuffle_shards(rows, 7, seed=2).toPandas(), sharding.shuffle_shards(rows, 7, seed=3).toPandas()
    key = ["doc_id", "shard", "slot"]
    assert got[key].sort_values(key).values.tolist() == again[key].sort_values(key).values.tolist() != other[key].sort_values(key).values.tolist()
    assert sorted(Counter(r.shard for r in sharding.shuffle_shards(odd, 4).collect()).values()) == [2, 2, 3, 3]
    assert sharding.shuffle_shards(none, 4).count() == 0


def test_registered_shards(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = queries.op13_sharding(spark, SF).collect()
    assert sorted(r.doc_id for r in got) == sorted(docs) and {r.law for r in got} == {"rows"} and {r.grown_shard for r in got} == {None}
    assert all(r.size == len(docs[r.doc_id].encode()) + 1 and r.text_crc32 == zlib.crc32(docs[r.doc_id].encode()) for r in got)
    sizes = Counter(r.shard for r in got)
    assert set(sizes) == set(range(16)) and max(sizes.values()) - min(sizes.values()) <= 1
