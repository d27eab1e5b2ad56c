"""The ten operators on odd rows and empty tables, and against brute force on small tables."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

from corpusloom.llm import fingerprints, langid, lm, mixing, ngram_join, packing, rollups, topk, toxicity, url_filters

PATH = public_tokenizers.path("byte_bpe_50k.json")
WORDS = re.compile("[^\x20\x09-\x0d]+")


def low(text):
    return re.sub("[A-Z]+", lambda m: m[0].lower(), text or "")


def test_url_parts_and_longest_rule(spark):
    urls = ["HTTP://User@Ex.ORG:80/Es/x?q#f", None, "no scheme", "http://a.example.org/es/1", "http://org", "x://badexample.org/es/", "http://com/fr/?a://b", "http://shop.com/de/9", "http://é.net/q"]
    pages = spark.createDataFrame([(i, u, "h") for i, u in enumerate(urls)], "page_id long, url string, verdict string")
    rules = [("allow", "org/"), ("block", "example.org/es/"), ("allow", "com/fr/"), ("block", "com/de/")]
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filters.judge(pages, rules).collect()}
    assert got[0][:3] == ("user@ex.org:80", "/Es/x", None)
    assert got[1][:3] == got[2][:3] == ("", "", None)
    assert got[3] == ("a.example.org", "/es/1", "example.org/es/", "block")
    assert got[4][:3] == ("org", "", None)
    assert got[5][2:] == ("org/", "allow")
    assert got[6] == ("com", "/fr/", "com/fr/", "allow") and got[7][2:] == ("com/de/", "block")
    assert url_filters.judge(pages.limit(0), rules).count() == 0


def test_mined_rules_against_brute_force(spark):
    rng = random.Random(1)
    rows = []
    for _ in range(300):
        items = rng.sample("abcde", rng.randint(1, 4))
        rows.append((items, "block" if "a" in items and "b" in items and rng.random() < 0.9 else "allow"))
    got = {(tuple(r["items"]), r.verdict): (round(r.confidence, 9), round(r.support, 9)) for r in url_filters.mine(spark.createDataFrame(rows, "tokens array<string>, verdict string"), 0.05, 0.6)[0].collect()}
    from itertools import combinations

    every = {}
    for n in range(1, 6):
        for c in combinations("abcde", n):
            hit = [v for i, v in rows if set(c) <= set(i)]
            for v in ("allow", "block"):
                k = hit.count(v)
                if k and k / 300 >= 0.05 and k / len(hit) >= 0.6:
                    every[c, v] = (round(k / len(hit), 9), round(k / 300, 9))
    want = {k: x for k, x in every.items() if not any(every.get((s, k[1]), (-1,))[0] >= x[0] for s in combinations(k[0], len(k[0]) - 1))}
    assert got == want


def test_mined_rules_of_nearly_equal_paths(spark):
    """A site of one verdict whose paths differ by single parts: a rule for each part, not one for each subset of 25."""
    rng = random.Random(6)
    parts = [f"p{k}" for k in range(25)]
    rows = [([p for p in parts if rng.random() > 0.05] + ["h"], "block") for _ in range(2000)] + [(["h", f"x{k % 3}"], "allow" if k % 2 else "block") for k in range(500)]
    rules = url_filters.mine(spark.createDataFrame(rows, "tokens array<string>, verdict string"))[0].collect()
    assert {tuple(r["items"]) for r in rules if r.confidence == 1.0} == {(p,) for p in parts} and len(rules) < 40


def test_matching_against_brute_force(spark):
    """Every rule is kept, whatever its place in the URL, and the best one judges."""
    rng = random.Random(11)
    letters = [f"t{k}" for k in range(30)]
    rows = []
    for k in range(400):
        tokens = rng.sample(letters, rng.randint(3, 20))
        rows.append((k, tokens, None if k % 4 == 0 else "block" if "t28" in tokens or "t29" in tokens and "t3" in tokens else "allow"))
    rows += [(400 + k, [f"deep{j}" for j in range(60)], "block") for k in range(60)] + [(500, [f"deep{j}" for j in range(59)], None), (501, [], None), (502, ["new"], None)]
    df = spark.createDataFrame(rows, "row long, tokens array<string>, verdict string")
    rules, items = url_filters.mine(df.select("tokens", "verdict"), 0.1, 0.6)
    item = {r.token: r["item"] for r in items.collect()}
    assert len({item[f"deep{j}"] for j in range(60)}) == 1
    kept = rules.collect()
    want = {}
    for k, tokens, verdict in rows:
        own = {item[t] for t in tokens if t in item}
        hits = [(r.confidence, r.support, r["items"], r.verdict) for r in kept if set(r["items"]) <= own]
        if verdict is None and hits:
            want[k] = max(hits)[3]
    got = {r.row: r.verdict for r in url_filters.match(df.where("verdict is null"), "row", rules, items).collect()}
    assert got == want and got[500] == "block" and 502 not in got and len(got) > 50


def test_urls_that_repeat_and_long_ones(spark):
    pages = spark.createDataFrame([(1, "http://a.org/x"), (1, "http://a.org/x"), (None, "http://com/de/" + "p/" * 20_000), (2, "http://" + "h." * 2000 + "net/")], "page_id long, url string")
    got = sorted((str(r.page_id), r.verdict, len(r.path)) for r in url_filters.judge(pages, [("allow", "org/"), ("block", "com/de/")]).collect())
    assert got == [("1", "allow", 2), ("1", "allow", 2), ("2", "allow", 1), ("None", "block", 40_004)]


def test_packing(odd, none):
    rows = packing.best_fit(odd, PATH, 64).collect()
    assert packing.best_fit(none, PATH).count() == 0
    bins = {}
    for r in rows:
        assert 1 <= r.length <= 64
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in bins.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= 64
    from tokenizers import Tokenizer

    ids = [*Tokenizer.from_file(PATH).encode("one two three four five six", add_special_tokens=False).ids, 2]
    four = [r for r in rows if r.doc_id == 4]
    assert len(four) == 2 and all((r.start, r.length, r.ids_crc32) == (0, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())) for r in four)
    assert [r.length for r in rows if r.doc_id in (1, 2)] == [1, 1]


def test_packing_opens_few_sequences(spark):
    """Every id of sf0.01 is the library's, and sequences are few: at most 0.5 % above what the tokens need."""
    from tokenizers import Tokenizer

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = packing.best_fit(docs, PATH).toPandas()
    assert rows["sequence_id"].nunique() <= math.ceil(rows["length"].sum() / 1024) * 1.005
    tok, want = Tokenizer.from_file(PATH), {}
    for r in docs.collect():
        want[r.doc_id] = np.array([*tok.encode(r.text or "", add_special_tokens=False).ids, 2], "<u4")
    for r in rows.itertuples():
        assert zlib.crc32(want[r.doc_id][r.start : r.start + r.length].tobytes()) == r.ids_crc32


def test_encoder_reads_special_strings_like_the_library():
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(PATH)
    for text in ["a<|endoftext|>b", "Grüße  \n\n an 東京!", "", " x"]:
        assert packing.encoder(PATH)(text).tolist() == tok.encode(text, add_special_tokens=False).ids


def test_sum_of_squares_takes_the_smallest_sum():
    rng = random.Random(2)
    packer, gaps = packing.SumOfSquares(20), Counter()
    for _ in range(300):
        length = rng.randint(1, 20)
        tried = {}
        for gap in [g for g, n in gaps.items() if n and g >= length] or [20]:
            c = Counter(gaps)
            if gap < 20:
                c[gap] -= 1
            if gap - length:
                c[gap - length] += 1
            tried[gap] = sum(n * n for g, n in c.items() if 0 < g < 20)
        _, offset = packer.place(length)
        gap = 20 - offset
        assert tried[gap] == min(tried.values())
        if gap < 20:
            gaps[gap] -= 1
        if gap - length:
            gaps[gap - length] += 1


def test_language_id(spark, odd, none):
    model = langid.prototypes(odd)
    got = langid.identify(odd, model).collect()
    assert {r.doc_id for r in got if r.lang_pred == "und"} == {1, 2, 3, 9} and all(0 <= r.score <= 1 for r in got)
    assert langid.identify(none, langid.prototypes(none)).count() == 0
    assert {r.lang_pred for r in langid.identify(odd, ([], np.zeros((0, langid.DIM)))).collect()} == {"und"}
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = langid.prototypes(docs.where("doc_id % 2 = 0"))
    held = langid.identify(docs.where("doc_id % 2 = 1"), model).select("lang", "lang_pred").collect()
    assert np.mean([r.lang == r.lang_pred for r in held]) > 0.97


def test_prototypes_are_sums_of_trigram_vectors(spark):
    """Vectors of texts, prototypes, nearest language and cosine by loops over letters."""
    rng = random.Random(8)
    docs = [(k, "".join(rng.choice("abcé 1-Z") if k % 2 else rng.choice("xyzß .Q") for _ in range(rng.randint(1, 40))), "ab"[k % 2]) for k in range(60)]

    def vector(text):
        letters = re.sub(" +", " ", "".join(c.lower() if c.isalpha() else " " for c in f" {text} "))
        v = np.zeros(langid.DIM)
        for i in range(len(letters) - 2):
            v += np.roll(langid._letter(ord(letters[i])), 2) * np.roll(langid._letter(ord(letters[i + 1])), 1) * langid._letter(ord(letters[i + 2]))
        return v / (np.linalg.norm(v) or 1)

    want = {x: sum(vector(t) for _, t, lang in docs if lang == x) for x in "ab"}
    want = {x: v / np.linalg.norm(v) for x, v in want.items()}
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    langs, protos = langid.prototypes(df)
    assert langs == ["a", "b"] and np.allclose(protos, [want["a"], want["b"]], atol=1e-4)
    for r in langid.identify(df, (langs, protos)).collect():
        cosines = {x: float(vector(r.text) @ v) for x, v in want.items()}
        if np.any(vector(r.text)):
            assert abs(r.score - max(0, max(cosines.values()))) < 1e-3 and cosines[r.lang_pred] > max(cosines.values()) - 1e-3


def test_winnowing_against_brute_force(spark, odd, none):
    import xxhash

    def plain(text, k=fingerprints.K, w=fingerprints.W):
        units = [u for word in re.findall(r"[^ \t\n\x0b\f\r]+", text) for u in ([word] if len(word) <= fingerprints.UNIT else word)]
        ids = [(h - (1 << 64) if h >> 63 else h) % (fingerprints.PRIME - 1) + 1 for h in (xxhash.xxh64_intdigest(u.encode(), seed=42) for u in units)]
        ids += [0] * (k - len(ids)) if ids else []
        hashes = [sum(x * fingerprints.BASE ** (k - 1 - j) for j, x in enumerate(ids[i : i + k])) % fingerprints.PRIME for i in range(len(ids) - k + 1)]
        out = {}
        for i in range(max(1, len(hashes) - w + 1)) if hashes else []:
            part = hashes[i : i + w]
            at = i + max(j for j, x in enumerate(part) if x == min(part))
            out[at] = hashes[at]
        return list(out.values()), list(out)

    rng = random.Random(3)
    texts = ["", " ", "a", "ab cd", "aa " * 50, "é" * 5000, " ".join(rng.choice(["x", "yy", "zzz", "longerword"]) for _ in range(3000))]
    for r in fingerprints.fingerprints(spark.createDataFrame([(t,) for t in texts], "text string")).collect():
        assert ([x >> 32 & 0xFFFFFFFF for x in r.fingerprint], [x & 0xFFFFFFFF for x in r.fingerprint]) == plain(r.text)
    # A character put into text without blanks changes what is near it alone.
    long = "".join(chr(rng.randrange(0x4E00, 0x9000)) for _ in range(3000))
    a, b = ({x >> 32 for x in r.fingerprint} for r in fingerprints.fingerprints(spark.createDataFrame([(long,), ("東" + long[:1500] + "京" + long[1500:],)], "text string")).collect())
    assert len(a & b) / len(a | b) > 0.97
    got = fingerprints.compare_edited(odd).collect()
    assert len(got) == odd.count() and fingerprints.compare_edited(none).count() == 0
    import hashlib

    rows = sorted([(r.doc_id, r.text or "") for r in odd.collect() if r.doc_id is not None])
    want = Counter()
    for k, (i, t) in enumerate(rows):
        half = len(t) // 2
        want[i, hashlib.sha256((t[: len(t) - half] + rows[(k + 1) % len(rows)][1][:half]).encode()).hexdigest()] += 1
    assert Counter((r.doc_id, r.edited_sha256) for r in got if r.doc_id is not None) == want


@pytest.mark.parametrize(("words", "least", "sizes"), [(3, 0.9, (256, 16, 4, 20_000)), (3, 0.9, (8, 2, 1, 0)), (5, 0.8, (4, 2, 1, 20_000))])
def test_jaccard_components_against_brute_force(spark, odd, none, words, least, sizes):
    rng = random.Random(4)
    base = [[rng.choice("abcdefgh") * rng.randint(1, 3) for _ in range(60)] for _ in range(8)]
    rows = [(i, "") for i in range(3)]
    for k in range(3, 150):
        text = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 1, 2, 6])):
            text[rng.randrange(60)] = rng.choice("ijkl")
        rows.append((k, " ".join(text[: rng.choice([60, 60, 58, 1, 2])])))
    kept = ngram_join.CELL, ngram_join.LEAF, ngram_join.FIRST_PAIRS, ngram_join.ORDER_DOCS
    ngram_join.CELL, ngram_join.LEAF, ngram_join.FIRST_PAIRS, ngram_join.ORDER_DOCS = sizes
    try:
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), words, least).collect()}
    finally:
        ngram_join.CELL, ngram_join.LEAF, ngram_join.FIRST_PAIRS, ngram_join.ORDER_DOCS = kept
    sets = {}
    for i, t in rows:
        w = WORDS.findall(low(t))
        sets[i] = {tuple(w[j : j + words]) for j in range(len(w) - words + 1)} if len(w) >= words else {tuple(w)} if w else set()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= round(100 * least) * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    assert got == {i: (len(s), find(i)) for i, s in sets.items()}
    strange = ngram_join.jaccard_components(odd, words, least).collect()
    assert sorted((r.doc_id, r.component_id) for r in strange if r.doc_id is not None) == [(1, 1), (2, 2), (3, 3), (4, 4), (4, 4), (6, 6), (7, 7), (8, 4), (9, 9)]
    assert [r.component_id for r in strange if r.doc_id is None] == [None]
    assert ngram_join.jaccard_components(none, words, least).count() == 0


def test_rtree_loses_no_pair():
    rng = np.random.default_rng(5)
    points = rng.poisson(3, (300, ngram_join.GROUPS)).astype(np.int32)
    points[150:] = np.maximum(0, points[:150] + rng.integers(-1, 2, (150, ngram_join.GROUPS)) * (rng.random((150, ngram_join.GROUPS)) < 0.1))
    points = points[np.arange(300).reshape(2, 150).T.ravel()]  # each next to the one made from it
    n = points.sum(1)
    tree = ngram_join.RTree(points, n)
    allowed = lambda q, m: (190 * np.minimum(points, q).sum(1) >= 90 * (n + m)) & (100 * np.minimum(n, m) >= 90 * np.maximum(n, m))
    for k in range(0, 300, 7):
        # The tree may keep rows of a leaf that sizes alone would rule out.
        got = set(tree.search(points[k], int(n[k]), 90).tolist())
        assert set(np.flatnonzero(allowed(points[k], n[k])).tolist()) <= got <= set(np.flatnonzero(190 * np.minimum(points, points[k]).sum(1) >= 90 * (n + n[k])).tolist())
    for cell in (np.zeros(300, np.int64), np.arange(300) // 12):
        i, j = ngram_join.cell_pairs(cell, n, points, 90)
        want = {(a, b) for a in range(300) for b in np.flatnonzero(allowed(points[a], n[a])).tolist() if b < a and cell[a] == cell[b]}
        assert set(zip(i.tolist(), j.tolist())) == want and len(want) >= 5


def test_count_blobs_are_never_below_the_counts():
    rng = np.random.default_rng(6)
    for size in (1, 40, 3000, 60_000):
        s = np.unique(rng.integers(0, 1 << 64, size, np.uint64))
        c = np.bincount((s >> np.uint64(40)).astype(np.int64) % ngram_join.GROUPS, minlength=ngram_join.GROUPS)
        got = ngram_join.points_of(pa.array([ngram_join.count_blob(s)]))[0]
        assert (got >= c).all() and got.sum() <= 1.3 * c.sum() + ngram_join.GROUPS


def test_cells_keep_neighbours_together():
    """Batches of any size give the same nodes a shingle, cut where sizes leave a gap."""
    rng = random.Random(12)
    rows = sorted({(rng.choice([-5, 3, 9, 11]) << ngram_join.SIZE_BITS | rng.choice([10, 100, 104, 111, 112, 500]), rng.randrange(60)) for _ in range(400)} | {(77 << ngram_join.SIZE_BITS | 9, 1)})
    x, nid = (np.array(c, np.int64) for c in zip(*rows))
    for step in (1, 7, 1000):
        kept, ngram_join.CELL = ngram_join.CELL, 16
        try:
            batches = (pa.RecordBatch.from_arrays([pa.array(x[k : k + step]), pa.array(nid[k : k + step])], ["x", "nid"]) for k in range(0, len(x), step))
            got = [r for b in ngram_join._cells(90)(batches) for r in b.to_pylist()]
        finally:
            ngram_join.CELL = kept
        assert all(len(r["nids"]) <= 16 for r in got)
        have = Counter((r["s"], i) for r in got for i in r["nids"])
        assert have[77, 1] == 1  # at the partition's end its shingle may go on
        size = {(v >> ngram_join.SIZE_BITS, i): v & ngram_join.SIZE for v, i in rows}
        for s in (-5, 3, 9, 11):
            assert sum(k for (t, _), k in have.items() if t == s) == sum(v >> ngram_join.SIZE_BITS == s for v, _ in rows)
    assert len(size) > 100


def test_mixing(odd, none):
    assert mixing.mix(none).count() == 0
    rows = mixing.mix(odd).collect()
    again = mixing.mix(odd.repartition(3)).collect()
    key = lambda r: (r.doc_id is None, r.doc_id, r.size, r.taken)
    assert sorted(map(tuple, rows), key=str) == sorted(map(tuple, again), key=str) and len(rows) == 10
    assert all(0 <= r.taken <= 2 * r.size for r in sorted(rows, key=key))
    for source in {r.source for r in rows}:
        own = [r for r in rows if r.source == source]
        assert abs(sum(r.taken for r in own) - own[0].target) <= mixing.BLOCK / 2 + 1


def test_apportionment_against_highest_quotients(spark):
    from pyspark.sql import functions as F

    rng = random.Random(10)
    cases = [([503.0, 301.0, 120.5, 44.0, 3.0, 0.0], 97), ([1000.0, *[0.6] * 40], 1024), ([1.0] * 7, 3), ([5.0, 5.0, 0.0], 0), ([rng.random() ** 6 for _ in range(60)], 500)]
    rows = [(c, k, t, seats) for c, (shares, seats) in enumerate(cases) for k, t in enumerate(shares)]
    df = spark.createDataFrame(rows, "c int, k int, t double, seats long")
    grouped = {(r.c, r.k): r.quota for r in mixing.apportion(df, ["c"], F.col("t"), F.col("seats"), ["k"]).collect()}
    for c, (shares, seats) in enumerate(cases):
        want = Counter()
        for _ in range(seats):
            want[max((k for k, t in enumerate(shares) if t), key=lambda k: (shares[k] / (2 * want[k] + 1), -k))] += 1
        assert {k: grouped[c, k] for k in range(len(shares))} == {k: want[k] for k in range(len(shares))}
        if c < 2:
            alone = mixing.apportion(df.where(F.col("c") == c), [], F.col("t"), F.lit(seats), ["k"])
            assert {r.k: r.quota for r in alone.collect()} == {k: want[k] for k in range(len(shares))}


def test_mix_targets_against_plain_levels(spark):
    sizes = {"a": 1000, "b": 10, "c": 400, "d": 30, None: 700, "e": 0}
    docs = spark.createDataFrame([(i, " ".join("w" * n), s) for i, (s, n) in enumerate(sizes.items())], "doc_id long, text string, source string")
    got = {r.source: (r.target, r.taken, r.size) for r in mixing.mix(docs).collect()}
    order = sorted((s for s in sizes if s is not None)) + [None]
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    target, goal, free = {}, 1.5 * sum(sizes.values()), set(order)
    while True:
        level = (goal - sum(target.values())) / sum(weight[s] for s in free)
        over = {s for s in free if level * weight[s] > 2 * sizes[s]}
        if not over:
            break
        target |= {s: 2.0 * sizes[s] for s in over}
        free -= over
    target |= {s: level * weight[s] for s in free}
    for s, (t, taken, size) in got.items():
        assert t == pytest.approx(target[s]) and abs(taken - t) <= mixing.BLOCK / 2 + 1 and taken <= 2 * size


def test_top_k_against_brute_force(spark):
    rng = random.Random(6)
    rows = [(i, [rng.choice([0.1, -0.3, 0.25, 0.5]) for _ in range(6)]) for i in range(120)]
    rows += [(200, None), (201, [None, 1.0]), (202, [float("nan")] * 6), (203, [float("inf")] * 6), (204, []), (250, [1.0, 2.0])]
    df = topk.whole_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), "vec_id", "embedding", 256)
    df = df.unionByName(df.where("id in (7, 50)"))  # repeated ids: each candidate stands for itself, a query is taken once
    topk.SHARD_ROWS, topk.LEAF, kept = 30, 4, (topk.SHARD_ROWS, topk.LEAF)
    try:
        got = sorted(map(tuple, topk.top_k(df, df.where("id % 50 = 0"), 5).collect()))
    finally:
        topk.SHARD_ROWS, topk.LEAF = kept
    v = {i: [math.floor(256 * float(np.float32(x))) for x in e] for i, e in rows[:120]}
    want = []
    for q in (0, 50, 100):
        best = sorted((-sum(a * b for a, b in zip(v[q], v[i])), i) for i in [*v, 7, 50] if i != q)[:5]
        want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(best)]
    assert got == sorted(want)
    assert topk.top_k(df.limit(0), df.limit(0), 5).count() == 0


def test_top_k_skips_shards_and_long_vectors(spark):
    """Shards whose bound lies below the kth score aren't searched; numbers beyond doubles stay exact."""
    from pyspark.sql import functions as F

    rng = np.random.default_rng(14)
    centres = rng.integers(-900, 900, (8, 300))
    v = {i: (centres[i % 8] + rng.integers(-5, 6, 300)).tolist() for i in range(400)}
    v |= {1000 + i: [int(x) << 40 for x in rng.integers(1, 900, 3)] for i in range(12)}
    df = spark.createDataFrame(list(v.items()), "id long, v array<long>")
    topk.SHARD_ROWS, kept = 25, topk.SHARD_ROWS
    try:
        placed, shards = topk.shard_rows(df.withColumn("dim", F.size("v")))
        asked = df.where("id < 16").selectExpr("id", "v", "size(v) dim", "3000000d floor")
        visits, every = topk.routed(asked, shards, False).count(), placed.where("dim = 300").select("shard").distinct().count()
        small = df.withColumn("v", F.when(F.col("id") < 1000, F.col("v")).otherwise(F.transform("v", lambda x: F.shiftright(x, 20))))
        got = sorted(map(tuple, topk.top_k(small, small.where("id % 50 = 0"), 3).collect()))
    finally:
        topk.SHARD_ROWS = kept
    assert every > 8 and visits < 16 * (every - 1) / 2
    v = {i: x if i < 1000 else [y >> 20 for y in x] for i, x in v.items()}
    want = []
    for q in (i for i in v if i % 50 == 0):
        best = sorted((-sum(a * b for a, b in zip(v[q], v[i])), i) for i in v if i != q and len(v[i]) == len(v[q]))[:3]
        want += [(q, r + 1, i, -s) for r, (s, i) in enumerate(best)]
    assert got == sorted(want) and max(x[3] for x in got) > 2**53


def test_lm_scores(spark, odd, none):
    from pyspark.sql import functions as F

    rows = lm.score(odd, F.col("doc_id") == 8, ["doc_id"]).collect()
    train = [r for r in odd.collect() if r.doc_id != 8]
    c = Counter(w for r in train for w in [*WORDS.findall(low(r.text)), "END "])
    n, v = sum(c.values()), len(c)
    texts = {r.doc_id: r.text for r in odd.collect()}
    for r in rows:
        tokens = [*WORDS.findall(low(texts[r.doc_id])), "END "]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(tokens), sum(c[t] > 0 for t in tokens), n)
        assert r.base_score == pytest.approx(sum(math.log10((c[t] + 1) / (n + v + 1)) for t in tokens))
        assert r.score < 0 and math.isfinite(r.score)
    assert len(rows) == 10 and lm.score(none, F.lit(False), ["doc_id"]).count() == 0


def test_lm_is_normalised_and_learns():
    rng = np.random.default_rng(7)
    unigram = np.full(lm.FREQUENT + 1, 1 / (lm.FREQUENT + 1))
    ids = np.tile([3, 7, 11], 20_000)
    starts = np.arange(0, len(ids), 30)
    trainer = lm.Trainer(lm.Model.start(unigram), unigram, 1)
    contexts = lm._contexts(ids, starts)
    before = trainer.m.log_probabilities(ids, *contexts).mean()
    trainer.learn(ids, *contexts)
    assert trainer.m.log_probabilities(ids, *contexts).mean() > before + 1
    a, b = rng.integers(0, lm.FREQUENT + 2, 2)
    every = np.arange(lm.FREQUENT + 1)
    assert np.exp(trainer.m.log_probabilities(every, np.full(len(every), a), np.full(len(every), b))).sum() == pytest.approx(1, abs=1e-4)


def test_rollups_commit_once(spark, tmp_path):
    rows = spark.createDataFrame([("a", "en", "v1", 10), ("a", "en", "v1", 5), (None, None, "v1", None), ("b", "de", "v1", 7)], "source string, lang string, tokenizer_version string, tokens long")
    store = rollups.Rollup(spark, f"file://{tmp_path}/store")
    assert store.totals().count() == 0
    assert store.commit("1", rollups.inserted(rows)) and not store.commit("1", rollups.inserted(rows))
    german = rows.where("lang = 'de'")
    new = spark.createDataFrame([("b", "de", "v2", 9)], rows.schema)
    assert store.commit("2", rollups.revised(german, new)) and not store.commit("2", rollups.revised(german, new))
    assert store.commit("3", rollups.deleted(rows.where("tokens = 5")))
    # A writer that finds the name taken only when it is done leaves nothing behind.
    rows.limit(1).write.parquet(f"file://{tmp_path}/store/_aside-x")
    assert not store._name(f"file://{tmp_path}/store/_aside-x", f"file://{tmp_path}/store/batch=3")
    assert sorted(x.name for x in (tmp_path / "store").iterdir()) == ["batch=1", "batch=2", "batch=3"]
    assert store.commit("4", rollups.inserted(rows.limit(0))) and not store.commit("4", rollups.inserted(rows))
    assert {tuple(r) for r in store.totals().collect()} == {("a", "en", "v1", 1, 10), (None, None, "v1", 1, 0), ("b", "de", "v2", 1, 9)}


def test_toxicity(spark, odd, none):
    rng = random.Random(8)
    clean = lambda: " ".join(rng.choice(["the", "green", "house", "on", "hill", "water", "runs"]) for _ in range(rng.randint(5, 60)))
    texts = [clean() for _ in range(600)]
    labels = np.array([i % 3 == 0 for i in range(600)]).astype(np.int64)
    texts = [t + " idiotic scumbag" if y else t for t, y in zip(texts, labels)]
    model = toxicity.fit(texts, labels, 1 / 3)
    s = model.scores(pa.array([clean(), clean() + " idiiotic scumbaag", clean() + " idiotic scumbag", None, ""]))
    assert s[0] < 0.5 < s[2] and s[1] > s[0] and s[3] == s[4]
    got = toxicity.toxicity_scores(odd, model).collect()
    assert len(got) == 10 and all(0 <= r.score <= 1 for r in got) and toxicity.toxicity_scores(none, model).count() == 0
    assert 0 < toxicity.fit([], np.zeros(0, np.int64), 0.5).scores(pa.array(["x"]))[0] < 1


def test_nearest_prototype_against_brute_force(spark):
    """More languages than are compared at once; cosines by letters bound and permuted by place, one trigram at a time."""
    rng = np.random.default_rng(13)
    v, protos = rng.standard_normal((40, langid.DIM)).astype(np.float32), rng.standard_normal((1300, langid.DIM)).astype(np.float32)
    best, top = langid.nearest(v, protos)
    cos = v @ protos.T
    assert (best == cos.argmax(1)).all() and np.allclose(top, cos.max(1))
    text, total = " né  a1b ", np.zeros(langid.DIM)
    plain = " né a b "
    for i in range(len(plain) - 2):
        a, b, c = (langid._letter(ord(x)).astype(np.float64) for x in plain[i : i + 3])
        total += np.roll(a, 2) * np.roll(b, 1) * c
    assert np.allclose(langid.text_vectors([text])[0], total / np.linalg.norm(total), atol=1e-6)
    rows = [(k, f"{chr(0x4E00 + k) * 3} {chr(0x4E00 + k) * 5}", f"l{k:03}") for k in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.prototypes(docs)
    assert len(model[0]) == 600 and all(r.lang == r.lang_pred for r in langid.identify(docs, model).collect())


def test_toxicity_fit_in_a_task(spark):
    texts = [f"you vile {k} scum" if k % 3 == 0 else f"a calm {k} day" for k in range(60)]
    rows = [(k, t, int(k % 3 == 0)) for k, t in enumerate(texts)] + [(60, None, 1), (61, "x", None), (62, "y", 7)]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    a, b = toxicity.fit_on(df), toxicity.fit_on(df.repartition(7))
    assert a.bias == b.bias and (a.odds == b.odds).all()
    order = df.where("doc_id < 60").selectExpr("*", "xxhash64(doc_id, text) h").orderBy("h").toPandas()
    plain = toxicity.fit(order["text"].tolist(), order["toxic"].to_numpy(np.int64), 1 / 3)
    assert a.bias == plain.bias and (a.odds == plain.odds).all()
    s = a.scores(pa.array(texts))
    assert all((x >= 0.5) == (k % 3 == 0) for k, x in enumerate(s))
    none = toxicity.fit_on(df.where("doc_id < 0"))
    assert 0 <= none.scores(pa.array([None, ""], pa.string()))[0] <= 1


def test_components_of_chains_stars_and_loops(spark):
    from corpusloom.llm.components import components

    rng = random.Random(4)
    edges = [(k, k + 1) for k in range(100, 140)] + [(200, k) for k in range(201, 230)] + [(7, 7), (300, 301), (301, 300)] + [(rng.randrange(400, 460), rng.randrange(400, 460)) for _ in range(40)]
    root = {x: x for e in edges if e[0] != e[1] for x in e}
    for _ in root:
        for a, b in edges:
            if a != b:
                root[a] = root[b] = min(root[a], root[b])
    got = components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert len(got) == len(root) and {r.node: r.component for r in got} == root
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_lm_looks_words_up_by_prefix():
    """Counts and ids against a dictionary: words that share a prefix, hashes between, before and after all words, no words."""
    rng = np.random.default_rng(3)
    near = (np.uint64(5) << np.uint64(44)) + np.arange(0, 40, 2, dtype=np.uint64)
    words = np.unique(np.concatenate([near, rng.integers(1 << 40, 1 << 63, 3000, np.uint64) * np.uint64(2)]))
    vocab = lm.Vocabulary(words, rng.integers(2, 99, len(words)), rng.permutation(len(words)) + 1, 10**6, 10**4)
    h = rng.permutation(np.concatenate([words, words + np.uint64(1), words - np.uint64(1), np.array([0, 2**64 - 1], np.uint64), rng.integers(0, 1 << 63, 500, np.uint64)]))
    known = dict(zip(words.tolist(), zip(vocab.counts.tolist(), vocab.ids.tolist(), strict=True), strict=True))
    c, ids = vocab.look_up(h)
    assert list(zip(c.tolist(), ids.tolist(), strict=True)) == [known.get(x, (0, 0)) for x in h.tolist()]
    assert vocab.look_up(h[:0])[0].size == 0
    none = lm.Vocabulary(words[:0], vocab.counts[:0], vocab.ids[:0], 0, 0)
    assert not none.look_up(h)[0].any()
    x = np.array([-200, -31, -1, 0, 2, 31, 200], np.float32)
    assert lm._sigmoid(x.copy(), 4) == pytest.approx(1 / (1 + np.exp(-np.clip(x, -30, 30))) / 4, rel=1e-5)


def test_lm_sums_to_one_over_several_groups():
    n = lm.FREQUENT + lm.GROUP * lm.CLASS + lm.CLASS + 9
    unigram = 1 / np.arange(3, n + 4)
    unigram /= unigram.sum()
    every = np.arange(n + 1)
    plain = lm.Model.plain(unigram).log_probabilities(every, np.full(n + 1, 3), np.full(n + 1, n))
    assert np.exp(plain) == pytest.approx(unigram, rel=1e-3)
    trainer, ids = lm.Trainer(lm.Model.start(unigram), unigram, 1), np.random.default_rng(2).permutation(np.tile(every, 3))
    trainer.learn(ids, *lm._contexts(ids, np.array([0]), n))
    for a, b in ((3, n), (n + 1, 700)):
        assert np.exp(trainer.m.log_probabilities(every, np.full(n + 1, a), np.full(n + 1, b))).sum() == pytest.approx(1, abs=1e-4)


def test_lm_models_words_beyond_the_frequent_ones(spark):
    from pyspark.sql import functions as F

    n = lm.FREQUENT + 2 * lm.CLASS + 77
    ids = np.tile(np.arange(1, n + 1), 20)
    unigram = np.full(n + 1, 1 / (n + 1))
    trainer, contexts = lm.Trainer(lm.Model.start(unigram), unigram, 1), lm._contexts(ids, np.arange(0, len(ids), n), n)
    for a, b in ((3, n), (n + 1, 700)):
        every = np.arange(n + 1)
        assert np.exp(trainer.m.log_probabilities(every, np.full(n + 1, a), np.full(n + 1, b))).sum() == pytest.approx(1, abs=1e-4)
    rare = ids > lm.FREQUENT
    before = trainer.m.log_probabilities(ids, *contexts)[rare].mean()
    for _ in range(10):
        trainer.learn(ids, *contexts)
    assert trainer.m.log_probabilities(ids, *contexts)[rare].mean() > before + 0.5
    # Pairs of words that are all equally frequent: the modelled vocabulary grows with the corpus, and rare words are learnt from context.
    pairs = [(k, " ".join(f"a{(k + j) % 700} b{(k + j) % 700}" for j in range(40))) for k in range(2100)]
    docs = spark.createDataFrame(pairs, "doc_id long, text string")
    vocab = lm.vocabulary(lm.count_words(docs))
    assert len(vocab.unigram()) == 1402
    rows = lm.score(docs, F.col("doc_id") % 10 == 0, ["doc_id"]).where("held_out").agg(F.sum("score").alias("s"), F.sum("base_score").alias("b")).first()
    assert rows.s > rows.b


def test_toxicity_learns_from_few_labels(spark):
    words = ["the", "green", "house", "on", "hill", "water", "runs"]
    rng = random.Random(9)
    clean = lambda: " ".join(rng.choice(words) for _ in range(20))
    texts = [clean() + (" idiotic scumbag" if k % 6 == 0 else "") for k in range(66)]
    model = toxicity.fit(texts, np.array([int(k % 6 == 0) for k in range(66)]), 1 / 6)
    s = model.scores(pa.array([clean() + " idiotic scumbag", clean() + " idiotic scumbag", clean(), clean()]))
    assert s[:2].min() > 0.5 > s[2:].max()


def test_toxicity_on_held_out_texts(spark):
    """The folds of op10_toxicity at sf0.1: nine of ten toxic texts, long ones too, at two false alarms in a hundred at most."""
    sf = "/root/testdata/sf0.1"
    rows = spark.read.parquet(f"{sf}/documents.parquet").join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("text is not null and toxic in (0, 1)").selectExpr("text", "toxic", "crc32(cast(string(doc_id) as binary)) % 5 = 0 held").orderBy("doc_id").toPandas()
    learnt, held = rows[~rows["held"]], rows[rows["held"]]
    y, long = held["toxic"].to_numpy() == 1, held["text"].str.len().to_numpy() > 3000
    hit = toxicity.fit(learnt["text"].tolist(), learnt["toxic"].to_numpy(np.int64), learnt["toxic"].mean()).scores(pa.array(held["text"].tolist())) >= 0.5
    assert hit[y].mean() >= 0.9 and hit[~y].mean() <= 0.02, (hit[y].mean(), hit[~y].mean())
    assert hit[y & long].mean() >= 0.8, hit[y & long].mean()


def test_lm_scores_against_a_softmax_for_each_level():
    """One token at a time: its word or group, then the group's classes, then the class's words."""
    f, g, c = lm.FREQUENT, lm.GROUP, lm.CLASS
    n = f + g * c + 3 * c + 5
    model, rng = lm.Model.start(np.full(n + 1, 1 / (n + 1))), np.random.default_rng(4)
    for x, bias in model.tables():
        x[:] = rng.standard_normal(x.shape)
        if bias is not None:
            bias[:] = rng.standard_normal(bias.shape)
    ids = np.concatenate([[0, 1, f, f + 1, f + c, f + g * c, f + g * c + 1, n], rng.integers(0, n + 1, 30)])
    one, two = rng.integers(0, n + 2, len(ids)), rng.integers(0, n + 2, len(ids))

    def part(q, rows, bias, lo, hi, at):
        s = [float(np.dot(q, rows[k].astype(float)) + bias[k]) for k in range(lo, min(hi, len(rows)))]
        return s[at - lo] - max(s) - math.log(sum(math.exp(x - max(s)) for x in s))

    for i, a, b, got in zip(ids, one, two, model.log_probabilities(ids, one, two), strict=True):
        q = model.one[a].astype(float) + model.two[b]
        v = int(i) - f - 1
        want = part(q, model.top, model.top_bias, 0, len(model.top), i if v < 0 else f + 1 + v // (g * c))
        if v >= 0:
            want += part(q, model.classes, model.class_bias, v // (g * c) * g, (v // (g * c) + 1) * g, v // c)
            want += part(q, model.word, model.word_bias, v // c * c, (v // c + 1) * c, v)
        assert got == pytest.approx(want, abs=2e-3)
