"""Winnowed fingerprints of whole texts, with DataFrame functions only.

A text is cut into units: words of up to UNIT characters, and the single characters of longer
runs, as those of scripts without blanks, links and encoded data. So units never shift against
each other: what is put in or left out changes the units at that place alone. The hash of K units
is a polynomial of theirs and rolls from each gram to the next; from each window of W successive
hashes the smallest is kept, the rightmost of equal ones, with its position. So any K + W - 1 units
that two texts share leave a common hash in both, and nothing shorter than K units does. Windows
are worked off in chunks, so that their hashes are never held for a whole text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm.common import running, stored

UNIT = 16
K, W = 4, 6
#: Window starts worked off at once. A window's place in its chunk has 12 bits, so it is below 4096 - W.
CHUNK = 1024
#: A gram's hash is taken modulo PRIME; with BASE below 2^30 no step of the sum leaves 63 bits.
PRIME, BASE = 2147483647, 1000003
#: Hashes rolled on from one that is summed up afresh: an array grows by copying, so a short one is cheap.
STRIDE = 32
#: Ids of a bucket in which a document finds the next one.
BUCKET_BITS = 9
#: Buckets of a task (about).
TASK_BUCKETS = 8
#: Buckets up to which their table is sent to every task rather than the texts being shuffled once more.
SMALL = 100_000


def _let(value: Column, body) -> Column:
    return F.transform(F.array(value), body)[0]


def _rolled(units: Column, first: Column, last: Column, k: int) -> Column:
    """Hashes of the grams of k units that start at first up to last: the sum of units times falling powers of BASE, modulo PRIME.

    units are hashes from 1 up to PRIME - 1; 0 stands for those past the end. The next hash comes
    from the one before: what leaves the gram is taken off and what enters it put on.
    """
    base, off = F.lit(BASE).cast("long"), F.lit(pow(BASE, k, PRIME)).cast("long")
    unit = lambda p: F.coalesce(F.get(units, p), F.lit(0).cast("long"))

    def fresh(p: Column) -> Column:
        h = unit(p)
        for i in range(1, k):
            h = (h * base + unit(p + i)) % PRIME
        return F.array(h)

    def roll(done: Column, p: Column) -> Column:
        before = F.get(done, F.size(done) - 1)
        return F.array_append(done, F.pmod(before * base - unit(p - 1) * off + unit(p + (k - 1)), F.lit(PRIME).cast("long")))

    def stride(p: Column) -> Column:
        end = F.least(p + (STRIDE - 1), last)
        return F.when(end > p, F.aggregate(F.sequence(p + 1, end), fresh(p), roll)).otherwise(fresh(p))

    return F.flatten(F.transform(F.sequence(first, last, F.lit(STRIDE)), stride))


def winnow(text: Column, k: int = K, w: int = W) -> Column:
    """Fingerprint of a text: distinct longs, the upper half a hash, the lower half its unit's position, by position.

    get() rather than slice(), which copies its whole array each time; it gives null past the
    end, which minima pass over. A text of fewer than k units is one gram, one with fewer than w grams one window; an empty,
    blank or null text has an empty fingerprint.
    """
    low = F.lit(4095).cast("long")

    def chunk(data: Column, c: Column, grams: Column, windows: Column) -> Column:
        base = c * CHUNK
        last = F.least(base + (CHUNK + w - 2), grams - 1)
        hashes = F.transform(_rolled(data, base, last, k), lambda h, i: F.shiftleft(h, 32).bitwiseOR((low - i).cast("long")))
        least = lambda h: F.transform(F.sequence(F.lit(0), F.least(F.lit(CHUNK), windows - base) - 1), lambda i: F.least(*(F.get(h, i + j) for j in range(w))))
        place = lambda x: x.bitwiseAND(F.lit(-4294967296).cast("long")).bitwiseOR((base + low - x.bitwiseAND(low)).cast("long"))
        return _let(hashes, lambda h: F.transform(F.array_distinct(least(h)), place))

    def whole(data: Column) -> Column:
        grams = F.greatest(F.lit(1), F.size(data) - (k - 1))
        windows = F.greatest(F.lit(1), grams - (w - 1))
        count = F.ceil(windows / CHUNK).cast("int")
        parts = F.transform(F.sequence(F.lit(0), count - 1), lambda c: chunk(data, c, grams, windows))
        return F.array_distinct(F.flatten(parts))

    units = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(rf"(?<!\S)\S{{1,{UNIT}}}(?!\S)|\S"), F.lit(0))
    none = F.array().cast("array<bigint>")
    hashed = F.transform(units, lambda u: F.pmod(F.xxhash64(u), F.lit(PRIME - 1).cast("long")) + 1)
    return _let(hashed, lambda u: F.when(F.size(u) > 0, whole(u)).otherwise(none))


def likeness(a: Column, b: Column) -> Column:
    """Jaccard index of two fingerprints' hashes; 1 if both are empty."""
    hashes = lambda f: F.array_distinct(F.transform(f, lambda x: F.shiftright(x, 32)))
    pair = F.struct(hashes(a).alias("x"), hashes(b).alias("y"))
    return _let(pair, lambda p: _let(F.size(F.array_intersect(p["x"], p["y"])), lambda both: F.when(F.size(p["x"]) + F.size(p["y"]) > 0, both / (F.size(p["x"]) + F.size(p["y"]) - both)).otherwise(1.0)))


def as_text(fingerprint: Column) -> Column:
    """Hash and position of each entry, in hexadecimal, apart by spaces."""
    return F.array_join(F.transform(fingerprint, lambda x: F.hex(x)), " ")


def fingerprints(docs: DataFrame) -> DataFrame:
    """docs(text, ...) with `fingerprint`, the array of winnow(); a column of that name is replaced."""
    return docs.withColumn("fingerprint", winnow(F.col("text")))


def _next_of(ids: DataFrame) -> DataFrame:
    """(bucket, next_id): the first id of the bucket after each one of ids(bucket, first_id); after the last, of the first."""
    s = running(ids, [F.col("first_id")])
    total = s.count()
    after = s.select(F.col("first_id").alias("next_id"), F.pmod(F.col("at") - 1, F.lit(max(total, 1))).alias("at"))
    return s.join(after, "at").select("bucket", "next_id")


def with_next(docs: DataFrame) -> DataFrame:
    """(doc_id, text, fingerprint, next_text, next_fingerprint): each document and the next one by ascending doc_id.

    After the last comes the first. Equal ids stand in order of their texts. A null doc_id has
    no place in the order; such a row is its own next. Texts are shuffled once, by buckets of
    ids; a bucket also gets a copy of the document that follows its last one.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    known = docs.where("doc_id is not null")
    bucket = F.shiftright("doc_id", BUCKET_BITS)
    following = stored(_next_of(known.groupBy(bucket.alias("bucket")).agg(F.min("doc_id").alias("first_id"))), "following")
    buckets = following.count()
    if buckets <= SMALL:  # rows of two longs
        following = F.broadcast(following)
    copies = known.join(following, known["doc_id"] == following["next_id"]).groupBy("bucket", "doc_id").agg(F.min("text").alias("text"))
    rows = known.select(bucket.alias("bucket"), "doc_id", "text", F.lit(False).alias("copy")).unionByName(copies.select("bucket", "doc_id", "text", F.lit(True).alias("copy")))
    tasks = max(docs.sparkSession.sparkContext.defaultParallelism, buckets // TASK_BUCKETS)
    rows = rows.repartition(tasks, "bucket").withColumn("fingerprint", winnow(F.col("text")))
    by = Window.partitionBy("bucket").orderBy("copy", "doc_id", "text")
    rows = rows.withColumns({"next_text": F.lead("text").over(by), "next_fingerprint": F.lead("fingerprint").over(by)}).where("not copy").drop("bucket", "copy")
    alone = fingerprints(docs.where("doc_id is null"))
    return rows.unionByName(alone.withColumns({"next_text": F.col("text"), "next_fingerprint": F.col("fingerprint")}))


def compare_edited(docs: DataFrame) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next), fingerprints as arrays.

    The edited text has its last floor(n_chars / 2) code points replaced by the first as many,
    or all, of the next document. A null text counts as empty. Rows that repeat are compared
    one by one; an empty table gives an empty result. Other columns are dropped.
    """
    half = F.floor(F.length("text") / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), F.length("text") - half), F.substring("next_text", F.lit(1), half))
    rows = with_next(docs).withColumn("edited", edited).withColumn("edited_fingerprint", winnow(F.col("edited")))
    return rows.select(
        "doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"), likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"),
    )
