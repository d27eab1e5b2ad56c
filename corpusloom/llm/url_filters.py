"""URL filters: explicit domain rules, and association rules mined from labelled URLs with Spark's FP-growth.

Explicit rules label part of the URLs; FP-growth mines token combinations that go with a label;
rules pruned by support, confidence and redundancy judge the rest through an inverted index: a
rule is filed under the item that the fewest URLs have, and a URL only looks at the rules filed
under its items. All tokens are mined and all rules kept; tokens that always occur together are one
item, and items that go with one verdict alone are rules by themselves, so that neither copies of a
long URL nor the nearly equal paths of a site with one verdict make every subset an itemset. Paths
of a site with both verdicts, nearly equal in many parts, still do.
"""

from __future__ import annotations

from math import ceil

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import small, stored

#: (verdict, host and path). A rule fits its host, all subdomains, and paths that start with its path.
Rules = list[tuple[str, str]]
DEFAULT = "allow"
#: Rows of the token and rule tables up to which they are sent to every task (about 200 bytes each); larger ones are joined by shuffles.
SMALL = 100_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for a null url or one without ://."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), _UPPER, _LOWER)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def longest_rule(host: Column, path: Column, rules: Rules) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, null if none does; of equally long rules, the first."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for v, r in sorted(rules, key=lambda x: len(x[1])):
        own, slash, rest = r.partition("/")
        fits = (host == own) | F.endswith(host, F.lit("." + own))
        fits = fits & F.startswith(path, F.lit(slash + rest))
        rule, verdict = F.when(fits, F.lit(r)).otherwise(rule), F.when(fits, F.lit(v)).otherwise(verdict)
    return rule, verdict


def tokens(host: Column, path: Column) -> Column:
    """Distinct tokens: host suffixes by label, and path parts between anything but letters and digits; digits alone are one token."""
    labels = F.split(host, r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.concat(F.lit("h:"), F.array_join(F.slice(F.reverse(labels), F.lit(1), i), ".")))
    parts = F.transform(F.split(F.lower(path), r"[^\p{L}\p{N}]+"), lambda p: F.concat(F.lit("p:"), F.when(p.rlike(r"^\p{N}+$"), "#").otherwise(p)))
    return F.array_distinct(F.filter(F.concat(F.when(host != "", suffixes).otherwise(F.array()), parts), lambda t: t != "p:"))


def items_of(rows: DataFrame, least: int) -> DataFrame:
    """(token, item) of the tokens that `least` of rows(row, tokens) have: tokens of the very same rows are one item, named after the first."""
    each = rows.select("row", F.explode("tokens").alias("token"))
    marks = [F.bit_xor(F.xxhash64("row", F.lit(k))).alias(f"mark{k}") for k in (1, 2)]
    seen = each.groupBy("token").agg(F.count("*").alias("n"), *marks).where(F.col("n") >= least)
    seen = stored(seen, "tokens")
    names = seen.groupBy("n", "mark1", "mark2").agg(F.min("token").alias("item"))
    return stored(seen.join(names, ["n", "mark1", "mark2"]).select("token", "item"), "items")


def mine(labelled: DataFrame, least_support: float = 0.002, least_confidence: float = 0.6) -> tuple[DataFrame, DataFrame]:
    """Rules (rule_id, items, verdict, confidence, support) from labelled(tokens, verdict), and the (token, item) they speak of.

    A rule says that URLs with all its items have the verdict. Rules below the least support or
    confidence go, and so do rules of which a subset of the items says the same with no less
    confidence. No labelled rows, or labels of no use, give no rules.
    """
    spark = labelled.sparkSession
    goal = F.concat(F.lit("=:"), F.col("verdict"))
    rows = labelled.where("verdict is not null").select("tokens", goal.alias("goal")).withColumn("row", F.monotonically_increasing_id())
    rows = stored(rows, "labelled")
    n = rows.count()
    items = items_of(rows, ceil(least_support * n))
    schema = "rule_id long, items array<string>, verdict string, confidence double, support double"
    if not n:
        return spark.createDataFrame([], schema), items
    pairs = rows.select("row", "goal", F.explode("tokens").alias("token")).join(small(items, SMALL), "token").select("row", "goal", "item").distinct()
    # An item all of whose rows have one verdict is a rule that no larger one improves on, so it needn't be mined with others:
    # the paths of a site that is judged as a whole would else give every subset of theirs.
    counts = pairs.groupBy("item", "goal").agg(F.count("*").alias("k")).groupBy("item").agg(F.sum("k").alias("k"), F.count("*").alias("goals"), F.min("goal").alias("goal"))
    counts = stored(counts, "counts")
    pure = counts.where(f"goals = 1 and k >= {ceil(least_support * n)}").select(F.array("item").alias("items"), F.substring("goal", 3, 1_000_000).alias("verdict"), F.lit(1.0).alias("confidence"), (F.col("k") / n).alias("support"))
    mixed = counts.where("goals > 1").select("item")
    found = pairs.join(small(mixed, SMALL), "item").groupBy("row").agg(F.collect_set("item").alias("found"))
    baskets = rows.select("row", "goal").join(found, "row", "left").select(F.array_append(F.coalesce("found", F.array().cast("array<string>")), F.col("goal")).alias("items"))
    model = FPGrowth(itemsCol="items", minSupport=least_support, minConfidence=least_confidence).fit(stored(baskets, "baskets"))
    found = model.associationRules.where(F.startswith(F.col("consequent")[0], F.lit("=:")))
    found = found.select(F.array_sort("antecedent").alias("items"), F.substring(F.col("consequent")[0], 3, 1_000_000).alias("verdict"), "confidence", "support")
    found = stored(found, "rules")
    # The subsets of one item less are enough: what makes one of those redundant makes this rule so too.
    less = found.where(F.size("items") > 1).withColumn("t", F.explode("items")).select("items", "verdict", "confidence", F.array_remove("items", F.col("t")).alias("part"))
    known = found.select(F.col("items").alias("part"), "verdict", F.col("confidence").alias("c"))
    redundant = less.join(known, ["part", "verdict"]).where("c >= confidence").select("items", "verdict").distinct()
    kept = found.join(redundant, ["items", "verdict"], "left_anti").select(*pure.columns).unionByName(pure)
    return stored(kept.select(F.monotonically_increasing_id().alias("rule_id"), "items", "verdict", "confidence", "support"), "kept"), items


def match(urls: DataFrame, key: str, rules: DataFrame, items: DataFrame) -> DataFrame:
    """(key, verdict, confidence) of the best rule that each row of urls(key, tokens) meets: by confidence, support, items; no row if none. key: unique."""
    own = urls.select(key, F.explode("tokens").alias("token")).join(small(items, SMALL), "token").groupBy(key).agg(F.collect_set("item").alias("items"))
    own = stored(own, "own")
    by_item = own.select(F.explode("items").alias("item")).groupBy("item").agg(F.count("*").alias("n"))
    filed = rules.withColumn("item", F.explode("items")).join(by_item, "item", "left").fillna(0, ["n"])
    rarest = filed.groupBy("rule_id").agg(F.min(F.struct("n", "item")).getField("item").alias("item"))
    index = stored(rules.join(rarest, "rule_id").select("item", F.col("items").alias("needed"), F.col("verdict").alias("v"), "confidence", "support"), "index")
    hits = own.withColumn("item", F.explode("items")).join(small(index, SMALL), "item").where(F.size(F.array_except("needed", "items")) == 0)
    best = hits.groupBy(key).agg(F.max(F.struct("confidence", "support", "needed", "v")).alias("b"))
    return best.select(key, F.col("b.v").alias("verdict"), F.col("b.confidence").alias("confidence"))


def judge(pages: DataFrame, rules: Rules) -> DataFrame:
    """(page_id, host, path, rule, verdict, confidence) of every row of pages(page_id, url, ...).

    verdict is that of the longest explicit rule that fits, else that of the best mined rule,
    else `allow`. The explicit rules' verdicts are the labels that rules are mined from. A null
    url, or one without ://, has an empty host and path. Rows that repeat or share a page_id
    are judged one by one; an empty table gives an empty result. Other columns are dropped.
    """
    host, path = host_and_path(F.col("url"))
    parts = pages.select("page_id", host.alias("host"), path.alias("path"))
    rule, verdict = longest_rule(F.col("host"), F.col("path"), rules)
    parts = stored(parts.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("own"), tokens(F.col("host"), F.col("path")).alias("tokens")).withColumn("row", F.monotonically_increasing_id()), "urls")
    mined, items = mine(parts.where("own is not null").select("tokens", F.col("own").alias("verdict")))
    hits = match(parts.where("own is null"), "row", mined, items)
    return parts.join(hits, "row", "left").select("page_id", "host", "path", "rule", F.coalesce("own", "verdict", F.lit(DEFAULT)).alias("verdict"), "confidence")
