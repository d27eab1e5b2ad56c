"""Queries over joins, roll-ups, ordered work, sets and scalar functions, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.functions import text as fn
from corpusloom.operators import joins
from corpusloom.plans.registry import query
from corpusloom.sources.readers import lines, table

# Joins


@query("""with f as (select user_id, floor(value / 25)::bigint symbol, ts, event_id from events where event_type = 'signup'),
x as (select user_id, symbol, arg_max(event_id, (ts, event_id)) id from f group by all),
p as (select event_id, user_id, floor(value / 25)::bigint symbol, ts from events where event_type = 'purchase'),
l as (select p.event_id, arg_max(f.event_id, (f.ts, f.event_id)) id from p join f on p.user_id = f.user_id and f.ts <= p.ts group by 1)
select p.event_id, p.user_id, coalesce(x.id, l.id) "owner", case when x.id is not null then 'exact' when l.id is not null then 'latest' end how
from p left join x on p.user_id = x.user_id and p.symbol = x.symbol left join l on p.event_id = l.event_id""")
def c04_exact_or_latest(spark: SparkSession, sf: str) -> DataFrame:
    """A purchase belongs to the user's signup of the same size, else to the latest before it."""
    e = table(spark, sf, "events").withColumn("symbol", F.floor(F.col("value") / 25))
    p = e.where("event_type = 'purchase'").select("event_id", "user_id", "symbol", "ts")
    s = e.where("event_type = 'signup'").select(F.col("event_id").alias("id"), "user_id", "symbol", "ts")
    return joins.exact_or_latest(p, s, "user_id", "symbol", "ts", "id").select("event_id", "user_id", "owner", "how")


@query("select o_orderpriority, count(*) n, count(distinct o_orderkey) orders from orders join lineitem on l_orderkey = o_orderkey and l_shipdate between o_orderdate and o_orderdate + interval 60 day group by 1")
def c14_point_in_interval(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderdate", "o_orderpriority")
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_shipdate")
    x = li.join(o, li["l_orderkey"] == o["o_orderkey"]).where(F.expr("l_shipdate between o_orderdate and o_orderdate + interval 60 days"))
    return x.groupBy("o_orderpriority").agg(F.count("*").alias("n"), F.count_distinct("o_orderkey").alias("orders"))


@query("""with e as (select *, epoch_us(ts) // 1000000 s from events), a as (select * from e where event_type = 'purchase'), b as (select * from e where event_type = 'click'),
n as (select a.event_id, count(b.event_id) matches from a left join b on a.user_id = b.user_id and abs(a.s - b.s) <= 7200 group by 1)
select event_id, matches, case matches when 0 then 'none' when 1 then 'unique' else 'ambiguous' end verdict from n""")
def c15_band_join(spark: SparkSession, sf: str) -> DataFrame:
    """Clicks of the same user within two hours of a purchase; more than one is ambiguous."""
    e = table(spark, sf, "events").withColumn("s", F.unix_seconds(F.col("ts").cast("timestamp")))
    return joins.band_counts(e.where("event_type = 'purchase'"), e.where("event_type = 'click'"), "user_id", "event_id", "s", 7200)


@query("""with n as (select l_partkey, l_suppkey, count(*) n from lineitem group by all) select count(*) pairs, sum((n > 1)::int)::bigint repeated, max(n) most from n""")
def c16_cardinality(spark: SparkSession, sf: str) -> DataFrame:
    """How often a key pair that should match once matches more often."""
    n = table(spark, sf, "lineitem").groupBy("l_partkey", "l_suppkey").agg(F.count("*").alias("n"))
    return n.agg(F.count("*").alias("pairs"), F.count_if(F.col("n") > 1).alias("repeated"), F.max("n").alias("most"))


@query("""select count(*) filter (d.doc_id is not null and l.doc_id is not null) "both", count(*) filter (l.doc_id is null) left_only, count(*) filter (d.doc_id is null) right_only from documents d full join labels l on d.doc_id = l.doc_id""")
def c21_key_coverage(spark: SparkSession, sf: str) -> DataFrame:
    return joins.key_coverage(table(spark, sf, "documents"), table(spark, sf, "labels"), ["doc_id"])


@query("""select lang, count(*) n, count(l.doc_id) matched, count(*) - count(l.doc_id) ignored, count(*) filter (toxic = 1 and n_chars < 1000) hits from documents d left join labels l using (doc_id) group by 1""")
def c24_matched_and_ignored(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").select("doc_id", "lang", "n_chars")
    x = d.join(table(spark, sf, "labels").withColumn("_here", F.lit(1)), "doc_id", "left")
    return x.groupBy("lang").agg(F.count("*").alias("n"), F.count("_here").alias("matched"), F.count_if(F.col("_here").isNull()).alias("ignored"), F.count_if((F.col("toxic") == 1) & (F.col("n_chars") < 1000)).alias("hits"))


@query("""select o_orderpriority, count(*) n, sum((o_orderkey in (select l_orderkey from lineitem where l_returnflag = 'R'))::int)::bigint returned from orders group by 1""")
def c25_default_false(spark: SparkSession, sf: str) -> DataFrame:
    """Orders with a returned line; without a match the answer is false, not null."""
    r = table(spark, sf, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey")).distinct().withColumn("_r", F.lit(True))
    x = table(spark, sf, "orders").select("o_orderkey", "o_orderpriority").join(r, "o_orderkey", "left")
    return x.groupBy("o_orderpriority").agg(F.count("*").alias("n"), F.count_if(F.coalesce("_r", F.lit(False))).alias("returned"))


@query("select c_custkey, c_name from customer where not exists (select 1 from orders where o_custkey = c_custkey)")
def c36_exclusion(spark: SparkSession, sf: str) -> DataFrame:
    c, o = table(spark, sf, "customer"), table(spark, sf, "orders")
    return c.join(o, c["c_custkey"] == o["o_custkey"], "left_anti").select("c_custkey", "c_name")


@query("""select s.conv_id, s.turn, count(b.turn) pairs from conversations s left join conversations a on a.conv_id = s.conv_id and a.role = 'user' and a.turn < s.turn
left join conversations b on b.conv_id = s.conv_id and b.role = 'user' and a.turn < b.turn and b.turn < s.turn where s.role = 'assistant' group by 1, 2""")
def c39_ordered_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs of earlier user turns before each answer, counted from the running number of turns instead of formed."""
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    c = table(spark, sf, "conversations").select("conv_id", "turn", "role").withColumn("k", F.count_if(F.col("role") == "user").over(w))
    return c.where("role = 'assistant'").select("conv_id", "turn", F.expr("k * (k - 1) div 2").alias("pairs"))


# Roll-ups


@query("""with n as (select source, lang, count(*) n from documents group by all)
select source, sum(n)::bigint total, arg_min(lang, (-n, lang)) dominant, string_agg(lang || ':' || n, ';' order by n desc, lang) packed from n group by 1""")
def d05_histogram_mode(spark: SparkSession, sf: str) -> DataFrame:
    """Languages of each source, most frequent first; ties by name."""
    n = table(spark, sf, "documents").groupBy("source", "lang").agg(F.count("*").alias("n"))
    by = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("m"), "lang")))
    x = n.groupBy("source").agg(F.sum("n").alias("total"), by.alias("l"))
    return x.select("source", "total", F.col("l")[0]["lang"].alias("dominant"), F.array_join(F.transform("l", lambda i: F.concat_ws(":", i["lang"], (-i["m"]).cast("string"))), ";").alias("packed"))


@query("select count(*) n, count(distinct source) sources, sum(n_chars)::bigint chars, max(n_chars) longest, sum(strlen(text))::bigint bytes from documents")
def d06_corpus_totals(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").agg(F.count("*").alias("n"), F.count_distinct("source").alias("sources"), F.sum("n_chars").alias("chars"), F.max("n_chars").alias("longest"), F.sum(F.octet_length("text")).cast("long").alias("bytes"))


@query("""select source, count(*) filter (contains(text, 'http')) with_link, count(*) filter (contains(text, '@')) with_at, count(*) filter (regexp_matches(text, '[0-9]')) with_digit from documents group by 1""")
def d07_conditional_counts(spark: SparkSession, sf: str) -> DataFrame:
    has = lambda x: F.count_if(F.contains("text", F.lit(x)))
    return table(spark, sf, "documents").groupBy("source").agg(has("http").alias("with_link"), has("@").alias("with_at"), F.count_if(F.col("text").rlike("[0-9]")).alias("with_digit"))


@query("""select part, count(*) n, count(distinct page_id) pages from (select page_id, unnest(string_split(url, '/')) part from pages) where part <> '' group by 1""")
def d08_element_histogram(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "pages").select("page_id", F.explode(F.split("url", "/")).alias("part")).where("part <> ''")
    return p.groupBy("part").agg(F.count("*").alias("n"), F.count_distinct("page_id").alias("pages"))


@query("select lang, quality, toxic, count(*) n from documents join labels using (doc_id) group by all")
def d10_cross_tab(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").select("doc_id", "lang")
    return table(spark, sf, "labels").join(d, "doc_id").groupBy("lang", "quality", "toxic").agg(F.count("*").alias("n"))


_HALVES = "a as (select distinct user_id, event_type from events where ts < timestamp '2024-01-16'), b as (select distinct user_id, event_type from events where ts >= timestamp '2024-01-16')"


def _halves(spark: SparkSession, sf: str) -> DataFrame:
    """(user_id, event_type) with whether it was seen in the first half and in the second one, which together have all events with a time; one aggregation instead of an outer join."""
    early = F.col("ts") < F.expr("timestamp_ntz '2024-01-16'")
    return table(spark, sf, "events").where("ts is not null").groupBy("user_id", "event_type").agg(F.bool_or(early).alias("a"), F.bool_or(~early).alias("b"))


@query(f"""with {_HALVES}, c as (select count(*) filter (a.user_id is not null and b.user_id is not null) tp, count(*) filter (a.user_id is null) fp, count(*) filter (b.user_id is null) fn from a full join b on a.user_id = b.user_id and a.event_type = b.event_type)
select tp, fp, fn, round(tp / nullif(tp + fp, 0), 6) "precision", round(tp / nullif(tp + fn, 0), 6) recall from c""")
def d15_relation_metrics_all(spark: SparkSession, sf: str) -> DataFrame:
    c = _halves(spark, sf).agg(F.count_if(F.expr("a and b")).alias("tp"), F.count_if(F.expr("b and not a")).alias("fp"), F.count_if(F.expr("a and not b")).alias("fn"))
    return c.select("*", F.expr("round(try_divide(tp, tp + fp), 6)").alias("precision"), F.expr("round(try_divide(tp, tp + fn), 6)").alias("recall"))


@query(f"""with {_HALVES} select coalesce(a.event_type, b.event_type) event_type, count(*) filter (a.user_id is not null and b.user_id is not null) retained, count(*) filter (b.user_id is null) removed, count(*) filter (a.user_id is null) added
from a full join b on a.user_id = b.user_id and a.event_type = b.event_type group by 1""")
def d33_version_delta_all(spark: SparkSession, sf: str) -> DataFrame:
    return _halves(spark, sf).groupBy("event_type").agg(F.count_if(F.expr("a and b")).alias("retained"), F.count_if(F.expr("a and not b")).alias("removed"), F.count_if(F.expr("b and not a")).alias("added"))


@query("""with s as (select o_custkey, list_sort(list(distinct o_orderpriority) filter (o_orderstatus = 'F')) f, list_sort(list(distinct o_orderpriority) filter (o_orderstatus = 'O')) o from orders group by 1)
select count(*) n, count(*) filter (coalesce(f, []) = coalesce(o, [])) equal_sets from s""")
def d16_exact_sets(spark: SparkSession, sf: str) -> DataFrame:
    of = lambda s: F.array_sort(F.collect_set(F.when(F.col("o_orderstatus") == s, F.col("o_orderpriority"))))
    s = table(spark, sf, "orders").groupBy("o_custkey").agg(of("F").alias("f"), of("O").alias("o"))
    return s.agg(F.count("*").alias("n"), F.count_if(F.col("f") == F.col("o")).alias("equal_sets"))


@query("""select lang, quality, count(*) n, round(avg(toxic), 6) rate from documents join labels using (doc_id) group by grouping sets ((), (lang), (quality))""")
def d18_coverage(spark: SparkSession, sf: str) -> DataFrame:
    """The rate overall, by language and by quality."""
    d = table(spark, sf, "documents").select("doc_id", "lang").join(table(spark, sf, "labels"), "doc_id")
    return spark.sql("select lang, quality, count(*) n, round(avg(toxic), 6) rate from {d} group by grouping sets ((), (lang), (quality))", d=d)


@query("""select round(sum(l_quantity * (l_returnflag = 'R')::int) / sum(l_quantity), 6) weighted_rate from lineitem""")
def d25_weighted_rate(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").agg(F.round(F.sum(F.col("l_quantity") * (F.col("l_returnflag") == "R").cast("int")) / F.sum("l_quantity"), 6).alias("weighted_rate"))


@query("""select o_custkey, count(*) n, string_agg(distinct o_orderstatus, ',' order by o_orderstatus) statuses, bool_or(o_orderpriority = '1-URGENT') urgent, arg_min(o_orderkey, (o_orderpriority, o_orderdate, o_orderkey)) first_key from orders group by 1""")
def d31_case_rollup(spark: SparkSession, sf: str) -> DataFrame:
    """Sets, any, and the best row of each customer."""
    o = table(spark, sf, "orders")
    best = F.min(F.struct("o_orderpriority", "o_orderdate", "o_orderkey"))["o_orderkey"]
    return o.groupBy("o_custkey").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_set("o_orderstatus")), ",").alias("statuses"), F.bool_or(F.col("o_orderpriority") == "1-URGENT").alias("urgent"), best.alias("first_key"))


@query("""select n_name, count(*) n, string_agg(distinct c_mktsegment, ', ' order by c_mktsegment) segments from customer join nation on c_nationkey = n_nationkey group by 1""")
def d45_checklist(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "customer").groupBy("c_nationkey").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_set("c_mktsegment")), ", ").alias("segments"))
    n = table(spark, sf, "nation")
    return c.join(n, F.col("c_nationkey") == F.col("n_nationkey")).select("n_name", "n", "segments")


@query("select sha256(text) digest, count(*) copies, min(doc_id) first_doc from documents group by 1 having count(*) > 1")
def d48_duplicates(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").select("doc_id", F.sha2("text", 256).alias("digest"))
    return d.groupBy("digest").agg(F.count("*").alias("copies"), F.min("doc_id").alias("first_doc")).where("copies > 1")


# Ordered work


@query("select o_orderkey, printf('AT-%06d', row_number() over (order by o_orderdate, o_orderkey)) task_id from orders")
def e01_task_ids(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderdate")
    return joins.numbered(o, F.trunc("o_orderdate", "month"), ["o_orderdate", "o_orderkey"], "n").select("o_orderkey", F.format_string("AT-%06d", "n").alias("task_id"))


@query("select c_nationkey, c_custkey, row_number() over (partition by c_nationkey order by c_mktsegment, c_custkey)::int seq from customer")
def e02_group_sequence(spark: SparkSession, sf: str) -> DataFrame:
    w = Window.partitionBy("c_nationkey").orderBy("c_mktsegment", "c_custkey")
    return table(spark, sf, "customer").select("c_nationkey", "c_custkey", F.row_number().over(w).alias("seq"))


@query("select event_id, event_type from events qualify row_number() over (partition by event_type order by ts, event_id) <= 50")
def e06_group_cap(spark: SparkSession, sf: str) -> DataFrame:
    w = Window.partitionBy("event_type").orderBy("ts", "event_id")
    return table(spark, sf, "events").withColumn("r", F.row_number().over(w)).where("r <= 50").select("event_id", "event_type")


@query(r"""with l as (select page_id, unnest(a) line, generate_subscripts(a, 1)::int line_no from (select page_id, regexp_split_to_array(html, '\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x{85}\x{2028}\x{2029}]') a from pages)),
b as (select page_id, line_no, sum(length(line) - length(replace(line, '(', ''))) over w opened, sum(length(replace(line, ')', '')) - length(replace(line, '(', ''))) over w balance from l window w as (partition by page_id order by line_no))
select page_id, min(line_no)::int closes from b where opened > 0 and balance <= 0 group by 1""")
def e09_balanced_end(spark: SparkSession, sf: str) -> DataFrame:
    """The first line of a page by which some parenthesis was opened and all are closed."""
    n = lambda c: F.length("line") - F.length(F.replace("line", F.lit(c), F.lit("")))
    w = Window.partitionBy("page_id").orderBy("line_no")
    x = lines(table(spark, sf, "pages"), "page_id", "html").select("page_id", "line_no", F.sum(n("(")).over(w).alias("opened"), F.sum(n("(") - n(")")).over(w).alias("balance"))
    return x.where("opened > 0 and balance <= 0").groupBy("page_id").agg(F.min("line_no").alias("closes"))


@query("select user_id, arg_max(event_id, (ts, event_id)) last_purchase, count(*) n from events where event_type = 'purchase' group by 1")
def e12_last_success(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").where("event_type = 'purchase'").groupBy("user_id").agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("last_purchase"), F.count("*").alias("n"))


@query("select doc_id, list_filter(string_split(text, ' '), lambda x: length(x) > 12)[1] word from documents")
def e14_first_match(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", F.get(F.filter(F.split("text", " "), lambda x: F.length(x) > 12), F.lit(0)).alias("word"))


# Sets and sorts


@query("""with u as (select user_id, event_id, 0 side from events where event_type = 'view' union all select user_id, event_id, 1 from events where event_type = 'error')
select user_id, arg_min(event_id, (side, event_id)) kept_first, arg_max(event_id, (side, event_id)) kept_last from u group by 1""")
def g01_distinct_on(spark: SparkSession, sf: str) -> DataFrame:
    """Of both lists the first and the last row of a key."""
    e = table(spark, sf, "events").where("event_type in ('view', 'error')").select("user_id", "event_id", (F.col("event_type") == "error").cast("int").alias("side"))
    at = F.struct("side", "event_id")
    return e.groupBy("user_id").agg(F.min_by("event_id", at).alias("kept_first"), F.max_by("event_id", at).alias("kept_last"))


@query("select user_id from events where event_type = 'click' union select c_custkey from customer")
def g08_union_of_ids(spark: SparkSession, sf: str) -> DataFrame:
    a = table(spark, sf, "events").where("event_type = 'click'").select("user_id")
    return a.union(table(spark, sf, "customer").select("c_custkey")).distinct()


@query("select o_orderpriority, o_orderkey, row_number() over (order by case o_orderpriority when '2-HIGH' then 0 when '3-MEDIUM' then 1 when '5-LOW' then 2 else 3 end, o_totalprice desc, o_orderkey)::int rank from orders qualify rank <= 100")
def f05_enum_order(spark: SparkSession, sf: str) -> DataFrame:
    """The first 100 orders by an order of names that isn't alphabetical."""
    place = F.when(F.col("o_orderpriority") == "2-HIGH", 0).when(F.col("o_orderpriority") == "3-MEDIUM", 1).when(F.col("o_orderpriority") == "5-LOW", 2).otherwise(3)
    o = table(spark, sf, "orders").select("o_orderpriority", "o_orderkey", "o_totalprice", place.alias("place"))
    by = ["place", F.desc("o_totalprice"), "o_orderkey"]
    return o.orderBy(*by).limit(100).withColumn("rank", F.row_number().over(Window.orderBy(*by))).select("o_orderpriority", "o_orderkey", "rank")


# Scalar functions


@query(r"""select page_id, regexp_matches(url, '^.*/es/.*$') or regexp_matches(regexp_extract(url, '([^/]*)$', 1), '^5.$') globbed, lower(regexp_extract(url, '([.][^./]+)$', 1)) suffix,
regexp_replace(regexp_replace(url, '[^A-Za-z0-9_-]+', '-', 'g'), '^-+|-+$', '', 'g') slug, len(string_split(url, '/'))::int parts from pages""")
def h08_paths(spark: SparkSession, sf: str) -> DataFrame:
    """Globs on the path or its last part, suffixes, slugs."""
    u = F.col("url")
    return table(spark, sf, "pages").select("page_id", fn.glob_match(u, ["*/es/*", "5?"]).alias("globbed"), fn.suffix(u).alias("suffix"), fn.slug(u).alias("slug"), F.size(F.split(u, "/")).alias("parts"))


@query(r"""select event_id, printf('EV-%08d', event_id) label, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') "at", value / nullif(user_id, 0) ratio, case when value >= 150 then 'HIGH' when value >= 50 then 'MEDIUM' else 'LOW' end tier,
array_to_string(list_filter([case when value < 50 then 'size' end, case when event_type <> 'purchase' then 'sale' end, case when user_id <= 5 then 'member' end], lambda x: x is not null), ';') missing from events""")
def h19_labels_and_tiers(spark: SparkSession, sf: str) -> DataFrame:
    """Formatted ids, ISO times, safe ratios, tiers and what is missing."""
    v = F.col("value")
    gaps = fn.missing({"size": v >= 50, "sale": F.col("event_type") == "purchase", "member": F.col("user_id") > 5})
    tier = F.when(v >= 150, "HIGH").when(v >= 50, "MEDIUM").otherwise("LOW")
    return table(spark, sf, "events").select("event_id", F.format_string("EV-%08d", "event_id").alias("label"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("at"), F.try_divide(v, F.col("user_id")).alias("ratio"), tier.alias("tier"), F.array_join(gaps, ";").alias("missing"))
