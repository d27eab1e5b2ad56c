"""Queries over panels of raters, references, samples, look-backs, sets and labels, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.operators import windows
from corpusloom.plans.registry import query
from corpusloom.sources.readers import table

# Filters and lookups

_PRIORITIES = ["5-LOW", "4-NOT SPECIFIED", "3-MEDIUM", "2-HIGH", "1-URGENT"]


@query(f"select o_orderstatus, o_orderpriority, count(*) n from orders where o_orderstatus in ('O', 'P') and list_position({_PRIORITIES}, o_orderpriority) >= 3 group by all")
def b09_rank_floor(spark: SparkSession, sf: str) -> DataFrame:
    """Rows of the chosen statuses whose priority ranks at or above a floor."""
    rank = F.array_position(F.array(*map(F.lit, _PRIORITIES)), F.col("o_orderpriority"))
    return table(spark, sf, "orders").where(F.col("o_orderstatus").isin("O", "P") & (rank >= 3)).groupBy("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"))


@query("select source, count(*) filter (toxic = 1) positive, count(*) filter (toxic = 0) negative, count(*) filter (toxic is null or toxic not in (0, 1)) excluded from documents left join labels using (doc_id) group by 1")
def b12_tri_state(spark: SparkSession, sf: str) -> DataFrame:
    """Positive and negative labels; what has neither is counted apart, not as negative."""
    x = table(spark, sf, "documents").select("doc_id", "source").join(table(spark, sf, "labels").select("doc_id", "toxic"), "doc_id", "left")
    t = F.col("toxic")
    return x.groupBy("source").agg(F.count_if(t == 1).alias("positive"), F.count_if(t == 0).alias("negative"), F.count_if(t.isNull() | ~t.isin(0, 1)).alias("excluded"))


@query("select case o_orderstatus when 'F' then 'finished' when 'O' then 'open' else 'unmapped' end label, count(*) n, round(sum(o_totalprice), 2) total from orders group by 1")
def c35_label_lookup(spark: SparkSession, sf: str) -> DataFrame:
    names = F.create_map(F.lit("F"), F.lit("finished"), F.lit("O"), F.lit("open"))
    label = F.coalesce(F.try_element_at(names, F.col("o_orderstatus")), F.lit("unmapped"))
    return table(spark, sf, "orders").groupBy(label.alias("label")).agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("select coalesce(nullif(source, ''), nullif(lang, ''), 'unknown') origin, count(*) n from documents group by 1")
def h29_first_truthy(spark: SparkSession, sf: str) -> DataFrame:
    """The first of several names that is neither null nor empty."""
    own = F.coalesce(F.nullif("source", F.lit("")), F.nullif("lang", F.lit("")), F.lit("unknown"))
    return table(spark, sf, "documents").groupBy(own.alias("origin")).agg(F.count("*").alias("n"))


_TOPICS = {"licensing": ["license", "rights reserved"], "contact": ["@", "http"], "figures": ["0", "1"]}


@query("select doc_id, case when contains(text, 'license') or contains(text, 'rights reserved') then 'licensing' when contains(text, '@') or contains(text, 'http') then 'contact' when contains(text, '0') or contains(text, '1') then 'figures' else 'other' end topic, (contains(text, 'license')::int + contains(text, 'rights reserved')::int + contains(text, '@')::int + contains(text, 'http')::int + contains(text, '0')::int + contains(text, '1')::int) hits from documents")
def h14_keyword_topic(spark: SparkSession, sf: str) -> DataFrame:
    """The first topic with a keyword in the text, and how many keywords are there."""
    topic, hits = F.lit("other"), F.lit(0)
    for name, words in reversed(_TOPICS.items()):
        found = [F.contains("text", F.lit(w)) for w in words]
        topic = F.when(found[0] | found[1], F.lit(name)).otherwise(topic)
        hits = sum((f.cast("int") for f in found), hits)
    return table(spark, sf, "documents").select("doc_id", topic.alias("topic"), hits.alias("hits"))


@query("select page_id, trim(regexp_replace(url, '[^A-Za-z0-9_-]+', '-', 'g'), '-') slug from pages")
def h37_slug(spark: SparkSession, sf: str) -> DataFrame:
    slug = F.regexp_replace(F.regexp_replace("url", "[^A-Za-z0-9_-]+", "-"), "^-+|-+$", "")
    return table(spark, sf, "pages").select("page_id", slug.alias("slug"))


@query("select p_partkey, array_to_string(list_transform(string_split(lower(p_type), ' '), lambda w: upper(w[1]) || w[2:]), ' ') title from part")
def h15_title(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").select("p_partkey", F.initcap("p_type").alias("title"))


@query("select doc_id, concat_ws(';', case when regexp_matches(text, '[0-9]') then 'digit' end, case when contains(text, 'http') then 'link' end, case when n_chars > 1500 then 'long' end) kinds from documents")
def h36_inferred_kinds(spark: SparkSession, sf: str) -> DataFrame:
    """Kinds of evidence in each text, sorted, without those that are missing."""
    kinds = F.array(F.when(F.col("n_chars") > 1500, "long"), F.when(F.contains("text", F.lit("http")), "link"), F.when(F.col("text").rlike("[0-9]"), "digit"))
    return table(spark, sf, "documents").select("doc_id", F.array_join(F.array_sort(F.array_compact(kinds)), ";").alias("kinds"))


# Panels: users are tasks, event types raters

_VOTES = "v as (select user_id, event_type rater, max(value) > 50 label from events group by all)"


def _votes(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").groupBy("user_id", F.col("event_type").alias("rater")).agg((F.max("value") > 50).alias("label"))


@query("select conv_id, count(*) filter (role = 'user') user_turns, count(*) filter (role = 'assistant') assistant_turns, count(distinct role) filter (role in ('user', 'assistant')) = 2 complete from conversations group by 1")
def c20_panel(spark: SparkSession, sf: str) -> DataFrame:
    """Roles as columns of a conversation, and whether all spoke."""
    n = table(spark, sf, "conversations").groupBy("conv_id").agg(*(F.count_if(F.col("role") == r).alias(f"{r}_turns") for r in ("user", "assistant")))
    return n.withColumn("complete", (F.col("user_turns") > 0) & (F.col("assistant_turns") > 0))


@query(f"with {_VOTES} select a.rater first_rater, b.rater second_rater, count(*) n, count(*) filter (a.label = b.label) agreed from v a join v b on a.user_id = b.user_id and a.rater < b.rater group by all")
def c22_rater_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Agreement of every two raters on the tasks that both judged."""
    v = _votes(spark, sf).where("label is not null")
    b = v.select("user_id", F.col("rater").alias("second_rater"), F.col("label").alias("other"))
    x = v.join(b, "user_id").where(F.col("rater") < F.col("second_rater"))
    return x.groupBy(F.col("rater").alias("first_rater"), "second_rater").agg(F.count("*").alias("n"), F.count_if(F.col("label") == F.col("other")).alias("agreed"))


@query(f"with {_VOTES} select user_id, count(*) raters, count(*) filter (label) positive from v group by 1 having count(*) = (select count(distinct event_type) from events)")
def c23_complete_case(spark: SparkSession, sf: str) -> DataFrame:
    """Tasks that every rater judged."""
    every = table(spark, sf, "events").agg(F.count_distinct("event_type").alias("k"))
    n = _votes(spark, sf).groupBy("user_id").agg(F.count("*").alias("raters"), F.count_if("label").alias("positive"))
    return n.join(every, n["raters"] == every["k"], "left_semi")


@query(f"with {_VOTES}, n as (select user_id, count(*) t, count(*) filter (label) yes, greatest(count(*) filter (label), count(*) filter (not label)) top from v group by 1) select t raters, count(*) tasks, count(*) filter (top = t) unanimous, count(*) filter (yes >= 3) majority, round(avg(top / t), 9) mean_share from n group by 1")
def d22_majority(spark: SparkSession, sf: str) -> DataFrame:
    """Unanimous votes, strict majorities (three votes for it), and the mean share of the leading label, by the number of raters."""
    n = _votes(spark, sf).groupBy("user_id").agg(F.count("*").alias("raters"), F.count_if("label").alias("yes"), F.greatest(F.count_if("label"), F.count_if(~F.col("label"))).alias("top"))
    top, t = F.col("top"), F.col("raters")
    return n.groupBy("raters").agg(F.count("*").alias("tasks"), F.count_if(top == t).alias("unanimous"), F.count_if(F.col("yes") >= 3).alias("majority"), F.round(F.avg(top / t), 9).alias("mean_share"))


@query("select event_type, count(*) total, count(*) filter (value > 50) completed, 100.0 * count(*) filter (value > 50) / count(*) percent, strftime(max(ts), '%Y-%m-%d') last_day from events group by 1")
def d44_progress(spark: SparkSession, sf: str) -> DataFrame:
    done = F.count_if(F.col("value") > 50)
    return table(spark, sf, "events").groupBy("event_type").agg(F.count("*").alias("total"), done.alias("completed"), (F.lit(100.0) * done / F.count("*")).alias("percent"), F.date_format(F.max("ts"), "yyyy-MM-dd").alias("last_day"))


# References between tables

@query("select o.o_orderkey // 4 * 4 root, count(*) members, count(r.o_orderkey) = 0 dangling from orders o left join orders r on r.o_orderkey = o.o_orderkey // 4 * 4 group by 1")
def c32_roots(spark: SparkSession, sf: str) -> DataFrame:
    """Members of each root; a root that no row has is dangling. One aggregation, since a root is a member of its own."""
    o = table(spark, sf, "orders").select("o_orderkey", F.expr("o_orderkey div 4 * 4").alias("root"))
    return o.groupBy("root").agg(F.count("*").alias("members"), (F.count_if(F.col("o_orderkey") == F.col("root")) == 0).alias("dangling"))


@query("select 'part' endpoint, count(*) dangling from lineitem where l_partkey not in (select p_partkey from part) union all select 'supplier', count(*) from lineitem where l_suppkey not in (select s_suppkey from supplier)")
def c33_endpoints(spark: SparkSession, sf: str) -> DataFrame:
    """Edges whose ends no node has."""
    li, p, s = (table(spark, sf, t) for t in ("lineitem", "part", "supplier"))
    gone = lambda name, rows: rows.agg(F.count("*").alias("dangling")).select(F.lit(name).alias("endpoint"), "dangling")
    return gone("part", li.join(p, li["l_partkey"] == p["p_partkey"], "left_anti")).unionByName(gone("supplier", li.join(s, li["l_suppkey"] == s["s_suppkey"], "left_anti")))


# Roll-ups

@query("select o_orderstatus, o_orderpriority, count(*) n, bool_or(o_totalprice > 400000) any_large from orders group by grouping sets ((o_orderstatus), (o_orderpriority), ())")
def d30_counters(spark: SparkSession, sf: str) -> DataFrame:
    return spark.sql("select o_orderstatus, o_orderpriority, count(*) n, bool_or(o_totalprice > 400000) any_large from {o} group by grouping sets ((o_orderstatus), (o_orderpriority), ())", o=table(spark, sf, "orders"))


@query("select sha256(text) fingerprint, count(*) n, min(doc_id) first_id from documents where text is not null group by 1")
def d39_freeze(spark: SparkSession, sf: str) -> DataFrame:
    """Distinct fingerprints, a row each, so that a baseline of any size stays distributed."""
    d = table(spark, sf, "documents").where("text is not null")
    return d.groupBy(F.sha2("text", 256).alias("fingerprint")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id"))


@query("with x as (select l_orderkey, list(l_returnflag order by l_linenumber, l_returnflag) a, list(l_returnflag order by l_shipdate, l_linenumber, l_returnflag) b from lineitem group by 1) select count(*) n, count(*) filter (a = b) raw_equal, count(*) filter (list_sort(a) = list_sort(b)) sorted_equal from x")
def d41_canonical(spark: SparkSession, sf: str) -> DataFrame:
    """Lists of an order's flags that agree as they are, and that agree once sorted. Lines of one number stand by flag."""
    flags = lambda *by: F.transform(F.array_sort(F.collect_list(F.struct(*by, "l_returnflag"))), lambda x: x["l_returnflag"])
    x = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(flags("l_linenumber").alias("a"), flags("l_shipdate", "l_linenumber").alias("b"))
    return x.agg(F.count("*").alias("n"), F.count_if(F.col("a") == F.col("b")).alias("raw_equal"), F.count_if(F.array_sort("a") == F.array_sort("b")).alias("sorted_equal"))


# Samples, look-backs and orders

@query("with s as (select doc_id, lang, row_number() over (partition by lang order by sha256('review' || chr(0) || doc_id::varchar), doc_id) draw, count(*) over (partition by lang) population from documents) select doc_id, lang, draw::int draw, population from s where draw <= 10")
def e04_sample_per_language(spark: SparkSession, sf: str) -> DataFrame:
    return windows.stratified(table(spark, sf, "documents").select("doc_id", "lang"), ["lang"], "doc_id", 10, "review").select("doc_id", "lang", "draw", "population")


_BEFORE = "over (partition by user_id order by ts, event_id rows between {} preceding and 1 preceding)"


@query(f"select event_id, last(case when event_type = 'click' then value end ignore nulls) {_BEFORE.format('unbounded')} latest from events qualify event_type = 'purchase'")
def e07_latest_before(spark: SparkSession, sf: str) -> DataFrame:
    """The value that the user's latest click before a purchase defined."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, -1)
    e = table(spark, sf, "events").withColumn("latest", F.last(F.when(F.col("event_type") == "click", F.col("value")), ignorenulls=True).over(w))
    return e.where("event_type = 'purchase'").select("event_id", "latest")


@query(f"select event_id, count(case when event_type = 'view' then 1 end) {_BEFORE.format(20)} > 0 guarded from events qualify event_type = 'purchase'")
def e11_lookback(spark: SparkSession, sf: str) -> DataFrame:
    """Whether a view guards a purchase within the user's 20 events before it."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(-20, -1)
    e = table(spark, sf, "events").withColumn("guarded", F.count(F.when(F.col("event_type") == "view", 1)).over(w) > 0)
    return e.where("event_type = 'purchase'").select("event_id", "guarded")


@query("select o_orderkey, row_number() over (order by o_orderstatus, o_totalprice desc, o_orderkey desc)::int place from orders qualify place <= 200")
def f02_mixed_order(spark: SparkSession, sf: str) -> DataFrame:
    by = [F.asc("o_orderstatus"), F.desc("o_totalprice"), F.desc("o_orderkey")]
    top = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice").orderBy(*by).limit(200)
    return top.select("o_orderkey", F.row_number().over(Window.orderBy(*by)).alias("place"))


@query("with n as (select part, count(*) n from (select unnest(string_split(url, '/')) part from pages) group by 1) select part, n, row_number() over (order by n desc, part)::int place from n qualify place <= 50")
def f09_group_sizes(spark: SparkSession, sf: str) -> DataFrame:
    """The most frequent parts of urls; ties by name."""
    n = table(spark, sf, "pages").select(F.explode(F.split("url", "/")).alias("part")).groupBy("part").agg(F.count("*").alias("n"))
    by = [F.desc("n"), F.asc("part")]
    return n.orderBy(*by).limit(50).withColumn("place", F.row_number().over(Window.orderBy(*by)))


# Sets

@query("with x as (select l_orderkey, l_returnflag, min(l_linenumber) m from lineitem group by all) select l_orderkey, string_agg(l_returnflag, ',' order by m, l_returnflag) flags from x group by 1")
def g03_ordered_distinct(spark: SparkSession, sf: str) -> DataFrame:
    """An order's distinct flags in the order of their first lines; of one line, by flag."""
    lines = F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_returnflag"))), lambda x: x["l_returnflag"])
    return table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.array_join(F.array_distinct(lines), ",").alias("flags"))


@query("with a as (select c_custkey k from customer), b as (select distinct o_custkey k from orders) select count(*) filter (b.k is null) only_left, count(*) filter (a.k is null) only_right, count(*) filter (a.k is null or b.k is null) = 0 equal from a full join b on a.k = b.k")
def g07_same_keys(spark: SparkSession, sf: str) -> DataFrame:
    """Whether two tables have the same keys, by one aggregation over both."""
    side = lambda t, c, k: table(spark, sf, t).select(F.col(c).alias("k"), F.lit(k).alias("side")).distinct()
    x = side("customer", "c_custkey", 1).unionByName(side("orders", "o_custkey", 2)).groupBy("k").agg(F.sum("side").alias("s"))
    return x.agg(F.count_if(F.col("s") == 1).alias("only_left"), F.count_if(F.col("s") == 2).alias("only_right"), (F.count_if(F.col("s") < 3) == 0).alias("equal"))


@query("select doc_id from documents where contains(text, '@') except select doc_id from documents where contains(text, 'http')")
def g10_generic(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").select("doc_id", "text")
    return d.where(F.contains("text", F.lit("@"))).select("doc_id").subtract(d.where(F.contains("text", F.lit("http"))).select("doc_id"))


@query("select count(*) orders, count(*) filter (a = range(1, m + 1)) complete from (select l_orderkey, list_sort(list(distinct l_linenumber::bigint)) a, max(l_linenumber) m from lineitem group by 1)")
def g11_complete_views(spark: SparkSession, sf: str) -> DataFrame:
    """Orders whose line numbers are all of 1 to the largest."""
    x = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_set("l_linenumber")).alias("a"), F.max("l_linenumber").alias("m"))
    return x.agg(F.count("*").alias("orders"), F.count_if(F.col("a") == F.sequence(F.lit(1), F.col("m"))).alias("complete"))
