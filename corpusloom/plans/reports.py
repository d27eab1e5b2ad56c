"""Queries over reports, orders, set operations and scalar functions, and their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.functions import json as fj
from corpusloom.functions import text as fn
from corpusloom.operators import graph, joins, metrics, ordering
from corpusloom.plans.audits import _HALVES, _SIGNALS, _halves, _signals
from corpusloom.plans.registry import query
from corpusloom.sources.readers import table

# Roll-ups


@query("select event_type, count(*) filter (value > 100) large, round(coalesce(sum(value) filter (value > 100), 0), 6) large_sum, round(sum(value), 6) total from events group by 1")
def d11_conditional_sums(spark: SparkSession, sf: str) -> DataFrame:
    large = F.col("value") > 100
    return table(spark, sf, "events").groupBy("event_type").agg(F.count_if(large).alias("large"), F.round(F.coalesce(F.sum(F.when(large, F.col("value"))), F.lit(0.0)), 6).alias("large_sum"), F.round(F.sum("value"), 6).alias("total"))


@query("""with x as (select lang, case when contains(text, '?') then null else toxic = 1 end gold, n_chars < 1000 pred, 1 + n_chars % 3 w from documents join labels using (doc_id))
select lang, count(*) filter (gold is not null) n, count(*) filter (gold is null) excluded, round(sum(w) filter (gold and pred) / nullif(sum(w) filter (gold is not null and pred), 0), 6) ppv, round(count(*) filter (gold is not null) / count(*), 6) coverage from x group by 1""")
def d14_provisional(spark: SparkSession, sf: str) -> DataFrame:
    """Weighted predictive value over the decided cases, how many those are, and what was left out."""
    x = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id")
    x = x.select("lang", F.when(~F.contains("text", F.lit("?")), F.col("toxic") == 1).alias("gold"), (F.col("n_chars") < 1000).alias("pred"), (1 + F.col("n_chars") % 3).alias("w"))
    known = F.col("gold").isNotNull()
    total = lambda c: F.sum(F.when(c, F.col("w")))
    return x.groupBy("lang").agg(
        F.count_if(known).alias("n"), F.count_if(~known).alias("excluded"),
        F.round(total(F.col("gold") & F.col("pred")) / F.nullif(total(known & F.col("pred")), F.lit(0)), 6).alias("ppv"), F.round(F.count_if(known) / F.count("*"), 6).alias("coverage"),
    )


_REPLICATES = 5000


@query(f"""with v as (select doc_id, unnest([lang = 'en', n_chars > 1500, contains(text, '.'), contains(text, '!'), doc_id is not null]) label from documents),
n as (select doc_id, count(*) filter (label) yes, count(*) filter (not label) no from v group by 1), p as (select yes, no, count(*) items from n group by all),
o as (select *, sum(items) over (order by case when no > 0 then 0 else 1 end, case when no > 0 then no else yes end) upto from p), b as (select *, upto - items since, (select sum(items) from p) total from o),
d as (select rep, j, (((j % 2147483647) * 16807 + rep * 48271 + 1) % 2147483647)::bigint a from (select unnest(range({_REPLICATES})) rep), (select unnest(range((select sum(items)::bigint from p))) j)),
e as (select rep, (a * a + 7 * a + 3) % 2147483647 a from d), f as (select rep, (a * a + 11 * a + 5) % 2147483647 a from e),
h as (select rep, a * (select sum(items)::bigint from p) // 2147483647 spot from f),
s as (select rep, sum(yes * (yes - 1) + no * (no - 1)) agree, sum(yes) y, sum(no) z, max(total) total from h join b on spot >= since and spot < upto group by 1 union all select -1, sum(items * (yes * (yes - 1) + no * (no - 1))), sum(items * yes), sum(items * no), max(total) from b),
k as (select rep, total, agree / (total * 20.0) o, pow(y / (total * 5.0), 2) + pow(z / (total * 5.0), 2) x from s), q as (select rep, total, case when abs(x - 1) > 1e-9 then (o - x) / (1 - x) end k from k)
select max(total)::bigint items, round(max(k) filter (rep = -1), 6) kappa, round(quantile_cont(k, 0.025) filter (rep >= 0), 6) low, round(quantile_cont(k, 0.975) filter (rep >= 0), 6) high from q""")
def d21_bootstrap(spark: SparkSession, sf: str) -> DataFrame:
    """Kappa of five raters (predicates over documents) and its interval from 5000 resamples."""
    d = table(spark, sf, "documents")
    labels = F.array(F.col("lang") == "en", F.col("n_chars") > 1500, F.contains("text", F.lit(".")), F.contains("text", F.lit("!")), F.col("doc_id").isNotNull())
    votes = d.select("doc_id", F.explode(labels).alias("label"))
    return metrics.bootstrap_kappa(votes, "doc_id", "label", _REPLICATES).select("items", *(F.round(c, 6).alias(c) for c in ("kappa", "low", "high")))


@query("""with s as (select event_type, count(*) n, count(distinct user_id) users, sum(value) secs from events where event_type in ('click', 'view', 'purchase') group by 1)
select count(*) stages, min(users) = max(users) consistent, case when min(users) = max(users) then round(sum(secs), 6) end total_seconds, round(max(n / secs), 6) best_rate from s""")
def d28_throughput(spark: SparkSession, sf: str) -> DataFrame:
    """Stages are only added up if they ran over the same population."""
    s = table(spark, sf, "events").where(F.col("event_type").isin("click", "view", "purchase")).groupBy("event_type").agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("users"), F.sum("value").alias("seconds"))
    same = F.min("users") == F.max("users")
    return s.agg(F.count("*").alias("stages"), same.alias("consistent"), F.when(same, F.round(F.sum("seconds"), 6)).alias("total_seconds"), F.round(F.max(F.col("n") / F.col("seconds")), 6).alias("best_rate"))


@query("""with k as (select user_id, bool_or(event_type = 'purchase') a, bool_or(event_type = 'click') b, bool_or(event_type = 'view') c, bool_or(event_type = 'signup') d, bool_or(event_type = 'error') e from events group by 1),
v(view_name, p, q) as (values ('sink_only', 0, 0), ('plain', 1, 0), ('full', 1, 1))
select view_name, round(sum(a::int + p * (b::int + c::int) + q * (d::int + e::int)) / (count(*) * 5), 4) completeness, round(sum(q * e::int) / nullif(sum(e::int), 0), 4) guard_recall from k, v group by 1""")
def d29_view_completeness(spark: SparkSession, sf: str) -> DataFrame:
    """What share of each case's fields a view shows, and of the guards."""
    has = lambda k: F.bool_or(F.col("event_type") == k).cast("int")
    k = table(spark, sf, "events").groupBy("user_id").agg(has("purchase").alias("a"), has("click").alias("b"), has("view").alias("c"), has("signup").alias("d"), has("error").alias("e"))
    views = F.array(*(F.struct(F.lit(v).alias("view_name"), F.lit(p).alias("p"), F.lit(q).alias("q")) for v, p, q in (("sink_only", 0, 0), ("plain", 1, 0), ("full", 1, 1))))
    x = k.withColumn("v", F.explode(views)).select("*", "v.*")
    return x.groupBy("view_name").agg(F.round(F.sum(F.expr("a + p * (b + c) + q * (d + e)")) / (F.count("*") * 5), 4).alias("completeness"), F.round(F.sum(F.expr("q * e")) / F.nullif(F.sum("e"), F.lit(0)), 4).alias("guard_recall"))


@query(f"""with {_HALVES}, p as (select user_id, len(list_filter(b.kinds, lambda x: not list_contains(a.kinds, x))) added, len(list_filter(a.kinds, lambda x: not list_contains(b.kinds, x))) removed, a.n before_n, b.n after_n from a join b using (user_id))
select added, removed, count(*) users, sum((added + removed > 0)::int)::bigint changed, sum(before_n)::bigint before_n, sum(after_n)::bigint after_n, sum(after_n - before_n)::bigint delta from p group by all""")
def d34_paired_delta(spark: SparkSession, sf: str) -> DataFrame:
    """Histogram of what users gained and lost between two versions, with the counts of both and their difference."""
    a, b = _halves(spark, sf)
    x = a.withColumnRenamed("n", "before_n").join(b.select("user_id", F.col("kinds").alias("new"), F.col("n").alias("after_n")), "user_id")
    x = x.withColumns({"added": F.size(F.array_except("new", "kinds")).cast("long"), "removed": F.size(F.array_except("kinds", "new")).cast("long")})
    return x.groupBy("added", "removed").agg(F.count("*").alias("users"), F.count_if(F.expr("added + removed > 0")).alias("changed"), F.sum("before_n").alias("before_n"), F.sum("after_n").alias("after_n"), F.sum(F.expr("after_n - before_n")).alias("delta"))


@query(f"""with {_SIGNALS}, d as (select name, host, count(*) n from s group by all), r as (select *, row_number() over (partition by name order by host) i from d)
select name, sum(n)::bigint pages, count(*) hosts, string_agg(host, ',' order by host) filter (i <= 5) first_hosts, count(*) > 5 truncated, case when count(*) > 20 then 'modeled' else 'signal only' end status from r group by 1""")
def d36_framework_coverage(spark: SparkSession, sf: str) -> DataFrame:
    """Pages and hosts of each adapter, the first five hosts, and whether there are more."""
    d = _signals(spark, sf).groupBy("name", "host").agg(F.count("*").alias("n"))
    first = d.select("name", "host", F.row_number().over(Window.partitionBy("name").orderBy("host")).alias("i")).where("i <= 5")
    first = first.groupBy("name").agg(F.array_join(F.array_sort(F.collect_list("host")), ",").alias("first_hosts"))
    total = d.groupBy("name").agg(F.sum("n").alias("pages"), F.count("*").alias("hosts"))
    status = F.when(F.col("hosts") > 20, "modeled").otherwise("signal only")
    return total.join(first, "name").select("name", "pages", "hosts", "first_hosts", (F.col("hosts") > 5).alias("truncated"), status.alias("status"))


@query("""with c as (select user_id, case event_type when 'purchase' then value when 'view' then 0 else 2 * value end cost, event_type <> 'error' done from events)
select user_id, count(*) attempts, count(*) filter (done) completed, round(sum(cost), 6) spent, round(avg(cost) filter (done) * (500 - count(*) filter (done)), 6) projected from c group by 1""")
def d42_cost(spark: SparkSession, sf: str) -> DataFrame:
    """Cost of all attempts: reported, cached for nothing, or a conservative price; and what the rest would cost at the mean."""
    kind, done = F.col("event_type"), F.col("event_type") != "error"
    cost = F.when(kind == "purchase", F.col("value")).when(kind == "view", 0).otherwise(2 * F.col("value"))
    e = table(spark, sf, "events").select("user_id", cost.alias("cost"), done.alias("done"))
    return e.groupBy("user_id").agg(F.count("*").alias("attempts"), F.count_if("done").alias("completed"), F.round(F.sum("cost"), 6).alias("spent"), F.round(F.avg(F.when(F.col("done"), F.col("cost"))) * (500 - F.count_if("done")), 6).alias("projected"))


@query("select source, count(distinct lang) upstreams, count(distinct lang) <= 1 consistent from documents group by 1")
def d43_provider_consistency(spark: SparkSession, sf: str) -> DataFrame:
    g = table(spark, sf, "documents").groupBy("source").agg(F.count_distinct("lang").alias("upstreams"))
    return g.withColumn("consistent", F.col("upstreams") <= 1)


@query("""with a as (select source, sha256(text) h, row_number() over (partition by source order by doc_id) - 1 i from documents where text is not null),
b as (select source, i // 256 i, sha256(string_agg(h, '' order by i)) h from a group by source, i // 256), c as (select source, i // 256 i, sha256(string_agg(h, '' order by i)) h from b group by source, i // 256)
select source, sha256(string_agg(h, '' order by i)) content from c group by 1""")
def d47_content_hash(spark: SparkSession, sf: str) -> DataFrame:
    """A hash of all texts of a source in their order: of each 256 texts, then of each 256 of those hashes, and once more of what is left, so that no group holds more, up to 16 million texts a source; beyond, another level has to be added to the SQL as well."""
    d = table(spark, sf, "documents").where("text is not null").select("source", "doc_id", F.sha2("text", 256).alias("h"))
    placed = ordering.running(d, ["source", "doc_id"])
    first = placed.groupBy("source").agg(F.min("place").alias("first"))
    x = placed.alias("p").join(first.alias("f"), F.col("p.source").eqNullSafe(F.col("f.source"))).select("p.source", (F.col("place") - F.col("first")).alias("i"), "h")
    joined = F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "h"))), lambda e: e["h"]), ""), 256)
    for _ in range(2):
        x = x.groupBy("source", F.expr("i div 256").alias("j")).agg(joined.alias("h")).withColumnRenamed("j", "i")
    return x.groupBy("source").agg(joined.alias("content"))


# Ordered work


@query("""with r as (select user_id, event_id, event_type, ts, sum(case event_type when 'signup' then 1 when 'purchase' then -1 else 0 end) over (partition by user_id order by ts, event_id) run from events),
a as (select user_id, event_id, event_type, list(run) over (partition by user_id order by ts, event_id rows between current row and 15 following) a from r)
select event_id, list_filter(range(1, len(a) + 1), lambda i: a[i] < a[1])[1] closed_after from a where event_type = 'signup'""")
def e10_bounded_balance(spark: SparkSession, sf: str) -> DataFrame:
    """How many rows a bracket stays open, looking sixteen rows ahead at most; null if it isn't closed there."""
    by = Window.partitionBy("user_id").orderBy("ts", "event_id")
    step = F.when(F.col("event_type") == "signup", 1).when(F.col("event_type") == "purchase", -1).otherwise(0)
    e = table(spark, sf, "events").withColumn("run", F.sum(step).over(by.rowsBetween(Window.unboundedPreceding, 0)))
    e = e.withColumn("a", F.collect_list("run").over(by.rowsBetween(0, 15))).where("event_type = 'signup'")
    closed = F.filter(F.transform("a", lambda x, i: F.when(x < F.col("a")[0], i + 1)), lambda x: x.isNotNull())
    return e.select("event_id", F.get(closed, 0).cast("long").alias("closed_after"))


@query("""with recursive e as (select c_custkey // 3 src, c_custkey dst from customer where c_custkey > 0 union select c_custkey // 5, c_custkey from customer where c_custkey > 0),
r(node, rank) as (select 0::bigint, 0 union select e.dst, r.rank + 1 from r join e on e.src = r.node)
select node, max(rank) rank from r group by 1""")
def e13_topological_rank(spark: SparkSession, sf: str) -> DataFrame:
    """The longest way from a root to each node of a graph without cycles."""
    c = table(spark, sf, "customer").select("c_custkey").where("c_custkey > 0")
    edges = c.select(F.floor(F.col("c_custkey") / 3).alias("src"), F.col("c_custkey").alias("dst")).unionByName(c.select(F.floor(F.col("c_custkey") / 5).alias("src"), F.col("c_custkey").alias("dst"))).distinct()
    return graph.peeled_ranks(edges).where("not cyclic").select("node", F.col("rank").cast("int").alias("rank"))


@query("select l_orderkey, l_linenumber, l_partkey, row_number() over (order by l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) place from lineitem")
def f01_total_order(spark: SparkSession, sf: str) -> DataFrame:
    """All rows numbered by their total order, bucket by bucket."""
    x = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    order = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]
    return joins.numbered(x, F.floor(F.col("l_orderkey") / 1000), order, "place").select("l_orderkey", "l_linenumber", "l_partkey", "place")


@query("""with w(id) as (values (3), (17), (-1)), t as (select p_partkey, p_retailprice from part order by p_retailprice desc, p_partkey limit 20)
select p_partkey, 'top' why from t union all select p_partkey, 'listed' from part join w on p_partkey = id union all select id, 'missing' from w where id not in (select p_partkey from part)""")
def f04_showcase(spark: SparkSession, sf: str) -> DataFrame:
    """The best rows by score, rows by an explicit list, and ids of the list that don't exist."""
    p = table(spark, sf, "part").select("p_partkey", "p_retailprice")
    top = p.orderBy(F.desc("p_retailprice"), "p_partkey").limit(20)
    ids = spark.range(1).select(F.explode(F.array(*(F.lit(i).cast("long") for i in (3, 17, -1)))).alias("p_partkey"))
    listed = p.join(F.broadcast(ids), "p_partkey")
    return top.select("p_partkey", F.lit("top").alias("why")).unionByName(listed.select("p_partkey", F.lit("listed").alias("why"))).unionByName(ids.join(listed, "p_partkey", "left_anti").select("p_partkey", F.lit("missing").alias("why")))


@query("with c as (select regexp_replace(o_orderpriority, '^[0-9]-', '') priority, count(*) n from orders group by 1) select priority, n, row_number() over (order by priority)::int place from c")
def f06_string_order(spark: SparkSession, sf: str) -> DataFrame:
    """Priorities in the order of their names, which isn't that of their ranks: HIGH, LOW, MEDIUM."""
    c = table(spark, sf, "orders").groupBy(F.regexp_replace("o_orderpriority", "^[0-9]-", "").alias("priority")).agg(F.count("*").alias("n"))
    return c.withColumn("place", F.row_number().over(Window.orderBy("priority")))  # a row for each priority


@query("select o_orderkey, o_custkey, row_number() over (order by o_totalprice desc, o_custkey, o_orderkey)::int place from orders where o_orderstatus <> 'F' order by place limit 100")
def f07_upgrade_queue(spark: SparkSession, sf: str) -> DataFrame:
    top = table(spark, sf, "orders").where("o_orderstatus <> 'F'").select("o_orderkey", "o_custkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_custkey", "o_orderkey").limit(100)
    return top.withColumn("place", F.row_number().over(Window.orderBy(F.desc("o_totalprice"), "o_custkey", "o_orderkey"))).drop("o_totalprice")  # the 100 rows


@query("select p_partkey, row_number() over (order by lower(upper(p_name)), p_partkey) place from part")
def f10_casefold_order(spark: SparkSession, sf: str) -> DataFrame:
    """Names without regard to case; upper, then lower case folds letters like a sharp s, too. Places come from range-partitioned tasks."""
    x = table(spark, sf, "part").select("p_partkey", F.lower(F.upper("p_name")).alias("folded"))
    return ordering.running(x, ["folded", "p_partkey"]).select("p_partkey", (F.col("place") + 1).alias("place"))


@query("select event_id, row_number() over (order by event_type, user_id, event_id) place from events")
def f11_bundle_order(spark: SparkSession, sf: str) -> DataFrame:
    bucket = F.concat_ws("-", "event_type", F.lpad(F.floor(F.col("user_id") / 100).cast("string"), 12, "0"))
    return joins.numbered(table(spark, sf, "events").select("event_id", "event_type", "user_id"), bucket, ["event_type", "user_id", "event_id"], "place").select("event_id", "place")


# Sets


@query(f"with {_HALVES} select user_id, array_to_string(list_sort(list_concat(list_filter(a.kinds, lambda x: not list_contains(b.kinds, x)), list_transform(b.kinds, lambda x: 'far ' || x))), ',') paths from a join b using (user_id)")
def g04_replaced(spark: SparkSession, sf: str) -> DataFrame:
    """Local paths go where they were expanded, and the expanded ones take their place."""
    a, b = _halves(spark, sf)
    x = a.join(b.select("user_id", F.col("kinds").alias("far")), "user_id")
    paths = F.concat(F.array_except("kinds", "far"), F.transform("far", lambda k: F.concat(F.lit("far "), k)))
    return x.select("user_id", F.array_join(F.array_sort(paths), ",").alias("paths"))


@query("""with r(id, origin, pattern) as (values ('feed', 'built in', 'utm_'), ('mobile', 'built in', '://m[.]'), ('docs', 'project', '/en/'), ('feed', 'project', 'feed')),
n as (select id, count(*) k from r group by 1), u as (select * from r where origin = 'built in' or id not in (select id from n where k > 1))
select id, origin, (select sum((k > 1)::int) from n)::bigint collisions, count(page_id) pages from u left join pages on regexp_matches(url, pattern) group by all""")
def g09_additive_rules(spark: SparkSession, sf: str) -> DataFrame:
    """Built-in rules and a project's own ones; one of those with an id that is taken is rejected."""
    rules = [("feed", "built in", "utm_"), ("mobile", "built in", "://m[.]"), ("docs", "project", "/en/"), ("feed", "project", "feed")]
    taken = {i for i, origin, _ in rules if origin == "built in"}
    kept = [r for r in rules if r[1] == "built in" or r[0] not in taken]
    counts = [F.count_if(F.col("url").rlike(p)).alias(f"n{k}") for k, (_, _, p) in enumerate(kept)]
    one = table(spark, sf, "pages").agg(*counts)
    rows = F.array(*(F.struct(F.lit(i).alias("id"), F.lit(o).alias("origin"), F.lit(len(rules) - len(kept)).cast("long").alias("collisions"), F.col(f"n{k}").alias("pages")) for k, (i, o, _) in enumerate(kept)))
    return one.select(F.explode(rows).alias("r")).select("r.*")


# Scalars


@query("""select event_id, sha256('{"event_id":' || event_id || ',"event_type":"' || event_type || '","user_id":' || user_id || '}') h from events""")
def h04_canonical_json(spark: SparkSession, sf: str) -> DataFrame:
    """A hash of the record as JSON with sorted keys and no blanks."""
    return table(spark, sf, "events").select("event_id", F.sha2(F.to_json(F.struct("event_id", "event_type", "user_id")), 256).alias("h"))


@query("""with k as (select page_id, url, regexp_extract(url, '://([^/?#]*)', 1) host from pages) select page_id, regexp_matches(url, '^https?://' || regexp_escape(host) || '/[a-z]*/') hit, host from k""")
def h07_template(spark: SparkSession, sf: str) -> DataFrame:
    """A pattern with {symbol} in it, made for each row from a literal text."""
    k = table(spark, sf, "pages").select("page_id", "url", F.regexp_extract("url", "://([^/?#]*)", 1).alias("host"))
    return k.select("page_id", F.expr("regexp(url, " + fn.template_sql("^https?://{symbol}/[a-z]*/", "host") + ")").alias("hit"), "host")


@query("select p_partkey, url_decode('q%3D' || replace(p_name, ' ', '%20') || '%C3%A9') decoded from part")
def h10_url_unquote(spark: SparkSession, sf: str) -> DataFrame:
    """Percent escapes back to text; a plus sign stays one."""
    raw = F.concat(F.lit("q%3D"), F.replace("p_name", F.lit(" "), F.lit("%20")), F.lit("%C3%A9"))
    return table(spark, sf, "part").select("p_partkey", fn.unquoted(raw).alias("decoded"))


@query("""with a as (select p_partkey, string_split(p_brand || '.' || p_type || '.' || replace(p_name, ' ', '.'), '.') a, p_size % 3 level from part)
select p_partkey, array_to_string(list_concat(a[1:len(a) - level], ['target']), '.') module from a""")
def h11_relative_module(spark: SparkSession, sf: str) -> DataFrame:
    """A name that climbs so many levels from another one."""
    whole = F.split(F.concat_ws(".", "p_brand", "p_type", F.replace("p_name", F.lit(" "), F.lit("."))), "[.]")
    return table(spark, sf, "part").select("p_partkey", fn.relative_module(whole, F.col("p_size") % 3, F.lit("target")).alias("module"))


@query(r"""with a as (select p_partkey, regexp_extract_all(p_name || ', "a,b", f(1,2), [' || p_size || ',0]', '(?:"[^"]*"|\([^)]*\)|\[[^\]]*\]|[^,])+') a from part) select p_partkey, len(a)::int parts, array_to_string(list_transform(a, lambda x: trim(x)), '|') arguments from a""")
def h13_arguments(spark: SparkSession, sf: str) -> DataFrame:
    """Arguments between commas that are outside quotes and brackets."""
    raw = F.concat("p_name", F.lit(', "a,b", f(1,2), ['), F.col("p_size").cast("string"), F.lit(",0]"))
    return table(spark, sf, "part").select("p_partkey", fn.arguments(raw).alias("a")).select("p_partkey", F.size("a").alias("parts"), F.array_join("a", "|").alias("arguments"))


@query("""select p_partkey, (p_size::bigint * (p_size - 1) * (p_size - 2)) // 6 choose3, pow(2, p_size % 20) doubled, ceil(p_retailprice / 7)::bigint up, floor(p_retailprice / 7)::bigint down, abs(p_retailprice - 900.1) <= 1e-9 * greatest(abs(p_retailprice), 900.1) near from part""")
def h22_arithmetic(spark: SparkSession, sf: str) -> DataFrame:
    """Binomials, powers, ceilings, floors, and closeness within a billionth."""
    price = F.col("p_retailprice")
    near = F.abs(price - 900.1) <= 1e-9 * F.greatest(F.abs(price), F.lit(900.1))
    return table(spark, sf, "part").select("p_partkey", F.round(fn.binomial(F.col("p_size"), F.lit(3))).cast("long").alias("choose3"), F.pow(F.lit(2.0), F.col("p_size") % 20).alias("doubled"), F.ceil(price / 7).alias("up"), F.floor(price / 7).alias("down"), near.alias("near"))


@query("""with c as (select source, lang, count(*) n from documents group by all), s as (select source, string_agg(lang || ':' || n, ';' order by lang) packed from c group by 1)
select source, packed, coalesce(regexp_extract(packed, 'en:([0-9]+)', 1), '') = '' no_english, coalesce(try_cast(regexp_extract(packed, 'de:([0-9]+)', 1) as bigint), 0) german from s""")
def h27_packed_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Counts packed into text by key, and read from there again as a map."""
    c = table(spark, sf, "documents").groupBy("source", "lang").agg(F.count("*").alias("n"))
    counts = F.map_from_entries(F.collect_list(F.struct("lang", "n")))
    s = c.where("lang is not null").groupBy("source").agg(F.array_sort(F.map_entries(counts)).alias("m"))
    packed = F.array_join(F.transform("m", lambda x: F.concat_ws(":", x["key"], x["value"].cast("string"))), ";")
    back = F.str_to_map("packed", F.lit(";"), F.lit(":"))
    return s.select("source", packed.alias("packed")).select("source", "packed", F.isnull(F.try_element_at(back, F.lit("en"))).alias("no_english"), F.coalesce(F.try_element_at(back, F.lit("de")).cast("long"), F.lit(0)).alias("german"))


@query("""select event_id, (json_extract_string(props, '$.' || coalesce(list_filter(json_keys(props), lambda k: contains(k, 'line'))[1], list_filter(json_keys(props), lambda k: contains(k, 'k'))[1])))::bigint line, '{"k":{"redacted":true,"sha256":"' || sha256((props->>'k')) || '"}}' shown from events""")
def h30_key_priority(spark: SparkSession, sf: str) -> DataFrame:
    """The value under the first key with the best token, and the record with its values blotted out."""
    m = F.from_json("props", "map<string,string>")
    has = lambda token: F.get(F.filter(F.map_keys(m), lambda k: F.contains(k, F.lit(token))), 0)
    x = table(spark, sf, "events").select("event_id", "props", m.alias("m"), F.coalesce(has("line"), has("k")).alias("key"))
    return x.select("event_id", F.try_element_at("m", F.col("key")).cast("long").alias("line"), fj.redacted_json(F.col("props"), ["k"]).alias("shown"))


def _penalty(name: Column, words: list[str], each: int) -> Column:
    return F.aggregate(F.array(*map(F.lit, words)), F.lit(0), lambda s, w: s - F.when(F.contains(name, w), each).otherwise(0))


@query("""select p_partkey, case p_type when 'PROMO' then 5 when 'ECONOMY' then 3 when 'SMALL' then 1 else 0 end + (p_size > 20)::int * 2 - 4 * contains(p_name, 'cold')::int - 4 * contains(p_name, 'small')::int score,
case when p_type = 'PROMO' and p_size > 20 then 'HIGH' when p_size > 20 then 'MEDIUM' else 'LOW' end priority from part""")
def h33_scores(spark: SparkSession, sf: str) -> DataFrame:
    """A score from a table of weights, a bonus and penalties for keywords, and the priority that cases give."""
    p = table(spark, sf, "part")
    weight = F.coalesce(F.try_element_at(F.create_map(*map(F.lit, ("PROMO", 5, "ECONOMY", 3, "SMALL", 1))), F.col("p_type")), F.lit(0))
    large = F.col("p_size") > 20
    score = weight + large.cast("int") * 2 + _penalty(F.col("p_name"), ["cold", "small"], 4)
    return p.select("p_partkey", score.alias("score"), F.when((F.col("p_type") == "PROMO") & large, "HIGH").when(large, "MEDIUM").otherwise("LOW").alias("priority"))
