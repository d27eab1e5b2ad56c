"""Queries that check samples, graphs and records against their rules, and label what they hold."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.operators import disposition, joins, verification, windows
from corpusloom.plans.registry import query
from corpusloom.sources.readers import table
from corpusloom.sources.tables import stored


@query("""with s as (select o_orderkey, o_orderpriority, o_orderstatus, row_number() over w draw, count(*) over (partition by o_orderpriority, o_orderstatus) population from orders window w as (partition by o_orderpriority, o_orderstatus order by sha256('corpusloom' || chr(0) || o_orderkey::varchar), o_orderkey)),
t as (select o_orderkey, o_orderpriority, o_orderstatus, population / least(population, 20) + (o_orderpriority = '1-URGENT')::int weight from s where draw <= 20 and not (o_orderstatus = 'F' and draw = 20) and not (o_orderpriority = '5-LOW' and o_orderstatus = 'O')),
u as (select * from t union all select * from t where o_orderstatus = 'P' and o_orderpriority = '2-HIGH' union all select -1, '2-HIGH', 'P', null),
z as (select o_orderpriority, o_orderstatus, count(*) n from orders group by all), k as (select z.*, x.taken from z left join (select o_orderpriority, o_orderstatus, count(distinct o_orderkey) taken from u group by all) x using (o_orderpriority, o_orderstatus))
select 'repeated' rule, count(*) violations from (select 1 from u group by o_orderkey having count(*) > 1) union all select 'outside', count(*) from u where o_orderkey not in (select o_orderkey from orders)
union all select 'quota', count(*) from k where taken <> least(n, 20) union all select 'uncovered', count(*) from k where taken is null
union all select 'weight', count(*) from u join k using (o_orderpriority, o_orderstatus) where weight is null or abs(weight - n / taken) > 1e-9""")
def k07_sample_audit(spark: SparkSession, sf: str) -> DataFrame:
    """A stratified sample in which rows were left out, doubled, weighed wrongly and made up, against the rules of such samples."""
    orders = table(spark, sf, "orders").select("o_orderkey", "o_orderpriority", "o_orderstatus")
    strata = ["o_orderpriority", "o_orderstatus"]
    drawn = windows.stratified(orders, strata, "o_orderkey", 20, "corpusloom")
    kept = drawn.where("not (o_orderstatus = 'F' and draw = 20) and not (o_orderpriority = '5-LOW' and o_orderstatus = 'O')")
    kept = stored(kept.select("o_orderkey", *strata, (F.col("weight") + (F.col("o_orderpriority") == "1-URGENT").cast("int")).alias("weight")), "sample")
    made_up = spark.range(1).select(F.lit(-1).cast("long").alias("o_orderkey"), F.lit("2-HIGH").alias("o_orderpriority"), F.lit("P").alias("o_orderstatus"), F.lit(None).cast("double").alias("weight"))
    sample = kept.unionByName(kept.where("o_orderstatus = 'P' and o_orderpriority = '2-HIGH'")).unionByName(made_up)
    return verification.sample_report(sample, orders, strata, "o_orderkey", 20)


_GRAPHS = """
g as (select o_orderkey graph_id, o_custkey * 100000 + floor(o_totalprice)::bigint % 1000 candidate_id, o_totalprice > 10000 verified, o_orderpriority = '5-LOW' and o_orderstatus = 'P' forbidden from orders),
n as (select l_orderkey graph_id, l_linenumber node_id, case l_returnflag when 'A' then 'source' when 'R' then 'sink' else 'step' end type from lineitem),
e as (select l_orderkey graph_id, l_linenumber src, l_linenumber + (l_suppkey % 2)::int dst from lineitem where l_discount > 0.05), v as (select l_orderkey graph_id, l_linenumber node_id from lineitem where l_tax > 0)"""


def _graphs(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Orders as graphs and their lines as nodes."""
    o, li = table(spark, sf, "orders"), table(spark, sf, "lineitem")
    graphs = o.select(F.col("o_orderkey").alias("graph_id"), (F.col("o_custkey") * 100_000 + F.floor("o_totalprice") % 1000).alias("candidate_id"), (F.col("o_totalprice") > 10_000).alias("verified"), F.expr("o_orderpriority = '5-LOW' and o_orderstatus = 'P'").alias("forbidden"))
    kind = F.when(F.col("l_returnflag") == "A", "source").when(F.col("l_returnflag") == "R", "sink").otherwise("step")
    nodes = li.select(F.col("l_orderkey").alias("graph_id"), F.col("l_linenumber").alias("node_id"), kind.alias("type"))
    edges = li.where("l_discount > 0.05").select(F.col("l_orderkey").alias("graph_id"), F.col("l_linenumber").alias("src"), (F.col("l_linenumber") + (F.col("l_suppkey") % 2).cast("int")).alias("dst"))
    return graphs, nodes, edges, li.where("l_tax > 0").select(F.col("l_orderkey").alias("graph_id"), F.col("l_linenumber").alias("node_id"))


@query(f"""with {_GRAPHS}, kn as (select distinct graph_id, node_id from n), r(type) as (values ('source'), ('sink')),
d as (select rowid_, graph_id from (select row_number() over () rowid_, * from e) x where not exists (select 1 from kn where kn.graph_id = x.graph_id and node_id = src) or not exists (select 1 from kn where kn.graph_id = x.graph_id and node_id = dst))
select graph_id, 'duplicate_candidate_id' code, null details, 1::bigint n from g where candidate_id in (select candidate_id from g group by 1 having count(*) > 1)
union all select graph_id, 'evidence_hash_not_verified', null, 1 from g where not verified union all select graph_id, 'forbidden_input_or_execution', null, 1 from g where forbidden
union all select graph_id, 'duplicate_node_id', null, 1 from (select distinct graph_id from (select graph_id from n group by graph_id, node_id having count(*) > 1))
union all select graph_id, 'missing_required_node_types', string_agg(r.type, ',' order by r.type), 1 from g, r where not exists (select 1 from n where n.graph_id = g.graph_id and n.type = r.type) group by graph_id
union all select graph_id, 'dangling_edge', null, count(*) from d group by 1
union all select graph_id, 'incomplete_view', null, count(*) from (select graph_id, node_id from kn except select graph_id, node_id from v) group by 1""")
def d38_graph_validation(spark: SparkSession, sf: str) -> DataFrame:
    """Each graph's broken rules: ids, provenance, required node types, edges and the view."""
    return verification.graph_report(*_graphs(spark, sf), ["source", "sink"])[0]


@query(f"with {_GRAPHS} select type, count(distinct graph_id) graphs from n group by 1")
def d38_node_types(spark: SparkSession, sf: str) -> DataFrame:
    """How many graphs have nodes of each type."""
    return verification.graph_report(*_graphs(spark, sf), ["source", "sink"])[1]


_STATUS = {"F": "finished", "O": "open"}
_PRIORITY = {"1-URGENT": "now", "2-HIGH": "soon", "3-MEDIUM": "later"}
_SEGMENT = {"BUILDING": "trade", "MACHINERY": "industry", "AUTOMOBILE": "industry"}
_REGION = {0: "south", 2: "east"}


@query("""select case o_orderstatus when 'F' then 'finished' when 'O' then 'open' else 'unmapped' end status, case o_orderpriority when '1-URGENT' then 'now' when '2-HIGH' then 'soon' when '3-MEDIUM' then 'later' else 'unmapped' end priority,
case c_mktsegment when 'BUILDING' then 'trade' when 'MACHINERY' then 'industry' when 'AUTOMOBILE' then 'industry' else lower(c_mktsegment) end segment, coalesce(case n_regionkey when 0 then 'south' when 2 then 'east' end, 'elsewhere') region, count(*) n
from orders left join customer on o_custkey = c_custkey left join nation on c_nationkey = n_nationkey group by all""")
def c35_four_lookups(spark: SparkSession, sf: str) -> DataFrame:
    """Four dictionaries, each with its own default: a word, a word, the value itself, a word for null as well."""
    o, c, n = table(spark, sf, "orders"), table(spark, sf, "customer"), table(spark, sf, "nation")
    x = o.join(c, F.col("o_custkey") == F.col("c_custkey"), "left").join(n, F.col("c_nationkey") == F.col("n_nationkey"), "left")
    look = lambda names, key, default: F.coalesce(F.try_element_at(F.create_map(*(F.lit(v) for kv in names.items() for v in kv)), key), default)
    status, priority = look(_STATUS, F.col("o_orderstatus"), F.lit("unmapped")), look(_PRIORITY, F.col("o_orderpriority"), F.lit("unmapped"))
    segment, region = look(_SEGMENT, F.col("c_mktsegment"), F.lower("c_mktsegment")), look(_REGION, F.col("n_regionkey"), F.lit("elsewhere"))
    return x.groupBy(status.alias("status"), priority.alias("priority"), segment.alias("segment"), region.alias("region")).agg(F.count("*").alias("n"))


@query("""with r as (select *, row_number() over (partition by user_id order by ts, event_id) r, (props->>'k')::int % 4 var from events)
select s.event_id sink, a.event_id copied, b.event_id overwritten from r s join r a on a.user_id = s.user_id and a.r between s.r - 12 and s.r - 1 join r b on b.user_id = s.user_id and b.r between s.r - 12 and s.r - 1 and a.r < b.r and a.var = b.var
where s.event_type = 'purchase' and a.event_type = 'view' and b.event_type = 'click'""")
def c39_copy_before_overwrite(spark: SparkSession, sf: str) -> DataFrame:
    """A value read, written again later, and then used: in the twelve events before each use, a window and no join. Twelve rows bound the pairs."""
    e = table(spark, sf, "events").withColumn("var", F.get_json_object("props", "$.k").cast("int") % 4)
    by = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(-12, -1)
    before = F.collect_list(F.struct("event_id", "event_type", "var")).over(by)
    x = e.withColumn("before", before).where("event_type = 'purchase'")
    pairs = F.flatten(F.transform("before", lambda a, i: F.transform(F.filter("before", lambda b, j: (j > i) & (a["event_type"] == "view") & (b["event_type"] == "click") & (a["var"] == b["var"])), lambda b: F.struct(a["event_id"].alias("copied"), b["event_id"].alias("overwritten")))))
    return x.select(F.col("event_id").alias("sink"), F.explode(pairs).alias("p")).select("sink", "p.*")


@query("""with s as (select o_custkey, list_sort(list(distinct o_orderpriority) filter (o_orderstatus = 'F')) a, list_sort(list(distinct o_orderpriority) filter (o_orderstatus = 'O')) b, list_sort(list(distinct year(o_orderdate)) filter (o_orderstatus = 'F')) c, list_sort(list(distinct year(o_orderdate)) filter (o_orderstatus = 'O')) d,
 bool_or(o_orderstatus = 'F' and o_totalprice > 300000) e, bool_or(o_orderstatus = 'O' and o_totalprice > 300000) f from orders group by 1)
select count(*) n, count(*) filter (coalesce(a, []) = coalesce(b, [])) priorities, count(*) filter (coalesce(c, []) = coalesce(d, [])) same_years, count(*) filter (e = f) large, count(*) filter (coalesce(a, []) = coalesce(b, []) and coalesce(c, []) = coalesce(d, []) and e = f) exact from s""")
def d16_exact_matches(spark: SparkSession, sf: str) -> DataFrame:
    """Three equalities of sets at once: priorities, years and whether any is large, of finished and open orders."""
    done, open_, large = F.col("o_orderstatus") == "F", F.col("o_orderstatus") == "O", F.col("o_totalprice") > 300_000
    of = lambda who, what: F.array_sort(F.collect_set(F.when(who, what)))
    year = F.year("o_orderdate")
    s = table(spark, sf, "orders").groupBy("o_custkey").agg(
        (of(done, F.col("o_orderpriority")) == of(open_, F.col("o_orderpriority"))).alias("p"), (of(done, year) == of(open_, year)).alias("y"), (F.bool_or(done & large) == F.bool_or(open_ & large)).alias("l")
    )
    return s.agg(F.count("*").alias("n"), F.count_if("p").alias("priorities"), F.count_if("y").alias("same_years"), F.count_if("l").alias("large"), F.count_if(F.expr("p and y and l")).alias("exact"))


@query("""with p as (select lang, n_chars < 1000 short, contains(text, '!') loud, contains(text, 'http') linked from documents)
select method, field, case when v then 'positive' else 'negative' end polarity, count(*) n from (select lang method, unnest(['short', 'loud', 'linked']) field, unnest([short, loud, linked]) v from p) where v is not null group by all""")
def d46_polarity_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Predictions by method (language), field and polarity."""
    fields = {"short": F.col("n_chars") < 1000, "loud": F.contains("text", F.lit("!")), "linked": F.contains("text", F.lit("http"))}
    d = table(spark, sf, "documents").select(F.col("lang").alias("method"), F.explode(F.array(*(F.struct(F.lit(f).alias("field"), c.alias("v")) for f, c in fields.items()))).alias("x")).select("method", "x.*")
    return d.where("v is not null").groupBy("method", "field", F.when(F.col("v"), "positive").otherwise("negative").alias("polarity")).agg(F.count("*").alias("n"))


@query("""with g as (select o_custkey, list_sort(list(distinct o_orderkey)) members, list_sort(list(distinct o_orderstatus)) impacts, list_sort(list(distinct substr(o_orderpriority, 1, 1))) levels, count(*) n from orders where o_totalprice > 200000 group by 1)
select o_custkey, array_to_string(members, ';') members, array_to_string(impacts, ';') impacts, array_to_string(levels, ';') levels, n from g""")
def d40_consolidated_cases(spark: SparkSession, sf: str) -> DataFrame:
    """Cases of a customer: members, the union of two kinds of impacts, and their number."""
    text = lambda c: F.array_join(F.array_sort(F.collect_set(c)).cast("array<string>"), ";")
    g = table(spark, sf, "orders").where("o_totalprice > 200000").groupBy("o_custkey")
    return g.agg(text("o_orderkey").alias("members"), text("o_orderstatus").alias("impacts"), text(F.substring("o_orderpriority", 1, 1)).alias("levels"), F.count("*").alias("n"))


@query("""with p as (select doc_id, n_chars < 1000 predicted, lang, source from documents), w as (select lang, source, count(*) / 7.0 weight from documents join labels using (doc_id) group by all)
select p.lang, count(*) predictions, count(l.doc_id) with_gold, count(*) filter (l.doc_id is not null and w.weight is not null) used, count(*) filter (l.doc_id is null or w.weight is null) ignored, round(sum(case when l.toxic = 1 and predicted then w.weight else 0 end), 6) weighted_hits
from p left join labels l using (doc_id) left join w on w.lang is not distinct from p.lang and w.source is not distinct from p.source group by 1""")
def c24_weighted_predictions(spark: SparkSession, sf: str) -> DataFrame:
    """Predictions joined to gold labels and to the weights of their strata; what lacks either is counted as ignored."""
    p = table(spark, sf, "documents").select("doc_id", (F.col("n_chars") < 1000).alias("predicted"), "lang", "source")
    gold = table(spark, sf, "labels").select("doc_id", "toxic", F.lit(True).alias("_gold"))
    w = p.join(gold, "doc_id").groupBy(F.col("lang").alias("_l"), F.col("source").alias("_s")).agg((F.count("*") / 7.0).alias("weight"))
    x = p.join(gold, "doc_id", "left").join(w, F.col("lang").eqNullSafe(F.col("_l")) & F.col("source").eqNullSafe(F.col("_s")), "left")
    used = F.col("_gold").isNotNull() & F.col("weight").isNotNull()
    hits = F.round(F.sum(F.when((F.col("toxic") == 1) & F.col("predicted"), F.coalesce("weight", F.lit(0.0))).otherwise(0.0)), 6)
    return x.groupBy("lang").agg(F.count("*").alias("predictions"), F.count("_gold").alias("with_gold"), F.count_if(used).alias("used"), F.count_if(~used).alias("ignored"), hits.alias("weighted_hits"))


@query("""with f as (select l_partkey, l_suppkey, l_returnflag, l_linestatus, count(*) n, min(l_orderkey) found from lineitem where l_quantity > 25 group by all),
m as (select l_partkey, l_suppkey, l_returnflag, l_linestatus, count(*) n from lineitem where l_quantity <= 25 group by all)
select m.l_returnflag, count(*) mutations, count(*) filter (f.n is null) unmatched, count(*) filter (f.n = 1 and m.n = 1) one_to_one, count(*) filter (f.n > 1) findings_repeat, count(*) filter (f.n is not null and m.n > 1) mutations_repeat, sum(case when f.n = 1 then found end)::bigint found
from m left join f using (l_partkey, l_suppkey, l_returnflag, l_linestatus) group by 1""")
def c16_matched_once(spark: SparkSession, sf: str) -> DataFrame:
    """Mutations joined to findings on four keys: how many match once, and which side repeats where they don't."""
    li, keys = table(spark, sf, "lineitem"), ["l_partkey", "l_suppkey", "l_returnflag", "l_linestatus"]
    f = li.where("l_quantity > 25").groupBy(*keys).agg(F.count("*").alias("fn"), F.min("l_orderkey").alias("found"))
    m = li.where("l_quantity <= 25").groupBy(*keys).agg(F.count("*").alias("mn"))
    n = lambda c, name: F.count_if(F.expr(c)).alias(name)
    return m.join(f, keys, "left").groupBy("l_returnflag").agg(F.count("*").alias("mutations"), n("fn is null", "unmatched"), n("fn = 1 and mn = 1", "one_to_one"), n("fn > 1", "findings_repeat"), n("fn is not null and mn > 1", "mutations_repeat"), F.sum(F.when(F.col("fn") == 1, F.col("found"))).alias("found"))


@query("select l.doc_id, quality, lang, n_chars from labels l join documents d on l.doc_id = d.doc_id")
def c18_checked_join(spark: SparkSession, sf: str) -> DataFrame:
    """Labels with their documents; a label without one, or with two, ends the job with an error that names it."""
    return joins.total_join(table(spark, sf, "labels").select("doc_id", "quality"), table(spark, sf, "documents").select("doc_id", "lang", "n_chars"), ["doc_id"], "documents")


@query("""select event_id, strftime(make_timestamp((epoch_us(ts) // 1000000) * 1000000), '%Y-%m-%dT%H:%M:%SZ') stamp, max(strftime(make_timestamp((epoch_us(ts) // 1000000) * 1000000), '%Y-%m-%dT%H:%M:%SZ')) over (partition by user_id) last_stamp from events""")
def h24_epoch_stamps(spark: SparkSession, sf: str) -> DataFrame:
    """Seconds since the epoch as ISO 8601 in UTC, whatever the session's zone, and the last one of each user by text order."""
    seconds = F.timestamp_diff("SECOND", F.lit("1970-01-01").cast("timestamp_ntz"), F.col("ts"))
    e = table(spark, sf, "events").select("event_id", "user_id", seconds.alias("s"))
    stamp = F.concat(F.date_format(F.timestamp_add("SECOND", F.col("s").cast("int"), F.lit("1970-01-01").cast("timestamp_ntz")), "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z"))
    x = e.select("event_id", "user_id", stamp.alias("stamp"))
    last = x.groupBy("user_id").agg(F.max("stamp").alias("last_stamp"))
    return x.join(last, "user_id").select("event_id", "stamp", "last_stamp")


@query("""with s as (select p_partkey, lower(p_type) || '_' || lower(replace(p_name, ' ', '_')) s from part) select p_partkey, array_to_string(list_transform(string_split(replace(s, '_', ' '), ' '), lambda w: upper(w[1]) || w[2:]), ' ') title from s""")
def h15_rule_titles(spark: SparkSession, sf: str) -> DataFrame:
    """Names with underscores as titles."""
    name = F.concat_ws("_", F.lower("p_type"), F.lower(F.replace("p_name", F.lit(" "), F.lit("_"))))
    return table(spark, sf, "part").select("p_partkey", F.initcap(F.replace(name, F.lit("_"), F.lit(" "))).alias("title"))


_KINDS = {"boundary": "[0-9]{3}", "record": "@", "local": "the ", "marker": "!", "stub": "license", "trace": "http"}


@query("select doc_id, array_to_string(list_sort(list_filter([" + ", ".join(f"case when regexp_matches(text, '{p}') then '{k}' end" for k, p in _KINDS.items()) + "], lambda x: x is not null)), ';') kinds from documents")
def h36_proof_kinds(spark: SparkSession, sf: str) -> DataFrame:
    """Six kinds of proof that a text may show, as a sorted set."""
    kinds = F.array(*(F.when(F.col("text").rlike(p), k) for k, p in _KINDS.items()))
    return table(spark, sf, "documents").select("doc_id", F.array_join(F.array_sort(F.array_compact(kinds)), ";").alias("kinds"))


@query("""with a as (select distinct l_partkey from lineitem where l_returnflag = 'R'), b as (select distinct l_partkey from lineitem where l_returnflag = 'A') select coalesce(a.l_partkey, b.l_partkey) l_partkey, case when b.l_partkey is null then 'first only' when a.l_partkey is null then 'second only' else 'both' end side from a full join b on a.l_partkey = b.l_partkey""")
def g05_set_sides(spark: SparkSession, sf: str) -> DataFrame:
    """Intersection and both differences of two candidate sets by one aggregation."""
    x = table(spark, sf, "lineitem").where("l_returnflag in ('R', 'A')").groupBy("l_partkey").agg(F.bool_or(F.col("l_returnflag") == "R").alias("a"), F.bool_or(F.col("l_returnflag") == "A").alias("b"))
    return x.select("l_partkey", F.when(F.expr("a and b"), "both").when(F.col("a"), "first only").otherwise("second only").alias("side"))


_CASES = """
c as (select o_orderkey gt_id, 'customer/' || o_custkey repository, case o_orderpriority when '1-URGENT' then 'command_execution' when '2-HIGH' then 'filesystem_write' when '3-MEDIUM' then 'network_access' when '4-NOT SPECIFIED' then 'dynamic_code_execution' else 'other' end category,
 l.boundary, l.marker, l.stub, l.trace, case when o_totalprice > 200000 then 'Unauthenticated default_workflow' else 'reviewed' end said, case when o_totalprice < 50000 then false when o_totalprice < 150000 then true end auth, o_orderstatus <> 'P' behavior, o_totalprice > 400000 vulnerability, o_totalprice < 20000 denied, case when l.trace then 'traced' end basis
 from orders join (select l_orderkey, bool_or(l_returnflag = 'R') boundary, bool_or(l_linestatus = 'O' and l_tax > 0.04) marker, bool_or(l_discount > 0.09) stub, bool_or(l_quantity > 40) trace from lineitem group by 1) l on o_orderkey = l_orderkey),
s as (select *, case category when 'command_execution' then 6 when 'dynamic_code_execution' then 6 when 'filesystem_write' then 4 when 'network_access' then 3 else 0 end + 3 * boundary::int + 2 * marker::int + 2 * stub::int + trace::int + 2 * coalesce(not auth, false)::int - 4 * denied::int score from c),
q as (select *, case when boundary and score >= 10 then 'priority_boundary_impact_followup' when category in ('command_execution', 'dynamic_code_execution') then 'impactful_behavior_needs_boundary_validation' else 'behavior_gt_needs_additional_validation' end tier from s where behavior and not vulnerability and not denied)"""


def _cases(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as confirmed behaviours: their lines give the proofs, prices the claims."""
    any_of = lambda c: F.bool_or(F.expr(c))
    proofs = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(
        any_of("l_returnflag = 'R'").alias("boundary_or_reachability"), any_of("l_linestatus = 'O' and l_tax > 0.04").alias("runtime_marker"), any_of("l_discount > 0.09").alias("runtime_stub_or_monkeypatch"), any_of("l_quantity > 40").alias("source_trace")
    )
    names = ["boundary_or_reachability", "runtime_marker", "runtime_stub_or_monkeypatch", "source_trace"]
    shown = proofs.select(F.col("l_orderkey").alias("gt_id"), F.array_compact(F.array(*(F.when(F.col(n), n) for n in names))).alias("proofs"), F.when(F.col("source_trace"), "traced").alias("basis"))
    kinds = F.create_map(*map(F.lit, ("1-URGENT", "command_execution", "2-HIGH", "filesystem_write", "3-MEDIUM", "network_access", "4-NOT SPECIFIED", "dynamic_code_execution")))
    price = F.col("o_totalprice")
    rows = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("gt_id"), F.concat(F.lit("customer/"), F.col("o_custkey").cast("string")).alias("repository"), F.coalesce(F.try_element_at(kinds, F.col("o_orderpriority")), F.lit("other")).alias("category"),
        F.when(price > 200_000, F.array(F.lit("Unauthenticated"), F.lit("default_workflow"))).otherwise(F.array(F.lit("reviewed"))).alias("statuses"), F.when(price < 50_000, F.lit(False)).when(price < 150_000, F.lit(True)).alias("auth_supplied"),
        (F.col("o_orderstatus") != "P").alias("behavior"), (price > 400_000).alias("vulnerability"), (price < 20_000).alias("denied"),
    )
    return rows.join(shown, "gt_id")


@query(f"""with {_CASES} select 'VGU-' || case when r < 100 then lpad(r::varchar, 3, '0') else r::varchar end upgrade_id, gt_id, repository, score, tier,
array_to_string(list_filter([case when not boundary then 'confirm_untrusted_or_cross_boundary_reachability' end, case when said = 'reviewed' and coalesce(auth, true) then 'confirm_authentication_authorization_boundary' end, case when not marker and not stub then 'add_runtime_or_stubbed_impact_observation' end,
 case when category in ('command_execution', 'dynamic_code_execution') then 'document_non_destructive_impact_marker_and_privilege_context' else 'document_concrete_confidentiality_integrity_availability_impact' end, case when said = 'reviewed' then 'check_default_or_documented_deployment_exposure' end, 'prepare_private_maintainer_report_before_public_claim'], lambda x: x is not null), ';') missing
from (select *, row_number() over (order by score desc, repository, gt_id) r from q)""")
def f07_upgrade_order(spark: SparkSession, sf: str) -> DataFrame:
    """The whole queue of behaviours to follow up, numbered, with what each one lacks."""
    return disposition.upgrade_queue(_cases(spark, sf)).withColumn("missing", F.array_join("missing", ";"))


@query(f"""with {_CASES} select s.gt_id, case when s.vulnerability then 'vulnerability_gt' when tier is not null then 'pending_upgrade_or_disclosure' when s.denied then 'guarded_not_vulnerability' else 'pending_upgrade_or_disclosure' end disposition,
case when s.vulnerability then 'confirmed_boundary_and_impact_reproduction' when tier is not null then tier when s.denied then coalesce(s.basis, 'explicit_not_a_vulnerability_claim') else 'behavior_confirmed_but_disposition_not_explicit' end basis from s left join q using (gt_id)""")
def j08_dispositions(spark: SparkSession, sf: str) -> DataFrame:
    """Where every behaviour stands, against the queue of those to follow up."""
    rows = stored(_cases(spark, sf), "cases")
    return disposition.dispositions(rows, disposition.upgrade_queue(rows))


@query("""with m as (select c_custkey place, c_name repo, sha1(c_name || case when c_acctbal < -990 then '' else 'x' end) commit_, case when c_acctbal > 9990 then 'dirty' else 'true' end clean, case when c_custkey in (select o_custkey from orders) then 1 else 0 end files, c_nationkey * 100000 + floor(c_acctbal)::bigint sample_id from customer),
x as (select repo, array_to_string(list_filter([case when not regexp_full_match(case when clean = 'dirty' then upper(commit_) || 'z' else commit_ end, '[0-9a-fA-F]{40}') then 'commit' end, case when clean <> 'true' then 'not clean' end, case when files = 0 then 'empty' end, case when count(*) over (partition by sample_id) > 1 then 'repeated id' end], lambda v: v is not null), ',') errors from m)
select repo, errors from x where errors <> ''""")
def k08_manifest_audit(spark: SparkSession, sf: str) -> DataFrame:
    """A manifest made of customers: commits of 40 hex digits, clean trees, files to be there, sample ids once each."""
    c, o = table(spark, sf, "customer"), table(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey")).distinct().withColumn("files", F.lit(1))
    dirty = F.col("c_acctbal") > 9990
    commit = F.sha1(F.concat("c_name", F.when(F.col("c_acctbal") < -990, "").otherwise("x")))
    m = c.join(o, "c_custkey", "left").select(F.col("c_name").alias("repo"), F.when(dirty, F.concat(F.upper(commit), F.lit("z"))).otherwise(commit).alias("commit"), dirty.alias("dirty"), F.col("files").isNull().alias("empty"), (F.col("c_nationkey") * 100_000 + F.floor("c_acctbal")).alias("sample_id"))
    twice = m.groupBy("sample_id").agg((F.count("*") > 1).alias("again"))
    errors = F.array_compact(F.array(F.when(~F.col("commit").rlike("^[0-9a-fA-F]{40}$"), "commit"), F.when(F.col("dirty"), "not clean"), F.when(F.col("empty"), "empty"), F.when(F.col("again"), "repeated id")))
    return m.join(twice, "sample_id").select("repo", F.array_join(errors, ",").alias("errors")).where("errors <> ''")


@query("""select o_orderkey, coalesce(c_mktsegment, 'unknown') segment, coalesce(n_name, 'unknown') home from orders left join (select * from customer where c_acctbal > 0) on o_custkey = c_custkey left join nation on c_nationkey = n_nationkey""")
def c28_manifest_or_unknown(spark: SparkSession, sf: str) -> DataFrame:
    """Graphs (orders) with what a manifest (customers in credit, and their nations) says of them, or `unknown`."""
    listed = table(spark, sf, "customer").where("c_acctbal > 0").join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"), "left").select("c_custkey", "c_mktsegment", "n_name")
    x = table(spark, sf, "orders").join(listed, F.col("o_custkey") == F.col("c_custkey"), "left")
    return x.select("o_orderkey", F.coalesce("c_mktsegment", F.lit("unknown")).alias("segment"), F.coalesce("n_name", F.lit("unknown")).alias("home"))
