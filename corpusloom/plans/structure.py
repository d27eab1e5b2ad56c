"""Queries over spans, graphs, names, evidence and nested records."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import json as fj
from corpusloom.functions import text as fn
from corpusloom.operators import graph, intervals, ordering, resolution
from corpusloom.plans.registry import query
from corpusloom.sources.file_tree import scan_tree
from corpusloom.sources.readers import table
from corpusloom.sources.snapshots import Snapshots
from corpusloom.sources.tables import scratch, shared_dir, stored


def _days(c: str) -> Column:
    return F.date_diff(F.col(c).cast("date"), F.lit("1970-01-01").cast("date")).cast("long")


@query("""with d as (select l_orderkey, max(date_diff('day', date '1970-01-01', l_shipdate::date)) last_day from lineitem group by 1),
s as (select o_custkey, o_orderkey, date_diff('day', date '1970-01-01', o_orderdate::date) low, greatest(last_day, date_diff('day', date '1970-01-01', o_orderdate::date)) high from orders join d on o_orderkey = l_orderkey),
p as (select l_orderkey, l_linenumber, l_orderkey * 8 + l_linenumber line, o_custkey, date_diff('day', date '1970-01-01', l_shipdate::date) "at" from lineitem join orders on l_orderkey = o_orderkey),
u as (select line, o_custkey, min("at") "at" from p group by all)
select line, arg_min(s.o_orderkey, (high - low, s.o_orderkey)) span, min(high - low) width from u join s on u.o_custkey = s.o_custkey and "at" between low and high group by 1""")
def c05_smallest_enclosing(spark: SparkSession, sf: str) -> DataFrame:
    """The narrowest of a customer's orders, from its date to its last shipment, that holds each shipment's day: spans and points are two tables."""
    orders, items = table(spark, sf, "orders"), table(spark, sf, "lineitem")
    last = items.groupBy("l_orderkey").agg(F.max(_days("l_shipdate")).alias("last_day"))
    spans = orders.join(last, orders["o_orderkey"] == last["l_orderkey"]).select("o_custkey", "o_orderkey", _days("o_orderdate").alias("low"), F.greatest("last_day", _days("o_orderdate")).alias("high"))
    points = items.join(orders.select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    points = points.select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("line"), "o_custkey", _days("l_shipdate").alias("at")).groupBy("line", "o_custkey").agg(F.min("at").alias("at"))
    return intervals.smallest_enclosing(points, spans, "o_custkey", "at", "low", "high", "line", "o_orderkey").withColumnRenamed("o_orderkey", "span")


_CALLS = """
k as (select event_id, user_id, event_type, (props->>'k')::int k from events),
par as (select user_id f, event_type name, row_number() over (partition by user_id order by min(event_id)) - 1 pos from k group by user_id, event_type),
site as (select a.event_id site, a.user_id caller, b.user_id callee, a.event_type kind, b.k % 5 spot, c.event_type name from k a join k b on b.event_id = a.event_id + 1 join k c on c.event_id = a.event_id + 2 where a.event_type in ('error', 'purchase') and b.event_type = 'signup'),
kw as (select site, caller, callee, name own, case spot when 0 then 'click' when 1 then 'error' when 2 then 'purchase' when 3 then 'signup' else 'view' end keyword from site where kind = 'purchase'),
flow as (select distinct callee, p.name callee_param, caller, s.name caller_param, site from site s join par p on p.f = callee and p.pos = spot join par o on o.f = caller and o.name = s.name where kind = 'error'
 union select distinct callee, keyword, caller, own, site from kw join par p on p.f = callee and p.name = keyword join par o on o.f = caller and o.name = own),
entry as (select f from par where pos = 0 and name = 'view')"""


def _call_tables(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """parameters, sites, arguments and entries read from events: users are functions, their kinds of events the parameters, and an event calls the next one's user."""
    e = stored(table(spark, sf, "events").select("event_id", "user_id", "event_type", F.get_json_object("props", "$.k").cast("int").alias("k")), "calls")
    first = e.groupBy("user_id", "event_type").agg(F.min("event_id").alias("first"))
    kinds = first.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("first", "event_type"))).alias("kinds"))  # a few kinds of events
    parameters = kinds.select(F.col("user_id").alias("function"), F.posexplode("kinds.event_type").alias("pos", "name"))
    a = e.where("event_type in ('error', 'purchase')").select(F.col("event_id").alias("site"), F.col("user_id").alias("caller"), F.col("event_type").alias("kind"))
    b = e.where("event_type = 'signup'").select((F.col("event_id") - 1).alias("site"), F.col("user_id").alias("callee"), (F.col("k") % 5).alias("at"))
    c = e.select((F.col("event_id") - 2).alias("site"), F.col("event_type").alias("name"))
    made = stored(a.join(b, "site").join(c, "site"), "sites")
    keyword = F.get(F.array(*map(F.lit, ("click", "error", "purchase", "signup", "view"))), "at")
    by_place = F.col("kind") == "error"
    arguments = made.select("site", F.when(by_place, F.col("at")).alias("pos"), F.when(~by_place, keyword).alias("keyword"), "name")
    sites = made.select("site", "caller", "callee", F.col("site").alias("line"))
    return parameters, sites, arguments, parameters.where("pos = 0 and name = 'view'").select("function")


@query(f"""with recursive {_CALLS},
w as (select f target, name parameter, f fn, name par, 0 depth, false done, null::bigint entry, name path, '|' || f || '/' || name || '|' seen, null::bigint site from par where name = 'signup'
 union all select w.target, w.parameter, flow.caller, flow.caller_param, depth + 1, caller in (select f from entry), case when caller in (select f from entry) then caller end, path || '>' || caller || '>' || caller_param, seen || caller || '/' || caller_param || '|', flow.site
 from w join flow on w.fn = flow.callee and w.par = flow.callee_param where not w.done and depth < 6 and (caller in (select f from entry) or not contains(seen, '|' || caller || '/' || caller_param || '|')))
select target, parameter, entry, par entry_param, depth, site, path from w where done""")
def c10_incoming_paths(spark: SparkSession, sf: str) -> DataFrame:
    """Every way, six calls at most, by which an entry's parameter reaches the `signup` parameter of a user, with the mapping of arguments at each call."""
    parameters, sites, arguments, entries = _call_tables(spark, sf)
    flows = graph.argument_flows(parameters, sites, arguments)
    targets = parameters.where("name = 'signup'").select("function", F.col("name").alias("parameter"))
    return graph.incoming_paths(flows, targets, entries).select("target", "parameter", "entry", "entry_param", "depth", "site", F.array_join("path", ">").alias("path"))


_LOOPED = "fwd as (select distinct c_custkey // 3 src, c_custkey dst from customer where c_custkey > 0 union select c_custkey // 5, c_custkey from customer where c_custkey > 0), back as (select c_custkey src, c_custkey // 3 dst from customer where c_acctbal < -900 and c_custkey >= 100), e as (select * from fwd union select * from back)"


@query(f"""with recursive {_LOOPED},
bad(node) as (select src from back union select dst from back union select e.dst from e join bad on e.src = bad.node),
good as (select node from (select src node from e union select dst from e) where node not in (select node from bad)),
sound as (select src, dst from e join good on dst = node),
r(node, rank) as (select node, 0 from good where node not in (select dst from e) union select sound.dst, r.rank + 1 from r join sound on sound.src = r.node),
top as (select max(rank) top from (select node, rank from r union all select e.dst, rank + 1 from r join e on e.src = r.node))
select node, max(rank)::bigint rank, false cyclic from r group by 1 union all select node, (select top from top) + row_number() over (order by node), true from (select distinct node from bad)""")
def e13_peeled_ranks(spark: SparkSession, sf: str) -> DataFrame:
    """Ranks by peeling a graph with cycles: nodes on or behind one are put after all others, in order."""
    c = table(spark, sf, "customer").select("c_custkey", "c_acctbal")
    edge = lambda n, where, flip=False: c.where(where).select(*((F.floor(F.col("c_custkey") / n), F.col("c_custkey")) if not flip else (F.col("c_custkey"), F.floor(F.col("c_custkey") / n)))).toDF("src", "dst")
    return graph.peeled_ranks(edge(3, "c_custkey > 0").unionByName(edge(5, "c_custkey > 0")).unionByName(edge(3, "c_acctbal < -900 and c_custkey >= 100", True)))


@query("""select l_suppkey, quantile_cont(l_extendedprice, 0.5) median, quantile_cont(l_extendedprice, 0.9) p90, quantile_disc(l_extendedprice, 0.95) p95_rank, coalesce(quantile_disc(case when l_returnflag = 'R' and l_quantity > 49 then l_tax end, 0.5), 0.0) returned_tax from lineitem group by 1""")
def d27_nearest_rank(spark: SparkSession, sf: str) -> DataFrame:
    """Exact percentiles of many groups by counts and running sums; a group without values has 0.0 at a nearest rank."""
    x = table(spark, sf, "lineitem").select("l_suppkey", "l_extendedprice", F.when((F.col("l_returnflag") == "R") & (F.col("l_quantity") > 49), F.col("l_tax")).alias("tax"))
    prices = ordering.percentiles(x, ["l_suppkey"], "l_extendedprice", {"median": ("linear", 0.5), "p90": ("linear", 0.9), "p95_rank": ("rank", 0.95)})
    return prices.join(ordering.percentiles(x, ["l_suppkey"], "tax", {"returned_tax": ("rank", 0.5)}), "l_suppkey")


_NESTED = """i as (select l_orderkey, l_linenumber, l_partkey, l_returnflag from lineitem), n as (select l_orderkey, count(*) n, max(l_partkey) big, {0} rows from i group by 1)"""


def _nested(spark: SparkSession, sf: str) -> DataFrame:
    """An order's lines as one nested record: texts, numbers, flags, objects and arrays under keys to be hidden."""
    i = table(spark, sf, "lineitem").groupBy("l_orderkey", "l_linenumber", "l_partkey").agg(F.max("l_returnflag").alias("flag"))
    line = F.struct(F.col("l_linenumber").alias("no"), F.struct(F.concat(F.lit('say "'), F.col("l_partkey").cast("string"), F.lit('"')).alias("thinking"), F.lit(True).alias("kept")).alias("step"))
    g = i.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(line)).alias("lines"))
    return g.select("l_orderkey", F.to_json(F.struct(F.col("lines").alias("z"), F.lit("plain").alias("a"), F.struct(F.size("lines").alias("thinking"), F.array(F.size("lines")).alias("b")).alias("m"))).alias("json"))


_LINES = "i as (select l_orderkey, l_linenumber, l_partkey from lineitem group by all)"


@query(f"""with {_LINES}, s as (select l_orderkey, count(*) n, string_agg('{{"no":' || l_linenumber || ',"step":{{"thinking":{{"redacted":true,"character_count":' || length('say "' || l_partkey || '"') || ',"sha256":"' || sha256('say "' || l_partkey || '"') || '"}},"kept":true}}}}', ',' order by l_linenumber, 'say "' || l_partkey || '"') z from i group by 1)
select l_orderkey, '{{"z":[' || z || '],"a":"plain","m":{{"thinking":{{"redacted":true,"sha256":"' || sha256(n::varchar) || '"}},"b":[' || n || ']}}}}' shown from s""")
def h31_nested_redaction(spark: SparkSession, sf: str) -> DataFrame:
    """What lies under a key is blotted out at any depth, in objects and arrays, whatever it is."""
    return _nested(spark, sf).select("l_orderkey", fj.redacted_json(F.col("json"), ["thinking"]).alias("shown"))


@query(f"""with {_LINES}, s as (select l_orderkey, count(*) n, string_agg('{{"no":' || l_linenumber || ',"step":{{"kept":true,"thinking":"say \\"' || l_partkey || '\\""}}}}', ',' order by l_linenumber, 'say "' || l_partkey || '"') z from i group by 1)
select l_orderkey, sha256('{{"a":"plain","m":{{"b":[' || n || '],"thinking":' || n || '}},"z":[' || z || ']}}') digest from s""")
def h04_nested_digest(spark: SparkSession, sf: str) -> DataFrame:
    """A digest that equal nested records share, whatever the order of their keys."""
    return _nested(spark, sf).select("l_orderkey", F.sha2(fj.canonical_json(F.col("json")), 256).alias("digest"))


@query(f"""with {_LINES}, s as (select l_orderkey, count(*) n, string_agg('{{"no":' || l_linenumber || ',"step":{{"kept":true}}}}', ',' order by l_linenumber) z from i group by 1)
select l_orderkey, '{{"z":[' || z || '],"m":{{"b":[' || n || ']}}}}' pruned from s""")
def h32_pruned_schema(spark: SparkSession, sf: str) -> DataFrame:
    """Nested records without the keywords that a reader of theirs refuses, at any depth."""
    return _nested(spark, sf).select("l_orderkey", fj.pruned_json(F.col("json"), ["thinking", "a", "title"]).alias("pruned"))


@query("""with e as (select l_orderkey, l_linenumber, case when l_returnflag = 'R' then 'run_exec_' || l_linenumber else 'call_' || l_linenumber end k, min(l_partkey) line, bool_or(l_linestatus = 'O') plain from lineitem group by all),
c as (select l_orderkey, (contains(k, 'exec') = false)::int priority, line, k from e where not plain),
b as (select l_orderkey, arg_min(line, (priority, line, k)) line, arg_min(k, (priority, line, k)) key from c group by 1)
select o.l_orderkey, b.line, b.key from (select distinct l_orderkey from lineitem) o left join b on o.l_orderkey = b.l_orderkey""")
def h30_nested_priority(spark: SparkSession, sf: str) -> DataFrame:
    """The line of the best entry of a nested record: keys with a token first, then the least line; entries that are no objects don't count."""
    name = F.concat(F.when(F.col("l_returnflag") == "R", "run_exec_").otherwise("call_"), F.col("l_linenumber").cast("string"))
    e = table(spark, sf, "lineitem").groupBy("l_orderkey", name.alias("k")).agg(F.min("l_partkey").alias("line"), F.bool_or(F.col("l_linestatus") == "O").alias("plain"))
    value = F.when(F.col("plain"), F.concat(F.lit('"'), F.col("line").cast("string"), F.lit('"'))).otherwise(F.to_json(F.struct("line")))
    entry = F.concat(F.lit('"'), "k", F.lit('":'), value)
    records = e.groupBy("l_orderkey").agg(F.concat(F.lit("{"), F.array_join(F.collect_list(entry), ","), F.lit("}")).alias("json"))
    return records.select("l_orderkey", fj.best_line(F.col("json"), ["exec", "spawn"]).alias("b")).select("l_orderkey", "b.line", "b.key")


@query(r"""with recursive t as (select p_partkey, p_name || ', f(g(1,2),[3,(' || p_size || ',4)]), "a\",b", x}' s from part),
w as (select p_partkey, s, 1 i, 0 depth, '' quote, false esc, '' acc from t
 union all select p_partkey, s, i + 1, case when quote <> '' then depth when c in ('(', '[', '{') then depth + 1 when c in (')', ']', '}') then greatest(depth - 1, 0) else depth end,
 case when quote <> '' and (esc or c <> quote) then quote when quote = '' and c in ('''', '"', '`') then c else '' end, quote <> '' and not esc and c = '\', acc || case when quote = '' and depth = 0 and c = ',' then chr(1) else c end
 from (select *, s[i] c from w where i <= length(s)))
select p_partkey, len(string_split(acc, chr(1)))::int parts, array_to_string(list_transform(string_split(acc, chr(1)), lambda x: trim(x)), '|') arguments from w where i = length(s) + 1""")
def h13_nested_arguments(spark: SparkSession, sf: str) -> DataFrame:
    """Arguments between commas, brackets nested to any depth and quotes with escapes."""
    raw = F.concat("p_name", F.lit(", f(g(1,2),[3,("), F.col("p_size").cast("string"), F.lit(',4)]), "a\\",b", x}'))
    return table(spark, sf, "part").select("p_partkey", fn.arguments(raw).alias("a")).select("p_partkey", F.size("a").alias("parts"), F.array_join("a", "|").alias("arguments"))


_BODY = """l as (select l_orderkey, l_linenumber n, min(l_returnflag) f from lineitem group by all), b as (select l_orderkey, n, row_number() over w i, (f = 'A')::int - (f = 'R')::int step, f from l window w as (partition by l_orderkey order by n)),
r as (select *, sum(step) over w open, bool_or(f = 'A') over w begun, count(*) over (partition by l_orderkey) lines from b window w as (partition by l_orderkey order by i))"""


@query(f"with {_BODY} select l_orderkey, coalesce(min(case when begun and open <= 0 then i end), max(lines))::int body_end from r group by 1")
def e09_body_end(spark: SparkSession, sf: str) -> DataFrame:
    """Where braces that an order's lines open are closed: A opens, R closes, N has a brace in quotes only."""
    flag = F.col("f")
    text = F.when(flag == "A", "f(x) {").when(flag == "R", "} // end").otherwise("s = '{';")
    rows = table(spark, sf, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_returnflag").alias("f"))
    body = rows.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", text.alias("line"))))["line"].alias("body"))
    return body.select("l_orderkey", fn.body_end(F.col("body")).alias("body_end"))


_NAMES = r"""
h as (select page_id, regexp_extract(url, '://([^/?#]*)', 1) host, regexp_extract(url, '://[^/?#]*/([^/?#]*)', 1) seg, regexp_extract(html, '<html lang="([a-z]*)"', 1) lang, regexp_extract_all(html, 'href="/([^"/]*)"', 1) links from pages),
m as (select *, array_to_string(list_reverse(string_split(host, '.')), '.') module, string_split(host, '.')[1] label from h),
def as (select distinct module, seg name, page_id key from m where seg <> ''),
call as (select page_id, unnest(list_distinct(links)) name, module from m),
known as (select distinct module from def),
imp as (select distinct a.module, a.lang name, b.label from_module, b.seg from_name from m a join m b on b.page_id = a.page_id + 1 where a.lang <> '' and b.seg <> ''),
rimp as (select distinct imp.module, name, coalesce(k1.module, k2.module, from_module) to_, from_name from imp left join known k1 on from_module = k1.module left join known k2 on regexp_replace(imp.module, '[^.]*$', '') || from_module = k2.module),
dot as (select page_id, module, regexp_replace(module, '[.][^.]*$', '') || '.' || label target, seg name from m),
rdot as (select page_id, coalesce(k1.module, k2.module, target) to_, name from dot left join known k1 on target = k1.module left join known k2 on regexp_replace(dot.module, '[^.]*$', '') || target = k2.module),
way as (select page_id || '/' || name site, module to_, name, 0 how from call union all select c.page_id || '/' || c.name, to_, from_name, 1 from call c join rimp using (module, name) union all select page_id || '/.' || name, to_, name, 2 from rdot)"""


@query(f"with {_NAMES} select site, key, min(how)::int how from way join def on to_ = module and way.name = def.name group by all")
def c06_call_resolution(spark: SparkSession, sf: str) -> DataFrame:
    """What links of pages may mean. Hosts are modules, the first parts of paths are names, a link calls one, the next page is imported under the page's language, and a host's first label is an alias below its package."""
    p = table(spark, sf, "pages")
    m = p.select("page_id", F.regexp_extract("url", "://([^/?#]*)", 1).alias("host"), F.regexp_extract("url", "://[^/?#]*/([^/?#]*)", 1).alias("seg"), F.regexp_extract("html", '<html lang="([a-z]*)"', 1).alias("lang"), F.regexp_extract_all("html", F.lit('href="/([^"/]*)"'), F.lit(1)).alias("links"))
    m = stored(m.withColumns({"module": F.array_join(F.reverse(F.split("host", "[.]")), "."), "label": F.split("host", "[.]")[0]}), "modules")
    definitions = m.where("seg <> ''").select("module", F.col("seg").alias("name"), F.col("page_id").alias("key")).distinct()
    ident = lambda sep, name: F.concat(F.col("page_id").cast("string"), F.lit(sep), name)
    plain = m.select("page_id", "module", F.explode(F.array_distinct("links")).alias("name")).select(ident("/", F.col("name")).alias("site"), "module", F.lit(None).cast("string").alias("base"), "name")
    dotted = m.select(ident("/.", F.col("seg")).alias("site"), "module", F.concat(F.lit("top."), "label").alias("base"), F.col("seg").alias("name"))
    imported = m.where("seg <> ''").select((F.col("page_id") - 1).alias("page_id"), F.col("label").alias("from_module"), F.col("seg").alias("from_name"))
    imports = m.where("lang <> ''").select("page_id", "module", F.col("lang").alias("name")).join(imported, "page_id").select("module", "name", "from_module", "from_name").distinct()
    aliases = m.select("module", F.lit("top").alias("base"), F.regexp_replace("module", "[.][^.]*$", "").alias("to_module")).distinct()
    return resolution.resolved_calls(plain.unionByName(dotted), definitions, imports, aliases)


_SUFFIXES = ("", ".ts", ".tsx", ".js", ".jsx", ".mjs")


@query("""with f as (select p_partkey, 'src/' || lower(p_brand) || '/' || p_type || '/p' || p_size // 7 || case p_size % 7 when 0 then '' when 1 then '.ts' when 2 then '.tsx' when 3 then '.js' when 4 then '/index.ts' when 5 then '/index.jsx' else '.mjs' end path from part),
i as (select l_orderkey * 8 + l_linenumber id, 'src/' || lower(p_brand) || '/' || case l_returnflag when 'A' then 'PROMO' when 'R' then 'ECONOMY' else 'SMALL' end || '/p' || p_size // 7 base from lineitem join part on l_partkey = p_partkey where p_size <> 13 or l_tax > 0),
s(rank, suffix) as (values (0, ''), (1, '.ts'), (2, '.tsx'), (3, '.js'), (4, '.jsx'), (5, '.mjs'), (6, '/index.ts'), (7, '/index.tsx'), (8, '/index.js'), (9, '/index.jsx')),
u as (select distinct id, base from i)
select id, base, arg_min(base || suffix, rank) path, min(rank)::int rank from u, s where base || suffix in (select path from f) group by all""")
def c08_import_files(spark: SparkSession, sf: str) -> DataFrame:
    """Imports to the first of ten candidate paths that exists: the name itself, with suffixes, then as a folder's index."""
    part = table(spark, sf, "part").select("p_partkey", F.lower("p_brand").alias("brand"), "p_type", "p_size")
    folder = F.concat(F.lit("/p"), F.floor(F.col("p_size") / 7).cast("string"))
    ends = F.array(*map(F.lit, ("", ".ts", ".tsx", ".js", "/index.ts", "/index.jsx", ".mjs")))
    files = part.select(F.concat(F.lit("src/"), "brand", F.lit("/"), "p_type", folder, F.get(ends, F.col("p_size") % 7)).alias("path"))
    kind = F.when(F.col("l_returnflag") == "A", "PROMO").when(F.col("l_returnflag") == "R", "ECONOMY").otherwise("SMALL")
    items = table(spark, sf, "lineitem").join(part, F.col("l_partkey") == F.col("p_partkey")).where("p_size <> 13 or l_tax > 0")
    imports = items.select(F.struct((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("id"), F.concat(F.lit("src/"), "brand", F.lit("/"), kind, folder).alias("base")).alias("i")).distinct()
    base = F.col("i.base")
    candidates = [F.concat(base, F.lit(s)) for s in (*_SUFFIXES, *(f"/index{s}" for s in _SUFFIXES[1:5]))]
    return resolution.first_existing(imports, "i", candidates, files, "path").select("i.id", "i.base", "path", "rank")


@query("""with r as (select user_id, event_type, event_id, event_type = 'purchase' done, case when ts < timestamp '2024-01-11' then 1 when ts < timestamp '2024-01-21' then 2 else 3 end batch from events)
select user_id, arg_max(event_type, (batch, event_id)) event_type, case when arg_max(done, (batch, event_id)) then 'completed' else 'draft' end state, max(batch) filter (true) batch from r group by 1""")
def j05_snapshot_upsert(spark: SparkSession, sf: str) -> DataFrame:
    """Three batches of saved records upserted into a table of versioned snapshots: each record's last state, draft or completed."""
    e = table(spark, sf, "events")
    edge = lambda d: F.lit(d).cast("timestamp_ntz")
    batch = F.when(F.col("ts") < edge("2024-01-11"), 1).when(F.col("ts") < edge("2024-01-21"), 2).otherwise(3)
    rows = stored(e.select("user_id", "event_type", F.when(F.col("event_type") == "purchase", "completed").otherwise("draft").alias("state"), batch.alias("batch"), "event_id"), "saved")
    kept = Snapshots(spark, f"{shared_dir(spark)}/snapshots/{uuid.uuid4().hex}")
    for k in (1, 2, 3):
        kept.upsert(rows.where(F.col("batch") == k), ["user_id"], "event_id")
    return kept.read().drop("event_id")


@query(r"""with d as (select doc_id, lang, len(replace(replace(text, chr(13), ' '), chr(10), ' ')) + 1 n from documents where lang is not null)
select 'lang=' || lang folder, 'kept' status, sum(n)::bigint chars from d where lang <> 'es' group by 1 union all select distinct 'lang=' || lang, 'pruned', null::bigint from d where lang = 'es'""")
def a01_scan_tree(spark: SparkSession, sf: str) -> DataFrame:
    """The documents as a tree of text files, a folder for each language, read back by a scan that prunes one of them. For folders that all machines mount."""
    path = scratch(spark, "tree")
    docs = table(spark, sf, "documents").where("lang is not null").select("doc_id", "lang", F.translate("text", "\r\n", "  ").alias("value"))
    docs.repartition("lang", F.pmod(F.xxhash64("doc_id"), F.lit(8))).select("lang", "value").write.partitionBy("lang").text(path)
    tree = scan_tree(spark, path, [".txt"], prune=("lang=es",), max_bytes=1 << 40)
    folder = F.regexp_extract("path", "^([^/]*)", 1)
    return tree.where("status <> 'suffix'").groupBy(folder.alias("folder"), "status").agg(F.sum(F.char_length("text")).alias("chars"))


@query(r"""with c as (select page_id, regexp_replace(url, '"[^"]*"', ' ', 'g') u from pages), i as (select page_id, list_sort(list_distinct(list_filter(regexp_extract_all(u, '[A-Za-z_][A-Za-z0-9_]*'), lambda x: x not in ('http', 'https', 'www') and not regexp_matches(x, '^[0-9_]*[A-Z][A-Z0-9_]*$')))) ids from c)
select page_id, array_to_string(ids, ',') ids from i""")
def h12_identifiers(spark: SparkSession, sf: str) -> DataFrame:
    """Names in a text, without reserved words and words in capitals."""
    return table(spark, sf, "pages").select("page_id", F.array_join(fn.identifiers(F.col("url"), ["http", "https", "www"]), ",").alias("ids"))


@query(r"""select doc_id, replace(replace(substr(text, 1, 300) || '|' || coalesce(lang, ''), '|', '\|'), chr(10), ' ') cell from documents""")
def h16_markdown_cell(spark: SparkSession, sf: str) -> DataFrame:
    """Text made safe for a table cell."""
    return table(spark, sf, "documents").select("doc_id", fn.markdown_cell(F.concat(F.substring("text", 1, 300), F.lit("|"), F.coalesce("lang", F.lit("")))).alias("cell"))


@query("""with a as (select l_orderkey, list(l_partkey::varchar order by l_linenumber, l_partkey) a from lineitem group by 1)
select l_orderkey, array_to_string(case when len(a) <= 5 then a else list_concat(a[1:2], ['...'], a[-2:]) end, ' -> ') path from a""")
def h17_elided_path(spark: SparkSession, sf: str) -> DataFrame:
    """Long ways with their middle left out."""
    a = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))).alias("a"))
    return a.select("l_orderkey", fn.elided(F.col("a.l_partkey").cast("array<string>")).alias("path"))


@query("""with a as (select l_orderkey, list_sort(list(distinct l_suppkey::varchar)) a from lineitem group by 1)
select l_orderkey, array_to_string(a[1:3], '; ') || case when len(a) > 3 then '; ...(+' || len(a) - 3 || ')' else '' end statuses from a""")
def h18_compact_list(spark: SparkSession, sf: str) -> DataFrame:
    """The first of a list and how many more there are."""
    a = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_set(F.col("l_suppkey").cast("string"))).alias("a"))
    return a.select("l_orderkey", fn.compact(F.col("a"), 3).alias("statuses"))


@query(r"""with p as (select page_id, case when page_id % 3 = 0 then '/' else '' end || regexp_extract(url, '://([^?#]*)', 1) || '/./../' || page_id || '//.x/../../../' || coalesce(regexp_extract(html, 'lang="([a-z]*)"', 1), '') || '.page.html' raw from pages),
n as (select page_id, raw, list_reduce(list_prepend('', string_split(raw, '/')), lambda a, x: case when x in ('', '.') then a when x <> '..' then case when a = '' then x else a || '/' || x end when a = '' or a = '..' or a like '%/..' then case when raw like '/%' then a when a = '' then '..' else a || '/..' end else regexp_replace(a, '/?[^/]*$', '') end) k from p),
m as (select page_id, case when raw like '/%' then '/' || k when k = '' then '.' else k end path from n)
select page_id, path, case when regexp_replace(path, '/?[^/]*$', '') <> '' then regexp_replace(path, '/?[^/]*$', '') when path like '/%' then '/' else '.' end parent, regexp_extract(path, '([^/]*)$', 1) "name", '.html' suffix from m""")
def h09_paths(spark: SparkSession, sf: str) -> DataFrame:
    """Paths with dots and climbs made normal, and their parts."""
    p = table(spark, sf, "pages")
    raw = F.concat(F.when(F.col("page_id") % 3 == 0, "/").otherwise(""), F.regexp_extract("url", "://([^?#]*)", 1), F.lit("/./../"), F.col("page_id").cast("string"), F.lit("//.x/../../../"), F.regexp_extract("html", 'lang="([a-z]*)"', 1), F.lit(".page.html"))
    x = p.select("page_id", fn.normal_path(raw).alias("path"))
    return x.withColumn("parts", fn.path_parts(F.col("path"))).select("page_id", "path", "parts.parent", "parts.name", "parts.suffix")
