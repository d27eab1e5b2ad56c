"""All registered queries of the library, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.operators import graph, metrics, ordering, policy, scan, verification, windows
from corpusloom.plans import audits, evidence, interchange, probing, reports, review, rules, structure  # noqa: F401  (register their queries)
from corpusloom.plans.registry import ORACLES, QUERIES, query  # noqa: F401
from corpusloom.sources import records
from corpusloom.sources.readers import table
from corpusloom.sources.tables import scratch, stored

FLAGSHIP = "h03_finding_ids"


#: Rules for prose: secrets, personal data, licences. ASCII classes only, so that all regex dialects agree.
RULES = [
    scan.Rule("credential_access", "token_literal", 'token = "[0-9a-f]{40}"', "high"),
    scan.Rule("credential_access", "access_key", "akia[0-9a-z]{16}", "high"),
    scan.Rule("personal_data", "email", "[a-z0-9._-]+@[a-z0-9-]+[.][a-z]+", "medium"),
    scan.Rule("personal_data", "card_number", "4[0-9]{15}", "high"),
    scan.Rule("network_access", "dotted_quad", "[0-9]{1,3}[.][0-9]{1,3}[.][0-9]{1,3}[.][0-9]{1,3}", "medium"),
    scan.Rule("license_text", "license_word", "license|rights reserved", "medium"),
]
_VALUES = ", ".join(f"('{r.category}', '{r.detector}', '{r.pattern}', '{r.confidence}')" for r in RULES)
_HITS = f"""
with r(category, detector, pattern, confidence) as (values {_VALUES}),
p as (select doc_id, regexp_split_to_array(text, '\\r\\n|[\\n\\r\\x0b\\x0c\\x1c\\x1d\\x1e\\x{{85}}\\x{{2028}}\\x{{2029}}]') a from documents),
l as (select doc_id, unnest(a) line, generate_subscripts(a, 1)::int line_no from p),
k as (select * from l where length(line) <= 2000 and not (regexp_replace(line, '^\\s+', '') like '#%' or regexp_replace(line, '^\\s+', '') like '//%' or regexp_replace(line, '^\\s+', '') like '/*%' or regexp_replace(line, '^\\s+', '') like '*%' or regexp_replace(line, '^\\s+', '') like '\"\"\"%' or regexp_replace(line, '^\\s+', '') like '''''''%')),
h as (select doc_id, line_no, line, category, detector, confidence from k join r on regexp_matches(line, '(?i)' || pattern))"""
_FOUND = _HITS + """,
g as (select doc_id, category, list_sort(list(distinct line_no)) ls, list_sort(list_transform(list_sort(list(distinct {'n': line_no, 'h': sha256(regexp_replace(regexp_replace(line, '^\\s+', ''), '\\s+$', ''))}))[1:50], lambda x: x.h)) hs, list_sort(list(distinct detector)) d, max(confidence = 'high') high from h group by all),
f as (select doc_id, category, '<module>' symbol, ls[1] line_start, ls[-1] line_end, len(ls)::int match_count, array_to_string(ls[1:50], ',') evidence_lines, array_to_string(d, ';') detectors, case when high then 'high' else 'medium' end confidence,
 'F-' || upper(sha256(concat_ws(chr(0), doc_id::varchar, category, '<module>', ls[1]::varchar, array_to_string(d, ';')))[1:16]) finding_id,
 'FP-' || upper(sha256(concat_ws(chr(0), doc_id::varchar, category, '<module>', array_to_string(d, ';'), array_to_string(hs, ';')))[1:24]) fingerprint from g)
"""


def _hits(spark: SparkSession, sf: str) -> DataFrame:
    return scan.matches(table(spark, sf, "documents").select("doc_id", "text"), "doc_id", RULES)


def _found(spark: SparkSession, sf: str) -> DataFrame:
    return scan.findings(_hits(spark, sf), "doc_id")


@query(_HITS + "select doc_id, line_no, category, detector, confidence from h")
def c01_rule_scan(spark: SparkSession, sf: str) -> DataFrame:
    return _hits(spark, sf).drop("line")


@query(_FOUND + "select * from f")
def h03_finding_ids(spark: SparkSession, sf: str) -> DataFrame:
    return _found(spark, sf)


#: A line that opens with a capital letter declares its first word, in prose; a dash, what follows it.
_DECLARED = ["^([A-Z][a-z]+) ", "^- ([a-z]+)"]


@query(_HITS + """,
dec as (select doc_id, line_no, coalesce(nullif(regexp_extract(line, '^([A-Z][a-z]+) ', 1), ''), nullif(regexp_extract(line, '^- ([a-z]+)', 1), '')) nm from l),
up as (select h.doc_id, h.line_no, arg_max(nm, dec.line_no) s from (select distinct doc_id, line_no from h) h join dec on dec.doc_id = h.doc_id and dec.line_no between h.line_no - 30 and h.line_no where nm is not null group by all),
down as (select h.doc_id, h.line_no, arg_min(nm, dec.line_no) s from (select distinct doc_id, line_no, line from h) h join dec on dec.doc_id = h.doc_id and dec.line_no between h.line_no + 1 and h.line_no + 8 where nm is not null and regexp_replace(line, '^\\s+', '') like '@%' group by all),
x as (select h.*, coalesce(down.s, up.s, '<module>') symbol from h left join up using (doc_id, line_no) left join down using (doc_id, line_no)),
g as (select doc_id, category, symbol, list_sort(list(distinct line_no)) ls, list_sort(list_transform(list_sort(list(distinct {'n': line_no, 'h': sha256(regexp_replace(regexp_replace(line, '^\\s+', ''), '\\s+$', ''))}))[1:50], lambda x: x.h)) hs, list_sort(list(distinct detector)) d, max(confidence = 'high') high from x group by all)
select doc_id, category, symbol, ls[1] line_start, ls[-1] line_end, len(ls)::int match_count, array_to_string(d, ';') detectors, case when high then 'high' else 'medium' end confidence,
 'F-' || upper(sha256(concat_ws(chr(0), doc_id::varchar, category, symbol, ls[1]::varchar, array_to_string(d, ';')))[1:16]) finding_id,
 'FP-' || upper(sha256(concat_ws(chr(0), doc_id::varchar, category, symbol, array_to_string(d, ';'), array_to_string(hs, ';')))[1:24]) fingerprint from g""")
def d01_symbol_findings(spark: SparkSession, sf: str) -> DataFrame:
    """Findings by document, category and the symbol they stand in, with their identities."""
    docs = table(spark, sf, "documents").select("doc_id", "text")
    hits = scan.with_symbols(stored(_hits(spark, sf), "hits"), docs, "doc_id", _DECLARED)
    return scan.findings(hits, "doc_id", "symbol").drop("evidence_lines")


_REVISED = """d2 as (select doc_id, lang, case lang when 'fr' then replace(text, '@', ' at ') when 'es' then substr(text, 1, 200) else text end text from documents where doc_id in (select doc_id from labels) or lang <> 'de'),
p2 as (select doc_id, regexp_split_to_array(text, '\\r\\n|[\\n\\r\\x0b\\x0c\\x1c\\x1d\\x1e\\x{85}\\x{2028}\\x{2029}]') a from d2),
l2 as (select doc_id, unnest(case when a[-1] = '' then a[:-2] else a end) line2, generate_subscripts(case when a[-1] = '' then a[:-2] else a end, 1)::int line_no from p2)"""


@query(_FOUND + ", " + _REVISED + """,
ev as (select distinct doc_id, category, line_no, line from h), nth as (select doc_id, category, line_no, line, row_number() over (partition by doc_id, category order by line_no) r from ev),
w as (select f.finding_id, nth.line_no, case when nth.doc_id not in (select doc_id from d2) then 'file not found' when l2.line2 is null then 'line missing' when sha256(regexp_replace(regexp_replace(line, '^\\s+', ''), '\\s+$', '')) <> sha256(regexp_replace(regexp_replace(line2, '^\\s+', ''), '\\s+$', '')) then 'hash differs' end error
 from nth join f using (doc_id, category) left join l2 on l2.doc_id = nth.doc_id and l2.line_no = nth.line_no where r <= 50),
m as (select f.finding_id, null::int line_no, case when q.doc_id is null then 'outside manifest' when f.category = 'license_text' and q.quality = 0 then 'other version' end error from f left join labels q using (doc_id))
select finding_id, error, line_no from w where error is not null union all select finding_id, error, line_no from m where error is not null""")
def k06_finding_verification(spark: SparkSession, sf: str) -> DataFrame:
    """Stored findings against a manifest (the labels) and a revised read of the documents: what no longer holds, finding by finding."""
    hits = stored(_hits(spark, sf), "hits")
    found = scan.findings(hits, "doc_id").join(scan.evidence(hits, "doc_id", ["category"]).withColumnRenamed("evidence_lines", "lines"), ["doc_id", "category"])
    labels = table(spark, sf, "labels").select("doc_id", "quality")
    version = F.when(F.col("category") == "license_text", F.lit(1)).otherwise(F.coalesce("quality", F.lit(1)))
    saved = found.join(labels, "doc_id", "left").select("finding_id", F.col("doc_id").alias("repo"), version.alias("version"), F.col("doc_id").alias("file"), F.col("lines").alias("evidence_lines"), "evidence_hashes")
    manifest = labels.select(F.col("doc_id").alias("repo"), F.col("quality").alias("version"))
    docs = table(spark, sf, "documents").join(labels.select("doc_id", F.lit(True).alias("known")), "doc_id", "left").where("known or lang <> 'de'")
    text = F.when(F.col("lang") == "fr", F.replace("text", F.lit("@"), F.lit(" at "))).when(F.col("lang") == "es", F.substring("text", 1, 200)).otherwise(F.col("text"))
    return verification.verified_findings(stored(saved, "findings"), manifest, docs.select(F.col("doc_id").alias("repo"), F.col("doc_id").alias("file"), text.alias("text")))


@query(_FOUND + "select category, confidence, count(*) n, sum(match_count)::bigint lines from f group by all")
def d03_category_counts(spark: SparkSession, sf: str) -> DataFrame:
    return _found(spark, sf).groupBy("category", "confidence").agg(F.count("*").alias("n"), F.sum("match_count").alias("lines"))


_POLICY = _FOUND + """,
s as (select fingerprint, case when category = 'license_text' then null else date '2024-06-01' end expires from f where category in ('license_text', 'network_access')),
e as (select f.*, f.fingerprint not in (select fingerprint from f where match_count = 1) is_new, f.fingerprint in (select fingerprint from s where expires is null or expires >= date '2024-07-01') suppressed from f)
"""


@query(_POLICY + "select category, count(*) n, sum(is_new::int)::bigint new_ones, sum(suppressed::int)::bigint suppressed, sum((is_new and not suppressed and confidence = 'high')::int)::bigint blocking from e group by all")
def j01_policy(spark: SparkSession, sf: str) -> DataFrame:
    """One-line findings are the baseline, licence findings suppressed for good, network ones until June."""
    f = stored(_found(spark, sf), "found")  # read three times
    s = f.where(F.col("category").isin("license_text", "network_access")).select("fingerprint", F.when(F.col("category") != "license_text", F.to_date(F.lit("2024-06-01"))).alias("expires"))
    e = policy.evaluate(f, f.where("match_count = 1"), s, F.col("confidence") == "high", F.to_date(F.lit("2024-07-01")))
    n = lambda c: F.sum(F.col(c).cast("int"))
    return e.groupBy("category").agg(F.count("*").alias("n"), n("is_new").alias("new_ones"), n("suppressed").alias("suppressed"), n("blocking").alias("blocking"))


_RECORDS = _POLICY + """,
m as (select e.*, confidence = 'high' and category in ('credential_access', 'personal_data') policy_match from e),
q as (select *, is_new and not suppressed and policy_match blocking from m)
"""


def _records(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Findings with their policy record, and the suppressions; dates and baseline as in j01_policy."""
    f = stored(_found(spark, sf), "found")
    s = f.where(F.col("category").isin("license_text", "network_access")).select(F.concat(F.lit("S-"), "finding_id").alias("suppression_id"), "fingerprint", F.when(F.col("category") != "license_text", F.to_date(F.lit("2024-06-01"))).alias("expires"))
    meets = (F.col("confidence") == "high") & F.col("category").isin("credential_access", "personal_data")
    return policy.records(f, f.where("match_count = 1"), s, meets, F.to_date(F.lit("2024-07-01"))), s


@query(_RECORDS + ", i as (select s.fingerprint, min('S-' || f.finding_id) suppression_id from s join f using (fingerprint) where s.expires is null or s.expires >= date '2024-07-01' group by 1) select finding_id, category, case when is_new then 'new' else 'existing' end baseline_status, suppression_id, policy_match, blocking from q left join i using (fingerprint)")
def j01_policy_records(spark: SparkSession, sf: str) -> DataFrame:
    """Each finding's place in the baseline, its suppression, whether the policy names it, and whether it blocks."""
    return _records(spark, sf)[0].select("finding_id", "category", "baseline_status", "suppression_id", "policy_match", "blocking")


@query(_RECORDS + "select category, count(*) n, sum(is_new::int)::bigint new_ones, sum((not is_new)::int)::bigint existing, sum(suppressed::int)::bigint suppressed, sum(policy_match::int)::bigint policy_matches, sum(blocking::int)::bigint blocking from q group by rollup (category)")
def d37_policy_rollup(spark: SparkSession, sf: str) -> DataFrame:
    """The policy's counts by category and over all."""
    n = lambda c, name: F.count_if(c).alias(name)
    new = F.col("baseline_status") == "new"
    return _records(spark, sf)[0].rollup("category").agg(F.count("*").alias("n"), n(new, "new_ones"), n(~new, "existing"), n(F.col("suppression_id").isNotNull(), "suppressed"), n(F.col("policy_match"), "policy_matches"), n(F.col("blocking"), "blocking"))


@query(_RECORDS + """, c as (select doc_id, count(*) n, count(*) filter (blocking) blocking, min(case when is_new then 'new' else 'existing' end) status from q group by 1)
select l.doc_id, quality, coalesce(n, 0) findings, coalesce(blocking, 0) blocking, coalesce(status, 'no finding') status from labels l left join c on c.doc_id = l.doc_id""")
def c31_case_policy(spark: SparkSession, sf: str) -> DataFrame:
    """Cases (labels) with the policy's records of their findings; those without a finding say so."""
    r = _records(spark, sf)[0].groupBy("doc_id").agg(F.count("*").alias("findings"), F.count_if("blocking").alias("blocking"), F.min("baseline_status").alias("status"))
    x = table(spark, sf, "labels").join(r, "doc_id", "left")
    return x.select("doc_id", "quality", *(F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("findings", "blocking")), F.coalesce("status", F.lit("no finding")).alias("status"))


_OLDER = _FOUND.replace("from documents)", "from (select doc_id, substr(text, 1, 1500) text from documents))")


@query(_FOUND + f""", base as (select distinct fingerprint from ({_OLDER} select fingerprint from f)),
sup as (select f.fingerprint, 'S-' || doc_id || '-' || category id, case when toxic = 1 then date '2024-06-01' end expires from f join labels using (doc_id) where quality = 0 or category = 'license_text'),
live as (select fingerprint, min(id) suppression_id from sup where expires is null or expires >= date '2024-07-01' group by 1)
select finding_id, case when b.fingerprint is null then 'new' else 'existing' end baseline_status, suppression_id, confidence = 'high' policy_match, b.fingerprint is null and suppression_id is null and confidence = 'high' blocking
from f left join base b on b.fingerprint = f.fingerprint left join live l on l.fingerprint = f.fingerprint""")
def j01_stored_policy(spark: SparkSession, sf: str) -> DataFrame:
    """The policy against a baseline file that a scan of an older, shorter version of the documents wrote, and suppressions read from the labels."""
    found = stored(_found(spark, sf), "found")
    older = table(spark, sf, "documents").select("doc_id", F.substring("text", 1, 1500).alias("text"))
    path = scratch(spark, "baseline")
    records.write_baseline(scan.findings(scan.matches(older, "doc_id", RULES), "doc_id").select("fingerprint"), path, "scan-baseline")
    baseline = records.read_baseline(spark, path, "scan-baseline")
    labels = table(spark, sf, "labels").select("doc_id", "quality", "toxic")
    quiet = found.join(labels, "doc_id").where("quality = 0 or category = 'license_text'")
    quiet = quiet.select("fingerprint", F.concat(F.lit("S-"), F.col("doc_id").cast("string"), F.lit("-"), "category").alias("suppression_id"), F.when(F.col("toxic") == 1, F.to_date(F.lit("2024-06-01"))).alias("expires"))
    got = policy.records(found, baseline, quiet, F.col("confidence") == "high", F.to_date(F.lit("2024-07-01")))
    return got.select("finding_id", "baseline_status", "suppression_id", "policy_match", "blocking")


@query(_POLICY + "select 'S-' || finding_id suppression_id, fingerprint, '2024-06-01' expires from f where category = 'network_access'")
def j01_expired_suppressions(spark: SparkSession, sf: str) -> DataFrame:
    """Suppressions that have run out."""
    return policy.expired(_records(spark, sf)[1], F.to_date(F.lit("2024-07-01"))).withColumn("expires", F.col("expires").cast("string"))


@query("select event_id, user_id, last(case when event_type = 'signup' then event_id end ignore nulls) over (partition by user_id order by ts, event_id rows between 30 preceding and current row) signup_id from events")
def c02_nearest_before(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    return windows.last_before(e, "user_id", ["ts", "event_id"], F.when(F.col("event_type") == "signup", F.col("event_id")), 30, "signup_id").select("event_id", "user_id", "signup_id")


@query("select event_id, user_id, first(case when event_type = 'purchase' then event_id end ignore nulls) over (partition by user_id order by ts, event_id rows between 1 following and 8 following) purchase_id from events")
def c03_next_after(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    return windows.first_after(e, "user_id", ["ts", "event_id"], F.when(F.col("event_type") == "purchase", F.col("event_id")), 8, "purchase_id").select("event_id", "user_id", "purchase_id")


@query("select a.l_orderkey, a.l_linenumber, count(*) n_overlaps from lineitem a join lineitem b on a.l_orderkey = b.l_orderkey and a.l_linenumber <> b.l_linenumber and a.l_shipdate <= b.l_shipdate + interval 7 day and b.l_shipdate <= a.l_shipdate + interval 7 day group by all")
def c13_interval_overlap(spark: SparkSession, sf: str) -> DataFrame:
    """Weeks from shipping that overlap within an order: equal keys first, the interval as what remains."""
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate")
    b = li.select("l_orderkey", F.col("l_linenumber").alias("other"), F.col("l_shipdate").alias("shipped"))
    week = F.expr("interval 7 days")
    x = li.join(b, "l_orderkey").where((F.col("l_linenumber") != F.col("other")) & (F.col("l_shipdate") <= F.col("shipped") + week) & (F.col("shipped") <= F.col("l_shipdate") + week))
    return x.groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("n_overlaps"))


_EDGES = """g as (select 'r' || n_regionkey src, 'n' || n_nationkey dst from nation union all select 'n' || c_nationkey, 'c' || c_custkey from customer union all select 'c' || o_custkey, 'o' || o_orderkey from orders)"""


@query(f"with recursive {_EDGES}, r as (select distinct src seed, src node, 0 depth from g union select seed, dst, depth + 1 from r join g on r.node = g.src where depth < 6) select seed, node, min(depth)::int depth from r group by all")
def c10_bounded_reach(spark: SparkSession, sf: str) -> DataFrame:
    """What each region, nation and customer leads to, six steps at most."""
    edge = lambda t, a, x, b, y: table(spark, sf, t).select(F.concat(F.lit(a), x).alias("src"), F.concat(F.lit(b), y).alias("dst"))
    e = edge("nation", "r", "n_regionkey", "n", "n_nationkey").unionByName(edge("customer", "n", "c_nationkey", "c", "c_custkey")).unionByName(edge("orders", "c", "o_custkey", "o", "o_orderkey"))
    return graph.bounded_reach(e, e.select(F.col("src").alias("node")), 6)


_LANGUAGES = {"email": ("en", "de"), "card_number": ("fr",), "license_word": ("en", "es")}


@query(_HITS + " select doc_id, line_no, detector from h join documents using (doc_id) where case detector when 'email' then lang in ('en', 'de') when 'card_number' then lang = 'fr' when 'license_word' then lang in ('en', 'es') else true end")
def b05_applicability(spark: SparkSession, sf: str) -> DataFrame:
    """Rules that are for some languages alone."""
    rules = [scan.Rule(r.category, r.detector, r.pattern, r.confidence, _LANGUAGES.get(r.detector, ())) for r in RULES]
    return scan.matches(table(spark, sf, "documents").select("doc_id", "text", "lang"), "doc_id", rules, "lang").select("doc_id", "line_no", "detector")


@query("select l_returnflag, quantile_cont(l_extendedprice, 0.9) p90, quantile_disc(l_extendedprice, 0.95) p95_rank from lineitem group by 1")
def d26_percentiles(spark: SparkSession, sf: str) -> DataFrame:
    return ordering.percentiles(table(spark, sf, "lineitem").select("l_returnflag", "l_extendedprice"), ["l_returnflag"], "l_extendedprice", {"p90": ("linear", 0.9), "p95_rank": ("rank", 0.95)})


@query("select c_mktsegment, n_name, grouping_id(c_mktsegment, n_name)::bigint level, count(*) n, round(100.0 * sum((c_acctbal < 0)::int) / count(*), 6) negative_percent from customer join nation on c_nationkey = n_nationkey group by grouping sets ((), (c_mktsegment), (n_name))")
def d09_feature_rates(spark: SparkSession, sf: str) -> DataFrame:
    return spark.sql("select c_mktsegment, n_name, grouping_id(c_mktsegment, n_name) level, count(*) n, round(100.0D * sum(int(c_acctbal < 0)) / count(*), 6) negative_percent from {c} join {n} on c_nationkey = n_nationkey group by grouping sets ((), (c_mktsegment), (n_name))", c=table(spark, sf, "customer"), n=table(spark, sf, "nation"))


@query("select n_name, count(*) filter (c_mktsegment = 'BUILDING') building, count(*) filter (c_mktsegment = 'MACHINERY') machinery, count(c_custkey) total from nation left join customer on c_nationkey = n_nationkey group by 1")
def d04_pivot(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "customer")
    by = c.groupBy("c_nationkey").agg(F.count_if(F.col("c_mktsegment") == "BUILDING").alias("building"), F.count_if(F.col("c_mktsegment") == "MACHINERY").alias("machinery"), F.count("*").alias("total"))
    return table(spark, sf, "nation").join(by, F.col("n_nationkey") == F.col("c_nationkey"), "left").select("n_name", *(F.coalesce(x, F.lit(0)).alias(x) for x in ("building", "machinery", "total")))


@query("with s as (select o_orderkey, o_orderpriority, o_orderstatus, row_number() over w draw, count(*) over (partition by o_orderpriority, o_orderstatus) population from orders window w as (partition by o_orderpriority, o_orderstatus order by sha256('corpusloom' || chr(0) || o_orderkey::varchar), o_orderkey)) select o_orderkey, o_orderpriority, o_orderstatus, draw::int draw, population, population / least(population, 20) weight from s where draw <= 20")
def e03_stratified_sample(spark: SparkSession, sf: str) -> DataFrame:
    return windows.stratified(table(spark, sf, "orders"), ["o_orderpriority", "o_orderstatus"], "o_orderkey", 20, "corpusloom").select("o_orderkey", "o_orderpriority", "o_orderstatus", "draw", "population", "weight")


@query("""with s as (select o_orderpriority, o_orderstatus, count(*) n from orders group by all), x as (select *, (150 - count(*) over ()) * (n - 1) / sum(n - 1) over () exact, count(*) over () k from s),
y as (select *, row_number() over (order by exact - floor(exact) desc, o_orderpriority, o_orderstatus) r, 150 - k - sum(floor(exact)) over () left_over from x)
select o_orderpriority, o_orderstatus, n, (1 + floor(exact) + (r <= left_over)::int)::bigint quota from y""")
def e05_quota(spark: SparkSession, sf: str) -> DataFrame:
    s = table(spark, sf, "orders").groupBy("o_orderpriority", "o_orderstatus").agg(F.count("*").alias("n"))
    return windows.largest_remainder(s, "n", 150, ["o_orderpriority", "o_orderstatus"])


_RATERS = """v as (select doc_id, unnest([lang = 'en', n_chars > 1500, contains(text, '.'), contains(text, '!'), doc_id is not null]) label, unnest(['a', 'b', 'c', 'd', 'e']) rater from documents)"""


def _ratings(spark: SparkSession, sf: str) -> DataFrame:
    """Five raters: predicates over documents."""
    d = table(spark, sf, "documents")
    votes = [F.struct(F.lit(r).alias("rater"), p.alias("label")) for r, p in zip("abcde", (F.col("lang") == "en", F.col("n_chars") > 1500, F.contains("text", F.lit(".")), F.contains("text", F.lit("!")), F.col("doc_id").isNotNull()), strict=True)]
    return d.select("doc_id", F.explode(F.array(*votes)).alias("v")).select("doc_id", "v.*")


@query(f"""with {_RATERS}, n as (select doc_id, label, count(*) n from v group by all), o as (select avg(p) observed from (select sum(n * (n - 1)) / (sum(n) * (sum(n) - 1)) p from n group by doc_id)), e as (select sum(s * s) / (sum(s) * sum(s)) expected from (select sum(n) s from n group by label))
select round(observed, 9) observed, round(expected, 9) expected, round((observed - expected) / (1 - expected), 9) kappa from o, e""")
def d19_fleiss(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.fleiss(_ratings(spark, sf), "doc_id", "label").select(*(F.round(c, 9).alias(c) for c in ("observed", "expected", "kappa")))


@query("""with n as (select (quality = 1) a, (toxic = 0) b, count(*) n from labels group by all), t as (select sum(n) t, sum(case when a = b then n else 0 end) s from n), x as (select a l, sum(n) x from n group by a), y as (select b l, sum(n) y from n group by b), e as (select sum(x * y) both_ from x join y using (l))
select round(s / t, 9) observed, round(both_ / (t * t), 9) expected, round((s / t - both_ / (t * t)) / (1 - both_ / (t * t)), 9) kappa from t, e""")
def d20_cohen(spark: SparkSession, sf: str) -> DataFrame:
    x = table(spark, sf, "labels").select((F.col("quality") == 1).alias("a"), (F.col("toxic") == 0).alias("b"))
    return metrics.cohen(x, "a", "b").select(*(F.round(c, 9).alias(c) for c in ("observed", "expected", "kappa")))


@query(f"with {_RATERS}, n as (select doc_id, label, count(*) n from v group by all), m as (select doc_id, max(n) votes from n group by 1) select doc_id, min(label) winner, votes, count(*) > 1 tied from n join m using (doc_id) where n = votes group by doc_id, votes")
def d23_plurality(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.plurality(_ratings(spark, sf), "doc_id", "label")


_GOLD = "x as (select lang, toxic = 1 gold, n_chars < 1000 pred, quality = 0 other, count(*) over (partition by lang, source) / 7.0 w from labels join documents using (doc_id))"


def _gold(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").select("doc_id", "lang", "source", "n_chars")
    x = table(spark, sf, "labels").join(d, "doc_id")
    # Strata are counted apart, so that none is held by one task.
    sizes = x.groupBy(F.col("lang").alias("_lang"), F.col("source").alias("_source")).agg(F.count("*").alias("_n"))
    x = x.join(sizes, F.col("lang").eqNullSafe(F.col("_lang")) & F.col("source").eqNullSafe(F.col("_source")))
    return x.select("lang", (F.col("toxic") == 1).alias("gold"), (F.col("n_chars") < 1000).alias("pred"), (F.col("quality") == 0).alias("other"), (F.col("_n") / 7.0).alias("w"))


@query(f"""with {_GOLD}, c as (select lang, round(sum(case when gold and pred then w else 0 end), 6) tp, round(sum(case when not gold and pred then w else 0 end), 6) fp, round(sum(case when gold and not pred then w else 0 end), 6) fn, round(sum(case when not gold and not pred then w else 0 end), 6) tn from x group by 1)
select *, round(tp / nullif(tp + fp, 0), 6) "precision", round(tp / nullif(tp + fn, 0), 6) recall, round(2 * tp / nullif(2 * tp + fp + fn, 0), 6) f1 from c""")
def d13_weighted_confusion(spark: SparkSession, sf: str) -> DataFrame:
    c = metrics.confusion(_gold(spark, sf), ["lang"], F.col("gold"), F.col("pred"), F.col("w").cast("double"))
    return c.select("lang", *(F.round(x, 6).alias(x) for x in ("tp", "fp", "fn", "tn", "precision", "recall", "f1")))


@query(f"""with {_GOLD}, c as (select lang, count(*) filter (gold and pred) tp, count(*) filter (not gold and pred) fp, count(*) filter (gold and not pred) fn, count(*) filter (not gold and not pred) tn from x group by 1)
select *, round(tp / nullif(tp + fp, 0), 6) "precision", round(tp / nullif(tp + fn, 0), 6) recall, round(2 * tp / nullif(2 * tp + fp + fn, 0), 6) f1 from c""")
def d12_confusion(spark: SparkSession, sf: str) -> DataFrame:
    c = metrics.confusion(_gold(spark, sf), ["lang"], F.col("gold"), F.col("pred"))
    return c.select("lang", *(F.col(x).cast("long").alias(x) for x in ("tp", "fp", "fn", "tn")), *(F.round(x, 6).alias(x) for x in ("precision", "recall", "f1")))


@query(f"""with {_GOLD}, c as (select lang, count(*) filter (pred = gold and other <> gold) only_first, count(*) filter (pred <> gold and other = gold) only_second, count(*) n from x group by 1),
t as (select lang, only_first + only_second m, unnest(range(0, least(only_first, only_second) + 1)) i from c), l as (select lang, m, sum(case when i = 0 then 0 else ln((m - i + 1) / i) end) over (partition by lang order by i) lg from t),
p as (select lang, least(1, 2 * sum(exp(lg - m * ln(2)))) p from l group by 1) select c.*, round(p, 6) p from c join p on c.lang is not distinct from p.lang""")
def d35_mcnemar(spark: SparkSession, sf: str) -> DataFrame:
    one, two = F.col("pred") == F.col("gold"), F.col("other") == F.col("gold")
    c = _gold(spark, sf).groupBy("lang").agg(F.count_if(one & ~two).alias("only_first"), F.count_if(~one & two).alias("only_second"), F.count("*").alias("n"))
    return c.withColumn("p", F.round(metrics.mcnemar_p(F.col("only_first"), F.col("only_second")), 6))


@query("select o_orderkey, o_orderpriority, row_number() over (order by o_orderpriority, o_totalprice desc, o_orderkey)::int rank from orders qualify rank <= 500")
def f03_topk(spark: SparkSession, sf: str) -> DataFrame:
    from pyspark.sql import Window

    top = table(spark, sf, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice").orderBy("o_orderpriority", F.desc("o_totalprice"), "o_orderkey").limit(500)
    return top.withColumn("rank", F.row_number().over(Window.orderBy("o_orderpriority", F.desc("o_totalprice"), "o_orderkey"))).drop("o_totalprice")


@query("""with s as (select user_id, list_sort(list(distinct event_type) filter (ts < timestamp '2024-01-16')) a, list_sort(list(distinct event_type) filter (ts >= timestamp '2024-01-16')) b from events group by 1)
select user_id, array_to_string(list_filter(coalesce(b, []), lambda x: not list_contains(coalesce(a, []), x)), ',') added, array_to_string(list_filter(coalesce(a, []), lambda x: not list_contains(coalesce(b, []), x)), ',') removed from s""")
def g06_array_delta(spark: SparkSession, sf: str) -> DataFrame:
    cut = F.col("ts") < F.lit("2024-01-16").cast("timestamp_ntz")
    s = table(spark, sf, "events").groupBy("user_id").agg(F.array_sort(F.collect_set(F.when(cut, F.col("event_type")))).alias("a"), F.array_sort(F.collect_set(F.when(~cut, F.col("event_type")))).alias("b"))
    return s.select("user_id", F.array_join(F.array_except("b", "a"), ",").alias("added"), F.array_join(F.array_except("a", "b"), ",").alias("removed"))


@query("select c_custkey from customer except select o_custkey from orders where o_orderpriority = '1-URGENT'")
def g05_set_difference(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "customer").select("c_custkey").subtract(table(spark, sf, "orders").where("o_orderpriority = '1-URGENT'").select("o_custkey"))


@query("""select 'duplicate_order' as "constraint", count(*) violations from (select o_orderkey from orders group by 1 having count(*) > 1) union all select 'dangling_line', count(*) from lineitem where l_orderkey not in (select o_orderkey from orders) union all select 'bad_length', count(*) from documents where n_chars <> length(text)""")
def k03_integrity(spark: SparkSession, sf: str) -> DataFrame:
    o, li, d = (table(spark, sf, t) for t in ("orders", "lineitem", "documents"))
    found = {"duplicate_order": o.groupBy("o_orderkey").count().where("count > 1"), "dangling_line": li.join(o, li["l_orderkey"] == o["o_orderkey"], "left_anti"), "bad_length": d.where(F.col("n_chars") != F.length("text"))}
    out = None
    for name, rows in found.items():
        one = rows.agg(F.count("*").alias("violations")).select(F.lit(name).alias("constraint"), "violations")
        out = one if out is None else out.unionByName(one)
    return out


@query("""select user_id, count(*) n, round(sum(coalesce((props->>'k')::double, 0)), 6) total, max(props) sample from events group by 1""")
def h28_json_access(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    return e.groupBy("user_id").agg(F.count("*").alias("n"), F.round(F.sum(F.coalesce(F.get_json_object("props", "$.k").cast("double"), F.lit(0.0))), 6).alias("total"), F.max("props").alias("sample"))


@query("""with c as (select *, row_number() over (partition by conv_id order by turn) r from conversations) select a.conv_id, a.turn, string_agg(b.role || ':' || length(b.text), '|' order by b.turn) context from c a join c b on a.conv_id = b.conv_id and b.r between a.r - 1 and a.r + 1 where a.role = 'user' group by 1, 2""")
def b25_context_window(spark: SparkSession, sf: str) -> DataFrame:
    """Each user turn with the turn before and after it, by a window over the conversation rather than a join."""
    from pyspark.sql import Window

    c = table(spark, sf, "conversations").withColumn("x", F.concat("role", F.lit(":"), F.length("text").cast("string")))
    w = Window.partitionBy("conv_id").orderBy("turn")
    return c.withColumn("context", F.array_join(F.collect_list("x").over(w.rowsBetween(-1, 1)), "|")).where("role = 'user'").select("conv_id", "turn", "context")
