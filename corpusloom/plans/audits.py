"""Queries over projections, key joins, review records and integrity rules, and their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.plans.registry import query
from corpusloom.sources.readers import table

# Filters and projections


@query("select lang, quality, count(*) n from documents join labels using (doc_id) where lang = 'de' group by all")
def b08_split_filter(spark: SparkSession, sf: str) -> DataFrame:
    """One split alone goes into the join."""
    split = table(spark, sf, "documents").where("lang = 'de'").select("doc_id", "lang")
    return split.join(table(spark, sf, "labels"), "doc_id").groupBy("lang", "quality").agg(F.count("*").alias("n"))


@query("select event_type, count(*) n from events where contains(event_type, 'i') and (value > 100) is not true group by 1")
def b10_evidence_filter(spark: SparkSession, sf: str) -> DataFrame:
    """Records of a status without a flag; an unknown flag is none."""
    e = table(spark, sf, "events").where(F.contains("event_type", F.lit("i")) & F.expr("(value > 100) is not true"))
    return e.groupBy("event_type").agg(F.count("*").alias("n"))


@query("select user_id, bool_or(coalesce((props->>'k')::int = 0, false)) negated from events group by 1")
def b11_explicit_negation(spark: SparkSession, sf: str) -> DataFrame:
    """Users with a record whose nested field says so; a missing field doesn't."""
    said = F.coalesce(F.get_json_object("props", "$.k").cast("int") == 0, F.lit(False))
    return table(spark, sf, "events").groupBy("user_id").agg(F.bool_or(said).alias("negated"))


@query("select o_orderkey, o_orderstatus from orders where o_orderstatus in ('O', 'P') and o_totalprice >= 1000")
def b13_in_scope(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").where(F.col("o_orderstatus").isin("O", "P") & (F.col("o_totalprice") >= 1000)).select("o_orderkey", "o_orderstatus")


@query("select p_partkey, p_name from part where list_contains(string_split(p_name, ' '), 'widget')")
def b14_tag_filter(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").where(F.array_contains(F.split("p_name", " "), "widget")).select("p_partkey", "p_name")


_SCORE = "(p_size > 25)::int * 2 + (p_retailprice > 905)::int * 2 + (p_type = 'PROMO')::int"


def _scored(spark: SparkSession, sf: str) -> DataFrame:
    score = (F.col("p_size") > 25).cast("int") * 2 + (F.col("p_retailprice") > 905).cast("int") * 2 + (F.col("p_type") == "PROMO").cast("int")
    return table(spark, sf, "part").withColumn("score", score)


@query(f"select p_partkey, {_SCORE} score from part where {_SCORE} >= 4")
def b15_score_threshold(spark: SparkSession, sf: str) -> DataFrame:
    return _scored(spark, sf).where("score >= 4").select("p_partkey", "score")


@query("select doc_id from documents join labels using (doc_id) where quality = 1 and toxic <> 1 and lang is distinct from 'es'")
def b16_eligible(spark: SparkSession, sf: str) -> DataFrame:
    x = table(spark, sf, "documents").select("doc_id", "lang").join(table(spark, sf, "labels"), "doc_id")
    return x.where((F.col("quality") == 1) & (F.col("toxic") != 1) & ~F.col("lang").eqNullSafe("es")).select("doc_id")


_FORBIDDEN = ("quality", "toxic", "source")


@query("select doc_id, lang, n_chars, '' keep, '' notes, 'v1' version from documents join labels using (doc_id)")
def b18_blinded_sheet(spark: SparkSession, sf: str) -> DataFrame:
    """The columns of a review sheet in their order, none that would tell the answer, and empty ones to fill in."""
    x = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id").drop("text", *_FORBIDDEN)
    x = x.select("doc_id", "lang", "n_chars", F.lit("").alias("keep"), F.lit("").alias("notes"), F.lit("v1").alias("version"))
    if left := set(x.columns) & set(_FORBIDDEN):
        raise ValueError(f"columns that tell the answer: {sorted(left)}")
    return x


@query("""select user_id, min(ts)::date::varchar first_day, string_agg(case when event_type in ('purchase', 'signup') then event_id::varchar end, ',' order by event_id) steps, count(*) events from events group by 1""")
def b19_compact_view(spark: SparkSession, sf: str) -> DataFrame:
    """A user as a small record: renamed fields, and the picked elements of a nested list."""
    e = table(spark, sf, "events").groupBy("user_id").agg(F.min("ts").alias("t"), F.array_sort(F.collect_list(F.struct("event_id", "event_type"))).alias("all"))
    picked = F.filter("all", lambda x: x["event_type"].isin("purchase", "signup"))
    steps = F.array_join(F.transform(picked, lambda x: x["event_id"].cast("string")), ",")
    return e.select("user_id", F.to_date("t").cast("string").alias("first_day"), F.nullif(steps, F.lit("")).alias("steps"), F.size("all").cast("long").alias("events"))


@query("""select d.doc_id, coalesce(case when l.quality = 0 then 'low' end, d.lang) lang, coalesce(l.toxic, 0) toxic from documents d left join labels l using (doc_id)""")
def b21_later_wins(spark: SparkSession, sf: str) -> DataFrame:
    """Two records of a document as one: fields that the later one has stand."""
    later = table(spark, sf, "labels").select("doc_id", F.when(F.col("quality") == 0, "low").alias("_lang"), "toxic")
    x = table(spark, sf, "documents").select("doc_id", "lang").join(later, "doc_id", "left")
    return x.select("doc_id", F.coalesce("_lang", "lang").alias("lang"), F.coalesce("toxic", F.lit(0)).alias("toxic"))


@query("select p_partkey, array_to_string(list_sort(string_split(p_name, ' ')), ' ') words from part")
def b22_sorted_fields(spark: SparkSession, sf: str) -> DataFrame:
    x = table(spark, sf, "part").drop("p_brand", "p_type", "p_size", "p_retailprice")
    return x.select("p_partkey", F.array_join(F.array_sort(F.split("p_name", " ")), " ").alias("words"))


_VIEWS = {"sink_only": ("purchase",), "plain": ("purchase", "click", "view"), "full": ("purchase", "click", "view", "signup", "error")}


@query("""with v(view_name, kind) as (values ('sink_only', 'purchase'), ('plain', 'purchase'), ('plain', 'click'), ('plain', 'view'), ('full', 'purchase'), ('full', 'click'), ('full', 'view'), ('full', 'signup'), ('full', 'error'))
select user_id, view_name, count(*) nodes from events join v on event_type = kind group by all""")
def b23_three_views(spark: SparkSession, sf: str) -> DataFrame:
    """Nodes of each view of a user's graph, picked by their types, from one pass over the nodes."""
    views = F.array_compact(F.array(*(F.when(F.col("event_type").isin(*kinds), F.lit(v)) for v, kinds in _VIEWS.items())))
    return table(spark, sf, "events").select("user_id", F.explode(views).alias("view_name")).groupBy("user_id", "view_name").agg(F.count("*").alias("nodes"))


@query("""with c as (select *, row_number() over (partition by conv_id order by turn) n from conversations),
h as (select conv_id, min(n) filter (contains(text, 'th')) hit, max(n) turns, sum(length(text)) size from c group by 1)
select conv_id, count(*) shown, string_agg(n || ': ' || c.role, chr(10) order by n) shown_text from c join h using (conv_id) where hit is not null and (turns <= 4 and size <= 1500 or n between hit - 1 and hit + 1) group by 1""")
def b24_numbered_window(spark: SparkSession, sf: str) -> DataFrame:
    """A short conversation whole, of a longer one the turns around the first hit, numbered."""
    c = table(spark, sf, "conversations").withColumn("n", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")))
    hits = c.groupBy("conv_id").agg(F.min(F.when(F.contains("text", F.lit("th")), F.col("n"))).alias("hit"), F.max("n").alias("turns"), F.sum(F.length("text")).alias("size"))
    near = F.expr("turns <= 4 and size <= 1500 or n between hit - 1 and hit + 1")
    x = c.join(hits.where("hit is not null"), "conv_id").where(near)
    rows = F.array_sort(F.collect_list(F.struct("n", F.concat(F.col("n").cast("string"), F.lit(": "), "role").alias("line"))))
    return x.groupBy("conv_id").agg(F.count("*").alias("shown"), F.array_join(rows["line"], "\n").alias("shown_text"))


@query("""select doc_id, quality = 1 and toxic = 1 behaviour, quality = 1 and n_chars < 1000 strict, quality = 1 or n_chars < 1000 inclusive,
case when toxic = 1 then 'confirmed' when quality = 0 then 'rejected' when n_chars > 5000 then 'needs context' else 'open' end status_group,
case when contains(text, '@') and contains(text, 'http') then 'both' when contains(text, '@') then 'mail' when contains(text, 'http') then 'link' else 'none' end evidence
from documents join labels using (doc_id)""")
def b26_derived(spark: SparkSession, sf: str) -> DataFrame:
    """Booleans from other columns, and ordered cases."""
    x = table(spark, sf, "documents").select("doc_id", "n_chars", "text").join(table(spark, sf, "labels"), "doc_id")
    good, short, mail, link = F.col("quality") == 1, F.col("n_chars") < 1000, F.contains("text", F.lit("@")), F.contains("text", F.lit("http"))
    status = F.when(F.col("toxic") == 1, "confirmed").when(F.col("quality") == 0, "rejected").when(F.col("n_chars") > 5000, "needs context").otherwise("open")
    evidence = F.when(mail & link, "both").when(mail, "mail").when(link, "link").otherwise("none")
    return x.select("doc_id", (good & (F.col("toxic") == 1)).alias("behaviour"), (good & short).alias("strict"), (good | short).alias("inclusive"), status.alias("status_group"), evidence.alias("evidence"))


@query("""select user_id, bool_or(event_type = 'signup') has_source, bool_or(event_type = 'purchase') has_sink, bool_or(event_type = 'error') has_guard, bool_or(value > 200) has_large from events group by 1""")
def b27_present_evidence(spark: SparkSession, sf: str) -> DataFrame:
    kind = lambda k: F.bool_or(F.col("event_type") == k)
    return table(spark, sf, "events").groupBy("user_id").agg(kind("signup").alias("has_source"), kind("purchase").alias("has_sink"), kind("error").alias("has_guard"), F.bool_or(F.col("value") > 200).alias("has_large"))


@query("select s_suppkey, s_name from supplier where s_suppkey not in (select l_suppkey from lineitem where l_quantity = 50 and l_tax = 0.08 and l_discount = 0.1 and l_suppkey is not null)")
def b29_excluded_ids(spark: SparkSession, sf: str) -> DataFrame:
    gone = table(spark, sf, "lineitem").where("l_quantity = 50 and l_tax = 0.08 and l_discount = 0.1").select(F.col("l_suppkey").alias("s_suppkey"))
    return table(spark, sf, "supplier").join(gone, "s_suppkey", "left_anti").select("s_suppkey", "s_name")


# Joins


@query("""with d as (select user_id, min(event_id) filter (event_type = 'signup') own, min(event_id) filter (event_type = 'view') imported, min(event_id) filter (event_type = 'click') alias_ from events group by 1),
p as (select event_id, user_id from events where event_type = 'purchase')
select event_id, callee from (select p.event_id, own callee from p join d using (user_id) union select p.event_id, imported from p join d using (user_id) union select p.event_id, alias_ from p join d using (user_id)) where callee is not null and callee < event_id""")
def c06_resolution_paths(spark: SparkSession, sf: str) -> DataFrame:
    """What a call may mean by three ways of resolution, each pair once."""
    e = table(spark, sf, "events")
    first = lambda k: F.min(F.when(F.col("event_type") == k, F.col("event_id")))
    d = e.groupBy("user_id").agg(F.array(first("signup"), first("view"), first("click")).alias("ways"))
    p = e.where("event_type = 'purchase'").select("event_id", "user_id").join(d, "user_id")
    return p.select("event_id", F.explode(F.array_distinct(F.array_compact("ways"))).alias("callee")).where("callee < event_id")


@query("""with k as (select page_id, regexp_extract(url, '://([^/?#]*)', 1) h from pages), c as (select page_id, h target, 0 r from k union all select page_id, 'www.' || h, 1 from k union all select page_id, regexp_replace(h, '^[^.]*[.]', ''), 2 from k),
f as (select h, min(page_id) home from k group by 1)
select c.page_id, arg_min(f.h, r) target, arg_min(home, r) home from c join f on c.target = f.h where home <> c.page_id group by 1""")
def c08_candidate_paths(spark: SparkSession, sf: str) -> DataFrame:
    """The first of several candidate names that exists, in order of preference."""
    k = table(spark, sf, "pages").select("page_id", F.regexp_extract("url", "://([^/?#]*)", 1).alias("h"))
    names = F.array("h", F.concat(F.lit("www."), "h"), F.regexp_replace("h", "^[^.]*[.]", ""))
    c = k.select("page_id", F.posexplode(names).alias("r", "target"))
    homes = k.groupBy("h").agg(F.min("page_id").alias("home"))
    x = c.join(homes, c["target"] == homes["h"]).where("home <> page_id")
    return x.groupBy("page_id").agg(F.min_by("target", "r").alias("target"), F.min_by("home", "r").alias("home"))


@query("select p_partkey, exists (select 1 from lineitem where l_partkey = p_partkey and l_returnflag = 'R' and l_quantity > 45) hit from part")
def c17_exists(spark: SparkSession, sf: str) -> DataFrame:
    hits = table(spark, sf, "lineitem").where("l_returnflag = 'R' and l_quantity > 45").select(F.col("l_partkey").alias("p_partkey")).distinct().withColumn("hit", F.lit(True))
    return table(spark, sf, "part").select("p_partkey").join(hits, "p_partkey", "left").select("p_partkey", F.coalesce("hit", F.lit(False)).alias("hit"))


@query("select (select count(*) from labels join documents using (doc_id)) matched, (select count(*) from labels where doc_id not in (select doc_id from documents)) missing")
def c18_total_join(spark: SparkSession, sf: str) -> DataFrame:
    """Each row has to find its partner; those that don't are counted as errors."""
    d = table(spark, sf, "documents").select("doc_id", F.lit(1).alias("there"))
    return table(spark, sf, "labels").join(d, "doc_id", "left").agg(F.count("there").alias("matched"), F.count_if(F.col("there").isNull()).alias("missing"))


@query("""select s_suppkey, c_custkey, c_name is not null covered from supplier left join customer on c_name = 'Customer#' || regexp_replace(s_name, '^Supplier#', '')""")
def c26_derived_key(spark: SparkSession, sf: str) -> DataFrame:
    """A left join by an id that is made from the other one."""
    s = table(spark, sf, "supplier").withColumn("key", F.concat(F.lit("Customer#"), F.regexp_replace("s_name", "^Supplier#", "")))
    c = table(spark, sf, "customer").select("c_custkey", "c_name")
    return s.join(c, s["key"] == c["c_name"], "left").select("s_suppkey", "c_custkey", F.col("c_name").isNotNull().alias("covered"))


_QUEUE = "q as (select doc_id, 100 - n_chars % 100 score from documents where lang = 'en')"


@query(f"""with {_QUEUE} select l.doc_id, coalesce(q.score, -1) score, coalesce(d.source, 'unknown') source,
case when l.toxic = 1 then 'vulnerability' when q.doc_id is null then 'not queued' when q.score >= 50 then 'pending' else 'guarded' end disposition
from labels l left join q using (doc_id) left join documents d on d.doc_id = l.doc_id and d.lang <> 'fr'""")
def c27_queue_and_manifest(spark: SparkSession, sf: str) -> DataFrame:
    """Labels with their place in a queue and their manifest row, defaults where there is none, and the disposition that follows."""
    d = table(spark, sf, "documents")
    q = d.where("lang = 'en'").select("doc_id", (100 - F.col("n_chars") % 100).alias("score"))
    m = d.where("lang <> 'fr'").select("doc_id", "source")
    x = table(spark, sf, "labels").join(q, "doc_id", "left").join(m, "doc_id", "left")
    kind = F.when(F.col("toxic") == 1, "vulnerability").when(F.col("score").isNull(), "not queued").when(F.col("score") >= 50, "pending").otherwise("guarded")
    return x.select("doc_id", F.coalesce("score", F.lit(-1)).alias("score"), F.coalesce("source", F.lit("unknown")).alias("source"), kind.alias("disposition"))


_HALVES = "a as (select user_id, list_sort(list(distinct event_type)) kinds, count(*) n from events where ts < timestamp '2024-01-16' group by 1), b as (select user_id, list_sort(list(distinct event_type)) kinds, count(*) n from events where ts >= timestamp '2024-01-16' group by 1)"


def _halves(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    e, late = table(spark, sf, "events"), F.col("ts") >= F.lit("2024-01-16").cast("timestamp_ntz")
    each = lambda part: part.groupBy("user_id").agg(F.array_sort(F.collect_set("event_type")).alias("kinds"), F.count("*").alias("n"))
    return each(e.where(~late)), each(e.where(late))


@query(f"with {_HALVES} select count(*) filter (a.user_id is null) only_after, count(*) filter (b.user_id is null) only_before, count(*) filter (a.kinds = b.kinds) same, count(*) filter (a.kinds <> b.kinds) differ from a full join b using (user_id)")
def c29_paired_versions(spark: SparkSession, sf: str) -> DataFrame:
    """Populations of two versions have to agree, and so do the records of a pair."""
    a, b = _halves(spark, sf)
    x = a.withColumn("l", F.lit(1)).join(b.select("user_id", F.col("kinds").alias("others"), F.lit(1).alias("r")), "user_id", "full_outer")
    return x.agg(F.count_if(F.col("l").isNull()).alias("only_after"), F.count_if(F.col("r").isNull()).alias("only_before"), F.count_if(F.expr("kinds = others")).alias("same"), F.count_if(F.expr("kinds <> others")).alias("differ"))


@query("select user_id, round(coalesce(sum(value) filter (event_type = 'click'), 0), 6) scan, round(coalesce(sum(value) filter (event_type = 'view'), 0), 6) build, round(coalesce(sum(value), 0), 6) total from events where event_type in ('click', 'view') group by 1")
def c30_stage_runtimes(spark: SparkSession, sf: str) -> DataFrame:
    """Seconds of two stages side by side, a stage that is missing counting nothing."""
    e = table(spark, sf, "events").where(F.col("event_type").isin("click", "view"))
    p = e.groupBy("user_id").pivot("event_type", ["click", "view"]).sum("value").na.fill(0.0)
    return p.select("user_id", F.round("click", 6).alias("scan"), F.round("view", 6).alias("build"), F.round(F.col("click") + F.col("view"), 6).alias("total"))


@query("""with l as (select doc_id, unnest(string_split(text, chr(10))) line, generate_subscripts(string_split(text, chr(10)), 1)::int line_no from documents),
s as (select doc_id, line_no, sha256(case when doc_id % 7 = 0 and line_no = 1 then line || '!' else line end) stored from l)
select doc_id, count(*) lines, count(*) filter (stored <> sha256(line)) wrong from l join s using (doc_id, line_no) group by 1 having wrong > 0""")
def c34_hash_verified(spark: SparkSession, sf: str) -> DataFrame:
    """An analogue of C34 within one table: each document's line hashes, some altered, against those of the same lines. k06_finding_verification joins stored findings to another read."""
    d = table(spark, sf, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("n", "line"))
    stored = F.sha2(F.when((F.col("doc_id") % 7 == 0) & (F.col("n") == 0), F.concat("line", F.lit("!"))).otherwise(F.col("line")), 256)
    x = d.groupBy("doc_id").agg(F.count("*").alias("lines"), F.count_if(stored != F.sha2("line", 256)).alias("wrong"))
    return x.where("wrong > 0")


_ADAPTERS = {"feed": "utm_", "mobile": "://m[.]", "docs": "/en/"}
_SIGNALS = "s as (select name, page_id, regexp_extract(url, '://([^/?#]*)', 1) host from pages join (values ('feed', 'utm_'), ('mobile', '://m[.]'), ('docs', '/en/')) a(name, pattern) on regexp_matches(url, pattern))"


def _signals(spark: SparkSession, sf: str) -> DataFrame:
    hits = F.array_compact(F.array(*(F.when(F.col("url").rlike(p), F.lit(n)) for n, p in _ADAPTERS.items())))
    return table(spark, sf, "pages").select(F.explode(hits).alias("name"), "page_id", F.regexp_extract("url", "://([^/?#]*)", 1).alias("host"))


@query(f"with {_SIGNALS} select distinct name, host from s")
def c37_signals(spark: SparkSession, sf: str) -> DataFrame:
    """Which adapter's pattern a host's URLs show; the patterns are literals of one projection."""
    return _signals(spark, sf).select("name", "host").distinct()


@query("""select event_id, coalesce(json_extract_string(props, '$.labels.k'), json_extract_string(props, '$.k'))::bigint label from events where coalesce(json_extract_string(props, '$.labels.k'), json_extract_string(props, '$.k')) is not null""")
def c38_nested_or_flat(spark: SparkSession, sf: str) -> DataFrame:
    """A label from its nested place, else from the record itself."""
    label = F.coalesce(F.get_json_object("props", "$.labels.k"), F.get_json_object("props", "$.k"))
    return table(spark, sf, "events").select("event_id", label.cast("long").alias("label")).where("label is not null")


@query("select n_name, stage from nation, (values ('scan', 0), ('build', 1), ('score', 3)) s(stage, least) where n_regionkey >= least")
def c40_work_list(spark: SparkSession, sf: str) -> DataFrame:
    """Rows with each stage that they need: a literal list of stages, filtered and unnested."""
    stages = F.array(*(F.struct(F.lit(s).alias("stage"), F.lit(k).alias("least")) for s, k in (("scan", 0), ("build", 1), ("score", 3))))
    x = table(spark, sf, "nation").select("n_name", "n_regionkey", F.explode(stages).alias("s"))
    return x.where(F.col("n_regionkey") >= F.col("s.least")).select("n_name", "s.stage")


# Review


def _errors(**rules: Column) -> Column:
    """Names of the rules that are broken (null counts as kept), joined by commas."""
    return F.array_join(F.array_compact(F.array(*(F.when(broken, F.lit(name)) for name, broken in rules.items()))), ",")


@query("""with e as (select doc_id, array_to_string(list_filter([case when lang not in ('en', 'de', 'fr') then 'lang' end, case when toxic = 1 and quality = 1 then 'toxic_quality' end, case when quality = 0 and n_chars > 3000 then 'long_low' end, case when coalesce(trim(text), '') = '' then 'empty' end, case when toxic = 1 and source is null then 'source' end], lambda x: x is not null), ',') errors from documents join labels using (doc_id))
select * from e where errors <> ''""")
def j03_validation(spark: SparkSession, sf: str) -> DataFrame:
    """Values out of their enums, and rules across fields, as one list of errors a row."""
    x = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id")
    toxic, low = F.col("toxic") == 1, F.col("quality") == 0
    errors = _errors(lang=~F.col("lang").isin("en", "de", "fr"), toxic_quality=toxic & (F.col("quality") == 1), long_low=low & (F.col("n_chars") > 3000), empty=F.coalesce(F.trim("text"), F.lit("")) == "", source=toxic & F.col("source").isNull())
    return x.select("doc_id", errors.alias("errors")).where("errors <> ''")


@query("select user_id, arg_max(event_type, (ts, event_id)) event_type, case when bool_or(event_type = 'purchase') then 'completed' else 'draft' end state from events group by 1")
def j05_upsert(spark: SparkSession, sf: str) -> DataFrame:
    """The latest version of each record; once completed it stays so."""
    e = table(spark, sf, "events")
    return e.groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("event_type"), F.when(F.bool_or(F.col("event_type") == "purchase"), "completed").otherwise("draft").alias("state"))


_PANEL = "p as (select l.doc_id, (n_chars < 1000)::int a, contains(text, '!')::int b, (lang = 'en')::int c, quality, toxic from labels l join documents using (doc_id)), v as (select *, a + b + c votes from p)"


def _panel(spark: SparkSession, sf: str) -> DataFrame:
    x = table(spark, sf, "labels").join(table(spark, sf, "documents"), "doc_id")
    a, b, c = ((F.col("n_chars") < 1000).cast("int"), F.contains("text", F.lit("!")).cast("int"), (F.col("lang") == "en").cast("int"))
    return x.select("doc_id", a.alias("a"), b.alias("b"), c.alias("c"), "quality", "toxic", (a + b + c).alias("votes"))


@query(f"with {_PANEL} select doc_id, case when quality <> (votes >= 2)::int and votes in (0, 3) then 'modified' when quality <> (votes >= 2)::int then 'ties only' else 'accepted' end alignment from v")
def j06_alignment(spark: SparkSession, sf: str) -> DataFrame:
    """How a reviewer stands to the panel: against all, against some, or with it."""
    off = F.col("quality") != (F.col("votes") >= 2).cast("int")
    return _panel(spark, sf).select("doc_id", F.when(off & F.col("votes").isin(0, 3), "modified").when(off, "ties only").otherwise("accepted").alias("alignment"))


@query(f"""with {_PANEL}, u as (select 'quality' field, quality = (votes >= 2)::int same, votes from v union all select 'toxic', toxic = (votes >= 2)::int, votes from v)
select field, case when votes in (0, 3) then 'unanimous' else 'split' end strength, count(*) n, count(*) filter (same) matched, count(*) filter (not same) overridden, round(count(*) filter (same) / count(*), 6) rate from u group by all""")
def d24_reviewer_alignment(spark: SparkSession, sf: str) -> DataFrame:
    """Matches and overrides by field and by how strong the panel's vote was."""
    most = (F.col("votes") >= 2).cast("int")
    u = _panel(spark, sf).select("votes", F.explode(F.array(*(F.struct(F.lit(f).alias("field"), (F.col(f) == most).alias("same")) for f in ("quality", "toxic")))).alias("x")).select("votes", "x.*")
    g = u.groupBy("field", F.when(F.col("votes").isin(0, 3), "unanimous").otherwise("split").alias("strength"))
    return g.agg(F.count("*").alias("n"), F.count_if("same").alias("matched"), F.count_if(~F.col("same")).alias("overridden"), F.round(F.count_if("same") / F.count("*"), 6).alias("rate"))


@query("""with d as (select o_custkey, o_orderkey, o_totalprice, sum(o_totalprice) over (partition by o_custkey order by o_orderdate, o_orderkey) spent from orders)
select o_custkey, min_by(o_orderkey, (spent, o_orderkey)) stopped_at, count(*) refused from d where spent + 1000 > 500000 group by 1""")
def j07_budget_gate(spark: SparkSession, sf: str) -> DataFrame:
    """The first order with which spending and a reserve go over the budget, and how many are refused."""
    spent = F.sum("o_totalprice").over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey").rowsBetween(Window.unboundedPreceding, 0))
    x = table(spark, sf, "orders").select("o_custkey", "o_orderkey", spent.alias("spent")).where("spent + 1000 > 500000")
    return x.groupBy("o_custkey").agg(F.min_by("o_orderkey", F.struct("spent", "o_orderkey")).alias("stopped_at"), F.count("*").alias("refused"))


@query("""select o_custkey, count(*) cases, string_agg(distinct o_orderstatus, ',' order by o_orderstatus) statuses, bool_or(o_orderpriority = '1-URGENT') urgent, case when bool_and(o_orderstatus = 'F') then 'final' when bool_or(o_orderstatus = 'P') then 'partial' else 'open' end outcome from orders group by 1""")
def j09_finalised(spark: SparkSession, sf: str) -> DataFrame:
    """Members of a case as one record, with the union of their lists and the outcome that all allow."""
    status = F.col("o_orderstatus")
    outcome = F.when(F.bool_and(status == "F"), "final").when(F.bool_or(status == "P"), "partial").otherwise("open")
    return table(spark, sf, "orders").groupBy("o_custkey").agg(F.count("*").alias("cases"), F.array_join(F.array_sort(F.collect_set(status)), ",").alias("statuses"), F.bool_or(F.col("o_orderpriority") == "1-URGENT").alias("urgent"), outcome.alias("outcome"))


# Integrity: rows that should not be there


@query("select l_orderkey, l_linenumber, count(*) n from lineitem group by all having n > 1")
def k01_duplicate_ids(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("n")).where("n > 1")


@query("""select (select count(*) from orders) expected, (select count(distinct l_orderkey) from lineitem) found, (select count(*) from orders) = (select count(distinct l_orderkey) from lineitem) equal""")
def k04_counts_agree(spark: SparkSession, sf: str) -> DataFrame:
    a = table(spark, sf, "orders").agg(F.count("*").alias("expected"))
    b = table(spark, sf, "lineitem").agg(F.count_distinct("l_orderkey").alias("found"))
    return a.join(F.broadcast(b)).withColumn("equal", F.col("expected") == F.col("found"))  # a row each


@query("with s as (select user_id, case when ts < timestamp '2024-01-16' then 'development' else 'held out' end split, count(*) n from events group by all) select user_id, sum(n)::bigint events from s group by 1 having count(*) > 1")
def k05_split_leaks(spark: SparkSession, sf: str) -> DataFrame:
    """Users that lie in both splits."""
    late = F.col("ts") >= F.lit("2024-01-16").cast("timestamp_ntz")
    return table(spark, sf, "events").groupBy("user_id").agg(F.count("*").alias("events"), F.bool_or(late).alias("held"), F.bool_or(~late).alias("dev")).where("held and dev").select("user_id", "events")


@query("""with s as (select o_orderpriority, o_orderstatus, count(*) n, least(count(*), 20) taken from orders group by all), q as (select count(*) strata, sum(taken)::bigint tasks, sum(n)::bigint population, sum(taken * (n / taken)) weighted from s)
select strata, tasks, population, abs(weighted - population) < 1e-6 weights_add_up, tasks = 20 * strata quota_filled from q""")
def k07_sample_rules(spark: SparkSession, sf: str) -> DataFrame:
    """Sizes of a stratified sample whose weights add up to the population by construction. k07_sample_audit checks a sample that breaks the rules."""
    s = table(spark, sf, "orders").groupBy("o_orderpriority", "o_orderstatus").agg(F.count("*").alias("n")).withColumn("taken", F.least("n", F.lit(20)))
    q = s.agg(F.count("*").alias("strata"), F.sum("taken").alias("tasks"), F.sum("n").alias("population"), F.sum(F.col("taken") * (F.col("n") / F.col("taken"))).alias("weighted"))
    return q.select("strata", "tasks", "population", (F.abs(F.col("weighted") - F.col("population")) < 1e-6).alias("weights_add_up"), (F.col("tasks") == 20 * F.col("strata")).alias("quota_filled"))


@query("""with x as (select c_custkey, c_name, lead(c_name) over (partition by c_custkey // 1000 order by c_custkey) follows, count(*) over (partition by c_name) n from customer)
select c_custkey, array_to_string(list_filter([case when not regexp_full_match(c_name, 'Customer#[0-9]{9}') then 'name' end, case when n > 1 then 'repeated' end, case when follows <= c_name then 'order' end, case when c_custkey % 50 = 0 then 'flagged' end], lambda v: v is not null), ',') errors from x where not regexp_full_match(c_name, 'Customer#[0-9]{9}') or n > 1 or follows <= c_name or c_custkey % 50 = 0""")
def k08_manifest_rules(spark: SparkSession, sf: str) -> DataFrame:
    """Rows of a manifest that break its format, repeat, stand out of order, or are flagged."""
    c = table(spark, sf, "customer").select("c_custkey", "c_name")
    twice = c.groupBy("c_name").agg(F.count("*").alias("n"))
    follows = F.lead("c_name").over(Window.partitionBy(F.floor(F.col("c_custkey") / 1000)).orderBy("c_custkey"))
    x = c.withColumn("follows", follows).join(twice, "c_name")
    errors = _errors(name=~F.col("c_name").rlike("^Customer#[0-9]{9}$"), repeated=F.col("n") > 1, order=F.col("follows") <= F.col("c_name"), flagged=F.col("c_custkey") % 50 == 0)
    return x.select("c_custkey", errors.alias("errors")).where("errors <> ''")


@query("""with p as (select doc_id, 'short' field, n_chars < 1000 prediction, lang from documents union all select doc_id, 'quality', quality = 1, null from labels)
select field, count(*) n, count(*) - count(distinct doc_id) repeated, count(*) filter (prediction is null) unset, count(*) filter (doc_id not in (select doc_id from labels)) outside from p group by 1""")
def k09_prediction_rules(spark: SparkSession, sf: str) -> DataFrame:
    """Predictions that repeat, have no value, or lie outside the split."""
    labels = table(spark, sf, "labels")
    p = table(spark, sf, "documents").select("doc_id", F.lit("short").alias("field"), (F.col("n_chars") < 1000).alias("prediction"))
    p = p.unionByName(labels.select("doc_id", F.lit("quality").alias("field"), (F.col("quality") == 1).alias("prediction")))
    p = p.join(labels.select("doc_id", F.lit(1).alias("inside")).distinct(), "doc_id", "left")
    return p.groupBy("field").agg(F.count("*").alias("n"), (F.count("*") - F.count_distinct("doc_id")).alias("repeated"), F.count_if(F.col("prediction").isNull()).alias("unset"), F.count_if(F.col("inside").isNull()).alias("outside"))


@query("""select conv_id, count(*) turns, count(*) filter (turn not between 0 and 3) outside, count(distinct sha256(text)) <> count(*) same_text from conversations group by 1 having outside > 0 or same_text""")
def k10_input_rules(spark: SparkSession, sf: str) -> DataFrame:
    """Inputs with lines outside their window, or the same input twice."""
    c = table(spark, sf, "conversations").groupBy("conv_id").agg(F.count("*").alias("turns"), F.count_if(~F.col("turn").between(0, 3)).alias("outside"), (F.count_distinct(F.sha2("text", 256)) != F.count("*")).alias("same_text"))
    return c.where("outside > 0 or same_text")


@query("""with e as (select 'graph repeated' error, count(*) n from (select o_orderkey from orders group by 1 having count(*) > 1) union all select 'no items', count(*) from orders where o_orderkey not in (select l_orderkey from lineitem)
union all select 'dangling', count(distinct l_orderkey) from lineitem where l_orderkey not in (select o_orderkey from orders) union all select 'no return flag', count(*) from lineitem where coalesce(l_returnflag, '') = '') select * from e""")
def d38_validation_report(spark: SparkSession, sf: str) -> DataFrame:
    """How many records break each rule, as one report."""
    o, li = table(spark, sf, "orders"), table(spark, sf, "lineitem")
    keys = li.select(F.col("l_orderkey").alias("o_orderkey"))
    found = {
        "graph repeated": o.groupBy("o_orderkey").agg(F.count("*").alias("k")).where("k > 1"),
        "no items": o.join(keys, "o_orderkey", "left_anti"),
        "dangling": keys.join(o, "o_orderkey", "left_anti").distinct(),
        "no return flag": li.where("coalesce(l_returnflag, '') = ''"),
    }
    counts = [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("error"), "n") for name, df in found.items()]
    out = counts[0]
    for c in counts[1:]:
        out = out.unionByName(c)
    return out
