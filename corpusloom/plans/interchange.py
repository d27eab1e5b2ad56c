"""Queries that write records in the formats of other tools and read them back, and scalar ones on text, dates and arrays."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.plans.registry import query
from corpusloom.sources import records
from corpusloom.sources.readers import table
from corpusloom.sources.tables import scratch, stored


@query("select event_id, user_id, event_type, value, props from events")
def a05_jsonl(spark: SparkSession, sf: str) -> DataFrame:
    """JSON lines with a needed column and a unique key."""
    path = scratch(spark, "events")
    records.write_jsonl(table(spark, sf, "events").select("event_id", "user_id", "event_type", "value", "props"), path)
    return records.read_jsonl(spark, path, "event_id long, user_id long, event_type string, value double, props string", need=("event_type",), unique="event_id")


@query("""select c_custkey, c_name || ', "' || c_mktsegment || '"' label, c_acctbal from customer""")
def a08_csv(spark: SparkSession, sf: str) -> DataFrame:
    """CSV by its header, with quotes and commas in fields; columns picked by name."""
    path = scratch(spark, "customers")
    label = F.concat("c_name", F.lit(', "'), "c_mktsegment", F.lit('"'))
    records.write_csv(table(spark, sf, "customer").select("c_nationkey", "c_custkey", label.alias("label"), "c_acctbal"), path)
    return records.read_csv(spark, path).select(F.col("c_custkey").cast("long").alias("c_custkey"), "label", F.col("c_acctbal").cast("double").alias("c_acctbal"))


@query("select s_nationkey::varchar nation, s_suppkey, s_name from supplier")
def a09_record_folders(spark: SparkSession, sf: str) -> DataFrame:
    """Records whose file's path tells a column."""
    path = scratch(spark, "suppliers")
    table(spark, sf, "supplier").select("s_suppkey", "s_name", "s_nationkey").write.partitionBy("s_nationkey").json(path)
    return records.read_records(spark, path, "s_suppkey long, s_name string", "nation", "s_nationkey=([^/]+)/", multi_line=False).select("nation", "s_suppkey", "s_name")


_LINES = """with f as (select distinct l_orderkey, case l_returnflag when 'R' then 'sent_back' when 'A' then 'accepted' else 'none' end rule, case l_linestatus when 'O' then 'warning' else 'error' end level, l_partkey, l_linenumber from lineitem)
"""


def _lines(spark: SparkSession, sf: str) -> DataFrame:
    """An order's lines as findings in files, each with one step of a flow."""
    rule = F.when(F.col("l_returnflag") == "R", "sent_back").when(F.col("l_returnflag") == "A", "accepted").otherwise("none")
    level = F.when(F.col("l_linestatus") == "O", "warning").otherwise("error")
    f = table(spark, sf, "lineitem").select("l_orderkey", rule.alias("rule"), level.alias("level"), "l_partkey", "l_linenumber").distinct()
    part = F.col("l_partkey").cast("string")
    step = F.struct(F.lit("./lib/step+1.py").alias("path"), (F.col("l_linenumber") * 10).alias("line"))
    return f.select(
        "l_orderkey", "rule", "level", F.concat(F.lit("part "), part).alias("message"), F.concat(F.lit("./src/part "), part, F.lit(".py")).alias("path"),
        F.col("l_linenumber").alias("line_start"), (F.col("l_linenumber") + 2).alias("line_end"), F.concat_ws("-", "l_orderkey", "l_partkey").alias("fingerprint"), F.array(step).alias("flow"),
    )


def _sarif(spark: SparkSession, sf: str) -> DataFrame:
    logs = stored(records.sarif_logs(_lines(spark, sf), "l_orderkey", "corpusloom"), "sarif")
    return records.sarif_results(logs, "l_orderkey")


@query(_LINES + "select l_orderkey, rule, case rule when 'sent_back' then 'Sent Back' when 'accepted' then 'Accepted' else 'None' end rule_name, level, 'part ' || l_partkey message, l_orderkey || '-' || l_partkey fingerprint from f")
def a10_sarif_results(spark: SparkSession, sf: str) -> DataFrame:
    """SARIF logs, a log for each order, and their results with the rules' names."""
    return _sarif(spark, sf).withColumn("fingerprint", F.try_element_at("fingerprints", F.lit("primary"))).drop("fingerprints", "places")


@query(_LINES + "select l_orderkey, rule, 'src/part ' || l_partkey || '.py' path, l_linenumber line_start, l_linenumber + 2 line_end from f union select l_orderkey, rule, 'lib/step+1.py', l_linenumber * 10, l_linenumber * 10 from f")
def a11_sarif_locations(spark: SparkSession, sf: str) -> DataFrame:
    """Places of SARIF results, those of their flows included."""
    return records.sarif_locations(_sarif(spark, sf), "l_orderkey", "rule")


@query(_LINES + "select l_orderkey, rule, 'part ' || l_partkey || '.py' path, l_linenumber line_start, l_linenumber + 2 line_end, upper(level) severity, 'part ' || l_partkey message from f")
def a12_tool_report(spark: SparkSession, sf: str) -> DataFrame:
    """A scanner's JSON report for each order, its paths seen from inside a container."""
    line = lambda c: F.struct(F.col(c).cast("int").alias("line"))
    path = F.regexp_replace("path", "^[.]/src/", "/src/")
    one = F.struct(F.col("rule").alias("check_id"), path.alias("path"), line("line_start").alias("start"), line("line_end").alias("end"), F.struct(F.upper("level").alias("severity"), "message").alias("extra"))
    reports = _lines(spark, sf).groupBy("l_orderkey").agg(F.to_json(F.struct(F.collect_list(one).alias("results"))).alias("report"))
    return records.report_results(stored(reports, "reports"), "l_orderkey")


@query("""with p as (select p_partkey, p_size, sha256(p_brand || p_type || p_name) fingerprint from part)
select p_partkey, fingerprint not in (select fingerprint from p where p_size <= 25) is_new from p""")
def a15_baseline(spark: SparkSession, sf: str) -> DataFrame:
    """Fingerprints written as a baseline, checked when read, and what is new against it."""
    p = table(spark, sf, "part").select("p_partkey", "p_size", F.sha2(F.concat("p_brand", "p_type", "p_name"), 256).alias("fingerprint"))
    path = scratch(spark, "baseline")
    records.write_baseline(p.where("p_size <= 25"), path, "part-baseline")
    old = records.read_baseline(spark, path, "part-baseline").withColumn("old", F.lit(True))
    return p.join(old, "fingerprint", "left").select("p_partkey", F.col("old").isNull().alias("is_new"))


@query("select c_mktsegment, c_nationkey, count(*) n, sum((c_acctbal < 0)::int)::bigint negative from customer group by all")
def a16_sql_report(spark: SparkSession, sf: str) -> DataFrame:
    """A table kept, and a report that SQL reads from it."""
    kept = stored(table(spark, sf, "customer").select("c_mktsegment", "c_nationkey", "c_acctbal"), "customer")
    return spark.sql("select c_mktsegment, c_nationkey, count(*) n, sum(int(c_acctbal < 0)) negative from {kept} group by all order by n desc, c_mktsegment, c_nationkey", kept=kept)


@query("""with c as (select source, coalesce(lang, 'none') lang, count(*) n, sum(coalesce(strlen(text), 0))::bigint b, sum(coalesce(contains(lower(text), 'license'), false)::int)::bigint l from documents group by all)
select source, sum(n)::bigint docs, sum(b)::bigint bytes, sum(l)::bigint license_docs, string_agg(lang || ':' || n, ';' order by lang) languages from c group by 1""")
def a17_inventory(spark: SparkSession, sf: str) -> DataFrame:
    """Counts, bytes, licence texts and languages of each source."""
    d = table(spark, sf, "documents").select("source", F.coalesce("lang", F.lit("none")).alias("lang"), F.coalesce(F.octet_length("text"), F.lit(0)).alias("b"), F.contains(F.lower("text"), F.lit("license")).alias("l"))
    c = d.groupBy("source", "lang").agg(F.count("*").alias("n"), F.sum("b").alias("b"), F.count_if("l").alias("l"))
    languages = F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "lang", F.col("n").cast("string")))), ";")
    return c.groupBy("source").agg(F.sum("n").alias("docs"), F.sum("b").alias("bytes"), F.sum("l").alias("license_docs"), languages.alias("languages"))


_TEMPLATES = [("python", "def order_%d(x):\n    return run(x, %d)\n"), ("typescript", "export const order%d = (x) => run(x, %d);\n"), ("shell", "run %d %d\n")]
_TEMPLATE_ROWS = ", ".join("('{}', '{}')".format(k, t.replace("\n", "\\n").replace("%d", "{}")) for k, t in _TEMPLATES)


@query(f"with t(language, template) as (values {_TEMPLATE_ROWS}) select o_orderkey || '-' || language sample_id, language, sha256(format(replace(template, '\\n', chr(10)), o_orderkey, o_custkey)) text_sha256 from orders, t")
def a18_generated_sources(spark: SparkSession, sf: str) -> DataFrame:
    """A source text from each template for each order."""
    texts = F.array(*(F.struct(F.lit(k).alias("language"), F.format_string(t, "o_orderkey", "o_custkey").alias("text")) for k, t in _TEMPLATES))
    x = table(spark, sf, "orders").select("o_orderkey", F.inline(texts))
    return x.select(F.concat_ws("-", F.col("o_orderkey").cast("string"), "language").alias("sample_id"), "language", F.sha2("text", 256).alias("text_sha256"))


@query(r"""select p_partkey, regexp_matches(p_name, 'old|mall') found, len(regexp_extract_all(p_name, '[a-z]+'))::int words, regexp_replace(p_name, '([a-z])[a-z]* ', '\1.', 'g') short, regexp_full_match(p_brand, 'Brand#[1-3][0-9]') whole, string_split(p_brand, '#')[2] number, array_to_string(regexp_extract_all(p_name, '[aeiou](.)', 1), '') after_vowels from part""")
def h06_regex(spark: SparkSession, sf: str) -> DataFrame:
    """Search, find all, substitute, full match, split and groups."""
    p = table(spark, sf, "part")
    return p.select(
        "p_partkey", F.col("p_name").rlike("old|mall").alias("found"), F.size(F.regexp_extract_all("p_name", F.lit("[a-z]+"), 0)).alias("words"), F.regexp_replace("p_name", "([a-z])[a-z]* ", "$1.").alias("short"),
        F.col("p_brand").rlike("^(?:Brand#[1-3][0-9])$").alias("whole"), F.get(F.split("p_brand", "#"), F.lit(1)).alias("number"), F.array_join(F.regexp_extract_all("p_name", F.lit("[aeiou](.)"), 1), "").alias("after_vowels"),
    )


@query("select p_partkey, round_even(p_size / 2, 0) half, round_even(p_size / 8, 2) eighth from part")
def h20_half_even(spark: SparkSession, sf: str) -> DataFrame:
    """Ties round to the even neighbour."""
    return table(spark, sf, "part").select("p_partkey", F.bround(F.col("p_size") / 2, 0).alias("half"), F.bround(F.col("p_size") / 8, 2).alias("eighth"))


@query("""with d as (select o_orderkey, case o_orderkey % 4 when 0 then strftime(o_orderdate, '%Y-%m-%d') when 1 then 'never' when 2 then '' end raw, o_orderdate::date d from orders),
p as (select o_orderkey, raw, try_cast(nullif(raw, '') as date) expires from d)
select o_orderkey, expires::varchar expires, coalesce(raw, '') <> '' and expires is null invalid, coalesce(expires >= date '1996-01-01', coalesce(raw, '') = '') active from p""")
def h23_dates(spark: SparkSession, sf: str) -> DataFrame:
    """Dates out of text: empty is no end, what is no date is invalid, and the last day still counts."""
    k = F.col("o_orderkey") % 4
    raw = F.when(k == 0, F.date_format("o_orderdate", "yyyy-MM-dd")).when(k == 1, "never").when(k == 2, "")
    blank = F.coalesce("raw", F.lit("")) == ""
    o = table(spark, sf, "orders").select("o_orderkey", raw.alias("raw")).withColumn("expires", F.when(~blank, F.col("raw").try_cast("date")))
    return o.select("o_orderkey", F.col("expires").cast("string").alias("expires"), (~blank & F.col("expires").isNull()).alias("invalid"), F.coalesce(F.col("expires") >= F.to_date(F.lit("1996-01-01")), blank).alias("active"))


@query("""select l_orderkey, array_to_string(list_sort(list(distinct l_returnflag)), ',') flags, bool_or(l_quantity > 40) any_large, bool_and(l_tax < 0.05) all_low, array_to_string(list_sort(list(l_linenumber))[1:2], ',') first_two, list_contains(list(l_returnflag), 'R') returned,
array_to_string(list_sort(flatten(list([l_linenumber::bigint, l_suppkey]))), ',') numbers, array_to_string(list_transform(list_zip(list_sort(list(l_linenumber)), list_sort(list(l_partkey))), lambda x: x[1] || ':' || x[2]), ',') zipped from lineitem group by 1""")
def h25_arrays(spark: SparkSession, sf: str) -> DataFrame:
    """Sorted sets, any, all, slices, membership, flattening and zipping of an order's lines."""
    text = lambda a: F.array_join(a.cast("array<string>"), ",")
    g = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(
        F.collect_set("l_returnflag").alias("flags"), F.collect_list("l_quantity").alias("q"), F.collect_list("l_tax").alias("t"), F.array_sort(F.collect_list("l_linenumber")).alias("n"),
        F.array_sort(F.collect_list("l_partkey")).alias("p"), F.collect_list(F.array(F.col("l_linenumber").cast("long"), "l_suppkey")).alias("both"),
    )
    pairs = F.transform(F.arrays_zip("n", "p"), lambda x: F.concat_ws(":", x["n"].cast("string"), x["p"].cast("string")))
    return g.select(
        "l_orderkey", text(F.array_sort("flags")).alias("flags"), F.exists("q", lambda x: x > 40).alias("any_large"), F.forall("t", lambda x: x < 0.05).alias("all_low"), text(F.slice("n", 1, 2)).alias("first_two"),
        F.array_contains("flags", "R").alias("returned"), text(F.array_sort(F.flatten("both"))).alias("numbers"), F.array_join(pairs, ",").alias("zipped"),
    )
