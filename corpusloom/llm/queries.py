"""Registered queries of the training-data operators, with production parameters, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.common import fold, shared_dir, stored, table


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from corpusloom.llm.packing import best_fit

    return best_fit(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op5_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpusloom.llm.ngram_join import jaccard_components

    return jaccard_components(table(spark, sf_dir, "documents"))


def op7_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpusloom.llm.topk import top_k, whole_vectors

    rows = whole_vectors(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", 256)
    return top_k(rows, rows.where("id % 50 = 0"), 5)


#: The rules that op1_url_filters starts from.
URL_RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpusloom.llm.url_filters import judge

    return judge(table(spark, sf_dir, "pages").select("page_id", "url"), URL_RULES)


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpusloom.llm.langid import identify, prototypes

    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held = fold("doc_id", 3) == 1
    model = prototypes(docs.where(~held))
    return identify(docs.select("doc_id", "text", held.alias("held_out")), model).select("doc_id", "held_out", "lang_pred", "score")


def op9_token_rollups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals after three batches: all documents by words; German ones counted anew by letters; short ones taken away. The second comes twice."""
    import uuid

    from corpusloom.llm.rollups import Rollup, deleted, inserted, letter_count, revised, word_count

    docs = table(spark, sf_dir, "documents")
    counted = stored(docs.select("source", "lang", word_count("text").alias("words"), letter_count("text").alias("letters")), "counted")
    by_words = counted.select("source", "lang", F.lit("words-1").alias("tokenizer_version"), F.col("words").alias("tokens"), "words")
    by_letters = counted.select("source", "lang", F.lit("letters-1").alias("tokenizer_version"), F.col("letters").alias("tokens"), "words")
    german, short = F.coalesce(F.col("lang") == "de", F.lit(False)), F.col("words") < 20
    store = Rollup(spark, f"{shared_dir(spark)}/rollups/{uuid.uuid4().hex}")
    store.commit("1-all", inserted(by_words))
    for _ in range(2):
        store.commit("2-german", revised(by_words.where(german), by_letters.where(german)))
    store.commit("3-short", deleted(by_words.where(short & ~german)).unionByName(deleted(by_letters.where(short & german))))
    return store.totals()


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpusloom.llm.toxicity import fit_on, toxicity_scores

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held = fold("doc_id", 5) == 0
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic").where(~held)
    model = fit_on(docs.join(labels, "doc_id"))
    scored = toxicity_scores(docs.select("doc_id", "text", held.alias("held_out")), model)
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op6_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpusloom.llm.mixing import mix

    return mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source")).drop("source")


def op8_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpusloom.llm.lm import score

    return score(table(spark, sf_dir, "documents").select("doc_id", "text"), fold("doc_id", 7) == 2, ["doc_id"])


def op4_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpusloom.llm.fingerprints import as_text, compare_edited

    rows = compare_edited(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return rows.withColumns({"fingerprint": as_text(F.col("fingerprint")), "edited_fingerprint": as_text(F.col("edited_fingerprint"))})


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpusloom.llm.prefix_trie import prefix_trie

    return prefix_trie(table(spark, sf_dir, "conversations"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpusloom.llm.runs import periodic_runs

    return periodic_runs(table(spark, sf_dir, "documents").select("doc_id", "text"), looped=True)


def op13_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Law `rows`: equal texts are dealt apart from each other, as a uniform shuffle asks."""
    from corpusloom.llm.sharding import shuffle_shards

    text = F.coalesce("text", F.lit(""))
    docs = table(spark, sf_dir, "documents").select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    got = shuffle_shards(docs, 16)
    return got.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


QUERIES = {f.__name__: f for f in (
    op1_url_filters, op2_best_fit_packing, op3_language_id, op4_document_fingerprints, op5_ngram_jaccard,
    op6_source_mixing, op7_exact_top_k, op8_lm_scores, op9_token_rollups, op10_toxicity,
    op11_prefix_trie, op12_periodic_runs, op13_sharding,
)}

ORACLES = {
    "op5_ngram_jaccard": r"""
with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') ws from documents),
g as materialized (select doc_id, unnest(case when len(ws) >= 3 then list_distinct(list_transform(range(1, len(ws) - 1), lambda i: array_to_string(ws[i:i+2], chr(10)))) when len(ws) > 0 then [array_to_string(ws, chr(10))] else [] end) s from w),
n as materialized (select doc_id, count(*) n from g group by 1),
p as (select x.doc_id a, y.doc_id b, count(*) k from g x join g y on x.s = y.s and x.doc_id < y.doc_id group by 1, 2),
l as materialized (select a, b from p join n x on x.doc_id = a join n y on y.doc_id = b where 100 * k >= 90 * (x.n + y.n - k)),
e as materialized (select a, b from l union all select b, a from l),
r as (select a, b from e union select r.a, e.b from r join e on r.b = e.a)
select d.doc_id, coalesce(n.n, 0) n_shingles, least(d.doc_id, coalesce(m.least_id, d.doc_id)) component_id
from documents d left join n using (doc_id) left join (select a, min(b) least_id from r group by 1) m on m.a = d.doc_id""",
    "op7_exact_top_k": """
with v as materialized (select vec_id, list_transform(embedding, lambda x: floor(256 * x::double)) e from embeddings where vec_id is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select q.vec_id query_id, c.vec_id, list_dot_product(q.e, c.e)::bigint score from v q join v c on c.vec_id <> q.vec_id and len(c.e) = len(q.e) where q.vec_id % 50 = 0),
r as (select *, row_number() over (partition by query_id order by score desc, vec_id)::int rank from s)
select query_id, rank, vec_id, score from r where rank <= 5""",
    "op9_token_rollups": r"""
with d as (select source, lang, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) words, len(regexp_extract_all(coalesce(text, ''), '[A-Za-z]+')) letters from documents),
k as (select source, lang, case when lang = 'de' then 'letters-1' else 'words-1' end tokenizer_version, case when lang = 'de' then letters else words end tokens from d where words >= 20)
select source, lang, tokenizer_version, count(*)::bigint docs, sum(tokens)::bigint tokens from k group by all""",
}
