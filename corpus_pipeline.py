"""Documents to packed training sequences: toxicity, language, near duplicates, mixing, packing.

Each stage takes (spark, docs, sf_dir); its result is written as Parquet and read again as the
next one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.common import discard, small, stored, table

#: Words of a shingle and least Jaccard index of near duplicates.
SHINGLE, SIMILAR = 5, 0.8
#: Texts less like any language learnt than this go, and those less than half as like as is usual for texts of their size.
LEAST_LIKE, USUAL_SHARE = 0.05, 0.5
#: Rows of one or two numbers that are sent to every task rather than the texts being shuffled.
SMALL = 200_000


def _free(docs: DataFrame, name: str) -> str:
    """A column name that docs doesn't have."""
    while name in docs.columns:
        name += "_"
    return name


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model, fitted on all labelled ones among them, scores below 0.5."""
    from corpusloom.llm.toxicity import fit_whole, toxicity_scores

    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic").where("toxic in (0, 1)")
    # Joined once: the fit goes over its rows three times.
    labelled = stored(docs.select("doc_id", "text").where("text is not null").join(small(labels, SMALL), "doc_id"), "labelled")
    model = fit_whole(labelled)
    discard(labelled)
    score = _free(docs, "_toxicity")
    return toxicity_scores(docs, model, score).where(F.col(score) < 0.5).select(*docs.columns)


def keep_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the labels teach: some letter, and a cosine of LEAST_LIKE or more, and of USUAL_SHARE of what
    all but a hundredth of the labelled texts of their size have. Prototypes and floors are made of all labelled texts. Without labels, all with a letter."""
    from corpusloom.llm.langid import identify, prototypes, size_class, usual_cosines

    model = prototypes(docs, None)
    lang, like, size = (_free(docs, x) for x in ("_lang", "_like", "_size"))
    known = stored(identify(docs.withColumn(size, size_class("text")), model, (lang, like)), "known")
    labelled = known.where(F.col("lang").isNotNull() & (F.col(lang) != "und"))
    usual = usual_cosines(labelled.select(F.col(size).alias("size"), F.col(like).alias("score")))
    floors = {n: max(LEAST_LIKE, USUAL_SHARE * least) for n, least in usual.items()}
    floor = F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in floors.items() for x in kv)), F.col(size)), F.lit(LEAST_LIKE)) if floors else F.lit(LEAST_LIKE)
    return known.where(F.lit(not model[0]) | ((F.col(lang) != "und") & (F.col(like) >= floor))).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest doc_id, of each group linked by similar shingle sets.

    Rows that share a doc_id count as one document; the one whose columns have the smallest hash stays. Rows without a doc_id stay.
    """
    from corpusloom.llm.ngram_join import jaccard_components

    groups = stored(jaccard_components(docs, SHINGLE, SIMILAR), "groups")
    again = stored(groups.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id"), "again")
    gone = stored(groups.where("component_id <> doc_id").select("doc_id").distinct().unionByName(again), "gone")
    heads = stored(again.join(groups.where("component_id <> doc_id").select("doc_id"), "doc_id", "left_anti"), "heads")
    once = docs.join(small(heads, SMALL), "doc_id", "left_semi")
    # Other rows of a hot doc_id go before the shuffle.
    once = once.groupBy("doc_id").agg(F.min_by(F.struct(*docs.columns), F.xxhash64(*docs.columns)).alias("_row")).select("_row.*")
    return docs.join(small(gone, SMALL), "doc_id", "left_anti").select(*docs.columns).unionByName(once.select(*docs.columns))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, in whole copies: words taken by words, whole times, and once more by a draw of a hash whose chance is the rest.

    So a source's words come near its target also where the mix takes a part of each document.

    Rows that share a doc_id, or have none, are counted as one document.
    """
    from corpusloom.llm.mixing import mix

    mixed = mix(docs.select("doc_id", "text", "source")).where("taken > 0")
    ident, times = _free(docs, "_id"), _free(docs, "_copies")
    drawn = F.pmod(F.xxhash64(F.col("doc_id"), F.lit("copies")), F.lit(1 << 30)) / float(1 << 30)
    copies = mixed.groupBy("doc_id").agg((F.sum("taken") / F.sum("size")).alias(times))
    copies = copies.select(F.col("doc_id").alias(ident), F.floor(F.col(times) + drawn).cast("int").alias(times)).where(F.col(times) > 0)
    joined = docs.join(copies, docs["doc_id"].eqNullSafe(copies[ident]))
    return joined.select(*docs.columns, F.explode(F.sequence(F.lit(1), F.col(times))).alias(ident)).select(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixed documents' pieces and their places in sequences of 1024 tokens."""
    import public_tokenizers

    from corpusloom.llm.packing import best_fit

    return best_fit(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("language", keep_languages),
    ("near copies", drop_near_copies),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: Neither the models nor the tokenizer can be put in SQL; tests/llm/test_pipeline.py checks the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply STAGES to documents."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(docs, f"stage-{k}")
    return docs
