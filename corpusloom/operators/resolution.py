"""Names to definitions: calls by three ways, modules by siblings, imports by candidate paths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.operators.joins import cell_join
from corpusloom.sources.tables import stored


def local_modules(imported: DataFrame, current: str, name: str, modules: DataFrame) -> DataFrame:
    """imported with `resolved`: the module of that name if there is one, else its sibling beside the current module, else the name as it is.

    modules(module): all that are known. Names hold dots between their parts; a sibling shares all but the last one.
    """
    known = modules.select(F.col("module").alias("_m")).distinct()
    beside = F.concat(F.regexp_replace(current, "[^.]*$", ""), F.col(name))
    x = imported.join(known.withColumnRenamed("_m", "_whole"), F.col(name) == F.col("_whole"), "left").withColumn("_beside", beside)
    x = x.join(known.withColumnRenamed("_m", "_sibling"), F.col("_beside") == F.col("_sibling"), "left")
    return x.withColumn("resolved", F.coalesce("_whole", "_sibling", name)).drop("_whole", "_sibling", "_beside")


def resolved_calls(calls: DataFrame, definitions: DataFrame, imports: DataFrame, aliases: DataFrame) -> DataFrame:
    """(site, key, how): all definitions a call may mean, each once, with the first way that leads there: 0 own module, 1 imported name, 2 module alias.

    calls(site, module, base, name): base is null for a plain name, self or cls for an object's own, else the parts before the
    name. definitions(module, name, key) may hold several of one name, and all are kept. imports(module, name, from_module,
    from_name); aliases(module, base, to_module), where the base's further parts are parts of the module. Modules are
    taken as local_modules() finds them. The result has a row for each call and definition of a name, so it grows with the
    product of the two. Ways are made single before they meet the definitions, in cells; a key that is defined once is
    then met once by each call, and only pairs of keys with several definitions are grouped.
    """
    d = definitions.where("module is not null and name is not null").select(F.col("module").alias("_to"), F.col("name").alias("_name"), "key").distinct()
    d = stored(d.withColumn("_several", F.count("*").over(Window.partitionBy("key")) > 1), "definitions")
    plain = calls.where("base is null or base in ('self', 'cls')").select("site", F.col("module").alias("_to"), F.col("name").alias("_name"), F.lit(0).alias("how"))
    taken = local_modules(imports, "module", "from_module", definitions).select("module", "name", F.col("resolved").alias("_to"), F.col("from_name").alias("_name")).distinct().join(d, ["_to", "_name"], "left_semi")
    named = calls.where("base is null").join(taken, ["module", "name"]).select("site", "_to", "_name", F.lit(1).alias("how"))
    parts = F.split("base", "[.]")
    dotted = calls.where("base not in ('self', 'cls')").withColumns({"_first": parts[0], "_rest": F.array_join(F.slice(parts, F.lit(2), F.size(parts)), ".")})
    dotted = dotted.join(aliases.select("module", F.col("base").alias("_first"), "to_module").distinct(), ["module", "_first"])
    dotted = dotted.withColumn("_target", F.concat_ws(".", "to_module", F.when(F.col("_rest") != "", F.col("_rest"))))
    through = local_modules(dotted, "module", "_target", definitions).select("site", F.col("resolved").alias("_to"), F.col("name").alias("_name"), F.lit(2).alias("how"))
    ways = stored(plain.unionByName(named).unionByName(through).groupBy("site", "_to", "_name").agg(F.min("how").alias("how")), "ways")
    pairs = lambda of: cell_join(ways, d.where(of).drop("_several"), ["_to", "_name"]).select("site", "key", "how")
    return pairs("not _several").unionByName(pairs("_several").groupBy("site", "key").agg(F.min("how").alias("how")))


def first_existing(imports: DataFrame, ident: str, candidates: list[Column], files: DataFrame, file: str) -> DataFrame:
    """(ident, file, rank): the first of several candidate paths that is a file; rows without one are left out. Null candidates are passed over."""
    c = imports.select(ident, F.posexplode(F.array(*candidates)).alias("rank", "_path")).where("_path is not null")
    met = c.join(files.select(F.col(file).alias("_path")).distinct(), "_path")
    return met.groupBy(ident).agg(F.min_by("_path", "rank").alias(file), F.min("rank").alias("rank"))
