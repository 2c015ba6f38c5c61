"""The import graph: what an import's target may mean, and a step along it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F


def _named(path):
    """All targets that may name a path, in lower case: itself, what stands before one of its dots or slashes, and inner runs of its segments."""
    low = F.lower(path)
    parts = F.split(low, "/")
    n = F.size(parts)
    before = F.transform(F.filter(F.sequence(F.lit(2), F.greatest(F.length(low), F.lit(2))), lambda i: F.substring(low, i, F.lit(1)).isin(".", "/")), lambda i: F.substring(low, F.lit(1), i - 1))
    inner = F.flatten(F.transform(F.sequence(F.lit(2), n - 1), lambda i: F.transform(F.sequence(F.lit(1), n - i), lambda k: F.array_join(F.slice(parts, i, k), "/"))))
    return F.array_distinct(F.concat(F.array(low), before, F.when(n > 2, inner).otherwise(F.array().cast("array<string>"))))


def resolve_targets(files: DataFrame, targets: DataFrame) -> DataFrame:
    """Files with each ``target`` that names them: their path, what stands before a dot or slash in it, or inner segments of it; case doesn't count.

    Paths are cut into all that may name them, which meets the targets by equality.
    """
    wanted = targets.select("target", F.lower("target").alias("_t")).distinct()
    return files.select("*", F.explode(_named(F.col("path"))).alias("_t")).join(wanted, "_t").drop("_t")


def imports_of(chunks: DataFrame, most: int = 256) -> DataFrame:
    """(source_path, target) edges of chunks (path, language, content): at most ``most`` of a file, as it names them first."""
    from corpusmith.functions.code import imports

    named = chunks.select(F.col("path").alias("source_path"), F.posexplode(imports("path", "content")).alias("at", "target"))
    first = named.groupBy("source_path", "target").agg(F.min("at").alias("at"))
    order = Window.partitionBy("source_path").orderBy("at", "target")
    return first.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= most).select("source_path", "target")


#: Targets of a query's seeds that are followed.
TARGETS = 32


def expand(seeds: DataFrame, chunks: DataFrame, symbols: DataFrame, edges: DataFrame, limit: int) -> DataFrame:
    """query_id, id, stage and place of chunks one step from the seeds: by symbol (0), by what the seeds import (1), by what imports them (2).

    ``seeds`` has query_id, id, path and names (array); ``chunks`` id, path and start_line;
    ``symbols`` name and id; ``edges`` source_path and target. By symbol, the ``limit`` chunks that
    begin first count; by import, the first chunks of the ``limit`` first paths; the other way, the
    first 2 * ``limit`` chunks of importing paths. Seeds are left out afterwards; a chunk found in
    several ways counts for the first, and ``limit`` chunks of each query come out.
    """
    within = lambda df, n, *order: df.withColumn("pos", F.row_number().over(Window.partitionBy("query_id").orderBy(*order))).where(F.col("pos") <= n)
    places = chunks.groupBy("id").agg(F.min("path").alias("path"), F.min("start_line").alias("start_line"))
    asked = seeds.select("query_id", F.explode("names").alias("name")).select("query_id", F.lower("name").alias("name")).distinct()
    met = symbols.select(F.lower("name").alias("name"), "id").join(asked, "name").select("query_id", "id").distinct().join(places, "id")
    by_symbol = within(met, limit, "start_line", "id").select("query_id", "id", F.lit(0).alias("stage"), "pos")
    own = seeds.select("query_id", F.col("path").alias("source_path")).distinct()
    targets = within(own.join(edges, "source_path").select("query_id", "target").distinct(), TARGETS, "target").select("query_id", "target")
    heads = chunks.groupBy("path").agg(F.min_by("id", F.struct("start_line", "id")).alias("id"))
    reached = resolve_targets(heads, targets).join(targets, "target").select("query_id", "path", "id").distinct()
    forward = within(reached, limit, "path").select("query_id", "id", F.lit(1).alias("stage"), "pos")
    names = F.explode(F.array_distinct(F.array("source_path", F.regexp_replace("source_path", r"\.[^.]+$", "")))).alias("target")
    importing = own.select("query_id", names).join(edges, "target").select("query_id", F.col("source_path").alias("path")).distinct()
    importing = within(importing, max(4 * limit, 16), "path").select("query_id", "path")
    reverse = within(importing.join(places, "path"), 2 * limit, "path", "start_line", "id").select("query_id", "id", F.lit(2).alias("stage"), "pos")
    found = by_symbol.unionByName(forward).unionByName(reverse).join(seeds.select("query_id", "id"), ["query_id", "id"], "left_anti")
    first = found.groupBy("query_id", "id").agg(F.min(F.struct("stage", "pos")).alias("f")).select("query_id", "id", "f.stage", "f.pos")
    return within(first, limit, "stage", "pos", "id").select("query_id", "id", "stage", F.col("pos").alias("place"))
