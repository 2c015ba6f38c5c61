"""Quality of rankings against expected paths, comparisons of variants, and gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F


def ranking_metrics(results: DataFrame, gold: DataFrame, strict: bool = False) -> DataFrame:
    """Per case: recall, mrr, ndcg, top1, top3 and top5.

    ``results`` has case_id, rank (from 1) and path; ``gold`` case_id, expected (array) and top_k.
    A result answers an expected path if it contains it or, if ``strict``, equals it; strict
    rankings count each path once, at its best place. Each result gains at most once in ndcg, which
    is at most 1. Cases without results have 0; a case without expected paths has recall 1.
    """
    wanted = gold.select("case_id", F.array_distinct("expected").alias("expected"), "top_k")
    rows = results
    if strict:
        rows = rows.groupBy("case_id", "path").agg(F.min("rank").alias("rank"))
        rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy("case_id").orderBy("rank", "path")))
    met = (lambda p: F.col("path") == p) if strict else (lambda p: F.contains(F.col("path"), p))
    hits = rows.join(wanted, "case_id").where(F.col("rank") <= F.col("top_k")).withColumn("met", F.filter("expected", met))
    gain = F.when(F.size("met") > 0, 1 / F.log2(F.col("rank") + 1)).otherwise(0.0)
    best = hits.groupBy("case_id").agg(
        F.size(F.array_distinct(F.flatten(F.collect_list("met")))).alias("found"), F.min(F.when(F.size("met") > 0, F.col("rank"))).alias("first"), F.sum(gain).alias("dcg")
    )
    joined = wanted.join(best, "case_id", "left")
    n = F.size("expected")
    ideal = F.aggregate(F.when(n > 0, F.sequence(F.lit(1), F.least(n, F.col("top_k")))).otherwise(F.array().cast("array<int>")), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1.0))
    top = lambda k: F.coalesce((F.col("first") <= k).cast("int"), F.lit(0))
    return joined.select(
        "case_id", F.round(F.when(n == 0, 1.0).otherwise(F.coalesce("found", F.lit(0)) / n), 6).alias("recall"), F.round(F.coalesce(1 / F.col("first"), F.lit(0.0)), 6).alias("mrr"),
        F.round(F.when(ideal > 0, F.least(F.lit(1.0), F.coalesce("dcg", F.lit(0.0)) / ideal)).otherwise(0.0), 6).alias("ndcg"), top(1).alias("top1"), top(3).alias("top3"), top(5).alias("top5"),
    )


def hard_negatives(results: DataFrame, gold: DataFrame) -> DataFrame:
    """Per case: whether the first path, and whether any of the first top_k different paths, is one of its negatives.

    ``results`` has case_id, rank and path; ``gold`` case_id, negatives (array) and top_k. Cases
    without results or negatives have neither.
    """
    once = results.groupBy("case_id", "path").agg(F.min("rank").alias("rank"))
    placed = once.withColumn("rank", F.row_number().over(Window.partitionBy("case_id").orderBy("rank", "path")))
    met = placed.join(gold.select("case_id", "negatives", "top_k"), "case_id").where((F.col("rank") <= F.col("top_k")) & F.array_contains("negatives", F.col("path")))
    first = met.groupBy("case_id").agg(F.min("rank").alias("_first"))
    return gold.select("case_id").distinct().join(first, "case_id", "left").select("case_id", F.coalesce(F.col("_first") == 1, F.lit(False)).alias("negative_top1"), F.col("_first").isNotNull().alias("negative_at_k"))


def variant_means(runs: DataFrame, values: list[str]) -> DataFrame:
    """Per variant: runs, how many passed, failed, timed out or had errors, the share that passed, and means that leave nulls out."""
    of = lambda s: F.count_if(F.col("status") == s)
    return runs.groupBy("variant").agg(
        F.count("*").alias("runs"), F.count_distinct("repetition").alias("repetitions"), of("passed").alias("passed"), of("failed").alias("failed"), of("timeout").alias("timeouts"), of("error").alias("errors"),
        F.round(of("passed") / F.count("*"), 6).alias("pass_rate"), *(F.round(F.avg(v), 6).alias(f"mean_{v}") for v in values),
    )


def delta_gate(deltas: dict[str, Column], worst: float = -0.01, gain: float = 0.005, ungained: tuple[str, ...] = ("top5",)) -> Column:
    """``candidate-for-default`` if no measure falls by more than allowed and one of those that count rises enough, else ``keep-opt-in``."""
    steady, better = F.lit(True), F.lit(False)
    for name, delta in deltas.items():
        steady = steady & (delta >= worst)
        better = better | (delta > gain) if name not in ungained else better
    return F.when(steady & better, "candidate-for-default").otherwise("keep-opt-in")


_CASE = "array<struct<id:string,query:string,expectPaths:array<string>,expectSymbols:array<string>,topK:int>>"


def cases_of(documents: DataFrame, column: str = "value", top_k: int = 8) -> DataFrame:
    """case_id, query, expected, symbols and top_k of case files, each a JSON array in one row of a column.

    Cases without id or query are left out; missing lists are empty and a missing top_k is the default.
    """
    none = F.array().cast("array<string>")
    rows = documents.select(F.explode(F.from_json(column, _CASE)).alias("c")).where("c.id is not null and c.query is not null")
    return rows.select(F.col("c.id").alias("case_id"), F.col("c.query").alias("query"), F.coalesce("c.expectPaths", none).alias("expected"), F.coalesce("c.expectSymbols", none).alias("symbols"), F.coalesce("c.topK", F.lit(top_k)).alias("top_k"))


def read_cases(spark: SparkSession, location: str, top_k: int = 8) -> DataFrame:
    """The cases of JSON files below a location."""
    return cases_of(spark.read.option("wholetext", True).text(location), "value", top_k)


def macro_average(metrics: DataFrame, by: str, values: list[str]) -> DataFrame:
    """The mean over groups of each group's mean, as one row."""
    return metrics.groupBy(by).agg(*(F.avg(v).alias(v) for v in values)).agg(*(F.round(F.avg(v), 6).alias(v) for v in values))


def paired_deltas(runs: DataFrame, base: str, other: str, value: str) -> DataFrame:
    """Runs (case_id, repetition, variant, status, value) of two variants side by side, with delta and outcome.

    The outcome is improved, regressed or unchanged, or excluded where a side is missing or failed.
    """
    pick = lambda v, name: runs.where(F.col("variant") == v).select("case_id", "repetition", F.when(F.col("status") == "ok", F.col(value)).alias(name))
    both = pick(base, "before").join(pick(other, "after"), ["case_id", "repetition"], "full_outer")
    delta = F.col("after") - F.col("before")
    return both.withColumn("delta", delta).withColumn("outcome", F.when(delta.isNull(), "excluded").when(delta > 0, "improved").when(delta < 0, "regressed").otherwise("unchanged"))


def gate(value: Column, least: float | None = None, most: float | None = None) -> Column:
    """Whether a value keeps its bounds; null and NaN fail."""
    ok = value.isNotNull() & ~F.isnan(value)
    ok = ok & (value >= least) if least is not None else ok
    return F.coalesce(ok & (value <= most) if most is not None else ok, F.lit(False))


def path_coverage(paths: Column, wanted: Column) -> Column:
    """The share of wanted paths that a list of paths has: equal, as an end behind a slash, or containing it."""
    hit = lambda w: F.exists(paths, lambda p: (p == w) | p.endswith(F.concat(F.lit("/"), w)) | F.contains(p, w))
    return F.when(F.size(wanted) > 0, F.size(F.filter(wanted, hit)) / F.size(wanted)).otherwise(1.0)


def invalid_gold(gold: DataFrame, files: DataFrame) -> DataFrame:
    """case_id and problem of cases (case_id, expected, negatives) that are doubled, name bad or absent paths, or contradict themselves."""
    bad = lambda p: p.startswith("/") | F.contains(p, F.lit("..")) | F.contains(p, F.lit("\\")) | (p == "")
    doubled = gold.groupBy("case_id").count().where("count > 1").select("case_id", F.lit("doubled case").alias("problem"))
    form = gold.where(F.exists("expected", bad)).select("case_id", F.lit("path isn't canonical").alias("problem"))
    clash = gold.where(F.arrays_overlap("expected", F.coalesce("negatives", F.array().cast("array<string>")))).select("case_id", F.lit("expected and negative").alias("problem"))
    named = gold.select("case_id", F.explode("expected").alias("path"))
    absent = named.join(files.select("path").distinct(), "path", "left_anti").select("case_id", F.lit("path is absent").alias("problem"))
    return doubled.unionByName(form).unionByName(clash).unionByName(absent).distinct()


def patch_statistics(numstat: DataFrame, patch: str, line: str) -> DataFrame:
    """Per patch: files, added and deleted lines of ``git diff --numstat`` output; counts that aren't numbers are 0."""
    parts = F.split(line, "\t")
    number = lambda i: F.coalesce(F.expr(f"try_cast(split({line}, '\\t')[{i}] as bigint)"), F.lit(0))
    own = numstat.where(F.size(parts) >= 3)
    return own.groupBy(patch).agg(F.count_distinct(parts[2]).alias("files"), F.sum(number(0)).alias("added"), F.sum(number(1)).alias("deleted"))
