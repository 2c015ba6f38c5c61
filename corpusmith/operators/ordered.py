"""Ranks, percentiles and running values of large groups, computed piece by piece so that no group meets in one task."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from corpusmith.session import materialize


def _pieces(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The rows cut into ranges of keys and order, with the number of their range in ``_p``; written once, so that it never changes."""
    count = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return materialize(df.repartitionByRange(count, *keys, *order).withColumn("_p", F.spark_partition_id()), "ranges")


def _same(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Left join on keys that are equal or both null."""
    other = right.select(*(F.col(k).alias(f"_r_{k}") for k in keys), *(c for c in right.columns if c not in keys))
    met = reduce(lambda a, b: a & b, (left[k].eqNullSafe(F.col(f"_r_{k}")) for k in keys))
    return left.join(other, met, "left").drop(*(f"_r_{k}" for k in keys))


def ranked(df: DataFrame, keys: list[str], order: list[Column], name: str = "rank") -> DataFrame:
    """Adds the place of each row (from 1) among those of its keys; the order must be total for a fixed result.

    Rows are ranked within ranges of the order, and each range begins where the ones before end.
    """
    cut = _pieces(df, keys, order)
    sizes = cut.groupBy("_p", *keys).agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(*keys).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.select("_p", *keys, F.coalesce(before, F.lit(0)).alias("_before"))
    local = cut.withColumn(name, F.row_number().over(Window.partitionBy("_p", *keys).orderBy(*order)).cast("long"))
    return _same(local, starts, ["_p", *keys]).withColumn(name, F.col(name) + F.col("_before")).drop("_p", "_before")


def nearest_rank(df: DataFrame, keys: list[str], value: str, share: float, name: str) -> DataFrame:
    """keys and the value at place ceil(n * share) of each key's ordered values; nulls don't count, keys without values don't come out.

    Equal values are counted first; counts are summed along ranges of the values.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("_c"))
    cut = _pieces(counts, keys, [F.col(value)])
    sums = cut.groupBy("_p", *keys).agg(F.sum("_c").alias("_n"))
    own = Window.partitionBy(*keys)
    before = F.sum("_n").over(own.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1))
    starts = sums.select("_p", *keys, F.coalesce(before, F.lit(0)).alias("_before"), F.sum("_n").over(own).alias("_all"))
    local = cut.withColumn("_to", F.sum("_c").over(Window.partitionBy("_p", *keys).orderBy(value).rowsBetween(Window.unboundedPreceding, 0)))
    placed = _same(local, starts, ["_p", *keys]).withColumn("_to", F.col("_to") + F.col("_before"))
    wanted = F.greatest(F.ceil(F.round(F.col("_all") * share, 9)), F.lit(1))
    return placed.where((F.col("_to") >= wanted) & (F.col("_to") - F.col("_c") < wanted)).select(*keys, F.col(value).alias(name))


def carried(df: DataFrame, keys: list[str], order: str, block: Column, value: str, name: str) -> DataFrame:
    """Adds the last value that isn't null at or before each row of its keys; ``block`` must rise with the order and cuts keys into bounded parts."""
    placed = df.withColumn("_b", block)
    near = placed.withColumn(name, F.last(value, ignorenulls=True).over(Window.partitionBy(*keys, "_b").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)))
    ends = placed.groupBy(*keys, "_b").agg(F.max_by(value, F.when(F.col(value).isNotNull(), F.col(order))).alias("_last"))
    before = F.last("_last", ignorenulls=True).over(Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1))
    return _same(near, ends.select(*keys, "_b", before.alias("_before")), [*keys, "_b"]).withColumn(name, F.coalesce(name, "_before")).drop("_b", "_before")
