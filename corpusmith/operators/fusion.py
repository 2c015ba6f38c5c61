"""Bringing ranked lists together: reciprocal ranks, normalization, bonuses and rounds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from corpusmith.functions import rules
from corpusmith.operators.ordered import ranked


def reciprocal_ranks(lists: DataFrame, key: str, k: int = rules.RRF_K) -> DataFrame:
    """query_id, ``key`` and rrf, the sum of 1 / (k + rank) over all lists; ranks begin at 1. Null ranks don't count."""
    return lists.where("rank is not null").groupBy("query_id", key).agg(F.sum(1 / (k + F.col("rank"))).alias("rrf"))


def max_normalized(value: str, by: str = "query_id") -> Column:
    """A value's share of the greatest of its query; 0 where none is above 0."""
    most = F.max(value).over(Window.partitionBy(by))
    return F.when(most > 0, F.col(value) / most).otherwise(0.0)


def min_max_normalized(value: str, by: str = "query_id") -> Column:
    """A value's place between the least and the greatest of its query; null where all are equal."""
    own = Window.partitionBy(by)
    least, most = F.min(value).over(own), F.max(value).over(own)
    return F.when(most > least, (F.col(value) - least) / (most - least))


def blend_scores(rows: DataFrame, weight: float, final: str = "final", neural: str = "neural") -> DataFrame:
    """Rows with ``final`` moved towards the normalized ``neural`` score by ``weight``; equal scores and nulls leave it."""
    own = min_max_normalized(neural)
    return rows.withColumn("_n", own).withColumn(final, F.when(F.col("_n").isNull(), F.col(final)).otherwise((1 - weight) * F.col(final) + weight * F.col("_n"))).drop("_n")


def combined(rank: Column, features: Column, meaning: Column, intent: Column) -> Column:
    """The final score as an expression: weights by intent, features through tanh, and a bonus where both agree."""
    meaning = F.coalesce(meaning, F.lit(0.0))

    def part(i: int) -> Column:
        chosen = F.when(meaning <= 0, F.lit(rules.WEIGHTS["none"][i]))
        for name, weights in rules.WEIGHTS.items():
            if name != "none":
                chosen = chosen.when(intent == name, F.lit(weights[i]))
        return chosen.otherwise(F.lit(0.0))

    agree = F.when((meaning >= 0.85) & (features >= 0.8), 0.06).otherwise(0.0)
    return part(0) * rank + part(1) * F.tanh(features / 2.2) + part(2) * meaning + agree


def hint_bonus(scores: DataFrame, by: list[str], score: str = "score", share: float = 0.1, most: float = 0.8) -> DataFrame:
    """The best score of each group and ``share`` of the others', at most ``most``."""
    rest = F.sum(score) - F.max(score)
    return scores.groupBy(*by).agg((F.max(score) + F.least(F.lit(most), share * rest)).alias(score))


def normalized(rows: DataFrame, value: str, by: str = "query_id") -> DataFrame:
    """Adds share and place of a value as :func:`max_normalized` and :func:`min_max_normalized` give them, for groups of any size."""
    ends = rows.groupBy(F.col(by).alias("_by")).agg(F.min(value).alias("_least"), F.max(value).alias("_most"))
    both = rows.join(ends, F.col(by).eqNullSafe(F.col("_by")))
    share = F.when(F.col("_most") > 0, F.col(value) / F.col("_most")).otherwise(0.0)
    place = F.when(F.col("_most") > F.col("_least"), (F.col(value) - F.col("_least")) / (F.col("_most") - F.col("_least")))
    return both.withColumn("share", share).withColumn("place", place).drop("_by", "_least", "_most")


def rounds(rows: DataFrame, group: str, score: str, key: str, by: str = "query_id") -> DataFrame:
    """Rows with round and place: first the best of every group, then the second best, and so on.

    Groups come in the order of their best score; equal scores go to the smaller key. Both places
    are counted along ranges of the order, whatever the size of a group or query.
    """
    best = rows.groupBy(F.col(by).alias("_by"), F.col(group).alias("_group")).agg(F.max(score).alias("_best"))
    within = ranked(rows, [by, group], [F.desc(score), F.col(key)], "round")
    placed = within.join(best, F.col(by).eqNullSafe(F.col("_by")) & F.col(group).eqNullSafe(F.col("_group"))).drop("_by", "_group")
    return ranked(placed, [by], [F.col("round"), F.desc("_best"), F.desc(score), F.col(key)], "place").drop("_best")


def append_discoveries(primary: DataFrame, others: DataFrame, key: str, limit: int) -> DataFrame:
    """The primary ranking as it is, followed by what only subqueries found.

    ``primary`` has query_id, ``key``, score; ``others`` query_id, sub, ``key`` and rank. At most a
    fifth of ``limit`` (one at least) is added by reciprocal ranks, below the primary's lowest score.
    """
    budget = max(1, -(-limit // 5))
    new = others.join(primary.select("query_id", key), ["query_id", key], "left_anti")
    found = reciprocal_ranks(new, key)
    order = Window.partitionBy("query_id").orderBy(F.desc(F.round("rrf", 12)), key)
    added = found.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= budget)
    floor = primary.groupBy("query_id").agg(F.min("score").alias("_floor"))
    added = added.join(floor, "query_id", "left").select("query_id", key, (F.coalesce("_floor", F.lit(0.0)) - F.col("_n") * 1e-6).alias("score"), F.lit(True).alias("discovered"))
    return primary.select("query_id", key, "score", F.lit(False).alias("discovered")).unionByName(added)
