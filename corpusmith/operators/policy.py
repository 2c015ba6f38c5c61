"""Who may see a path, and which paths a filter keeps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def normal_prefix(prefix: Column) -> Column:
    """A prefix without a leading ``./`` and trailing slashes."""
    return F.regexp_replace(F.regexp_replace(prefix, r"^(\./)+", ""), "/+$", "")


def under(path: Column, prefix: Column) -> Column:
    """Whether ``path`` is the prefix or lies below it; an empty prefix holds everything."""
    prefix = normal_prefix(prefix)
    return (prefix == "") | (path == prefix) | path.startswith(F.concat(prefix, F.lit("/")))


def allowed(files: DataFrame, rules: DataFrame, default: str = "allow", path: str = "path") -> DataFrame:
    """Files with ``effect``: of the rules (prefix, effect) that hold a path the longest decides, deny before allow.

    Every path is cut into its own prefixes, which are joined by equality, so no rule is compared
    with a path that it can't hold. Rules with null or unknown effect don't count.
    """
    clean = rules.select(normal_prefix(F.col("prefix")).alias("prefix"), F.lower("effect").alias("effect")).where("effect in ('allow', 'deny')")
    clean = clean.groupBy("prefix").agg(F.max_by("effect", F.col("effect") == "deny").alias("effect"))
    parts = F.split(path, "/")
    prefixes = F.concat(F.array(F.lit("")), F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/")))
    paths = files.select(path).distinct().select(path, F.explode(prefixes).alias("prefix"))
    decided = paths.join(clean, "prefix").groupBy(path).agg(F.max_by("effect", F.length("prefix")).alias("effect"))
    return files.join(decided, path, "left").withColumn("effect", F.coalesce("effect", F.lit(default)))


def watched(path: Column) -> Column:
    """Whether a change of a path concerns the index: not below node_modules, .git or an index folder, nor dist at the root."""
    parts = F.split(path, "/")
    return ~F.arrays_overlap(parts, F.array(F.lit("node_modules"), F.lit(".git"), F.lit(".index"))) & (parts[0] != "dist")


def permission_at_least(permission: Column, needed: str) -> Column:
    """Whether a permission is at least ``needed``, of reader, writer and owner; null and unknown ones aren't."""
    rank = {"reader": 1, "writer": 2, "owner": 3}
    ladder = F.lit(0)
    for name, n in rank.items():
        ladder = F.when(permission == name, n).otherwise(ladder)
    return F.coalesce(ladder, F.lit(0)) >= rank[needed]


def invalid_policies(rules: DataFrame, most: int = 256) -> DataFrame:
    """policy_id and problem of policies with more than ``most`` rules or a prefix that occurs twice."""
    own = rules.groupBy("policy_id").agg(F.count("*").alias("n"), F.count_distinct(normal_prefix(F.col("prefix"))).alias("d"))
    problem = F.when(F.col("n") > most, "too many rules").when(F.col("d") < F.col("n"), "prefix occurs twice")
    return own.select("policy_id", problem.alias("problem")).where("problem is not null")
