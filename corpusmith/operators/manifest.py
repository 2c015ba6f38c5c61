"""Tables of files and their versions: differences, upserts, replacements, generations and retention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def difference(current: DataFrame, previous: DataFrame, keys: list[str], digest: str) -> DataFrame:
    """Keys with change: upsert where the digest is new or other, delete where the key is gone; equal rows don't come out.

    A null digest is a value like any other. Keys are matched by equality, so rows with a null key
    are new or gone. Of a key with several digests the greatest counts.
    """
    now = current.groupBy(*keys).agg(F.max(digest).alias("_now")).withColumn("_here", F.lit(True))
    was = previous.groupBy(*keys).agg(F.max(digest).alias("_was")).withColumn("_there", F.lit(True))
    both = now.join(was, keys, "full_outer")
    change = F.when(F.col("_here").isNull(), "delete").when(F.col("_there").isNull() | ~F.col("_now").eqNullSafe(F.col("_was")), "upsert")
    return both.select(*keys, change.alias("change")).where("change is not null")


def once(rows: DataFrame, keys: list[str]) -> DataFrame:
    """One row for each key: the one whose other columns, in the order of their names, are greatest; nulls are least."""
    rest = sorted(c for c in rows.columns if c not in keys)
    if not rest:
        return rows.distinct()
    best = rows.groupBy(*keys).agg(F.max(F.struct(*rest)).alias("_b"))
    return best.select(*(F.col(c) if c in keys else F.col(f"_b.{c}").alias(c) for c in rows.columns))


def upsert(table: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """The table with the rows of ``changes`` in place of those with the same keys; of changes with equal keys see :func:`once`."""
    return table.join(changes.select(*keys).distinct(), keys, "left_anti").unionByName(once(changes, keys))


def insert_absent(table: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """The table with those ``rows`` whose keys it lacks; of rows with equal keys see :func:`once`."""
    return table.unionByName(once(rows, keys).join(table.select(*keys), keys, "left_anti"))


def without(table: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    """The table without the rows whose keys are in ``gone``."""
    return table.join(gone.select(*keys).distinct(), keys, "left_anti")


def newest(rows: DataFrame, keys: list[str], order: list[Column], n: int = 1) -> DataFrame:
    """The first ``n`` rows of each key in the given order."""
    ranked = rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.where(F.col("_n") <= n).drop("_n")


def page(rows: DataFrame, keys: list[str], after: tuple | None, size: int) -> DataFrame:
    """The next ``size`` rows after the given keys, in their order; ``after`` None begins."""
    if after is not None:
        later, equal = F.lit(False), F.lit(True)
        for key, value in zip(keys, after, strict=True):
            later = later | (equal & (F.col(key) > F.lit(value)))
            equal = equal & (F.col(key) == F.lit(value))
        rows = rows.where(later)
    return rows.orderBy(*keys).limit(size)


def revision_number(revision: Column) -> Column:
    """The number of a revision that is digits or ends in ``:digits``; null for others, which can't be compared."""
    return F.try_to_number(F.nullif(F.regexp_extract(revision, r"^(?:.*:)?(\d{1,18})$", 1), F.lit("")), F.lit("9" * 18)).cast("long")


def may_promote(candidate: Column, active: Column) -> Column:
    """Whether a revision isn't older than the active one; unlike forms can't be promoted over each other."""
    new, old = revision_number(candidate), revision_number(active)
    return F.when(active.isNull(), True).when(new.isNull() | old.isNull(), candidate == active).otherwise(new >= old)


def prunable(snapshots: DataFrame, group: str, created: str, keep: int, before: Column, key: str) -> DataFrame:
    """Snapshots beyond the newest ``keep`` of their group that are also older than ``before``."""
    order = Window.partitionBy(group).orderBy(F.desc(created), F.desc(key))
    return snapshots.withColumn("_n", F.row_number().over(order)).where((F.col("_n") > keep) & (F.col(created) < before)).drop("_n")


def unreferenced(listed: DataFrame, referenced: DataFrame, preserved: DataFrame, key: str) -> DataFrame:
    """Listed artifacts that are neither referenced nor preserved."""
    return without(without(listed, referenced, [key]), preserved, [key])


def reindex_plan(files: DataFrame, index: DataFrame, keys: list[str], digest: str, version: int) -> DataFrame:
    """Keys with action index, keep or drop.

    A file is kept if its digest is the indexed one and was indexed by this ``version``
    (tokenizer_version); a file that is gone is dropped. Of a key with several digests the greatest counts.
    """
    now = files.groupBy(*keys).agg(F.max(digest).alias("_now"))
    was = once(index.select(*keys, F.col(digest).alias("_was"), "tokenizer_version"), keys).withColumn("_there", F.lit(True))
    same = F.col("_now").eqNullSafe(F.col("_was")) & (F.col("tokenizer_version") == version)
    both = now.withColumn("_here", F.lit(True)).join(was, keys, "full_outer")
    action = F.when(F.col("_here").isNull(), "drop").when(F.col("_there") & same, "keep").otherwise("index")
    return both.select(*keys, action.alias("action"))


def widest_overlap(spans: DataFrame, symbols: DataFrame, path: str = "path") -> DataFrame:
    """Spans (path, id, start_line, end_line) with the symbol that overlaps them: exported first, then the widest, then the first.

    Lines are cut into blocks of 64, on which spans and symbols meet by equality, so a file with
    many of both isn't multiplied out. A span without a symbol keeps a null name; a null end_line
    is start_line.
    """
    size = 64
    cut = lambda a, b: F.explode(F.sequence(F.floor(a / size), F.floor(F.greatest(a, b) / size))).alias("_b")
    ends = F.coalesce("end_line", "start_line")
    left = spans.select(path, "id", "start_line", ends.alias("end_line"), cut(F.col("start_line"), ends))
    right = symbols.select(path, F.col("name").alias("_name"), F.col("start_line").alias("_a"), F.coalesce("end_line", "start_line").alias("_z"), "exported", "ordinal", cut(F.col("start_line"), ends))
    met = left.join(right, [path, "_b"]).where((F.col("_a") <= F.col("end_line")) & (F.col("_z") >= F.col("start_line")))
    best = met.groupBy("id").agg(F.max_by("_name", F.struct(F.col("exported"), F.col("_z") - F.col("_a"), -F.col("ordinal"))).alias("name"))
    return spans.join(best, "id", "left")


def virtual_documents(sources: DataFrame, blobs: DataFrame, paths: DataFrame | None = None) -> DataFrame:
    """Sources (workspace_id, path, blob_hash) with the content of their blob (hash, content); those without blob don't come out.

    ``paths`` (workspace_id, path) keeps only these. Hashes are matched in lower case; a hash that
    occurs twice has one content, the greatest.
    """
    if paths is not None:
        sources = sources.join(paths.select("workspace_id", "path").distinct(), ["workspace_id", "path"], "left_semi")
    held = blobs.where("hash is not null and content is not null").groupBy(F.lower("hash").alias("_hash")).agg(F.max("content").alias("content"))
    return sources.drop("content").join(held, F.lower("blob_hash") == F.col("_hash")).drop("_hash")


def granted(grants: DataFrame, blobs: DataFrame, session: str = "session_id", digest: str = "blob_hash") -> DataFrame:
    """session, digest and stored: every blob that a session was granted, once, and whether it is there."""
    asked = grants.where(F.col(digest).isNotNull()).select(session, F.lower(digest).alias(digest)).distinct()
    known = blobs.where("hash is not null").select(F.lower("hash").alias(digest)).distinct().withColumn("_known", F.lit(True))
    return asked.join(known, digest, "left").select(session, digest, F.coalesce("_known", F.lit(False)).alias("stored"))


def in_order(ids: DataFrame, chunks: DataFrame, key: str = "id") -> DataFrame:
    """The chunks of ranked ids (query_id, rank, id) with their rank; unknown ids don't come out, copies of a chunk count once."""
    return ids.select("query_id", "rank", key).join(once(chunks, [key]), key).select("query_id", "rank", key, *(c for c in chunks.columns if c not in ("query_id", "rank", key)))


def after_cursor(log: DataFrame, event: str, cursor: int, most: int) -> DataFrame:
    """The next ``most`` events of a feed after a cursor, in order; the greatest of them is the next cursor."""
    return log.where(F.col(event) > cursor).orderBy(event).limit(most)
