"""Rebuilding a table from a change feed of upserts, deletes and renames.

A rename couples two keys: it may carry over what its old key held. Instead of folding the feed
in order, every change becomes events on single keys, each key's last event wins by a window
rank, and the values carried over by renames are found by following links between events. The
links are halved in each round (pointer jumping), so a chain of n renames takes log2(n) joins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from corpusmith.session import materialize, release

#: Changes of a session are looked up in blocks of this many sequence numbers, so that the
#: events of one hot key never have to meet in one task.
LOOKUP_BLOCK = 4096


def normal_path(path: Column) -> Column:
    """``path`` with ``/`` only and without empty or ``.`` segments; null stays null."""
    parts = F.split(F.translate(path, "\\", "/"), "/", -1)
    return F.array_join(F.filter(parts, lambda s: (s != "") & (s != ".")), "/")


def clean_changes(changes: DataFrame, *kept: str) -> DataFrame:
    """One row per (session_id, sequence), in normal spelling, with the columns ``kept`` that depend on the session.

    op is trimmed and in lower case, blob_hash in lower case (empty counts as null), paths are
    normal. Of repeated deliveries the last received counts; ties go to the spelling that sorts
    last, so the choice never depends on the order of rows. Rows with another op, or without
    session, sequence or path, aren't changes and are left out.
    """
    blank = lambda c: F.when(F.length(c) > 0, c)
    rows = changes.select(
        "session_id",
        F.col("sequence").cast("long").alias("sequence"),
        F.lower(F.regexp_replace("op", r"^\s+|\s+$", "")).alias("op"),
        blank(normal_path(F.col("path"))).alias("path"),
        blank(normal_path(F.col("old_path"))).alias("old_path"),
        blank(F.lower(F.trim("blob_hash"))).alias("blob_hash"),
        "received_at", *kept,
    ).where("session_id is not null and sequence is not null and path is not null and op in ('upsert', 'delete', 'rename')")
    latest = Window.partitionBy("session_id", "sequence").orderBy(
        *(F.col(c).desc_nulls_last() for c in ("received_at", "op", "path", "old_path", "blob_hash"))
    )
    return rows.withColumn("_n", F.row_number().over(latest)).where("_n = 1").drop("_n", "received_at")


def _lookups(events: DataFrame, refs: DataFrame) -> DataFrame:
    """For each of ``refs``, the last event on the key it refers to before it.

    Within a block by a window; where the block has none, by the last event of the key's earlier
    blocks. Both groups are bounded by the number of a key's blocks and the block's size.
    """
    block = F.floor(F.col("sequence") / LOOKUP_BLOCK).alias("block")
    place = ["workspace_id", "key", "turn", "block"]
    wanted = refs.select("workspace_id", F.col("ref").alias("key")).distinct()
    found = F.struct("kind", "blob_hash", "turn", "sequence").alias("held")
    sets = events.join(wanted, ["workspace_id", "key"], "left_semi").select("workspace_id", "key", "turn", block, "sequence", "phase", found)
    sets = materialize(sets, "sets").withColumn("asks", F.lit(False))
    asks = refs.select(
        "workspace_id", F.col("ref").alias("key"), "turn", block, "sequence", F.lit(-1).alias("phase"),
        F.lit(None).cast(sets.schema["held"].dataType).alias("held"), F.lit(True).alias("asks"),
    )
    before = Window.partitionBy(*place).orderBy("sequence", "phase").rowsBetween(Window.unboundedPreceding, -1)
    near = sets.unionByName(asks).withColumn("near", F.last("held", ignorenulls=True).over(before)).where("asks").select(*place, "sequence", "near")
    last = sets.groupBy(*place).agg(F.max(F.struct("sequence", "phase", "held"))["held"].alias("held"))
    blocks = last.unionByName(near.where("near is null").select(*place).distinct(), allowMissingColumns=True)
    blocks = blocks.groupBy(*place).agg(F.max("held").alias("held"))
    earlier = Window.partitionBy("workspace_id", "key").orderBy("turn", "block").rowsBetween(Window.unboundedPreceding, -1)
    far = blocks.select(*place, F.last("held", ignorenulls=True).over(earlier).alias("held"))
    missing = near.where("near is null").join(far, place, "left").select("turn", "sequence", "held")
    return near.where("near is not null").select("turn", "sequence", F.col("near").alias("held")).unionByName(missing)


def _carried(events: DataFrame, refs: DataFrame) -> DataFrame:
    """turn, sequence and blob_hash of what each referring event carries over; null where nothing was held."""
    by = lambda kind: F.col("held.kind") == kind
    links = materialize(
        _lookups(events, refs).select(
            "turn", "sequence", F.when(by("set"), F.col("held.blob_hash")).alias("blob_hash"),
            F.when(by("ref"), F.col("held.turn")).alias("turn_"), F.when(by("ref"), F.col("held.sequence")).alias("sequence_"),
        ),
        "links",
    )
    while links.where("turn_ is not null").limit(1).count():
        ahead = links.select(F.col("turn").alias("turn_"), F.col("sequence").alias("sequence_"), F.col("blob_hash").alias("_blob"), F.col("turn_").alias("_turn"), F.col("sequence_").alias("_sequence"))
        done = links.where("turn_ is null")
        jumped = links.where("turn_ is not null").join(ahead, ["turn_", "sequence_"], "left").select(
            "turn", "sequence", F.col("_blob").alias("blob_hash"), F.col("_turn").alias("turn_"), F.col("_sequence").alias("sequence_")
        )
        before, links = links, materialize(done.unionByName(jumped), "links")
        release(before)
    return links.select("turn", "sequence", F.col("blob_hash").alias("carried"))


def apply_change_feed(base: DataFrame, changes: DataFrame, sessions: DataFrame) -> DataFrame:
    """The state (workspace_id, path, blob_hash) after the committed sessions' changes.

    ``base`` has workspace_id, path, blob_hash; ``changes`` session_id, sequence, op, path,
    old_path, blob_hash, received_at; ``sessions`` id, workspace_id, base_revision, status. More
    columns are ignored. Committed sessions apply by rising base_revision (equal ones by id), a
    session's changes by rising sequence. An upsert sets path to its blob_hash (null included), a
    delete removes path, a rename removes old_path and sets path to its blob_hash or else to what
    old_path held; if that was nothing, path holds nothing afterwards. Changes of unknown sessions
    and base rows without path or workspace are left out; of base rows with the same path the
    largest blob_hash counts. Empty tables give an empty state or the base.
    """
    committed = (
        sessions.where("lower(trim(status)) = 'committed'")
        .groupBy(F.col("id").alias("session_id"))
        .agg(F.max("workspace_id").alias("workspace_id"), F.max("base_revision").alias("revision"))
        .where("session_id is not null and workspace_id is not null")
    )
    # numbers that rise over a total order, whatever the partitions: turns of sessions
    turns = committed.orderBy(F.col("revision").asc_nulls_first(), "session_id").select("session_id", "workspace_id", (F.monotonically_increasing_id() + 1).alias("turn"))
    turns = materialize(turns, "turns")
    kept = changes.drop("workspace_id", "turn").join(turns, "session_id")  # others' changes aren't shuffled
    ordered = clean_changes(kept, "workspace_id", "turn")
    null = F.lit(None).cast("string")
    event = lambda key, phase, kind, blob, ref: F.struct(
        key.alias("key"), F.lit(phase).alias("phase"), kind.alias("kind"), blob.alias("blob_hash"), ref.alias("ref")
    )
    path, old, blob = F.col("path"), F.col("old_path"), F.col("blob_hash")
    carries = blob.isNull() & old.isNotNull()
    as_events = (
        F.when(F.col("op") == "upsert", F.array(event(path, 1, F.lit("set"), blob, null)))
        .when(F.col("op") == "delete", F.array(event(path, 1, F.lit("gone"), null, null)))
        .otherwise(
            F.filter(
                F.array(
                    event(old, 0, F.lit("gone"), null, null),
                    event(path, 1, F.when(carries, "ref").when(blob.isNull(), "gone").otherwise("set"), blob, F.when(carries, old)),
                ),
                lambda e: e["key"].isNotNull(),
            )
        )
    )
    moved = materialize(ordered.select("workspace_id", "turn", "sequence", F.inline(as_events)), "events")
    start = base.select(
        "workspace_id", F.lit(0).cast("long").alias("turn"), F.lit(0).cast("long").alias("sequence"), normal_path(F.col("path")).alias("key"),
        F.lit(0).alias("phase"), F.lit("set").alias("kind"), F.lower(F.trim("blob_hash")).alias("blob_hash"),
    ).where("workspace_id is not null and key != ''")
    events = start.unionByName(moved.drop("ref"))
    newest = Window.partitionBy("workspace_id", "key").orderBy(F.desc("turn"), F.desc("sequence"), F.desc("phase"), F.col("blob_hash").desc_nulls_last())
    final = events.withColumn("_n", F.row_number().over(newest)).where("_n = 1 and kind != 'gone'").select("workspace_id", F.col("key").alias("path"), "kind", "turn", "sequence", "blob_hash")
    final = materialize(final, "final")
    refs = moved.where("kind = 'ref'").select("workspace_id", "ref", "turn", "sequence")
    carried = _carried(events, refs).where("carried is not null")
    told = final.where("kind = 'ref'").join(carried, ["turn", "sequence"]).select("workspace_id", "path", F.col("carried").alias("blob_hash"))
    return final.where("kind = 'set'").select("workspace_id", "path", "blob_hash").unionByName(told)
