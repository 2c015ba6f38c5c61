"""Problem 8: packing items of varying size into containers of fixed capacity.

Bounded-space online packing: each partition keeps a fixed number of open containers, puts every
item where it fits best and, when it fits nowhere, emits the fullest. Only what is still open at
the end of a partition is packed again, as items, in ever fewer partitions.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from corpusmith.session import materialize

CAPACITY = 2048
OPEN = 64
#: Partitions whose leftovers meet in one partition of the next round.
FAN_IN = 16


class OpenWindows:
    """At most ``limit`` open containers, ordered by the space that is left in them."""

    def __init__(self, capacity: int, limit: int) -> None:
        self.capacity, self.limit = capacity, limit
        self.open: list[tuple[int, int]] = []  # (space left, number)
        self.made = 0

    def put(self, size: int) -> tuple[int, int, list[int]]:
        """Container and offset of an item, and the containers closed for it."""
        closed: list[int] = []
        at = bisect.bisect_left(self.open, (size, -1))
        if at < len(self.open):
            left, number = self.open.pop(at)
        else:
            if len(self.open) >= self.limit:
                closed.append(self.open.pop(0)[1])
            left, number = self.capacity, self.made
            self.made += 1
        if left - size:
            bisect.insort(self.open, (left - size, number))
        else:
            closed.append(number)
        return number, self.capacity - left, closed


def _pack(rows: DataFrame, capacity: int, limit: int | None, left: int, prefix: str) -> DataFrame:
    """Adds container and offset to rows (item, size) partition by partition; the partitions must be ordered.

    ``limit`` containers are open at a time; none bounds the rows of a level that is bounded itself. The
    ``left`` emptiest that are open at the end come out once more, as rows without item whose size is what they hold.
    """

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        windows, part = OpenWindows(capacity, limit or 1 << 30), None
        for batch in batches:
            if not len(batch):
                continue
            if part is None:
                part = int(batch["_part"].iloc[0])
            placed = [windows.put(int(s))[:2] for s in batch["size"]]
            batch["bin"] = [f"{prefix}-{part}-{n}" for n, _ in placed]
            batch["offset"] = pd.Series([o for _, o in placed], dtype="int32").to_numpy()
            yield batch[["item", "size", "bin", "offset"]]
        emptiest = windows.open[-left:]
        if emptiest:
            yield pd.DataFrame(
                {"item": [None] * len(emptiest), "size": [capacity - s for s, _ in emptiest], "bin": [f"{prefix}-{part}-{n}" for _, n in emptiest], "offset": -1}
            ).astype({"size": "int32", "offset": "int32"})

    kind = rows.schema["item"].dataType.simpleString()
    return rows.withColumn("_part", F.spark_partition_id()).mapInPandas(pack, f"item {kind}, size int, bin string, offset int")


def pack_items(items: DataFrame, capacity: int = CAPACITY, limit: int = OPEN) -> DataFrame:
    """Places (item, part, parts, size, container, offset) of items (item, size).

    An item over the capacity is split into full containers and a rest that is packed like an item;
    its pieces are numbered by ``part``. Items of size 0 or null take a place of size 0 like any
    other, so every item comes out. Repeated items are packed as often as they occur. ``offset`` is
    where the piece begins in its container. Containers hold at most ``capacity``. The result
    depends on the rows and the number of partitions, not on the order in which rows arrive.
    """
    size = F.greatest(F.coalesce(F.col("size").cast("int"), F.lit(0)), F.lit(0))
    pieces = items.select("item", size.alias("_size")).select(
        "item",
        F.when(F.col("_size") <= capacity, 1).otherwise(F.ceil(F.col("_size") / capacity)).cast("int").alias("parts"),
        F.explode(
            F.when(F.col("_size") <= capacity, F.array(F.struct(F.lit(0).alias("part"), F.col("_size").alias("size")))).otherwise(
                F.transform(
                    F.sequence(F.lit(0), F.ceil(F.col("_size") / capacity).cast("int") - 1),
                    lambda p: F.struct(p.alias("part"), F.least(F.col("_size") - p * capacity, F.lit(capacity)).cast("int").alias("size")),
                )
            )
        ).alias("p"),
    )
    rows = pieces.select(F.struct("item", "parts", F.col("p.part").alias("part")).alias("item"), F.col("p.size").alias("size"))
    # ordered by hash, so that sizes come mixed; the item itself settles ties
    count = max(1, int(items.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    mixed = rows.repartition(count, F.xxhash64("item")).sortWithinPartitions(F.xxhash64("item"), "item")
    packed = materialize(_pack(mixed, capacity, limit, limit, "0"), "packed")
    placed = packed.where("offset >= 0")
    still_open = lambda level: level.where("offset < 0").select(F.col("bin").alias("item"), "size")
    open_ = still_open(packed)
    moves: DataFrame | None = None
    level = 1
    while count > 1:
        count = -(-count // FAN_IN)
        # a partition gets at most limit * FAN_IN open containers: best fit, fullest first
        part = F.pmod(F.split("item", "-")[1].cast("int"), F.lit(count))
        ordered = open_.repartition(count, part).sortWithinPartitions(F.desc("size"), "item")
        merged = materialize(_pack(ordered, capacity, None, limit if count > 1 else 0, str(level)), f"merged{level}")
        step = merged.where("offset >= 0").select(F.col("item").alias("bin"), F.col("bin").alias("_to"), F.col("offset").alias("_by"))
        if moves is None:
            moves = step.select("bin", F.col("_to").alias("to"), F.col("_by").alias("by"))
        else:
            again = step.withColumnRenamed("bin", "to")
            moves = moves.join(again, "to", "left").select(
                "bin", F.coalesce("_to", "to").alias("to"), (F.col("by") + F.coalesce("_by", F.lit(0))).cast("int").alias("by")
            )
        open_ = still_open(merged)
        level += 1
    if moves is not None:
        placed = placed.join(moves, "bin", "left").select(
            "item", "size", F.coalesce("to", "bin").alias("bin"), (F.col("offset") + F.coalesce("by", F.lit(0))).cast("int").alias("offset")
        )
    return placed.select(
        F.col("item.item").alias("item"), F.col("item.part").alias("part"), F.col("item.parts").alias("parts"), "size",
        F.col("bin").alias("container"), "offset",
    )
