"""Problem 4: records that share most of their content, by bottom-k sketches.

Each distinct content is kept as the smallest hashes of its runs of five words. Inverted lists
of the few smallest give pairs; the sketch of a pair's union estimates their similarity; the
pairs that may be similar are verified on all their runs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from corpusmith.llm.shingles import Shingler
from corpusmith.operators.components import connected_components
from corpusmith.session import materialize

#: Retained values, and how many of them are keys of the inverted lists. A pair of similarity s has none of the keys in common with a probability of (1 - s) ** KEYS.
RETAINED, KEYS = 32, 8
#: A key is hot if more contents than this have it among their KEYS smallest values; it is no key of contents that have others.
HOT = 256
#: Contents with this share of hot values are listed by all their runs, in the order of how many of them share each.
HOT_SHARE = 0.2
#: Lists are compared in blocks of so many entries.
BLOCK = 256
#: Standard deviations that an estimate may lie below the threshold.
SLACK = 4.0


#: Bytes of a retained value: its hash's upper 40 bits.
WIDTH = 5


def _lists(arrays: list[np.ndarray]) -> pa.ListArray:
    ends = np.concatenate([[0], np.cumsum([len(x) for x in arrays])]).astype(np.int32)
    flat = np.concatenate(arrays) if arrays else np.zeros(0, dtype=np.uint64)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat.view(np.int64)))


def pack(values: np.ndarray) -> bytes:
    """The upper 40 bits of hashes, as bytes."""
    return np.ascontiguousarray((values >> np.uint64(64 - 8 * WIDTH)).view(np.uint8).reshape(-1, 8)[:, :WIDTH]).tobytes()


def unpack(data: bytes) -> np.ndarray:
    """The values of :func:`pack`."""
    out = np.zeros((len(data) // WIDTH, 8), dtype=np.uint8)
    out[:, :WIDTH] = np.frombuffer(data, dtype=np.uint8).reshape(-1, WIDTH)
    return out.view(np.uint64).reshape(-1)


def keys_of(values: np.ndarray, hot: int) -> tuple[list[int], bool]:
    """The keys that a sketch is listed under, and whether its KEYS smallest values are all among them; bit i of ``hot`` says that value i is hot.

    Hot values leave twice as many others, which for contents with less than HOT_SHARE of hot ones
    miss a pair no more often than KEYS values of any kind.
    """
    if not hot:
        return values[:KEYS].tolist(), True
    flags = np.array([(hot >> i) & 1 for i in range(len(values))], dtype=bool)
    return values[~flags][: 2 * KEYS].tolist(), False


def sketch(items: DataFrame, retained: int = RETAINED) -> DataFrame:
    """id, class (a digest of the content), n (distinct runs) and sketch (the packed smallest hashes, ascending) of items."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler()
        for batch in batches:
            sets = [shingler.text(t) for t in batch.column(2).to_pylist()]
            counts = pa.array([len(s) for s in sets], pa.int32())
            packed = pa.array([pack(s[:retained]) for s in sets], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), counts, packed], names=["id", "class", "n", "sketch"])

    rows = items.where("id is not null and content is not null").select(F.col("id").cast("string").alias("id"), F.unhex(F.md5("content")).alias("class"), "content")
    return rows.mapInArrow(read, "id string, class binary, n int, sketch binary")


def _values(sketches: DataFrame, most: int) -> DataFrame:
    """number, value and at (the place) of the ``most`` smallest values of sketches (number, sketch)."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [unpack(s)[:most] for s in batch.column(1).to_pylist()]
            sizes = [len(x) for x in own]
            flat = np.concatenate(own) if own else np.zeros(0, dtype=np.uint64)
            at = np.concatenate([np.arange(n, dtype=np.int32) for n in sizes]) if own else np.zeros(0, dtype=np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(batch.column(0).to_numpy(), sizes), pa.int64()), pa.array(flat.view(np.int64)), pa.array(at)], names=["number", "value", "at"])

    return sketches.select("number", "sketch").mapInArrow(read, "number long, value long, at int")


def _postings(items: DataFrame, reps: DataFrame, threshold: float) -> DataFrame:
    """number, value and full of the inverted lists; a content may be in a list twice.

    Values that more than HOT contents share are found by counting and met by a join, whose side
    Spark broadcasts only where it is small. Contents with many of them are read once more and
    listed by all their runs, rarest first: of n runs two contents of the threshold share at least
    ``threshold`` n, so one of the first (1 - ``threshold``) n + 1 of both is the same. Where these
    run into values that over HOT such contents share, a content is also listed under its KEYS
    smallest values, hot or not, as it then is hot for nearly as much as the threshold asks.
    """
    sketches = reps.select("number", "sketch")
    hot = materialize(_values(sketches, KEYS).groupBy("value").count().where(F.col("count") > HOT).select("value"), "hot")
    if not hot.limit(1).count():
        return _values(sketches, KEYS).select("number", "value", F.lit(True).alias("full"))
    # written, so that its size is known and the sketches are only shuffled where it is large
    bits = materialize(_values(sketches, RETAINED).join(hot, "value", "left_semi").groupBy("number").agg(F.bit_or(F.expr("shiftleft(1L, at)")).alias("hot")), "bits")
    flagged = sketches.join(bits, "number", "left").withColumn("hot", F.coalesce("hot", F.lit(0).cast("long")))

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [keys_of(unpack(s), h) for s, h in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            sizes = [len(k) for k, _ in own]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(batch.column(0).to_numpy(), sizes), pa.int64()), pa.array([v for k, _ in own for v in k], pa.int64()), pa.array([f for k, f in own for _ in k], pa.bool_())], names=["number", "value", "full"]
            )

    first = flagged.select("number", "sketch", "hot").mapInArrow(listed, "number long, value long, full boolean")
    mixed = materialize(reps.join(bits, "number").where(F.bit_count("hot") >= HOT_SHARE * F.octet_length("sketch") / WIDTH).select("number", "n", "sketch", "class", F.col("representative").alias("id")), "mixed")
    if not mixed.limit(1).count():
        return first

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler()
        for batch in batches:
            for number, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = shingler.text(text)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), number), pa.int64()), pa.array(own.view(np.int64))], names=["number", "value"])

    content = items.where("content is not null").select(F.col("id").cast("string").alias("id"), F.unhex(F.md5("content")).alias("class"), "content")
    texts = content.join(mixed.select("id", "class", "number"), ["id", "class"]).select("number", "content").dropDuplicates(["number"])
    runs = materialize(texts.mapInArrow(whole, "number long, value long"), "whole")
    # runs of one content come first in the order, but can't meet; only their number counts
    shared = runs.groupBy("value").agg(F.count("*").alias("df")).where("df > 1")
    own = runs.join(shared, "value").groupBy("number").agg(F.sort_array(F.collect_list(F.struct("df", "value"))).alias("runs"))
    parts = 10_000
    reach = F.expr(f"n - (({round(threshold * parts)} * cast(n as long) + {parts - 1}) div {parts}) + 1 - (n - size(runs))").cast("int")
    prefix = materialize(own.join(mixed.select("number", "n", "sketch"), "number").select("number", "sketch", F.slice("runs", 1, F.greatest(reach, F.lit(0))).alias("runs")), "prefix")
    rare = prefix.select("number", F.explode(F.filter("runs", lambda x: x["df"] <= HOT)).alias("x")).select("number", "x.value", F.lit(False).alias("full"))
    often = _values(prefix.where(F.exists("runs", lambda x: x["df"] > HOT)), KEYS).select("number", "value", F.lit(True).alias("full"))
    return first.unionByName(rare).unionByName(often)


def _compare(threshold: float, retained: int):
    """Streams lists, ordered by list, and yields the pairs of each whose estimate may reach the threshold.

    A pair comes out of the list of the smallest value that both have, where both list it; where
    that isn't sure, it may come out several times.
    """

    def pairs(group: list[tuple], out: list[tuple[int, int]]) -> None:
        names = [g[1] for g in group]
        sides = np.array([g[2] for g in group])
        sets = [unpack(g[3]) for g in group]
        sizes = np.array([g[4] for g in group], dtype=np.float64)
        full = np.array([g[5] for g in group], dtype=bool)
        value = group[0][0][0]
        width = max(map(len, sets))
        table = np.zeros((len(sets), width), dtype=np.uint64)
        filled = np.zeros((len(sets), width), dtype=bool)
        for i, s in enumerate(sets):
            table[i, : len(s)] = s
            filled[i, : len(s)] = True
        last = np.array([s[-1] if len(s) == retained else np.uint64(2**64 - 1) for s in sets], dtype=np.uint64)
        for i, mine in enumerate(sets):
            right = np.arange(i + 1, len(sets))
            if group[i][0][1] != group[i][0][2]:  # two blocks of a long list: only across
                right = right[sides[right] != sides[i]]
            right = right[np.minimum(sizes[right], sizes[i]) >= threshold * np.maximum(sizes[right], sizes[i])]
            if not len(right):
                continue
            shared = np.isin(table[right], mine) & filled[right]
            both = shared.sum(axis=1)
            # the union's sketch reaches to the smaller of the two sketches' ends
            reach = np.minimum(last[right], last[i])
            within = (shared & (table[right] <= reach[:, None])).sum(axis=1)
            union = (filled[right] & (table[right] <= reach[:, None])).sum(axis=1) + (mine[None, :] <= reach[:, None]).sum(axis=1) - within
            estimate = within / np.maximum(union, 1)
            exact = (sizes[right] <= retained) & (sizes[i] <= retained)
            least = np.where(exact, threshold - 1e-9, threshold - SLACK * np.sqrt(threshold * (1 - threshold) / np.maximum(union, 1)))
            good = (both > 0) & (estimate >= least)
            # the first value of the other that is shared is the smallest; among both sketches' first KEYS it is listed by both
            place = shared.argmax(axis=1)
            smallest = table[right, place]
            listed = full[right] & full[i] & (place < KEYS) & (smallest <= mine[min(KEYS, len(mine)) - 1])
            for j in right[good & (~listed | (smallest.view(np.int64) == value))]:
                a, b = names[i], names[j]
                out.append((a, b) if a < b else (b, a))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        out: list[tuple[int, int]] = []

        def batch_of() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64())], names=["a", "b"])
            out.clear()
            return made

        for batch in batches:
            rows = [batch.column(i).to_pylist() for i in range(batch.num_columns)]
            for value, lo, hi, number, side, mine, n, full in zip(*rows, strict=True):
                place = (value, lo, hi)
                if held and held[0][0] != place:
                    if len(held) > 1:
                        pairs(held, out)
                    held = []
                if held and held[-1][1] == number:
                    held[-1] = (*held[-1][:5], full or held[-1][5])
                else:
                    held.append((place, number, side, mine, n, full))
            if len(out) > 20_000:
                yield batch_of()
        if len(held) > 1:
            pairs(held, out)
        if out:
            yield batch_of()

    return read


def near_duplicates(items: DataFrame, threshold: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """Links between different contents of items (id, content), and the classes of equal contents.

    Gives (a, b, similarity) with a < b, where a and b stand for their classes, and members
    (representative, id): the smallest id of each content with all its distinct ids. Contents are
    linked if the share of distinct five-word runs that both have, of those that either has, is at
    least ``threshold``. Ids occurring twice count once, with the content whose digest is smaller;
    null contents and those with fewer than five words have no links. Links are complete but for
    sketches' errors: with s the similarity, (1 - s) ** KEYS, 7e-5 at 0.7, and 4 standard
    deviations of the estimate.

    Hot keys (in more than HOT contents) aren't used as keys of contents that have others, and
    contents with many of them are listed by all their runs, so that no pair is lost by that: see
    :func:`_postings`.
    """
    read = materialize(sketch(items), "sketches")
    chosen = read.groupBy("id").agg(F.min("class").alias("class"))
    members = materialize(chosen.join(chosen.groupBy("class").agg(F.min("id").alias("representative")), "class"), "members")
    heads = members.where("id = representative").select("class", "representative")
    contents = read.where("n > 0").groupBy("class").agg(F.first("n").alias("n"), F.first("sketch").alias("sketch"))
    # numbered once and written, so that the number of a content never changes
    reps = materialize(contents.join(heads, "class").select(F.monotonically_increasing_id().alias("number"), "class", "representative", "n", "sketch"), "contents")
    sketches = reps.select("number", "n", "sketch")
    postings = _postings(items, reps, threshold)
    sizes = postings.groupBy("value").agg(F.count("*").alias("size")).where("size > 1")
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    side = F.pmod(F.xxhash64("number"), blocks).cast("int")
    entries = (
        postings.join(sizes, "value")
        .select("value", "number", "full", blocks.alias("blocks"), side.alias("side"))
        .select("value", "number", "full", "side", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
        .select("value", "number", "full", "side", F.least("side", "other").alias("lo"), F.greatest("side", "other").alias("hi"))
    )
    together = entries.join(sketches, "number").select("value", "lo", "hi", "number", "side", "sketch", "n", "full")
    together = together.repartition("value", "lo", "hi").sortWithinPartitions("value", "lo", "hi", "number")
    found = materialize(together.mapInArrow(_compare(threshold, RETAINED), "a long, b long").distinct(), "candidates")
    name = lambda side: reps.select(F.col("number").alias(side), F.col("representative").alias(f"r{side}"))
    named = found.join(name("a"), "a").join(name("b"), "b").select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b"))
    return _verify(items, members, materialize(named, "named"), threshold), members.select("representative", "id")


def _verify(items: DataFrame, members: DataFrame, candidates: DataFrame, threshold: float) -> DataFrame:
    """The candidates whose similarity on all runs reaches the threshold."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler()
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), _lists([shingler.text(t) for t in batch.column(1).to_pylist()])], names=["id", "runs"])

    wanted = candidates.select(F.col("a").alias("id")).unionByName(candidates.select(F.col("b").alias("id"))).distinct().join(members.select("id", "class"), "id")
    content = items.where("content is not null").select(F.col("id").cast("string").alias("id"), F.unhex(F.md5("content")).alias("class"), "content")
    content = content.join(wanted, ["id", "class"], "left_semi").select("id", "content")
    sets = materialize(content.mapInArrow(read, "id string, runs array<bigint>").dropDuplicates(["id"]), "runs")
    pairs = candidates.join(sets.select(F.col("id").alias("a"), F.col("runs").alias("x")), "a").join(sets.select(F.col("id").alias("b"), F.col("runs").alias("y")), "b")
    both = F.size(F.array_intersect("x", "y")).cast("long")
    counted = pairs.select("a", "b", both.alias("shared"), (F.size("x") + F.size("y")).cast("long").alias("sum"))
    parts = 10_000
    enough = F.col("shared") * parts >= round(threshold * parts) * (F.col("sum") - F.col("shared"))
    return counted.where(enough).select("a", "b", (F.col("shared") / (F.col("sum") - F.col("shared"))).alias("similarity"))


def expand(links: DataFrame, members: DataFrame) -> DataFrame:
    """(id_a, id_b) with id_a < id_b: the links between all ids of the linked contents."""
    left = members.select(F.col("representative").alias("a"), F.col("id").alias("x"))
    right = members.select(F.col("representative").alias("b"), F.col("id").alias("y"))
    return links.select("a", "b").join(left, "a").join(right, "b").select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"))


def groups(links: DataFrame, members: DataFrame) -> DataFrame:
    """id, group (smallest representative of the connected contents), n_links (other contents it is linked to) and n_copies of every id."""
    links = materialize(links.select("a", "b"), "links")
    degree = links.select(F.col("a").alias("representative")).unionByName(links.select(F.col("b").alias("representative"))).groupBy("representative").agg(F.count("*").alias("n_links"))
    parts = connected_components(links).select(F.col("node").alias("representative"), F.col("component").alias("group"))
    copies = members.groupBy("representative").agg(F.count("*").alias("n_copies"))
    classes = copies.join(degree, "representative", "left").join(parts, "representative", "left")
    return members.join(classes, "representative").select(
        "id", F.coalesce("group", "representative").alias("group"), F.coalesce("n_links", F.lit(0)).alias("n_links"), "n_copies"
    )
