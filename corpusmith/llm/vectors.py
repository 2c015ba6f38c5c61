"""Problem 3: most similar vectors, by score-aware quantisation, four-bit tables and exact reranking.

Vectors are sent to the nearest few of a number of cells. Within a cell, vectors are kept as one
four-bit code for each two dimensions. The codes are fitted so that errors along the vector,
which change inner products most, weigh more than errors across it. A query's inner products
with all codewords make its tables; sums of table entries choose candidates, whose similarity
is then computed from the vectors themselves.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window, functions as F

from corpusmith.session import materialize

K = 5
#: Rows of a cell at most on average, up to CELL_FLOATS numbers of cells' centres in all and CENTRES cells of a group, which bounds what is broadcast.
CELL, CELL_FLOATS, CENTRES = 128, 8_000_000, 2_500
#: Cells that these bounds leave larger are parted by centres of their own, fitted on at most SAMPLE of their vectors each; a vector goes to so many parts.
PART_REACH = 2
#: A cell's vectors are sent to its parts by so many tasks.
SALTS = 8
#: Nearest cells that each vector goes to; within a large cell, nearest parts.
REACH = 3
#: Vectors of each group (model, dim) that centres and codes are fitted on, at most.
SAMPLE, CODE_SAMPLE = 20_000, 4_096
#: Codewords of a code, dimensions of a code, and the inner product from which on errors matter.
WORDS, WIDTH, AIM = 16, 2, 0.2
#: Candidates of a query in a cell that are reranked, and how far tables may be below the floor.
RERANK, MARGIN = 40, 0.15
#: Copies of one vector that are searched; K + 1 are enough, as equal similarities go to smaller ids.
COPIES = K + 1
#: Queries that are compared with all rows at a time.
QUERY_BLOCK = 16_384


def usable(vector: Column, dim: Column, model: Column) -> Column:
    """Length equal to dim, model not null, and only finite numbers that aren't all zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return model.isNotNull() & dim.isNotNull() & (F.size(vector) == dim) & finite & F.exists(vector, lambda x: x != 0)


def directions(rows: DataFrame, vectors: bool = False) -> DataFrame:
    """vec_id, model, dim and copy of clean rows, with the vector if asked for.

    copy is a hash of the unit vector to six digits: vectors that share it have a cosine of 1 to nine digits.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            copy = np.zeros(batch.num_rows, dtype=np.int64)
            for _, dim, at in _groups(batch):
                unit = _unit(_vectors(batch.column(3).take(pa.array(at)), dim))
                marks = np.floor(unit * 1e6 + 0.5).astype(np.int32)
                copy[at] = [xxhash.xxh64_intdigest(x.tobytes()) >> 1 for x in marks]
            kept = 4 if vectors else 3
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(kept)), pa.array(copy)], names=["vec_id", "model", "dim", "vector"][:kept] + ["copy"])

    return rows.mapInArrow(read, "vec_id long, model string, dim int, " + ("vector array<float>, " if vectors else "") + "copy long")


def centres_of(sample: np.ndarray, count: int, rounds: int = 6, seed: int = 7) -> np.ndarray:
    """Unit centres of ``count`` cells, by spherical k-means."""
    rng = np.random.default_rng(seed)
    centres = sample[rng.choice(len(sample), min(count, len(sample)), replace=False)].copy()
    for _ in range(rounds):
        nearest = np.concatenate([np.argmax(sample[i : i + 4096] @ centres.T, axis=1) for i in range(0, len(sample), 4096)])
        order = np.argsort(nearest, kind="stable")
        found, starts = np.unique(nearest[order], return_index=True)
        sums = np.add.reduceat(sample[order], starts, axis=0)
        norms = np.linalg.norm(sums, axis=1, keepdims=True)
        centres[found] = np.where(norms > 1e-9, sums / np.maximum(norms, 1e-9), centres[found])
    return centres


class Codes:
    """Four-bit codes with a weight on the error along the vector."""

    def __init__(self, words: np.ndarray, weight: float) -> None:
        self.words, self.weight = words, weight  # (parts, WORDS, WIDTH)

    @classmethod
    def fit(cls, sample: np.ndarray, rounds: int = 3, seed: int = 11) -> Codes:
        """Alternates between the best codes and the best codewords for the weighted error."""
        n, d = sample.shape
        weight = max(1.0, (d - 1) * AIM**2 / (1 - AIM**2))
        parts = d // WIDTH
        rng = np.random.default_rng(seed)
        split = sample.reshape(n, parts, WIDTH)
        words = split[rng.choice(n, WORDS, replace=n < WORDS)].transpose(1, 0, 2).copy()
        own = cls(words, 1.0)
        for _ in range(4):  # plain codes first
            codes = own.encode(sample)
            for p in range(parts):
                sums = np.zeros((WORDS, WIDTH), dtype=sample.dtype)
                np.add.at(sums, codes[:, p], split[:, p])
                counts = np.bincount(codes[:, p], minlength=WORDS)[:, None]
                words[p] = np.where(counts > 0, sums / np.maximum(counts, 1), words[p])
        own.weight = weight
        for _ in range(rounds):
            codes = own.encode(sample)
            # the error is |x - c|^2 + (weight - 1) (1 - x.c)^2 for unit x: linear in the codewords
            spread = np.zeros((n, parts, WORDS, WIDTH), dtype=np.float64)
            np.put_along_axis(spread, codes[:, :, None, None].repeat(WIDTH, 3).astype(np.int64), split[:, :, None, :], axis=2)
            spread = spread.reshape(n, -1)
            counts = np.stack([np.bincount(codes[:, p], minlength=WORDS) for p in range(parts)]).repeat(WIDTH, 1).reshape(parts, WORDS, WIDTH)
            left = (weight - 1) * (spread.T @ spread)
            left[np.diag_indices_from(left)] += counts.reshape(-1) + 1e-3
            own.words = np.linalg.solve(left, weight * spread.sum(axis=0) + 1e-3 * own.words.reshape(-1)).reshape(parts, WORDS, WIDTH).astype(np.float32)
        return own

    def encode(self, vectors: np.ndarray) -> np.ndarray:
        """Codes (n, parts) of unit vectors: nearest codewords, then changed part by part for the weighted error."""
        n, parts = len(vectors), self.words.shape[0]
        split = vectors.reshape(n, parts, WIDTH)
        across = ((split[:, :, None, :] - self.words[None]) ** 2).sum(axis=3)
        codes = across.argmin(axis=2).astype(np.uint8)
        if self.weight <= 1.0:
            return codes
        along = np.einsum("npw,pkw->npk", split, self.words)
        total = np.take_along_axis(along, codes[:, :, None].astype(np.int64), axis=2)[:, :, 0].sum(axis=1)
        for p in range(parts):
            rest = total - along[np.arange(n), p, codes[:, p]]
            cost = across[:, p] + (self.weight - 1) * (1 - rest[:, None] - along[:, p]) ** 2
            codes[:, p] = cost.argmin(axis=1)
            total = rest + along[np.arange(n), p, codes[:, p]]
        return codes

    def tables(self, queries: np.ndarray) -> np.ndarray:
        """Tables (queries, pairs of parts, 256): inner products with two codewords at a time."""
        parts = self.words.shape[0]
        one = np.einsum("npw,pkw->npk", queries.reshape(len(queries), parts, WIDTH), self.words)
        if parts % 2:
            one = np.concatenate([one, np.zeros((len(queries), 1, WORDS), dtype=one.dtype)], axis=1)
        return (one[:, 0::2, :, None] + one[:, 1::2, None, :]).reshape(len(queries), -1, WORDS * WORDS).astype(np.float32)

    def pairs(self, codes: np.ndarray) -> np.ndarray:
        """Two codes in each byte, one row for each pair of parts."""
        if codes.shape[1] % 2:
            codes = np.concatenate([codes, np.zeros((len(codes), 1), dtype=np.uint8)], axis=1)
        return np.ascontiguousarray((codes[:, 0::2] * WORDS + codes[:, 1::2]).T)

    @staticmethod
    def scan(tables: np.ndarray, packed: np.ndarray) -> np.ndarray:
        """Approximate inner products (queries, vectors): sums of table entries."""
        total = tables[:, 0].take(packed[0], axis=1)
        for p in range(1, len(packed)):
            total += tables[:, p].take(packed[p], axis=1)
        return total


def _unit(vectors: np.ndarray) -> np.ndarray:
    wide = vectors.astype(np.float64)
    # scaled by the largest number first, so that squares neither overflow nor vanish
    wide /= np.abs(wide).max(axis=1, keepdims=True)
    return wide / np.linalg.norm(wide, axis=1, keepdims=True)


def _best(ids: np.ndarray, units: np.ndarray, rows: np.ndarray, against: np.ndarray, codes: Codes | None, k: int, floor: float) -> list[tuple[int, int, float]]:
    """The best k of ``against`` for each of ``rows`` (positions), of at least ``floor``, from tables and reranking."""
    out: list[tuple[int, int, float]] = []
    small = units.astype(np.float32)
    against = against[np.argsort(ids[against], kind="stable")]
    packed = codes.pairs(codes.encode(small[against])) if codes is not None else None
    for at in range(0, len(rows), 256):
        own = rows[at : at + 256]
        if packed is None or len(against) <= RERANK:
            rough = small[own] @ small[against].T
            slack = 1e-5
        else:
            rough = Codes.scan(codes.tables(small[own]), packed)
            slack = MARGIN
        near = rough >= floor - slack
        near &= ids[own][:, None] != ids[against][None, :]
        crowded = np.flatnonzero(near.sum(axis=1) > RERANK)
        if len(crowded):
            part = np.where(near[crowded], rough[crowded], -np.inf)
            keep = np.argpartition(-part, RERANK - 1, axis=1)[:, :RERANK]
            near[crowded] = False
            near[crowded[:, None], keep] = True
            # tables decide only as far as their error allows: rows with more candidates than were kept are compared in full
            sure = np.einsum("qnd,qd->qn", units[against[keep]], units[own[crowded]])
            error = np.abs(sure - np.take_along_axis(rough[crowded], keep, axis=1)).max()
            least = np.maximum(np.partition(sure, -min(k, RERANK), axis=1)[:, -min(k, RERANK)], floor)
            open_ = (part >= least[:, None] - error).sum(axis=1) > (np.take_along_axis(part, keep, axis=1) >= least[:, None] - error).sum(axis=1)
            if open_.any():
                again = crowded[open_]
                full = (units[own[again]] @ units[against].T).round(9)
                full[ids[own[again]][:, None] == ids[against][None, :]] = -np.inf
                first = np.argsort(-full, axis=1, kind="stable")[:, :k]
                near[again] = False
                near[again[:, None], first] = True
                near &= ids[own][:, None] != ids[against][None, :]
        q, c = np.nonzero(near)
        exact = np.einsum("nd,nd->n", units[own[q]], units[against[c]]).round(9) if len(q) else np.zeros(0)
        fine = exact >= floor - 1e-9
        q, c, exact = q[fine], c[fine], exact[fine]
        other = ids[against[c]]
        order = np.lexsort((other, -exact, q))
        rank, before = 0, -1
        for i in order:
            rank = rank + 1 if q[i] == before else 1
            before = q[i]
            if rank <= k:
                out.append((int(ids[own[q[i]]]), int(other[i]), float(exact[i])))
    return out


def _cell(ids: np.ndarray, vectors: np.ndarray, codes: Codes | None, k: int, floor: float) -> list[tuple[int, int, float]]:
    """The best k in its cell for every vector of the cell; large cells are parted again."""
    ids, first = np.unique(ids, return_index=True)
    if len(ids) < 2:
        return []
    units = _unit(vectors[first])
    every = np.arange(len(ids))
    limit = 16 * CELL
    if len(ids) <= limit:
        return _best(ids, units, every, every, codes, k, floor)
    small = units.astype(np.float32)
    rng = np.random.default_rng(len(ids))
    parts = centres_of(small[rng.choice(len(ids), min(SAMPLE, len(ids)), replace=False)], math.ceil(len(ids) / CELL), 4)
    near = np.concatenate([np.argpartition(-(small[i : i + 4096] @ parts.T), REACH - 1, axis=1)[:, :REACH] for i in range(0, len(ids), 4096)])
    out: list[tuple[int, int, float]] = []
    for p in range(len(parts)):
        own = np.flatnonzero((near == p).any(axis=1))
        # a part that is still large (many vectors as good as equal) is compared in blocks
        for a in range(0, len(own), limit):
            for b in range(0, len(own), limit):
                out += _best(ids, units, own[a : a + limit], own[b : b + limit], codes, k, floor)
    return out


def _fit(rows: DataFrame, sizes: list[tuple[str, int, int]]) -> dict[tuple[str, int], tuple[np.ndarray, Codes]]:
    """Centres and codes of each group that has more than two cells' rows, from at most SAMPLE of its vectors."""
    every = sum(n for *_, n in sizes)
    plan = {(m, d): min(math.ceil(n / CELL), max(1, int(CELL_FLOATS * (n / every) / d)), CENTRES) for m, d, n in sizes if n > 2 * CELL}
    plan = {g: c for g, c in plan.items() if c > 1}
    if not plan:
        return {}
    hashed = F.xxhash64("vec_id")
    chosen = Window.partitionBy("model", "dim").orderBy(hashed, "vec_id")
    # a sample by hash: first thinned, then the bound is enforced exactly
    most = {f"{m}\0{d}": n for m, d, n in sizes if (m, d) in plan}
    share = F.create_map(*[x for g, n in most.items() for x in (F.lit(g), F.lit(min(1.0, 1.5 * SAMPLE / n)))])[F.concat_ws("\0", "model", F.col("dim").cast("string"))]
    thin = rows.where(F.pmod(hashed, F.lit(1_000_003)) < share * 1_000_003)
    sample = thin.withColumn("_n", F.row_number().over(chosen)).where(F.col("_n") <= SAMPLE).drop("_n")

    def learn(group: pd.DataFrame) -> pd.DataFrame:
        model, dim = group["model"].iloc[0], int(group["dim"].iloc[0])
        unit = _unit(np.stack(group.sort_values("vec_id")["vector"].to_numpy())).astype(np.float32)
        codes = Codes.fit(unit[:: max(1, len(unit) // CODE_SAMPLE)][:CODE_SAMPLE]) if dim % WIDTH == 0 else None
        return pd.DataFrame(
            {
                "model": [model], "dim": [dim], "centres": [centres_of(unit, plan[(model, dim)]).tobytes()],
                "words": [codes.words.astype(np.float32).tobytes() if codes else b""], "weight": [codes.weight if codes else 1.0],
            }
        )

    fitted = sample.groupBy("model", "dim").applyInPandas(learn, "model string, dim int, centres binary, words binary, weight double").collect()
    out = {}
    for r in fitted:
        centres = np.frombuffer(r["centres"], dtype=np.float32).reshape(-1, r["dim"])
        words = Codes(np.frombuffer(r["words"], dtype=np.float32).reshape(-1, WORDS, WIDTH), r["weight"]) if r["words"] else None
        out[(r["model"], r["dim"])] = (centres, words)
    return out


def _vectors(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _groups(batch: pa.RecordBatch) -> Iterator[tuple[str, int, np.ndarray]]:
    keys = pd.DataFrame({"m": batch.column(1).to_pandas(), "d": batch.column(2).to_pandas()})
    for (model, dim), rows in keys.groupby(["m", "d"], sort=True).indices.items():
        yield model, int(dim), rows


def clean(rows: DataFrame) -> DataFrame:
    """vec_id, model, dim and vector of the usable rows."""
    named = rows.select("vec_id", "model", F.col("dim").cast("int").alias("dim"), F.col("vector").cast("array<float>").alias("vector"))
    return named.where(F.col("vec_id").isNotNull() & usable(F.col("vector"), F.col("dim"), F.col("model")))


def _parted(cells: DataFrame, large: dict[tuple[str, int], int]) -> DataFrame:
    """Cells (vec_id, model, dim, cell, vector) with part: those of the groups ``large`` are parted into about so many each, others have one.

    Each cell's centres are fitted where its sample lies and come to its vectors as the first row
    of their partition, so nothing of this size passes through the driver.
    """
    spark = cells.sparkSession
    bound = spark.sparkContext.broadcast(large)
    cells = materialize(cells, "cells")
    group = F.concat_ws("\0", "model", F.col("dim").cast("string"))
    wide = cells.where(group.isin(*(f"{m}\0{d}" for m, d in large)))
    hashed = F.xxhash64("vec_id", F.lit("part"))
    thin = wide.where(F.pmod(hashed, F.lit(1_000_003)) < min(1.0, 16.0 / (REACH * CELL)) * 1_000_003)
    order = Window.partitionBy("model", "dim", "cell").orderBy(hashed, "vec_id")
    sample = thin.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= SAMPLE).drop("_n")

    def learn(group: pd.DataFrame) -> pd.DataFrame:
        model, dim, cell = group["model"].iloc[0], int(group["dim"].iloc[0]), int(group["cell"].iloc[0])
        own = np.frombuffer(b"".join(group.sort_values("vec_id")["vector"]), dtype=np.float32).reshape(-1, dim)
        # a cell's share of the sample tells its size
        count = min(bound.value[(model, dim)] * 4, max(1, len(own) // 8), SAMPLE // 8)
        return pd.DataFrame({"vec_id": [-1], "model": [model], "dim": [dim], "cell": [cell], "vector": [centres_of(_unit(own).astype(np.float32), count, 4).tobytes()]})

    centres = sample.groupBy("model", "dim", "cell").applyInPandas(learn, "vec_id long, model string, dim int, cell int, vector binary")
    centres = centres.withColumn("first", F.lit(0)).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    every = centres.unionByName(cells.withColumn("first", F.lit(1)).withColumn("salt", F.pmod(F.xxhash64("vec_id"), F.lit(SALTS)).cast("int")))
    key = ["model", "dim", "cell", "salt"]

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, known = None, None
        for batch in batches:
            columns = {n: batch.column(n).to_pylist() for n in (*key, "first")}
            places = list(zip(*(columns[n] for n in key), strict=True))
            at = 0
            while at < batch.num_rows:
                end = at
                while end < batch.num_rows and places[end] == places[at]:
                    end += 1
                if places[at] != place:
                    place, known = places[at], None
                    if columns["first"][at] == 0:
                        known = np.frombuffer(batch.column("vector")[at].as_py(), dtype=np.float32).reshape(-1, place[1])
                        at += 1
                if at < end:
                    own = batch.slice(at, end - at)
                    blobs = own.column("vector").to_pylist()
                    if known is None or len(known) < 2:
                        parts = np.zeros((len(blobs), 1), dtype=np.int32)
                    else:
                        unit = _unit(np.frombuffer(b"".join(blobs), dtype=np.float32).reshape(len(blobs), -1)).astype(np.float32)
                        reach = min(PART_REACH, len(known))
                        parts = np.concatenate([np.argpartition(-(unit[i : i + 4096] @ known.T), reach - 1, axis=1)[:, :reach] for i in range(0, len(unit), 4096)]).astype(np.int32)
                    times = parts.shape[1]
                    repeat = pa.array(np.repeat(np.arange(len(blobs)), times))
                    yield pa.RecordBatch.from_arrays([*(own.column(n).take(repeat) for n in ("vec_id", "model", "dim", "cell")), pa.array(parts.reshape(-1)), own.column("vector").take(repeat)], names=["vec_id", "model", "dim", "cell", "part", "vector"])
                at = end

    ordered = every.repartition(*key).sortWithinPartitions(*key, "first").select("vec_id", *key, "first", "vector")
    return ordered.mapInArrow(part, "vec_id long, model string, dim int, cell int, part int, vector binary")


def nearest(rows: DataFrame, k: int = K, floor: float = -1.0, reach: int = REACH) -> DataFrame:
    """vec_id, neighbour and similarity of the ``k`` most similar vectors of the same model and dim, for every usable vector.

    Similarity is the cosine, rounded to nine digits; equal ones go to the smaller neighbour. A
    pair is found if its vectors share one of their ``reach`` nearest cells, which is likely the
    more the more similar they are; pairs below ``floor`` are left out. Rows (vec_id, model, dim,
    vector) that aren't usable are ignored; a vec_id that occurs twice counts once. Of vectors that
    are copies of one another but for their length, only the k + 1 smallest ids are searched; the others' neighbours
    are the k smallest.
    """
    every = clean(rows)
    spark = rows.sparkSession
    same = Window.partitionBy("model", "dim", "copy").orderBy("vec_id")
    light = directions(every).distinct()
    ranked = materialize(light.withColumn("_n", F.row_number().over(same)), "copies")
    firsts = ranked.where(F.col("_n") <= k + 1)
    sizes = [(r["model"], r["dim"], r["count"]) for r in firsts.groupBy("model", "dim").count().collect()]
    fitted = spark.sparkContext.broadcast(_fit(every, sizes))
    extra = ranked.where(F.col("_n") > k + 1).drop("_n")
    hot = firsts.where(F.col("_n") == k + 1).select("model", "dim", "copy")  # copies that may have more than are searched
    searched = every
    if extra.limit(1).count():  # else there is nothing to take out, and the vectors needn't be shuffled for it
        searched = directions(every, True).join(extra.select("vec_id", "copy"), ["vec_id", "copy"], "left_anti").select("vec_id", "model", "dim", "vector")

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for model, dim, at in _groups(batch):
                part = batch.take(pa.array(at))
                vectors = _vectors(part.column(3), dim).astype(np.float32)
                known = fitted.value.get((model, dim))
                if known is None:
                    cells = np.zeros((len(at), 1), dtype=np.int32)
                else:
                    unit = _unit(vectors).astype(np.float32)
                    cells = np.argpartition(-(unit @ known[0].T), min(reach, len(known[0])) - 1, axis=1)[:, : min(reach, len(known[0]))].astype(np.int32)
                times = cells.shape[1]
                raw = vectors.tobytes()
                step = 4 * dim
                blobs = [raw[i : i + step] for i in range(0, len(raw), step)]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.repeat(part.column(0).to_numpy(), times)), pa.array([model] * (len(at) * times), pa.string()),
                        pa.array(np.full(len(at) * times, dim, dtype=np.int32)), pa.array(cells.reshape(-1)),
                        pa.array([b for b in blobs for _ in range(times)], pa.binary()),
                    ],
                    names=["vec_id", "model", "dim", "cell", "vector"],
                )

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, ids, blobs = None, [], []

        def found() -> pa.RecordBatch:
            vectors = np.frombuffer(b"".join(blobs), dtype=np.float32).reshape(len(ids), place[1])
            known = fitted.value.get(place[:2])
            rows_ = _cell(np.array(ids, dtype=np.int64), vectors, known[1] if known else None, k, floor)
            cols = list(zip(*rows_, strict=True)) or [(), (), ()]
            return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.float64())], names=["vec_id", "neighbour", "similarity"])

        for batch in batches:
            for vec, model, dim, cell, part, blob in zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True):
                if place != (model, dim, cell, part):
                    if ids:
                        yield found()
                    place, ids, blobs = (model, dim, cell, part), [], []
                ids.append(vec)
                blobs.append(blob)
        if ids:
            yield found()

    cells = searched.mapInArrow(assign, "vec_id long, model string, dim int, cell int, vector binary")
    large = {(m, d): math.ceil(n / (CELL * len(fitted.value[(m, d)][0]))) for m, d, n in sizes if (m, d) in fitted.value}
    large = {g: n for g, n in large.items() if n > 1}
    cells = _parted(cells, large) if large else cells.select("vec_id", "model", "dim", "cell", F.lit(0).alias("part"), "vector")
    placed = cells.repartition("model", "dim", "cell", "part").sortWithinPartitions("model", "dim", "cell", "part")
    pairs = placed.mapInArrow(search, "vec_id long, neighbour long, similarity double")
    # the other copies: their own vector's smallest ids, of similarity 1
    heads = firsts.where(F.col("_n") <= k).join(hot, ["model", "dim", "copy"], "left_semi").select("model", "dim", "copy", F.col("vec_id").alias("neighbour"))
    copies = extra.join(heads, ["model", "dim", "copy"]).select("vec_id", "neighbour", F.lit(1.0).alias("similarity"))
    best = Window.partitionBy("vec_id").orderBy(F.desc("similarity"), "neighbour")
    merged = pairs.unionByName(copies).groupBy("vec_id", "neighbour").agg(F.max("similarity").alias("similarity"))
    return merged.withColumn("_n", F.row_number().over(best)).where(F.col("_n") <= k).drop("_n")


def search_queries(rows: DataFrame, queries: DataFrame, k: int = K) -> DataFrame:
    """vec_id, rank, neighbour and similarity: the ``k`` most similar of all ``rows`` for each of ``queries``.

    All rows are read against blocks of QUERY_BLOCK queries; tables choose each block of rows'
    candidates, so that nothing but ``k`` rows a query and task is shuffled. Ties and unusable rows
    count as in :func:`nearest`.
    """
    every, asked = clean(rows), clean(queries)
    spark = rows.sparkSession
    sizes = [(r["model"], r["dim"], r["count"]) for r in every.groupBy("model", "dim").count().collect()]
    fitted = spark.sparkContext.broadcast({g: (None, c) for g, (_, c) in _fit(every, sizes).items()})
    total = asked.count()
    blocks = max(1, math.ceil(total / QUERY_BLOCK))
    parts: DataFrame | None = None
    for b in range(blocks):
        block = asked.where(F.pmod(F.xxhash64("vec_id", F.lit("q")), F.lit(blocks)) == b).dropDuplicates(["vec_id"])
        held: dict[tuple[str, int], tuple[np.ndarray, np.ndarray]] = {}
        grouped: dict[tuple[str, int], list] = {}
        for r in block.toLocalIterator():
            grouped.setdefault((r["model"], r["dim"]), []).append((r["vec_id"], r["vector"]))
        for g, own in grouped.items():
            held[g] = (np.array([i for i, _ in own], dtype=np.int64), np.array([v for _, v in own], dtype=np.float32))
        sent = spark.sparkContext.broadcast(held)

        def scan(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            best: dict[int, list[tuple[float, int]]] = {}
            for batch in batches:
                for model, dim, at in _groups(batch):
                    if (model, dim) not in sent.value:
                        continue
                    qids, qvecs = sent.value[(model, dim)]
                    part = batch.take(pa.array(at))
                    ids, first = np.unique(part.column(0).to_numpy(), return_index=True)
                    vectors = _vectors(part.column(3), dim).astype(np.float32)[first]
                    known = fitted.value.get((model, dim))
                    both = np.concatenate([qids, ids])
                    units = np.concatenate([_unit(qvecs), _unit(vectors)])
                    rows_ = np.arange(len(qids))
                    for q, other, s in _best(both, units, rows_, np.arange(len(qids), len(both)), known[1] if known else None, k, -1.0):
                        best.setdefault(q, []).append((-s, other))
                for q, own in best.items():
                    if len(own) > k:
                        best[q] = sorted(set(own))[:k]
            if best:
                flat = [(q, o, -s) for q, own in best.items() for s, o in own]
                cols = list(zip(*flat, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.float64())], names=["vec_id", "neighbour", "similarity"])

        found = every.mapInArrow(scan, "vec_id long, neighbour long, similarity double")
        parts = found if parts is None else parts.unionByName(found)
    order = Window.partitionBy("vec_id").orderBy(F.desc("similarity"), "neighbour")
    merged = parts.groupBy("vec_id", "neighbour").agg(F.max("similarity").alias("similarity"))
    return merged.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("vec_id", "rank", "neighbour", "similarity")
