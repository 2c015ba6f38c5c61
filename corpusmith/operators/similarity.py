"""Vector expressions and exact search with a given set of queries."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T


#: Queries that are compared with all rows at a time.
QUERIES = 10_000


def dot(a: Column, b: Column) -> Column:
    """Inner product in double precision; null if a vector is null or the lengths differ."""
    total = F.aggregate(F.zip_with(a.cast("array<double>"), b.cast("array<double>"), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    return F.when(F.size(a) == F.size(b), total)


def norm(a: Column) -> Column:
    """Euclidean length."""
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors; a vector of zeros counts as of length 1, so the result is 0."""
    length = norm(a) * norm(b)
    return dot(a, b) / F.when(length > 0, length).otherwise(1.0)


def normalized(a: Column) -> Column:
    """The vector with length 1; zeros stay."""
    length = norm(a)
    return F.transform(a.cast("array<double>"), lambda x: x / F.when(length > 0, length).otherwise(1.0))


def to_text(a: Column) -> Column:
    """``[1.0,2.0]``, the form in which databases take vectors."""
    return F.concat(F.lit("["), F.array_join(F.transform(a, lambda x: x.cast("string")), ","), F.lit("]"))


def from_text(text: Column) -> Column:
    """The vector of :func:`to_text`; null for other texts."""
    return F.from_json(text, "array<double>")


@F.pandas_udf(T.BinaryType())
def to_bytes(vectors: pd.Series) -> pd.Series:
    """32-bit little-endian floats; null stays null."""
    return vectors.map(lambda v: None if v is None else np.asarray(v, dtype="<f4").tobytes())


@F.pandas_udf(T.ArrayType(T.FloatType()))
def from_bytes(data: pd.Series) -> pd.Series:
    """The vector of :func:`to_bytes`; null where the length isn't a multiple of four."""
    return data.map(lambda b: None if b is None or len(b) % 4 else np.frombuffer(b, dtype="<f4"))


def _best_of(asked: dict[int, tuple[list[int], np.ndarray]], k: int, digits: int):
    """Reads rows (key, vector) and yields the k best of its partition for each query, by place of the query."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        kind = None
        for batch in batches:
            kind = batch.schema.field(0).type
            keys, lists = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1)
            sizes = lists.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
            for dim, (places, units) in asked.items():
                at = np.flatnonzero(sizes == dim)
                if not len(at):
                    continue
                rows = lists.take(pa.array(at)).flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(-1, dim)
                length = np.linalg.norm(rows, axis=1, keepdims=True)
                scores = (units @ (rows / np.where(length > 0, length, 1.0)).T).round(digits)
                q, c = np.arange(len(places)), keys[at]
                if scores.shape[1] > k:
                    least = np.partition(scores, -k, axis=1)[:, -k]
                    q, at_c = np.nonzero(scores >= least[:, None])
                else:
                    q, at_c = np.nonzero(np.ones_like(scores, dtype=bool))
                own = (q, c[at_c], scores[q, at_c])
                if dim in best:
                    own = tuple(np.concatenate(x) for x in zip(best[dim], own, strict=True))
                order = np.lexsort((own[1], -own[2], own[0]))
                q = own[0][order]
                rank = np.arange(len(q)) - np.searchsorted(q, q, side="left")
                best[dim] = tuple(x[order][rank < k] for x in own)
        for dim, (q, keys, scores) in best.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.array(asked[dim][0])[q], pa.int64()), pa.array(keys.tolist(), kind), pa.array(scores, pa.float64())], names=["_place", "key", "score"])

    return read


def nearest_to(queries: DataFrame, rows: DataFrame, k: int, key: str, vector: str, digits: int = 6) -> DataFrame:
    """query_id, ``key``, score and rank of the ``k`` rows of the greatest cosine for each query (query_id, query_vector).

    Every row is compared with every query of the given set, in blocks of about QUERIES queries
    that are sent to all executors, and each task keeps its own best before anything is shuffled.
    Equal scores go to the smaller key. Rows and queries of other lengths don't meet; null vectors
    and null numbers don't count; vectors of zeros score 0.
    """
    whole = lambda c: F.col(c).isNotNull() & (F.size(c) > 0) & ~F.exists(c, lambda x: x.isNull() | F.isnan(x))
    asked = queries.select("query_id", "query_vector").where(whole("query_vector"))
    blocks = max(1, -(-asked.count() // QUERIES))
    kind, found = rows.schema[key].dataType.simpleString(), None
    for b in range(blocks):
        block = asked.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b).collect()
        held: dict[int, tuple[list[int], list]] = {}
        for n, r in enumerate(block):
            places, vectors = held.setdefault(len(r["query_vector"]), ([], []))
            places.append(n)
            vectors.append(r["query_vector"])
        units = {}
        for dim, (places, vectors) in held.items():
            matrix = np.array(vectors, dtype=np.float64)
            length = np.linalg.norm(matrix, axis=1, keepdims=True)
            units[dim] = (places, matrix / np.where(length > 0, length, 1.0))
        names = rows.sparkSession.createDataFrame([(n, r["query_id"]) for n, r in enumerate(block)], T.StructType([T.StructField("_place", T.LongType()), T.StructField("query_id", queries.schema["query_id"].dataType)]))
        own = rows.where(whole(vector)).select(F.col(key).alias("key"), vector).mapInArrow(_best_of(units, k, digits), f"_place long, key {kind}, score double")
        own = own.join(names, "_place").select("query_id", F.col("key").alias(key), "score")
        found = own if found is None else found.unionByName(own)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), key)
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).withColumn("rank", F.col("rank").cast("long"))
