"""Embedding and reranking with functions that the caller gives: batches, texts, failures, and a stand-in without a model."""

from __future__ import annotations

import hashlib
import time
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

Embed = Callable[[list[str]], list[list[float]]]

#: Characters of a text that a reranker is given, and texts of a batch.
RERANK_CHARS, BATCH = 2000, 32
#: Characters of a chunk's content that are embedded.
EMBED_CHARS = 6000


def embedding_text(path: Column, symbol: Column, content: Column) -> Column:
    """What is embedded of a chunk: its path, its symbol, and the first EMBED_CHARS characters that a model takes of its content."""
    return F.concat(F.lit("File: "), path, F.lit("\nSymbol: "), F.coalesce(symbol, F.lit("")), F.lit("\n\n"), F.substring(F.coalesce(content, F.lit("")), 1, EMBED_CHARS))


def rerank_text(path: Column, symbol: Column, language: Column, content: Column, most: int = RERANK_CHARS) -> Column:
    """What a reranker reads of a chunk: path, symbol and language, then the content on one line; at most ``most`` characters, the last an ellipsis."""
    told = lambda label, c: F.concat(F.lit(label), F.nullif(c, F.lit("")))
    body = F.trim(F.regexp_replace(F.coalesce(content, F.lit("")), r"\s+", " "))
    text = F.concat_ws("\n", F.concat(F.lit("path: "), path), told("symbol: ", symbol), told("language: ", language), body)
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most - 1), F.lit("…"))).otherwise(text)


def instructed(query: Column, task: str = "Given a question, find the code that answers it") -> Column:
    """A query with the instruction that embedding models expect before it."""
    return F.concat(F.lit(f"Instruct: {task}\nQuery: "), query)


def in_batches(texts: list[str], embed: Embed, size: int = BATCH) -> list[list[float]]:
    """The vectors of texts, asked for in batches of like lengths, in the order of the texts.

    A batch that fails is halved and asked for again; a single text that fails raises its error.
    """
    out: list[list[float]] = [[]] * len(texts)
    order = sorted(range(len(texts)), key=lambda i: len(texts[i]))

    def ask(part: list[int]) -> None:
        try:
            vectors = embed([texts[i] for i in part])
            if len(vectors) != len(part):
                raise ValueError(f"{len(vectors)} vectors for {len(part)} texts")
        except Exception:
            if len(part) == 1:
                raise
            ask(part[: len(part) // 2])
            ask(part[len(part) // 2 :])
            return
        for i, v in zip(part, vectors, strict=True):
            out[i] = v

    for at in range(0, len(order), size):
        ask(order[at : at + size])
    return out


def embed_missing(chunks: DataFrame, vectors: DataFrame, embed: Embed, model: str, size: int = BATCH) -> DataFrame:
    """chunk_id, model, dim and vector (of length 1) of the chunks (id, text) that have no vector of ``model``."""
    have = vectors.where(F.col("model") == model).select(F.col("chunk_id").alias("id"))
    missing = chunks.select("id", F.coalesce("text", F.lit("")).alias("text")).dropDuplicates(["id"]).join(have, "id", "left_anti")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [np.asarray(v, dtype=np.float32) for v in in_batches(batch["text"].tolist(), embed, size)]
            unit = [v / max(float(np.linalg.norm(v)), 1e-12) for v in found]
            yield pd.DataFrame({"chunk_id": batch["id"], "model": model, "dim": pd.Series([len(v) for v in unit], dtype="int32"), "vector": unit})

    return missing.mapInPandas(run, "chunk_id string, model string, dim int, vector array<float>")


def hashed_embedding(texts: list[str], dim: int = 64) -> list[list[float]]:
    """Vectors without a model: each word adds to a place and sign that its digest gives. Equal texts have equal vectors."""
    out = []
    for text in texts:
        v = np.zeros(dim)
        for word in text.lower().split():
            d = hashlib.blake2b(word.encode(), digest_size=8).digest()
            v[int.from_bytes(d[:4], "little") % dim] += 1 if d[4] & 1 else -1
        n = np.linalg.norm(v)
        out.append((v / n if n else v).tolist())
    return out


class Breaker:
    """Keeps calls from a service that fails: after ``most`` failures in a row none for ``pause`` seconds, then one as a probe."""

    def __init__(self, most: int = 3, pause: float = 30.0, clock: Callable[[], float] = time.monotonic) -> None:
        self.most, self.pause, self.clock = most, pause, clock
        self.failures, self.opened, self.probing = 0, None, False

    def allows(self) -> bool:
        """Whether a call may be made now."""
        if self.opened is None:
            return True
        if self.clock() - self.opened < self.pause or self.probing:
            return False
        self.probing = True
        return True

    def call(self, action: Callable, fallback=None, degraded: list[str] | None = None, name: str = ""):
        """The result of ``action``, or ``fallback`` where calls are kept back or it fails; then ``name`` is added to ``degraded``."""
        if self.allows():
            try:
                out = action()
            except Exception:  # noqa: BLE001 - any failure of a service counts
                self.failures += 1
                self.probing = False
                if self.failures >= self.most:
                    self.opened = self.clock()
            else:
                self.failures, self.opened, self.probing = 0, None, False
                return out
        if degraded is not None:
            degraded.append(name)
        return fallback
