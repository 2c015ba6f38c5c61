"""Batches, breakers and reports."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from corpusmith.operators import models, reports


def test_batches_are_halved_and_ordered():
    asked = []

    def embed(texts):
        asked.append(len(texts))
        if len(texts) > 2:
            raise MemoryError
        return [[float(len(t))] for t in texts]

    texts = ["aaa", "b", "", "cccc", "dd"]
    assert models.in_batches(texts, embed, 4) == [[3.0], [1.0], [0.0], [4.0], [2.0]] and max(asked) == 4
    with pytest.raises(ValueError):
        models.in_batches(["x"], lambda t: [], 4)
    assert models.in_batches([], embed) == []


def test_embed_missing(spark):
    chunks = spark.createDataFrame([("a", "some text"), ("b", "other"), ("b", "other"), ("c", None)], "id string, text string")
    have = spark.createDataFrame([("a", "m"), ("b", "else")], "chunk_id string, model string")
    got = {r.chunk_id: r for r in models.embed_missing(chunks, have, models.hashed_embedding, "m").collect()}
    assert set(got) == {"b", "c"} and got["b"].dim == 64 and sum(x * x for x in got["b"].vector) == pytest.approx(1)
    text = chunks.select(models.rerank_text(F.lit("p"), F.lit(None).cast("string"), F.lit(""), F.col("text"), 12).alias("t")).first().t
    assert text == "path: p\nsom…"


def test_breaker():
    now = [0.0]
    b, degraded = models.Breaker(2, 10, lambda: now[0]), []

    def fails():
        raise OSError

    assert b.call(lambda: 1) == 1
    assert [b.call(fails, 0, degraded, "x") for _ in range(3)] == [0, 0, 0] and degraded == ["x"] * 3 and not b.allows()
    now[0] = 11
    assert b.call(fails, 0) == 0 and b.call(lambda: 1, 0) == 0
    now[0] = 22
    assert b.call(lambda: 1, 0) == 1 and b.call(lambda: 2, 0) == 2


def test_reports(spark):
    metrics = spark.createDataFrame([("a", 1.0, 1.0, 1.0, 1, 1, 1), ("b", 0.0, 0.0, 0.0, 0, 0, 0)], "case_id string, recall double, mrr double, ndcg double, top1 int, top3 int, top5 int")
    text = reports.evaluation_text(metrics)
    assert "recall: 0.5000" in text and "missed: b" in text and reports.evaluation_text(metrics.limit(0)) == "no cases"
    deltas = spark.createDataFrame([("improved", 0.5), ("excluded", None)], "outcome string, delta double")
    assert "| improved | 1 |" in reports.comparison_markdown(deltas, "one", "two")
    jobs = spark.createDataFrame([("queued",), ("failed",)], "status string")
    asked = spark.createDataFrame([(200, 5.0), (500, 9.0)], "status int, duration_ms double")
    assert tuple(reports.overview(jobs, asked).first()) == (1, 0, 0, 1, 2, 1, 9.0)
    assert reports.needs_rebuild(None, 3) and reports.needs_rebuild(1, 3) and not reports.needs_rebuild(2, 3)
