"""Containers: nothing lost, nothing over, little space left."""

from __future__ import annotations

import random

from corpusmith.llm.packing import OpenWindows, pack_items


def packed(spark, sizes, capacity=100):
    df = spark.createDataFrame(list(enumerate(sizes)), "item long, size int").selectExpr("*", "'x' as container")
    return [r.asDict() for r in pack_items(df, capacity, 8).collect()]


def check(rows, sizes, capacity=100):
    by_item: dict = {}
    by_bin: dict = {}
    for r in rows:
        by_item.setdefault(r["item"], []).append(r)
        by_bin.setdefault(r["container"], []).append(r)
    assert set(by_item) == set(range(len(sizes)))
    for i, own in by_item.items():
        assert sum(r["size"] for r in own) == max(0, sizes[i] or 0) and sorted(r["part"] for r in own) == list(range(own[0]["parts"])) and len(own) == own[0]["parts"]
        if (sizes[i] or 0) <= capacity:
            assert len(own) == 1
    for own in by_bin.values():
        at = 0
        for r in sorted((r for r in own if r["size"]), key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["size"]
        assert at <= capacity and all(0 <= r["offset"] <= capacity for r in own)
    return sum(max(0, s or 0) for s in sizes) / (capacity * len(by_bin))


def test_packs_well(spark):
    r = random.Random(2)
    sizes = [r.choice([r.randint(1, 30), r.randint(1, 100), r.randint(101, 450)]) for _ in range(1500)]
    assert check(packed(spark, sizes), sizes) > 0.95


def test_special_sizes(spark):
    sizes = [0, None, 100, 200, 101, -5, 1, 1, 1]
    check(packed(spark, sizes), sizes)
    same = [60] * 200
    check(packed(spark, same), same)
    assert packed(spark, []) == []


def test_best_fit():
    w = OpenWindows(10, 2)
    assert [w.put(s)[:2] for s in (6, 7, 3, 4)] == [(0, 0), (1, 0), (1, 7), (0, 6)]
    w = OpenWindows(10, 2)
    w.put(6), w.put(7)
    assert w.put(8)[2] == [1]  # the fullest is closed


def test_same_result_in_any_order(spark):
    sizes = [(i * 37) % 90 + 1 for i in range(300)]
    df = spark.createDataFrame(list(enumerate(sizes)), "item long, size int")
    key = lambda rows: sorted((r.item, r.container, r.offset) for r in rows)
    assert key(pack_items(df, 100, 8).collect()) == key(pack_items(df.repartition(7).orderBy("size"), 100, 8).collect())


def test_only_open_containers_are_merged(spark):
    """Items of which no two fit together: all but the open containers stay as their partition closed them."""
    rows = packed(spark, [65] * 2000)
    first = {r["container"] for r in rows if r["container"].startswith("0-")}
    merged = {r["container"] for r in rows} - first
    assert len(first) + len(merged) == 2000 and len(merged) <= 8 * 4
