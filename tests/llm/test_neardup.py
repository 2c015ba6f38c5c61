"""Near-duplicates against all pairs, with hot runs and copies."""

from __future__ import annotations

import random
import re

import numpy as np
import pytest

from corpusmith.llm import neardup
from corpusmith.llm.neardup import expand, groups, near_duplicates, pack, unpack
from corpusmith.llm.shingles import Shingler


def runs(text):
    w = re.findall(r"[a-z0-9_]+", text.lower())
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def brute(rows, threshold):
    out = set()
    own = {i: (c, runs(c)) for i, c in rows if c}
    for a in own:
        for b in own:
            if a < b and own[a][0] != own[b][0] and own[a][1] and own[b][1]:
                both = len(own[a][1] & own[b][1])
                if both * 100 >= round(threshold * 100) * len(own[a][1] | own[b][1]):
                    out.add((a, b))
    return out


def corpus(seed, head="", n=40):
    r = random.Random(seed)
    vocab = [f"w{i}" for i in range(60)]
    rows = []
    for d in range(n):
        base = [r.choice(vocab) for _ in range(r.choice([4, 12, 60, 150]))]
        for v in range(r.choice([1, 1, 3])):
            text = list(base)
            for _ in range(v * r.randint(0, 3)):
                text[r.randrange(len(text))] = r.choice(vocab)
            rows.append((f"d{d:03}{v}", head + " ".join(text)))
    rows += [(f"copy{i}", rows[0][1]) for i in range(5)] + [("none", None), ("empty", ""), ("odd", "!!! ... 中文"), ("case", rows[3][1].upper())]
    return rows


@pytest.mark.parametrize("threshold", [0.7, 0.8])
def test_equals_all_pairs(spark, threshold):
    rows = corpus(1)
    df = spark.createDataFrame(rows + rows[:3], "id string, content string").selectExpr("*", "1 as n", "'x' as class")
    links, members = near_duplicates(df, threshold)
    assert {tuple(r) for r in expand(links, members).collect()} == brute(rows, threshold)


@pytest.mark.parametrize(("seed", "words"), [(2, 18), (5, 40), (6, 90)])
def test_hot_runs(spark, monkeypatch, seed, words):
    """Contents whose head is shared by all: a share of their runs from a few to nearly all is hot."""
    monkeypatch.setattr(neardup, "HOT", 8)
    monkeypatch.setattr(neardup, "BLOCK", 16)
    rows = corpus(seed, head="".join(f"notice{i} " for i in range(words)))
    links, members = near_duplicates(spark.createDataFrame(rows, "id string, content string"), 0.7)
    assert {tuple(r) for r in expand(links, members).collect()} == brute(rows, 0.7)


def test_hot_contents_that_share_little_else(spark, monkeypatch):
    """All of a long head is hot, as short contents hold its parts: it is most of what the long contents share, and the rest a few of many runs."""
    monkeypatch.setattr(neardup, "HOT", 8)
    head = [f"notice{i}" for i in range(820)]
    rows = [(f"part{i:03}{j}", " ".join([*head[i : i + 12], f"own{i}and{j}"])) for i in range(0, 812, 8) for j in range(12)]
    for p in range(12):
        for side in "ab":
            rows.append((f"whole{p:02}{side}", " ".join([*head, *(f"both{p}no{k}" for k in range(14)), *(f"{side}{p}no{k}" for k in range(164))])))
    links, members = near_duplicates(spark.createDataFrame(rows, "id string, content string"), 0.7)
    got = {tuple(r) for r in expand(links, members).collect() if r.id_a.startswith("whole") and r.id_b.startswith("whole")}
    assert got == brute([r for r in rows if r[0].startswith("whole")], 0.7) and len(got) == 12


def test_groups(spark):
    rows = corpus(3, n=10)
    got = {r.id: r for r in groups(*near_duplicates(spark.createDataFrame(rows, "id string, content string"))).collect()}
    assert set(got) == {i for i, c in rows if c is not None} and got["copy0"].n_copies >= 6 and got["copy0"].group == got["copy4"].group
    for a, b in brute(rows, 0.8):
        assert got[a].group == got[b].group and got[a].n_links


def test_empty(spark):
    links, members = near_duplicates(spark.createDataFrame([], "id string, content string"))
    assert links.count() == 0 and members.count() == 0 and groups(links, members).count() == 0


def test_shingles():
    s = Shingler()
    assert len(s.text("one two three four")) == 0 and len(s.text(None)) == 0
    assert (s.text("A b c d e f a b c d e") == s.text("a B! c,d e f a b c d E")).all() and len(s.text("a b c d e " * 3)) == 5
    values = np.sort(np.random.default_rng(0).integers(0, 2**63, 40, dtype=np.uint64))
    assert (unpack(pack(values)) == values >> np.uint64(24)).all()
