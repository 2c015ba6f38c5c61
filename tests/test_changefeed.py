"""The change feed against a fold in order, on random feeds and special cases."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest

from corpusmith.operators import changefeed
from corpusmith.operators.changefeed import apply_change_feed

BASE = "workspace_id string, path string, blob_hash string"
CHANGES = "session_id string, sequence int, op string, path string, old_path string, blob_hash string, received_at timestamp, extra string"
SESSIONS = "id string, workspace_id string, base_revision long, status string, path string"


def fold(base, changes, sessions):
    clean = lambda p: "/".join(s for s in p.replace("\\", "/").split("/") if s not in ("", ".")) if p else p
    state = {(w, clean(p)): b and b.lower() for w, p, b in base}
    known = {s[0]: s for s in sessions if s[3] == "committed"}
    feed = {}
    for c in sorted(changes, key=lambda c: c[6]):
        feed[c[:2]] = c
    for sid, seq in sorted((k for k in feed if k[0] in known), key=lambda k: (known[k[0]][1], known[k[0]][2], k[0], k[1])):
        _, _, op, path, old, blob, *_ = feed[(sid, seq)]
        ws, op, path, old, blob = known[sid][1], op.strip().lower(), clean(path), clean(old), blob and blob.lower()
        if op == "upsert":
            state[(ws, path)] = blob
        elif op == "delete":
            state.pop((ws, path), None)
        else:
            held = state.pop((ws, old), None) if old else None
            value = blob or held
            if value:
                state[(ws, path)] = value
            else:
                state.pop((ws, path), None)
    return {(w, p, b) for (w, p), b in state.items()}


def run(spark, base, changes, sessions):
    out = apply_change_feed(spark.createDataFrame(base, BASE), spark.createDataFrame(changes, CHANGES), spark.createDataFrame(sessions, SESSIONS))
    rows = [tuple(r) for r in out.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


@pytest.mark.parametrize("seed", [1, 2])
def test_random_feeds_equal_the_fold(spark, seed, monkeypatch):
    monkeypatch.setattr(changefeed, "LOOKUP_BLOCK", 4)
    r = random.Random(seed)
    paths = [f"d/p{i}" for i in range(6)]
    spell = lambda p: r.choice([p, "./" + p, p.replace("/", "\\"), p.replace("/", "//"), p.replace("/", "/./")])
    base = [("w1", p, f"B{i}") for i, p in enumerate(paths[:3])] + [("w2", "x", "bx")]
    sessions = [(f"s{i}", r.choice(["w1", "w1", "w2"]), i, r.choice(["committed"] * 4 + ["aborted"]), "other") for i in range(8)]
    changes, t = [], datetime(2025, 1, 1)
    for s in sessions:
        for q in range(r.randint(0, 14)):
            op = r.choice(["upsert", "delete", "rename", "rename"])
            change = [s[0], q, r.choice([op, op.upper(), f" {op} "]), spell(r.choice(paths)), spell(r.choice(paths)) if op == "rename" else r.choice([None, ""]), None if op == "delete" or op == "rename" and r.random() < 0.7 else f"H{r.randint(0, 99)}"]
            for _ in range(r.choice([1, 1, 2])):
                changes.append((*change, t + timedelta(seconds=r.randint(0, 99999)), "e"))
    r.shuffle(changes)
    assert run(spark, base, changes, [*sessions, sessions[0]]) == fold(base, changes, sessions)


def test_long_chain_of_renames(spark):
    t = datetime(2025, 1, 1)
    changes = [("s", i, "rename", f"p{i + 1}", f"p{i}", None, t, None) for i in range(40)]
    assert run(spark, [("w", "p0", "AB")], changes, [("s", "w", 1, "committed", None)]) == {("w", "p40", "ab")}


def test_special_cases(spark):
    t = datetime(2025, 1, 1)
    sessions = [("s", "w", 1, "committed", None), ("n", None, 1, "committed", None)]
    changes = [
        ("s", 0, "upsert", "a", None, None, t, None),  # a null blob is kept
        ("s", 1, "rename", "b", "nothing", None, t, None),  # nothing was there
        ("s", 2, "rename", "c", None, "CC", t, None),  # no old path
        ("s", 3, "rename", "k", "k", None, t, None),  # onto itself
        ("s", 4, "truncate", "k", None, None, t, None),
        ("s", None, "delete", "k", None, None, t, None),
        ("s", 5, "upsert", None, None, "x", t, None),
        ("n", 0, "upsert", "z", None, "x", t, None),
        ("unknown", 0, "delete", "k", None, None, t, None),
    ]
    base = [("w", "k", "k1"), ("w", None, "x"), (None, "y", "x"), ("w", "./b", "old")]
    assert run(spark, base, changes, sessions) == {("w", "a", None), ("w", "c", "cc"), ("w", "k", "k1")}


def test_empty_tables(spark):
    assert run(spark, [], [], []) == set()
    assert run(spark, [("w", "p", "B")], [], []) == {("w", "p", "b")}
