"""Pieces: sizes, overlaps, lines, and that nothing is lost."""

from __future__ import annotations

import random

import pytest

from corpusmith.llm.splitting import OVERLAP_CHARS, split_oversized, split_text


def check(text, limit=2400):
    pieces = split_text(text, limit)
    assert pieces[0][0] == 0 and pieces[-1][1] == len(text)
    for a, b in pieces:
        assert 0 < b - a <= limit
    for (a, b), (c, d) in zip(pieces, pieces[1:], strict=False):
        assert a < c < b < d
        shared = text[c:b]
        assert len(shared) <= max(OVERLAP_CHARS + 8, limit // 3)
        if text[b - 1] == "\n" and shared.count("\n") and len(shared) > OVERLAP_CHARS:
            assert shared.count("\n") == 2
    return pieces


@pytest.mark.parametrize("seed", range(6))
def test_random_texts(seed):
    r = random.Random(seed)
    lines = ["".join(r.choice("abc {};,.é😀\t") for _ in range(r.choice([0, 20, 60, 90, 400, 3000]))) for _ in range(r.randint(2, 120))]
    text = r.choice(["\n", "\r\n"]).join(lines)
    if len(text) > 2400:
        check(text)


def test_special_texts():
    assert split_text("") == [] and split_text("x" * 2400) == [(0, 2400)]
    check("x" * 10_000)
    check("word " * 3000)
    check("e\u0301" * 3000)
    check("\n" * 9000)
    check("a\r\n" * 2000)
    assert len(check("x" * 300_000)) < 150
    check("a b\n" * 100, limit=50)


def test_natural_cuts():
    text = "".join(f"def f{i}():\n    a = {i}\n    return a\n\n" for i in range(200))
    cuts = [b for _, b in check(text)[:-1]]
    assert all(text[b - 2 : b] == "\n\n" or text[b] == "\n" for b in cuts)


def test_frames(spark):
    long = "\n".join(f"line {i} " + "x" * 50 for i in range(120))
    rows = [("a", 11, long, 1), ("b", None, long, 1), ("c", 1, None, 1), ("d", 1, "", 1), ("e", 5, "short\n", 1)]
    got = split_oversized(spark.createDataFrame(rows, "id string, start_line int, content string, piece int")).collect()
    a = sorted((r for r in got if r.id == "a"), key=lambda r: r.piece)
    assert a[0].start_line == 11 and a[-1].end_line == 130 and all(r.content.split("\n")[0] == long.split("\n")[r.start_line - 11] for r in a)
    assert all(y.start_line == x.end_line - 1 for x, y in zip(a, a[1:], strict=False))
    assert {r.start_line for r in got if r.id == "b"} == {None} and {r.id for r in got} == {"a", "b", "e"}
    assert [(r.start_line, r.end_line) for r in got if r.id == "e"] == [(5, 5)]
    assert split_oversized(spark.createDataFrame([], "id string, start_line int, content string")).count() == 0
