"""Problem 2: cutting oversized texts into overlapping pieces at natural boundaries.

A dynamic programme over possible cut positions minimises the sum of the cuts' penalties and of
the squared deviation of the pieces' sizes from an even division, under a hard maximum size.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

LIMIT = 2400
OVERLAP_LINES = 2
OVERLAP_CHARS = 100

#: Penalties of a cut, from a blank line to a hard cut within a word. Size imbalance counts SIZE_WEIGHT times its square.
BLANK, TOP_LEVEL, BLOCK_END, INDENT, CONTINUED = 0.0, 0.15, 0.25, 0.12, 0.6
IN_SENTENCE_END, IN_CLAUSE_END, IN_SPACE, IN_WORD = 1.5, 2.0, 2.5, 4.0
SIZE_WEIGHT = 1.0

_BREAK = re.compile(r"([.!?;。！？；]+\s*)|([,:)\]}>、，：]+\s*)|(\s+)")
#: Within a long line one candidate is kept in each run of this many characters.
_THIN = 40


def _line_penalty(before: str, after: str) -> float:
    """Penalty of a cut between two whole lines."""
    if not before.strip() or not after.strip():
        return BLANK
    stripped = before.rstrip()
    indent = len(after) - len(after.lstrip(" \t"))
    cost = TOP_LEVEL if indent == 0 else min(1.0, TOP_LEVEL + INDENT * (1 + indent / 4))
    if after.lstrip()[:1] in ("}", ")", "]"):
        cost += CONTINUED
    if stripped[-1:] in ("}", ";") or stripped.endswith("end"):
        cost = min(cost, BLOCK_END + 0.02 * indent)
    if stripped[-1:] in (",", "(", "[", "{", "\\", "=", "+", "|", "&"):
        cost += CONTINUED
    return cost


def _whole(text: str, at: int) -> int:
    """``at`` or the next place before it that parts no combining sequence and no CR LF."""
    while 0 < at < len(text) and (unicodedata.combining(text[at]) or text[at] in "‍︎️" or text[at - 1] == "‍" or text[at - 1 : at + 1] == "\r\n"):
        at -= 1
    return at


def _candidates(text: str, limit: int, lines: int, chars: int) -> tuple[list[int], list[int], list[float]]:
    """Cut positions, where the piece after each begins, and the penalties; the last is the end of the text."""
    starts = [0, *(m.end() for m in re.finditer("\n", text))]
    if starts[-1] < len(text) or len(starts) == 1:
        starts.append(len(text))
    long_line, shared = limit // 2, limit // 3
    chars, thin = min(chars, limit // 4), max(1, min(_THIN, limit // 8))
    cuts: list[int] = []
    nexts: list[int] = []
    costs: list[float] = []

    def inside(at: int) -> int:
        return max(0, _whole(text, at - chars))

    for i in range(len(starts) - 1):
        a, b = starts[i], starts[i + 1]
        if i:
            cuts.append(a)
            two = starts[max(0, i - lines)]
            nexts.append(two if a - two <= shared else inside(a))
            costs.append(_line_penalty(text[starts[i - 1] : a], text[a:b]))
        if b - a <= long_line:
            continue
        best: dict[int, tuple[float, int]] = {}
        for m in _BREAK.finditer(text, a, b):
            if a < m.end() < b:
                cost = IN_SENTENCE_END if m.group(1) else IN_CLAUSE_END if m.group(2) else IN_SPACE
                key = (m.end() - a) // thin
                if key not in best or cost <= best[key][0]:
                    best[key] = (cost, m.end())
        for key in range((b - a) // thin):
            if key not in best and (at := _whole(text, a + (key + 1) * thin)) > a and at < b:
                best[key] = (IN_WORD, at)
        for at, cost in sorted({at: cost for cost, at in best.values()}.items()):
            cuts.append(at)
            nexts.append(inside(at))
            costs.append(cost)
    cuts.append(len(text))
    nexts.append(len(text))
    costs.append(0.0)
    return cuts, nexts, costs


def split_text(text: str, limit: int = LIMIT, lines: int = OVERLAP_LINES, chars: int = OVERLAP_CHARS) -> list[tuple[int, int]]:
    """[begin, end) of each piece, in code points. A text within the limit is one piece, an empty one none."""
    if len(text) <= limit:
        return [(0, len(text))] if text else []
    cut_list, next_list, cost_list = _candidates(text, limit, lines, chars)
    cuts = np.array([0, *cut_list])
    nexts = np.array([0, *next_list])
    costs = np.array([0.0, *cost_list])
    # a piece must go on beyond what it shares with the next, else the row of pieces could stall
    count = max(2, -(-len(text) // max(1, limit - limit // 12)))
    ideal = len(text) / count
    total = np.full(len(cuts), np.inf)
    total[0] = 0.0
    back = np.zeros(len(cuts), dtype=np.int64)
    lows = np.searchsorted(cuts, cuts - limit, side="left")
    for k in range(1, len(cuts)):
        lo = lows[k]
        sizes = cuts[k] - nexts[lo:k]
        options = total[lo:k] + SIZE_WEIGHT * ((sizes - ideal) / ideal) ** 2
        options[(sizes > limit) | (nexts[lo:k] >= nexts[k])] = np.inf
        if options.size and np.isfinite(options[j := int(np.argmin(options))]):
            total[k] = options[j] + costs[k]
            back[k] = lo + j
    out: list[tuple[int, int]] = []
    k = len(cuts) - 1
    while k > 0:
        j = int(back[k])
        out.append((int(nexts[j]), int(cuts[k])))
        k = j
    return out[::-1]


def split_oversized(items: DataFrame, limit: int = LIMIT, lines: int = OVERLAP_LINES, chars: int = OVERLAP_CHARS) -> DataFrame:
    """Pieces (id, piece, pieces, start_line, end_line, content) of items (id, start_line, content).

    Every item with content comes out, one within the limit as a single piece. Pieces hold at most
    ``limit`` code points; neighbours share ``lines`` whole lines, or ``chars`` characters where the
    cut lies inside a longer line or the shared lines would fill over a third of a piece. A piece's
    lines count from start_line; they are null where start_line is. Null or empty contents give no
    piece. Other columns are ignored; repeated rows give their pieces again.
    """

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for key, first, text in zip(batch["id"], batch["start_line"], batch["content"], strict=True):
                pieces = split_text(text, limit, lines, chars)
                known = first is not None and first == first
                line, seen = int(first) if known else 0, 0
                for n, (a, b) in enumerate(pieces):
                    line += text.count("\n", seen, a) if a >= seen else -text.count("\n", a, seen)
                    seen = a
                    last = line + text.count("\n", a, b - 1)
                    rows.append((key, n, len(pieces), line if known else None, last if known else None, text[a:b]))
            out = pd.DataFrame(rows, columns=["id", "piece", "pieces", "start_line", "end_line", "content"])
            yield out.astype({"start_line": "Int32", "end_line": "Int32", "piece": "int32", "pieces": "int32"})

    rows = items.select(F.col("id").cast("string").alias("id"), F.col("start_line").cast("int").alias("start_line"), "content")
    return rows.where("content is not null and content != ''").mapInPandas(
        cut, "id string, piece int, pieces int, start_line int, end_line int, content string"
    )


def oversized(content: Column, limit: int = LIMIT) -> Column:
    """Whether an item must be cut; Spark counts code points."""
    return F.length(content) > limit
