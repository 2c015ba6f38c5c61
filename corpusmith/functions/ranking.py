"""Scores of candidates: features of a chunk, weights by intent, similarity of paths, and orders."""

from __future__ import annotations

import functools
import math
import os.path
import re

from corpusmith.functions import rules
from corpusmith.functions.query import Query, basename_affinity
from corpusmith.functions.tokens import tokenize


def is_implementation(path: str, language: str | None = None) -> bool:
    """Whether a path is source code; documents and commits never are."""
    return bool(rules.IMPLEMENTATION.search(path)) and language not in ("markdown", "git-commit")


def test_like(path: str) -> bool:
    """Whether a path belongs to tests, by its folders or its name."""
    *folders, base = path.replace("\\", "/").split("/")
    return any(rules.TEST_FOLDER.search(f) or rules.CAMEL_TEST_FOLDER.search(f) for f in folders) or bool(rules.TEST_NAME.search(base))


def feature_score(path: str, language: str | None, symbol: str | None, content: str | None, query: Query) -> float:
    """The sum of a chunk's features for a query: names it holds, words it shares, and what kind of file it is in."""
    content, symbol = content or "", (symbol or "").lower()
    lower, base = path.lower(), path.lower().rsplit("/", 1)[-1]
    stem = re.sub(r"\.[^.]+$", "", base)
    code = is_implementation(path, language)
    docs, tests = bool(rules.ASKS_DOCS.search(query.raw)), bool(rules.ASKS_TESTS.search(query.raw))
    focused = query.intent in ("symbol", "path")
    gains: list[float] = []
    low_content = content.lower()
    for name in query.identifiers:
        own = name.lower()
        gains.append(1.35 if symbol == own else 0.75 if own in symbol else 0.0)
        gains.append(0.55 if own in base else 0.0)
        gains.append((0.55 if code else 0.30) if name in content else (0.30 if code else 0.15) if own in low_content else 0.0)
        gains.append(0.70 if stem == own else 0.0)
    gains += [0.95 for hint in query.paths if hint.lower() in lower]
    in_text, in_path, in_stem = set(tokenize(content[:4000])), set(tokenize(path)), set(tokenize(stem))
    shared = sum((t in in_text) + 1.5 * (t in in_path) for t in query.tokens)
    gains.append(min(1.6, shared * (0.14 if code else 0.10)))
    gains += [1.15 if stem == t else 0.72 if t in in_stem else 0.0 for t in query.tokens if len(t) >= 4]
    if rules.SOURCE_PATH.search(path):
        gains.append(0.95)
    gains.append(0.80 if code else 0.0)
    gains.append(0.25 if rules.CORE_FILE.search(path) else 0.0)
    if code and symbol and len(content) < 2800:
        gains.append(0.20)
    if code and 80 < len(content) < 3500:
        gains.append(0.10)
    losses = [asked if tests else other for pattern, asked, other in rules.TEST_PATHS if pattern.search(path)]
    if query.intent != "path":
        losses += [0.55] * bool(rules.HEADER_FILE.search(path)) + [0.90] * bool(rules.JSON_FILE.search(path))
    if rules.DOCUMENT_PATH.search(path):
        losses.append(0.25 if docs else 1.85 if focused else 1.45)
    if language == "markdown" or rules.MARKDOWN_FILE.search(path) or rules.PROJECT_DOCUMENT.search(base):
        losses.append(0.20 if docs else 1.75 if focused else 0.35 if query.intent == "history" else 1.35)
    if rules.TYPINGS_PATH.search(path):
        losses.append(0.85)
    if not rules.ASKS_DEPRECATED.search(query.raw):
        losses.append(1.25 if rules.DEPRECATED_PATH.search(path) else 0.70 if rules.DEPRECATED_MARK.search(content[:600]) else 0.0)
    if language == "git-commit":
        gains.append(0.70 if query.history else -0.85)
    return sum(gains) - sum(losses)


def combine(rank: float, features: float, meaning: float, intent: str, has_meaning: bool = True) -> float:
    """The final score from fused rank, features and normalized similarity."""
    by_rank, by_feature, by_meaning = rules.WEIGHTS[intent if has_meaning and meaning > 0 else "none"]
    agree = 0.06 if has_meaning and meaning >= 0.85 and features >= 0.8 else 0.0
    return by_rank * rank + by_feature * math.tanh(features / 2.2) + by_meaning * meaning + agree


def path_similarity(a: str, b: str) -> float:
    """How much two files are alike by their paths."""
    if a == b:
        return 1.0
    x, y = a.split("/"), b.split("/")
    same = lambda pairs: next((i for i, (p, q) in enumerate(pairs) if p != q), min(len(x), len(y)))
    ratio = same(zip(x, y, strict=False)) / max(len(x), len(y))
    if x[-1] != y[-1]:
        return min(0.25, ratio)
    return 0.85 if same(zip(x[::-1], y[::-1], strict=False)) >= 3 else min(0.5, max(0.15, ratio))


def preferred(items: list, score=lambda c: c["final"], path=lambda c: c["path"]) -> list:
    """Items by falling score; where scores are within 0.02, code first and then by path.

    This relation isn't transitive, so the result depends on the order of the items given, which
    therefore has to be fixed by the caller.
    """

    def compare(a, b) -> int:
        gap = score(a) - score(b)
        if abs(gap) > 0.02:
            return -1 if gap > 0 else 1
        code = bool(rules.IMPLEMENTATION.search(path(b))) - bool(rules.IMPLEMENTATION.search(path(a)))
        return code or (path(a) > path(b)) - (path(a) < path(b))

    return sorted(items, key=functools.cmp_to_key(compare))


def diversify(items: list, count: int, weight: float = 0.78, score=lambda c: c["final"], path=lambda c: c["path"]) -> list:
    """``count`` items, each time the one whose score less its likeness to those chosen is best; ties go to the earlier."""
    if len(items) <= count:
        return list(items)
    rest, chosen = list(items), []
    while rest and len(chosen) < count:
        worth = [
            weight * score(c) - (1 - weight) * max((path_similarity(path(c), path(s)) for s in chosen), default=0.0) + (0.02 if rules.IMPLEMENTATION.search(path(c)) else 0.0)
            for c in rest
        ]
        chosen.append(rest.pop(max(range(len(rest)), key=lambda i: (worth[i], -i))))
    return chosen


def collapse(items: list[dict], query: Query) -> list[dict]:
    """One item for each file: its best, lifted by the words that the file covers, its other items and its name."""
    files: dict[str, list[dict]] = {}
    for item in items:
        files.setdefault(item["path"], []).append(item)
    words = {t for t in query.tokens if len(t) >= 3}
    out = []
    for path, own in files.items():
        own = preferred(own)
        best = own[0]
        code = is_implementation(path, best["language"])
        held = set(tokenize("\n".join([path, *(i["content"] or "" for i in own[:12])])[:36_000]))
        covered = len(words & held) / len(words) if words else 0.0
        support = min(0.12, 0.04 * sum(max(0.0, i["final"]) for i in own[1:4])) if code else 0.0
        name = basename_affinity(path, query) * 0.24 * (0.25 if test_like(path) and not rules.ASKS_TESTS.search(query.raw) else 1.0)
        out.append({**best, "final": best["final"] + covered * (0.18 if code else 0.05) + support + name})
    return preferred(out)


def packed_tokens(text: str) -> int:
    """The estimate of a text's tokens: a quarter of its UTF-16 length, rounded up."""
    return -(-len(text.encode("utf-16-le", "surrogatepass")) // 8)


def base_name(path: str) -> str:
    """The last segment of a path."""
    return os.path.basename(path)
