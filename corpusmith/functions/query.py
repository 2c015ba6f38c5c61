"""What a query asks for: identifiers, paths, intent, and the terms each channel looks up."""

from __future__ import annotations

import os.path
import re
from dataclasses import asdict, dataclass

import pandas as pd
from pyspark.sql import functions as F, types as T

from corpusmith.functions import rules
from corpusmith.functions.tokens import tokenize


@dataclass
class Query:
    """An analyzed query."""

    raw: str
    intent: str
    identifiers: list[str]
    tokens: list[str]
    expanded: list[str]
    paths: list[str]
    history: bool


_WORDS = T.ArrayType(T.StringType())
QUERY_TYPE = T.StructType(
    [T.StructField("raw", T.StringType()), T.StructField("intent", T.StringType()), *(T.StructField(n, _WORDS) for n in ("identifiers", "tokens", "expanded", "paths")), T.StructField("history", T.BooleanType())]
)


def _unique(values) -> list[str]:
    return list(dict.fromkeys(values))


def analyze(raw: str | None) -> Query:
    """The parts of a query and its intent; a null query is an empty one."""
    raw = raw or ""
    paths = _unique(rules.PATH_HINT.findall(raw))
    names = _unique(n for n in rules.IDENTIFIER.findall(raw) if len(n) > 2 and n.lower() not in rules.CAPITALIZED_PROSE)
    tokens = [t for t in tokenize(raw) if t not in rules.QUERY_STOP_WORDS]
    pieces = [p.lower() for path in paths for p in re.split(r"[/.]", path) if len(p) > 1]
    expanded = _unique([*tokens, *(t for n in names for t in tokenize(n)), *pieces])
    history = bool(rules.HISTORY_WORDS.search(raw))
    strong = any(len(n) >= 8 or "_" in n or n != n.lower() for n in names)
    if history:
        intent = "history"
    elif paths:
        intent = "mixed" if strong else "path"
    elif strong:
        intent = "symbol" if len(tokens) <= 6 else "mixed"
    else:
        intent = "concept"
    return Query(raw, intent, names, tokens, expanded, paths, history)


@F.pandas_udf(QUERY_TYPE)
def analyzed(raw: pd.Series) -> pd.DataFrame:
    """:func:`analyze` of a column, as a struct."""
    return pd.DataFrame([asdict(analyze(x)) for x in raw], columns=QUERY_TYPE.names)


def strong_identifier(name: str) -> bool:
    """Whether a name is clearly one: it has an inner capital, or is a capitalized word of seven letters."""
    return bool(re.search(r"[a-z0-9][A-Z]", name) or len(name) >= 7 and re.fullmatch(r"[A-Z][a-z0-9]+", name))


def priority_terms(query: Query) -> list[str]:
    """Long parts of the identifiers, longest first, each followed by its neighbours in the query."""
    parts = sorted(_unique(t for n in query.identifiers for t in tokenize(n) if len(t) >= 4), key=lambda t: -len(t))
    out: list[str] = []
    for part in parts:
        near = [part]
        if part in query.tokens:
            at = query.tokens.index(part)
            near += query.tokens[max(0, at - 1) : at] + query.tokens[at + 1 : at + 2]
        out += [t for t in near if len(t) >= 4 and t not in out]
    return out


def fts_groups(raw: str, priority: list[str] | None = None) -> list[list[str]]:
    """The boolean full-text query as groups: a text must hold a term of every group. None if there are no terms."""
    terms = [t for t in _unique(tokenize(raw)) if t not in rules.FTS_STOP_WORDS]
    first = [t for t in _unique(t for p in priority or [] for t in tokenize(p)) if t in terms][:2]
    longest = sorted(terms, key=lambda t: -len(t))
    if len(first) == 2:
        rest = [t for t in longest if t not in first][: rules.FTS_SUPPORT]
        if rest:
            return [first, rest]
    elif not first and len(terms) > rules.FTS_TERMS:
        lead = terms[0]
        echoes = {lead + "s", lead + "es"}
        if lead in rules.GENERIC_LEADING_TERMS or any(t in echoes or lead in (t + "s", t + "es") for t in terms[1:]):
            return [longest[:2], longest[2 : 2 + rules.FTS_SUPPORT]]
    if len(terms) <= rules.FTS_TERMS:
        return [terms] if terms else []
    kept = first or terms[:1]
    return [kept + [t for t in longest if t not in kept][: rules.FTS_TERMS - len(kept)]]


def symbol_hints(query: Query, most: int = rules.MAX_IDENTIFIERS, natural: int = rules.MAX_NATURAL_SYMBOLS) -> list[str]:
    """Symbols to look up: the identifiers, or else compounds of the query's telling words."""
    if query.identifiers:
        return query.identifiers[:most]
    words = [t for t in query.tokens if len(t) >= 4 and t not in rules.SYMBOL_STOP_WORDS]
    joined = [a + b for a, b in zip(words, words[1:], strict=False) if len(a + b) <= 64][:3]
    suffixed = []
    for i, word in enumerate(words):
        ends = [s for s in rules.COMPOUND_SUFFIXES if word != s and word.endswith(s)]
        suffixed += [ends[0] + later for later in words[i + 1 : i + 4]] if ends else []
    found = _unique([*sorted(suffixed, key=len), *joined]) or _unique(words)
    return found[:natural]


def language_qualifier(word: str) -> bool:
    """Whether a word only names a programming language."""
    return word.strip().lower() in rules.LANGUAGE_QUALIFIERS


def path_hints(query: Query, most: int = rules.MAX_PATH_HINTS) -> list[str]:
    """Path fragments to look up, at most ``most``: explicit paths, capitalized identifiers, their parts and neighbours."""
    named = [n for n in query.identifiers if re.match(r"[A-Z]", n) and not language_qualifier(n)]
    wanted = list(query.paths)
    for name in named:
        wanted += [name, *(p for p in tokenize(name) if len(p) >= 4)]
    for name in named:
        for part in tokenize(name):
            at = query.tokens.index(part) if part in query.tokens else None
            after = query.tokens[at + 1] if at is not None and at + 1 < len(query.tokens) else ""
            before = query.tokens[at - 1] if at else ""
            if len(part) < 4:
                wanted += [after] if len(after) >= 4 else []
            elif len(before) >= 3 and not language_qualifier(before):
                wanted.append(f"{before}/{part}")
    return [h for h in _unique(w.strip().lower() for w in wanted) if len(h) >= 2][:most]


def _stem(path: str) -> tuple[str, str]:
    base = os.path.basename(path)
    return base, re.sub(r"\.[^.]+$", "", base)


def score_path_hint(path: str, hint: str) -> float:
    """How closely a path's file name answers a hint: from 4 for a fragment of several segments to 2 for any substring."""
    hint = hint.strip().lower()
    base, raw = _stem(path)
    stem = raw.lower()
    whole = re.sub(r"\.[^./]+$", "", path.replace("\\", "/").lower())
    ladder = [
        (4.0, "/" in hint and f"/{hint}/" in f"/{whole}/"), (3.2, stem == hint), (3.1, stem in (hint + "s", hint + "es")), (3.0, base.lower().startswith(hint + ".")),
        (2.9, hint in tokenize(raw)), (2.7, len(hint) >= 4 and stem.startswith(hint)),
    ]
    return next((score for score, holds in ladder if holds), 2.0)


def basename_affinity(path: str, query: Query) -> float:
    """How closely a file's name answers the words and identifiers of a query, from 0 to 1.75."""
    _, raw = _stem(path)
    stem, parts = raw.lower(), set(tokenize(raw))
    folder = os.path.basename(os.path.dirname(path)).lower()
    plural = lambda w: stem in (w + "s", w + "es")
    words = {w.lower() for w in re.findall(r"[A-Za-z0-9_-]+", query.raw) if len(w) >= 4 and not language_qualifier(w)}
    scores = [0.0]
    for w in words:
        scores.append(1.0 if stem == w else 0.8 if plural(w) else 0.92 if w in parts else 0.8 if stem.startswith(w) else 0.0)
    met = sum(any(p == w or min(len(p), len(w)) >= 4 and (p.startswith(w) or w.startswith(p)) for w in words) for p in parts)
    if met > 1:
        scores.append(min(1.75, 1 + 0.3 * (met - 1)))
    if folder == stem and any(map(plural, words)):
        scores.append(1.75)
    for name in query.identifiers:
        if language_qualifier(name):
            continue
        if strong_identifier(name) and stem == name.lower():
            scores.append(1.75)
        pieces = tokenize(name)
        for p in pieces:
            if len(p) >= 4:
                scores.append(0.85 if stem == p else (0.95 if len(pieces) > 1 else 0.78) if plural(p) else 0.78 if p in parts else 0.6 if stem.startswith(p) else 0.0)
    return max(scores)


def match_expression(query: Query, most: int = 16, fallback: int = 8) -> str:
    """A full-text match expression of quoted terms: all parts of the first identifier for a symbol's query, else any of the first ``most`` terms and identifiers."""
    clean = lambda t: re.sub(r'["*]', "", t).replace("'", "''")
    terms = _unique([c for t in query.expanded if len(t) > 1 and (c := clean(t))] + [c for n in query.identifiers if len(c := clean(n)) > 1])
    if not terms:
        words = [w for w in re.split(r"\s+", re.sub(r"[^\w\s.-]", " ", query.raw, flags=re.ASCII)) if len(w) > 1]
        return " OR ".join(f'"{w}"' for w in words[:fallback]) or '""'
    if query.intent == "symbol" and query.identifiers:
        name = re.sub(r"[\"*']", "", query.identifiers[0])
        parts = [p for p in tokenize(name) if len(p) > 1]
        return " AND ".join(f'"{p}"' for p in parts) if len(parts) > 1 else f'"{name}"'
    return " OR ".join(f'"{t}"' for t in terms[:most])


def subqueries(query: Query) -> list[tuple[str, str]]:
    """Focused parts (text, reason) of a long query with several facets; none for short or focused ones."""
    raw = query.raw.strip()
    if query.intent in ("symbol", "path") or len(query.tokens) < rules.TASK_TOKENS and len(raw) < rules.TASK_CHARS:
        return []
    ideas = [(n, "identifier") for n in sorted(query.identifiers, key=lambda n: -len(n))[:2]]
    if query.history and query.identifiers:
        ideas.append((" ".join(query.identifiers[:2]) + " history", "history"))
    for path in query.paths[:1]:
        ideas.append((" ".join([path, *[t for t in query.tokens if t not in path.lower()][:3]]), "path"))
    clauses = [c.strip(",.; \t\n\r\f\v") for c in rules.CLAUSE_BREAK.split(raw)]
    clauses = [c for c in clauses if sum(len(w) >= 2 for w in c.split()) >= 3]
    if len(clauses) > 1:
        ideas += [(c, "clause") for c in clauses[:2]]
    kept: list[tuple[str, str]] = []
    covered: list[set[str]] = []
    left = rules.PLAN_CHARS
    for text, reason in ideas:
        text = text.strip()[: rules.SUBQUERY_CHARS].strip()
        words = {w for w in re.split(r"[^a-z0-9_]+", text.lower()) if w}
        if len(kept) < rules.SUBQUERIES and 3 <= len(text) <= left and words and not any(words <= c for c in covered):
            kept.append((text, reason))
            covered.append(words)
            left -= len(text)
    return kept if len(kept) > 1 else []
