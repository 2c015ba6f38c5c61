"""Packing what a search found into the budget of a prompt, query by query."""

from __future__ import annotations

from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from corpusmith.functions.query import Query, analyze
from corpusmith.functions.ranking import packed_tokens

#: Characters of a token, and the part of the budget that rules may take.
CHARS, RULE_SHARE = 4, 4
#: Share of the shorter passage's lines, and characters of a contained text, from which on passages repeat each other; rules that are read at most.
REPEATED, PASSAGE, MAX_RULES = 0.8, 80, 24
#: What stands for lines that are left out (fixed value).
ELISION = "… [unrelated lines omitted]"


def estimated_tokens(text: Column) -> Column:
    """A quarter of the UTF-16 length, rounded up."""
    return F.ceil(F.octet_length(F.encode(text, "UTF-16BE")) / 8).cast("long")


def preview(text: Column, most: int = 220) -> Column:
    """The text on one line, at most ``most`` characters, the last an ellipsis where it was longer."""
    line = F.trim(F.regexp_replace(text, r"\s+", " "))
    return F.when(F.length(line) > most, F.concat(F.substring(line, 1, most - 1), F.lit("…"))).otherwise(line)


def line_range(content: Column, first: Column, last: Column) -> Column:
    """The lines from ``first`` to ``last`` (from 1, both kept within the text)."""
    lines = F.split(content, "\n", -1)
    a = F.least(F.greatest(first, F.lit(1)), F.size(lines))
    z = F.least(F.greatest(last, a), F.size(lines))
    return F.array_join(F.slice(lines, a, z - a + 1), "\n")


def salient(text: str, terms: list[str]) -> str | None:
    """The lines that hold a term of three letters or more, with their neighbours and marks for what is left out.

    None if that saves nothing: the text has three lines or fewer, no line is met, or all are kept.
    """
    lines, words = text.split("\n"), [t.lower() for t in terms if len(t) >= 3]
    met = [i for i, line in enumerate(lines) if any(w in line.lower() for w in words)]
    kept = sorted({j for i in met for j in (i - 1, i, i + 1) if 0 <= j < len(lines)})
    if len(lines) <= 3 or not kept or len(kept) == len(lines):
        return None
    out, before = [], -1
    for i in kept:
        if i > before + 1:
            out.append(ELISION)
        out.append(lines[i])
        before = i
    return "\n".join(out + [ELISION] * (before < len(lines) - 1))


@F.pandas_udf(T.StringType())
def salient_part(content: pd.Series, terms: pd.Series) -> pd.Series:
    """:func:`salient` of two columns; null texts give null."""
    return pd.Series([None if c is None else salient(c, list(t) if t is not None else []) for c, t in zip(content, terms, strict=True)], dtype=object)


def repeats(a: dict, b: dict) -> bool:
    """Whether two passages of a file say the same: by id or hash, span, four fifths of the shorter's lines, or containment of longer texts."""
    if a["id"] == b["id"] or a["hash"] and a["hash"] == b["hash"]:
        return True
    (a0, a1), (b0, b1) = (sorted((x["start_line"], x["end_line"])) for x in (a, b))
    if (a0, a1) == (b0, b1) or max(0, min(a1, b1) - max(a0, b0) + 1) >= REPEATED * min(a1 - a0 + 1, b1 - b0 + 1):
        return True
    x, y = sorted((" ".join(c["content"].split()).lower() for c in (a, b)), key=len)
    return len(x) >= PASSAGE and x in y


def in_rounds(hits: list[dict]) -> list[dict]:
    """Ranked hits (with score) in rounds: the best passage of every file, then the second best, without passages that repeat a better one of their file.

    Files come by their best score, equal ones in the order in which the ranking first names them.
    """
    files: dict[str, list[dict]] = {}
    for hit in hits:
        files.setdefault(hit["path"], []).append(hit)
    groups = []
    for own in files.values():
        kept: list[dict] = []
        for hit in sorted(own, key=lambda h: -h["score"]):
            if not any(repeats(k, hit) for k in kept):
                kept.append(hit)
        groups.append(kept)
    groups.sort(key=lambda g: -g[0]["score"])
    return [g[n] for n in range(max(map(len, groups), default=0)) for g in groups if n < len(g)]


def rules_section(rules: list[dict], most: int) -> str:
    """Workspace rules (path, always, content) as a text of at most ``most`` characters; none for no rules."""
    if not rules:
        return ""
    blocks = [f"## Rule: {r['path'].rsplit('/', 1)[-1]} ({'always' if r['always'] else 'agent-requested'})\nsource: {r['path']}\n\n{r['content'].strip()}" for r in rules]
    return ("# Workspace rules\n\nRepository conventions the change must follow.\n\n" + "\n\n".join(blocks))[: max(0, most)]


@dataclass
class Pack:
    """A context in the making: blocks of text within a number of characters."""

    budget: int
    blocks: list[str] = field(default_factory=list)
    used: int = 0

    def add(self, block: str) -> bool:
        """Takes a block if it fits."""
        if self.used + len(block) > self.budget:
            return False
        self.blocks.append(block)
        self.used += len(block)
        return True


def pack(header: str, rules: list[dict], hits: list[dict], terms: list[str], tokens: int, most: int = 40) -> dict:
    """The context for one query: a header, rules up to a quarter of the budget, and hits (with score) in rounds.

    A hit that doesn't fit whole is shortened to its salient lines and packing goes on; if even
    these don't fit, it is cut to what is left and packing ends.
    """
    own = Pack(tokens * CHARS)
    ordered = in_rounds(hits)[:most]
    place = lambda hit: f"## {hit['path']}:{hit['start_line']}-{hit['end_line']}\n"
    first = len(place(ordered[0])) + 1 if ordered else 0
    whole = own.add(header[: max(0, own.budget - first) if first <= own.budget else own.budget]) and own.used == len(header)
    if whole and rules:
        section = rules_section(rules, own.budget // RULE_SHARE - own.used)
        own.add(f"\n{section}\n" if section else "")
    taken: list[dict] = []
    kept: list[str] = []
    for hit in ordered:
        head = "\n" * bool(own.used) + place(hit)
        if own.add(head + hit["content"] + "\n"):
            kept.append("raw")
        elif (short := salient(hit["content"], terms)) and own.add(head + short + "\n"):
            kept.append("extractive")
        else:
            left = own.budget - own.used - len(head)
            if left < 0 or not own.add(head + hit["content"][:left]):
                break
            kept.append("cut")
        taken.append(hit)
        if kept[-1] == "cut":
            break
    text = "".join(own.blocks)
    return {"context": text, "n_hits": len(taken), "ids": [t["id"] for t in taken], "kept": kept, "tokens": packed_tokens(text), "candidates": len(hits), "files": len({t["path"] for t in taken}), "truncated": not whole or len(taken) < len(ordered) or any(k != "raw" for k in kept)}


def context_header(query: Query, found: int) -> str:
    """What stands before the passages: the task, its intent and identifiers, and how many candidates there were."""
    named = [f"Identifiers: {', '.join(query.identifiers[:8])}"] if query.identifiers else []
    return "\n".join(["# Task context", "", f"Task: {query.raw}", f"Intent: {query.intent}", *named, "", f"Retrieved {found} candidate chunks; packing complementary passages by file.", ""])


def salient_terms(query: Query) -> list[str]:
    """The words of a query by which lines are kept: identifiers, tokens and their parts of three letters or more."""
    return list(dict.fromkeys(t for t in (x.strip().lower() for x in [*query.identifiers, *query.tokens, *query.expanded]) if len(t) >= 3))


def pack_contexts(hits: DataFrame, tokens: int = 2000, most: int = 40, rules: DataFrame | None = None) -> DataFrame:
    """query_id, context, n_hits, ids, kept, tokens, candidates, files and truncated of ranked hits (query_id, query, place, id, path, hash, lines, content, and score or the place for it).

    Hits are bounded by the search that gave them, so a query's hits are packed in one group.
    ``rules`` (path, always, content) are a workspace's, of which :func:`workspace_rules` gives a bounded number.
    """
    told = [r.asDict() for r in rules.select("path", "always", "content").limit(MAX_RULES).collect()] if rules is not None else []

    def one(group: pd.DataFrame) -> pd.DataFrame:
        rows = group.sort_values("place").to_dict("records")
        for r in rows:
            r["end_line"] = int(r["end_line"]) if r["end_line"] == r["end_line"] and r["end_line"] is not None else int(r["start_line"])
        query = analyze(rows[0]["query"])
        found = pack(context_header(query, len(rows)), told, rows, salient_terms(query), tokens, most)
        return pd.DataFrame([{"query_id": rows[0]["query_id"], **found}])

    score = F.coalesce(F.col("score").cast("double"), -F.col("place")) if "score" in hits.columns else -F.col("place").cast("double")
    named = hits.select("query_id", "query", "place", "id", "path", F.coalesce("hash", F.lit("")).alias("hash"), "start_line", "end_line", F.coalesce("content", F.lit("")).alias("content"), score.cast("double").alias("score"))
    kind = named.schema["query_id"].dataType.simpleString()
    return named.groupBy("query_id").applyInPandas(one, f"query_id {kind}, context string, n_hits int, ids array<string>, kept array<string>, tokens int, candidates int, files int, truncated boolean")
