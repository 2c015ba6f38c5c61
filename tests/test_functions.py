"""Tokens, queries, ranking and chunks by example."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from corpusmith.functions import query as Q, ranking
from corpusmith.functions.chunker import chunk_file
from corpusmith.functions.code import imports_of, names_of
from corpusmith.functions.tokens import plain_tokens, tokenize, tokens


@pytest.mark.parametrize(
    ("text", "wanted"),
    [
        ("用户权限校验", ["用户", "户权", "权限", "限校", "校验"]), ("détecter erreur", ["detecter", "erreur"]), ("getHTTPServer_url-path", ["get", "http", "server", "url", "path"]),
        ("ｆｕｌｌ width", ["full", "width"]), ("a b1 c", ["b1"]), (None, []), ("", []), ("租", ["租"]),
    ],
)
def test_tokenize(text, wanted):
    assert tokenize(text) == wanted


def test_token_columns(spark):
    df = spark.createDataFrame([("parseURLFast now",), (None,), ("",)], "t string")
    rows = df.select(tokens("t").alias("a"), plain_tokens(F.col("t")).alias("b")).collect()
    assert [(r.a, r.b) for r in rows] == [(["parse", "url", "fast", "now"],) * 2, ([], []), ([], [])]


@pytest.mark.parametrize(
    ("raw", "intent"),
    [("Where is Optional implemented and transformed?", "symbol"), ("IFileService how are files read and watched and closed by the workspace host", "mixed"), ("src/app/main.ts", "path"), ("why was retry removed", "history"), ("cache entries expire", "concept"), (None, "concept")],
)
def test_intent(raw, intent):
    assert Q.analyze(raw).intent == intent


def test_query_terms():
    q = Q.analyze("How does EmptyQueryCursor handle src/db/cursor.ts")
    assert q.identifiers == ["EmptyQueryCursor", "cursor.ts"] and q.paths == ["src/db/cursor.ts"] and "cursor" in q.expanded
    assert Q.symbol_hints(q) == ["EmptyQueryCursor", "cursor.ts"]
    assert Q.symbol_hints(Q.analyze("snapshot scheduler retries failed jobs")) == ["snapshotscheduler", "schedulerretries", "retriesfailed"]
    assert Q.path_hints(Q.analyze("snapshot EmptyCursor")) == ["emptycursor", "empty", "cursor", "snapshot/empty", "empty/cursor"]
    assert Q.fts_groups("stale cursor") == [["stale", "cursor"]]
    assert Q.fts_groups("") == []
    assert Q.fts_groups("find the longest expiration policy cursor bound") == [["expiration", "longest"], ["policy", "cursor", "bound", "find"]]
    assert [Q.score_path_hint(p, h) for p, h in [("a/db/cursor.ts", "db/cursor"), ("cursor.ts", "cursor"), ("cursors.ts", "cursor"), ("cursor.spec.ts", "cursor"), ("myCursor.ts", "cursor"), ("cursorable.ts", "cursor"), ("xcursorx.ts", "cursor")]] == [4.0, 3.2, 3.1, 3.0, 2.9, 2.7, 2.0]


def test_match_expression():
    told = lambda raw: Q.match_expression(Q.analyze(raw))
    assert told("EmptyQueryCursor handler") == '"empty" AND "query" AND "cursor"' and told("cache entries expire") == '"cache" OR "entries" OR "expire"' and told("") == '""'
    assert told("the of?") == '"the" OR "of"' and len(told(" ".join(f"word{i}" for i in range(40))).split(" OR ")) == 16


def test_subqueries():
    assert Q.subqueries(Q.analyze("short query")) == []
    plan = Q.subqueries(Q.analyze("Fix the SnapshotJob so that the replica retries, and then update src/cache/store.ts while keeping RawRangeDiff untouched"))
    assert 2 <= len(plan) <= 4 and plan[0] == ("RawRangeDiff", "identifier") and sum(len(t) for t, _ in plan) <= 360


def test_ranking():
    q = Q.analyze("cursor store")
    code = ranking.feature_score("src/cursor.ts", "typescript", "Cursor", "export class Cursor {}" * 5, q)
    assert code > max(ranking.feature_score("test/cursor.test.ts", "typescript", "Cursor", "export class Cursor {}" * 5, q), ranking.feature_score("docs/cursor.md", "markdown", None, "cursor", q))
    assert ranking.combine(1.0, 0.0, 0.0, "concept") == pytest.approx(0.45)
    assert ranking.combine(0.5, 2.2, 0.9, "mixed") == pytest.approx(0.22 * 0.5 + 0.4 * 0.761594 + 0.38 * 0.9 + 0.06, abs=1e-5)
    assert ranking.path_similarity("a/b/c.ts", "a/b/c.ts") == 1 and ranking.path_similarity("x/q/b/c.ts", "y/q/b/c.ts") == 0.85 and ranking.path_similarity("a/x.ts", "b/y.ts") == 0
    items = [{"final": 0.50, "path": "b.md"}, {"final": 0.49, "path": "a.ts"}, {"final": 0.9, "path": "z.md"}]
    assert [i["path"] for i in ranking.preferred(items)] == ["z.md", "a.ts", "b.md"]
    same = [{"final": 0.9, "path": "p/a/x.ts"}, {"final": 0.89, "path": "q/p/a/x.ts"}, {"final": 0.8, "path": "r/other.ts"}]
    assert [i["path"] for i in ranking.diversify(same, 2, 0.78)] == ["p/a/x.ts", "r/other.ts"]
    assert ranking.packed_tokens("a😀bc") == 2


TS = "import { a } from './util';\n\n// adds\nexport function add(x: number) {\n  return x; // }\n}\n\nexport class Box {\n" + "".join(f"  method{i}(v: string) {{\n    if (v) {{ return '{i}'; }}\n    return v + \"{'x' * 60}\";\n  }}\n\n" for i in range(40)) + "}\n"


def test_chunker_covers_code():
    chunks = chunk_file("src/box.ts", TS)
    lines = TS.split("\n")
    covered = {n for c in chunks for n in range(c["start_line"], c["end_line"] + 1)}
    assert {i + 1 for i, x in enumerate(lines) if x.strip()} <= covered
    assert any(c["symbol"] == "add" for c in chunks) and any(c["symbol"] == "Box.method7" for c in chunks)
    assert all(len(c["content"]) <= 3600 for c in chunks) and len({c["id"] for c in chunks}) == len(chunks)


def test_chunker_other_kinds():
    py = chunk_file("a.py", "import os\n\n@cache\ndef f():\n    return 1\n\nclass C:\n    def m(self):\n        pass\n")
    assert [c["symbol"] for c in py if c["symbol"]] == ["f", "f"]  # the name is looked for in the lines that are shared, too
    md = chunk_file("a.md", "# One\n\ntext of the first section\n\n## Two\n\nmore text here of section two\n\n# Three\n\nand the last of the sections\n")
    assert len(md) >= 2
    assert chunk_file("a.txt", None) == [] and chunk_file("a.txt", " \n ") == []
    long = chunk_file("a.txt", "\n".join("word " * 20 for _ in range(500)))
    assert all(len(c["content"]) <= 3600 for c in long) and long[-1]["end_line"] == 500


def test_names_and_imports():
    assert names_of("// function no()\nexport async function yes() {}\nclass K {}\nif (x) {}") == ["yes", "K"]
    assert names_of(None) == []
    assert imports_of("src/a/b.ts", "import x from '../c/d';\nconst y = require(\"fs\");\nexport * from './e'") == ["src/c/d", "fs", "src/a/e"]
    assert imports_of("p/q/m.py", "from .x import y\nfrom ..z.k import w\nimport os, re") == ["p/q/x", "p/z/k", "os", "re"]
    assert imports_of("m.go", 'import (\n "fmt"\n x "a/b"\n)') == ["fmt", "a/b"]
    assert imports_of(None, "x") == []
