"""Sources on recorded input."""

from __future__ import annotations

import json
import sqlite3

import pytest
from pyspark.sql import functions as F

from corpusmith.sources import commits, connectors, files, snapshots, web


def test_scan(spark, tmp_path):
    for name, data in {"src/a b.ts": b"const x = 1", "node_modules/m.ts": b"no", "bin.dat": bytes(200), "empty.md": b"", "docs/x.md": "# é".encode(), "skip/keep.py": b"x", "skip/y.py": b"y"}.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(data)
    got = {r.path: r for r in files.scan(spark, {"main": str(tmp_path)}, ["skip/*", "!skip/keep.py"]).collect()}
    assert set(got) == {"src/a b.ts", "docs/x.md", "skip/keep.py"} and got["docs/x.md"].content == "# é" and got["src/a b.ts"].language == "typescript"
    two = files.scan(spark, {"one": f"{tmp_path}/src", "two": f"{tmp_path}/docs"})
    assert {r.path for r in two.collect()} == {"one/a b.ts", "two/x.md"}


def test_ignore_rules():
    assert files.ignored("a/node_modules/b.ts", ["node_modules/"]) and not files.ignored("a/modules.ts", ["node_modules/"]) and not files.ignored("a/node_modules", ["node_modules/"])
    assert files.ignored("x/y.log", ["*.log"]) and not files.ignored("x/y.log", ["*.log", "!y.log"]) and files.ignored("top/a", ["/top/a"]) and not files.ignored("b/top/a", ["/top/a"])
    assert files.ignored("a/b/testdata/x", ["**/testdata/"]) and files.ignored("A.PNG", ["*.png"]) and files.ignored("cmake-build-x/a", ["cmake-build-*/"]) and not files.ignored("abc", ["a[x-z]c", "#abc", "", "  "])
    assert files.ignored("build/keep.ts", ["build/", "!build/keep.ts"])  # the folder is out
    assert files.nested_rules("a/b", "# no\n*.tmp\n/x\n!/y\n!z\n") == ["a/b/*.tmp", "a/b/x", "!a/b/y", "!a/b/z"] and files.nested_rules("", "*.tmp") == ["*.tmp"]


def test_nested_ignore_files(spark, tmp_path):
    tree = {".gitignore": "*.tmp\nlogs/\n", "a.tmp": "x", "a.ts": "x", "logs/b.ts": "x", "sub/.gitignore": "*.py\n!keep.tmp\n", "sub/c.py": "x", "sub/keep.tmp": "x", "sub/deep/d.py": "x", "sub/e.ts": "x", "image.png": "x", "note.weird": "x", "Makefile": "x", "Dockerfile.dev": "x", "vendor/v.ts": "x", ".env": "A=1", ".env.sample": "A="}
    for name, text in tree.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    got = {r.path: r.language for r in files.scan(spark, {"main": str(tmp_path)}).collect()}
    # names that begin with their only dot have no extension; the nested rule is anchored in its folder
    assert got == {"a.ts": "typescript", "sub/deep/d.py": "python", "sub/e.ts": "typescript", "Makefile": "makefile", "Dockerfile.dev": "dockerfile", ".gitignore": "text", "sub/.gitignore": "text"}
    assert {r.path for r in files.scan(spark, {"main": str(tmp_path)}, all_text=True).collect()} >= {"note.weird", "sub/keep.tmp", ".env.sample"}


def test_languages(spark):
    wanted = {"a.tsx": "tsx", "x.proto": "protobuf", "y.c++": "cpp", "z.mm": "objective-cpp", "GNUmakefile": "makefile", "build.gradle.kts": "gradle", "pom.xml": "xml", "d/Dockerfile.x": "dockerfile", "q.lua": "lua", "Gemfile": "text", ".bashrc": "text", "m.hcl": "hcl", "n.": "text"}
    got = spark.createDataFrame(list(wanted.items()), "path string, wanted string").select("path", "wanted", files.language_of(F.col("path")).alias("got")).collect()
    assert all(r.got == r.wanted for r in got), [r for r in got if r.got != r.wanted]


def test_web(spark):
    page = '<html><head><title> A &amp; <i>B</i> </title><script>x()</script></head><body><!-- no --><h1>Head</h1><p>One&nbsp;two<br>three&#33;</p><a href="/b/index.html?q=1">b</a><a href=\'c.html#f\'>c</a><a href="mailto:x@y">m</a><a href=d>next</a>next</body></html>'
    pages = spark.createDataFrame([("https://site.test/a/", page), ("https://site.test/b", "<p>no title</p>"), ("https://site.test/a/d", "<a href='/a/'></a>"), ("https://site.test/x", None), ("https://site.test/b%2fc/", "x"), ("https://site.test/a/index", "y")], "url string, html string")
    docs = {r.path: r for r in web.documents(pages).collect()}
    assert docs["website/a/index.md"].content == "# A & B\n\nSource: https://site.test/a/\n\nA & B\n\nHead\n\nOne two\n\nthree!\n\nb c m next next\n" and docs["website/b.md"].content.startswith("# /b\n\n")
    assert sum(p.startswith("website/a/index--") for p in docs) == 1 and len(docs) == 5
    links = pages.limit(1).select(web.links_of(F.col("html"), F.col("url")).alias("l")).first().l
    assert links == ["https://site.test/a/c.html#f", "https://site.test/a/d", "https://site.test/b/index.html?q=1"]
    rules = web.robots_rules("User-agent: *\nDisallow: /private\nAllow: /private/open\n\nUser-agent: bad\nDisallow: /", "mybot")
    paths = spark.createDataFrame([("/private/x",), ("/private/open/y",), ("/else",)], "p string")
    assert [r[0] for r in paths.select(web.robots_allowed(F.col("p"), rules)).collect()] == [False, True, True]
    found = web.crawl(pages, "https://site.test/a/", 2).collect()
    assert [(r.url, r.depth) for r in found] == [("https://site.test/a/", 0), ("https://site.test/a/d", 1)]
    assert web.crawl(pages, "https://site.test/a/", 2, most_bytes=len(page)).count() == 1
    odd = [("HTTPS://Site.Test", "https://site.test/"), ("https://u@site.test/a", None), ("https://site.test/a.pdf", None), ("https://site.test/a%zz", None), ("ftp://site.test/", None), ("https://site.test/a#b", None), (None, None)]
    assert [r.c for r in spark.createDataFrame(odd, "u string, w string").select(web.canonical(F.col("u")).alias("c")).collect()] == [w for _, w in odd]
    assert web.absolute_link("../../x/./y?a=1&amp;b", "https://s.test/p/q") == "https://s.test/x/y?a=1&b" and web.absolute_link("", "https://s.test/") is None


def test_commits(spark):
    s = commits.SEPARATOR
    text = ["junk", f"commit{s}abc{s}ab{s}Ann{s}2025-01-01{s}First: x", "src/a.ts", "", "src/b.ts", f"commit{s}def{s}de{s}Bo{s}2025-01-02{s}Second"]
    lines = spark.createDataFrame([("l", i, v) for i, v in enumerate(text)], "log string, n int, value string")
    got = {r.short: r for r in commits.parse_log(lines).collect()}
    assert got["ab"].files == ["src/a.ts", "src/b.ts"] and got["de"].files == [] and got["ab"].subject == "First: x"
    chunk = {r.path: r for r in commits.commit_chunks(commits.parse_log(lines)).collect()}
    assert chunk[".git/commits/ab"].language == "git-commit" and chunk[".git/commits/ab"].content == "commit ab 2025-01-01\nauthor: Ann\nsubject: First: x\nfiles:\n- src/a.ts\n- src/b.ts" and chunk[".git/commits/de"].end_line == 3


def test_snapshots(spark, tmp_path):
    tables = {
        "file": spark.createDataFrame([("a.ts", "h", "typescript", 1, 2)], snapshots.KINDS["file"]), "chunk": spark.createDataFrame([("c1", "a.ts", "typescript", 1, None, "é\n", None, "h")], snapshots.KINDS["chunk"]),
        "embedding": spark.createDataFrame([("c1", "m", 2, [0.5, -1.0])], snapshots.KINDS["embedding"]),
    }
    folder = f"file://{tmp_path}/snap"
    made = snapshots.export_snapshot(tables, folder, {"k": 1})
    manifest, back = snapshots.import_snapshot(spark, folder)
    assert manifest == made and all([tuple(r) for r in back[k].collect()] == [tuple(r) for r in tables[k].collect()] for k in tables)
    target = f"file://{tmp_path}/far"
    assert [snapshots.replicate(spark, folder, target, "main", n) for n in (2, 2, 1, 3)] == ["published", "already_current", "superseded", "published"]
    assert snapshots.import_snapshot(spark, snapshots.published(spark, target, "main"))[0] == made and snapshots.published(spark, target, "other") is None
    other = snapshots.export_snapshot({**tables, "embedding": tables["embedding"].limit(0)}, f"file://{tmp_path}/snap2")
    assert other["digest"] != made["digest"] and snapshots.replicate(spark, f"file://{tmp_path}/snap2", target, "main", 3) == "conflict"
    tables["chunk"].withColumn("path", F.lit("gone")).select(F.to_json(F.struct(F.lit("chunk").alias("type"), F.struct("*").alias("value"))).alias("value")).write.mode("overwrite").option("compression", "gzip").text(f"{folder}/chunk")
    with pytest.raises(ValueError):
        snapshots.import_snapshot(spark, folder)
    assert [snapshots.publication(*x) for x in [(None, 1, False), (3, 2, False), (3, 3, True), (3, 3, False)]] == ["published", "superseded", "already_current", "conflict"]


def test_connectors(spark, tmp_path):
    tree = {"truncated": False, "tree": [{"path": "a.ts", "type": "blob", "sha": "1", "size": 3}, {"path": "d", "type": "tree", "sha": "2"}, {"path": "../x", "type": "blob", "sha": "3", "size": 1}]}
    (tmp_path / "t.json").write_text(json.dumps(tree))
    listed = connectors.list_files(spark, "github", {"location": str(tmp_path / "t.json")})
    assert [tuple(r) for r in listed.collect()] == [("a.ts", "1", 3)]
    stored = spark.createDataFrame([("a.ts", "0"), ("b.ts", "1")], "path string, remote_revision string")
    assert sorted(tuple(r) for r in connectors.sync_plan(listed, stored).collect()) == [("a.ts", "upsert"), ("b.ts", "delete")]
    (tmp_path / "u.json").write_text(json.dumps({"truncated": True, "tree": tree["tree"]}))
    with pytest.raises(ValueError):
        connectors.list_files(spark, "github", {"location": str(tmp_path / "u.json")})
    with pytest.raises(ValueError):
        connectors.register("github", None)


def test_reading_and_cursors(spark, tmp_path):
    files = spark.createDataFrame([("a", "1", 3), ("b", "2", 9), ("c", "3", None), ("d", "9", 1)], "path string, revision string, bytes long")
    (tmp_path / "blobs.json").write_text("\n".join(json.dumps(x) for x in [{"sha": "1", "encoding": "base64", "content": "YWJj\n"}, {"sha": "2", "encoding": "base64", "content": "YWJj"}, {"sha": "3", "encoding": "utf-8", "content": "x"}]))
    got = {r.path: (r.content and bytes(r.content), r.problem) for r in connectors.read_files(spark, "github", {"blobs": str(tmp_path / "blobs.json")}, files).collect()}
    assert got == {"a": (b"abc", None), "b": (None, "another size"), "c": (None, "not base64"), "d": (None, "missing")}
    connectors.register("memory", lambda spark, config: spark.createDataFrame([("a", "1", None), ("n", "7", 4), ("../x", "1", 1)], "path string, revision string, bytes long"))
    commit = "a" * 40
    listed, cursor = connectors.list_since(spark, "memory", {"commit": commit}, None, files)
    assert sorted(tuple(r) for r in listed.collect()) == [("a", "1", 3), ("n", "7", 4)] and connectors.list_since(spark, "memory", {"commit": commit}, cursor, files)[0] is files
    with pytest.raises(ValueError):
        connectors.list_since(spark, "memory", {"commit": "main"}, None, files)
    with pytest.raises(ValueError):
        connectors.read_files(spark, "memory", {}, files)
    config = connectors.with_profile({}, {"name": "one", "root": "/a"})
    assert connectors.profile(config)["root"] == "/a" and connectors.profile({}) == {} and connectors.profile(connectors.with_profile(config, {"name": "two", "root": "/b"}), "two")["root"] == "/b"
    with pytest.raises(ValueError):
        connectors.profile(config, "three")


def test_sqlite(spark, tmp_path):
    path = str(tmp_path / "old.db")
    with sqlite3.connect(path) as db:
        db.execute("create table chunks (id text, n integer)")
        db.executemany("insert into chunks values (?, ?)", [(f"c{i}", i) for i in range(50)])
        db.execute("create table none (id text)")
    assert connectors.read_sqlite(spark, path, "chunks", "id string, n long").agg(F.sum("n")).first()[0] == 1225
    assert connectors.read_sqlite(spark, path, "none", "id string").count() == 0


def test_rules_and_settings(spark):
    found = spark.createDataFrame([("AGENTS.md", "be kind"), (".rules/a.md", "---\nalwaysApply: true\n---\nbody"), (".rules/b.md", "plain"), ("src/a.md", "no"), (".rules/c.bin", "no")], "path string, content string")
    assert [tuple(r) for r in connectors.workspace_rules(found).collect()] == [(".rules/a.md", True, "body"), ("AGENTS.md", True, "be kind"), (".rules/b.md", False, "plain")]
    assert connectors.parse_env("A=1 # c\nexport B='x y'\n# C=2\nbroken\n") == {"A": "1", "B": "x y"}
    assert connectors.settings({"n": 1, "on": False}, {"n": "5"}, {"on": "true"}) == {"n": 5, "on": True}
