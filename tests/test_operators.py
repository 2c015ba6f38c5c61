"""Operators of the core on small tables: ties, nulls, empty tables."""

from __future__ import annotations

import math
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from corpusmith.functions.tokens import tokens
from corpusmith.operators import components, context, evaluation, fusion, graph, history, lexical, manifest, ordered, policy, retrieval, similarity
from corpusmith.operators.generations import Store
from corpusmith.sources.objects import Conflict, Objects


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_bm25_by_hand(spark):
    docs = spark.createDataFrame([(1, "lease lease worker"), (2, "worker"), (3, "other words")], "id long, text string")
    cut = docs.select("id", tokens("text").alias("t"))
    queries = spark.createDataFrame([(7, ["lease", "lease"]), (8, ["nothing"]), (9, [])], "query_id long, terms array<string>")
    scores = lexical.bm25(lexical.postings(cut, "id", F.col("t")), lexical.corpus_statistics(cut, F.col("t")), queries, "id")
    idf = math.log(1 + (3 - 1 + 0.5) / 1.5)
    want = 2 * idf * 2 * 2.4 / (2 + 1.4 * (0.25 + 0.75 * 3 / 2))
    assert [(r.query_id, r.id, pytest.approx(r.score)) for r in scores.collect()] == [(7, 1, want)]
    empty = docs.limit(0).select("id", tokens("text").alias("t"))
    assert lexical.bm25(lexical.postings(empty, "id", F.col("t")), lexical.corpus_statistics(empty, F.col("t")), queries, "id").count() == 0


def test_boolean_and_cover(spark):
    docs = spark.createDataFrame([(1, ["a1", "x1", "b1"]), (2, ["a1", "b1"]), (3, ["a1"])], "id long, t array<string>")
    index = lexical.postings(docs, "id", F.col("t"))
    groups = spark.createDataFrame([(1, [["a1"], ["b1", "c1"]])], "query_id long, groups array<array<string>>")
    assert rows(lexical.boolean_matches(index, groups, "id")) == [(1, 1), (1, 2)]
    score = {r.id: r.score for r in lexical.cover_density_scores(index, groups, "id").collect()}
    assert score[2] > score[1] > 0


def test_fusion(spark):
    lists = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (1, "a", 3), (1, "c", None)], "query_id long, id string, rank int")
    got = {r.id: r.rrf for r in fusion.reciprocal_ranks(lists, "id").collect()}
    assert got == {"a": pytest.approx(1 / 61 + 1 / 63), "b": pytest.approx(1 / 62)}
    blended = fusion.blend_scores(spark.createDataFrame([(1, 0.5, 2.0), (1, 0.4, 4.0), (2, 0.3, 1.0), (2, 0.2, 1.0)], "query_id long, final double, neural double"), 0.5)
    assert sorted(round(r.final, 3) for r in blended.collect()) == [0.2, 0.25, 0.3, 0.7]
    primary = spark.createDataFrame([(1, "a", 0.9), (1, "b", 0.5)], "query_id long, id string, score double")
    others = spark.createDataFrame([(1, 1, "b", 1), (1, 1, "c", 2), (1, 2, "d", 1), (1, 2, "c", 2)], "query_id long, sub int, id string, rank int")
    assert [(r.id, r.discovered) for r in fusion.append_discoveries(primary, others, "id", 5).orderBy(F.desc("score")).collect()] == [("a", False), ("b", False), ("c", True)]


def test_similarity(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0], [1.0, 1.0]), (2, [0.0, 0.0], [1.0, 1.0]), (3, [1.0], [1.0, 1.0]), (4, None, [1.0, 1.0])], "id long, a array<double>, b array<double>")
    got = {r.id: r.c for r in df.select("id", similarity.cosine(F.col("a"), F.col("b")).alias("c")).collect()}
    assert got == {1: pytest.approx(0.7071068), 2: 0.0, 3: None, 4: None}


def test_components_of_chain_and_star(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 140)] + [(7, 7), (500, 500), (None, 3)]
    got = dict(rows(components.connected_components(spark.createDataFrame(links, "a long, b long"))))
    assert {got[i] for i in range(41)} == {0} and {got[i] for i in range(100, 140)} == {100} and got[500] == 500
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_policy(spark):
    files = spark.createDataFrame([("a/b/c.ts",), ("a/bc.ts",), ("x.md",), (None,)], "path string")
    rules = spark.createDataFrame([("a", "allow"), ("./a/b/", "deny"), ("a/b", "allow"), ("x.md", "what"), (None, "deny")], "prefix string, effect string")
    assert rows(policy.allowed(files, rules, "deny")) == sorted([("a/b/c.ts", "deny"), ("a/bc.ts", "allow"), ("x.md", "deny"), (None, "deny")], key=repr)
    assert rows(spark.createDataFrame([("owner",), ("reader",), (None,), ("?",)], "p string").select(policy.permission_at_least(F.col("p"), "writer"))) == [(False,), (False,), (False,), (True,)]
    many = spark.createDataFrame([("p", "a"), ("p", "a/"), ("q", "b")], "policy_id string, prefix string")
    assert rows(policy.invalid_policies(many)) == [("p", "prefix occurs twice")]


def test_manifest(spark):
    now = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", None)], "path string, h string")
    was = spark.createDataFrame([("a", "1"), ("b", "x"), ("d", "4"), ("c", None)], "path string, h string")
    assert rows(manifest.difference(now, was, ["path"], "h")) == [("b", "upsert"), ("d", "delete")]
    assert rows(manifest.upsert(was, now, ["path"])) == sorted([("a", "1"), ("b", "2"), ("c", None), ("d", "4")], key=repr)
    index = was.withColumn("tokenizer_version", F.lit(2))
    assert rows(manifest.reindex_plan(now, index, ["path"], "h", 2)) == [("a", "keep"), ("b", "index"), ("c", "keep"), ("d", "drop")]
    assert {r.action for r in manifest.reindex_plan(now, index, ["path"], "h", 3).collect()} == {"index", "drop"}
    revisions = spark.createDataFrame([("12",), ("r:7",), ("abc",), (None,)], "r string").select(manifest.revision_number(F.col("r")).alias("n"))
    assert [r.n for r in revisions.collect()] == [12, 7, None, None]
    spans = spark.createDataFrame([("p", "s1", 1, 10), ("p", "s2", 200, None), ("q", "s3", 1, 5)], "path string, id string, start_line int, end_line int")
    symbols = spark.createDataFrame([("p", "wide", 1, 300, False, 1), ("p", "out", 9, 12, True, 2), ("p", "out2", 8, 11, True, 3)], "path string, name string, start_line int, end_line int, exported boolean, ordinal int")
    assert {r.id: r.name for r in manifest.widest_overlap(spans, symbols).collect()} == {"s1": "out", "s2": "wide", "s3": None}


def test_history(spark):
    t = datetime(2025, 1, 1)
    events = spark.createDataFrame([(i, "u", t + timedelta(minutes=m)) for i, m in enumerate([0, 10, 50, 51, 52])], "event_id long, user string, at timestamp")
    assert [(r.session, r.events) for r in history.sessions(events, "user", "at").orderBy("session").collect()] == [(1, 2), (2, 3)]
    limited = history.rate_limited(events, "user", "at", 2, 600).orderBy("event_id").collect()
    assert [(r.recent, r.rejected) for r in limited] == [(0, False), (0, False), (0, False), (1, False), (2, True)]
    log = spark.createDataFrame([("j", 1, "queued"), ("j", 2, "running"), ("j", 3, "succeeded"), ("j", 4, "running"), ("k", 1, "running")], "job string, n int, status string")
    assert rows(history.broken_transitions(log, "job", "n", "status").select("job", "n")) == [("j", 4), ("k", 1)]
    one = spark.range(1)
    run = one.select(history.next_interval_run(F.lit(t), F.lit(t + timedelta(minutes=25)), F.lit(600)).alias("r"), history.next_nightly_run(F.lit("2025-07-01 22:30:00").cast("timestamp"), "01:00", "Europe/Berlin").alias("n")).first()
    assert run.r == t + timedelta(minutes=30) and run.n == datetime(2025, 7, 1, 23, 0)
    cause = "code string, name string, status int"
    chains = [[("EACCES", None, None)], [(None, "Odd", None), ("ENOSPC", None, None)], [(None, "TimeoutError", 500)], [(None, None, 404)], [(None, "ExpiredToken", 403)], [], None, [(None, None, None)] * 4 + [("EPERM", None, None)]]
    kinds = spark.createDataFrame([(i, c) for i, c in enumerate(chains)], f"i int, c array<struct<{cause.replace(' string', ':string').replace(' int', ':int')}>>")
    got = [r.k for r in kinds.select("i", history.error_kind(F.col("c")).alias("k")).orderBy("i").collect()]
    assert got == ["permission", "capacity", "timeout", "not_found", "transient", "transient", "transient", "transient"]
    method = spark.createDataFrame([("get",), ("TRACE",), (None,)], "m string").select(history.normal_method(F.col("m")).alias("m"))
    assert [r.m for r in method.collect()] == ["GET", "OTHER", "OTHER"]
    route = one.select(history.normal_route(F.lit("/a/5?x=1"), [history.route_template("/a/{id}")]).alias("r"), history.normal_route(F.lit("/a/5/6"), [history.route_template("/a/{id}")]).alias("o")).first()
    assert (route.r, route.o) == ("/a/{id}", "other")


def test_evaluation_of_search(spark):
    text = {"src/lease.ts": "export class LeaseKeeper { renewLease() { return 1 } }", "src/quota.ts": "export function quotaOf(x) { return x }", "docs/a.md": "# nothing here"}
    index = retrieval.build_index(spark.createDataFrame([(p, p, "typescript" if p.endswith("ts") else "markdown", None, 1, 1, t, "h") for p, t in text.items()], "id string, path string, language string, symbol string, start_line int, end_line int, content string, hash string"))
    cases = spark.createDataFrame([("one", "LeaseKeeper renew lease", ["lease.ts"], 2), ("two", "quotaOf", ["quota.ts"], 2), ("three", "nothing like it zzz", ["gone.ts"], 1)], "case_id string, query string, expected array<string>, top_k int")
    got = {r.case_id: (r.recall, r.top1) for r in retrieval.evaluate(cases, index).collect()}
    assert got["one"] == (1.0, 1) and got["two"] == (1.0, 1) and got["three"] == (0.0, 0)
    assert {r.case_id: r.outcome for r in retrieval.compare_subqueries(cases, index).collect()} == dict.fromkeys(("one", "two", "three"), "unchanged")


def test_search_goes_on_without_services(spark):
    index = retrieval.build_index(spark.createDataFrame([(p, p, "typescript", None, 1, 1, f"export const lease{i} = 'lease worker {i}'", "h") for i, p in enumerate(["a.ts", "b.ts", "c.ts"])], "id string, path string, language string, symbol string, start_line int, end_line int, content string, hash string"))
    asked = spark.createDataFrame([(1, "lease worker")], "query_id long, raw string")

    def broken(df):
        raise OSError("no service")

    plain = [r.id for r in retrieval.search(asked, index, 3).orderBy("place").collect()]
    breakers = {}
    for _ in range(4):
        hits, degraded = retrieval.search_reliably(asked, index, 3, broken, broken, breakers)
        assert [r.id for r in hits.orderBy("place").collect()] == plain and degraded == ["semantic", "rerank"]
    assert not breakers["semantic"].allows()
    last = plain[-1]
    hits, degraded = retrieval.search_reliably(asked, index, 3, None, lambda df: df.withColumn("neural", (F.col("id") == last).cast("double")))
    assert degraded == [] and {r.id: r.final for r in hits.collect()}[last] > {r.id: r.final for r in retrieval.search(asked, index, 3).collect()}[last] * 0.6
    near = lambda df: df.select("query_id", F.lit(last).alias("id"), F.lit(0.9).alias("score"), F.lit(1).alias("rank"))
    assert [r.id for r in retrieval.search_reliably(asked, index, 3, near)[0].orderBy("place").collect()][0] == last


def test_ranges(spark):
    import math as m
    import random

    r = random.Random(4)
    data = [(r.choice(["a", "a", "a", "b", None]), r.randint(0, 30) if r.random() > 0.1 else None, i) for i in range(400)]
    df = spark.createDataFrame(data, "k string, v int, i int")
    groups: dict = {}
    for k, v, i in data:
        groups.setdefault(k, []).append((v is not None, v, i))
    want = sorted(((k, i, n + 1) for k, own in groups.items() for n, (_, _, i) in enumerate(sorted(own, key=lambda x: (x[0], x[1] or 0, x[2])))), key=repr)
    assert rows(ordered.ranked(df, ["k"], [F.col("v"), F.col("i")]).select("k", "i", "rank")) == want
    for share in (0.5, 0.95, 1.0):
        high = [(k, x[m.ceil(round(len(x) * share, 9)) - 1]) for k, own in groups.items() if (x := sorted(v for ok, v, _ in own if ok))]
        assert rows(ordered.nearest_rank(df, ["k"], "v", share, "p")) == sorted(high, key=repr)
    assert ordered.nearest_rank(df.limit(0), ["k"], "v", 0.5, "p").count() == 0 and ordered.ranked(df.limit(0), ["k"], [F.col("i")]).count() == 0
    sparse = df.withColumn("m", F.when(F.col("i") % 50 == 7, F.col("i")))
    last, wanted = {}, []
    for k, _, i in data:
        last[k] = i if i % 50 == 7 else last.get(k)
        wanted.append((k, i, last[k]))
    assert rows(ordered.carried(sparse, ["k"], "i", F.floor(F.col("i") / 20), "m", "c").select("k", "i", "c")) == sorted(wanted, key=repr)


def test_joins_of_tables(spark):
    sources = spark.createDataFrame([("w", "a", "AA"), ("w", "b", None), ("w", "c", "zz")], "workspace_id string, path string, blob_hash string")
    blobs = spark.createDataFrame([("aa", "one"), ("AA", "two"), ("bb", None), (None, "x")], "hash string, content string")
    assert rows(manifest.virtual_documents(sources, blobs).select("path", "content")) == [("a", "two")]
    assert manifest.virtual_documents(sources, blobs, sources.where("path = 'c'")).count() == 0
    assert rows(manifest.granted(sources, blobs, "workspace_id")) == [("w", "aa", True), ("w", "zz", False)]
    ids = spark.createDataFrame([(1, 1, "x"), (1, 2, "gone"), (1, 3, "y")], "query_id long, rank int, id string")
    chunks = spark.createDataFrame([("x", 1), ("x", 2), ("y", None)], "id string, n int")
    assert rows(manifest.in_order(ids, chunks)) == [(1, 1, "x", 2), (1, 3, "y", None)]
    changes = spark.createDataFrame([("k", "1", None), ("k", "2", 5), ("k", "2", 4)], "key string, a string, b int")
    assert rows(manifest.upsert(changes.limit(0), changes, ["key"])) == [("k", "2", 5)]
    queue = spark.createDataFrame([("a", "pending", 1, None, 0), ("b", "processing", 0, 0, 1), ("c", "processing", 0, 90, 1), ("d", "pending", None, None, 0)], "id string, status string, n long, l long, attempts long")
    queue = queue.withColumn("next_attempt_at", F.timestamp_seconds("n")).withColumn("locked_at", F.timestamp_seconds("l"))
    assert [(r.id, r.attempts, r.status) for r in history.claim(queue, F.timestamp_seconds(F.lit(100)), 20_000, 5, ["id"]).collect()] == [("b", 2, "processing"), ("a", 1, "processing")]


def test_evaluation(spark):
    results = spark.createDataFrame([("c", 1, "x.ts"), ("c", 2, "src/a.ts"), ("c", 3, "src/a.ts"), ("c", 4, "b.ts")], "case_id string, rank int, path string")
    gold = spark.createDataFrame([("c", ["a.ts", "zz"], 5), ("none", ["q"], 5), ("free", [], 5)], "case_id string, expected array<string>, top_k int")
    got = {r.case_id: r for r in evaluation.ranking_metrics(results, gold).collect()}
    assert (got["c"].recall, got["c"].mrr, got["c"].top1, got["c"].top3) == (0.5, 0.5, 0, 1) and got["none"].ndcg == 0 and got["free"].recall == 1
    strict = {r.case_id: r.recall for r in evaluation.ranking_metrics(results, gold, strict=True).collect()}
    assert strict["c"] == 0
    bad = spark.createDataFrame([("a", ["/x"], None), ("b", ["p"], ["p"]), ("c", ["p"], [])], "case_id string, expected array<string>, negatives array<string>")
    files = spark.createDataFrame([("p",)], "path string")
    assert set(rows(evaluation.invalid_gold(bad, files))) == {("a", "path is absent"), ("a", "path isn't canonical"), ("b", "expected and negative")}


def test_context():
    hit = lambda i, text, a=1, z=3, path="p.ts", score=0.5: {"id": i, "hash": i, "path": path, "start_line": a, "end_line": z, "content": text, "score": score}
    long = "\n".join(f"line {i} {'needle' if i == 50 else 'hay'}" for i in range(100))
    rule = {"path": "AGENTS.md", "always": True, "content": "be kind"}
    found = context.pack("# q\n", [rule], [hit("a", "short"), hit("a2", "short"), hit("b", long, 100, 200), hit("c", "x" * 5000, 300, 400)], ["needle"], 100)
    assert found["kept"] == ["raw", "extractive", "cut"] and len(found["context"]) <= 400 and "needle" in found["context"] and found["truncated"]
    wide = context.pack("# q\n", [rule], [hit("a", "short")], ["needle"], 1000)
    assert "## Rule: AGENTS.md (always)" in wide["context"] and wide["kept"] == ["raw"] and not wide["truncated"]
    # rounds: the best of each file first, by the best score of the file; repeated passages of a file are left out
    order = context.in_rounds([hit("p1", "a", score=0.5), hit("q1", "b", path="q.ts", score=0.9), hit("p2", "c", 10, 12, score=0.4), hit("p3", "d", 10, 12, score=0.3), hit("q2", "e", 50, 52, "q.ts", 0.1)])
    assert [h["id"] for h in order] == ["q1", "p1", "q2", "p2"] and context.in_rounds([]) == []
    assert context.pack("# q\n", [], [], [], 10)["n_hits"] == 0
    assert context.salient("a\nb", ["a"]) is None


def test_graph(spark):
    chunks = spark.createDataFrame([("1", "src/a.ts", 1), ("2", "src/b.ts", 1), ("3", "lib/c.ts", 1), ("4", "lib/c.ts", 9)], "id string, path string, start_line int")
    symbols = spark.createDataFrame([("Known", "4")], "name string, id string")
    edges = spark.createDataFrame([("src/a.ts", "src/b"), ("lib/c.ts", "src/a")], "source_path string, target string")
    seeds = spark.createDataFrame([(1, "1", "src/a.ts", ["Known"])], "query_id long, id string, path string, names array<string>")
    assert [(r.id, r.stage) for r in graph.expand(seeds, chunks, symbols, edges, 5).orderBy("place").collect()] == [("4", 0), ("2", 1), ("3", 2)]


def test_retrieval_ends(spark):
    schema = "id string, path string, language string, symbol string, start_line int, end_line int, content string, hash string"
    chunks = [
        ("1", "src/cursor.ts", "typescript", "EmptyCursor", 1, 9, "export class EmptyCursor { merge(lease) { return lease; } }", "h1"), ("2", "docs/cursor.md", "markdown", None, 1, 9, "# cursor\nthe lease cursor expires", "h2"),
        ("3", "src/other.ts", "typescript", None, 1, 2, "const unrelated = 1", "h3"), ("3", "src/other.ts", "typescript", None, 1, 2, "const unrelated = 1", "h3"), ("4", "src/null.ts", None, None, 1, None, "", None),
    ]
    index = retrieval.build_index(spark.createDataFrame(chunks, schema))
    asked = spark.createDataFrame([(1, "EmptyCursor lease"), (2, "zzz nothing here"), (3, None)], "query_id long, raw string")
    hits = retrieval.search(asked, index, 5).orderBy("query_id", "place").collect()
    assert [(h.query_id, h.path) for h in hits][0] == (1, "src/cursor.ts") and all(h.query_id == 1 for h in hits)
    none = retrieval.build_index(spark.createDataFrame([], schema))
    assert retrieval.search(asked, none, 5).count() == 0


def test_pieces_of_paths_are_never_sent(spark, monkeypatch):
    """Few hints are sent to the pieces of all paths, many are met by a sort; Spark would hold the pieces for small and collect them in the driver."""
    schema = "id string, path string, language string, symbol string, start_line int, end_line int, content string, hash string"
    paths = ["src/rank/policy.ts", "src/rank/policies.ts", "lib/ts/queue.go", "docs/policy/a.md"]
    index = retrieval.build_index(spark.createDataFrame([(str(i), p, None, None, 1, 2, "x", "h") for i, p in enumerate(paths)], schema))
    plans = spark.createDataFrame([(1, ["policy", "src/rank"]), (2, ["ts", "queue"]), (3, [])], "query_id long, hints array<string>")
    found = []
    for most, join in ((retrieval.SENT_HINTS, "BroadcastHashJoin"), (0, "SortMergeJoin")):
        monkeypatch.setattr(retrieval, "SENT_HINTS", most)
        hits = retrieval.path_channel(plans, index)
        plan = hits._jdf.queryExecution().sparkPlan().toString()
        assert plan.count(join) == plan.count("Join ") == 2 and "BuildLeft" not in plan
        found.append([(r.query_id, r.id, round(r.score, 6)) for r in hits.orderBy("query_id", "rank").collect()])
    assert found[0] == found[1] and [x[:2] for x in found[0]] == [(1, "0"), (1, "1"), (1, "3"), (2, "2"), (2, "0"), (2, "1")]


def test_generations(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/index")
    one = store.begin({"files": spark.createDataFrame([("a", 1), ("b", 2)], "path string, n int")})
    assert store.active() is None and store.state(one) == "ready"
    store.promote(one, 5)
    put = spark.createDataFrame([("b", 9), ("c", 3)], "path string, n int")
    two = store.begin_from_active({"files": (put, spark.createDataFrame([("a",)], "path string"), ["path"])})
    assert store.active() == one
    for bad in ((two, 4), ("gen-none", 9), (two, 6, "gen-other")):
        with pytest.raises(ValueError):
            store.promote(*bad)
    store.promote(two, 6, one)
    assert rows(store.read("files")) == [("b", 9), ("c", 3)] and store.revision() == 6 and (store.state(one), store.state(two)) == ("retired", "active")
    assert store.collect(older_ms=3_600_000) == [] and store.collect() == [one] and store.active() == two and store.state(one) is None
    with pytest.raises(ValueError):
        store.discard(two)


def test_two_writers(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/index")
    df = spark.createDataFrame([(1,)], "n int")
    one, two = store.begin({"t": df}), store.begin({"t": df})
    number, _ = store._active()
    store.promote(one, 1)
    with pytest.raises(Conflict):  # it read the value before the first promotion
        store._pointer.replace(number, b"{}")
    store.promote(two, 1)
    assert store.active() == two


def test_objects(spark, tmp_path):
    store = Objects(spark, f"file://{tmp_path}/o")
    assert store.get("a/b") is None and store.head("a/b") is None and store.list() == []
    store.put("a/b", b"one"), store.put("a/b", b"two"), store.put("c", b"")
    assert store.get("a/b") == b"two" and store.head("a/b") == 3 and [k for k, *_ in store.list()] == ["a/b", "c"] and [k for k, *_ in store.list("a/")] == ["a/b"]
    with pytest.raises(Conflict):
        store.put_absent("a/b", b"x")
    with pytest.raises(ValueError):
        store.get("../x")
    assert store.prefixed("a").get("b") == b"two" and store.within(30, "get", "a/b") == b"two" and store.delete("a/b") and not store.delete("a/b")
    assert all(store.probe().values()) and store.list("probe-") == []
