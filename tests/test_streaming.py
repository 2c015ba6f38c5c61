"""Streams give what the batch forms give."""

from __future__ import annotations

from datetime import datetime, timedelta

from corpusmith.streaming import logs

SCHEMA = "event_id long, user string, at timestamp, value double"


def stream(spark, tmp_path, parts):
    folder = tmp_path / "in"
    folder.mkdir()
    for i, part in enumerate(parts):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.parquet(str(folder / f"p{i}"))
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(folder))


def collected(df, tmp_path, name):
    q = df.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return df.sparkSession.table(name).collect()


T = datetime(2025, 1, 1)
AT = lambda m: T + timedelta(minutes=m)
EVENTS = [[(1, "u", AT(0), 1.0), (2, "u", AT(5), 2.0)], [(3, "u", AT(70), 3.0), (2, "u", AT(5), 2.0)], [(4, "v", AT(600), 9.0)], [(5, "v", AT(900), 9.0)]]


def test_rollup_and_sessions(spark, tmp_path):
    df = stream(spark, tmp_path, EVENTS)
    rolled = {(r.user, r.started): (r.events, r.total) for r in collected(logs.windowed_rollup(df, "at", ["user"], "value"), tmp_path, "rolled")}
    assert rolled[("u", AT(70))] == (1, 3.0) and rolled[("u", AT(0))][1] >= 3.0
    sessions = {(r.user, r.started): r.events for r in collected(logs.idle_sessions(df, "at", "user"), tmp_path, "sessions")}
    assert sessions[("u", AT(70))] == 1 and ("u", AT(0)) in sessions


def test_inbox_and_limit(spark, tmp_path):
    df = stream(spark, tmp_path, EVENTS)
    assert sorted(r.event_id for r in collected(logs.idempotent(df, ["event_id"], "at"), tmp_path, "inbox")) == [1, 2, 3, 4, 5]
    limited = collected(logs.rate_limited(df, "user", "at", 1, 600), tmp_path, "limited")
    assert {(r.event_id, r.rejected) for r in limited} >= {(1, False), (2, True), (3, False), (4, False)}


def test_rolling_percentile(spark, tmp_path):
    df = stream(spark, tmp_path, EVENTS)
    seen = [(r.user, r.events, r.p) for r in collected(logs.rolling_percentile(df, "user", "at", "value", 2, 0.5), tmp_path, "rolling")]
    assert max(e for u, e, _ in seen if u == "u") == 4 and max(e for u, e, _ in seen if u == "v") == 2 and ("v", 2, 9.0) in seen


def test_keep_manifest(spark, tmp_path):
    table, schema, folder = str(tmp_path / "table"), "path string, h string, op string, n int", tmp_path / "changes"
    batches = [[("a", "1", "upsert", 0), ("b", "2", "upsert", 0), ("a", "9", "upsert", 5), ("b", None, "delete", 3)], [("a", "8", "upsert", 1), ("b", "3", "upsert", 2), ("c", "7", "upsert", 4)]]
    for i, part in enumerate(batches):  # the second batch brings older changes
        spark.createDataFrame(part, schema).coalesce(1).write.json(str(folder / f"p{i}"))
        changes = spark.readStream.schema(schema).option("recursiveFileLookup", True).json(str(folder))
        logs.keep_manifest(changes, table, ["path"], "n", "op", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination(120)
    now = lambda t: sorted((r.path, r.h) for r in logs.current_manifest(spark, t, ["path"], "n", "op").collect())
    assert now(table) == [("a", "9"), ("c", "7")]
    logs.compact_manifest(spark, table, str(tmp_path / "compact"), ["path"], "n", "op")
    assert now(str(tmp_path / "compact")) == [("a", "9"), ("c", "7")]
