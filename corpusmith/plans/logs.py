"""Queries on events, orders and changes as logs."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusmith.operators import evaluation, history, manifest
from corpusmith.plans.registry import Registry
from corpusmith.sources.tables import table

LOGS = Registry()


@LOGS.add("select event_type as route, count(*) requests, count(*) filter (value >= 40) errors, round(avg(value), 1) avg_ms, round(quantile_disc(value, 0.95), 1) p95_ms from events group by 1")
def route_rollup(spark, directory):
    """Requests, errors, mean and 95th percentile of each route."""
    rows = table(spark, directory, "events").select(F.col("event_type").alias("route"), F.when(F.col("value") >= 40, 500).otherwise(200).alias("status"), "value")
    return history.route_rollup(rows, "route", "status", "value")


@LOGS.add("select user_id, count(*) filter (event_type = 'error') errors, count(*) filter (event_type = 'view') views, count(*) filter (event_type not in ('error', 'view')) others from events group by 1")
def filtered_counts(spark, directory):
    """Counts by status."""
    kind = F.col("event_type")
    return table(spark, directory, "events").groupBy("user_id").agg(F.count_if(kind == "error").alias("errors"), F.count_if(kind == "view").alias("views"), F.count_if(~kind.isin("error", "view")).alias("others"))


@LOGS.add("""select user_id, session, min(ts) started, max(ts) ended, count(*) events from (select *, sum(f) over (partition by user_id order by ts, event_id rows unbounded preceding)::bigint as session
from (select *, (lag(ts) over w is null or ts > lag(ts) over w + interval 30 minute)::bigint f from events window w as (partition by user_id order by ts, event_id))) group by all""")
def sessions_by_idle_gap(spark, directory):
    """Sessions that end after 30 idle minutes."""
    rows = table(spark, directory, "events")
    return history.sessions(rows, "user_id", "ts")


@LOGS.add("""select event_id, recent, recent >= 3 rejected from (select event_id, count(*) over (partition by user_id order by epoch_us(ts) range between 86399999999 preceding and current row) - 1 recent from events)""")
def rate_limit(spark, directory):
    """K8: events whose user had three or more in the trailing day."""
    return history.rate_limited(table(spark, directory, "events"), "user_id", "ts", 3, 86400).select("event_id", "recent", "rejected")


@LOGS.add("""select session_id, sequence, epoch_us(min(received_at)) received_us from sync_changes group by all""")
def inbox_first(spark, directory):
    """K7: the first delivery of every change."""
    first, _ = history.inbox(table(spark, directory, "sync_changes"), ["session_id", "sequence"], "path", "received_at")
    return first.select("session_id", "sequence", F.unix_micros("received_at").alias("received_us"))


@LOGS.add("""select session_id, sequence, count(distinct path) bodies, count(*) deliveries from sync_changes group by all having count(distinct path) > 1""")
def inbox_conflicts(spark, directory):
    """K7: changes that were delivered with different bodies."""
    return history.inbox(table(spark, directory, "sync_changes"), ["session_id", "sequence"], "path", "received_at")[1]


@LOGS.add("""select user_id, least(n, 100) n, p from (select user_id, count(*) n, quantile_disc(value, 0.95) p from (select *, row_number() over (partition by user_id order by event_id desc) k from events) where k <= 100 group by 1)""")
def rolling_last_n(spark, directory):
    """The 95th percentile of each user's last 100 values; the number is the feature."""
    return history.last_n_percentile(table(spark, directory, "events"), "user_id", "event_id", "value", 100)


@LOGS.add("""with s as (select *, ['queued', 'running', 'succeeded', 'failed'][(hash_ % 4) + 1] st from (select event_id, user_id, (value * 100)::bigint % 4 hash_ from events)),
l as (select event_id, user_id, st, lag(st) over (partition by user_id order by event_id) p from s)
select event_id, user_id, st as status, p as previous from l where not coalesce((p is null and st = 'queued') or (p = 'queued' and st in ('running', 'failed')) or (p = 'running' and st in ('succeeded', 'failed', 'queued', 'running')) or (p = 'failed' and st = 'queued'), false)""")
def broken_transitions(spark, directory):
    """K9: rows of a job log whose state can't follow on the one before."""
    states = F.array(*map(F.lit, ("queued", "running", "succeeded", "failed")))
    rows = table(spark, directory, "events").select("event_id", "user_id", states[(F.round(F.col("value") * 100).cast("long") % 4).cast("int")].alias("status"))
    return history.broken_transitions(rows, "user_id", "event_id", "status")


@LOGS.add("""select event_id, user_id, event_type from (select *, lag(event_type) over w b, row_number() over w n from events window w as (partition by user_id order by event_id)) where n = 1 or b is distinct from event_type""")
def status_changes(spark, directory):
    """Events that differ from the one before of their user."""
    return history.changes_only(table(spark, directory, "events").select("event_id", "user_id", "event_type"), "user_id", "event_id", "event_type")


_JOBS = """select o_orderkey job_id, 'cust' || o_custkey % 50 target, case o_orderstatus when 'F' then 'succeeded' when 'O' then 'failed' else 'queued' end status, 1 + o_orderkey % 4 attempts, (o_totalprice * 100)::bigint bytes, 10.0 + o_orderkey % 1000 duration_ms, o_orderdate finished from orders"""


@LOGS.add(f"""with j as ({_JOBS}), l as (select target, max((finished, job_id)) m from j where status = 'succeeded' group by 1)
select j.target, count(*) filter (status = 'succeeded') succeeded, count(*) filter (status = 'failed') failed, sum(greatest(attempts - 1, 0))::bigint retries, coalesce(sum(bytes) filter (status = 'succeeded'), 0)::bigint bytes,
round(avg(duration_ms) filter (status = 'succeeded'), 4)::double avg_ms, (max(duration_ms) filter (status = 'succeeded'))::double max_ms, round(sum(bytes) filter (status = 'succeeded') * 1000.0 / sum(duration_ms) filter (status = 'succeeded'), 4)::double bytes_per_s,
count(*) filter (status = 'failed' and (m is null or (finished, job_id) > m)) failures_since, max(m[1]) last_success from j left join l on l.target = j.target group by j.target""")
def replication_metrics(spark, directory):
    """Outcomes, retries, throughput and failures since the last success of each target."""
    key = F.col("o_orderkey")
    jobs = table(spark, directory, "orders").select(
        key.alias("job_id"), F.concat(F.lit("cust"), (F.col("o_custkey") % 50).cast("string")).alias("target"), F.when(F.col("o_orderstatus") == "F", "succeeded").when(F.col("o_orderstatus") == "O", "failed").otherwise("queued").alias("status"),
        (1 + key % 4).alias("attempts"), F.round(F.col("o_totalprice") * 100).cast("long").alias("bytes"), (F.lit(10.0) + key % 1000).alias("duration_ms"), F.col("o_orderdate").alias("finished"),
    )
    return history.replication_metrics(jobs, "target")


@LOGS.add("""select event_id, make_timestamp((epoch_us(ts) + (floor((epoch_us(timestamp '2024-02-01 00:00:00') - epoch_us(ts)) / (3600000000.0 * (1 + event_id % 5))) + 1)::bigint * 3600000000 * (1 + event_id % 5))::bigint) as next_run from events""")
def next_interval_runs(spark, directory):
    """The next time of periodic runs."""
    due = F.col("ts").cast("timestamp")
    run = history.next_interval_run(due, F.lit("2024-02-01 00:00:00").cast("timestamp"), 3600 * (1 + F.col("event_id") % 5))
    return table(spark, directory, "events").select("event_id", run.cast("timestamp_ntz").alias("next_run"))


@LOGS.add("""select event_id, least(60000, 1000 * pow(2, least(greatest(event_id % 12 - 1, 0), 6)))::bigint delay_ms from events""")
def retry_delays(spark, directory):
    """Bounded exponential delays."""
    return table(spark, directory, "events").select("event_id", history.retry_delay_ms(F.col("event_id") % 12, 1000, 60000, 6).alias("delay_ms"))


@LOGS.add("""select event_id, (props::json->>'k')::bigint k, json_type(props::json, '$.k') in ('UBIGINT', 'BIGINT') numeric from events""")
def json_access(spark, directory):
    """A number in a JSON column, and whether it is one."""
    v = F.parse_json("props")
    return table(spark, directory, "events").select("event_id", F.try_variant_get(v, "$.k", "bigint").alias("k"), (F.schema_of_variant(F.variant_get(v, "$.k", "variant")) == "BIGINT").alias("numeric"))


_RESULTS = "select l_orderkey case_id, l_linenumber rank, 'src/part' || l_partkey % 20 || '.ts' path from lineitem"
_GOLD = "select o_orderkey case_id, ['part' || o_orderkey % 20 || '.ts', 'part' || o_orderkey % 7 || '.ts'] expected, 5 top_k from orders"


@LOGS.add(f"""with r as ({_RESULTS}), g as (select case_id, list_distinct(expected) expected, top_k from ({_GOLD})),
h as (select g.case_id, rank, list_filter(expected, lambda e: contains(path, e)) met from r join g using (case_id) where rank <= top_k),
b as (select case_id, len(list_distinct(flatten(list(met)))) found, min(rank) filter (len(met) > 0) fst, sum(case when len(met) > 0 then 1 / log2(rank + 1) else 0 end) dcg from h group by 1),
i as (select g.*, found, fst, dcg, list_sum(list_transform(range(1, least(len(expected), top_k) + 1), lambda x: 1 / log2(x + 1))) ideal from g left join b using (case_id))
select case_id, round(coalesce(found, 0) / len(expected), 6) recall, round(coalesce(1 / fst, 0), 6) mrr, round(least(1.0, coalesce(dcg, 0) / ideal), 6) ndcg, coalesce((fst <= 1)::int, 0) top1, coalesce((fst <= 3)::int, 0) top3, coalesce((fst <= 5)::int, 0) top5 from i""")
def ir_metrics(spark, directory):
    """Recall, reciprocal rank, gain and top places of every case."""
    return evaluation.ranking_metrics(*_cases(spark, directory))


def _cases(spark, directory):
    part = lambda c, n: F.concat(F.lit("part"), (F.col(c) % n).cast("string"), F.lit(".ts"))
    results = table(spark, directory, "lineitem").select(F.col("l_orderkey").alias("case_id"), F.col("l_linenumber").alias("rank"), F.concat(F.lit("src/"), part("l_partkey", 20)).alias("path"))
    gold = table(spark, directory, "orders").select(F.col("o_orderkey").alias("case_id"), F.array(part("o_orderkey", 20), part("o_orderkey", 7)).alias("expected"), F.lit(5).alias("top_k"))
    return results, gold


@LOGS.add(f"""with g as (select case_id, list_distinct(list_transform(expected, lambda e: 'src/' || e)) expected, top_k from ({_GOLD})), r0 as (select case_id, path, min(rank) rank from ({_RESULTS}) group by all),
r as (select case_id, path, row_number() over (partition by case_id order by rank, path) rank from r0),
h as (select g.case_id, rank, list_filter(expected, lambda e: path = e) met from r join g using (case_id) where rank <= top_k),
b as (select case_id, len(list_distinct(flatten(list(met)))) found, min(rank) filter (len(met) > 0) fst, sum(case when len(met) > 0 then 1 / log2(rank + 1) else 0 end) dcg from h group by 1),
i as (select g.*, found, fst, dcg, list_sum(list_transform(range(1, least(len(expected), top_k) + 1), lambda x: 1 / log2(x + 1))) ideal from g left join b using (case_id))
select case_id, round(coalesce(found, 0) / len(expected), 6) recall, round(coalesce(1 / fst, 0), 6) mrr, round(least(1.0, coalesce(dcg, 0) / ideal), 6) ndcg, coalesce((fst <= 1)::int, 0) top1, coalesce((fst <= 3)::int, 0) top3, coalesce((fst <= 5)::int, 0) top5 from i""")
def ir_metrics_strict(spark, directory):
    """I32: the same with equal paths that count once."""
    results, gold = _cases(spark, directory)
    return evaluation.ranking_metrics(results, gold.withColumn("expected", F.transform("expected", lambda e: F.concat(F.lit("src/"), e))), strict=True)


@LOGS.add("""with m as (select o_orderpriority suite, o_totalprice v, o_custkey * 1.0 w from orders) select round(avg(v), 6)::double v, round(avg(w), 6)::double w from (select suite, avg(v) v, avg(w) w from m group by 1)""")
def macro_average(spark, directory):
    """The mean over suites of their means."""
    rows = table(spark, directory, "orders").select(F.col("o_orderpriority").alias("suite"), F.col("o_totalprice").alias("v"), (F.col("o_custkey") * 1.0).alias("w"))
    return evaluation.macro_average(rows, "suite", ["v", "w"])


_RUNS = "select l_orderkey case_id, l_linenumber // 2 repetition, case l_linenumber % 2 when 0 then 'base' else 'other' end variant, case when l_returnflag = 'R' then 'failed' else 'ok' end status, l_extendedprice v from lineitem"


@LOGS.add(f"""with r as ({_RUNS}), a as (select case_id, repetition, case when status = 'ok' then v end b from r where variant = 'base'), o as (select case_id, repetition, case when status = 'ok' then v end b from r where variant = 'other')
select coalesce(a.case_id, o.case_id) case_id, coalesce(a.repetition, o.repetition)::bigint repetition, a.b as before, o.b as after, o.b - a.b as delta, case when o.b - a.b is null then 'excluded' when o.b > a.b then 'improved' when o.b < a.b then 'regressed' else 'unchanged' end outcome
from a full join o on a.case_id = o.case_id and a.repetition = o.repetition""")
def paired_ab_delta(spark, directory):
    """Two variants side by side."""
    n = F.col("l_linenumber")
    runs = table(spark, directory, "lineitem").select(
        F.col("l_orderkey").alias("case_id"), F.floor(n / 2).alias("repetition"), F.when(n % 2 == 0, "base").otherwise("other").alias("variant"), F.when(F.col("l_returnflag") == "R", "failed").otherwise("ok").alias("status"), F.col("l_extendedprice").alias("v")
    )
    return evaluation.paired_deltas(runs, "base", "other", "v")


@LOGS.add("select o_orderpriority suite, avg(o_totalprice) >= 100 and avg(o_totalprice) <= 1e9 passes from orders group by 1")
def threshold_gate(spark, directory):
    """Whether each suite keeps its bounds."""
    return table(spark, directory, "orders").groupBy(F.col("o_orderpriority").alias("suite")).agg(F.avg("o_totalprice").alias("v")).select("suite", evaluation.gate(F.col("v"), 100, 1e9).alias("passes"))


@LOGS.add("""with f as (select distinct coalesce(lower(language), 'none') || ':' || workspace_id as name from files), c as (select distinct coalesce(lower(language), 'none') || ':' || workspace_id as name from workspace_sources)
select coalesce(f.name, c.name) as name, case when f.name is null then 'missing' else 'unexpected' end problem from f full join c on f.name = c.name where f.name is null or c.name is null""")
def suite_coverage(spark, directory):
    """H6: the languages of workspaces that the index lacks of the sources, and the other way."""
    named = lambda t: table(spark, directory, t).select(F.concat_ws(":", F.coalesce(F.lower("language"), F.lit("none")), "workspace_id").alias("name")).distinct()
    have, want = named("files"), named("workspace_sources")
    return want.exceptAll(have).withColumn("problem", F.lit("missing")).unionByName(have.exceptAll(want).withColumn("problem", F.lit("unexpected")))


@LOGS.add("""select channel, count(distinct case_id) cases, count(distinct generation) generations from (select l_orderkey case_id, unnest([l_returnflag, l_linestatus]) channel, l_suppkey % 7 generation from lineitem) group by 1""")
def trace_summary(spark, directory):
    """In how many cases each channel took part, and on how many generations."""
    rows = table(spark, directory, "lineitem").select(F.col("l_orderkey").alias("case_id"), F.explode(F.array("l_returnflag", "l_linestatus")).alias("channel"), (F.col("l_suppkey") % 7).alias("generation"))
    return rows.groupBy("channel").agg(F.count_distinct("case_id").alias("cases"), F.count_distinct("generation").alias("generations"))


@LOGS.add("select o_custkey patch, count(distinct o_orderpriority) files, sum(case when o_orderkey % 9 = 0 then 0 else o_orderkey % 9 end)::bigint added, sum(o_orderkey % 5)::bigint deleted from orders group by 1")
def patch_statistics(spark, directory):
    """Files and lines of every patch."""
    key = F.col("o_orderkey")
    line = F.concat_ws("\t", F.when(key % 9 == 0, "-").otherwise((key % 9).cast("string")), (key % 5).cast("string"), F.col("o_orderpriority"))
    return evaluation.patch_statistics(table(spark, directory, "orders").select(F.col("o_custkey").alias("patch"), line.alias("line")), "patch", "line")


@LOGS.add("""select c_nationkey, c_custkey, c_acctbal from (select *, row_number() over (partition by c_nationkey order by c_acctbal desc, c_custkey) n from customer) where n <= 3""")
def top_per_group(spark, directory):
    """The three richest customers of each nation; the number is the feature."""
    return manifest.newest(table(spark, directory, "customer").select("c_nationkey", "c_custkey", "c_acctbal"), ["c_nationkey"], [F.desc("c_acctbal"), F.col("c_custkey")], 3)


@LOGS.add("""select n_name as nation, r_name as region, count(*) orders, round(sum(o_totalprice), 2) total from orders join customer on c_custkey = o_custkey join nation on n_nationkey = c_nationkey join region on r_regionkey = n_regionkey group by all""")
def star_join(spark, directory):
    """Inner joins along keys, with a grouped sum."""
    read = lambda n: table(spark, directory, n)
    joined = read("orders").join(read("customer"), F.col("o_custkey") == F.col("c_custkey")).join(read("nation"), F.col("n_nationkey") == F.col("c_nationkey")).join(read("region"), F.col("r_regionkey") == F.col("n_regionkey"))
    return joined.groupBy(F.col("n_name").alias("nation"), F.col("r_name").alias("region")).agg(F.count("*").alias("orders"), F.round(F.sum("o_totalprice"), 2).alias("total"))
