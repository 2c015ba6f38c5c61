"""Logs of requests, jobs and events: rollups, windows, state checks and retry times."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window, functions as F

from corpusmith.operators.ordered import nearest_rank


def p95(value: str, share: float = 0.95) -> Column:
    """The nearest-rank percentile: the value at place ceil(n * share) of the ordered ones; nulls don't count."""
    return F.expr(f"percentile_disc({share}) within group (order by {value})")


def route_rollup(requests: DataFrame, route: str, status: str, duration: str) -> DataFrame:
    """Per route: requests, errors (status from 400), avg_ms and p95_ms to a tenth; routes without durations have null for both.

    The percentile is the nearest rank over counted values, so a busy route is no single task.
    """
    counts = requests.groupBy(route).agg(F.count("*").alias("requests"), F.count_if(F.col(status) >= 400).alias("errors"), F.round(F.avg(duration), 1).alias("avg_ms"))
    high = nearest_rank(requests, [route], duration, 0.95, "_p95").select(F.col(route).alias("_route"), F.round("_p95", 1).alias("p95_ms"))
    return counts.join(high, F.col(route).eqNullSafe(F.col("_route")), "left").drop("_route")


# Methods that are told apart.
METHODS = "GET HEAD POST PUT PATCH DELETE OPTIONS".split()


def normal_method(method: Column) -> Column:
    """The method in capitals if it is one that is told apart, else ``OTHER``."""
    return F.when(F.upper(method).isin(*METHODS), F.upper(method)).otherwise("OTHER")


def normal_route(url: Column, templates: list[tuple[str, str]], other: str = "other") -> Column:
    """The template of the first pattern that a path matches whole, without its query and fragment; else ``other``."""
    path = F.regexp_replace(url, r"[?#].*$", "")
    chosen = None
    for pattern, template in templates:
        met = path.rlike(f"^(?:{pattern})$")
        chosen = F.when(met, template) if chosen is None else chosen.when(met, template)
    return F.lit(other) if chosen is None else chosen.otherwise(other)


def route_template(template: str) -> tuple[str, str]:
    """The pattern of a template whose parts in braces stand for one segment each: ``/a/{id}`` for ``/a/5``."""
    return "/".join("[^/]+" if part.startswith("{") and part.endswith("}") else re.escape(part) for part in template.split("/")), template


def sessions(events: DataFrame, user: str, at: str, idle: str = "30 minutes", block: str = "1 day") -> DataFrame:
    """Sessions by idle gaps: user, session (from 1), started, ended and events of each. Events without time don't count.

    A user's events are cut into blocks of time; each block's first gap is measured from the last
    event of the blocks before, and its sessions are numbered on from theirs.
    """
    micros = F.unix_micros(F.col(at).cast("timestamp"))
    width = F.expr(f"unix_micros(timestamp_seconds(0) + interval {block})")
    gap = F.expr(f"unix_micros(timestamp_seconds(0) + interval {idle})")
    placed = events.where(F.col(at).isNotNull()).select(user, at, micros.alias("_us")).withColumn("_b", F.floor(F.col("_us") / width))
    blocks, inside = Window.partitionBy(user).orderBy("_b"), Window.partitionBy(user, "_b").orderBy("_us")
    last = placed.groupBy(user, "_b").agg(F.max("_us").alias("_max")).withColumn("_before", F.lag("_max").over(blocks)).drop("_max")
    on = lambda a, b: a.join(b.withColumnRenamed(user, "_u").withColumnRenamed("_b", "_c"), F.col(user).eqNullSafe(F.col("_u")) & (F.col("_b") == F.col("_c")), "left").drop("_u", "_c")
    before = F.coalesce(F.lag("_us").over(inside), F.col("_before"))
    begun = on(placed, last).withColumn("_new", (before.isNull() | (F.col("_us") > before + gap)).cast("long"))
    starts = begun.groupBy(user, "_b").agg(F.sum("_new").alias("_n")).select(user, "_b", F.coalesce(F.sum("_n").over(blocks.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_sum"))
    numbered = on(begun.withColumn("session", F.sum("_new").over(inside.rowsBetween(Window.unboundedPreceding, 0))), starts).withColumn("session", F.col("session") + F.col("_sum"))
    return numbered.groupBy(user, "session").agg(F.min(at).alias("started"), F.max(at).alias("ended"), F.count("*").alias("events"))


def rate_limited(events: DataFrame, key: str, at: str, most: int = 60, seconds: int = 600) -> DataFrame:
    """Events with ``recent``, the events of their key in the trailing time, and ``rejected`` where these reach ``most``.

    The window's beginning is excluded and the event itself isn't counted; events at the same
    moment count among one another. A key's events are cut into blocks of the trailing time; each
    event is also counted with the next block, which is as far as a window reaches back.
    """
    span = seconds * 1_000_000
    micros = F.unix_micros(F.col(at).cast("timestamp"))
    order = Window.partitionBy(key, "_b").orderBy("_us").rangeBetween(-(span - 1), 0)
    block = F.floor(F.col("_us") / span)
    own = events.withColumn("_us", micros).withColumn("_b", block).withColumn("_own", F.lit(True))
    copies = own.select(*(F.col(c) if c in (key, "_us") else F.lit(None).cast(t).alias(c) for c, t in own.dtypes)).withColumn("_b", block + 1).withColumn("_own", F.lit(False))
    counted = own.unionByName(copies).withColumn("recent", F.count("*").over(order) - 1).where("_own")
    return counted.drop("_us", "_b", "_own").withColumn("rejected", F.col("recent") >= most)


def inbox(deliveries: DataFrame, keys: list[str], body: str, received: str) -> tuple[DataFrame, DataFrame]:
    """The first delivery of each key, and the keys that were delivered again with another body."""
    order = Window.partitionBy(*keys).orderBy(received, body)
    first = deliveries.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")
    conflicts = deliveries.groupBy(*keys).agg(F.count_distinct(body).alias("bodies"), F.count("*").alias("deliveries")).where("bodies > 1")
    return first, conflicts


#: Transitions of a job; the first state follows on nothing.
TRANSITIONS = {None: ["queued"], "queued": ["running", "failed"], "running": ["succeeded", "failed", "queued", "running"], "failed": ["queued"], "succeeded": []}


def broken_transitions(log: DataFrame, job: str, order: str, status: str) -> DataFrame:
    """Rows of a job log whose status can't follow on the one before, with ``previous``."""
    own = Window.partitionBy(job).orderBy(order)
    previous = F.lag(status).over(own)
    allowed = F.lit(False)
    for before, after in TRANSITIONS.items():
        here = previous.isNull() if before is None else previous == before
        allowed = allowed | (here & F.col(status).isin(after)) if after else allowed
    return log.withColumn("previous", previous).withColumn("_ok", F.coalesce(allowed, F.lit(False))).where("not _ok").drop("_ok")


def changes_only(log: DataFrame, key: str, order: str, payload: str) -> DataFrame:
    """Rows whose payload differs from the one before of the same key; the first always counts."""
    own = Window.partitionBy(key).orderBy(order)
    return log.withColumn("_b", F.lag(payload).over(own)).withColumn("_n", F.row_number().over(own)).where((F.col("_n") == 1) | ~F.col("_b").eqNullSafe(F.col(payload))).drop("_b", "_n")


def last_n_percentile(log: DataFrame, key: str, order: str, value: str, n: int = 2000, share: float = 0.95) -> DataFrame:
    """The percentile of each key's last ``n`` values."""
    own = Window.partitionBy(key).orderBy(F.desc(order))
    return log.withColumn("_n", F.row_number().over(own)).where(F.col("_n") <= n).groupBy(key).agg(F.count("*").alias("n"), p95(value, share).alias("p"))


def replication_metrics(jobs: DataFrame, target: str) -> DataFrame:
    """Per target: counts by status, retries, bytes, throughput weighted by time, failures since the last success and its time.

    ``jobs`` has the target, status, attempts, bytes, duration_ms, finished and job_id.
    """
    done = F.col("status") == "succeeded"
    last = jobs.where(done).groupBy(target).agg(F.max(F.struct("finished", "job_id")).alias("_last"))
    joined = jobs.join(last, target, "left")
    since = (F.col("status") == "failed") & (F.col("_last").isNull() | (F.struct("finished", "job_id") > F.col("_last")))
    return joined.groupBy(target).agg(
        F.count_if(done).alias("succeeded"), F.count_if(F.col("status") == "failed").alias("failed"), F.sum(F.greatest(F.col("attempts") - 1, F.lit(0))).cast("long").alias("retries"),
        F.coalesce(F.sum(F.when(done, F.col("bytes"))), F.lit(0)).cast("long").alias("bytes"), F.round(F.avg(F.when(done, F.col("duration_ms"))), 4).alias("avg_ms"), F.max(F.when(done, F.col("duration_ms"))).alias("max_ms"),
        F.round(F.sum(F.when(done, F.col("bytes"))) * 1000.0 / F.sum(F.when(done & (F.col("duration_ms") > 0), F.col("duration_ms"))), 4).alias("bytes_per_s"),
        F.count_if(since).alias("failures_since"), F.max("_last.finished").alias("last_success"),
    )


def next_interval_run(due: Column, now: Column, seconds: Column) -> Column:
    """The next time of a periodic run; missed periods are skipped. Times are timestamps."""
    passed = (F.unix_micros(now) - F.unix_micros(due)) / (seconds * 1_000_000)
    steps = F.when(now < due, 0).otherwise(F.floor(passed) + 1)
    return F.timestamp_micros(F.unix_micros(due) + (steps * seconds * 1_000_000).cast("long"))


def next_nightly_run(now: Column, clock: str, zone: str) -> Column:
    """The next ``HH:MM`` in a time zone, today if it is still to come and else tomorrow."""
    local = F.from_utc_timestamp(now, zone)
    today = F.to_timestamp(F.concat(F.date_format(local, "yyyy-MM-dd"), F.lit(f" {clock}:00")))
    chosen = F.when(today > local, today).otherwise(today + F.expr("interval 1 day"))
    return F.to_utc_timestamp(chosen, zone)


def retry_delay_ms(attempts: Column, base: int = 1000, most: int | None = None, doublings: int = 30) -> Column:
    """base * 2 ^ (attempts - 1) milliseconds, the power and the result bounded."""
    delay = base * F.pow(F.lit(2.0), F.least(F.greatest(attempts - 1, F.lit(0)), F.lit(doublings)))
    return (F.least(delay, F.lit(float(most))) if most else delay).cast("long")


def expired(expires: Column, now: Column) -> Column:
    """Whether a lease is over: its end is reached; without end it never is."""
    return F.coalesce(expires <= now, F.lit(False))


def due_within(at: Column, now: Column, milliseconds: int) -> Column:
    """Whether a time is still to come and no further away than so many milliseconds."""
    return F.coalesce((at > now) & (F.unix_micros(at) - F.unix_micros(now) <= milliseconds * 1000), F.lit(False))


def claimable(status: Column, next_attempt: Column, locked: Column, now: Column, lease_ms: int) -> Column:
    """Whether a queued row may be claimed: pending and due, or processing under a lease that is over."""
    late = F.unix_micros(locked) + lease_ms * 1000 <= F.unix_micros(now)
    return F.coalesce((status == "pending") & (next_attempt <= now) | (status == "processing") & late, F.lit(False))


def claim(queue: DataFrame, now: Column, lease_ms: int, most: int, order: list[str]) -> DataFrame:
    """The next ``most`` claimable rows (status, next_attempt_at, locked_at, attempts) by next attempt and ``order``, as they are once claimed.

    Giving a row to one worker only is up to the store that the claim is written to.
    """
    ready = queue.where(claimable(F.col("status"), F.col("next_attempt_at"), F.col("locked_at"), now, lease_ms))
    first = ready.orderBy("next_attempt_at", *order).limit(most)
    return first.withColumn("status", F.lit("processing")).withColumn("attempts", F.col("attempts") + 1).withColumn("locked_at", now)


def session_states(sessions: DataFrame, status: str, seen: str, now: Column, ttl_ms: int) -> DataFrame:
    """One row: active sessions that were seen within their time to live, expired and closed ones."""
    live = F.unix_micros(seen) + ttl_ms * 1000 > F.unix_micros(now)
    active = F.col(status) == "active"
    return sessions.agg(F.count_if(active & live).alias("active"), F.count_if(active & ~live).alias("expired"), F.count_if(~active).alias("closed"))


# What stores report, by kind, in the order in which kinds are tried.
ERROR_KINDS = {
    "permission": (["EACCES", "EPERM", "EROFS"], ["AccessDenied", "AccessDeniedException", "AllAccessDisabled", "InvalidAccessKeyId", "SignatureDoesNotMatch"], [401, 403]),
    "capacity": (["ENOSPC", "EDQUOT"], ["QuotaExceeded", "ServiceQuotaExceededException"], [507]),
    "timeout": (["ETIMEDOUT", "ESOCKETTIMEDOUT", "ERR_SOCKET_CONNECTION_TIMEOUT"], ["TimeoutError", "RequestTimeout", "RequestTimeoutException", "SnapshotStoreTimeoutError"], [408]),
    "aborted": (["ABORT_ERR"], ["AbortError"], []),
    "not_found": (["ENOENT"], ["NoSuchKey", "NotFound", "NoSuchBucket"], [404]),
}
#: Names of errors that go away once credentials are renewed, whatever their status.
RENEWED = ["ExpiredToken", "ExpiredTokenException", "TokenRefreshRequired", "CredentialsProviderError"]
CAUSES = 4


def error_kind(causes: Column) -> Column:
    """The kind of a store's error from its chain of causes (array of code, name and status; the first CAUSES count): that of the first that has one, else ``transient``."""

    def one(c: Column) -> Column:
        kind = F.when(c["name"].isin(*RENEWED), "transient")
        for name, (codes, names, states) in ERROR_KINDS.items():
            kind = kind.when(F.coalesce(c["code"].isin(*codes), F.lit(False)) | F.coalesce(c["name"].isin(*names), F.lit(False)) | (F.coalesce(c["status"].isin(*states), F.lit(False)) if states else F.lit(False)), name)
        return kind

    kinds = F.filter(F.transform(F.slice(causes, 1, CAUSES), one), lambda k: k.isNotNull())
    return F.coalesce(F.get(kinds, F.lit(0)), F.lit("transient"))


def retryable(kind: Column) -> Column:
    """Whether an error of this kind may go away by itself: all but permission and capacity."""
    return ~kind.isin("permission", "capacity")
