"""Reports for people: evaluations as text, comparisons as Markdown, and an overview of a service."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from corpusmith.operators.ordered import nearest_rank


def evaluation_text(metrics: DataFrame) -> str:
    """Mean recall, mrr, ndcg and top places of per-case metrics, and the cases that found nothing; both are bounded."""
    names = ["recall", "mrr", "ndcg", "top1", "top3", "top5"]
    own = metrics.agg(F.count("*").alias("cases"), *(F.avg(n).alias(n) for n in names)).first()
    if not own["cases"]:
        return "no cases"
    lines = [f"cases: {own['cases']}", *(f"{n}: {own[n]:.4f}" for n in names)]
    missed = [str(r[0]) for r in metrics.where("recall = 0").select("case_id").orderBy("case_id").limit(20).collect()]
    return "\n".join(lines + ([f"missed: {', '.join(missed)}"] if missed else []))


def comparison_markdown(deltas: DataFrame, base: str, other: str) -> str:
    """Outcomes of paired runs as a Markdown table, with the mean delta."""
    counts = {r["outcome"]: r["count"] for r in deltas.groupBy("outcome").count().collect()}
    mean = deltas.agg(F.avg("delta")).first()[0]
    rows = [f"| {name} | {counts.get(name, 0)} |" for name in ("improved", "regressed", "unchanged", "excluded")]
    return "\n".join([f"# {other} against {base}", "", "| outcome | pairs |", "|---|---|", *rows, "", f"mean delta: {'n/a' if mean is None else f'{mean:.4f}'}"])


def overview(jobs: DataFrame, requests: DataFrame) -> DataFrame:
    """One row: jobs by status, requests, errors and the 95th percentile of durations.

    ``jobs`` has status; ``requests`` status and duration_ms. Empty tables count 0.
    """
    states = ("queued", "running", "succeeded", "failed")
    counted = jobs.agg(*(F.count_if(F.col("status") == s).alias(s) for s in states))
    asked = requests.agg(F.count("*").alias("requests"), F.count_if(F.col("status") >= 400).alias("errors"))
    high = nearest_rank(requests.select(F.lit(1).alias("all"), "duration_ms"), ["all"], "duration_ms", 0.95, "p95_ms")
    scalars = [df.select(c).scalar().alias(c) for df, cs in ((counted, states), (asked, ("requests", "errors")), (high, ("p95_ms",))) for c in cs]
    return jobs.sparkSession.range(1).select(*scalars)


def needs_rebuild(indexed: int | None, revision: int) -> bool:
    """Whether an index can't be brought to a revision by its changes alone: it isn't the one before."""
    return indexed is None or indexed != revision - 1


def rebuild_needed(indexed: Column, revision: Column) -> Column:
    """:func:`needs_rebuild` of columns."""
    return indexed.isNull() | (indexed != revision - 1)


def recent_jobs(jobs: DataFrame, most: int = 20) -> DataFrame:
    """The ``most`` jobs (id, workspace_id, status, created_at) that were created last."""
    return jobs.orderBy(F.desc_nulls_last("created_at"), "id").limit(most)


def workspace_overview(files: DataFrame, chunks: DataFrame, jobs: DataFrame) -> DataFrame:
    """Per workspace: files, chunks, jobs and the last job's time; workspaces that any of the tables names."""
    parts = [
        files.select("workspace_id", "path").distinct().groupBy("workspace_id").agg(F.count("*").alias("files")), chunks.select("workspace_id", "id").distinct().groupBy("workspace_id").agg(F.count("*").alias("chunks")),
        jobs.groupBy("workspace_id").agg(F.count_distinct("id").alias("jobs"), F.max("created_at").alias("last_job")),
    ]
    joined = parts[0].join(parts[1], "workspace_id", "full_outer").join(parts[2], "workspace_id", "full_outer")
    return joined.select("workspace_id", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("files", "chunks", "jobs")), "last_job")
