"""Commits from the text that ``git log --name-only`` prints."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from corpusmith.operators.ordered import carried

#: The format the log is written in: ``git log --name-only --pretty=format:'commit%x1f%H%x1f%h%x1f%an%x1f%aI%x1f%s'``.
MARK, SEPARATOR = "commit", "\x1f"
MAX_FILES, MAX_SUBJECT = 40, 120
#: Line numbers of a log that are read together.
BLOCK = 4096


def parse_log(lines: DataFrame) -> DataFrame:
    """hash, short, author, date, subject and files of the commits in lines (log, n, value).

    ``log`` tells logs apart and ``n`` orders their lines. Lines before the first commit are left
    out; a commit without files has an empty array.
    """
    head = F.col("value").startswith(MARK + SEPARATOR)
    begun = lines.where("value is not null").withColumn("_head", head).withColumn("_at", F.when(F.col("_head"), F.col("n")))
    # a line belongs to the last head before it; long logs are read in blocks of lines
    numbered = carried(begun, ["log"], "n", F.floor(F.col("n") / BLOCK), "_at", "_c").where("_c is not null")
    heads = numbered.where("_head").select("log", "_c", F.split("value", SEPARATOR, 6).alias("p"))
    files = numbered.where("not _head and trim(value) != ''").groupBy("log", "_c").agg(F.sort_array(F.collect_list(F.struct("n", "value"))).alias("f"))
    both = heads.join(files, ["log", "_c"], "left")
    parts = [F.col("p")[i].alias(name) for i, name in enumerate(("hash", "short", "author", "date", "subject"), 1)]
    return both.select(*parts, F.coalesce(F.col("f.value"), F.array().cast("array<string>")).alias("files"))


def commit_chunks(commits: DataFrame) -> DataFrame:
    """A chunk for each commit, under a path of its own, with its short hash, date, author, subject and first MAX_FILES files."""
    none = F.lit(None).cast("string")
    files = F.array_join(F.transform(F.slice("files", 1, MAX_FILES), lambda f: F.concat(F.lit("- "), f)), "\n")
    told = lambda label, c: F.concat(F.lit(label), F.coalesce(c, F.lit("")))
    content = F.concat_ws(
        "\n", F.concat(F.lit("commit "), F.col("short"), F.lit(" "), F.coalesce("date", F.lit(""))), told("author: ", F.col("author")), told("subject: ", F.col("subject")),
        F.when(F.size("files") > 0, F.concat(F.lit("files:\n"), files)).otherwise(none),
    )
    return commits.select(
        F.substring(F.sha2(F.concat(F.lit("commit\0"), F.col("hash")), 256), 1, 16).alias("id"), F.concat(F.lit(".git/commits/"), F.col("short")).alias("path"), F.lit("git-commit").alias("language"),
        F.lit(1).alias("start_line"), F.size(F.split(content, "\n")).alias("end_line"), content.alias("content"), F.substring("subject", 1, MAX_SUBJECT).alias("symbol"), F.sha2(content, 256).alias("hash"),
    )
