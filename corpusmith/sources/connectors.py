"""Sources of files outside: recorded answers of code hosts as tables, sync plans, rules, settings and old databases."""

from __future__ import annotations

import os
import re
import sqlite3
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from corpusmith.operators import manifest

MAX_FILES = 20_000
#: Where each host's recorded tree lists its files: field of the list, path, revision, size and the value of a file's type.
HOSTS = {"github": ("tree", "path", "sha", "size", "blob"), "gitlab": ("tree", "path", "id", "size", "blob"), "bitbucket": ("values", "path", "commit.hash", "size", "commit_file")}


@dataclass(frozen=True)
class Connector:
    """A provider of files: what it lists (path, revision, bytes) for settings, and what it reads (path, content, problem) of listed files."""

    listing: Callable[[SparkSession, dict], DataFrame]
    reading: Callable[[SparkSession, dict, DataFrame], DataFrame] | None = None


_providers: dict[str, Connector] = {}


def register(name: str, provider: Connector | Callable[[SparkSession, dict], DataFrame] | None) -> None:
    """Makes a provider known; its function gives path, revision and bytes. A name can't be taken twice."""
    if name in _providers:
        raise ValueError(f"provider {name} is taken")
    _providers[name] = provider if isinstance(provider, Connector) else Connector(provider)


def list_files(spark: SparkSession, name: str, config: dict, previous: DataFrame | None = None) -> DataFrame:
    """The files of a registered provider, safe paths only.

    ``previous`` (path, revision, bytes) is what was listed before: the size of a file that has
    not changed since is taken from it where the listing has none.
    """
    files = _providers[name].listing(spark, config).where(safe_path(F.col("path")))
    if previous is None:
        return files
    known = previous.groupBy("path", "revision").agg(F.max("bytes").alias("_bytes"))
    return files.join(known, ["path", "revision"], "left").select("path", "revision", F.coalesce("bytes", "_bytes").alias("bytes"))


def list_since(spark: SparkSession, name: str, config: dict, cursor: dict | None, previous: DataFrame) -> tuple[DataFrame, dict]:
    """The files and the next cursor; where the cursor names the commit that the settings pin, the previous files as they are."""
    commit = config.get("commit")
    if commit is not None and not re.fullmatch(r"[0-9a-f]{40}|[0-9a-f]{64}", commit):
        raise ValueError(f"{commit} isn't a commit")
    if commit and cursor and cursor.get("commit") == commit:
        return previous, cursor
    return list_files(spark, name, config, previous), {"commit": commit}


def read_files(spark: SparkSession, name: str, config: dict, files: DataFrame) -> DataFrame:
    """path, content and problem of listed files (path, revision, bytes); content is null where there is a problem."""
    reading = _providers[name].reading
    if reading is None:
        raise ValueError(f"provider {name} reads no files")
    return reading(spark, config, files)


def recorded_blobs(spark: SparkSession, config: dict, files: DataFrame) -> DataFrame:
    """Files with the bytes of their recorded blob (JSON lines with sha, encoding, content and size below ``blobs``).

    A problem is a blob that is missing, not in base64, or of another size than was listed.
    """
    answers = spark.read.schema("sha string, encoding string, content string, size long").json(config["blobs"])
    once = answers.where("sha is not null").groupBy("sha").agg(F.max(F.struct("encoding", "content", "size")).alias("b"))
    text = F.regexp_replace("b.content", r"\s+", "")
    good = (F.col("b.encoding") == "base64") & text.rlike(r"^(?:[A-Za-z0-9+/]{4})*(?:[A-Za-z0-9+/]{2}==|[A-Za-z0-9+/]{3}=)?$")
    held = files.join(once, files["revision"] == once["sha"], "left").select("path", "bytes", F.col("sha").isNotNull().alias("there"), F.coalesce(good, F.lit(False)).alias("good"), F.when(good, F.unbase64(text)).alias("data"))
    size = F.octet_length("data")
    problem = F.when(~F.col("there"), "missing").when(~F.col("good"), "not base64").when(F.col("bytes").isNotNull() & (size != F.col("bytes")), "another size")
    return held.select("path", F.when(problem.isNull(), F.col("data")).alias("content"), problem.alias("problem"))


def safe_path(path):
    """Whether a path is relative, without empty, ``.`` or ``..`` segments, backslashes or control characters."""
    parts = F.split(path, "/")
    return path.isNotNull() & (path != "") & ~path.rlike(r"[\x00-\x1f\\]") & ~F.exists(parts, lambda p: p.isin("", ".", ".."))


def recorded_tree(spark: SparkSession, host: str, location: str, most: int = MAX_FILES, lines: bool = False) -> DataFrame:
    """path, revision and bytes from a host's recorded JSON pages, each a file or, with ``lines``, a line.

    Directories and unsafe paths are left out. ValueError for a truncated tree, a path that occurs
    twice, or more than ``most`` files.
    """
    field, path, revision, size, blob = HOSTS[host]
    pages = spark.read.option("multiLine", not lines).json(location)
    if "truncated" in pages.columns and pages.where("truncated").limit(1).count():
        raise ValueError("the tree is truncated")
    rows = pages.select(F.explode(field).alias("f")).where(F.col("f.type") == blob)
    sizes = F.col(f"f.{size}").cast("long") if size in rows.select("f.*").columns else F.lit(None).cast("long")
    files = rows.select(F.col(f"f.{path}").alias("path"), F.col(f"f.{revision}").alias("revision"), sizes.alias("bytes")).where(safe_path(F.col("path")))
    found = files.agg(F.count("*").alias("n"), F.count_distinct("path").alias("d")).first()
    if found["n"] > most or found["d"] < found["n"]:
        raise ValueError(f"{found['n']} files of {found['d']} paths; at most {most}, each once")
    return files


for _host in HOSTS:
    register(_host, Connector(lambda spark, config, host=_host: recorded_tree(spark, host, config["location"], config.get("most", MAX_FILES), config.get("lines", False)), recorded_blobs))


def sync_plan(listed: DataFrame, stored: DataFrame) -> DataFrame:
    """path and change (upsert, delete) that bring what is stored (path, remote_revision) to what is listed (path, revision)."""
    return manifest.difference(listed.select("path", F.col("revision").alias("v")), stored.select("path", F.col("remote_revision").alias("v")), ["path"], "v")


class _Rows(InputPartition):
    def __init__(self, low: int, high: int) -> None:
        self.low, self.high = low, high


class _SqliteReader(DataSourceReader):
    def __init__(self, options: dict, schema) -> None:
        self.path, self.table, self.names = options["path"], options["table"], schema.names
        self.parts = int(options.get("partitions", 4))

    def partitions(self) -> list[InputPartition]:
        with sqlite3.connect(f"file:{self.path}?mode=ro", uri=True) as db:
            low, high = db.execute(f'select min(rowid), max(rowid) from "{self.table}"').fetchone()
        if low is None:
            return []
        step = max(1, -(-(high - low + 1) // self.parts))
        return [_Rows(a, min(a + step, high + 1)) for a in range(low, high + 1, step)]

    def read(self, partition) -> Iterator[tuple]:
        if partition is None:  # an empty table has no ranges
            return
        with sqlite3.connect(f"file:{self.path}?mode=ro", uri=True) as db:
            names = ", ".join(f'"{n}"' for n in self.names)
            yield from db.execute(f'select {names} from "{self.table}" where rowid >= ? and rowid < ?', (partition.low, partition.high))


class SqliteSource(DataSource):
    """Tables of a SQLite file on a folder that all executors see, read by ranges of row ids."""

    @classmethod
    def name(cls) -> str:
        return "sqlite_table"

    def reader(self, schema) -> DataSourceReader:
        return _SqliteReader(self.options, schema)


def read_sqlite(spark: SparkSession, path: str, table: str, schema: str) -> DataFrame:
    """A table of a SQLite file."""
    spark.dataSource.register(SqliteSource)
    return spark.read.format("sqlite_table").schema(schema).option("path", path).option("table", table).load()


#: Names of rule files, the folders of rule files, and the bounds of what is read.
RULE_FILES, RULE_FOLDERS = ("AGENTS.md", "CLAUDE.md"), (".rules/", ".cursor/rules/")
RULE_BYTES, RULE_COUNT = 32 * 1024, 24


def workspace_rules(files: DataFrame) -> DataFrame:
    """path, always and content of a workspace's rules among files (path, content), those that always apply first.

    Rule files at the root always apply; those in rule folders only if their front matter says
    ``alwaysApply: true``. At most RULE_COUNT come out, each cut to RULE_BYTES characters.
    """
    front = F.regexp_extract("content", r"(?s)^---\s*\n(.*?)\n---\s*(?:\n|$)", 1)
    root = F.col("path").isin(*RULE_FILES)
    inside = F.lit(False)
    for folder in RULE_FOLDERS:
        inside = inside | F.col("path").startswith(folder)
    body = F.regexp_replace("content", r"(?s)^---\s*\n.*?\n---\s*(?:\n|$)", "")
    rows = files.where(root | (inside & F.col("path").rlike(r"\.(?:md|mdc|txt)$")))
    named = rows.select("path", (root | front.rlike(r"(?m)^alwaysApply:\s*true\s*$")).alias("always"), F.substring(body, 1, RULE_BYTES).alias("content"))
    return named.orderBy(F.desc("always"), "path").limit(RULE_COUNT)


def parse_env(text: str) -> dict[str, str]:
    """The settings of a ``.env`` text; quotes and ``export`` are taken off, comments and broken lines left out."""
    out = {}
    for line in text.splitlines():
        m = re.match(r"\s*(?:export\s+)?([A-Za-z_]\w*)\s*=\s*(.*?)\s*$", line)
        if m and not line.lstrip().startswith("#"):
            value = m.group(2)
            quoted = re.match(r"^([\"'])(.*)\1(?:\s+#.*)?$", value)
            out[m.group(1)] = quoted.group(2) if quoted else re.sub(r"\s+#.*$", "", value)
    return out


def settings(defaults: dict, *layers: dict, prefix: str = "CORPUSMITH_") -> dict:
    """Defaults overlaid by layers and at last by the environment; values take the type of their default."""
    merged = dict(defaults)
    for layer in (*layers, {k[len(prefix) :].lower(): v for k, v in os.environ.items() if k.startswith(prefix)}):
        for key, value in layer.items():
            kind = type(defaults.get(key, ""))
            merged[key] = value if isinstance(value, kind) else str(value).lower() in ("1", "true", "yes") if kind is bool else kind(value)
    return merged


def profile(config: dict, name: str | None = None) -> dict:
    """One of the profiles of a configuration ({default, profiles: [{name, ...}]}): by name, else the default, else the first; empty where there are none."""
    every = {p["name"]: p for p in config.get("profiles", [])}
    if not every:
        return {}
    key = name or config.get("default") or next(iter(every))
    if key not in every:
        raise ValueError(f"unknown profile {key}; there are {', '.join(every)}")
    return every[key]


def with_profile(config: dict, new: dict) -> dict:
    """The configuration with a profile added or in place of the one of its name; the first becomes the default."""
    others = [p for p in config.get("profiles", []) if p["name"] != new["name"]]
    return {**config, "profiles": [*others, new], "default": config.get("default") or new["name"]}
