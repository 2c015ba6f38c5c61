"""Scanning folders: which files are read, what language they are in, and how bytes become text."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import pandas as pd
from pyarrow.fs import FileSelector, FileSystem, FileType
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from corpusmith.functions import rules
from corpusmith.session import materialize

MAX_BYTES = 1 << 20
#: Files of a tree that hold ignore rules for what lies below them.
IGNORE_FILES = (".gitignore", ".ignore")


def _lookup(table: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for x in chain.from_iterable(table.items())])


def base_name(path: Column) -> Column:
    """The last segment of a path, in lower case."""
    return F.lower(F.regexp_extract(path, "[^/]*$", 0))


def extension_of(path: Column) -> Column:
    """The extension of a path's last segment in lower case, without its dot; empty where there is none, as for ``.name``."""
    return F.regexp_extract(base_name(path), r"^.+\.([^.]*)$", 1)


def language_of(path: Column) -> Column:
    """The language by a file's name, else by its extension, else the extension itself, else ``text``."""
    base, extension = base_name(path), extension_of(path)
    named = F.when(base.startswith("dockerfile."), "dockerfile").otherwise(F.element_at(_lookup(rules.LANGUAGE_BY_NAME), base))
    return F.coalesce(named, F.element_at(_lookup(rules.LANGUAGE_BY_EXTENSION), extension), F.when(extension != "", extension), F.lit("text"))


def readable(path: Column, size: Column, most: int = MAX_BYTES, all_text: bool = False) -> Column:
    """Whether a file is read by its name and size: a text extension, none, or a known name; neither empty nor over ``most`` bytes."""
    base, extension = base_name(path), extension_of(path)
    named = base.isin(*rules.LANGUAGE_BY_NAME) | base.startswith("dockerfile.")
    dotted = base.rlike(r"^.+\.[^.]*$")  # a dot at the end is an extension, too
    known = F.lit(True) if all_text else named | extension.isin(*rules.TEXT_EXTENSIONS) | ~dotted
    return F.coalesce((size > 0) & (size <= most) & known, F.lit(False))


def _segments(body: str) -> str:
    """The regular expression of a rule's text: ``*`` and ``?`` stay within a segment, ``**`` crosses them."""
    out, i = "", 0
    while i < len(body):
        if body.startswith("**/", i):
            out, i = out + "(?:[^/]*/)*", i + 3
        elif body.startswith("/**", i) and i + 3 == len(body):
            out, i = out + "/.+", i + 3
        elif body[i] == "*":
            while i + 1 < len(body) and body[i + 1] == "*":
                i += 1
            out, i = out + "[^/]*", i + 1
        elif body[i] == "?":
            out, i = out + "[^/]", i + 1
        elif body[i] == "[" and (end := body.find("]", i + 2)) > 0:
            inner = body[i + 1 : end]
            out, i = out + "[" + ("^" + inner[1:] if inner[0] in "!^" else inner).replace("\\", "\\\\") + "]", end + 1
        elif body[i] == "\\" and i + 1 < len(body):
            out, i = out + re.escape(body[i + 1]), i + 2
        else:
            out, i = out + re.escape(body[i]), i + 1
    return out


@lru_cache(maxsize=100_000)
def _pattern(rule: str) -> tuple[re.Pattern, bool, bool] | None:
    """A regular expression for one ignore rule, whether it takes back in, whether it means folders only; None for blanks and comments."""
    rule = rule.rstrip("\r\n")
    rule = re.sub(r"(?<!\\)\s+$", "", rule)
    if not rule or rule.startswith("#"):
        return None
    keep = rule.startswith("!")
    body = rule[keep:]
    folder = body.endswith("/")
    body = body.rstrip("/")
    anchored = "/" in body
    body = body.removeprefix("/")
    if not body:
        return None
    try:
        return re.compile(("^" if anchored else "^(?:.*/)?") + _segments(body) + "$", re.IGNORECASE), keep, folder
    except re.error:
        return None


def ignored(path: str, patterns: list[str]) -> bool:
    """Whether the rules exclude a file: the last rule that it or a folder above it meets decides, ``!`` takes back in.

    A rule that ends with ``/`` means folders, one with another ``/`` is anchored; case doesn't
    count. What lies in an excluded folder can't be taken back in.
    """
    parts = path.split("/")
    return any(_last_met("/".join(parts[:k]), k < len(parts), patterns) for k in range(1, len(parts) + 1))


def _last_met(path: str, folder: bool, patterns: list[str]) -> bool:
    """Whether the last rule that a path itself meets excludes it."""
    out = False
    for rule in patterns:
        known = _pattern(rule)
        if known and (folder or not known[2]) and known[0].search(path):
            out = not known[1]
    return out


def nested_rules(folder: str, text: str) -> list[str]:
    """The rules of an ignore file as rules of the tree's root: those of folders below it are anchored there."""
    out = []
    for line in text.splitlines():
        rule = line.strip()
        if not rule or rule.startswith("#"):
            continue
        keep = rule.startswith("!")
        rule = rule[keep:]
        out.append(("!" if keep else "") + (f"{folder}/{rule.removeprefix('/')}" if folder else rule))
    return out


def excluded(files: DataFrame, ignore: list[str] | None = None, ignore_files: tuple[str, ...] = IGNORE_FILES) -> DataFrame:
    """Adds ``excluded`` to files (root, path, content): whether default rules, the tree's ignore files or ``ignore`` exclude them.

    Rules apply in this order: defaults, the root's ignore files, ``ignore``, and those of the
    folders above a file from the outermost in. ``content`` may be text or bytes and is only read
    of ignore files. Null paths aren't excluded. A file meets the rules by its folders, so no
    list of a whole tree's rules is sent anywhere.
    """
    folder_of = lambda path: F.regexp_replace(path, r"/?[^/]*$", "")

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def parsed(folder: pd.Series, content: pd.Series) -> pd.Series:
        text = content.map(lambda c: "" if c is None else c if isinstance(c, str) else bytes(c).decode("utf-8", "replace"))
        return pd.Series([nested_rules(f, t) for f, t in zip(folder, text, strict=True)])

    @F.pandas_udf(T.BooleanType())
    def decided(path: pd.Series, own: pd.Series) -> pd.Series:
        def one(p: str | None, levels: list | None) -> bool:
            if p is None:
                return False
            known = sorted((x for x in levels if x is not None), key=lambda x: (x["depth"], x["name"])) if levels is not None else []
            told = lambda of: [r for x in known if of(x["depth"]) for r in x["rules"]]
            return ignored(p, [*rules.DEFAULT_IGNORES, *told(lambda d: d == 0), *(ignore or []), *told(lambda d: d > 0)])

        return pd.Series([one(p, o) for p, o in zip(path, own, strict=True)])

    name = F.regexp_extract("path", "[^/]*$", 0)
    told = files.where(name.isin(*ignore_files)).select("root", folder_of(F.col("path")).alias("folder"), name.alias("name"), "content")
    told = told.select("root", "folder", F.struct(F.when(F.col("folder") == "", 0).otherwise(F.size(F.split("folder", "/"))).alias("depth"), "name", parsed("folder", "content").alias("rules")).alias("level"))
    parts = F.split(folder_of(F.col("path")), "/")
    above = F.array_distinct(F.concat(F.array(F.lit("")), F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, 1, k), "/"))))
    met = files.select("root", "path", F.explode(above).alias("folder")).distinct().join(told, ["root", "folder"]).groupBy("root", "path").agg(F.collect_list("level").alias("_rules"))
    return files.join(met, ["root", "path"], "left").withColumn("excluded", decided("path", "_rules")).drop("_rules")


def looks_textual(data: bytes | None, sample: int = 2048) -> bool:
    """Whether the first bytes are text: at most two NULs and at most 30 % unprintable (tab and line ends are printable)."""
    head = (data or b"")[:sample]
    odd = sum((b < 32 and b not in (9, 10, 13)) or b == 127 for b in head)
    return head.count(0) <= 2 and odd <= 0.3 * max(1, len(head))


@F.pandas_udf(T.StringType())
def decoded(data: pd.Series) -> pd.Series:
    """Bytes as text, broken sequences as U+FFFD; null for what isn't text."""
    return data.map(lambda b: bytes(b).decode("utf-8", "replace") if b is not None and looks_textual(bytes(b)) else None)


def rooted(files: DataFrame, several: Column) -> DataFrame:
    """Files (root, path) with the root's name before their path where there are ``several`` roots."""
    return files.withColumn("path", F.when(several, F.concat_ws("/", "root", "path")).otherwise(F.col("path")))


_FOUND = "root string, base string, path string, folder boolean, size long, mtime_ms long, rules array<string>"


def _listed(ignore: list[str], ignore_files: tuple[str, ...]):
    """Lists folders (root, base, path, rules): what isn't excluded in them, with the rules that hold below."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows: list[tuple] = []
            for root, base, folder, told in zip(batch["root"], batch["base"], batch["path"], batch["rules"], strict=True):
                store, at = FileSystem.from_uri(base)
                found = sorted(store.get_file_info(FileSelector(f"{at}/{folder}" if folder else at, allow_not_found=True)), key=lambda x: x.base_name)
                own: list[str] = []
                for name in ignore_files:
                    for info in found:
                        if info.base_name == name and info.type == FileType.File:
                            with store.open_input_stream(info.path) as data:
                                own += nested_rules(folder, data.read().decode("utf-8", "replace"))
                below = [*told, *own] if folder else [*rules.DEFAULT_IGNORES, *own, *ignore]
                for info in found:
                    path, inner = f"{folder}/{info.base_name}" if folder else info.base_name, info.type == FileType.Directory
                    if not _last_met(path, inner, below):
                        rows.append((root, base, path, inner, info.size, (info.mtime_ns or 0) // 1_000_000, below if inner else None))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in _FOUND.split(", ")]).astype({"size": "Int64", "mtime_ms": "Int64"})

    return read


def walk(spark: SparkSession, roots: dict[str, str], ignore: list[str] | None = None, ignore_files: tuple[str, ...] = IGNORE_FILES) -> DataFrame:
    """root, base, path, size and mtime_ms of the files below the roots (name to folder) that no rule excludes.

    Folders are listed level by level, each where a task runs, and excluded ones aren't entered;
    each folder carries the rules that hold in it. Names that begin with a dot or a low line are
    listed, too. Roots are local folders or addresses that Arrow can open, seen by all executors.
    """
    frontier = spark.createDataFrame([(name, folder.rstrip("/"), "", []) for name, folder in roots.items()], "root string, base string, path string, rules array<string>")
    found = None
    while True:
        level = materialize(frontier.mapInPandas(_listed(ignore or [], ignore_files), _FOUND), "level")
        own = level.where("not folder").select("root", "base", "path", "size", "mtime_ms")
        found = own if found is None else found.unionByName(own)
        frontier = level.where("folder").select("root", "base", "path", "rules")
        if not frontier.limit(1).count():
            return found
        frontier = frontier.repartition(F.xxhash64("root", "path"))


def scan(spark: SparkSession, roots: dict[str, str], ignore: list[str] | None = None, most: int = MAX_BYTES, all_text: bool = False, ignore_files: tuple[str, ...] = IGNORE_FILES) -> DataFrame:
    """path, size, mtime_ms, language, content and hash of the text files below the roots (name to folder).

    Paths are relative, and begin with the root's name where there are several. Excluded files,
    those that aren't :func:`readable` and binary ones don't come out; with ``all_text`` any
    extension is read. A file that is gone when it is read doesn't come out.
    """

    def contents(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            data = []
            for base, path in zip(batch["base"], batch["path"], strict=True):
                store, at = FileSystem.from_uri(base)
                try:
                    with store.open_input_stream(f"{at}/{path}") as stream:
                        data.append(stream.read())
                except FileNotFoundError:
                    data.append(None)
            yield batch.assign(content=data)[["root", "path", "size", "mtime_ms", "content"]]

    kept = walk(spark, roots, ignore, ignore_files).where(readable(F.col("path"), F.col("size"), most, all_text))
    read = kept.repartition(F.xxhash64("root", "path")).mapInPandas(contents, "root string, path string, size long, mtime_ms long, content binary")
    text = rooted(read, F.lit(len(roots) > 1)).select("path", "size", "mtime_ms", language_of(F.col("path")).alias("language"), decoded("content").alias("content"))
    return text.where("content is not null").withColumn("hash", F.sha2("content", 256))
