"""Archives of an index: compressed JSON lines of typed records, with a header that counts them."""

from __future__ import annotations

import hashlib
import json
import os

from pyspark.sql import DataFrame, SparkSession, functions as F

from corpusmith.sources.objects import Conflict, Objects, Versioned

FORMAT = 2
#: Kinds of records in the order in which an archive has them, and their fields.
KINDS = {
    "file": "path string, hash string, language string, mtime_ms long, size long",
    "chunk": "id string, path string, language string, start_line int, end_line int, content string, symbol string, hash string",
    "embedding": "chunk_id string, model string, dim int, vector array<float>",
}


def canonical_json(value) -> str:
    """JSON with sorted keys and no blanks, the same for equal values."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def merkle(digests: DataFrame) -> str:
    """One sha256 of all digests (column d, hexadecimal): digests that begin alike are sorted and hashed together, level by level.

    It doesn't depend on the order or the parts in which records lie, only on the records and how often each occurs.
    """
    level = digests.groupBy(F.substring("d", 1, 5).alias("p")).agg(F.sha2(F.array_join(F.sort_array(F.collect_list("d")), ""), 256).alias("d"))
    for size in (3, 1, 0):
        pair = F.sort_array(F.collect_list(F.struct("p", "d")))
        level = level.groupBy(F.substring("p", 1, size).alias("q")).agg(F.sha2(F.array_join(F.transform(pair, lambda x: F.concat(x["p"], x["d"])), ""), 256).alias("d")).select(F.col("q").alias("p"), "d")
    found = level.first()
    return found["d"] if found else hashlib.sha256(b"").hexdigest()


def _measured(lines: DataFrame) -> tuple[int, str]:
    return lines.count(), merkle(lines.select(F.sha2("value", 256).alias("d")))


def _whole(counts: dict, digests: dict) -> str:
    return hashlib.sha256(canonical_json([counts, digests]).encode()).hexdigest()


def export_snapshot(tables: dict[str, DataFrame], folder: str, metadata: dict | None = None) -> dict:
    """Writes an archive: parts of compressed lines, and a manifest with counts and digests. Returns the manifest.

    Every kind is a folder of parts written by all executors, so an archive isn't bound by one
    machine. Each kind's digest is that of all its records, whatever their order.
    """
    counts, digests = {}, {}
    spark = next(iter(tables.values())).sparkSession
    for kind, schema in KINDS.items():
        names = [c.split()[0] for c in schema.split(", ")]
        lines = tables[kind].select(F.to_json(F.struct(F.lit(kind).alias("type"), F.struct(*names).alias("value"))).alias("value"))
        lines.write.mode("overwrite").option("compression", "gzip").text(f"{folder}/{kind}")
        counts[kind], digests[kind] = _measured(spark.read.text(f"{folder}/{kind}"))
    manifest = {"format": FORMAT, "counts": counts, "digests": digests, "digest": _whole(counts, digests), "metadata": metadata or {}}
    Objects(spark, folder).put("manifest.json", canonical_json(manifest).encode())
    return manifest


def read_manifest(spark: SparkSession, folder: str) -> dict:
    """The manifest of an archive; ValueError if there is none, it is of another format, or its digest isn't that of its parts."""
    data = Objects(spark, folder).get("manifest.json")
    manifest = json.loads(data) if data else {}
    if manifest.get("format") != FORMAT:
        raise ValueError(f"archive of format {manifest.get('format')}")
    if manifest["digest"] != _whole(manifest["counts"], manifest["digests"]):
        raise ValueError("the manifest's digest isn't that of its parts")
    return manifest


def import_snapshot(spark: SparkSession, folder: str) -> tuple[dict, dict[str, DataFrame]]:
    """The manifest and the tables of an archive; ValueError if it isn't whole.

    Counts and digests must be the manifest's, types those of their folder, every chunk's file
    must be there and every vector's chunk.
    """
    manifest = read_manifest(spark, folder)
    tables = {}
    for kind, schema in KINDS.items():
        lines = spark.read.text(f"{folder}/{kind}")
        count, found = _measured(lines)
        odd = lines.where(F.get_json_object("value", "$.type") != kind).limit(1).count()
        if count != manifest["counts"][kind] or odd or found != manifest["digests"][kind]:
            raise ValueError(f"{count} records of {kind}; the manifest has {manifest['counts'][kind]}, of another digest or type")
        tables[kind] = lines.select(F.from_json("value", f"type string, value struct<{schema.replace(' ', ':').replace(',:', ',')}>").alias("r")).select("r.value.*")
    lost = tables["chunk"].join(tables["file"], "path", "left_anti").limit(1).count()
    orphans = tables["embedding"].join(tables["chunk"].select(F.col("id").alias("chunk_id")), "chunk_id", "left_anti").limit(1).count()
    if lost or orphans:
        raise ValueError("chunks without file or vectors without chunk")
    return manifest, tables


def replicate(spark: SparkSession, source: str, target: str, name: str, sequence: int) -> str:
    """Copies an archive below a target and publishes it under a name with a sequence; says what became of it.

    The copy's records are counted and hashed before it is published. A publication of a smaller
    sequence than the one there is superseded, an equal one already_current or, if it is another
    archive, a conflict; of two writers at once one gets conflict.
    """
    manifest = read_manifest(spark, source)
    pointer = Versioned(Objects(spark, target), f"publications/{name}")
    number, data = pointer.read()
    now = json.loads(data) if data else None
    outcome = publication(now["sequence"] if now else None, sequence, bool(now) and now["digest"] == manifest["digest"])
    if outcome != "published":
        return outcome
    place = f"{target.rstrip('/')}/archives/{manifest['digest']}"
    if Objects(spark, place).head("manifest.json") is None:
        for kind in KINDS:
            spark.read.text(f"{source}/{kind}").write.mode("overwrite").option("compression", "gzip").text(f"{place}/{kind}")
            if _measured(spark.read.text(f"{place}/{kind}")) != (manifest["counts"][kind], manifest["digests"][kind]):
                raise ValueError(f"the copy of {kind} isn't the archive's")
        Objects(spark, place).put("manifest.json", canonical_json(manifest).encode())
    try:
        pointer.replace(number, canonical_json({"sequence": sequence, "digest": manifest["digest"]}).encode())
    except Conflict:
        return "conflict"
    return outcome


def published(spark: SparkSession, target: str, name: str) -> str | None:
    """The folder of the archive that is published under a name."""
    _, data = Versioned(Objects(spark, target), f"publications/{name}").read()
    return f"{target.rstrip('/')}/archives/{json.loads(data)['digest']}" if data else None


def publication(current: int | None, offered: int, same: bool) -> str:
    """What becomes of an offered publication: published, already_current, superseded or conflict."""
    if current is None or offered > current:
        return "published"
    return "superseded" if offered < current else "already_current" if same else "conflict"


def file_digest(path: str) -> str:
    """The sha256 of a local file."""
    with open(os.path.expanduser(path), "rb") as file:
        return hashlib.file_digest(file, "sha256").hexdigest()
