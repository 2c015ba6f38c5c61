"""Versions of an index on a shared folder: written beside each other, promoted by comparing and swapping one small value."""

from __future__ import annotations

import json
import time
import uuid

from pyspark.sql import DataFrame, SparkSession

from corpusmith.operators.manifest import upsert, without
from corpusmith.sources.objects import Conflict, Objects, Versioned


class Store:
    """Generations of an index below one folder of any Hadoop file system.

    A generation is a folder that is written once. The value ``active`` names the one that is
    read; it is replaced only by writers that read the value before it, so of two promotions one
    fails. Readers keep the generation they opened until it is collected.
    """

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        self.objects = Objects(spark, self.root)
        self._pointer = Versioned(self.objects, "active")

    def _active(self) -> tuple[int, dict]:
        number, data = self._pointer.read()
        return number, json.loads(data) if data else {"generation": None, "revision": None}

    def active(self) -> str | None:
        """The generation that is read."""
        return self._active()[1]["generation"]

    def revision(self) -> int | None:
        """The revision of the generation that is read."""
        return self._active()[1]["revision"]

    def read(self, table: str, generation: str | None = None) -> DataFrame:
        """A table of a generation, by default the active one."""
        return self.spark.read.parquet(f"{self.root}/{generation or self.active()}/{table}")

    def _state(self, generation: str) -> dict | None:
        data = self.objects.get(f"states/{generation}.json")
        return json.loads(data) if data else None

    def _note(self, generation: str, **more) -> None:
        known = self._state(generation) or {}
        self.objects.put(f"states/{generation}.json", json.dumps({**known, **more}, sort_keys=True).encode())

    def state(self, generation: str) -> str | None:
        """building, ready, active, retired or failed; None for one that isn't known."""
        known = self._state(generation)
        if known is None:
            return None
        return "active" if generation == self.active() else known["status"]

    def begin(self, tables: dict[str, DataFrame]) -> str:
        """Writes a generation and gives its name; nothing reads it yet. One whose writing fails stays as failed."""
        name = f"gen-{uuid.uuid4().hex}"
        self._note(name, status="building", at=int(time.time() * 1000), tables=sorted(tables))
        try:
            for table, df in tables.items():
                df.write.parquet(f"{self.root}/{name}/{table}")
        except BaseException:
            self._note(name, status="failed", at=int(time.time() * 1000))
            raise
        self._note(name, status="ready")
        return name

    def begin_from_active(self, changes: dict[str, tuple[DataFrame, DataFrame, list[str]]]) -> str:
        """Writes a generation like the active one with changes: for each table rows to put, keys to delete, and the key."""
        base = self.active()
        tables = {}
        for table in (self._state(base) or {"tables": []})["tables"] if base else []:
            df = self.read(table, base)
            if table in changes:
                put, gone, keys = changes[table]
                df = upsert(without(df, gone, keys), put, keys)
            tables[table] = df
        return self.begin(tables)

    def promote(self, generation: str, revision: int, expected: str | None = None) -> None:
        """Makes a generation the active one.

        ValueError if it wasn't finished, its revision is older than the active one's, or
        ``expected`` is given and isn't the active one; Conflict if another promotion came between.
        """
        known = self._state(generation)
        if known is None or known["status"] not in ("ready", "retired"):
            raise ValueError(f"{generation} isn't finished")
        number, now = self._active()
        if expected is not None and now["generation"] != expected:
            raise ValueError(f"{now['generation']} is active, not {expected}")
        if now["revision"] is not None and revision < now["revision"]:
            raise ValueError(f"revision {revision} is older than {now['revision']}")
        self._pointer.replace(number, json.dumps({"generation": generation, "revision": revision}, sort_keys=True).encode())
        if now["generation"] and now["generation"] != generation:
            self._note(now["generation"], status="retired", at=int(time.time() * 1000))

    def discard(self, generation: str) -> None:
        """Removes a generation that isn't active."""
        if generation == self.active():
            raise ValueError("the active generation can't be discarded")
        self.objects.delete(generation)
        self.objects.delete(f"states/{generation}.json")

    def collect(self, older_ms: int = 0, most: int = 8, now_ms: int | None = None) -> list[str]:
        """Removes retired and failed generations that have been so for ``older_ms``, at most ``most``, oldest first."""
        now = int(time.time() * 1000) if now_ms is None else now_ms
        states = [(self._state(name), name) for name in (k.removeprefix("states/").removesuffix(".json") for k, *_ in self.objects.list("states/"))]
        idle = sorted((s["at"], name) for s, name in states if s and s["status"] in ("retired", "failed") and name != self.active() and now - s["at"] >= older_ms)
        for _, name in idle[:most]:
            self.discard(name)
        return [name for _, name in idle[:most]]


__all__ = ["Conflict", "Store"]
