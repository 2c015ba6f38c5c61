"""Objects on a Hadoop file system: put, get, list and replace under a condition, below one folder."""

from __future__ import annotations

import hashlib
import os
import uuid
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import SparkSession


class Conflict(Exception):
    """An object isn't what the condition of a write says."""


class Objects:
    """Small objects by key below a root; keys are relative paths without ``.`` and ``..``.

    A write goes to a hidden name first, so an object is there whole or not at all. An object that
    must not exist yet is put by a link or rename that fails where the name is taken: this is
    atomic on local folders and on HDFS; on stores without such a rename it holds for one writer.
    """

    def __init__(self, spark: SparkSession, root: str, prefix: str = "") -> None:
        self.spark, self.root = spark, root.rstrip("/") + (f"/{prefix.strip('/')}" if prefix.strip("/") else "")
        self._jvm = spark.sparkContext._jvm
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._fs = self._path("").getFileSystem(self._conf)
        self._local = self._fs.getScheme() == "file"

    def prefixed(self, prefix: str) -> Objects:
        """The objects below a prefix, as a store of its own."""
        return Objects(self.spark, self.root, prefix)

    def _path(self, key: str):
        if any(part in ("", ".", "..") for part in key.split("/")) and key:
            raise ValueError(f"{key} isn't a key")
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{key}" if key else self.root)

    def head(self, key: str) -> int | None:
        """The size of an object; None where there is none."""
        path = self._path(key)
        return self._fs.getFileStatus(path).getLen() if self._fs.exists(path) else None

    def get(self, key: str) -> bytes | None:
        """The bytes of an object; None where there is none."""
        if self.head(key) is None:
            return None
        stream = self._fs.open(self._path(key))
        try:
            return bytes(stream.readAllBytes())
        finally:
            stream.close()

    def _hidden(self, key: str, data: bytes):
        folder, _, name = key.rpartition("/")
        hidden = self._path(f"{folder}/.{name}.{uuid.uuid4().hex}" if folder else f".{name}.{uuid.uuid4().hex}")
        out = self._fs.create(hidden, True)
        out.write(bytearray(data))
        out.close()
        return hidden

    def put(self, key: str, data: bytes) -> None:
        """Writes an object, in place of what is there."""
        hidden = self._hidden(key, data)
        if self._local:
            os.replace(hidden.toUri().getPath(), self._path(key).toUri().getPath())
            return
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(hidden.toUri(), self._conf)
        options = self.spark.sparkContext._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = self._jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        context.rename(hidden, self._path(key), options)

    def put_absent(self, key: str, data: bytes) -> None:
        """Writes an object that must not be there; Conflict if it is."""
        hidden = self._hidden(key, data)
        try:
            if self._local:
                os.link(hidden.toUri().getPath(), self._path(key).toUri().getPath())
            elif self._fs.exists(self._path(key)) or not self._fs.rename(hidden, self._path(key)):
                raise FileExistsError
        except FileExistsError:
            raise Conflict(key) from None
        finally:
            self._fs.delete(hidden, False)

    def delete(self, key: str) -> bool:
        """Removes an object or all below a folder; whether there was any."""
        return self._fs.delete(self._path(key), True)

    def list(self, prefix: str = "") -> list[tuple[str, int, int]]:
        """key, size and time (milliseconds) of the objects whose key begins with a prefix, by key."""
        if not self._fs.exists(self._path("")):
            return []
        base, found = self._fs.makeQualified(self._path("")).toUri().getPath().rstrip("/") + "/", []
        every = self._fs.listFiles(self._path(""), True)
        while every.hasNext():
            status = every.next()
            key = status.getPath().toUri().getPath().removeprefix(base)
            if key.startswith(prefix) and not status.getPath().getName().startswith("."):
                found.append((key, status.getLen(), status.getModificationTime()))
        return sorted(found)

    def within(self, seconds: float, call: str, *given):
        """The result of a method by name; TimeoutError if it isn't there in time."""
        pool = ThreadPoolExecutor(1)
        try:
            return pool.submit(getattr(self, call), *given).result(timeout=seconds)
        finally:
            pool.shutdown(wait=False)

    def probe(self) -> dict[str, bool]:
        """Whether an object can be put, read, listed, kept from being put twice, and deleted."""
        key, data = f"probe-{uuid.uuid4().hex}", uuid.uuid4().bytes
        self.put_absent(key, data)
        try:
            out = {"read": self.get(key) == data, "listed": any(k == key for k, *_ in self.list("probe-"))}
            try:
                self.put_absent(key, data)
                out["conditional"] = False
            except Conflict:
                out["conditional"] = True
        finally:
            gone = self.delete(key)
        return out | {"deleted": gone}


class Versioned:
    """A value that is replaced under a condition: numbered objects of which the last counts.

    A writer names the number it read, and the next number can be put only once, so of two
    writers that read the same value one gets Conflict. Readers always find a value.
    """

    def __init__(self, objects: Objects, name: str) -> None:
        self.objects = objects.prefixed(name)

    def read(self) -> tuple[int, bytes | None]:
        """The number and bytes of the value; (0, None) where there is none yet."""
        keys = [k for k, *_ in self.objects.list()]
        return (int(keys[-1]), self.objects.get(keys[-1])) if keys else (0, None)

    def replace(self, number: int, data: bytes, keep: int = 8) -> int:
        """Puts the value after ``number`` and gives its number; older ones than the last ``keep`` are removed."""
        self.objects.put_absent(f"{number + 1:012d}", data)
        for key, *_ in self.objects.list()[:-keep]:
            self.objects.delete(key)
        return number + 1


def digest(data: bytes) -> str:
    """The sha256 of bytes, as an object's tag."""
    return hashlib.sha256(data).hexdigest()
