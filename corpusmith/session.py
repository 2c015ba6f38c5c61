"""Session helpers: a local session for tests, and the shared folder that jobs may write to."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int = 8, name: str = "corpusmith", **conf: str) -> SparkSession:
    """A single-JVM session for tests and benchmarks; clusters bring their own session."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


_temporary: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share (``spark.checkpoint.dir``).

    Only where the session names none, and only in local mode, a temporary folder takes its place.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local[") and context.master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    # the setting can't be changed once a session runs, so the folder is remembered here
    key = context.applicationId
    if key not in _temporary:
        _temporary[key] = f"file://{tempfile.mkdtemp(prefix='corpusmith-')}"
    return _temporary[key]


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors of a cluster on which it isn't installed."""
    import os
    import zipfile

    folder = os.path.dirname(os.path.abspath(__file__))
    target = os.path.join(tempfile.mkdtemp(prefix="corpusmith-"), "corpusmith.zip")
    with zipfile.ZipFile(target, "w") as archive:
        for base, _, files in os.walk(folder):
            for name in files:
                if name.endswith(".py"):
                    path = os.path.join(base, name)
                    archive.write(path, os.path.join("corpusmith", os.path.relpath(path, folder)))
    spark.sparkContext.addPyFile(target)


_written: list[tuple[SparkSession, str]] = []


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage of ``df``: write it to the shared folder as Parquet and read it again.

    The copy survives the loss of executors, unlike a local checkpoint. It is removed when the
    driver ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/corpusmith-{uuid.uuid4().hex}/{name}"
    df.write.parquet(path)
    if not _written:
        atexit.register(_clean)
    _written.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def kept_folder(spark: SparkSession, name: str) -> str:
    """A folder below the shared one that is removed when the driver ends."""
    path = f"{shared_dir(spark)}/corpusmith-{uuid.uuid4().hex}/{name}"
    if not _written:
        atexit.register(_clean)
    _written.append((spark, path))
    return path


def still_there(df: DataFrame) -> bool:
    """Whether the files of a materialized table haven't been removed by others."""
    files = df.inputFiles()
    if not files:
        return True
    spark = df.sparkSession
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(files[0])
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def release(df: DataFrame) -> None:
    """Remove the files of a materialized table that no later action reads."""
    files = set(df.inputFiles())
    for entry in list(_written):
        if any(entry[1].split("://")[-1] in f for f in files):
            _remove(*entry)
            _written.remove(entry)


def _remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path).getParent()
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def _clean() -> None:
    for spark, path in _written:
        try:
            _remove(spark, path)
        except Exception:  # noqa: BLE001 - the JVM may be gone already
            return
