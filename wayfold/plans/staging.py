"""Intermediate tables in the folder that the whole cluster shares, and what is done to files there.

A staged table cuts lineage: what reads it never recomputes what made it, and a lost
executor loses nothing, since the files stand in ``spark.checkpoint.dir``.  A parquet
table is preferred to ``checkpoint()`` because readers prune its columns.
"""

from __future__ import annotations

import atexit
import contextlib
import hashlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_DIR = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; where none is set, a temporary one in local mode (tests), and an error elsewhere."""
    root = spark.conf.get(_DIR, None)
    if not root:
        if not (spark.sparkContext.master == "local" or spark.sparkContext.master.startswith("local[")):
            raise RuntimeError(f"set {_DIR} to a folder that driver and executors share")
        root = f"file://{tempfile.mkdtemp(prefix='wayfold-')}"
        spark.conf.set(_DIR, root)
    return root.rstrip("/")


#: Folders that go when the driver ends.
_SWEPT: set[str] = set()


def _own_folder(spark: SparkSession) -> str:
    """The application's folder; it is deleted when the driver's Python ends, as what stands there has no other reader."""
    folder = f"{shared_dir(spark)}/wayfold/{spark.sparkContext.applicationId}"
    if folder not in _SWEPT:
        _SWEPT.add(folder)
        atexit.register(_sweep, *_file(spark, folder))
    return folder


def _sweep(fs, at) -> None:
    with contextlib.suppress(Exception):  # the JVM may be gone by then
        fs.delete(at, True)


#: Bytes of files whose rows are joined by a table in the driver at most.
_BROADCAST = 1_000_000
_THRESHOLD = "spark.sql.autoBroadcastJoinThreshold"


def bound_broadcasts(spark: SparkSession) -> None:
    """From now on the session broadcasts by itself only what is small in the driver, too.

    Spark goes by the size of compressed columns; ids and costs of points and arcs take ten to thirty times as much
    as a hash table, and a query has many joins.
    """
    now = spark._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold()
    if now > _BROADCAST:
        spark.conf.set(_THRESHOLD, str(_BROADCAST))


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as parquet under the shared folder and return the written table."""
    spark = df.sparkSession
    bound_broadcasts(spark)
    path = f"{_own_folder(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def unstage(df: DataFrame) -> None:
    """Delete the files of a staged table that nothing will read again."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        if "/wayfold/" not in folder:
            raise ValueError(f"not a staged table: {folder}")
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def _file(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def exists(spark: SparkSession, path: str) -> bool:
    fs, at = _file(spark, path)
    return fs.exists(at)


def stamp_of(spark: SparkSession, path: str) -> str:
    """What changes when a file or folder does: sizes and times of its files; empty where there is none."""
    fs, at = _file(spark, path)
    if not fs.exists(at):
        return ""
    found = fs.listStatus(at) if fs.getFileStatus(at).isDirectory() else [fs.getFileStatus(at)]
    return ",".join(sorted(f"{f.getPath().getName()}:{f.getLen()}:{f.getModificationTime()}" for f in found))


def publish(spark: SparkSession, source: str, target: str) -> None:
    """Puts a finished folder in its place, in one step; what stood there goes."""
    fs, at = _file(spark, target)
    fs.delete(at, True)
    fs.mkdirs(at.getParent())
    if not fs.rename(_file(spark, source)[1], at):
        raise OSError(f"{source} could not be moved to {target}")


def cached(spark: SparkSession, folder: str, name: str, key: str, build) -> DataFrame:
    """A table that stands in ``folder`` under the hash of what it is made from; made and put there the first time."""
    path = f"{folder.rstrip('/')}/{name}-{hashlib.sha256(key.encode()).hexdigest()[:24]}"
    if not exists(spark, f"{path}/_SUCCESS"):
        half = f"{path}.{uuid.uuid4().hex}"
        build().write.parquet(half)
        if exists(spark, f"{path}/_SUCCESS"):  # another session was faster: both made the same
            fs, at = _file(spark, half)
            fs.delete(at, True)
        else:
            publish(spark, half, path)
    return spark.read.parquet(path)
