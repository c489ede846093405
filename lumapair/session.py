"""What every job of the library needs from a session."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
import zipfile
from collections.abc import Iterable
from pathlib import Path
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession

#: Used only when the session names no shared folder, as in local tests.
LOCAL_CHECKPOINTS = "/tmp/checkpoints"

_shipped: set[str] = set()
#: Written tables: path to application, and DataFrame to path.
_tables: dict[str, str] = {}
_path_of: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once per application."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parent
    archive = os.path.join(tempfile.mkdtemp(), f"{root.name}.zip")
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    sc.addPyFile(archive)
    _shipped.add(sc.applicationId)


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Only a local session may do without it."""
    given = spark.conf.get("spark.checkpoint.dir", None)
    if not given and not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return (given or LOCAL_CHECKPOINTS).rstrip("/")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back.

    Cuts lineage, so a lost executor costs the rereading of files rather than
    the recomputation of everything before, and gives later joins true sizes.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tables/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    written = spark.read.schema(df.schema).parquet(path)
    _tables[path] = spark.sparkContext.applicationId
    _path_of[written] = path
    return written


def delete(spark: SparkSession, path: str) -> None:
    """Remove a folder of the shared store, if it is there."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def _file_system(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    at, store = _file_system(spark, path)
    return store.exists(at)


def rename(spark: SparkSession, path: str, to: str) -> None:
    """Give a folder of the shared store its name; if that is taken, the folder goes."""
    at, store = _file_system(spark, path)
    target = spark._jvm.org.apache.hadoop.fs.Path(to)
    if store.exists(target) or not store.rename(at, target):
        store.delete(at, True)


def files_below(spark: SparkSession, path: str) -> list[tuple[str, int, int]]:
    """(path, bytes, time) of the files below a path, in order."""
    at, store = _file_system(spark, path)
    found, listed = [], store.listFiles(at, True)
    while listed.hasNext():
        f = listed.next()
        found.append((f.getPath().toString(), f.getLen(), f.getModificationTime()))
    return sorted(found)


def folder(spark: SparkSession, name: str) -> str:
    """A new folder's path on the shared store, which `drop_tables` removes like a table."""
    path = f"{shared_dir(spark)}/tables/{name}-{uuid.uuid4().hex}"
    _tables[path] = spark.sparkContext.applicationId
    return path


def ship_file(spark: SparkSession, name: str, parts: Iterable[bytes]) -> str:
    """Write a file to the shared folder part by part and have Spark hand it to every executor; returns its name for `SparkFiles.get`.

    It stays there, since executors that start later fetch it too.
    """
    own = f"{name}-{uuid.uuid4().hex}"
    at, store = _file_system(spark, f"{shared_dir(spark)}/files/{own}")
    out = store.create(at)
    try:
        for part in parts:
            out.write(bytearray(part))
    finally:
        out.close()
    spark.sparkContext.addFile(store.makeQualified(at).toString())
    return own


def discard(*tables: DataFrame) -> None:
    """Remove tables that `materialize` returned and that nothing reads any more."""
    for t in tables:
        if path := _path_of.pop(t, None):
            _tables.pop(path, None)
            delete(t.sparkSession, path)


def drop_tables(spark: SparkSession) -> None:
    """Remove every table that this application has written so far; for use when all results that read them are written."""
    for path, app in list(_tables.items()):
        if app == spark.sparkContext.applicationId:
            del _tables[path]
            delete(spark, path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
