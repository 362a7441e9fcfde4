"""Intermediate tables that several later steps read, written to the folder all executors share."""

from __future__ import annotations

import atexit
import tempfile
import threading
import uuid
import weakref
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Spark's setting to remove shuffle files when a query ends, not when the driver collects garbage.
CLEAN_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_lock = threading.Lock()
_writers: dict[str, list] = {}
_folders: dict[str, SparkSession] = {}
_paths: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``. Only a local master, whose executors
    share the driver's disk, may do without; then it is a temporary folder."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="gapbook-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def run_folder(spark: SparkSession) -> str:
    """This application's folder below the shared one; it is deleted when Python ends."""
    folder = f"{shared_dir(spark)}/gapbook-{spark.sparkContext.applicationId}"
    if folder not in _folders:
        _folders[folder] = spark
        atexit.register(remove_folder, folder)
    return folder


def remove_folder(folder: str) -> None:
    """Delete what an application has written, if its session still runs. Tables read back from there
    can no longer be used."""
    spark = _folders.pop(folder, None)
    if spark is not None and spark.sparkContext._jsc is not None:
        _delete(spark, folder)


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of queries inside go when each query ends. Writers in several threads share the
    session's setting: the first turns it on, the last puts back what was there."""
    session = spark._jsparkSession.sessionUUID()
    with _lock:
        held = _writers.setdefault(session, [0, spark.conf.get(CLEAN_SHUFFLES, "false")])
        held[0] += 1
        spark.conf.set(CLEAN_SHUFFLES, "true")
    try:
        yield
    finally:
        with _lock:
            held[0] -= 1
            if not held[0]:
                spark.conf.set(CLEAN_SHUFFLES, held[1])
                del _writers[session]


def materialise(frame: DataFrame, tag: str, codec: str | None = None) -> DataFrame:
    """``frame`` written as Parquet (in a codec other than the session's, if one is named) and read back:
    computed once, a cut in the lineage, and safe from lost executors."""
    spark = frame.sparkSession
    path = f"{run_folder(spark)}/{tag}-{uuid.uuid4().hex}"
    writer = frame.write.option("compression", codec) if codec else frame.write
    with shuffles_removed(spark):
        writer.parquet(path)
    found = spark.read.schema(frame.schema).parquet(path)
    _paths[found] = path
    return found


def discard(frame: DataFrame) -> None:
    """Delete what ``materialise`` has written for ``frame``, once nothing derived from it is still to be
    computed: a loop frees the table of its former step."""
    path = _paths.pop(frame, None)
    if path is not None:
        _delete(frame.sparkSession, path)
