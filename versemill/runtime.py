"""Session helpers: table access, lineage cuts in the shared folder, and size checks before a broadcast."""

from __future__ import annotations

import re
import sys
import tempfile
import types
import uuid
import weakref
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Largest side, in bytes, that an operator may mark for broadcast after measuring it.
BROADCAST_BYTES = 32 << 20

#: The folder made for an application whose session names none; the setting itself cannot be changed once it runs.
_local: dict[str, str] = {}
#: Where stored frames lie, by the frame's identity.
_paths: dict[int, tuple[weakref.ref, str]] = {}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One parquet table of a data folder."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Where the session names none, a fresh local folder does if the
    whole session is one machine (tests); on a cluster that is an error."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if at:
        return at
    if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _local:
        _local[app] = "file://" + tempfile.mkdtemp(prefix="versemill-")
    return _local[app]


def fresh_folder(spark: SparkSession) -> str:
    """A new path in the shared folder; what is written there goes when the driver's file system closes."""
    path = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(jpath)
    return path


def stored(df: DataFrame) -> DataFrame:
    """The frame written once to the shared folder and read back: a lineage cut that outlives lost executors.

    Written as parquet, so later steps prune columns and know the size. Empty frames keep their schema. The folder goes
    with `release`, or when the driver's file system closes.
    """
    spark = df.sparkSession
    path = fresh_folder(spark)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _paths[id(out)] = (weakref.ref(out, lambda _, k=id(out): _paths.pop(k, None)), path)
    return out


def release(*frames: DataFrame) -> None:
    """Delete stored frames that nothing will read again, so that rounds of a loop do not pile up in the shared folder."""
    for df in frames:
        held, path = _paths.get(id(df), (None, None))
        if path is not None and held() is df:
            jpath = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            jpath.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(jpath, True)
            _paths.pop(id(df), None)


def kept_in_worker(key: tuple, make: Callable[[], object]) -> object:
    """A value made once in each Python worker and kept for its later tasks; functions sent to workers have no memory of their own."""
    held = sys.modules.setdefault("_versemill_kept", types.ModuleType("_versemill_kept")).__dict__
    if key not in held:
        held[key] = make()
    return held[key]


def small(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """Mark a side for broadcast if its measured text size is under the limit; otherwise leave the join to Spark."""
    size = df.agg(F.sum(sum((F.coalesce(F.length(F.col(c).cast("string")), F.lit(0)) + 16 for c in df.columns), F.lit(0)))).first()[0]
    return F.broadcast(df) if (size or 0) <= limit else df
