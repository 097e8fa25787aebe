"""Tables between jobs, in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import functools
import gc
import heapq
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; a temporary one of our own only where that is unset."""
    if folder := spark.conf.get("spark.checkpoint.dir", None):
        return folder.rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        _OWN[app] = tempfile.mkdtemp(prefix="tidewater-")
        atexit.register(shutil.rmtree, _OWN[app], ignore_errors=True)
        spark.sparkContext.setCheckpointDir(_OWN[app])
    return _OWN[app]


def stash(df: DataFrame, label: str) -> DataFrame:
    """Write df to the shared folder and read it back: cuts the lineage and survives lost executors."""
    path = f"{shared_folder(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.stash_path = path
    return out


def dealt(stashed: DataFrame, n: int) -> DataFrame:
    """A stashed table in n partitions (and one) at most, of about the same size: whole files, the largest first, each to the
    partition that has least. Splits by bytes would leave some without a row group and give others many."""
    spark = stashed.sparkSession
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(stashed.stash_path)
    files = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(where)
    sizes = sorted(((f.getLen(), f.getPath().toString()) for f in files if f.getPath().getName().startswith("part-")), reverse=True)
    groups = [(0, i, []) for i in range(min(n, len(sizes)))]
    for size, path in sizes:
        held, i, paths = heapq.heappop(groups)
        heapq.heappush(groups, (held + size, i, [*paths, path]))
    # Spark 4.1 makes one partition of a union of single ones; the first, least part has two, so that it is none of those.
    parts = [spark.read.schema(stashed.schema).parquet(*paths).coalesce(1 + (i == 0)) for i, (_, _, paths) in enumerate(sorted(groups))]
    return functools.reduce(DataFrame.union, parts) if parts else stashed


def exists(spark: SparkSession, path: str) -> bool:
    """Whether there is such a file or folder, in whatever store the path names."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def release(spark: SparkSession, *used_up: DataFrame) -> None:
    """Delete stashed tables that nothing reads any more, and let Spark remove the shuffle files of finished jobs,
    which it does when the driver's JVM finds their handles unreachable."""
    jvm = spark.sparkContext._jvm
    for df in used_up:
        path = jvm.org.apache.hadoop.fs.Path(df.stash_path)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    gc.collect()
    jvm.System.gc()
