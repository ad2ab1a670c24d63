"""The folder that driver and executors share, and tables that are written there to end a lineage."""

from __future__ import annotations

import atexit
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Where tables go in a session on one machine that names no shared folder, as in tests.
LOCAL_SHARED = "/tmp/checkpoints"
#: Files of a written table for each core, at most.
FILES_A_CORE = 2
#: Partitions of a result for each core, at most.
TASKS_A_CORE = 4


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where that is unset, a local session gets a folder of
    ours, and a cluster an error, as its executors would each write to a disk of their own."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = LOCAL_SHARED
        spark.sparkContext.setCheckpointDir(root)
    return f"{root.rstrip('/')}/strandline-{spark.sparkContext.applicationId}"


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder through Hadoop's file system, so any store works."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def _leave(spark: SparkSession) -> None:
    try:
        remove(spark, shared_dir(spark))
    except Exception:  # the session may have ended before the interpreter
        pass


_REGISTERED: set[str] = set()
#: Paths of the tables that were written in each open scratch block.
_SCRATCH: list[list[str]] = []


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder; it goes with its scratch block, or with the whole folder at exit."""
    if (app := spark.sparkContext.applicationId) not in _REGISTERED:
        _REGISTERED.add(app)
        atexit.register(_leave, spark)
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
    if _SCRATCH:
        _SCRATCH[-1].append(path)
    return path


def gathered(df: DataFrame, per_core: int = TASKS_A_CORE) -> DataFrame:
    """df in at most per_core partitions for each core, without a shuffle: a task goes through several partitions one after
    the other, so small tables don't become thousands of tiny files. Where cores come and go as they are asked for, df as
    it is."""
    context = df.sparkSession.sparkContext
    if context.getConf().get("spark.dynamicAllocation.enabled", "false") == "true":
        return df
    return df.coalesce(per_core * context.defaultParallelism)


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder: lineage ends there, and a lost executor costs nothing of what was done before. At
    most FILES_A_CORE tasks a core write it (see `gathered`)."""
    spark = df.sparkSession
    df = gathered(df, FILES_A_CORE)
    df.write.parquet(path := new_path(spark, name))
    out = spark.read.schema(df.schema).parquet(path)
    out._strandline_path = path
    return out


@contextmanager
def scratch(spark: SparkSession) -> Iterator[list[DataFrame]]:
    """Tables that are written inside go at the end, but for those (what `written` returned) that are put into the list."""
    _SCRATCH.append([])
    kept: list[DataFrame] = []
    try:
        yield kept
    finally:
        paths, stay = _SCRATCH.pop(), {df._strandline_path for df in kept}
        for path in paths:
            if path not in stay:
                remove(spark, path)
            elif _SCRATCH:
                _SCRATCH[-1].append(path)
