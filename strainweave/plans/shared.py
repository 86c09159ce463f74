"""Tables in the folder that all executors share, in place of in-memory checkpoints.

A step that is read more than once, or a loop's result, is written there as Parquet and read back: that cuts the
lineage, and a lost executor costs only the tasks it was running.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, Observation, SparkSession

_LOCAL: dict[str, str] = {}
#: Steps of the scopes that are open, the innermost last.
_OPEN: list[list[Written]] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; where that is unset, a fresh one of this machine, in local mode only."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local[") and context.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if context.applicationId not in _LOCAL:
        _LOCAL[context.applicationId] = "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    return _LOCAL[context.applicationId]


class Written:
    """A written table and its place."""

    def __init__(self, spark: SparkSession, path: str, df: DataFrame):
        self.spark, self.path, self.df = spark, path, df

    def drop(self) -> None:
        """Removes the files; only for steps that nothing reads any more."""
        jvm = self.spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(self.path)
        at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def write_step(df: DataFrame, name: str, by: list[str] | None = None) -> Written:
    """Writes df to the shared folder, partitioned by the columns `by`; .df reads it back."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.partitionBy(*by or []).parquet(path)
    step = Written(spark, path, spark.read.schema(df.schema).parquet(path))
    if _OPEN:
        _OPEN[-1].append(step)
    return step


def write_counted(df: DataFrame, name: str, **counts: Column) -> tuple[Written, dict]:
    """write_step, and aggregates of df taken while it is written; 0 where there is nothing to count."""
    seen = Observation()
    step = write_step(df.observe(seen, *[c.alias(k) for k, c in counts.items()]), name)
    try:
        got = seen.get
    except Py4JJavaError:  # nothing is observed where adaptive execution finds a plan without rows
        if step.df.limit(1).count():
            raise
        got = {}
    return step, {k: got.get(k) or 0 for k in counts}


def cut(df: DataFrame, name: str) -> DataFrame:
    """df, written to the shared folder and read back; while a scope is open it goes with it."""
    return write_step(df, name).df


@contextmanager
def scope() -> Iterator[Callable[[DataFrame, str], DataFrame]]:
    """Steps written inside are removed at its end, but for what keep(df, name) writes: that belongs to the scope around it.

    What leaves the scope must be kept, or no longer be read.
    """
    own: list[Written] = []
    kept: list[Written] = []
    _OPEN.append(own)

    def keep(df: DataFrame, name: str) -> DataFrame:
        kept.append(write_step(df, name))
        own.remove(kept[-1])
        return kept[-1].df

    try:
        yield keep
    finally:
        _OPEN.pop()
        for step in own:
            step.drop()
        if _OPEN:
            _OPEN[-1].extend(kept)
