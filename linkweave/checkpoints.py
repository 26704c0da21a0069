"""Results that several later steps read, written once, and the folder for them."""

from __future__ import annotations

import atexit
import contextlib
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

from pyspark import SparkContext
from pyspark.sql import DataFrame, SparkSession


def shared(spark: SparkSession) -> str:
    """The folder that all executors share (spark.checkpoint.dir).

    Only on a local master, as in tests, is a folder made where the setting is missing: on a cluster executors couldn't read each
    other's files in it, so that is refused."""
    context = spark.sparkContext
    if not context.getCheckpointDir():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and context.master.split("[")[0] != "local":
            raise RuntimeError("spark.checkpoint.dir has to name a folder that all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="linkweave-checkpoint-"))
    return context.getCheckpointDir()


#: Applications whose folder is removed when the interpreter ends.
_ENDING: set[str] = set()
#: What is written while released() holds, the innermost last.
_HELD: list[list[str]] = []


def fresh(spark: SparkSession, name: str, lasting: bool = False) -> str:
    """A path in the shared folder that nothing has yet; what is written there goes when the interpreter ends, or before: discard() and, unless it is lasting, released()."""
    context = spark.sparkContext
    folder = f"{shared(spark).rstrip('/')}/linkweave-{context.applicationId}"
    if folder not in _ENDING:
        _ENDING.add(folder)
        atexit.register(_remove, context, folder)
    path = f"{folder}/{name}-{uuid.uuid4().hex}"
    if _HELD and not lasting:
        _HELD[-1].append(path)
    return path


def _remove(context: SparkContext, path: str) -> None:
    if context._jsc is None:  # the session has ended: local folders alone can be reached
        shutil.rmtree(path.removeprefix("file://").removeprefix("file:"), ignore_errors=True)
        return
    with contextlib.suppress(Exception):  # py4j's, if the JVM has ended
        at = context._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(context._jsc.hadoopConfiguration()).delete(at, True)


def written(df: DataFrame) -> DataFrame:
    """df, computed now and kept in the shared folder: a lost executor costs nothing that was written."""
    shared(df.sparkSession)
    return df.checkpoint(eager=True)


def tabled(df: DataFrame, lasting: bool = False) -> DataFrame:
    """df, written as a table in the shared folder and read again: unlike written() with its size known, so that small ones are broadcast
    without a shuffle, and with columns read as they are asked for."""
    path = fresh(df.sparkSession, "table", lasting)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


#: Fewer buckets than shuffle partitions would have Spark shuffle them after all.
LEAST_BUCKETS = 16


def buckets(spark: SparkSession) -> int:
    """How many buckets dealt() writes."""
    return max(LEAST_BUCKETS, int(spark.conf.get("spark.sql.shuffle.partitions")))


def dealt(df: DataFrame, *keys: str, lasting: bool = False, ready: bool = False) -> DataFrame:
    """df, written as by tabled(), in buckets by keys: rows that are grouped by these, or by these and more, stay where they are. ready: df is dealt by keys into as many parts already.

    Buckets are known to the session's catalog alone; its name for them goes with the session."""
    spark = df.sparkSession
    path = fresh(spark, "table", lasting)
    n = buckets(spark)
    name = f"linkweave_{path.rpartition('-')[2]}"
    # a task writes whole buckets: dealt as buckets are, a file each
    rows = df if ready else df.repartition(n, *keys)
    rows.write.bucketBy(n, *keys).sortBy(*keys).option("path", path).format("parquet").saveAsTable(name)
    out = spark.table(name)
    out.stored_at = path
    return out


def discard(table: DataFrame) -> None:
    """Removes what tabled() wrote for this table; nothing may read it any more."""
    _remove(table.sparkSession.sparkContext, table.stored_at)


@contextlib.contextmanager
def released(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """What is written meanwhile is removed at the end, but for tables given to the function that this yields, which returns them.

    Results that aren't computed inside, or kept, can't be computed afterwards."""
    _HELD.append([])

    def keep(table: DataFrame) -> DataFrame:
        for paths in _HELD:
            if table.stored_at in paths:
                paths.remove(table.stored_at)
                if paths is not _HELD[0]:
                    _HELD[_HELD.index(paths) - 1].append(table.stored_at)
                break
        return table

    try:
        yield keep
    finally:
        for path in _HELD.pop():
            _remove(spark.sparkContext, path)
