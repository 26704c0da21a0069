"""Helpers the corpus operators share: tables, checkpoints, connected components, small numpy parts."""

from __future__ import annotations

import contextlib
import ctypes
import functools
import os
import tempfile
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from linkweave.checkpoints import written as checkpointed

#: White space that separates words: U+0020 and U+0009 to U+000D. bytes.split() uses the same set.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    """How many parts a shuffle has; a cluster sets it in proportion to its data."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def apart(operator: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """The same function of a table, whatever the table's columns are named.

    Names that begin with two underscores are the operators' own; the table's columns that begin so are renamed meanwhile."""

    @functools.wraps(operator)
    def run(docs: DataFrame, *args: Any, **options: Any) -> DataFrame:
        theirs = [c for c in docs.columns if c.startswith("__")]
        prefix = "own"
        while any(c.lower().startswith(prefix) for c in docs.columns):
            prefix += "n"
        other = {c: f"{prefix}{k}" for k, c in enumerate(theirs)}
        out = operator(docs.withColumnsRenamed(other), *args, **options)
        return out.withColumnsRenamed({v: k for k, v in other.items()})

    return run


def hashable(docs: DataFrame) -> list[Column]:
    """A table's columns for a hash of its rows; maps and variants have none and are taken as JSON."""
    out = []
    for name, kind in docs.dtypes:
        c = F.col(f"`{name.replace('`', '``')}`")
        out.append(F.to_json(F.struct(c.alias("c"))) if "map<" in kind or "variant" in kind else c)
    return out


#: Numbers that one row is spread to at once, at most.
SPREAD = 1 << 16


def spread(rows: DataFrame, first: Column, n: Column, name: str) -> DataFrame:
    """rows with a column `name` that counts from first to first + n - 1: n rows for each.

    A row that counts far is cut into ranges of SPREAD numbers first, which are dealt out before they are spread: no task
    gets more from one row than from another, and no array is longer than SPREAD or n / SPREAD."""
    last = first + n - 1
    ranged = rows.where(n > 0).withColumn("__range", F.explode(F.sequence(first, last, F.lit(SPREAD).cast("long")))).withColumn("__last", F.least(last, F.col("__range") + SPREAD - 1))
    return ranged.repartition("__range").withColumn(name, F.explode(F.sequence("__range", "__last"))).drop("__range", "__last")


def slices(batches: Iterator[pa.RecordBatch], column: str, most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about `most` bytes of `column` at most (a longer row is alone)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        values = batch.column(batch.schema.get_field_index(column))
        lengths = np.asarray(pc.binary_length(values).fill_null(0).to_numpy(zero_copy_only=False), dtype=np.int64)
        ends, start = np.cumsum(lengths), 0
        while start < batch.num_rows:
            before = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + most, side="right")))
            yield batch.slice(start, stop - start)
            start = stop


def utf8(values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts of an Arrow array, one after another, and the n + 1 offsets. Null: empty."""
    values = values.cast(pa.large_binary()).fill_null(b"")
    if isinstance(values, pa.ChunkedArray):
        values = values.combine_chunks()
    offsets = np.frombuffer(values.buffers()[1], dtype=np.int64)[values.offset : values.offset + len(values) + 1]
    data = values.buffers()[2]
    whole = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


def labelled(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For the nodes 0 to n - 1 the smallest node that the links a-b reach."""
    label = np.arange(n)
    while True:
        x, y = label[a], label[b]
        open_ = x != y
        if not open_.any():
            return label
        a, b, x, y = a[open_], b[open_], x[open_], y[open_]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while not np.array_equal(jumped := label[label], label):
            label = jumped


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, component) for every node that has a link to another; links: two long columns.

    component is the smallest node reached. Large-star and small-star rounds (each two aggregations
    and two joins, whose hot hubs adaptive execution splits), until nothing changes; each round's
    links are written to the shared checkpoint folder. Nothing but a count and a sum reaches the driver."""
    one, two = links.columns[:2]
    edges = links.select(F.col(one).cast("long").alias("a"), F.col(two).cast("long").alias("b")).where("a <> b")
    edges = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges, seen = checkpointed(edges), None
    for _ in range(most_rounds):
        told = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(told) == seen or not told[0]:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(edges.select("b", "b").distinct())
        seen = tuple(told)
        both = edges.union(edges.select("b", "a")).toDF("u", "v")
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select("a", "b", "m")
        edges = small.select("a", F.col("m").alias("b")).union(small.where("b <> m").select(F.col("b"), F.col("m"))).where("a <> b").distinct()
        edges = checkpointed(edges)
    raise RuntimeError("components: no end after all rounds")


def packed_ranges(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted, merged (touching ones too) half-open ranges."""
    if not len(starts):
        return starts, ends
    order = np.argsort(starts, kind="stable")
    starts, reach = starts[order], np.maximum.accumulate(ends[order])
    first = np.concatenate([[True], starts[1:] > reach[:-1]])
    at = np.flatnonzero(first)
    return starts[at], reach[np.concatenate([at[1:] - 1, [len(starts) - 1]])]


def frugal(task: Callable) -> Callable:
    """The same function of batches, which gives memory back when it ends: Python workers stay for later tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from task(batches)
        finally:
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):  # not the GNU C library
                ctypes.CDLL(None).malloc_trim(0)

    return run


def scratch() -> str:
    """A folder for one task's own files, which it removes before it ends; another task never reads them."""
    return tempfile.mkdtemp(prefix="linkweave-task-", dir=os.environ.get("TMPDIR"))


def whole_groups(batches: Iterator[pa.RecordBatch], key: int) -> Iterator[list[np.ndarray]]:
    """Columns of rows that are sorted by column `key`, never with a group cut in two."""
    held: list[pa.RecordBatch] = []
    last = None

    def columns() -> list[np.ndarray]:
        return [np.concatenate([b.column(i).to_numpy(zero_copy_only=False) for b in held]) for i in range(held[0].num_columns)]

    for batch in batches:
        if not batch.num_rows:
            continue
        group = batch.column(key).to_numpy(zero_copy_only=False)
        if held and group[-1] != last:  # what is held ends where the last group begins
            cut = 0 if group[0] == group[-1] else int(np.flatnonzero(group != group[-1])[-1]) + 1
            held.append(batch.slice(0, cut))
            yield columns()
            held = [batch.slice(cut)]
        else:
            held.append(batch)
        last = group[-1]
    if held:
        yield columns()
