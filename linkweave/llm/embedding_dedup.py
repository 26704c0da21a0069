"""Near-duplicate vectors by a pivot-permutation index.

A vector is described by its `prefix` nearest pivots out of a set of reference points. Inverted lists hold, for each pivot, the
vectors that have it; two vectors are candidates if they share `shared` pivots or more, and candidates are verified by
their cosine in double precision. As `shared` common pivots are asked for, lists need only the prefix - shared + 1 rarest pivots of
each vector, and a pair is looked at only in the list of its rarest common pivot: once, whatever else it shares.

Equal vectors are one class, which goes into the index once with the number of its ids, however many there are. Shared pivots are counted
tile by tile. A tile's links become counts for each class and a spanning forest, so pairs are never written out. Lists of
over `tile` classes are cut into tiles, every two of which meet in a task of their own.

Bounds (parameters): pivots are chosen from a sample of twice as many vectors, SAMPLE at least, the only ones that reach the driver: the first FARTHEST of them
farthest first, one after another, the others as the sample has them; every vector is indexed. The more pivots there are, the less do two vectors' nearest ones
agree, so prefixes grow with the pivots (prefix_for()), and recall stays. Their number grows with the square root of the table up to MOST_PIVOTS, that is up to 10 ** 9
different vectors, so that all lists together grow with the table's power of 1.5. Recall is measured in the tests.

Defined cases: vectors that are null, zero, or hold null or non-finite components link with nothing; so do rows with a null
id. Vectors of different lengths don't link; each length has a sample and pivots of its own. Rows that repeat an id and vector are one vector and get one result each; an id
with several vectors links if one of them does, and stays outside the classes. Ties of distance go to the pivot first in order. Other columns, labels among them, are
ignored; an empty table gives an empty result. Vectors are taken for equal by 96 bits of hashes and their length."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkweave.llm.common import checkpointed, components, frugal, labelled, partitions, whole_groups

SAMPLE, MOST_PIVOTS, FARTHEST, PREFIX, SHARED, TILE = 4096, 1 << 16, 1024, 14, 4, 4096


def unit(values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Rows that can link, as unit vectors in double precision, and which rows of values they are; the most frequent length only."""
    flat, lengths = values.flatten(), pc.list_value_length(values).fill_null(0).to_numpy(zero_copy_only=False)
    if not len(lengths) or not lengths.max():
        return np.zeros(0, np.int64), np.zeros((0, 0))
    return _unit(flat, lengths, int(np.bincount(lengths[lengths > 0]).argmax()))


def _unit(flat: pa.Array, lengths: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    starts = np.cumsum(lengths) - lengths
    rows = np.flatnonzero(lengths == width)
    data = flat.cast(pa.float64()).fill_null(np.nan).to_numpy(zero_copy_only=False)
    x = data[starts[rows][:, None] + np.arange(width)] if len(rows) else np.zeros((0, width))
    fine = np.isfinite(x).all(1)
    rows, x = rows[fine], x[fine]
    scale = np.abs(x).max(1, initial=0)
    rows, x = rows[scale > 0], x[scale > 0] / scale[scale > 0][:, None]
    return rows, x / np.sqrt((x * x).sum(1))[:, None]


def prefix_for(pivots: int, prefix: int = PREFIX) -> int:
    """How many nearest pivots describe a vector: two more for each doubling of the pivots beyond 2,048."""
    return prefix + 2 * max(0, (pivots - 1).bit_length() - 11)


def choose_pivots(x: np.ndarray, n: int, alike: float = 0.8) -> np.ndarray:
    """Up to n rows of x, the first FARTHEST farthest first; none of those is closer than the cosine `alike` to one before it, while there are others.

    The others are the first rows that aren't as close to one of those: no step is made for each of them."""
    if not len(x):
        return x
    chosen, nearest = [0], x @ x[0]
    while len(chosen) < min(n, FARTHEST, len(x)):
        k = int(nearest.argmin())
        if nearest[k] >= alike and len(chosen) >= PREFIX:
            break
        chosen.append(k)
        nearest = np.maximum(nearest, x @ x[k])
        nearest[chosen] = np.inf
    if len(chosen) == FARTHEST < n:
        chosen += np.flatnonzero(nearest < alike)[: n - FARTHEST].tolist()
    return x[chosen]


def nearest_pivots(x: np.ndarray, pivots: np.ndarray, prefix: int) -> np.ndarray:
    """(rows, prefix) numbers of the nearest pivots, in order of nearness."""
    most = max(1, (1 << 22) // max(1, len(pivots)))  # rows at a time, so that their scores take 32 MB
    if len(x) > most:
        return np.concatenate([nearest_pivots(x[k : k + most], pivots, prefix) for k in range(0, len(x), most)])
    score = x @ pivots.T
    prefix = min(prefix, score.shape[1])
    part = np.argpartition(-score, prefix - 1, axis=1)[:, :prefix] if prefix < score.shape[1] else np.tile(np.arange(score.shape[1]), (len(x), 1))
    return np.take_along_axis(part, np.lexsort((part, -np.take_along_axis(score, part, 1)), axis=1), 1)


def linked(x: np.ndarray, near: np.ndarray, weight: np.ndarray, ids: np.ndarray, pivot: int, cut: int | None, cosine: float, shared: int, block: int = 128) -> tuple[np.ndarray, np.ndarray]:
    """For the vectors of one list: how many others each links with here (by weight), and the component's first row.

    near: the pivots of each. cut: None, or where the second tile begins, when only pairs across it are asked for."""
    n, prefix = near.shape
    count, label = np.zeros(n, np.int64), np.arange(n)
    used, at = np.unique(near, return_inverse=True)
    at = at.reshape(near.shape)
    # which vectors have a pivot, as rows; a pivot rarer than this list's counts for more than all others together
    kind, dear = (np.uint8, 16) if prefix < 16 else (np.uint16, 256)
    has = np.zeros((len(used), n), kind)
    has[at, np.arange(n)[:, None]] = np.where(near < pivot, dear, 1)
    end = n if cut is None else cut
    for i in range(0, end, block):
        rows = np.arange(i, min(i + block, end))
        start = i if cut is None else cut
        common = has[at[rows], start:].sum(1, dtype=kind)
        a, b = np.nonzero((common >= shared) & (common < dear))
        a, b = a + i, b + start
        fresh = ids[a] != ids[b] if cut is not None else (a < b) & (ids[a] != ids[b])
        a, b = a[fresh], b[fresh]
        for k in range(0, len(a), 1 << 15):
            p, q = a[k : k + (1 << 15)], b[k : k + (1 << 15)]
            close = np.einsum("ij,ij->i", x[p], x[q]) >= cosine
            p, q = p[close], q[close]
            np.add.at(count, p, weight[q])
            np.add.at(count, q, weight[p])
            u, v = label[p], label[q]
            open_ = u != v
            if open_.any():
                nodes, where = np.unique(np.concatenate([u[open_], v[open_]]), return_inverse=True)
                half = len(where) // 2
                joined, whole = labelled(len(nodes), where[:half], where[half:]), np.arange(n)
                whole[nodes] = nodes[joined]
                label = whole[label]
    return count, label


def _pivots(usable: DataFrame, total: int, prefix: int, shared: int) -> tuple[np.ndarray, int, int] | None:
    """The pivots for vectors of one length, the rarest first, and prefix and shared for so many; None if nothing can link."""
    wanted = min(MOST_PIVOTS, 1 << max(6, round(2 * total**0.5).bit_length()))
    seen = usable.orderBy(F.xxhash64("node"), "node").limit(max(SAMPLE, 2 * wanted)).select("v").toArrow().column(0).combine_chunks()
    seen = seen if isinstance(seen, pa.Array) else pa.concat_arrays(seen.chunks) if seen.num_chunks else pa.array([], pa.list_(pa.float32()))
    _, sample = unit(seen)
    pivots = choose_pivots(sample, wanted)
    if not len(pivots):
        return None
    pivots, sample = pivots.astype(np.float32), sample.astype(np.float32)
    prefix = min(prefix_for(len(pivots), prefix), len(pivots))
    often = np.bincount(nearest_pivots(sample, pivots, prefix).ravel(), minlength=len(pivots))
    return pivots[np.argsort(often, kind="stable")], prefix, min(shared, prefix)


KEY = ["h1", "h2", "width"]


def _classes(rows: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, bool]:
    """Of rows (vec_id, v, KEY, fine): classes (KEY, node: the smallest id, n: how many ids) of equal vectors, the ids with several
    vectors, the rows to index (node, n, v), and whether there are ids with several vectors."""
    every = rows.where("vec_id IS NOT NULL").select("vec_id", *KEY, "fine").distinct()
    several = checkpointed(every.groupBy("vec_id").count().where("count > 1").select("vec_id"))
    pairs = every.where("fine").drop("fine")
    some = not several.isEmpty()
    single = pairs.join(several, "vec_id", "left_anti") if some else pairs
    classes = checkpointed(single.groupBy(*KEY).agg(F.min("vec_id").alias("node"), F.count("*").alias("n")))
    asked = classes.select(F.col("node").alias("vec_id"), *KEY, "n")
    if some:
        asked = asked.unionByName(pairs.join(several, "vec_id", "left_semi").withColumn("n", F.lit(1).cast("long")))
    return classes, several, rows.where("fine").join(asked, ["vec_id", *KEY]).select(F.col("vec_id").alias("node"), "n", "v"), some


def near_duplicates(vectors: DataFrame, cosine: float = 0.9, prefix: int = PREFIX, shared: int = SHARED, tile: int = TILE, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """vec_id, n_links, component_id, kept for each row."""
    rows = vectors.select(F.col(id_column).cast("long").alias("vec_id"), F.col(vector_column).alias("v"))
    sound = F.forall("v", lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False)) & ~F.isnan(x)) & F.exists("v", lambda x: x != 0)
    rows = rows.withColumns({"h1": F.xxhash64("v"), "h2": F.hash("v"), "width": F.size("v"), "fine": F.col("vec_id").isNotNull() & F.coalesce(sound, F.lit(False))})
    slim = checkpointed(rows.select("vec_id", *KEY, "fine"))
    classes, several, to_index, some = _classes(rows)
    to_index = checkpointed(to_index)
    lengths = dict(to_index.groupBy(F.size("v")).count().collect())  # a row for each length
    tables = [t for width, total in sorted(lengths.items()) if width and (t := _pivots(to_index.where(F.size("v") == width), total, prefix, shared))]
    if not tables:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    first = np.cumsum([0, *[len(pivots) for pivots, _, _ in tables]])  # pivots are numbered through all lengths
    n = int(first[-1])

    def described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column(2)
            lengths = pc.list_value_length(values).fill_null(0).to_numpy(zero_copy_only=False)
            for (pivots, prefix, shared), start in zip(tables, first[:-1], strict=True):
                at, x = _unit(values.flatten(), lengths, pivots.shape[1])
                if not len(at):
                    continue
                near = np.sort(nearest_pivots(x.astype(np.float32), pivots, prefix), axis=1).astype(np.int32) + np.int32(start)
                lists = [pa.ListArray.from_arrays(np.arange(len(at) + 1, dtype=np.int32) * k, pa.array(np.ascontiguousarray(near[:, :k]).ravel())) for k in (prefix, prefix - shared + 1)]
                packed = np.concatenate([near.view(np.uint8), x.view(np.uint8)], axis=1)
                buffers = pa.FixedSizeBinaryArray.from_buffers(pa.binary(packed.shape[1]), len(at), [None, pa.py_buffer(packed.tobytes())])
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), batch.column(1).take(pa.array(at)), lists[1], buffers.cast(pa.binary())], names=["node", "n", "own", "packed"])

    # written once: lists are counted first and then dealt out
    index = checkpointed(to_index.mapInArrow(frugal(described), "node long, n long, own array<int>, packed binary"))
    listed = index.select("node", "n", F.explode("own").alias("pivot"), "packed")
    sizes = dict(listed.groupBy("pivot").count().collect())  # a row for each pivot, MOST_PIVOTS for each length at most
    tiles = F.element_at(F.expr(f"array({','.join(str(-(-sizes.get(k, 1) // tile)) for k in range(n))})"), F.col("pivot") + 1)
    cut = listed.withColumn("tiles", tiles).withColumn("mine", F.pmod(F.xxhash64("node"), F.col("tiles")).cast("int"))
    meets = cut.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    group = F.concat_ws(",", F.col("pivot"), F.least("mine", "other"), F.greatest("mine", "other"))
    side = F.when(F.col("mine") == F.col("other"), 0).otherwise(F.when(F.col("mine") < F.col("other"), 1).otherwise(2))
    dealt = meets.select(group.alias("g"), "pivot", side.alias("side"), "node", "n", "packed").repartition(partitions(vectors.sparkSession), "g").sortWithinPartitions("g", "side", "node")

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g, pivot, side, ids, weight, packed in whole_groups(batches, 0):
            edge = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1], [True]]))
            for a, b in zip(edge[:-1], edge[1:], strict=True):
                if b - a < 2:
                    continue
                which = int(np.searchsorted(first, pivot[a], side="right")) - 1
                _, prefix, shared = tables[which]
                data = np.frombuffer(b"".join(packed[a:b]), np.uint8).reshape(b - a, -1)
                fresh = np.concatenate([[True], (ids[a + 1 : b] != ids[a : b - 1]) | (data[1:] != data[:-1]).any(1)])
                data, sides, own = data[fresh], side[a:b][fresh], ids[a:b][fresh]
                if sides[-1] and not sides[0] < sides[-1]:
                    continue
                near, x = np.ascontiguousarray(data[:, : 4 * prefix]).view(np.int32), np.ascontiguousarray(data[:, 4 * prefix :]).view(np.float64)
                count, label = linked(x, near, weight[a:b][fresh], own, int(pivot[a]), int(np.searchsorted(sides, 2)) if sides[0] else None, cosine, shared)
                some = np.flatnonzero(count)
                if len(some):
                    yield pa.RecordBatch.from_arrays([pa.array(own[some]), pa.array(count[some]), pa.array(own[label[some]])], names=["a", "n", "b"])

    found = checkpointed(dealt.mapInArrow(frugal(compared), "a long, n long, b long"))  # a row for each class and list at most
    counts = found.groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("links"))
    group_of = components(found.select("a", "b"))
    zero = F.lit(0).cast("long")
    # what holds for a class is put together before its ids are looked at: of those, one class may hold a third
    told = classes.join(counts, "node", "left").join(group_of, "node", "left").select(*KEY, (F.coalesce("links", zero) + F.col("n") - 1).alias("links"), F.coalesce("component", "node").alias("component"))
    mine = slim.where("fine")
    alone = slim.where("NOT fine").select("vec_id", zero.alias("links"), F.col("vec_id").alias("component"))
    if some:
        apart = several.join(counts, several.vec_id == counts.node, "left").drop("node").join(group_of, F.col("vec_id") == F.col("node"), "left")
        apart = apart.select("vec_id", F.coalesce("links", zero).alias("links"), F.coalesce("component", "vec_id").alias("component"))
        alone = alone.join(several, "vec_id", "left_anti").unionByName(slim.select("vec_id").join(apart, "vec_id"))
        mine = mine.join(several, "vec_id", "left_anti")
    done = mine.join(told, KEY).select("vec_id", "links", "component").unionByName(alone)
    return done.select("vec_id", F.col("links").alias("n_links"), F.col("component").alias("component_id"), F.col("vec_id").eqNullSafe(F.col("component")).alias("kept"))


#: The same by SQL, for embeddings: all pairs (small tables only).
ORACLE = r"""
WITH RECURSIVE usable AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
  AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM usable a, usable b WHERE a.vec_id <> b.vec_id AND len(a.v) = len(b.v) AND list_cosine_similarity(a.v, b.v) >= 0.9),
reach AS (SELECT DISTINCT a AS n, a AS r FROM links UNION SELECT reach.n, links.b FROM reach JOIN links ON reach.r = links.a),
least AS (SELECT n, min(r) AS component_id FROM reach GROUP BY n),
counts AS (SELECT a AS n, count(*) AS n_links FROM links GROUP BY a)
SELECT vec_id, coalesce(n_links, 0) AS n_links, coalesce(component_id, vec_id) AS component_id, coalesce(component_id, vec_id) IS NOT DISTINCT FROM vec_id AS kept
FROM embeddings LEFT JOIN least ON least.n = vec_id LEFT JOIN counts ON counts.n = vec_id
"""
