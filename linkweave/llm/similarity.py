"""Near duplicates by the similarity of their word shingles: |A & B| / |A | B| of the sets, computed exactly.

Candidates are found in two ways. SimHash fingerprints of the texts that differ in RADIUS bits or fewer are linked, by the bit-sliced
comparison of simhash; no pair within the radius is missed, but few pairs at 0.8 are within it, and a radius that holds them leaves no
block of bits to meet by. So texts meet as well where a band of their MinHash signatures agrees (BANDS bands of ROWS minima; two
texts of similarity s meet with probability 1 - (1 - s^ROWS)^BANDS, so of pairs at 0.8 about 3 in a million do not, and fewer above).
Those that meet are compared by the last bytes of all their minima, and stay candidates if no more of them differ than four
standard deviations above what the least similarity lets expect (about 3 in 100,000 pairs at 0.8 differ more). So a bucket of texts that
have a common passage, but are not alike, falls apart before any text is read.

What candidates connect is a group; the sets of a group's texts are compared with each other, and only what is similar enough is
linked. Large groups and large buckets are cut into tiles, and every two tiles meet in a task of their own.

Defined cases: words as in simhash; fewer words than a shingle give one shingle, the whole sequence, also an empty one; a null
text is as an empty one; texts with one set of shingles are alike. Shingles are told apart by 64-bit hashes."""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from math import sqrt

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkweave.llm import simhash
from linkweave.llm.common import apart, checkpointed, components, frugal, partitions, slices, whole_groups
from linkweave.llm.simhash import FIRST, KEY, keyed, one_each, picked, shingle_hashes

BANDS, ROWS = 32, 5
#: Bits in which fingerprints of candidates differ, at most.
RADIUS = 4
#: Shingles of a tile of texts, about, and rows of a tile of a bucket.
TILE_SHINGLES, TILE_ROWS = 1 << 21, 1 << 13
_RANDOM = np.random.default_rng(42)
_TIMES = _RANDOM.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLUS = _RANDOM.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64)


def shingle_set(text: str | None, shingle: int) -> np.ndarray:
    return np.unique(shingle_hashes((text or "").encode(), shingle))


def minima(hashes: np.ndarray) -> np.ndarray:
    """The MinHash signature of a set."""
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max)
    for k in range(0, len(hashes), 256):
        least = np.minimum(least, (hashes[k : k + 256] * _TIMES[:, None] + _PLUS[:, None]).min(1))
    return least


def band_keys(least: np.ndarray) -> list[int]:
    """A key for each band of the signature; keys of different bands don't meet."""
    return [xxhash.xxh64_intdigest(least[b * ROWS : (b + 1) * ROWS].tobytes(), b) for b in range(BANDS)]


def sketches(docs: DataFrame, shingle: int) -> DataFrame:
    """(doc_id, __t, __r, node: a hash of the set of shingles, size of the set, fp: the text's SimHash, bands: the keys, marks: a byte of each minimum) for each row of docs."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 2 << 20):
            texts = batch.column(1).to_pylist()
            sets = [shingle_set(x, shingle) for x in texts]
            node = np.array([xxhash.xxh64_intdigest(x.tobytes(), 42) for x in sets], np.uint64).view(np.int64)
            fps = np.array([simhash.fingerprint((x or "").encode(), shingle) for x in texts], np.uint64).view(np.int64)
            least = [minima(x) for x in sets]
            bands = np.array([band_keys(x) for x in least], np.uint64).view(np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1, dtype=np.int32) * BANDS), pa.array(bands.reshape(-1)))
            marks = pa.array([(x & np.uint64(255)).astype(np.uint8).tobytes() for x in least], pa.binary())
            columns = [batch.column(0), batch.column(2), batch.column(3), pa.array(node), pa.array([len(x) for x in sets], pa.int64()), pa.array(fps), lists, marks]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "__t", "__r", "node", "size", "fp", "bands", "marks"])

    return keyed(docs).mapInArrow(frugal(of), "doc_id long, __t long, __r long, node long, size long, fp long, bands array<long>, marks binary")


def _tiled(rows: DataFrame, group: str, *kept: str) -> DataFrame:
    """kept columns of rows, with g and side: rows of one g meet, all if side is 0, else those of 1 and 2. Column tiles: null, or how many a group is cut into."""
    mine = F.coalesce(F.pmod(F.xxhash64("node"), F.col("tiles")), F.lit(0)).cast("long")
    others = F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("tiles", F.lit(1).cast("long")) - 1))
    meets = rows.select(*kept, group, mine.alias("mine"), others.alias("other"))
    side = F.when(F.col("mine") == F.col("other"), 0).when(F.col("mine") < F.col("other"), 1).otherwise(2)
    dealt = meets.select(*kept, F.xxhash64(group, F.least("mine", "other"), F.greatest("mine", "other")).alias("g"), side.alias("side"))
    return dealt.repartition(partitions(rows.sparkSession), "g").sortWithinPartitions("g", "side", "node")


def resembling(marks: np.ndarray, side: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions (i, j) of rows of marks that differ in `most` places or fewer, as stars of a spanning forest; side as in alike()."""
    at = np.arange(len(marks))
    label = at.copy()
    for i in np.flatnonzero(side < 2):
        j = np.flatnonzero((label != label[i]) & ((at > i) if side[i] == 0 else (side == 2)))
        if len(j):
            hits = j[(marks[j] != marks[i]).sum(1) <= most]
            if len(hits):
                label[np.isin(label, label[hits])] = label[i]
    child = np.flatnonzero(label != at)
    return child, label[child]


def meetings(nodes: DataFrame, similarity: Fraction, tile: int = TILE_ROWS) -> DataFrame:
    """(a, b) of nodes that have a band in common and signatures that agree well enough; nodes: (node, bands, marks)."""
    n, s = BANDS * ROWS, float(similarity)
    most = round(n * (1 - s) + 4 * sqrt(n * s * (1 - s)))
    met = nodes.select("node", F.explode("bands").alias("key"))
    sizes = met.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key", F.when(F.col("n") > tile, (F.col("n") / tile + 1).cast("long")).alias("tiles"))
    dealt = _tiled(met.join(sizes, "key").join(nodes.select("node", "marks"), "node"), "key", "node", "marks")

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for node, marks, group, side in whole_groups(batches, 2):
            bytes_ = np.frombuffer(b"".join(marks), np.uint8).reshape(len(node), n)
            ends = np.flatnonzero(np.concatenate([group[1:] != group[:-1], [True]])) + 1
            for i, j in zip([0, *ends[:-1]], ends, strict=True):
                if j - i > 1:
                    a, b = resembling(bytes_[i:j], side[i:j], most)
                    yield pa.RecordBatch.from_arrays([pa.array(node[i:j][a]), pa.array(node[i:j][b])], names=["a", "b"])

    return dealt.mapInArrow(frugal(of), "a long, b long")


def candidates(nodes: DataFrame, similarity: Fraction) -> DataFrame:
    """(a, b) of nodes whose texts are to be compared, as spanning links; nodes: (node, fp, bands, marks)."""
    first = nodes.groupBy("fp").agg(F.min("node").alias("b"))  # one for each fingerprint
    equal = nodes.join(first, "fp").where("node <> b").select(F.col("node").alias("a"), "b")
    return equal.union(simhash.links(first.select(F.col("b").alias("node"), "fp"), RADIUS)).union(meetings(nodes, similarity))


def alike(sets: list[np.ndarray], side: np.ndarray, similarity: Fraction) -> tuple[np.ndarray, np.ndarray]:
    """Positions (i, j) of linked sets, as stars of a spanning forest: pairs that are linked already aren't compared.

    side: 0 where all meet; of rows of 1 and 2 only 1 meets 2."""
    n, (num, den) = len(sets), similarity.as_integer_ratio()
    sizes = np.array([len(x) for x in sets])
    starts = np.cumsum(sizes) - sizes
    known, codes = np.unique(np.concatenate(sets), return_inverse=True)
    mark, label, at = np.zeros(len(known), np.int64), np.arange(n), np.arange(n)
    for i in np.flatnonzero(side < 2):
        j = np.flatnonzero((label != label[i]) & ((at > i) if side[i] == 0 else (side == 2)) & (sizes * den >= num * sizes[i]) & (sizes[i] * den >= num * sizes))
        if not len(j):
            continue
        mine = codes[starts[i] : starts[i] + sizes[i]]
        mark[mine] = 1
        both = np.add.reduceat(mark[codes], starts)[j] if 4 * len(j) > n else np.array([mark[codes[starts[k] : starts[k] + sizes[k]]].sum() for k in j])
        mark[mine] = 0
        hits = j[both * den >= num * (sizes[i] + sizes[j] - both)]
        label[np.isin(label, label[hits])] = label[i]
    child = np.flatnonzero(label != at)
    return child, label[child]


def links(texts: DataFrame, similarity: Fraction, shingle: int) -> DataFrame:
    """(a, b) of nodes that are similar enough, within each group; texts: (node, text, group, tiles: null or how many the group is cut into)."""
    dealt = _tiled(texts, "group", "node", "text")

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = (part for batch in batches for part in slices([batch], "text", 8 << 20))
        for node, text, group, side in whole_groups(pieces, 2):
            ends = np.flatnonzero(np.concatenate([group[1:] != group[:-1], [True]])) + 1
            for i, j in zip([0, *ends[:-1]], ends, strict=True):
                if j - i > 1:
                    a, b = alike([shingle_set(x, shingle) for x in text[i:j]], side[i:j], similarity)
                    yield pa.RecordBatch.from_arrays([pa.array(node[i:j][a]), pa.array(node[i:j][b])], names=["a", "b"])

    return dealt.mapInArrow(frugal(of), "a long, b long")


@apart
def representatives(docs: DataFrame, similarity: float = 0.8, shingle: int = 5, tile: int = 256) -> DataFrame:
    """One row of each component of similar documents, with all its columns: see simhash.one_each."""
    prints = checkpointed(sketches(docs, shingle))
    once = [F.min("fp").alias("fp"), *[F.first(c).alias(c) for c in ("size", "bands", "marks")]]  # one set has one of each
    nodes = checkpointed(prints.groupBy("node").agg(F.min(F.expr(FIRST)).alias("k"), *once))
    least = Fraction(str(similarity))
    groups = components(candidates(nodes, least)).select("node", F.col("component").alias("group"))
    held = nodes.select("node", "size", "k").join(groups, "node")
    parts = F.greatest(F.count("*") / tile, F.sum("size") / TILE_SHINGLES)
    cut = held.groupBy("group").agg(parts.alias("parts")).select("group", F.when(F.col("parts") > 1, (F.col("parts") + 1).cast("long")).alias("tiles"))
    asked = held.join(cut, "group").select("node", "group", "tiles", *[F.col(v).alias(c) for c, v in KEY.items()])
    texts = picked(docs, asked, few=True).select("node", "text", "group", "tiles")
    found = components(links(texts, least, shingle))
    return one_each(docs, prints, nodes.join(found, "node", "left").select("node", F.coalesce("component", "node").alias("component")))
