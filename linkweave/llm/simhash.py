"""SimHash near-duplicates: fingerprints of word shingles, linked by bit-sliced comparison.

Every distinct fingerprint is compared with all others that agree with it on some choice of blocks of bits (see
block_masks; r differing bits leave enough blocks untouched, so no link is lost). Inside such a bucket, 64 fingerprints make one vertical block: word p holds bit p of each. Distances to a query
grow in carry-save counters, and a block is abandoned once all its lanes are beyond the radius.

Defined cases: a null text is as an empty one; no word gives fingerprint 0, which links like any other;
fewer words than a shingle give one shingle, the whole sequence; equal fingerprints link (0 bits differ).
A null doc_id takes part, but never names a component while another id can. Repeated rows come back as often
as they came in. Other columns are ignored. An empty table gives an empty result."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from linkweave.llm.common import apart, checkpointed, components, frugal, hashable, labelled, partitions, slices, whole_groups

LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
LANES = 64


def shingle_hashes(text: bytes, shingle: int) -> np.ndarray:
    """XXH64 (seed 42) of each shingle of the text's words; of the whole sequence if it is no longer than one, or empty."""
    words = text.translate(LOWER).split()
    joined = b" ".join(words)
    if len(words) <= shingle:
        return np.array([xxhash.xxh64_intdigest(joined, 42)], dtype="<u8")
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = np.concatenate([[0], ends[:-1]])
    n, h = len(words) - shingle + 1, xxhash.xxh64_intdigest
    return np.array([h(joined[i:j], 42) for i, j in zip(starts[:n].tolist(), (ends[shingle - 1 :] - 1).tolist(), strict=True)], dtype="<u8")


def fingerprint(text: bytes, shingle: int = 4) -> int:
    """The SimHash of one text: bit b is 1 if it is set in over half of the shingles' XXH64 (seed 42)."""
    if not text.split():
        return 0
    hashes = shingle_hashes(text, shingle)
    n = len(hashes)
    votes = np.zeros(64, np.int64)
    for k in range(0, n, 1 << 16):
        votes += np.unpackbits(hashes[k : k + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * votes > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = 4) -> DataFrame:
    """(doc_id, fp long: the 64 bits as a signed number) for each row of docs, and the columns of keyed() if it has them."""
    more = [c for c in ("__t", "__r") if c in docs.columns]

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 2 << 20):
            found = np.array([fingerprint((x or "").encode(), shingle) for x in batch.column(1).to_pylist()], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64)), *batch.columns[2:]], names=["doc_id", "fp", *more])

    return docs.select("doc_id", "text", *more).mapInArrow(frugal(of), "doc_id long, fp long" + "".join(f", {c} long" for c in more))


def _planes(values: np.ndarray) -> np.ndarray:
    """(blocks, 64) words: bit k of word p of a block is bit p of its k-th value. values: (blocks, 64)."""
    bits = np.unpackbits(np.ascontiguousarray(values.astype("<u8")).view(np.uint8).reshape(*values.shape, 8), axis=-1, bitorder="little")
    return np.ascontiguousarray(np.packbits(bits.transpose(0, 2, 1), axis=-1, bitorder="little")).view("<u8")[..., 0]


def near(values: np.ndarray, pairs: np.ndarray, radius: int, step: int = 8) -> np.ndarray:
    """Lanes within the radius: (pairs, 64 queries) words. values: (blocks, 64); pairs: (n, 2) of blocks, (queries', base).

    Only whole rows of queries are left out early: a query's block is abandoned once all its lanes are too far."""
    planes = _planes(values)
    which, query = np.divmod(np.arange(len(pairs) * LANES), LANES)
    base, asked = pairs[which, 1], values[pairs[which, 0], query]
    live = np.arange(len(which))
    width = radius.bit_length()
    counters = [np.zeros(len(which), np.uint64) for _ in range(width)]
    over = np.zeros(len(which), np.uint64)
    out = np.zeros(len(which), np.uint64)
    for p in range(64):
        carry = planes[base, p] ^ (np.uint64(0) - ((asked >> np.uint64(p)) & np.uint64(1)))
        for k in range(width):
            counters[k], carry = counters[k] ^ carry, counters[k] & carry
        over |= carry
        if p % step == step - 1:
            # lanes whose count is over the radius, by comparing bits from the highest down
            more, same = np.zeros_like(over), ~np.zeros_like(over)
            for k in reversed(range(width)):
                if radius >> k & 1:
                    same &= counters[k]
                else:
                    more |= same & counters[k]
                    same &= ~counters[k]
            over |= more
            keep = np.flatnonzero(~over)
            if len(keep) < len(live):
                live, base, asked, over = live[keep], base[keep], asked[keep], over[keep]
                counters = [c[keep] for c in counters]
    out[live] = ~over
    return out.reshape(len(pairs), LANES)


def _linked(fps: np.ndarray, group: np.ndarray, side: np.ndarray, radius: int, chunk: int = 512) -> tuple[np.ndarray, np.ndarray]:
    """Positions (i, j) of linked fingerprints as stars of a spanning forest; rows are sorted by group.

    side: 0 where a group is compared with itself; groups cut in tiles have rows of 1 and 2, and 1 meets 2."""
    n = len(fps)
    new = np.flatnonzero(np.concatenate([[True], (group[1:] != group[:-1]) | (side[1:] != side[:-1])]))
    counts = np.diff(np.concatenate([new, [n]]))
    blocks_of = -(-counts // LANES)
    first = np.concatenate([[0], np.cumsum(blocks_of)])
    at = np.repeat(new - first[:-1] * LANES, counts)
    slot = np.arange(n) - at
    values, owner = np.zeros((first[-1], LANES), np.uint64), np.full((first[-1], LANES), -1)
    values.reshape(-1)[slot], owner.reshape(-1)[slot] = fps, np.arange(n)
    label = np.arange(n)

    def pairs() -> Iterator[np.ndarray]:
        held: list[np.ndarray] = []
        size = 0
        for k in range(len(new)):
            if side[new[k]] == 2:
                continue
            mine = np.arange(first[k], first[k + 1])
            if side[new[k]] == 1:
                if k + 1 == len(new) or group[new[k + 1]] != group[new[k]]:
                    continue
                other = np.arange(first[k + 1], first[k + 2])
            for i in mine:
                those = other if side[new[k]] == 1 else np.arange(i, first[k + 1])
                held.append(np.stack([np.full(len(those), i), those], 1))
                size += len(those)
                if size >= chunk:
                    yield np.concatenate(held)
                    held, size = [], 0
        if held:
            yield np.concatenate(held)

    for some in pairs():
        for k in range(0, len(some), chunk):
            part = some[k : k + chunk]
            which, inside = np.unique(part, return_inverse=True)
            hits = near(values[which], inside.reshape(part.shape), radius)
            row, query = np.nonzero(hits)
            bits = np.unpackbits(hits[row, query].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            hit, lane = np.nonzero(bits)
            a, b = owner[part[row[hit], 0], query[hit]], owner[part[row[hit], 1], lane]
            real = (a >= 0) & (b >= 0) & (a != b)
            a, b = label[a[real]], label[b[real]]
            if len(a):
                nodes, where = np.unique(np.concatenate([a, b]), return_inverse=True)
                joined = labelled(len(nodes), where[: len(a)], where[len(a) :])
                whole = np.arange(n)
                whole[nodes] = nodes[joined]
                label = whole[label]
    child = np.flatnonzero(label != np.arange(n))
    return child, label[child]


#: Distinct fingerprints that one key of a block has on average, at most.
CROWD = 2048
#: Keys that are cut into tiles, at most: they are broadcast.
MOST_CUT = 1 << 17


def block_masks(n: int, radius: int) -> list[int]:
    """Bits that have to agree for two fingerprints to meet, in one of these ways at least.

    The 64 bits are cut into radius + k blocks. Differing bits touch `radius` blocks at most, so k of them agree, and every choice
    of k blocks is a key. k is the least one that leaves CROWD of n fingerprints to a key: 5 keys of 13 bits for radius 4 up to 8 million,
    15 of 21 bits up to 4 thousand million, then 35 of 27 bits. No choice loses a link."""
    k = 1
    while n > CROWD << (64 * k // (radius + k)) and k < 4:
        k += 1
    cuts = [round(b * 64 / (radius + k)) for b in range(radius + k + 1)]
    blocks = [(1 << hi) - (1 << lo) for lo, hi in zip(cuts, cuts[1:], strict=False)]
    return [sum(c) for c in combinations(blocks, k)]


def links(nodes: DataFrame, radius: int = 4, tile: int = 16384, masks: list[int] | None = None) -> DataFrame:
    """(a, b) of nodes whose fingerprints differ in radius bits or fewer: spanning links, a row for each node and key at most.

    nodes: (node long, fp long), fingerprints distinct. A key of over `tile` rows is cut into tiles, and every two tiles meet in
    a task of their own. Only where over MOST_CUT keys were to be cut, which takes over MOST_CUT * tile rows, does tile grow."""
    total = nodes.count()
    masks = masks or block_masks(total, radius)
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    keys = F.array(*[F.col("fp").bitwiseAND(F.lit(m).cast("long")) for m in signed])
    keyed = nodes.select("node", "fp", F.posexplode(keys).alias("block", "key"))
    tile = max(tile, total * len(masks) // MOST_CUT)
    large = keyed.groupBy("block", "key").count().where(F.col("count") > tile).select("block", "key", (F.col("count") / tile + 1).cast("long").alias("tiles"))
    keyed = keyed.join(F.broadcast(large), ["block", "key"], "left")
    mine = F.when(F.col("tiles").isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64("fp"), F.col("tiles")))
    others = F.sequence(F.lit(0).cast("long"), F.coalesce(F.col("tiles"), F.lit(1).cast("long")) - 1)
    meets = keyed.withColumn("mine", mine.cast("long")).withColumn("other", F.explode(others)).select("node", "fp", F.struct("block", "key", F.least("mine", "other").alias("x"), F.greatest("mine", "other").alias("y")).alias("g"), F.when(F.col("mine") == F.col("other"), 0).otherwise(F.when(F.col("mine") < F.col("other"), 1).otherwise(2)).alias("side"))
    dealt = meets.select("node", "fp", F.xxhash64("g").alias("g"), "side").repartition(partitions(nodes.sparkSession), "g").sortWithinPartitions("g", "side", "fp")

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for node, fp, group, side in whole_groups(batches, 2):
            i, j = _linked(fp.view(np.uint64), group, side, radius)
            yield pa.RecordBatch.from_arrays([pa.array(node[i]), pa.array(node[j])], names=["a", "b"])

    return dealt.mapInArrow(frugal(of), "a long, b long")


def near_duplicates(docs: DataFrame, radius: int = 4, shingle: int = 4) -> DataFrame:
    """(doc_id, fingerprint: 16 hex digits, component_id: the smallest doc_id reached) for each row."""
    prints = checkpointed(fingerprints(docs, shingle))  # 16 bytes a document; read three times
    # equal fingerprints become one node, named by the fingerprint, before anything is compared
    nodes = prints.groupBy("fp").agg(F.min("doc_id").alias("least"))
    found = components(links(nodes.select(F.col("fp").alias("node"), "fp"), radius)).select(F.col("node").alias("fp"), "component")
    # a row for each component of two or more, written first: so a component with most of the rows can be split in the join
    least = checkpointed(nodes.join(found, "fp").groupBy("component").agg(F.min("least").alias("component_id")))
    named = nodes.join(found, "fp", "left").join(least, "component", "left")
    # (where there is no id at all in a component, both are null)
    names = named.select("fp", F.coalesce("component_id", "least").alias("component_id"))
    return prints.join(names, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id and text, with what tells rows apart where ids don't: __t, a hash of the text, and __r, one of all columns."""
    return docs.select("doc_id", "text", F.xxhash64("text").alias("__t"), F.xxhash64(*hashable(docs)).alias("__r"))


#: Hash values of keys that are broadcast, at most: 16 MB whatever the tables' sizes.
HASHES = 1 << 20


def _hash(*key: str) -> Column:
    # never null: else the planner asks for that below the joins, and infers from it at length
    return F.xxhash64(F.col(key[0]).cast("long"), *key[1:]).bitwiseAND(F.lit(HASHES - 1).cast("long")).alias("__h")


def picked(docs: DataFrame, keys: DataFrame, few: bool = False) -> DataFrame:
    """The columns of docs and of keys for the rows of docs that keys names by (__id, __kt, __kr), each once where rows are repeated.

    few: keys may name few rows; then texts that can't be among them, as no key has their hash value, aren't shuffled."""
    marked = docs.withColumns({"__t": F.xxhash64("text"), "__r": F.xxhash64(*hashable(docs))})
    if few:
        marked = marked.withColumn("__h", _hash("doc_id", "__t", "__r")).join(F.broadcast(keys.select(_hash("__id", "__kt", "__kr")).distinct()), "__h", "left_semi").drop("__h")
    kept = marked.join(keys, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__t") == F.col("__kt")) & (F.col("__r") == F.col("__kr")))
    again = Window.partitionBy("__id", "__kt", "__kr").orderBy("__r")
    return kept.withColumn("__k", F.row_number().over(again)).where("__k = 1")


#: SQL of what orders the rows that may stand for others: the smallest id's comes first (nulls last), then the smallest hash's.
FIRST = "struct(doc_id IS NULL AS none, doc_id, __t, __r)"
KEY = {"__id": "k.doc_id", "__kt": "k.__t", "__kr": "k.__r"}


def one_each(docs: DataFrame, prints: DataFrame, components: DataFrame) -> DataFrame:
    """One row of docs for each component, with all its columns.

    prints: doc_id, __t, __r and node of each row of docs; components: node and its component. Rows that agree in id and both hashes have one text, so one
    component. Only where a row has the hash value of a key that goes, or of one that several rows have, are texts shuffled to tell which; others stay where
    they are. There are HASHES values, so the more rows go, the more are asked for, and none is taken wrongly."""
    each = prints.groupBy("doc_id", "__t", "__r", "node").agg(F.count("*").alias("__n")).join(components, "node")
    least = each.groupBy("component").agg(F.min(F.expr(FIRST)).alias("k"))
    stay = checkpointed(least.select("component", *[F.col(v).alias(c) for c, v in KEY.items()]))
    mine = F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__t") == F.col("__kt")) & (F.col("__r") == F.col("__kr"))
    doubtful = each.join(stay, "component").where(~mine | (F.col("__n") > 1)).select(_hash("doc_id", "__t", "__r")).distinct()
    doubtful = F.broadcast(checkpointed(doubtful))  # HASHES rows at most
    marked = docs.withColumn("__h", _hash_of(docs))
    sure = marked.join(doubtful, "__h", "left_anti").select(*docs.columns)
    asked = marked.join(doubtful, "__h", "left_semi").select(*docs.columns)
    return sure.unionByName(picked(asked, stay.join(doubtful, _hash("__id", "__kt", "__kr") == F.col("__h"), "left_semi")).select(*docs.columns))


def _hash_of(docs: DataFrame) -> Column:
    return F.xxhash64(F.col("doc_id").cast("long"), F.xxhash64("text"), F.xxhash64(*hashable(docs))).bitwiseAND(F.lit(HASHES - 1).cast("long"))


@apart
def representatives(docs: DataFrame, radius: int = 4, shingle: int = 4, ids_once: bool = True) -> DataFrame:
    """One row of each component, with all its columns: that of the smallest doc_id; a row with a null id where no other row of the
    component has one. ids_once: of the components that one id represents with several texts, only the first by text hash stays."""
    prints = checkpointed(fingerprints(keyed(docs), shingle))
    nodes = prints.select("fp").distinct()
    found = components(links(nodes.select(F.col("fp").alias("node"), "fp"), radius)).select(F.col("node").alias("fp"), "component")
    names = nodes.join(found, "fp", "left").select("fp", F.coalesce("component", "fp").alias("component"))
    kept = one_each(docs, prints.withColumnRenamed("fp", "node"), names.withColumnRenamed("fp", "node"))
    if not ids_once:
        return kept
    taken = kept.where("doc_id IS NOT NULL").withColumn("__k", F.row_number().over(Window.partitionBy("doc_id").orderBy(F.xxhash64("text")))).where("__k = 1").drop("__k")
    return taken.unionByName(kept.where("doc_id IS NULL"))
