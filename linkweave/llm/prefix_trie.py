"""The trie of conversations' prefixes, with sums over subtrees by heavy-path decomposition.

Turns are numbered, conversations rebuilt, and a prefix is known by its depth and the sums, lane by lane, of hashes of (place, turn): sums of parts of a
conversation can be added, so one of any length is cut into blocks. A node's heavy child is the largest (most members, then the smallest member);
following heavy children gives paths, and any way from the root leaves a path at most log2(conversations) times. A path belongs to the round that says how
often; rounds go from the last to the first: what hangs below a path's nodes is attached to them, sums run along the path from its end, and the
sum at its head goes to the head's parent.

No group is held by one task: equal rows are counted before they are numbered, numbering is by ranges and their counts, long conversations and paths go
by blocks of BLOCK places, and a hot node meets many rows only in aggregations with partial sums and in joins whose sides can be split. The digest of a node's
ends is sequential by its definition: ids are joined into strings by ranges of CHUNK ids first, and one task hashes those strings as they come.

Defined cases: rows without a conv_id belong to no conversation; null role or text is empty; turns with one number are in order of their digest, nulls
first; repeated rows are turns each; conv_id % 20 and % 4 are never negative; other columns are ignored; a table without conversations has no
root and gives an empty result. Turns are told apart by SHA-256, prefixes by their depth and 128 bits."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from linkweave.llm.common import WORD, checkpointed, frugal, partitions, spread

BLOCK, CHUNK_BITS, GROUP, SHARED_TURNS = 4096, 12, 20, 4
KEY = ["depth", "a", "b"]
LOW = (1 << 32) - 1


def numbered(conversations: DataFrame) -> DataFrame:
    """conv_id, place (1, 2, ...), turn_hash, words for each turn."""
    role, text = (F.coalesce(c, F.lit("")) for c in ("role", "text"))
    digest = F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256))
    slim = conversations.where("conv_id IS NOT NULL").select("conv_id", "turn", digest.alias("turn_hash"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("words"))
    order = [F.col("turn").asc_nulls_first(), "turn_hash"]
    told = slim.groupBy("conv_id", "turn", "turn_hash").agg(F.count("*").alias("n"), F.max("words").alias("words"))
    ranged = checkpointed(told.repartitionByRange(partitions(conversations.sparkSession), "conv_id", *order).withColumn("part", F.spark_partition_id()))
    held = ranged.groupBy("conv_id", "part").agg(F.sum("n").alias("held"))
    earlier = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = held.select("conv_id", "part", F.coalesce(F.sum("held").over(earlier), F.lit(0)).alias("before"))
    within = Window.partitionBy("conv_id", "part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    rows = ranged.join(before, ["conv_id", "part"]).withColumn("first", F.col("before") + F.coalesce(F.sum("n").over(within), F.lit(0)) + 1).select("conv_id", "first", "n", "turn_hash", "words")
    columns = ["conv_id", "place", "turn_hash", "words"]
    once = rows.where("n = 1").withColumnRenamed("first", "place")
    return once.select(*columns).union(spread(rows.where("n > 1"), F.col("first"), F.col("n"), "place").select(*columns))


def rebuilt(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns of the rebuilt conversations (conv_id, depth, turn_hash, words, length), and a row for each (conv_id, length): the first turns of the group's
    first conversation, as many as the id's checksum says, then its own that come after so many."""
    turns = checkpointed(numbered(conversations))
    sizes = turns.groupBy("conv_id").agg(F.count("*").alias("n_turns"))
    lead, shared = F.col("conv_id") - F.pmod("conv_id", F.lit(GROUP)), F.crc32(F.col("conv_id").cast("string").cast("binary")) % SHARED_TURNS
    convs = sizes.select("conv_id", "n_turns", lead.alias("lead"), shared.alias("shared"))
    leads = sizes.where(F.pmod("conv_id", F.lit(GROUP)) == 0).select(F.col("conv_id").alias("lead"), F.col("n_turns").alias("lead_turns"))
    taken = F.least("shared", F.coalesce("lead_turns", F.lit(0)))
    convs = convs.join(leads, "lead", "left").withColumn("taken", taken).withColumn("length", F.col("taken") + F.greatest(F.col("n_turns") - F.col("shared"), F.lit(0)))
    convs = checkpointed(convs.select("conv_id", "lead", "shared", "taken", "length"))
    own = turns.join(convs.select("conv_id", "shared", "taken", "length"), "conv_id").where("place > shared")
    own = own.select("conv_id", (F.col("place") - F.col("shared") + F.col("taken")).alias("depth"), "turn_hash", "words", "length")
    firsts = turns.where((F.col("place") < SHARED_TURNS) & (F.pmod("conv_id", F.lit(GROUP)) == 0)).withColumnRenamed("conv_id", "lead")
    others = firsts.join(convs, "lead").where("place <= shared").select("conv_id", F.col("place").alias("depth"), "turn_hash", "words", "length")
    return own.union(others), convs.select("conv_id", "length")


def _block(block: int) -> Column:
    return F.floor(F.col("depth") / block)


def prefixes(rows: DataFrame, deep: bool, block: int) -> DataFrame:
    """conv_id, depth, words, length, the key (a, b) of each prefix and that of the one before it (pa, pb)."""
    lanes = ["l0", "l1", "l2", "l3"]
    for k, (x, y) in enumerate((lanes[:2], lanes[2:])):
        rows = rows.withColumn("h", F.xxhash64(F.lit(k), "depth", "turn_hash")).withColumn(x, F.col("h").bitwiseAND(LOW)).withColumn(y, F.shiftrightunsigned("h", 32))
    rows = rows.drop("h", "turn_hash").withColumn("block", _block(block))
    within = Window.partitionBy("conv_id", "block").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    sums = {x: F.sum(x).over(within) for x in lanes}
    out = rows.withColumns({f"s{x}": c for x, c in sums.items()})
    if deep:
        earlier = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
        blocks = rows.groupBy("conv_id", "block").agg(*[F.sum(x).alias(x) for x in lanes])
        before = blocks.select("conv_id", "block", *[F.sum(x).over(earlier).alias(f"p{x}") for x in lanes]).where("block > 0")
        out = out.join(before, ["conv_id", "block"], "left").withColumns({f"s{x}": F.col(f"s{x}") + F.coalesce(f"p{x}", F.lit(0)) for x in lanes})

    def joined(x: Column, y: Column) -> Column:
        return F.shiftleft(x.bitwiseAND(LOW), 32).bitwiseOR(y.bitwiseAND(LOW))

    here, there = [F.col(f"s{x}") for x in lanes], [F.col(f"s{x}") - F.col(x) for x in lanes]
    keys = {n: joined(v[i], v[i + 1]) for v, names in ((here, "a b"), (there, "pa pb")) for n, i in zip(names.split(), (0, 2), strict=True)}
    return out.withColumns(keys).select("conv_id", "depth", "words", "length", *keys)


def nodes(steps: DataFrame) -> DataFrame:
    """KEY, pa, pb, member (the smallest), n_convs, words, n_children, light (whether it isn't its parent's heavy child) for each node but the root, whose row has children alone."""
    rows = checkpointed(steps.groupBy(*KEY).agg(F.count("*").alias("n_convs"), F.min("conv_id").alias("member"), F.max("pa").alias("pa"), F.max("pb").alias("pb"), F.max("words").alias("words")))
    largest = F.max(F.struct("n_convs", (-F.col("member")).alias("m"), "a", "b"))
    parents = checkpointed(rows.groupBy((F.col("depth") - 1).alias("depth"), F.col("pa").alias("a"), F.col("pb").alias("b")).agg(F.count("*").alias("n_children"), largest.alias("heavy")))
    heavy = parents.select((F.col("depth") + 1).alias("depth"), "heavy.a", "heavy.b", F.lit(0).alias("light"))
    both = rows.join(heavy, KEY, "left").join(parents.select(*KEY, "n_children"), KEY, "full")
    return both.select(*KEY, "pa", "pb", "member", "n_convs", "words", F.coalesce("n_children", F.lit(0).cast("long")).alias("n_children"), F.coalesce("light", F.lit(1)).alias("light"))


def on_paths(steps: DataFrame, tree: DataFrame, deep: bool, block: int) -> DataFrame:
    """Nodes with their round, the head of their path (h_depth, h_a, h_b; null: the root) and their parent's smallest member (null: the root's).

    Of the members of a node only the smallest is followed, so copies of a conversation cost nothing here."""
    met = steps.select("conv_id", *KEY).join(tree.select(F.col("member").alias("conv_id")).distinct(), "conv_id", "left_semi").join(tree.where("depth > 0"), KEY).withColumn("block", _block(block))
    head = F.max(F.when(F.col("light") == 1, F.struct(*KEY)))  # depth first: the last one
    within = Window.partitionBy("conv_id", "block").orderBy("depth")
    out = met.withColumns({"round": F.sum("light").over(within), "head": head.over(within), "parent": F.lag("member").over(within)})
    if deep:
        earlier = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
        blocks = met.groupBy("conv_id", "block").agg(F.sum("light").alias("r"), head.alias("h"), F.max(F.struct("depth", "member")).alias("m"))
        before = blocks.select("conv_id", "block", F.sum("r").over(earlier).alias("r"), F.max("h").over(earlier).alias("h"), F.max("m").over(earlier).alias("m")).where("block > 0")
        out = out.join(before, ["conv_id", "block"], "left").withColumns({"round": F.col("round") + F.coalesce("r", F.lit(0)), "head": F.coalesce("head", "h"), "parent": F.coalesce("parent", "m.member")})
    mine = out.where("conv_id = member")
    return mine.select(*KEY, "pa", "pb", "member", "n_convs", "words", "n_children", "round", F.col("head.depth").alias("h_depth"), F.col("head.a").alias("h_a"), F.col("head.b").alias("h_b"), "parent")


SUMS = ["n_leaves", "saved_tokens"]
PATH = ["h_depth", "h_a", "h_b"]


def along_paths(rows: DataFrame, deep: bool, block: int) -> DataFrame:
    """rows with each of SUMS summed over the node and those after it on its path."""
    rows = rows.withColumn("block", _block(block))
    within = Window.partitionBy(*PATH, "block").orderBy(F.desc("depth")).rowsBetween(Window.unboundedPreceding, 0)
    out = rows.withColumns({s: F.sum(s).over(within) for s in SUMS})
    if deep:
        later = Window.partitionBy(*PATH).orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
        blocks = rows.groupBy(*PATH, "block").agg(*[F.sum(s).alias(s) for s in SUMS])
        after = blocks.select(*PATH, "block", *[F.coalesce(F.sum(s).over(later), F.lit(0)).alias(f"later_{s}") for s in SUMS])
        out = out.join(after, [*PATH, "block"]).withColumns({s: F.col(s) + F.col(f"later_{s}") for s in SUMS})
    return out.select(*rows.columns).drop("block")


def subtree_sums(placed: DataFrame, deep: bool, block: int) -> DataFrame:
    """placed with n_leaves and saved_tokens of each node's subtree: a round for each number of times that paths are left."""
    own = placed.withColumns({"n_leaves": (F.col("n_children") == 0).cast("long"), "saved_tokens": (F.col("n_convs") - 1) * F.col("words")})
    rounds = own.agg(F.max("round")).first()[0]
    done, below = [], None
    for k in range(rounds, -1, -1):
        rows = own.where(F.col("round") == k)
        if below is not None:
            rows = rows.join(below, KEY, "left").withColumns({s: F.col(s) + F.coalesce(f"below_{s}", F.lit(0)) for s in SUMS}).select(*own.columns)
        done.append(checkpointed(along_paths(rows, deep, block)))
        heads = done[-1].where("depth = h_depth AND depth > 0")
        below = heads.groupBy((F.col("depth") - 1).alias("depth"), F.col("pa").alias("a"), F.col("pb").alias("b")).agg(*[F.sum(s).alias(f"below_{s}") for s in SUMS])
    out = done[0]
    for other in done[1:]:
        out = out.union(other)
    return out


def ends(steps: DataFrame, lengths: DataFrame) -> DataFrame:
    """KEY, ends_sha256 of the nodes at which conversations end."""
    zero = F.lit(0).cast("long")
    last = steps.where("depth = length").select(*KEY, "conv_id").union(lengths.where("length = 0").select(zero, zero, zero, "conv_id"))
    ids = F.array_join(F.transform(F.sort_array(F.collect_list("conv_id")), lambda c: c.cast("string")), ",")
    chunks = last.groupBy(*KEY, F.shiftright("conv_id", CHUNK_BITS).alias("chunk")).agg(ids.alias("ids"))
    dealt = chunks.repartition(partitions(steps.sparkSession), *KEY).sortWithinPartitions(*KEY, "chunk")

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, digest = None, hashlib.sha256()
        for batch in batches:
            out = []
            for *node, _, ids in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if node == key:
                    digest.update(b",")
                else:
                    if key:
                        out.append([*key, digest.hexdigest()])
                    key, digest = node, hashlib.sha256()
                digest.update(ids.encode())
            yield told(out)
        yield told([[*key, digest.hexdigest()]] if key else [])

    def told(rows: list[list]) -> pa.RecordBatch:
        columns = zip(*rows, strict=True) if rows else [[]] * 4
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True)], names=[*KEY, "ends_sha256"])

    return dealt.mapInArrow(frugal(hashed), "depth long, a long, b long, ends_sha256 string")


NODE = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def prefix_trie(conversations: DataFrame, block: int = BLOCK) -> DataFrame:
    """NODE for each node of the trie of rebuilt conversations. conversations: conv_id, turn, role, text."""
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", "role", "text")
    turns, lengths = rebuilt(rows)
    root = lengths.agg(F.count("*").alias("n"), F.min("conv_id").alias("member"), F.max("length").alias("most")).first()
    deep = (root.most or 0) >= block
    steps = checkpointed(prefixes(turns, deep, block))
    tree = checkpointed(nodes(steps))
    zero = F.lit(0).cast("long")
    # the root's row: counted above, its children with the other nodes
    top = lengths.sparkSession.createDataFrame([(0, 0, 0, root.n, root.member)] if root.n else [], "depth long, a long, b long, n long, m long").join(tree.where("depth = 0").select(*KEY, "n_children"), KEY, "left")
    top = top.select(*KEY, zero.alias("pa"), zero.alias("pb"), F.col("m").alias("member"), F.col("n").alias("n_convs"), zero.alias("words"), F.coalesce("n_children", zero).alias("n_children"), zero.alias("round"), *[zero.alias(c) for c in PATH], F.lit(None).cast("long").alias("parent"))
    below = on_paths(steps, tree, deep, block).withColumns({c: F.coalesce(c, zero) for c in PATH} | {"parent": F.coalesce("parent", F.lit(root.member))})
    placed = checkpointed(top.unionByName(below))
    done = subtree_sums(placed, deep, block) if root.n else placed.withColumns({s: zero for s in SUMS})
    digest = F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest()))
    return done.join(ends(steps, lengths), KEY, "left").select(F.col("member").alias("conv_id"), "depth", F.col("parent").alias("parent_conv_id"), "n_convs", "n_children", *SUMS, digest.alias("ends_sha256"))


#: The same by SQL, for conversations: whole prefixes as lists (small tables only); CRC-32 byte by byte.
ORACLE = r"""
WITH RECURSIVE poly AS (SELECT list(list_reduce(list_prepend(k, range(8)), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) ORDER BY k) AS t FROM range(256) r(k)),
turns AS (SELECT conv_id AS c, coalesce(role, '') AS r, coalesce(text, '') AS t,
  row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(octet_length(encode(coalesce(role, ''))) || ':' || coalesce(role, '') || coalesce(text, ''))) AS pos FROM conversations WHERE conv_id IS NOT NULL),
ids AS (SELECT c, c - ((c % 20) + 20) % 20 AS lead, list_prepend(4294967295, list_transform(string_split(c::VARCHAR, ''), lambda x: unicode(x)::BIGINT)) AS b FROM (SELECT DISTINCT c FROM turns)),
convs AS (SELECT c, lead, xor(4294967295, list_reduce(b, lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1]))) % 4 AS h FROM ids, poly),
firsts AS (SELECT v.c, list({'r': r, 't': t} ORDER BY pos) AS q FROM convs v JOIN turns x ON x.c = v.lead AND x.pos <= v.h GROUP BY v.c),
owns AS (SELECT v.c, list({'r': r, 't': t} ORDER BY pos) AS q FROM convs v JOIN turns x ON x.c = v.c AND x.pos > v.h GROUP BY v.c),
seqs AS (SELECT v.c, list_concat(coalesce(f.q, []), coalesce(o.q, [])) AS s FROM convs v LEFT JOIN firsts f ON f.c = v.c LEFT JOIN owns o ON o.c = v.c),
steps AS (SELECT c, len(s) AS n, s, unnest(range(0, len(s) + 1)) AS d FROM seqs),
nodes AS (SELECT list_slice(s, 1, d) AS p, d, min(c) AS m, count(*) AS n_convs, coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (n = d), '') AS e FROM steps GROUP BY 1, 2),
kids AS (SELECT list_slice(p, 1, d - 1) AS p, d - 1 AS d, count(*) AS k FROM nodes WHERE d > 0 GROUP BY 1, 2),
told AS (SELECT nodes.*, coalesce(k, 0) AS n_children, CASE WHEN nodes.d = 0 THEN 0 ELSE (n_convs - 1) * len(regexp_extract_all(nodes.p[nodes.d].t, '[^\x20\x09-\x0D]+')) END AS saved
  FROM nodes LEFT JOIN kids ON kids.p = nodes.p AND kids.d = nodes.d),
up AS (SELECT p, n_children, saved, unnest(range(0, d + 1)) AS j FROM told),
sums AS (SELECT list_slice(p, 1, j) AS p, j AS d, count(*) FILTER (n_children = 0) AS n_leaves, sum(saved)::BIGINT AS saved_tokens FROM up GROUP BY 1, 2)
SELECT a.m AS conv_id, a.d::BIGINT AS depth, b.m AS parent_conv_id, a.n_convs, a.n_children, n_leaves, saved_tokens, sha256(a.e) AS ends_sha256
FROM told a JOIN sums ON sums.p = a.p AND sums.d = a.d LEFT JOIN nodes b ON b.d = a.d - 1 AND b.p = list_slice(a.p, 1, a.d - 1)
"""
