"""Reproducible shuffle and sharding by a Feistel permutation with cycle walking over global row numbers.

Rows get dense global numbers from 0 without a global sort: they are dealt into buckets by a hash of their key, numbered
inside each bucket by a window, and a bucket's first number comes from the counts of those before it. A keyed permutation
of 0 to N - 1 then gives each row its place; shard and slot are its remainder and quotient by the number of shards, so
shards differ by a row at most and slots have no gap. Everything is an expression of DataFrame functions.

Defined cases: equal rows of key columns are counted before the shuffle and numbered one after another, so a key with a
third of all rows is one row until the numbers are spread out again, in ranges of bounded length that are dealt out first; nulls
are values like any other; an empty table gives an empty result; columns beyond the key are ignored by place(), and carried by
shuffled(), whatever they are named (but `shard` and `slot`, which are its own)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from linkweave.llm.common import apart, checkpointed, spread

ROUNDS = 4
BUCKETS = 4096
#: In so many parts the places of one key are numbered.
PARTS = 1024
WALKS = 64


def _halves(n: int) -> tuple[int, int]:
    """a, b with a * b >= n and a * b - n < b, near the square root."""
    a = max(1, math.isqrt(n))
    return a, -(-n // a)


def permute(x: Column, n: int, seed: str) -> Column:
    """A permutation of 0 to a * b - 1: Feistel rounds over (x div b, x mod b), additions modulo a and b by turns."""
    a, b = _halves(n)
    state = F.struct(((x - F.pmod(x, F.lit(b))) / F.lit(b)).cast("long").alias("l"), F.pmod(x, F.lit(b)).alias("r"))

    def step(s: Column, k: Column) -> Column:
        even = F.pmod(k, F.lit(2)) == 0
        f = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}|"), k.cast("string"), F.lit("|"), F.when(even, s["r"]).otherwise(s["l"]).cast("string")).cast("binary")), 1, 8), 16, 10).cast("long")
        return F.struct(F.when(even, F.pmod(s["l"] + f, F.lit(a))).otherwise(s["l"]).alias("l"), F.when(even, s["r"]).otherwise(F.pmod(s["r"] + f, F.lit(b))).alias("r"))

    return F.aggregate(F.array(*[F.lit(k) for k in range(ROUNDS)]), state, step, lambda s: s["l"] * F.lit(b) + s["r"])


def walked(x: Column, n: int, seed: str) -> Column:
    """The permutation of 0 to n - 1: apply again while the result is n or more.

    a * b - n < b, so up to n = 4096 at most 64 walks are possible; beyond, 64 in a row have a chance under n ** -32,
    and an error is raised rather than a wrong place given."""
    once = permute(x, n, seed)
    more = F.aggregate(F.sequence(F.lit(1), F.lit(WALKS)), once, lambda y, _: F.when(y < n, y).otherwise(permute(y, n, seed)))
    return F.when(more < n, more).otherwise(F.raise_error(F.lit("cycle walk too long")).cast("long"))


def numbered(rows: DataFrame, key: list[str]) -> tuple[DataFrame, int]:
    """The key columns of every row with row_no, dense from 0, and the number of rows."""
    counted = rows.groupBy(*key).agg(F.count("*").cast("long").alias("__n"))
    text = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("~")) for c in key])
    # written once, a row for each key: the texts aren't read again for the numbers
    counted = checkpointed(counted.withColumn("__bucket", (F.conv(F.substring(F.md5(text.cast("binary")), 1, 3), 16, 10)).cast("int")))
    held = counted.groupBy("__bucket").agg(F.sum("__n").alias("n")).collect()  # BUCKETS rows at most
    sums, total = {}, 0
    for bucket, n in sorted(held):
        sums[bucket], total = total, total + n
    if not total:
        return rows.select(*key, F.lit(0).cast("long").alias("row_no")).limit(0), 0
    first = F.element_at(F.expr(f"array({','.join(f'{sums.get(k, 0)}L' for k in range(BUCKETS))})"), F.col("__bucket") + 1)
    before = F.sum("__n").over(Window.partitionBy("__bucket").orderBy(*key).rowsBetween(Window.unboundedPreceding, -1))
    placed = counted.withColumn("__at", F.coalesce(before, F.lit(0).cast("long")) + first)
    return spread(placed, F.col("__at"), F.col("__n"), "row_no").select(*key, "row_no"), total


def place(rows: DataFrame, key: list[str], shards: int, seed: str = "linkweave") -> DataFrame:
    """The key columns of every row with its shard (int) and slot (long)."""
    found, n = numbered(rows, key)
    if not n:
        return found.select(*key, F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"))
    placed = found.select(*key, walked(F.col("row_no"), n, seed).alias("__place"))
    return placed.select(*key, F.pmod("__place", F.lit(shards)).cast("int").alias("shard"), ((F.col("__place") - F.pmod("__place", F.lit(shards))) / F.lit(shards)).cast("long").alias("slot"))


def shard_documents(docs: DataFrame, shards: int = 40, seed: str = "linkweave") -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of each document, under the law `rows`."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    placed = place(rows, ["doc_id", "size", "text_crc32"], shards, seed)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


@apart
def shuffled(docs: DataFrame, shards: int = 40, seed: str = "linkweave") -> DataFrame:
    """docs with shard and slot, for writing; rows that agree in id, size and checksum are told apart by the task that reads them and their place there.

    The table is written once with both, so they hold; rows are numbered in each task, and before that the tasks' counts are added up, so copies of one
    row, however many, never meet in one task."""
    text = F.coalesce(F.col("text"), F.lit(""))
    docs = docs.drop("shard", "slot")
    key = ["__id", "__size", "__crc"]
    keyed = docs.withColumns({"__id": F.col("doc_id"), "__size": F.octet_length(text).cast("long"), "__crc": F.crc32(text.cast("binary")), "__task": F.spark_partition_id(), "__row": F.monotonically_increasing_id()})
    keyed = checkpointed(keyed)
    same = " AND ".join(("a.__id <=> b.__id", "a.__size = b.__size", "a.__crc = b.__crc"))
    counts = keyed.groupBy(*key, "__task").agg(F.count("*").alias("__n"))
    before = F.sum("__n").over(Window.partitionBy(*key).orderBy("__task").rowsBetween(Window.unboundedPreceding, -1))
    counts = counts.withColumn("__before", F.coalesce(before, F.lit(0))).drop("__n")
    slim = keyed.select(*key, "__task", "__row").withColumn("__i", F.row_number().over(Window.partitionBy(*key, "__task").orderBy("__row")))
    slim = slim.alias("a").join(counts.alias("b"), F.expr(f"{same} AND a.__task = b.__task")).select(*[f"a.{c}" for c in key], "a.__row", (F.col("a.__i") + F.col("b.__before")).alias("__k"))
    placed = place(keyed.select(*key), key, shards, seed)
    # places of a key are numbered in PARTS parts
    held = Window.partitionBy(*key, "__part").orderBy("slot", "shard")
    placed = placed.withColumn("__part", F.pmod("slot", F.lit(PARTS)))
    parts = placed.groupBy(*key, "__part").agg(F.count("*").alias("__n"))
    parts = parts.withColumn("__before", F.coalesce(F.sum("__n").over(Window.partitionBy(*key).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("__n")
    placed = placed.withColumn("__i", F.row_number().over(held)).alias("a").join(parts.alias("b"), F.expr(f"{same} AND a.__part = b.__part"))
    placed = placed.select(*[f"a.{c}" for c in key], "a.shard", "a.slot", (F.col("a.__i") + F.col("b.__before")).alias("__k"))
    found = slim.alias("a").join(placed.alias("b"), F.expr(f"{same} AND a.__k = b.__k")).select(F.col("a.__row").alias("__at"), "b.shard", "b.slot")
    return keyed.join(found, F.col("__row") == F.col("__at")).select(*[F.col(f"`{c}`") for c in docs.columns], "shard", "slot")


#: The same by SQL, for documents; CRC-32 byte by byte.
ORACLE = r"""
WITH RECURSIVE poly AS (SELECT list(list_reduce(list_prepend(k, range(8)), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) ORDER BY k) AS t FROM range(256) r(k)),
bytes AS (SELECT doc_id, octet_length(encode(coalesce(text, ''))) + 16 AS size,
  list_transform(range(octet_length(encode(coalesce(text, '')))), lambda i: ('0x' || hex(array_slice(encode(coalesce(text, '')), i + 1, i + 1)))::BIGINT) AS b FROM documents),
keyed AS (SELECT doc_id, size::BIGINT AS size, xor(4294967295, list_reduce(list_prepend(4294967295, b), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])))::BIGINT AS crc FROM bytes, poly),
numbered AS (SELECT *, row_number() OVER (ORDER BY substr(md5(coalesce(doc_id::VARCHAR, '~') || '|' || size || '|' || crc), 1, 3), doc_id NULLS FIRST, size, crc) - 1 AS x FROM keyed),
shape AS (SELECT count(*) AS n, greatest(1, floor(sqrt(count(*)))::BIGINT) AS a, ceil(count(*) / greatest(1, floor(sqrt(count(*)))))::BIGINT AS b FROM keyed),
walk AS (
  SELECT x AS start, x, 0 AS step FROM numbered
  UNION ALL
  SELECT start, l4 * b + r4, step + 1 FROM (
    SELECT *, (r2 + ('0x' || substr(md5('linkweave|3|' || l4), 1, 8))::BIGINT) % b AS r4 FROM (
      SELECT *, (l2 + ('0x' || substr(md5('linkweave|2|' || r2), 1, 8))::BIGINT) % a AS l4 FROM (
        SELECT *, (r0 + ('0x' || substr(md5('linkweave|1|' || l2), 1, 8))::BIGINT) % b AS r2 FROM (
          SELECT *, (l0 + ('0x' || substr(md5('linkweave|0|' || r0), 1, 8))::BIGINT) % a AS l2 FROM (
            SELECT start, step, x // b AS l0, x % b AS r0, a, b FROM walk, shape WHERE step = 0 OR x >= n)))))),
placed AS (SELECT start, x AS place FROM walk, shape WHERE step > 0 AND x < n)
SELECT doc_id, size, crc AS text_crc32, 'rows' AS law, (place % 40)::INT AS shard, place // 40 AS slot, NULL::INT AS grown_shard FROM numbered JOIN placed ON start = numbered.x
"""
