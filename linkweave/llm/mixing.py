"""Mixing overlapping sources to target weights by min-cost flow.

Documents are aggregated by membership pattern (the set of sources that hold them). Token capacity flows from each
pattern to the quotas of its sources; a pattern's first pass costs nothing, and each further one more than the last, up
to `most` passes. Costs lie on the arcs into patterns alone and rise with the pass, so the cheapest flow is found by
letting one pass after another in and carrying each to a maximum flow (rerouting what was sent before). Whole passes take
every document of a pattern; the part of a pass goes to documents in a seeded order, up to the one whose middle lies
beyond the quota, so a source misses its flow by half a document at most.

The seeded order needs no sort and no shuffle of documents: they fall into 4096 buckets by the leading digits of a keyed hash, the
sums of buckets tell in which one a pattern's part of a pass ends, and only that one's rows are put in order, to find the place. Every
row then tells for itself, from a small table of places, whether it comes before its pattern's.

Defined cases: a null text has size 0; a null source is a source of its own, last in order; rows that repeat an id are separate
documents; those of one size too are counted first and told apart by a hash of the row, and equal rows by their number, where the place lies among
them; other columns are carried along, whatever they are named; sources without a word get target 0; an empty table gives an empty result."""

from __future__ import annotations

from collections import deque

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from linkweave.llm.common import WORD, apart, checkpointed, hashable

#: More patterns than this are refused: they are what the driver holds.
MOST_PATTERNS = 100_000
SEED = "linkweave"


def targets(sizes: dict[str | None, int], weights: dict[str | None, float], total: int, most: int = 3) -> dict[str | None, float]:
    """total by weight; a source stops at most times its size, and the excess is shared by weight until none is above."""
    capped: dict[str | None, float] = {}
    while True:
        open_ = {s: w for s, w in weights.items() if s not in capped}
        rest, weight = total - sum(capped.values()), sum(open_.values())
        share = {s: rest * w / weight for s, w in open_.items()} if weight else {}
        above = [s for s, x in share.items() if x > most * sizes[s]]
        if not above:
            return {s: float(x) for s, x in {**capped, **share}.items()}
        capped |= {s: most * sizes[s] for s in above}


def route(patterns: dict[tuple, int], quotas: dict[str | None, int], most: int = 3) -> dict[tuple, dict[str | None, int]]:
    """Tokens that each pattern sends to each of its sources: a maximum flow, and among those one of least repetition cost."""
    names = sorted(patterns, key=repr)
    flow = {p: dict.fromkeys(p, 0) for p in names}
    spare, free = dict.fromkeys(names, 0), dict(quotas)
    holds: dict[str | None, list[tuple]] = {}
    for p in names:
        for s in p:
            holds.setdefault(s, []).append(p)
    for _ in range(most):
        for p in names:
            spare[p] += patterns[p]
        while True:  # shortest augmenting paths: pattern -> source, and back over what a source already gets
            came: dict[tuple, tuple | None] = {("p", p): None for p in names if spare[p]}
            queue, end = deque(came), None
            while queue and end is None:
                kind, x = here = queue.popleft()
                if kind == "s" and free[x]:
                    end = here
                    break
                onward = [("s", s) for s in x] if kind == "p" else [("p", p) for p in holds[x] if flow[p][x]]
                for y in onward:
                    if y not in came:
                        came[y] = here
                        queue.append(y)
            if end is None:
                break
            path = [end]
            while came[path[-1]] is not None:
                path.append(came[path[-1]])
            path.reverse()
            steps = list(zip(path, path[1:], strict=False))
            amount = min([spare[path[0][1]], free[end[1]], *(flow[b[1]][a[1]] for a, b in steps if a[0] == "s")])
            for a, b in steps:
                if a[0] == "p":
                    flow[a[1]][b[1]] += amount
                else:
                    flow[b[1]][a[1]] -= amount
            spare[path[0][1]] -= amount
            free[end[1]] -= amount
    return flow


def words(text: Column | str) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def mix(docs: DataFrame, size: Column, members: Column, weights: dict[str | None, float] | None = None, most: int = 3, seed: str = SEED, source: Column | None = None) -> DataFrame:
    """docs with __size, __taken (times its size), __source_size and __target of `source` (or the first member).

    members: an array of sources. weights: 1, 2, 3, repeating, over the sources in order of code points, null last, by default.
    docs is read three times, the second time for the rows of one bucket of each pattern alone; it isn't shuffled."""
    spark = docs.sparkSession
    text = F.concat(F.lit(f"{seed}|"), F.coalesce(F.col("doc_id").cast("string"), F.lit("~")))
    placed = docs.withColumns({"__members": F.array_sort(F.array_distinct(members)), "__source": source if source is not None else F.get(members, F.lit(0)), "__order": F.md5(text.cast("binary"))})
    placed = placed.withColumns({"__bucket": F.substring("__order", 1, 3), "__size": size})
    sums = checkpointed(placed.groupBy("__members", "__bucket").agg(F.sum("__size").alias("__n")))  # 4096 rows for each pattern at most
    told = sums.groupBy("__members").agg(F.sum("__n")).limit(MOST_PATTERNS + 1).collect()
    if len(told) > MOST_PATTERNS:
        raise ValueError(f"over {MOST_PATTERNS} membership patterns")
    patterns = {tuple(r[0]): int(r[1]) for r in told}
    sizes: dict[str | None, int] = {}
    for p, n in patterns.items():
        for s in p:
            sizes[s] = sizes.get(s, 0) + n
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weights = weights or {s: k % 3 + 1 for k, s in enumerate(order)}
    aim = targets(sizes, {s: weights.get(s, 0) for s in order}, sum(patterns.values()), most)
    sent = route(patterns, {s: int(aim[s]) for s in order}, most)
    passes = {p: divmod(sum(sent[p].values()), n) if n else (0, 0) for p, n in patterns.items()}
    cuts = _cuts(placed, sums, {p: rest for p, (_, rest) in passes.items()})
    plan = [(list(p), whole, *cuts.get(p, ("", None, None, 0))) for p, (whole, _) in passes.items()]
    plan = spark.createDataFrame(plan, "__m array<string>, __passes long, __cut_bucket string, __cut_order string, __cut_size long, __fit long")
    about = spark.createDataFrame([(s, sizes[s], aim[s]) for s in order], "__s string, __source_size long, __target double")
    # both tables have a row for each pattern or source, MOST_PATTERNS at most
    known = placed.join(F.broadcast(plan), F.col("__members").eqNullSafe(F.col("__m"))).join(F.broadcast(about), F.col("__source").eqNullSafe(F.col("__s")), "left")
    out = [*[F.col(c) for c in docs.columns], F.col("__size"), "__taken", "__source_size", "__target"]
    before, at = F.col("__bucket") < F.col("__cut_bucket"), F.col("__bucket") == F.col("__cut_bucket")
    earlier = F.col("__cut_order").isNull() | (F.col("__order") < F.col("__cut_order")) | ((F.col("__order") == F.col("__cut_order")) & (F.col("__size") < F.col("__cut_size")))
    tied = at & F.coalesce((F.col("__order") == F.col("__cut_order")) & (F.col("__size") == F.col("__cut_size")), F.lit(False))
    part = F.when(before | (at & F.coalesce(earlier, F.lit(False))), 1).otherwise(0)

    def taken(rows: DataFrame, more: Column) -> DataFrame:
        return rows.withColumn("__taken", F.least(F.lit(most), F.col("__passes") + more).cast("int")).select(*out)

    if not any(fit for *_, fit in cuts.values()):
        return taken(known, part)
    # rows under one id and of one size, of which only so many are taken once more
    ties = checkpointed(known.where(tied).withColumns({"__row": F.xxhash64(*hashable(docs)), "__task": F.spark_partition_id()}))
    counts = ties.groupBy("__m", "__row", "__task").agg(F.count("*").alias("__k"))
    ahead = F.coalesce(F.sum("__k").over(Window.partitionBy("__m").orderBy("__row", "__task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.withColumn("__ahead", ahead).select(F.col("__m").alias("__m2"), F.col("__row").alias("__row2"), F.col("__task").alias("__task2"), "__ahead")
    numbered = ties.withColumn("__i", F.row_number().over(Window.partitionBy("__m", "__row", "__task").orderBy("__order")))
    numbered = numbered.join(counts, F.col("__m").eqNullSafe(F.col("__m2")) & (F.col("__row") == F.col("__row2")) & (F.col("__task") == F.col("__task2")))
    return taken(known.where(~tied), part).unionByName(taken(numbered, F.when(F.col("__ahead") + F.col("__i") <= F.col("__fit"), 1).otherwise(0)))


def _cuts(placed: DataFrame, sums: DataFrame, rests: dict[tuple, int]) -> dict[tuple, tuple]:
    """Where the part of a pass ends in each pattern: (bucket, order, size, fit).

    Rows of earlier buckets are in it, those of later ones aren't; of the bucket's rows those before (order, size) are, and `fit` of
    those with just this order and size. order is null if the whole bucket is in it."""
    spark = placed.sparkSession
    rest = spark.createDataFrame([(list(p), r) for p, r in rests.items() if r], "__m array<string>, __rest long")
    sums = sums.join(F.broadcast(rest), F.col("__members").eqNullSafe(F.col("__m")))
    run = Window.partitionBy("__m").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, 0)
    ends = sums.withColumn("__end", F.sum("__n").over(run)).where(F.col("__end") > F.col("__rest"))
    first = ends.groupBy("__m", "__rest").agg(F.min(F.struct("__bucket", "__end", "__n")).alias("f"))
    first = checkpointed(first.select("__m", "__rest", F.col("f.__bucket").alias("__b"), (F.col("f.__end") - F.col("f.__n")).alias("__offset")))  # a row for each pattern
    cut = {tuple(r["__m"]): (r["__b"], None, None, 0) for r in first.collect()}
    inside = placed.join(F.broadcast(first), F.col("__members").eqNullSafe(F.col("__m")) & (F.col("__bucket") == F.col("__b")))
    each = inside.groupBy("__m", "__rest", "__b", "__offset", "__order", "__size").agg(F.count("*").alias("__n"))
    held = F.sum(F.col("__size") * F.col("__n")).over(Window.partitionBy("__m").orderBy("__order", "__size").rowsBetween(Window.unboundedPreceding, -1))
    each = each.withColumn("__before", F.col("__offset") + F.coalesce(held, F.lit(0)))
    over = each.where(2 * (F.col("__before") + (F.col("__n") - 1) * F.col("__size")) + F.col("__size") > 2 * F.col("__rest"))
    least = over.groupBy("__m", "__rest", "__b").agg(F.min(F.struct("__order", "__size", "__before")).alias("f"))
    for r in least.select("__m", "__rest", "__b", "f.*").collect():  # a row for each pattern at most
        room = 2 * (r["__rest"] - r["__before"]) - r["__size"]
        cut[tuple(r["__m"])] = (r["__b"], r["__order"], r["__size"], room // (2 * r["__size"]) + 1 if room >= 0 and r["__size"] else 0)
    return cut


def report(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target and taken of each document."""
    slim = checkpointed(docs.select("doc_id", "source", words("text").alias("size")))  # texts are read once
    mixed = mix(slim, F.col("size"), F.array("source"))
    return mixed.select("doc_id", "size", F.col("__source_size").alias("source_size"), F.col("__target").alias("target"), (F.col("size") * F.col("__taken")).alias("taken"))


@apart
def mixed(docs: DataFrame) -> DataFrame:
    """docs, each row as often as the mix takes it, all its columns."""
    placed = mix(docs, words("text"), F.array("source"))
    return placed.where("__taken > 0").withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__taken")))).select(*docs.columns)


#: The same by SQL, for documents.
ORACLE = r"""
WITH RECURSIVE sized AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
sources AS (SELECT source, sum(size)::BIGINT AS s, ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::BIGINT AS w FROM sized GROUP BY source),
whole AS (SELECT sum(s)::BIGINT AS t FROM sources),
fill AS (
  SELECT 0 AS i, source, s, w, false AS capped, (SELECT t FROM whole) * w / (SELECT sum(w) FROM sources)::DOUBLE AS target FROM sources
  UNION ALL
  SELECT i + 1, source, s, w, now, CASE WHEN now THEN (3 * s)::DOUBLE ELSE
    (((SELECT t FROM whole) - sum(CASE WHEN now THEN 3 * s ELSE 0 END) OVER ()) * w)::DOUBLE / (sum(CASE WHEN now THEN 0 ELSE w END) OVER ())::DOUBLE END
  FROM (SELECT *, capped OR target > 3 * s AS now FROM fill WHERE i < 30)),
aims AS (SELECT source, s, target, least(floor(target)::BIGINT, 3 * s) AS f FROM fill WHERE i = 30),
passes AS (SELECT *, CASE WHEN s = 0 THEN 0 ELSE f // s END AS p, CASE WHEN s = 0 THEN 0 ELSE f % s END AS rest FROM aims),
placed AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY md5('linkweave|' || coalesce(doc_id::VARCHAR, '~')), doc_id NULLS FIRST, size
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM sized)
SELECT doc_id, size, s AS source_size, target, (size * least(3, p + CASE WHEN 2 * before + size <= 2 * rest THEN 1 ELSE 0 END))::BIGINT AS taken
FROM placed JOIN passes ON placed.source IS NOT DISTINCT FROM passes.source
"""
