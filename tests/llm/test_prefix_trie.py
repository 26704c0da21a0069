"""The trie against one made of dictionaries."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from linkweave.llm import prefix_trie, queries
from tests.llm.conftest import table

TURNS = "conv_id long, turn long, role string, text string"


def plain(rows):
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn, role or "", text or ""))

    def tie(t):
        return t[0], t[1] or 0, hashlib.sha256(f"{len(t[2].encode())}:{t[2]}{t[3]}".encode()).hexdigest()

    own = {c: [t[2:] for t in sorted(turns, key=tie)] for c, turns in own.items()}
    members, finals = {}, {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        done = (*own.get(c - c % 20, [])[:h], *turns[h:])
        for d in range(len(done) + 1):
            members.setdefault(done[:d], []).append(c)
        finals.setdefault(done, []).append(c)
    children = {}
    for p in members:
        if p:
            children.setdefault(p[:-1], []).append(p)
    leaves, saved = dict.fromkeys(members, 0), dict.fromkeys(members, 0)
    for p in members:
        words = len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
        for d in range(len(p) + 1):
            leaves[p[:d]] += p not in children
            saved[p[:d]] += (len(members[p]) - 1) * words
    told = [(min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(children.get(p, [])), leaves[p], saved[p], hashlib.sha256(",".join(map(str, sorted(finals.get(p, [])))).encode()).hexdigest()) for p, m in members.items()]
    return sorted(told, key=lambda r: [(x is None, str(x)) for x in r])


def talks(seed, n=70, depth=6, words=2):
    rnd = random.Random(seed)
    rows = []
    for c in range(0, 3 * n, rnd.choice([1, 2, 3])):
        for k in range(rnd.randint(1, depth)):
            rows.append((c, k, ["user", "assistant"][k % 2], " ".join(rnd.choice("ab") for _ in range(rnd.randint(1, words)))))
    rnd.shuffle(rows)
    return rows


ODD = [(None, 0, "user", "of no conversation"), (5000, None, None, None), (5000, 0, "user", ""), (5001, 0, "user", "a tie"), (5001, 0, "assistant", "a tie"), (5002, 1, "user", "twice"), (5002, 1, "user", "twice"), (5003, 0, "", "user"), (5004, 0, "user", None), (-3, 0, "user", "below zero"), (-20, 0, "user", "first of its group"), (5020, 0, "user", "word " * 20_000)]


@pytest.mark.parametrize(("seed", "block"), [(1, 4096), (3, 2), (5, 3)])
def test_trie(spark, seed, block):
    rows = talks(seed, depth=4 + 2 * seed) + ODD
    got = prefix_trie.prefix_trie(spark.createDataFrame(rows, TURNS).repartition(5), block)
    assert got.columns == prefix_trie.NODE
    assert table(got) == plain(rows)


def test_copies_and_a_long_conversation(spark):
    rows = [(c, k, "user", f"same {k}") for c in range(0, 300, 3) for k in range(5)]  # a third of all ids
    rows += [(c, k, "user", f"{c % 7} {k % 2}") for c in range(1, 300, 3) for k in range(3)]
    rows += [(7, 100 + k, "user", str(k % 3)) for k in range(900)] + [(28, 100 + k, "user", str(k % 3)) for k in range(700)]
    rows += [(9, 5, "user", "again")] * 400
    assert table(prefix_trie.prefix_trie(spark.createDataFrame(rows, TURNS), 64)) == plain(rows)


def test_other_columns_and_empty_tables(spark):
    rows = talks(9, 20)
    frame = spark.createDataFrame(rows, TURNS).withColumns({c: F.lit("own") for c in ("depth", "a", "b", "n_convs", "place", "round", "__range", "light")})
    assert table(prefix_trie.prefix_trie(frame)) == plain(rows)
    assert prefix_trie.prefix_trie(spark.createDataFrame([], TURNS)).collect() == []
    assert prefix_trie.prefix_trie(spark.createDataFrame([(None, 0, "user", "x")], TURNS)).collect() == []
    # the first conversation of the group isn't there, and one turn is less than its share: no turns at all
    alone = next(c for c in range(1, 20) if zlib.crc32(str(c).encode()) % 4 == 2)
    assert table(prefix_trie.prefix_trie(spark.createDataFrame([(alone, 0, "user", "x")], TURNS))) == plain([(alone, 0, "user", "x")])


def test_a_path_is_left_few_times(spark):
    rows = [(20 * c, k, "user", str(c >> k & 1)) for c in range(64) for k in range(6)]
    turns, _ = prefix_trie.rebuilt(spark.createDataFrame(rows, TURNS))
    steps = prefix_trie.prefixes(turns, False, 4096)
    assert prefix_trie.on_paths(steps, prefix_trie.nodes(steps), False, 4096).agg(F.max("round")).first()[0] <= 6


def test_query_and_sql(spark):
    folder = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert table(queries.op13_prefix_trie(spark, folder)) == plain(rows)
    with duckdb.connect() as con:
        con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{folder}/conversations.parquet'")
        got = con.execute(f"SELECT {', '.join(prefix_trie.NODE)} FROM ({prefix_trie.ORACLE})").fetchall()
    assert sorted(got, key=lambda r: [(x is None, str(x)) for x in r]) == plain(rows)
