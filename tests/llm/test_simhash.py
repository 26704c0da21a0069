from __future__ import annotations

import numpy as np
import pytest
import xxhash

from linkweave.llm import simhash, similarity
from linkweave.llm.common import components, labelled
from tests.llm.conftest import corpus, table


def plain(text, n=4):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    if not words:
        return 0
    shingles = [b" ".join(words[k : k + n]) for k in range(len(words) - n + 1)] or [b" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute(rows):
    prints = np.array([plain(r[1]) for r in rows], np.uint64)
    a, b = np.nonzero(np.bitwise_count(prints[:, None] ^ prints) <= 4)
    label = labelled(len(rows), a, b)
    least = {}
    for k, r in zip(label, rows, strict=True):
        least[k] = min((x for x in (least.get(k), r[0]) if x is not None), default=None)
    return [(r[0], f"{p:016x}", least[k]) for r, p, k in zip(rows, prints.tolist(), label, strict=True)]


def ordered(rows):
    return sorted(rows, key=lambda r: [(x is None, str(x)) for x in r])


def test_against_brute_force(docs, rows):
    assert table(simhash.near_duplicates(docs)) == ordered(brute(rows))


def test_fingerprint_cases():
    for text in ("", "  \n", "One", "one two three", "one two three four", "A b C d E f g", "É é É é É", "x " * 500):
        assert simhash.fingerprint(text.encode()) == plain(text)


def test_planes_and_radius():
    rng = np.random.default_rng(5)
    base = rng.integers(0, 2**63, 40, dtype=np.uint64)
    fps = base[rng.integers(0, 40, 900)]
    for k in range(900):
        for b in rng.integers(0, 64, rng.integers(0, 8)):
            fps[k] ^= np.uint64(1) << np.uint64(b)
    for radius in (0, 1, 3, 4, 7):
        child, root = simhash._linked(fps, np.zeros(900, np.int64), np.zeros(900, np.int64), radius)
        a, b = np.nonzero(np.bitwise_count(fps[:, None] ^ fps) <= radius)
        assert (labelled(900, child, root) == labelled(900, a, b)).all()


def test_buckets_cut_in_tiles_lose_no_link(spark):
    rng = np.random.default_rng(6)
    fps = np.unique(np.uint64(0xABCDEF0123456789) ^ (np.uint64(1) << rng.integers(0, 64, 400).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 400).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 400).astype(np.uint64)))
    signed = fps.view(np.int64).tolist()
    nodes = spark.createDataFrame([(x, x) for x in signed], "node long, fp long")
    found = {r[0]: r[1] for r in components(simhash.links(nodes, 4, tile=20)).collect()}
    a, b = np.nonzero(np.bitwise_count(fps[:, None] ^ fps) <= 4)
    groups = labelled(len(fps), a, b)
    mine = [found.get(x, x) for x in signed]
    assert len(set(zip(groups.tolist(), mine, strict=True))) == len(set(groups.tolist())) == len(set(mine))


@pytest.mark.parametrize("k", [1, 2, 3])
def test_longer_keys_lose_no_link(spark, k):
    n = {1: 1, 2: 1 << 24, 3: 1 << 33}[k]
    masks = simhash.block_masks(n, 4)
    assert len(masks) == {1: 5, 2: 15, 3: 35}[k]
    rng = np.random.default_rng(k)
    fps = rng.integers(0, 2**64, 60, dtype=np.uint64)[rng.integers(0, 60, 600)]
    for _ in range(4):
        fps ^= np.uint64(1) << rng.integers(0, 64, 600).astype(np.uint64)
    fps = np.unique(fps)
    signed = fps.view(np.int64).tolist()
    nodes = spark.createDataFrame([(x, x) for x in signed], "node long, fp long")
    found = {r[0]: r[1] for r in components(simhash.links(nodes, 4, masks=masks)).collect()}
    a, b = np.nonzero(np.bitwise_count(fps[:, None] ^ fps) <= 4)
    groups, mine = labelled(len(fps), a, b), [found.get(x, x) for x in signed]
    assert len(set(zip(groups.tolist(), mine, strict=True))) == len(set(groups.tolist())) == len(set(mine))


def test_any_column_names(docs, underscored):
    for run in (simhash.representatives, similarity.representatives):
        out = run(underscored)
        assert out.columns == underscored.columns and table(out, *docs.columns) == table(run(docs))


def test_unrelated_rows_without_an_id_or_under_one_stay(spark):
    rows = [(None, "a b c d e f"), (None, "g h i j k l"), (None, "m n o p q r"), (1, "s t u v w x"), (1, "y z a c e g"), (2, "s t u v w x")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert table(simhash.representatives(df, ids_once=False)) == ordered(rows[:5])
    assert table(similarity.representatives(df)) == ordered(rows[:5])


def test_components_of_long_chains(spark):
    order = np.random.default_rng(7).permutation(300).tolist()
    links = spark.createDataFrame([(order[k], order[k + 1]) for k in range(299) if k != 150], "a long, b long")
    want = {x: min(order[:151]) for x in order[:151]} | {x: min(order[151:]) for x in order[151:]}
    assert {r[0]: r[1] for r in components(links).collect()} == want
    assert components(links.where("false")).count() == 0


def test_representatives(docs, rows, nothing, clashing):
    groups = brute(rows)
    out = simhash.representatives(clashing)
    assert out.columns == clashing.columns
    stay = {d for d, _, c in groups if d == c}
    assert sorted(r["doc_id"] for r in out.collect() if r["doc_id"] is not None) == sorted(x for x in stay if x is not None)
    assert table(simhash.near_duplicates(nothing)) == [] and table(simhash.representatives(nothing)) == []
    assert len(corpus()) == len(rows) and docs.count() == len(rows)
