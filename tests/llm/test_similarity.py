from __future__ import annotations

import random
from collections import Counter
from fractions import Fraction

import numpy as np

import corpus_pipeline as P
from linkweave.llm import similarity
from linkweave.llm.common import labelled
from tests.llm.conftest import DOCS, sentence, table


def plain(text, n=5):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    return {b" ".join(words[k : k + n]) for k in range(len(words) - n + 1)} or {b" ".join(words)}


def brute(rows, least=0.8):
    """The rows that stay: of each component the smallest id, nulls last."""
    sets = [plain(r[1]) for r in rows]
    a, b = zip(*[(i, j) for i, x in enumerate(sets) for j, y in enumerate(sets) if len(x & y) >= least * len(x | y)], strict=True)
    label = labelled(len(rows), np.array(a), np.array(b))
    stay = {}
    for k, r in zip(label.tolist(), rows, strict=True):
        stay[k] = min(stay.get(k, r), r, key=lambda r: (r[0] is None, r[0] or 0))
    return stay.values()


def family(seed, n):
    """Texts and copies with several words changed here and there, to both sides of 0.8."""
    rnd, rows = random.Random(seed), []
    for k in range(n):
        words = sentence(rnd, rnd.randint(3, 300)).split()
        rows.append((10 * k, " ".join(words)))
        for c in range(rnd.randint(0, 4)):
            other = list(words)
            for _ in range(rnd.randint(1, max(1, len(words) // 30))):
                other[rnd.randrange(len(words))] = "changed"
            rows.append((10 * k + c + 1, " ".join(other)))
    return [(d, t, "en", "s1", len(t)) for d, t in rows]


def test_stage_drops_near_copies_of_several_changed_words(spark):
    rows = family(4, 60)
    docs = spark.createDataFrame(rows, DOCS).repartition(4)
    assert sorted(map(tuple, P.simhash_stage(spark, docs, "").collect())) == sorted(brute(rows))


def test_awkward_rows(docs, rows, nothing, clashing):
    out = similarity.representatives(clashing)
    assert out.columns == clashing.columns
    assert Counter(r["doc_id"] for r in out.collect()) == Counter(r[0] for r in brute(rows))
    assert table(similarity.representatives(nothing)) == []


def test_groups_cut_in_tiles_lose_no_link(spark):
    rnd = random.Random(8)
    words = sentence(rnd, 200).split()
    rows = []
    for k in range(60):
        words[rnd.randrange(200)] = f"w{k}"
        rows.append((k, " ".join(words), "en", "s1", 1))  # a chain: far ends are not similar
    rows += [(100 + k, sentence(rnd, 50), "en", "s1", 1) for k in range(20)]
    out = similarity.representatives(spark.createDataFrame(rows, DOCS), tile=7)
    assert sorted(r["doc_id"] for r in out.collect()) == [0, *range(100, 120)]


def test_similarity_is_exact():
    a, b, c = np.arange(9, dtype=np.uint64), np.arange(10, dtype=np.uint64), np.arange(2, 10, dtype=np.uint64)
    for least, want in ((Fraction(4, 5), {0: 0, 1: 0, 2: 0}), (Fraction(81, 100), {0: 0, 1: 0, 2: 2}), (Fraction(91, 100), {0: 0, 1: 1, 2: 2})):
        child, root = similarity.alike([a, b, c], np.zeros(3, int), least)
        assert labelled(3, child, root).tolist() == list(want.values())


def boilerplate(n, seed=5):
    """Texts that share two fifths of their words, as one passage, and are not alike."""
    rnd = random.Random(seed)
    common = sentence(rnd, 120)
    return [(k, f"{common} " + " ".join(f"{rnd.randrange(10**6)}" for _ in range(180)), "en", "s1", 1) for k in range(n)]


def test_boilerplate_makes_no_groups(spark):
    """Texts that meet, but aren't similar, fall apart before they are compared."""
    groups = {}
    for n in (300, 1500):
        prints = similarity.sketches(spark.createDataFrame(boilerplate(n), DOCS), 5)
        keys = Counter(x for r in prints.select("bands").collect() for x in set(r["bands"]))
        groups[n] = (max(keys.values()), similarity.candidates(prints, Fraction(4, 5)).count())
    assert groups[1500][0] > 10 and groups[300][1] == groups[1500][1] == 0


def test_recall_of_candidates(spark):
    """Of several hundred pairs between 0.8 and 0.9 all become candidates."""
    rnd, rows = random.Random(6), []
    while len(rows) < 800:
        words = [f"{rnd.randrange(10**6)}" for _ in range(rnd.randint(60, 400))]
        other = list(words)
        for _ in range(rnd.randint(1, len(words) // 40 + 1)):
            other[rnd.randrange(len(words))] = "changed"
        x, y = plain(" ".join(words)), plain(" ".join(other))
        if 0.8 <= len(x & y) / len(x | y) < 0.9:
            rows += [(len(rows), " ".join(words), "en", "s1", 1), (len(rows) + 1, " ".join(other), "en", "s1", 1)]
    prints = similarity.sketches(spark.createDataFrame(rows, DOCS), 5)
    at = {r["node"]: r["doc_id"] for r in prints.select("node", "doc_id").collect()}
    found = {frozenset((at[r["a"]], at[r["b"]])) for r in similarity.candidates(prints, Fraction(4, 5)).collect()}
    assert found == {frozenset((k, k + 1)) for k in range(0, 800, 2)}


def test_buckets_cut_in_tiles_lose_no_candidate(spark):
    rnd = random.Random(9)
    words = sentence(rnd, 300).split()
    rows = [(k, " ".join([*words[:k], "other", *words[k + 1 :]]), "en", "s1", 1) for k in range(40)]
    prints = similarity.sketches(spark.createDataFrame(rows, DOCS), 5)
    for tile in (7, 1000):
        pairs = similarity.meetings(prints, Fraction(4, 5), tile).collect()
        ids = {x: k for k, x in enumerate({r["node"] for r in prints.select("node").collect()})}
        assert not labelled(40, np.array([ids[r["a"]] for r in pairs]), np.array([ids[r["b"]] for r in pairs])).any()
