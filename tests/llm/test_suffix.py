from __future__ import annotations

import hashlib
import random

import numpy as np

from linkweave.llm import suffix_dedup as S
from tests.llm.conftest import DOCS, table


def brute(rows, window=100):
    seen, out = set(), {}
    for d, t in sorted({(r[0], r[1] or "") for r in rows}, key=lambda r: (r[0] is not None, r[0] or 0)):
        b = t.encode()
        gone = np.zeros(len(b), bool)
        for s in range(len(b) - window + 1):
            w = b[s : s + window]
            if w in seen:
                gone[s : s + window] = True
            seen.add(w)
        edge = np.diff(np.concatenate([[0], gone.astype(int), [0]]))
        out[d] = (len(b), int(gone.sum()), int((edge == 1).sum()), hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest())
    return out


def awkward():
    rnd = random.Random(9)
    base = "".join(rnd.choice("abc d") for _ in range(700))
    rows = [(1, base), (2, base[:99]), (3, base[:100]), (4, base[50:260] + "é" + base[40:300]), (5, base + base), (6, "a" * 350), (7, "ab" * 300), (8, None), (9, ""), (10, "b" + "a" * 100), (11, base[300:] + base[:400]), (None, base[10:200])]
    for k in range(40):
        i, j = rnd.randrange(600), rnd.randrange(600)
        rows.append((20 + k, base[i : i + rnd.randint(0, 300)] + rnd.choice("xyz") + base[j : j + rnd.randint(0, 300)]))
    return rows


def check(spark, rows, parts):
    df = spark.createDataFrame([(*r[:2], None, None, None) for r in rows], DOCS).repartition(parts)
    want = brute(rows)
    got = S.remove_repeats(df).collect()
    assert len(got) == len(rows)
    assert {r["doc_id"]: tuple(r)[1:] for r in got} == want
    return want


def test_against_brute_force(spark):
    want = check(spark, awkward(), 4)
    assert sum(v[1] for v in want.values()) > 5000


def test_corpus(spark, rows):
    mine = [r for r in rows if len({x[1] for x in rows if x[0] == r[0]}) == 1 and r[0] != 1004]
    check(spark, mine, 3)


def test_several_flushes_and_parts_of_long_texts(spark, monkeypatch):
    rows = awkward()
    plain = {}

    def deal(batches):
        found = [r for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True)]
        return [S._rows(sorted(found, key=lambda r: r[:2]))] if found else []

    import pyarrow as pa

    monkeypatch.setattr(S, "FLUSH", 20)
    monkeypatch.setattr(S._texts, "__defaults__", (150,))
    n, texts, first = 5, [], []
    for k in range(4):
        some = rows[k::4]
        batch = pa.record_batch({"doc_id": pa.array([r[0] for r in some], pa.int64()), "key": pa.array([hash(r) for r in some], pa.int64()), "text": pa.array([r[1] or "" for r in some])})
        first += list(S._anchored(n)([batch]))
        texts += list(S._documents(n)([batch]))
    places = list(S._repeated(n)(deal(first)))
    ranges = list(S._sorted(n)(deal(list(S._cut(n)(deal(places + texts))))))
    for b in S._removed(True)(deal(ranges + texts)):
        plain |= {r[0]: r[1:5] for r in zip(*(c.to_pylist() for c in b.columns), strict=True)}
    assert plain == brute(rows)


def test_columns_against_plain_sort(tmp_path):
    rnd = random.Random(2)
    strings = ["".join(rnd.choice("ab") for _ in range(168)).encode() for _ in range(50)]
    strings += [s[:60] + strings[0][60:] for s in strings[:20]]
    lead = last = np.full(len(strings), 68)
    lead, last = np.full(len(strings), 68), np.zeros(len(strings), np.int64)
    priority = np.random.default_rng(1).permutation(len(strings))
    marks = S.sorted_columns(strings, lead, last, priority, str(tmp_path))
    for c in range(69):
        for i, s in enumerate(strings):
            assert marks[i, c] == any(t[c : c + 100] == s[c : c + 100] and priority[j] < priority[i] for j, t in enumerate(strings))


def test_repeated_rows_and_empty(spark, nothing, clashing, docs):
    rows = [(1, "x" * 30 + "long enough to be counted, " * 9)] * 3
    df = spark.createDataFrame([(*r, None, None, None) for r in rows], DOCS)
    assert len(set(table(S.remove_repeats(df)))) == 1
    assert table(S.remove_repeats(nothing)) == []
    assert table(S.remove_repeats(clashing)) == table(S.remove_repeats(docs))
