from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from linkweave.llm import packing
from tests.llm.conftest import table

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def tokenizer():
    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    return t


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(max_size=30) | st.sampled_from(["", "  a", "a \n b", "it's 12 <|endoftext|>", "\t\t", "x" * 500, "é 日本 ́"]), min_size=1, max_size=5))
def test_ids_are_the_tokenizers(texts):
    encoder = packing.encoder(PATH)
    want = encoder.tokenizer.encode_batch(texts, add_special_tokens=False)
    assert [x.tolist() for x in encoder.encode(texts)] == [e.ids for e in want]


def check(got, rows, tokenizer, capacity=2048):
    want = Counter()
    for r in rows:
        ids = [*tokenizer.encode(r[1] or "", add_special_tokens=False).ids, 1]
        want[r[0], tuple(ids)] += 1
    sequences: dict[int, list] = {}
    for r in got:
        sequences.setdefault(r["sequence_id"], []).append(r)
    for pieces in sequences.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= capacity and {(r["sequence_tokens"], r["padded_to"]) for r in pieces} == {(at, min(capacity, 1 << (at - 1).bit_length()))}
    # pieces of rows that repeat an id: each row's pieces tile it once
    by: dict = {}
    for r in got:
        by.setdefault(r["doc_id"], []).append(r)
    for doc, pieces in by.items():
        docs = [list(ids) for (d, ids), k in want.items() if d == doc for _ in range(k)]
        assert sum(r["length"] for r in pieces) == sum(map(len, docs))
        for r in pieces:
            assert any(len(ids) == r["doc_tokens"] and zlib.crc32(np.array(ids[r["start"] : r["start"] + r["length"]], "<u4").tobytes()) == r["ids_crc32"] for ids in docs)
        if len(docs) == 1:
            at = 0
            for r in sorted(pieces, key=lambda r: r["start"]):
                assert r["start"] == at
                at += r["length"]
            assert at == len(docs[0])
    return sequences


def test_documents(docs, rows, tokenizer):
    sequences = check(packing.pack(docs, PATH).collect(), rows, tokenizer)
    tokens = sum(sum(r["length"] for r in p) for p in sequences.values())
    assert sum(p[0]["padded_to"] for p in sequences.values()) <= 1.15 * tokens  # five tiny partitions


def test_small_groups_and_capacity(docs, rows, tokenizer):
    check(packing.pack(docs, PATH, capacity=64, group=7).collect(), rows, tokenizer, 64)


def test_ids_column(docs):
    for r in packing.pack(docs, PATH, with_ids=True).collect():
        assert zlib.crc32(np.array(r["ids"], "<u4").tobytes()) == r["ids_crc32"] and len(r["ids"]) == r["length"]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 63), max_size=60))
def test_assign_fills_sequences_exactly(lengths):
    pieces = packing.assign(lengths, 64)
    held: dict[int, list] = {}
    for n, own in zip(lengths, pieces, strict=True):
        assert sum(p[1] for p in own) == n and [p[0] for p in own] == np.cumsum([0, *[p[1] for p in own]])[:-1].tolist()
        for p in own:
            held.setdefault(p[2], []).append((p[3], p[1]))
    sizes = []
    for spans in held.values():
        at = 0
        for o, n in sorted(spans):
            assert o == at
            at += n
        sizes.append(at)
    assert sum(s < 64 for s in sizes) <= 1 and all(s <= 64 for s in sizes)


def test_costs_are_balanced():
    rng = np.random.default_rng(3)
    lengths = rng.integers(1, 2048, 4000).tolist()
    cost: dict[int, float] = {}
    for own in packing.assign(lengths):
        for _, n, k, _ in own:
            cost[k] = cost.get(k, 0) + packing.cost(n)
    first_fit, room, costs = 0, [], []
    for n in sorted(lengths, reverse=True):
        k = next((k for k, r in enumerate(room) if r >= n), None)
        if k is None:
            room.append(2048)
            costs.append(0.0)
            k = len(room) - 1
        room[k] -= n
        costs[k] += packing.cost(n)
    mine = np.array([c for c in cost.values()])
    assert len(mine) <= len(costs) and mine.std() < np.std(costs) and first_fit == 0


def test_empty_and_extra_columns(nothing, docs, clashing):
    assert table(packing.pack(nothing, PATH)) == []
    assert table(packing.pack(clashing, PATH)) == table(packing.pack(docs, PATH))


def test_only_what_fits_nowhere_is_cut():
    """Each remainder, in descending order, against a plain search of all sequences."""
    rng = np.random.default_rng(4)
    lengths = np.concatenate([rng.integers(1, 300, 3000), rng.integers(300, 2048, 1000)]).tolist()
    total = sum(lengths)
    room = [2048] * (total // 2048) + [total % 2048] * (total % 2048 > 0)
    costs, whole = [0.0] * len(room), {}
    for d in sorted(range(len(lengths)), key=lambda d: (-lengths[d], d)):
        fits = [(c, k) for k, c in enumerate(costs) if room[k] >= lengths[d]]
        if fits:
            whole[d] = k = min(fits)[1]
            room[k] -= lengths[d]
            costs[k] += packing.cost(lengths[d])
    pieces = packing.assign(lengths)
    assert {d: own[0][2] for d, own in enumerate(pieces) if len(own) == 1 and d in whole} == whole


def test_added_tokens_are_the_librarys(spark):
    texts = ["a <|endoftext|> b", "<|endoftext|>", "no<|endoftext|><|endoftext|>gap\n", "<|endoftext", "plain"]
    library = Tokenizer.from_file(PATH)
    want = [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert want[0] == [64, 220, 50256, 275]
    assert [x.tolist() for x in packing.encoder(PATH).encode(texts)] == want
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r["doc_id"]: r["ids"][:-1] for r in packing.pack(docs, PATH, with_ids=True).collect()} == dict(enumerate(want))


def test_very_long_runs(spark, tokenizer):
    """Ten million characters without a boundary, through Spark, and shorter ones at every place where the two ways meet."""
    long = [" " * 10_000_000, "\n" * 3_000_000, "a" * 3_000_000, "é" * 5000, "?" * 4097, "7" * 4096, "x" + " " * 4095 + "y", "x" + " " * 5000 + "y z"]
    docs = spark.createDataFrame(list(enumerate(long)), "doc_id long, text string")
    found = {r["doc_id"]: r["doc_tokens"] for r in packing.pack(docs, PATH).collect()}
    library = Tokenizer.from_file(PATH)
    assert found == {k: len(library.encode(t, add_special_tokens=False).ids) + 1 for k, t in enumerate(long)}
    assert [x.tolist() for x in packing.encoder(PATH).encode(long[3:])] == [library.encode(t, add_special_tokens=False).ids for t in long[3:]]


def test_other_files_are_refused(tmp_path):
    import json

    whole = json.load(open(PATH, encoding="utf-8"))
    for k, change in enumerate(({"normalizer": {"type": "NFC"}}, {"pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": True, "trim_offsets": True, "use_regex": True}}, {"pre_tokenizer": {"type": "Whitespace"}})):
        path = tmp_path / f"{k}.json"
        path.write_text(json.dumps(whole | change), encoding="utf-8")
        with pytest.raises(ValueError, match="split"):
            packing.Encoder(str(path))
