"""Token counts against the tokenizers library."""

from __future__ import annotations

import json
import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from linkweave.llm import queries, token_counts
from tests.llm.conftest import DOCS, table

FILE = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(FILE)
KINDS = ("aab bAé  \n\t'sre1２Ⅷ½̀  　中😀ۀא\x1c\x85힣՘ll've<|>endoftext", "ab  \n\t'sr1.!", "a \n", "the  of\n ing ")


def n_tokens(text):
    return len(LIBRARY.encode(text or "", add_special_tokens=False).ids)


def want(rows):
    return sorted(((i, len((t or "").encode()), n_tokens(t), n_tokens(t) > 100) for i, t, *_ in rows), key=lambda r: [(x is None, str(x)) for x in r])


def test_documents(spark, rows, docs, nothing, clashing, underscored):
    for frame in (docs, clashing, underscored):
        assert table(token_counts.count_tokens(frame, FILE, 100)) == want(rows)
    assert token_counts.count_tokens(nothing, FILE).count() == 0


@pytest.mark.parametrize("kind", range(len(KINDS)))
def test_random_texts(kind):
    rnd, counting = random.Random(kind), token_counts.merges(FILE)
    for _ in range(4000):
        text = "".join(rnd.choice(KINDS[kind]) for _ in range(rnd.randint(0, 40)))
        text += ("<|endoftext|>" + text) * (rnd.random() < 0.1)
        assert counting.count(text) == n_tokens(text), text


def test_every_plain_character_is_split_as_by_the_library():
    before = LIBRARY.pre_tokenizer
    for c in [*range(0x530), *range(0x2000, 0x2070)]:
        text = f"a{chr(c)}b1{chr(c)}1 {chr(c)}{chr(c)} .{chr(c)}"
        assert not token_counts.STRANGE.search(text)
        assert [m.span() for m in token_counts.SPLIT.finditer(text)] == [x for _, x in before.pre_tokenize_str(text)], hex(c)


def test_long_pieces_and_texts(spark):
    counting = token_counts.merges(FILE)
    for piece in ("a" * 20_000, " " * 9_000, "ab" * 7_000, "é" * 5_000, "the" * 3_000):
        assert counting.count(piece) == n_tokens(piece)
    long = ("word of  text\n " * 90_000)[: (1 << 20) + 77]  # beyond LONG
    assert counting.count(long) == n_tokens(long)
    got = token_counts.count_tokens(spark.createDataFrame([(1, long, None, None, 0), (1, long, None, None, 0)], DOCS), FILE).collect()
    assert [tuple(r) for r in got] == [(1, len(long), n_tokens(long), True)] * 2


def test_forgetting(monkeypatch):
    monkeypatch.setattr(token_counts, "REMEMBERED", 8)
    counting = token_counts.Merges(FILE)
    text = " ".join(f"w{k % 30} and" for k in range(300))
    assert counting.count(text) == n_tokens(text) and len(counting.pieces) <= 8


def test_other_files_are_refused(tmp_path):
    with open(FILE, encoding="utf-8") as f:
        whole = json.load(f)
    for change in ({"normalizer": {"type": "NFC"}}, {"pre_tokenizer": {"type": "Whitespace"}}, {"model": whole["model"] | {"ignore_merges": True}}, {"added_tokens": [whole["added_tokens"][0] | {"lstrip": True}]}):
        path = tmp_path / "other.json"
        path.write_text(json.dumps(whole | change), encoding="utf-8")
        with pytest.raises(ValueError, match="other.json"):
            token_counts.Merges(str(path))


def test_query(spark):
    folder = "/root/testdata/sf0.001"
    rows = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    got = queries.op11_token_counts(spark, folder).collect()
    assert len(got) == len(rows)
    assert all((r.n_bytes, r.n_tokens, r.over_limit) == (len((rows[r.doc_id] or "").encode()), n_tokens(rows[r.doc_id]), n_tokens(rows[r.doc_id]) > 1024) for r in got)
