"""Cost-balanced packing of tokenized documents into sequences of fixed capacity.

The cost of a piece of n tokens is linear plus quadratic, n + n * n / QUADRATIC_AT: attention stays inside a piece.
A document's full runs of `capacity` tokens are sequences of their own. What remains of the documents of one group (about
`group` documents that one task reads one after another) is assigned in descending order, each to the sequence of least
cost that has room for it. A group's sequences hold exactly its tokens, so when nothing has room for a remainder whole, it
is cut, into the sequences with most room left; only a group's last sequence is short, and that one is padded to the next
power of two.

Defined cases: a null text is as an empty one, and has one token, the end id; an added token's string in a text is that
token, as the library has it by default; repeated rows are packed as often as they come; null ids are carried; other columns are ignored; an empty table
gives an empty result. Sequence ids hold the number of the task's partition and a count: the same input files
and splits give the same packing, so a lost task is repeated alike."""

from __future__ import annotations

import heapq
import json
import os
import re
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from linkweave.llm.common import frugal, slices

CAPACITY = 2048
END_ID = 1
GROUP = 4096
QUADRATIC_AT = 2048
#: Texts of each worker, and one of so many of all, that both libraries encode.
CHECKED, CHECKED_SHARE = 20, 128
LONG_RUN = 4096
_RUN = re.compile(r"\s{64,}|\S{64,}")
#: Fixed value: how byte-level BPE of this kind splits a text before its merges.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class Encoder:
    """Token ids of texts, as the tokenizers library gives them for a byte-level BPE file.

    The merges run in tiktoken, which is several times faster, with the ranks of the file and SPLIT, the rule that the file's
    pre_tokenizer stands for. A file with another pre_tokenizer, with a normalizer, or whose ids aren't in the order of its
    merges is refused. The library itself encodes texts that hold an added token, and those with a run of over LONG_RUN
    characters with or without white space, which tiktoken's regular expressions can't take at any length. A share of all texts, chosen by a checksum, and
    the first ones of every worker are encoded by both and compared."""

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        with open(path, encoding="utf-8") as f:
            whole = json.load(f)
        before, model = whole.get("pre_tokenizer") or {}, whole["model"]
        if whole.get("normalizer") or (before.get("type"), before.get("add_prefix_space"), before.get("use_regex", True)) != ("ByteLevel", False, True):
            raise ValueError(f"{path}: its texts are not split as byte-level BPE splits them")
        if model.get("type") != "BPE" or any(model.get(x) for x in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")):
            raise ValueError(f"{path}: not a plain byte-level BPE")
        letters = _byte_letters()
        ranks = {bytes(letters[c] for c in t): k for t, k in model["vocab"].items() if all(c in letters for c in t) and t not in self.added}
        merged = [ranks[bytes(letters[c] for c in "".join(m if isinstance(m, list) else m.split(" ")))] for m in model["merges"]]
        if merged != sorted(merged):
            raise ValueError(f"{path}: ids are not in the order of the merges")
        self.fast = tiktoken.Encoding("file", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})
        self.checked = 0

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(self._one(t), np.uint32) for t in texts]

    def _one(self, text: str) -> list[int]:
        if any(a in text for a in self.added) or (len(text) > LONG_RUN and any(m.end() - m.start() > LONG_RUN for m in _RUN.finditer(text))):
            return self._library(text)
        ids = self.fast.encode_ordinary(text)
        if self.checked < CHECKED or zlib.crc32(text.encode()) % CHECKED_SHARE == 0:
            self.checked += 1
            if self._library(text) != ids:
                raise ValueError("the two libraries differ")
        return ids

    def _library(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids


def _byte_letters() -> dict[str, int]:
    """The letter that byte-level BPE files write for each byte: itself if it is visible Latin-1, else one from U+0100 on."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One for each Python worker."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def cost(n: int) -> float:
    return n + n * n / QUADRATIC_AT


def assign(lengths: list[int], capacity: int = CAPACITY) -> list[list[tuple[int, int, int, int]]]:
    """For each document its pieces (start, length, sequence, offset), for remainders shorter than capacity."""
    total = sum(lengths)
    n = -(-total // capacity)
    room = [capacity] * n
    if n:
        room[-1] = total - capacity * (n - 1)
    pieces: list[list[tuple[int, int, int, int]]] = [[] for _ in lengths]
    size = list(room)
    # the whole group's sequences are asked for each remainder: their number is bounded by the group's
    free, costs = np.array(room, np.int64), np.zeros(n)
    left: list[int] = []
    for d in sorted(range(len(lengths)), key=lambda d: (-lengths[d], d)):
        length = lengths[d]
        if not length:
            continue
        k = int(np.where(free >= length, costs, np.inf).argmin())
        if free[k] < length:
            left.append(d)
            continue
        pieces[d].append((0, length, k, size[k] - int(free[k])))
        free[k] -= length
        costs[k] += cost(length)
    room = free.tolist()
    open_ = [(-r, k) for k, r in enumerate(room) if r]
    heapq.heapify(open_)
    for d in left:
        start = 0
        while start < lengths[d]:
            _, k = heapq.heappop(open_)
            take = min(room[k], lengths[d] - start)
            pieces[d].append((start, take, k, size[k] - room[k]))
            room[k] -= take
            start += take
            if room[k]:
                heapq.heappush(open_, (-room[k], k))
    return pieces


PACKED = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, sequence_tokens int, padded_to int"


def _padded(n: int, capacity: int) -> int:
    return min(capacity, 1 << (n - 1).bit_length())


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, group: int = GROUP, with_ids: bool = False) -> DataFrame:
    """PACKED (and ids, an array of int, if asked for) for each piece of each document."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode = encoder(tokenizer).encode
        following = TaskContext.get().partitionId() << 36
        names = PACKED.replace(" long", "").replace(" int", "").split(", ")
        kinds = [*[pa.int64()] * 7, *[pa.int32()] * 2, *[pa.list_(pa.int32())] * with_ids]
        rows: list[tuple] = []
        waiting: list[tuple[int | None, int, int, np.ndarray]] = []

        def row(doc: int | None, start: int, ids: np.ndarray, tokens: int, sequence: int, offset: int, held: int) -> None:
            crc = zlib.crc32(ids.astype("<u4").tobytes())
            rows.append((doc, start, len(ids), crc, tokens, sequence, offset, held, _padded(held, capacity), *[ids.astype(np.int32)] * with_ids))

        def close() -> None:
            nonlocal following
            pieces = assign([len(w[3]) for w in waiting], capacity)
            held: dict[int, int] = {}
            for p in chain.from_iterable(pieces):
                held[p[2]] = held.get(p[2], 0) + p[1]
            for (doc, start, tokens, ids), own in zip(waiting, pieces, strict=True):
                for a, n, k, at in own:
                    row(doc, start + a, ids[a : a + n], tokens, following + k, at, held[k])
            following += len(held)
            waiting.clear()

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=[*names, *["ids"] * with_ids])
            rows.clear()
            return out

        for batch in slices(batches, "text", 2 << 20):
            for doc, ids in zip(batch.column(0).to_pylist(), encode([x or "" for x in batch.column(1).to_pylist()]), strict=True):
                ids = np.append(ids, np.uint32(END_ID))
                full = len(ids) // capacity * capacity
                for a in range(0, full, capacity):
                    row(doc, a, ids[a : a + capacity], len(ids), following, 0, capacity)
                    following += 1
                if full < len(ids):
                    waiting.append((doc, full, len(ids), ids[full:].astype(np.uint16) if ids.max() < 65536 else ids[full:]))
                    if len(waiting) >= group:
                        close()
            if len(rows) > 5000:
                yield flush()
        close()
        if rows:
            yield flush()

    return docs.select("doc_id", "text").mapInArrow(frugal(of), PACKED + ", ids array<int>" * with_ids)
