"""How many tokens byte-level byte-pair encoding makes of a text, without making them.

A text is split as the tokenizer's file says, each piece starts as one symbol a byte, and the adjacent pair of lowest rank is merged again and
again: a heap holds the pairs, a linked list the symbols that are left. Every merge takes one symbol away, so a piece counts as many tokens
as it has bytes, less its merges; ids are never looked up. Counts of short pieces are remembered, up to REMEMBERED of them, so most of a text costs
one look-up for each piece. A document stays in the task that reads it: nothing is shuffled.

Pieces are found by SPLIT where a text has only characters on whose kind all versions of Unicode agree (not STRANGE), else by the file's own pre-tokenizer,
through its library. No piece has a space after another character, so a text is cut at its spaces first, and counts of words are remembered too; where white
space stands on both sides of a space (SPACED), pieces are looked for in the whole text. Strings of added tokens inside a text are one token each, as the library has it by default. One text in CHECKED_SHARE, by its
checksum, is encoded by the library too, and a difference raises.

Defined cases: a null text is as an empty one and has no token; a row gives a row, so repeated rows and null ids stay; ids are carried; other
columns are ignored; an empty table gives an empty result. A text of any length is counted whole: pieces come one after another, and one of n bytes takes n log n steps."""

from __future__ import annotations

import heapq
import json
import os
import zlib
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkweave.llm.common import frugal, slices

LIMIT, REMEMBERED, SHORT, CHECKED_SHARE = 1024, 1 << 19, 48, 256
#: Texts of more characters are cut into pieces one by one.
LONG = 1 << 20
#: Fixed value: how byte-level BPE of this kind splits a text before its merges.
SPLIT = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
#: A character outside the blocks from Basic Latin to Cyrillic Supplement and outside General Punctuation.
STRANGE = regex.compile(r"[^\x00-ԯ -⁯]")
SPACED = regex.compile(r"\s (?:\s|\Z)")


class Merges:
    """The merges of a byte-level BPE file, by rank."""

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            whole = json.load(f)
        before, model = whole.get("pre_tokenizer") or {}, whole["model"]
        if whole.get("normalizer") or (before.get("type"), before.get("add_prefix_space"), before.get("use_regex", True)) != ("ByteLevel", False, True):
            raise ValueError(f"{path}: its texts are not split as byte-level BPE splits them")
        if model.get("type") != "BPE" or any(model.get(x) for x in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")):
            raise ValueError(f"{path}: not a plain byte-level BPE")
        added = whole.get("added_tokens") or []
        if any(t.get(x) for t in added for x in ("lstrip", "rstrip", "single_word", "normalized")):
            raise ValueError(f"{path}: an added token takes more than its own string")
        shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
        letters = dict(zip(shown, map(chr, shown), strict=True)) | {b: chr(256 + k) for k, b in enumerate(sorted({*range(256)} - {*shown}))}
        if not model["vocab"].keys() >= {*letters.values()}:
            raise ValueError(f"{path}: not every byte is a symbol")
        # symbols are numbered as they come up: bytes by themselves, then what merges make
        number, pairs = {letters[b]: b for b in range(256)}, [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.made = [number.setdefault(a + b, len(number)) for a, b in pairs]
        #: The rank of a pair of symbols.
        self.rank = {number[a] << 32 | number[b]: k for k, (a, b) in enumerate(pairs)}
        self.tokenizer = Tokenizer.from_file(path)
        self.added = regex.compile("|".join(regex.escape(x) for x in sorted((t["content"] for t in added), key=len, reverse=True))) if added else None
        self.pieces = Remembered(self.tokens)
        self.words = Remembered(lambda word: sum(map(self.pieces.__getitem__, SPLIT.findall(" " + word))))

    def tokens(self, piece: str) -> int:
        """Symbols of a piece less its merges, the pair of lowest rank first, of equal ones the leftmost."""
        symbols = list(piece.encode())
        n, rank, made = len(symbols), self.rank.get, self.made
        heap = [r * n + i for i in range(n - 1) if (r := rank(symbols[i] << 32 | symbols[i + 1])) is not None]
        if not heap:
            return n
        heapq.heapify(heap)
        # links of a long piece are kept as plain numbers
        many = list if n < 4096 else lambda numbers: array("q", numbers)
        following, before = many(range(1, n + 1)), many(range(-1, n - 1))
        pop, push, left = heapq.heappop, heapq.heappush, n
        while heap:
            r = pop(heap)
            i = r % n
            r //= n
            j = following[i]
            if j == n or symbols[i] < 0 or rank(symbols[i] << 32 | symbols[j]) != r:  # one of the two was merged meanwhile
                continue
            symbols[i] = grown = made[r]
            symbols[j] = -1
            left -= 1
            following[i] = k = following[j]
            if k < n:
                before[k] = i
                if (r := rank(grown << 32 | symbols[k])) is not None:
                    push(heap, r * n + i)
            if (h := before[i]) >= 0 and (r := rank(symbols[h] << 32 | grown)) is not None:
                push(heap, r * n + h)
        return left

    def count(self, text: str) -> int:
        """Tokens of a text."""
        if self.added and (met := sum(1 for _ in self.added.finditer(text))):
            return met + sum(self._plain(part) for part in self.added.split(text))
        return self._plain(text)

    def _plain(self, text: str) -> int:
        pieces, words = self.pieces, self.words
        if STRANGE.search(text):
            return sum(pieces[text[a:b]] for _, (a, b) in self.tokenizer.pre_tokenizer.pre_tokenize_str(text))
        if len(text) > LONG:
            return sum(pieces[m.group()] for m in SPLIT.finditer(text))
        if SPACED.search(text):
            return sum(map(pieces.__getitem__, SPLIT.findall(text)))
        first, *others = text.split(" ")
        return sum(map(pieces.__getitem__, SPLIT.findall(first))) + sum(map(words.__getitem__, others))

    def checked(self, text: str, data: bytes) -> int:
        n = self.count(text)
        if zlib.crc32(data) % CHECKED_SHARE == 0 and len(self.tokenizer.encode(text, add_special_tokens=False).ids) != n:
            raise ValueError("the library counts another number of tokens")
        return n


class Remembered(dict):
    """Counts of strings; those of short ones are kept, and all are forgotten when there are too many."""

    def __init__(self, count: Callable[[str], int]) -> None:
        super().__init__()
        self.count = count

    def __missing__(self, string: str) -> int:
        n = self.count(string)
        if len(string) <= SHORT:
            if len(self) >= REMEMBERED:
                self.clear()
            self[string] = n
        return n


_MERGES: dict[str, Merges] = {}


def merges(path: str) -> Merges:
    """One for each Python worker."""
    if path not in _MERGES:
        _MERGES[path] = Merges(path)
    return _MERGES[path]


def count_tokens(docs: DataFrame, tokenizer: str, limit: int = LIMIT, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (more than `limit` tokens) for each row. tokenizer: a byte-level BPE file, which executors read."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counting = merges(tokenizer)
        for batch in slices(batches, "text", 2 << 20):
            data = batch.column(1).cast(pa.large_binary()).fill_null(b"")
            n = np.array([counting.checked(x.decode(), x) for x in (y.as_py() for y in data)], np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pc.binary_length(data).cast(pa.int64()), pa.array(n), pa.array(n > limit)], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text"))
    return rows.mapInArrow(frugal(of), "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
