"""Removal of repeated byte strings by a column-wise multi-document suffix construction.

A byte goes if a string of `window` bytes covers it that also starts earlier (smaller document, or same document and earlier
place). Suffixes of all texts are sorted column by column, one symbol of every string a round: the order of round c + 1 becomes
that of round c by a stable sort on the symbols inserted, which are the transform's column c, and the common prefix of two
neighbours is one more than the least one between them before, or none where their symbols differ. Strings whose common
prefix holds a window there form a class; its earliest member stays, all others are marked.

Texts of any length are brought to that form by cutting them into short overlapping strings. Each window of `window` bytes
chooses its least KGRAM-byte hash; equal windows choose at the same place, so strings are aligned at the chosen place, the
anchor, and equal windows stand in the same column. Hence windows need to meet only with those of the same anchor hash, which deals the work
out over tasks, and rounds number 2 * window - KGRAM at most however long the texts are. Anchors that occur once are left out.

The steps, each a shuffle of packed columns rather than of rows: (1) anchors of all texts by hash; (2) texts, which give the strings
of repeated anchors; equal strings of a batch are sent once and all but the first are marked at once; (3) strings by hash, which
are sorted column-wise; a task keeps them in an external file by columns, written once and read from the last column to the first;
(4) texts again, with the ranges to remove.

Defined cases: a null text is as an empty one; texts shorter than a window keep all bytes; a null doc_id comes before all others; rows that
repeat an id and a text are one document and get one result each; documents that share an id alone are ordered by a hash of the text;
other columns are ignored; an empty table gives an empty result. Nothing is cut short or capped."""

from __future__ import annotations

import hashlib
import os
import pickle
import shutil
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkweave.llm.common import frugal, packed_ranges, partitions, scratch, slices, utf8, whole_groups

WINDOW, KGRAM = 100, 32
NULL_ID = np.iinfo(np.int64).min
PLACE_BITS = 24
FLUSH = 1 << 20
BLOB = "part int, kind int, blob binary"


def _dump(**columns: np.ndarray | list) -> bytes:
    return zstandard.compress(pickle.dumps(columns, protocol=5), 1)


def _load(blob: bytes) -> dict:
    return pickle.loads(zstandard.decompress(blob))


def _rows(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    part, kind, blob = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(kind, pa.int32()), pa.array(blob, pa.binary())], names=["part", "kind", "blob"])


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


_BYTE = _mixed(np.arange(1, 257, dtype=np.uint64))


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """A hash of the KGRAM bytes from each place on, by doubling."""
    h, n = _BYTE[data], 1
    while n < KGRAM:
        h = h[:-n] * np.uint64(0x2545F4914F6CDD1D + 2 * n) + h[n:]
        n *= 2
    return _mixed(h)


def anchors(data: np.ndarray, offsets: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, ...]:
    """(hash, document, place, first, last) of the strings of the texts that lie one after another in data: places are in data,
    and the windows that start from first to last have the anchor at place."""
    empty = np.zeros(0, np.int64)
    starts = np.diff(offsets) - window + 1
    if len(data) < window or starts.max(initial=0) <= 0:
        return empty.astype(np.uint64), empty, empty, empty, empty
    h = gram_hashes(data)
    wide = window - KGRAM + 1
    low = np.uint64((1 << PLACE_BITS) - 1)
    least, n = (h & ~low) | np.arange(len(h), dtype=np.uint64), 1
    while 2 * n <= wide:
        least = np.minimum(least[:-n], least[n:])
        n *= 2
    if n < wide:
        least = np.minimum(least[: -(wide - n)], least[wide - n :])
    place = (least & low).astype(np.int64)
    document = np.repeat(np.arange(len(starts)), np.maximum(starts, 0))
    begin = np.repeat(offsets[:-1], np.maximum(starts, 0))
    within = np.arange(len(document)) - np.repeat(np.cumsum(np.maximum(starts, 0)) - np.maximum(starts, 0), np.maximum(starts, 0))
    at = begin + within
    place = place[at]
    new = np.concatenate([[True], (place[1:] != place[:-1]) | (document[1:] != document[:-1])])
    first = np.flatnonzero(new)
    last = np.concatenate([first[1:] - 1, [len(at) - 1]])
    return h[place[first]], document[first], place[first], at[first], at[last]


def sorted_columns(strings: list[bytes], lead: np.ndarray, last: np.ndarray, priority: np.ndarray, folder: str, window: int = WINDOW) -> np.ndarray:
    """Marks (strings, columns) of the windows that also start in a string of smaller priority, in the same column.

    lead: bytes before the anchor; last: bytes from the last window's start to the anchor. The anchor is in column `before` of all."""
    before, m = window - KGRAM, len(strings)
    width = before + window
    lengths = np.fromiter(map(len, strings), np.int64, m)
    table = np.zeros((m, width), np.uint8)
    row = np.repeat(np.arange(m), lengths)
    column = np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths) + np.repeat(before - lead, lengths)
    table[row, column] = np.frombuffer(b"".join(strings), np.uint8)
    path = os.path.join(folder, "columns")
    with open(path, "wb") as f:
        for c in reversed(range(width)):
            f.write(np.ascontiguousarray(table[:, c]).tobytes())
    del table, row, column
    marks = np.zeros((m, before + 1), bool)
    order, common = np.arange(m), np.zeros(m, np.uint8)
    first, final = before - lead, before - last
    with open(path, "rb") as f:
        for c in reversed(range(width)):
            symbols = np.frombuffer(f.read(m), np.uint8)[order]
            moved = np.argsort(symbols, kind="stable")
            common = _prefixes(symbols[moved], moved, common, window)
            order = order[moved]
            if c > before:
                continue
            holds = (first[order] <= c) & (c <= final[order])
            heads = np.flatnonzero(common < window)
            if len(heads) == m:
                continue
            rank = np.where(holds, priority[order], np.iinfo(np.int64).max)
            earliest = np.repeat(np.minimum.reduceat(rank, heads), np.diff(np.concatenate([heads, [m]])))
            marks[order[holds & (rank > earliest)], c] = True
    os.remove(path)
    return marks


def _prefixes(symbols: np.ndarray, moved: np.ndarray, common: np.ndarray, window: int) -> np.ndarray:
    """Common prefixes of neighbours in the new order (of each with the one before), from those in the old order; up to `window`."""
    out = np.zeros(len(moved), np.uint8)
    same = np.flatnonzero(symbols[1:] == symbols[:-1]) + 1
    if not len(same):
        return out
    lo, hi = moved[same - 1] + 1, moved[same]  # least of common[lo .. hi]
    span = hi - lo + 1
    level = np.frexp(span.astype(np.float64))[1] - 1
    least, table = np.empty(len(same), np.uint8), common
    for k in range(int(level.max()) + 1):
        if k:
            half = 1 << (k - 1)
            table = np.minimum(table[:-half], table[half:])
        at = np.flatnonzero(level == k)
        if len(at):
            least[at] = np.minimum(table[lo[at]], table[hi[at] - (1 << k) + 1])
    out[same] = np.minimum(least.astype(np.int32) + 1, window)
    return out


def _anchored(n_parts: int):
    """(1) Places of anchors by hash; those that repeat inside one flush go straight on, with a mere sign that their hash repeats."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        size = 0

        def flush() -> pa.RecordBatch:
            h, key, place, lead, last = (np.concatenate(c) for c in zip(*held, strict=True))
            held.clear()
            _, which, times = np.unique(h, return_inverse=True, return_counts=True)
            known = times[which] > 1
            rows = _positions(h[known], key[known], place[known], lead[known], last[known], n_parts, 1)
            signs = np.unique(h[known])
            part, sign_part = (h % np.uint64(n_parts)).astype(np.int64), (signs % np.uint64(n_parts)).astype(np.int64)
            once = np.flatnonzero(~known)
            once = once[np.argsort(part[once], kind="stable")]
            signs, sign_part = signs[o := np.argsort(sign_part, kind="stable")], sign_part[o]
            edge, sign_edge = np.searchsorted(part[once], np.arange(n_parts + 1)), np.searchsorted(sign_part, np.arange(n_parts + 1))
            for p in range(n_parts):
                k = once[edge[p] : edge[p + 1]]
                s = signs[sign_edge[p] : sign_edge[p + 1]]
                if len(k) or len(s):
                    rows.append((p, 0, _dump(h=h[k], key=key[k], place=place[k], lead=lead[k], last=last[k], signs=s)))
            return _rows(rows)

        for batch in slices(batches, "text", 1 << 20):
            key = batch.column(1).to_numpy(zero_copy_only=False)
            for data, offsets, base, document in _texts(batch.column(2)):
                h, d, place, first, final = anchors(data, offsets)
                if len(h):
                    held.append((h, key[document[d]], (place - offsets[d] + base[d]).astype(np.uint32), (place - first).astype(np.uint8), (place - final).astype(np.uint8)))
                    size += len(h)
            if size > FLUSH:
                if held:
                    yield flush()
                size = 0
        if held:
            yield flush()

    return of


def _texts(column: pa.Array, most: int = 1 << 23) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(data, offsets, where each begins in its text, its row): texts of over `most` bytes come in parts, in which each window lies whole once."""
    data, offsets = utf8(column)
    long = np.flatnonzero(np.diff(offsets) > most)
    if not len(long):
        yield data, offsets, np.zeros(len(offsets) - 1, np.int64), np.arange(len(offsets) - 1)
        return
    for k in range(len(offsets) - 1):
        text = data[offsets[k] : offsets[k + 1]]
        for at in range(0, max(1, len(text) - WINDOW + 1), most):
            part = text[at : at + most + WINDOW - 1]
            yield part, np.array([0, len(part)]), np.array([at]), np.array([k])


def _positions(h, key, place, lead, last, n_parts: int, kind: int) -> list[tuple[int, int, bytes]]:
    """Blobs of places, by the part that has their text."""
    part = (key.view(np.uint64) % np.uint64(n_parts)).astype(np.int64)
    order = np.argsort(part, kind="stable")
    edge = np.searchsorted(part[order], np.arange(n_parts + 1))
    return [(int(p), kind, _dump(key=key[k], h=h[k], place=place[k], lead=lead[k], last=last[k])) for p in np.flatnonzero(np.diff(edge)) for k in [order[edge[p] : edge[p + 1]]]]


def _repeated(n_parts: int):
    """(1, after the shuffle) Places whose hash occurs twice or more."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for parts, kinds, blobs in whole_groups(batches, 0):
            rows = [(int(p), 1, b) for p, k, b in zip(parts, kinds, blobs, strict=True) if k == 1]
            for p in np.unique(parts):
                found = [_load(b) for b, q, k in zip(blobs, parts, kinds, strict=True) if q == p and k == 0]
                if not found:
                    continue
                h, key, place, lead, last, signs = (np.concatenate([x[c] for x in found]) for c in ("h", "key", "place", "lead", "last", "signs"))
                order = np.lexsort((place, key, h))
                h, key, place, lead, last = (x[order] for x in (h, key, place, lead, last))
                if not len(h):
                    continue
                fresh = np.concatenate([[True], (h[1:] != h[:-1]) | (key[1:] != key[:-1]) | (place[1:] != place[:-1])])
                h, key, place, lead, last = (x[fresh] for x in (h, key, place, lead, last))
                again = h[1:] == h[:-1]
                stays = np.concatenate([[False], again]) | np.concatenate([again, [False]]) | np.isin(h, signs)
                rows += _positions(h[stays], key[stays], place[stays], lead[stays], last[stays], n_parts, 1)
            if rows:
                yield _rows(rows)

    return of


def _documents(n_parts: int):
    """Texts in compressed blobs, by part."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 8 << 20):
            ids = batch.column(0).fill_null(int(NULL_ID)).to_numpy(zero_copy_only=False)
            null = pc.is_null(batch.column(0)).to_numpy(zero_copy_only=False)
            key = batch.column(1).to_numpy(zero_copy_only=False)
            data, offsets = utf8(batch.column(2))
            part = (key.view(np.uint64) % np.uint64(n_parts)).astype(np.int64)
            rows = []
            for p in np.unique(part):
                k = np.flatnonzero(part == p)
                rows.append((int(p), 2, _dump(ids=ids[k], null=null[k], key=key[k], texts=[data[offsets[i] : offsets[i + 1]].tobytes() for i in k])))
            if rows:
                yield _rows(rows)

    return of


def _slices_by_key(sorted_keys: np.ndarray, key: int) -> slice:
    return slice(int(np.searchsorted(sorted_keys, key)), int(np.searchsorted(sorted_keys, key, side="right")))


def _cut(n_parts: int, window: int = WINDOW):
    """(2) The strings of repeated anchors; of equal ones in a flush the first alone, the others' bytes are marked for removal."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        strings: dict[bytes, tuple] = {}
        gone: list[tuple] = []
        size = 0

        def flush() -> pa.RecordBatch:
            rows = []
            if strings:
                text = list(strings)
                ids, key, place, lead, last, h = (np.array(c, kind) for c, kind in zip(zip(*strings.values(), strict=True), [*[np.int64] * 5, np.uint64], strict=True))
                part = (h % np.uint64(n_parts)).astype(np.int64)
                for p in np.unique(part):
                    k = np.flatnonzero(part == p)
                    rows.append((int(p), 0, _dump(text=[text[i] for i in k], ids=ids[k], key=key[k], place=place[k], lead=lead[k], last=last[k])))
            if gone:
                rows += _ranges(*(np.array(c, np.int64) for c in zip(*gone, strict=True)), n_parts)
            strings.clear()
            gone.clear()
            return _rows(rows)

        for places, docs in _by_part(batches):
            keys = places["key"]
            for blob in docs:
                x = _load(blob)
                for doc, key, text in zip(x["ids"].tolist(), x["key"].tolist(), x["texts"], strict=True):
                    own = _slices_by_key(keys, key)
                    for h, place, lead, last in zip(*(places[c][own].tolist() for c in ("h", "place", "lead", "last")), strict=True):
                        string = text[place - lead : place - last + window]
                        if len(string) != lead - last + window:
                            continue  # of a text whose hash is the same by chance
                        size += len(string)
                        mine = (doc, key, place, lead, last, h)
                        was = strings.setdefault(string, mine)
                        if was[:3] == mine[:3]:
                            continue
                        later = mine
                        if mine < was:
                            strings[string], later = mine, was
                        gone.append((later[0], later[1], later[2] - later[3], later[2] - later[4] + window))
                if size > 64 << 20:
                    yield flush()
                    size = 0
        if strings or gone:
            yield flush()

    return of


def _ranges(ids: np.ndarray, key: np.ndarray, start: np.ndarray, end: np.ndarray, n_parts: int) -> list[tuple[int, int, bytes]]:
    part = (key.view(np.uint64) % np.uint64(n_parts)).astype(np.int64)
    order = np.lexsort((start, key, part))
    edge = np.searchsorted(part[order], np.arange(n_parts + 1))
    return [(int(p), 1, _dump(ids=ids[k], key=key[k], start=start[k], end=end[k])) for p in np.flatnonzero(np.diff(edge)) for k in [order[edge[p] : edge[p + 1]]]]


def _by_part(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict[str, np.ndarray], Iterator[bytes]]]:
    """For each part its arrays (kind 1), sorted by key, and its blobs of texts (kind 2), which follow one by one."""
    rows = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns), strict=True))
    row = next(rows, None)
    while row is not None:
        part, found = row[0], []
        while row is not None and row[0] == part and row[1] == 1:
            found.append(_load(row[2]))
            row = next(rows, None)
        arrays = {c: np.concatenate([x[c] for x in found]) for c in found[0]} if found else {c: np.zeros(0, np.int64) for c in ("key", "ids", "start", "end", "h", "place", "lead", "last")}
        order = np.argsort(arrays["key"], kind="stable")
        arrays = {c: x[order] for c, x in arrays.items()}

        def texts() -> Iterator[bytes]:
            nonlocal row
            while row is not None and row[0] == part:
                yield row[2]
                row = next(rows, None)

        yield arrays, (mine := texts())
        for _ in mine:
            pass


def _sorted(n_parts: int, window: int = WINDOW):
    """(3) Column-wise order of all strings of a part; what it marks becomes ranges of bytes."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for parts, kinds, blobs in whole_groups(batches, 0):
            rows = [(int(p), 1, b) for p, k, b in zip(parts, kinds, blobs, strict=True) if k == 1]
            for p in np.unique(parts):
                strings: dict[bytes, tuple] = {}
                gone: list[tuple] = []
                for x in (_load(b) for b, q, k in zip(blobs, parts, kinds, strict=True) if q == p and k == 0):
                    for string, *mine in zip(x["text"], *(x[c].tolist() for c in ("ids", "key", "place", "lead", "last")), strict=True):
                        was, later = strings.setdefault(string, mine), mine
                        if was[:3] == mine[:3]:
                            continue
                        if mine < was:
                            strings[string], later = mine, was
                        gone.append((later[0], later[1], later[2] - later[3], later[2] - later[4] + window))
                if not strings:
                    continue
                ids, key, place, lead, last = (np.array(c, np.int64) for c in zip(*strings.values(), strict=True))
                priority = np.empty(len(ids), np.int64)
                priority[np.lexsort((place, key, ids))] = np.arange(len(ids))
                folder = scratch()
                try:
                    marks = sorted_columns(list(strings), lead, last, priority, folder, window)
                finally:
                    shutil.rmtree(folder)
                edge = np.diff(np.pad(marks.astype(np.int8), ((0, 0), (1, 1))), axis=1)
                row, first = np.nonzero(edge == 1)
                final = np.nonzero(edge == -1)[1]
                base = place[row] - (window - KGRAM)
                more = [np.array(c, np.int64) for c in zip(*gone, strict=True)] if gone else [np.zeros(0, np.int64)] * 4
                out = [np.concatenate(c) for c in zip(more, (ids[row], key[row], base + first, base + final - 1 + window), strict=True)]
                if len(out[0]):
                    rows += _ranges(*out, n_parts)
            if rows:
                yield _rows(rows)

    return of


REMOVED = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def _removed(with_text: bool):
    """(4) What is left of each text."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ranges, docs in _by_part(batches):
            keys = ranges["key"]
            for blob in docs:
                x, rows = _load(blob), []
                for doc, null, key, text in zip(x["ids"].tolist(), x["null"].tolist(), x["key"].tolist(), x["texts"], strict=True):
                    own = _slices_by_key(keys, key)
                    mine = ranges["ids"][own] == doc
                    starts, ends = packed_ranges(ranges["start"][own][mine], ranges["end"][own][mine])
                    cuts = [0, *np.stack([starts, ends], 1).ravel().tolist(), len(text)]
                    kept = b"".join(text[a:b] for a, b in zip(cuts[::2], cuts[1::2], strict=True))
                    rows.append((None if null else doc, len(text), len(text) - len(kept), len(starts), hashlib.sha256(kept).hexdigest(), *[kept] * with_text))
                kinds = [*[pa.int64()] * 4, pa.string(), *[pa.binary()] * with_text]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", *["kept"] * with_text])

    return of


def remove_repeats(docs: DataFrame, with_text: bool = False) -> DataFrame:
    """REMOVED (and kept, the bytes left, if asked for) for each row of docs."""
    n = partitions(docs.sparkSession)
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("doc_id", "text").alias("key"), F.coalesce("text", F.lit("")).alias("text"))

    def dealt(blobs: DataFrame) -> DataFrame:
        # each part is a partition; hashing the few numbers would put several into one
        return blobs.repartitionById(n, "part").sortWithinPartitions("part", "kind")

    texts = keyed.mapInArrow(frugal(_documents(n)), BLOB)
    places = dealt(keyed.mapInArrow(frugal(_anchored(n)), BLOB)).mapInArrow(frugal(_repeated(n)), BLOB)
    strings = dealt(places.union(texts)).mapInArrow(frugal(_cut(n)), BLOB)
    ranges = dealt(strings).mapInArrow(frugal(_sorted(n)), BLOB)
    return dealt(ranges.union(texts)).mapInArrow(frugal(_removed(with_text)), REMOVED + ", kept binary" * with_text)


#: The same by SQL, for documents: all windows (small tables only).
ORACLE = r"""
WITH docs AS (SELECT DISTINCT doc_id, encode(coalesce(text, '')) AS b FROM documents),
windows AS (SELECT doc_id, i, array_slice(b, i + 1, i + 100) AS w FROM (SELECT doc_id, b, unnest(range(octet_length(b) - 99)) AS i FROM docs WHERE octet_length(b) >= 100)),
later AS (SELECT doc_id, i FROM windows QUALIFY row_number() OVER (PARTITION BY w ORDER BY doc_id NULLS FIRST, i) > 1),
begun AS (SELECT doc_id, i, i > coalesce(lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 100, -1) AS fresh FROM later),
spans AS (SELECT doc_id, min(i) AS lo, max(i) + 100 AS hi FROM (SELECT doc_id, i, sum(fresh::INT) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM begun) GROUP BY doc_id, k),
gaps AS (SELECT doc_id, hi AS a, lead(lo) OVER (PARTITION BY doc_id ORDER BY lo) AS z FROM spans UNION ALL SELECT doc_id, 0, min(lo) FROM spans GROUP BY doc_id),
kept AS (SELECT g.doc_id, string_agg(hex(array_slice(b, a + 1, coalesce(z, octet_length(b)))), '' ORDER BY a) AS h FROM gaps g JOIN docs USING (doc_id) GROUP BY g.doc_id),
sums AS (SELECT doc_id, sum(hi - lo)::BIGINT AS n_removed, count(*) AS n_spans FROM spans GROUP BY doc_id)
SELECT d.doc_id, octet_length(encode(coalesce(d.text, '')))::BIGINT AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
  CASE WHEN h IS NULL THEN sha256(coalesce(d.text, '')) ELSE sha256(unhex(h)) END AS kept_sha256
FROM documents d LEFT JOIN kept USING (doc_id) LEFT JOIN sums USING (doc_id)
"""
