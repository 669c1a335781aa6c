"""Byte texts of Arrow batches as flat numpy arrays: word bounds, word hashes, shingles.

Used inside ``mapInArrow`` tasks. All arrays of a chunk are bounded by ``CHUNK_BYTES`` of text or by
one row, whichever is larger, so a task's memory does not depend on how many rows it reads.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 4 << 20

#: ASCII lower case of every byte; other bytes stay as they are.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: The white space between words: space and the controls 9 to 13.
SPACE = np.zeros(256, dtype=bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True

U = np.uint64
GOLDEN = U(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """SplitMix64 finaliser: a bijection of 64-bit values with good avalanche."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets (``n + 1``, relative to the bytes) of a string column; null is empty."""
    if column.null_count:
        column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(batches, text: str = "text", limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut record batches into runs of rows with at most ``limit`` bytes of text (one row at least)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, off = buffers(batch.column(batch.schema.get_field_index(text)))
        at = 0
        while at < batch.num_rows:
            end = max(at + 1, int(np.searchsorted(off, off[at] + limit, side="right")) - 1)
            yield batch.slice(at, end - at)
            at = end


class Words:
    """Words of a chunk: ``start``/``end`` byte bounds, ``doc`` row of each word, ``first`` (rows + 1)
    offsets of each row's words. A word is a maximal run of bytes for which ``is_gap`` is false."""

    def __init__(self, column: pa.Array, is_gap: np.ndarray = SPACE):
        raw, self.offsets = buffers(column)
        self.buf = LOWER[raw]
        n = len(raw)
        solid = ~is_gap[self.buf]
        edge = np.zeros(n + 1, dtype=bool)
        edge[self.offsets] = True
        before = np.empty(n, dtype=bool)
        if n:
            before[0] = False
            before[1:] = solid[:-1]
        self.start = np.flatnonzero(solid & (~before | edge[:-1]))
        after = np.zeros(n, dtype=bool)
        if n:
            after[:-1] = solid[1:]
        self.end = np.flatnonzero(solid & (~after | edge[1:])) + 1
        self.first = np.searchsorted(self.start, self.offsets)
        self.count = np.diff(self.first)
        self.doc = np.repeat(np.arange(len(self.count)), self.count)

    def hashes(self) -> np.ndarray:
        """64-bit hash of each word's lower-cased bytes, all words one byte further per step."""
        return hash_runs(self.buf, self.start, self.end - self.start)


def hash_runs(buf: np.ndarray, start: np.ndarray, size: np.ndarray, long: int = 64) -> np.ndarray:
    """Hash of the bytes ``buf[start : start + size]``; runs over ``long`` bytes go one by one."""
    import xxhash

    out = np.full(len(start), U(0xCBF29CE484222325))
    live = np.flatnonzero(size <= long)
    order = live[np.argsort(-size[live].astype(np.int16), kind="stable")]
    s, z, h = start[order], size[order], out[order]
    step, n = 0, len(order)
    while n:
        h[:n] = (h[:n] ^ buf[s[:n] + step]) * U(0x100000001B3)
        step += 1
        n = int(np.searchsorted(-z[:n], -step, side="left"))
    out[order] = h
    for i in np.flatnonzero(size > long):
        out[i] = xxhash.xxh64_intdigest(buf[start[i] : start[i] + size[i]].tobytes())
    return mix(out ^ (size.astype(np.uint64) * GOLDEN))


def shingles(words: Words, h: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes of ``size`` consecutive words of each row, sorted, and offsets (rows + 1).
    A row of fewer words, but not none, has one shingle of all its words."""
    rows = len(words.count)
    if not len(h):
        return np.zeros(0, np.uint64), np.zeros(rows + 1, np.int64)
    with np.errstate(over="ignore"):
        pad = np.concatenate([h, np.zeros(size, np.uint64)])
        acc = np.zeros(len(h), np.uint64)
        place = np.arange(len(h)) - words.first[:-1][words.doc]
        left = words.count[words.doc] - place  # words from here to the row's end
        keep = (left >= size) | (place == 0)
        for k in range(size):
            acc = acc * U(0x9FB21C651E98DF25) + np.where(left > k, pad[k : k + len(h)] ^ U(k + 1), U(0))
        acc = mix(acc ^ (np.minimum(left, size).astype(np.uint64) * GOLDEN))
    doc, acc = words.doc[keep], acc[keep]
    ends = np.searchsorted(doc, np.arange(rows + 1))
    for lo, hi in zip(ends[:-1], ends[1:], strict=True):
        acc[lo:hi].sort()
    new = np.ones(len(acc), dtype=bool)
    new[1:] = (acc[1:] != acc[:-1]) | (doc[1:] != doc[:-1])
    doc, acc = doc[new], acc[new]
    return acc, np.searchsorted(doc, np.arange(rows + 1))
