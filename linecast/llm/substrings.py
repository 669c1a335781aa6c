"""Exact removal of repeated byte strings across documents, by suffix arrays.

Method. A byte goes if it is covered by a ``span``-byte string that also starts in a document with a
smaller id. Equal strings must meet, and nothing else needs to: each string's key is the smallest hash
of the ``GRAM``-byte grams in it, which depends on its bytes alone. Consecutive strings of a text with
the same key form one piece (about 19 strings in 67 bytes). First only keys are shuffled, to learn
which occur in documents of different ids. Then the pieces of those keys are shuffled by key; those
whose strings may repeat are joined to one text per key, its suffix array is built by linear Lyndon
grouping (``linecast.llm.suffixes``), and neighbours in the array that share ``span`` bytes form the
intervals of equal strings, whose smallest document keeps its bytes.

Scale. Within a chunk of texts a key, and equal pieces of several documents, are sent once, for the
smallest id, and the others are settled on the spot; so thousands of copies, or a passage in a third of
all documents, reach a task once per chunk. Documents are dealt to homes by hash; keys that are shared
and ranges that are covered come home in packed rows, and the shuffle of the texts by home is the same
exchange both times. A task holds one bucket of keys or one home; their number follows
``spark.sql.shuffle.partitions``. A key with more than ``LONG_GROUP`` bytes of different pieces is cut
into its single strings, which are compared directly, group by group.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linecast.llm.classlm import _pack, _unpack
from linecast.llm.scratch import table
from linecast.llm.suffixes import ragged, suffix_arrays
from linecast.llm.words import GOLDEN, U, buffers, chunks, mix

GRAM = 16
#: Bytes of text worked on at once.
CHUNK = 2 << 20
MOST = 64  # strings in a piece
LONG_GROUP = 512
BATCH = 1 << 19  # bytes of text whose suffix arrays are built together
NO_ID = np.iinfo(np.int64).max
#: Homes, and buckets of keys, for each shuffle partition.
HOMES = 1
#: Keys name their document by id and this much of its tag; what else that fits only adds candidates.
SHORT = 0xFF


def _grams(buf: np.ndarray) -> np.ndarray:
    """A hash of the ``GRAM`` (16) bytes from each place on; the text is followed by zeros."""
    raw = np.concatenate([buf, np.zeros(24, np.uint8)])
    w = np.ndarray((len(buf) + 8,), "<u8", raw.tobytes(), 0, (1,)).astype(np.uint64)
    with np.errstate(over="ignore"):
        x = w[: len(buf)] * U(0x9FB21C651E98DF25)
        x ^= x >> U(29)
        x += w[8:]
        del w
        x *= U(0xBF58476D1CE4E5B9)
        x ^= x >> U(32)
    return x


def _prints(g: np.ndarray, at: np.ndarray, span: int) -> np.ndarray:
    """A 64-bit fingerprint of the ``span`` bytes from each place ``at`` on, made of its grams."""
    x = np.zeros(len(at), np.uint64)
    with np.errstate(over="ignore"):
        for k in [*range(0, span - GRAM, GRAM), span - GRAM]:
            x = x * U(0x9FB21C651E98DF25) + g[at + k]
            x ^= x >> U(31)
        return x * GOLDEN


def _eights(buf: np.ndarray) -> np.ndarray:
    """The 8 bytes from each place on as one number; the text is followed by zeros."""
    raw = np.concatenate([buf, np.zeros(8, np.uint8)])
    return np.ndarray((len(buf) + 1,), "<u8", raw.tobytes(), 0, (1,)).astype(np.uint64)


def _same(eights: np.ndarray, p: np.ndarray, q: np.ndarray, span: int) -> np.ndarray:
    """Whether the ``span`` bytes from ``p`` and from ``q`` on are equal."""
    same = np.ones(len(p), bool)
    for k in [*range(0, span - 8, 8), span - 8]:
        same &= eights[p + k] == eights[q + k]
    return same


def _least(g: np.ndarray, width: int) -> np.ndarray:
    """Minimum of ``width`` consecutive values, from each place on."""
    have, x = 1, g
    while have < width:
        step = min(have, width - have)
        x = np.minimum(x[: len(x) - step], x[step:])
        have += step
    return x


def pieces(buf: np.ndarray, off: np.ndarray, span: int):
    """Pieces of a chunk: key, document, first string's place and number of strings; and the grams."""
    width = span - GRAM + 1
    n = len(buf)
    g = _grams(buf)
    if n < span:
        none = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), none, none, none, g
    least = _least(g[: n - GRAM + 1], width)  # for each place where a string may start
    ok = np.ones(len(least), bool)
    for end in off[1:-1]:  # strings may not cross into the next document
        ok[max(0, end - span + 1) : end] = False
    same = np.zeros(len(least), bool)
    same[1:] = (least[1:] == least[:-1]) & ok[1:] & ok[:-1]
    first = np.flatnonzero(ok & ~same)
    last = np.flatnonzero(ok & ~np.append(same[1:], False)) + 1
    size = last - first
    if (size > MOST).any():
        parts = -(-size // MOST)
        which = np.repeat(np.arange(len(first)), parts)
        k = ragged(np.zeros(len(parts), np.int64), parts)
        first, size = first[which] + k * MOST, np.minimum(size[which] - k * MOST, MOST)
    doc = np.searchsorted(off, first, side="right") - 1
    return mix(least[first]), doc, first, size, g  # smallest hashes are small: mixed, they spread over the ranges


def _ranges(h: np.ndarray, parts: int) -> np.ndarray:
    return ((h >> U(32)) * U(parts) >> U(32)).astype(np.int32)


def _ids(column: pa.Array) -> np.ndarray:
    return column.fill_null(NO_ID).to_numpy(zero_copy_only=False).astype(np.int64)


def _runs(*cols: np.ndarray) -> np.ndarray:
    """Starts of runs of equal rows."""
    new = np.ones(len(cols[0]), bool)
    if len(new):
        new[1:] = False
        for x in cols:
            new[1:] |= x[1:] != x[:-1]
    return np.flatnonzero(new)


def _slices(starts: np.ndarray, n: int) -> list[slice]:
    return [slice(a, b) for a, b in zip(starts, [*starts[1:], n][: len(starts)], strict=True)]


def _sent(buckets, homes, blobs) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(buckets, pa.int32()), pa.array(homes, pa.int32()), pa.array(blobs, pa.binary())], names=["bucket", "home", "blob"])


def _home_rows(ids, tags, homes, *cols) -> tuple[list, list]:
    """Rows of documents packed by home."""
    order = np.lexsort((*cols[::-1], tags, ids, homes))
    ids, tags, homes, cols = ids[order], tags[order], homes[order], [c[order] for c in cols]
    cut = _slices(_runs(homes), len(homes))
    return [int(homes[c.start]) for c in cut], [_pack(ids[c].view(np.uint64), tags[c], *(x[c] for x in cols)) for c in cut]


def _offer(span: int, parts: int):
    """Keys of a chunk by hash range (bucket); keys that the chunk itself shows to be shared go home."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "__text", CHUNK):
            buf, off = buffers(batch.column("__text"))
            key, doc, _, _, _ = pieces(buf, off, span)
            if not len(key):
                continue
            ids, tags, homes = _ids(batch.column("id")), (_tags(batch.column("tag")) & U(SHORT)).astype(np.int64), batch.column("home").to_numpy().astype(np.int64)
            order = np.lexsort((ids[doc], key))
            key, doc = key[order], doc[order]
            at = _runs(key, doc)
            key, doc = key[at], doc[at]
            first = _runs(key)
            n = np.diff(np.append(first, len(key)))
            many = ids[doc[first]] != ids[doc[first + n - 1]]  # sorted: the first id is the smallest
            mine = np.repeat(many, n)
            buckets, to, blobs = [], [], []
            if mine.any():
                d = doc[mine]
                to, blobs = _home_rows(ids[d], tags[d], homes[d], key[mine])
                buckets = [-1] * len(to)
            # one row per key and document of the smallest id, which may stand in several rows
            lead = ~mine
            lead[first[many]] = True
            key, doc, settled = key[lead], doc[lead], mine[lead]
            where = _ranges(key, parts)
            for s in _slices(_runs(where), len(where)):
                docs, local = np.unique(doc[s], return_inverse=True)
                buckets.append(int(where[s.start]))
                to.append(-1)
                base = key[s.start]
                blobs.append(_pack(ids[docs].view(np.uint64), tags[docs], homes[docs], local, settled[s].astype(np.int64), np.array([base], np.uint64), np.diff(key[s], prepend=base)))
            yield _sent(buckets, to, blobs)

    return run


def _tags(column: pa.Array) -> np.ndarray:
    return column.to_numpy().view(np.uint64)


def _by_bucket(work):
    """Stream over rows sorted by bucket; ``work`` gets a bucket's blobs, others pass through."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        now, held = None, []

        def close():
            homes, blobs = work(held) if held else ([], [])
            return _sent([-1] * len(homes), homes, blobs)

        for batch in batches:
            homes, blobs = [], []
            for b, home, blob in zip(batch.column("bucket").to_pylist(), batch.column("home").to_pylist(), batch.column("blob"), strict=True):
                if b != now:
                    yield close()
                    now, held = b, []
                if b < 0:
                    homes.append(home)
                    blobs.append(blob.as_py())
                else:
                    held.append(blob.as_py())
            yield _sent([-1] * len(homes), homes, blobs)
        yield close()

    return run


def _shared_keys(blobs: list[bytes]) -> tuple[list, list]:
    """Keys that occur under different ids, for the documents that do not know it yet."""
    ids, tags, homes, doc, settled, key, at = [], [], [], [], [], [], 0
    for blob in blobs:
        i, t, h, local, known, base, step = _unpack(blob)
        ids.append(i.view(np.int64))
        tags.append(t.astype(np.int64))
        homes.append(h.astype(np.int64))
        doc.append(local.astype(np.int64) + at)
        settled.append(known.astype(bool))
        with np.errstate(over="ignore"):
            key.append(base[0] + np.cumsum(step, dtype=np.uint64))
        at += len(i)
    ids, tags, homes, doc, settled, key = (np.concatenate(x) for x in (ids, tags, homes, doc, settled, key))
    order = np.lexsort((ids[doc], key))
    doc, settled, key = doc[order], settled[order], key[order]
    first = _runs(key)
    n = np.diff(np.append(first, len(key)))
    tell = np.repeat(ids[doc[first]] != ids[doc[first + n - 1]], n) & ~settled
    d = doc[tell]
    return _home_rows(ids[d], tags[d], homes[d], key[tell])


def _rows_of(texts: pa.Table, told: pa.Table, mask: int = -1):
    """The home's documents and, with them, what was sent home: the documents' rows for each entry,
    named by id and by the tag under ``mask``. Of rows with equal id and tag the first stands for all."""
    row: dict[tuple[int, int], int] = {}
    rows: dict[tuple[int, int], list[int]] = {}
    ids, tags = _ids(texts.column("id").combine_chunks()), _tags(texts.column("tag").combine_chunks())
    for k, (i, t) in enumerate(zip(ids.tolist(), tags.tolist(), strict=True)):
        if row.setdefault((i, t), k) == k:
            rows.setdefault((i, t & mask), []).append(k)
    parts = [_unpack(b.as_py()) for b in told.column("blob")]
    named = [rows[pair] for p in parts for pair in zip(p[0].view(np.int64).tolist(), p[1].tolist(), strict=True)]
    times = np.array([len(x) for x in named], np.int64)
    cols = [np.repeat(np.concatenate([p[k] for p in parts]), times) if parts else np.zeros(0, np.int64) for k in range(2, len(parts[0]) if parts else 4)]
    return ids, tags, row, np.array([k for x in named for k in x], np.int64), cols


def _spread(span: int, parts: int):
    """A home's pieces of shared keys by hash range; what the home itself shows to be covered goes home."""

    def run(texts: pa.Table, told: pa.Table) -> pa.Table:
        if not told.num_rows or not texts.num_rows:
            return pa.Table.from_batches([_sent([], [], [])])
        ids, tags, _, who, cols = _rows_of(texts, told, SHORT)
        homes = texts.column("home").combine_chunks().to_numpy().astype(np.int64)
        with np.errstate(over="ignore"):
            wanted = np.sort(cols[0].astype(np.uint64) ^ mix(who.astype(np.uint64) * GOLDEN))
        have = np.unique(who)
        out = []
        for batch in chunks(texts.select(["__text"]).take(pa.array(have)).combine_chunks().to_batches(), "__text", CHUNK):
            mine = have[: batch.num_rows]
            have = have[batch.num_rows :]
            buf, off = buffers(batch.column("__text"))
            key, doc, first, size, g = pieces(buf, off, span)
            with np.errstate(over="ignore"):
                mark = key ^ mix(mine[doc].astype(np.uint64) * GOLDEN)
            at = np.minimum(np.searchsorted(wanted, mark), len(wanted) - 1)
            hit = wanted[at] == mark
            key, doc, first, size = key[hit], doc[hit], first[hit], size[hit]
            if len(key):
                out.append(_pieces_by_range(buf, off, g, key, doc, first, size, ids[mine], tags[mine], homes[mine], span, parts))
        return pa.Table.from_batches(out, schema=_sent([], [], []).schema)

    return run


def _pieces_by_range(buf, off, g, key, doc, first, size, ids, tags, homes, span, parts) -> pa.RecordBatch:
    own = ids[doc]
    a, b, c = (_prints(g, first + k, span) for k in (0, size - 1, size // 2))
    with np.errstate(over="ignore"):
        whole = mix(key ^ (a * U(3) + b * U(5) + c * U(7) + size.astype(np.uint64)))
    order = np.lexsort((own, whole, key))
    key, doc, first, size, own, whole, a, b = (x[order] for x in (key, doc, first, size, own, whole, a, b))
    at = _runs(key, whole, size, a, b)
    least = np.repeat(own[at], np.diff(np.append(at, len(own))))
    seen = own > least
    buckets, to, blobs = [], [], []
    if seen.any():
        d = doc[seen]
        to, blobs = _covered(ids[d], tags[d], homes[d], first[seen] - off[d], size[seen] + span - 1)
        buckets = [-1] * len(to)
    key, doc, first, size = (x[~seen] for x in (key, doc, first, size))
    where = _ranges(key, parts)
    for s in _slices(_runs(where), len(where)):
        docs, local = np.unique(doc[s], return_inverse=True)
        length = size[s] + span - 1
        base = key[s.start]
        buckets.append(int(where[s.start]))
        to.append(-1)
        blobs.append(_pack(ids[docs].view(np.uint64), tags[docs], homes[docs], local, first[s] - off[doc[s]], size[s], np.array([base], np.uint64), np.diff(key[s], prepend=base), buf[ragged(first[s], length)]))
    return _sent(buckets, to, blobs)


def _covered(ids, tags, homes, start, length) -> tuple[list, list]:
    """Covered ranges by home, those of a document that touch or overlap as one."""
    order = np.lexsort((start, tags, ids))
    ids, tags, homes, start, end = ids[order], tags[order], homes[order], start[order], (start + length)[order]
    row = np.repeat(np.arange(len(at := _runs(ids, tags))), np.diff(np.append(at, len(ids))))
    far = int(end.max()) + 1
    reach = np.maximum.accumulate(end + row * far) - row * far
    new = np.append(True, (row[1:] != row[:-1]) | (start[1:] > reach[:-1]))
    at = np.flatnonzero(new)
    last = np.append(at[1:], len(ids)) - 1
    return _home_rows(ids[at], tags[at], homes[at], start[at], reach[last] - start[at])


def _repeated(span: int):
    """For a bucket of pieces, the ranges covered by a string of a smaller document."""

    def bucket(blobs: list[bytes]) -> tuple[list, list]:
        ids, tags, homes, doc, start, size, key, text, at = [], [], [], [], [], [], [], [], 0
        for blob in blobs:
            i, t, h, local, first, n, base, step, chars = _unpack(blob)
            ids.append(i.view(np.int64))
            tags.append(t)
            homes.append(h.astype(np.int64))
            doc.append(local.astype(np.int64) + at)
            start.append(first.astype(np.int64))
            size.append(n.astype(np.int64))
            with np.errstate(over="ignore"):
                key.append(base[0] + np.cumsum(step, dtype=np.uint64))
            text.append(chars)
            at += len(i)
        ids, tags, homes, doc, start, size, key, text = (np.concatenate(x) for x in (ids, tags, homes, doc, start, size, key, text))
        length = size + span - 1
        place = np.cumsum(length) - length
        order = np.lexsort((ids[doc], key))
        doc, start, size, key, length, place = (x[order] for x in (doc, start, size, key, length, place))
        edge = np.append(_runs(key), len(key))
        homes_out, blobs_out, lo = [], [], 0
        # some keys at a time, as many as fit in a chunk of text
        total = np.append(0, np.cumsum(length))
        while lo < len(edge) - 1:
            hi = max(lo + 1, int(np.searchsorted(total[edge], total[edge[lo]] + 2 * CHUNK, side="right")) - 1)
            s = slice(edge[lo], edge[hi])
            to, found = some(text, ids, tags, homes, doc[s], start[s], size[s], key[s], length[s], place[s])
            homes_out += to
            blobs_out += found
            lo = hi
        return homes_out, blobs_out

    def some(text, ids, tags, homes, doc, start, size, key, length, place):
        own = ids[doc]
        group = _runs(key)
        members = np.diff(np.append(group, len(key)))
        shared = np.repeat(own[group] != own[group + members - 1], members)  # sorted: first and last id differ
        doc, start, size, key, length, place, own = (x[shared] for x in (doc, start, size, key, length, place, own))
        if not len(key):
            return [], []
        # strings whose fingerprint occurs in documents of different ids
        chars = text[ragged(place, length)]
        begin = np.cumsum(length) - length
        g = _grams(chars)
        piece = np.repeat(np.arange(len(size)), size)
        at = ragged(begin, size)
        f = _prints(g, at, span)
        order = np.lexsort((own[piece], f))
        piece, at, f = piece[order], at[order], f[order]
        new = _runs(f)
        count = np.diff(np.append(new, len(f)))
        alike = np.repeat(own[piece[new]] != own[piece[new + count - 1]], count)
        piece, at, f = piece[alike], at[alike], f[alike]
        if not len(piece):
            return [], []
        hit = _confirm(chars, begin, length, key, own, np.unique(piece), (piece, at, f), span)
        if not hit.any():
            return [], []
        p, where = piece[hit], at[hit]
        return _covered(own[p], tags[doc[p]], homes[doc[p]], start[p] + where - begin[p], np.full(len(p), span))

    return bucket


def _confirm(chars, begin, length, key, own, used, candidates, span):
    """Whether each candidate string ``(piece, place, fingerprint)`` equals one of a smaller document.

    The pieces of a key make one text; texts of similar length get their suffix arrays together."""
    piece, at, f = candidates
    number = np.full(len(begin), -1)
    number[used] = np.arange(len(used))
    k = key[used]  # used is sorted, and so are the keys
    first = np.flatnonzero(np.append(True, k[1:] != k[:-1]))
    total = np.add.reduceat(length[used] + 1, first) + 1
    group_of = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(used))))
    direct = (total > LONG_GROUP)[group_of[number[piece]]]
    hit = np.zeros(len(piece), bool)
    eights = _eights(chars)
    hit[direct] = _compare(eights, at[direct], f[direct], own[piece[direct]], span)

    rank = np.argsort(total[total <= LONG_GROUP], kind="stable")
    small = np.flatnonzero(total <= LONG_GROUP)[rank]
    stop = np.cumsum(total[small])
    found = np.zeros(len(chars) + 1, bool)
    for lo in range(0, int(stop[-1]) if len(stop) else 0, BATCH):
        mine = small[(stop > lo) & (stop <= lo + BATCH)]
        if not len(mine):
            continue
        n = np.diff(np.append(first, len(used)))[mine]
        which = used[ragged(first[mine], n)]
        size = length[which]
        # text: each piece's bytes, then a separator (1); each string ends with 0
        group = np.repeat(np.arange(len(mine)), n)
        lead = np.cumsum(size + 1) - (size + 1) + group
        text = np.ones(int(total[mine].sum()), np.int64)
        source = np.full(len(text), -1)
        to, src = ragged(lead, size), ragged(begin[which], size)
        text[to], source[to] = chars[src].astype(np.int64) + 2, src
        off = np.append(0, np.cumsum(total[mine]))
        text[off[1:] - 1] = 0
        left = np.zeros(len(text), np.int64)  # bytes to the end of the piece
        left[to] = np.repeat(lead + size, size) - to
        who = np.full(len(text), NO_ID)
        who[to] = np.repeat(own[which], size)
        sa = suffix_arrays(text, off)
        sa = sa[left[sa] >= span]
        if not len(sa):
            continue
        equal = np.zeros(len(sa), bool)
        place = source[sa]  # whole strings lie inside a piece, so their bytes do in ``chars``
        equal[1:] = _same(eights, place[:-1], place[1:], span)
        owner = np.searchsorted(off, sa, side="right")
        equal[1:] &= owner[1:] == owner[:-1]
        interval = np.cumsum(~equal) - 1
        least = np.full(int(interval[-1]) + 1, NO_ID)
        np.minimum.at(least, interval, who[sa])
        found[source[sa[who[sa] > least[interval]]]] = True
    hit[~direct] = found[at[~direct]]
    return hit


def _compare(eights, at, f, own, span):
    """The same for single strings, sorted by fingerprint: each against the first bytes of its run; what
    differs (two strings of one fingerprint) goes another round."""
    hit = np.zeros(len(at), bool)
    rest = np.arange(len(at))
    while len(rest):
        head = np.flatnonzero(np.append(True, f[rest][1:] != f[rest][:-1]))
        lead = rest[np.repeat(head, np.diff(np.append(head, len(rest))))]
        same = _same(eights, at[rest], at[lead], span)
        hit[rest[same]] = own[rest[same]] > own[lead[same]]  # sorted by id: the first is the smallest
        rest = rest[~same]
    return hit


def _cut(texts: pa.Table, told: pa.Table) -> pa.Table:
    """The home's documents without their covered ranges."""
    ids, tags, row, who, cols = _rows_of(texts, told)
    start, end = cols[0].astype(np.int64), cols[0].astype(np.int64) + cols[1].astype(np.int64)
    order = np.argsort(who, kind="stable")
    who, start, end = who[order], start[order], end[order]
    lead = [row[pair] for pair in zip(ids.tolist(), tags.tolist(), strict=True)]
    lo, hi = np.searchsorted(who, lead), np.searchsorted(who, lead, side="right")
    n_bytes, removed, spans, digest, kept = [], [], [], [], []
    for i, value in enumerate(texts.column("__text")):
        text = np.frombuffer((value.as_py() or "").encode(), np.uint8)
        keep = np.ones(len(text), bool)
        for k in range(lo[i], hi[i]):
            keep[start[k] : end[k]] = False
        left = text[keep].tobytes()
        n_bytes.append(len(text))
        removed.append(len(text) - len(left))
        spans.append(int((~keep & np.append(True, keep)[:-1]).sum()))
        digest.append(hashlib.sha256(left).hexdigest())
        kept.append(left)
    return pa.table([texts.column("id"), pa.array(n_bytes, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(digest, pa.string()), pa.array(kept, pa.binary())], names=["id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", span: int = 50) -> DataFrame:
    """Rows ``(id, n_bytes, n_removed, n_spans, kept_sha256, kept)``, one per row of ``docs``.

    A text is its UTF-8 bytes; a byte is removed if a ``span``-byte string that covers it also starts in
    a row with a smaller id. Strings are judged on the input. ``kept`` is the remaining bytes, which may
    begin or end inside a character.

    * null and empty texts have no bytes; texts shorter than ``span`` lose none;
    * rows with the same id do not remove each other's strings; each has its own result (they are told
      apart by a 64-bit hash of the text), and repeated rows have the same one;
    * a null id is greater than all others, and null ids do not remove each other's strings;
    * ids must be integers; other columns are ignored, whatever their names.
    """
    width = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = HOMES * width
    src = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(F.col(text_col)).alias("tag"), F.col(text_col).alias("__text"))
    src = src.withColumn("home", F.pmod(F.xxhash64("id", "tag"), F.lit(parts)).cast("int"))
    sent = "bucket int, home int, blob binary"

    def to_buckets(rows: DataFrame) -> DataFrame:
        deal = F.when(F.col("bucket") < 0, -1 - F.col("home")).otherwise(F.col("bucket"))
        return rows.withColumn("deal", deal).repartition(width, "deal").sortWithinPartitions("deal").select("bucket", "home", "blob")

    keys = to_buckets(src.mapInArrow(_offer(span, parts), sent)).mapInArrow(_by_bucket(_shared_keys), sent)
    texts = src.groupBy("home")
    pieces_ = to_buckets(texts.cogroup(keys.groupBy("home")).applyInArrow(_spread(span, parts), sent))
    ranges = pieces_.mapInArrow(_by_bucket(_repeated(span)), sent)
    out = texts.cogroup(ranges.groupBy("home")).applyInArrow(_cut, "id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
    return out.withColumnRenamed("id", id_col)


def op4_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    """Contract query: 50-byte strings, all documents."""
    return remove_repeats(table(spark, sf_dir, "documents")).drop("kept")


ORACLE_OP4 = """
WITH t AS (SELECT doc_id, hex(coalesce(text, '')) AS h, strlen(coalesce(text, '')) AS n FROM documents),
p AS (SELECT doc_id, i, substr(h, CAST(2 * i + 1 AS BIGINT), 100) AS s FROM t, unnest(range(0, n - 49)) AS u(i)),
hit AS (SELECT p.doc_id, p.i FROM p JOIN (SELECT s, min(doc_id) AS least FROM p GROUP BY s) f USING (s) WHERE least < p.doc_id),
marked AS (SELECT *, i > lag(i) OVER w + 50 AS apart FROM hit WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
run AS (
  SELECT doc_id, min(i) AS a, max(i) + 50 AS b
  FROM (SELECT *, count(*) FILTER (apart) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM marked) GROUP BY doc_id, k),
cut AS (SELECT *, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS since FROM run),
kept AS (
  SELECT t.doc_id, t.n, coalesce(sum(b - a), 0) AS removed, count(a) AS spans,
    coalesce(string_agg(substr(h, CAST(2 * since + 1 AS BIGINT), CAST(2 * (a - since) AS BIGINT)), '' ORDER BY a), '')
      || substr(any_value(h), CAST(2 * coalesce(max(b), 0) + 1 AS BIGINT)) AS h
  FROM t LEFT JOIN cut USING (doc_id) GROUP BY t.doc_id, t.n)
SELECT doc_id, CAST(n AS BIGINT) AS n_bytes, CAST(removed AS BIGINT) AS n_removed, CAST(spans AS BIGINT) AS n_spans,
  sha256(unhex(h)) AS kept_sha256 FROM kept"""
