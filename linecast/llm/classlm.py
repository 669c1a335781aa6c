"""Language-model scoring with a Brown class-based bigram model.

Method. Exchange clustering assigns every word to one of ``classes`` classes. ``fit`` begins with units,
the most frequent words and the families of the other words' endings, which are exchanged between
classes while that raises the likelihood of the class bigrams; ``exchange_words`` then exchanges every
word by itself, in tasks, beside the class bigrams of all texts. A text's probability
is the product of smoothed class transitions and smoothed word emissions,
``P(w | before) = P(class(w) | class(before)) * (c(w) + 1) / (N_class + V_class + 1)``; the last summand
keeps one place per class for unknown words. A text begins and ends with the end token, which is a
class of its own.

Scale. Word counts cover every training text and stay distributed. What reaches the driver is bounded
by parameters, not by data: ``top`` words, the matrix of unit pairs (``top + endings + 1`` squared) and
the class bigrams. A chunk of texts asks for the counts and classes of its distinct words by hash range
and streams past them in that range's task.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linecast.llm.scratch import table, written
from linecast.llm.words import U, Words, chunks, hash_runs

#: A chunk's distinct words are asked for together, so chunks are larger here.
CHUNK = 8 << 20


def held_out(id_col: str = "doc_id") -> Column:
    """crc32 of the id's text, mod 7, is 2; a null id is training text."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 7 == 2, F.lit(False))


def _ranges(h: np.ndarray, parts: int) -> np.ndarray:
    """Hash range of each 64-bit hash; grows with the hash."""
    return ((h >> U(32)) * U(parts) >> U(32)).astype(np.int32)


def _endings(words: Words, at: np.ndarray, endings: int) -> np.ndarray:
    """Family of the last three bytes of the words ``at``."""
    size = np.minimum(words.end[at] - words.start[at], 3)
    return (hash_runs(words.buf, words.end[at] - size, size) % U(endings)).astype(np.int32)


def _count(endings: int, parts: int):
    """Distinct words of a partition with their counts, merged over chunks while they fit in memory."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def merged():
            h, n, e = (np.concatenate([x[k] for x in held]) for k in range(3))
            u, first, back = np.unique(h, return_index=True, return_inverse=True)
            return u, np.bincount(back, weights=n).astype(np.int64), e[first]

        def rows(u, n, e):
            for at in range(0, len(u), 100_000):
                s = slice(at, at + 100_000)
                yield pa.RecordBatch.from_arrays([pa.array(_ranges(u[s], parts)), pa.array(u[s].view(np.int64)), pa.array(n[s]), pa.array(e[s])], names=["bucket", "w", "n", "ending"])

        for batch in chunks(batches, limit=CHUNK):
            words = Words(batch.column("text"))
            if not len(words.start):
                continue
            u, first, n = np.unique(words.hashes(), return_index=True, return_counts=True)
            held.append((u, n, _endings(words, first, endings)))
            if len(held) == 8:
                held[:] = [merged()]
                if len(held[0][0]) > 1_000_000:
                    yield from rows(*held.pop())
        if held:
            yield from rows(*merged())

    return run


def _units(words: Words, top: np.ndarray, rank: np.ndarray, endings: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and unit of each word. ``top``: sorted hashes of the frequent words, ``rank``: their units."""
    h = words.hashes()
    if not len(h):
        return h, np.zeros(0, np.int64)
    at = np.minimum(np.searchsorted(top, h), max(len(top) - 1, 0))
    known = top[at] == h if len(top) else np.zeros(len(h), bool)
    unit = np.empty(len(h), np.int64)
    unit[known] = rank[at[known]]
    rest = np.flatnonzero(~known)
    unit[rest] = len(top) + _endings(words, rest, endings)
    return h, unit


def _with_ends(words: Words, unit: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """Transitions (from, to) of all texts, each begun and ended by ``end``, ordered by text."""
    rows = len(words.count)
    size = words.count + 1
    stop = np.cumsum(size)
    to = np.full(int(stop[-1]) if rows else 0, end)
    place = np.ones(len(to), bool)
    place[stop - 1] = False
    to[place] = unit
    before = np.empty_like(to)
    before[1:] = to[:-1]
    before[stop - size] = end
    return before, to


def _pairs(top: np.ndarray, rank: np.ndarray, endings: int, units: int, blocks: int):
    """Counts of unit pairs, one dense matrix per task, sent as compressed blocks of rows."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        total = np.zeros(units * units, np.int64)
        for batch in chunks(batches, limit=CHUNK):
            words = Words(batch.column("text"))
            _, unit = _units(words, top, rank, endings)
            a, b = _with_ends(words, unit, units - 1)
            code, n = np.unique(a * units + b, return_counts=True)
            total[code] += n
        cells = np.flatnonzero(total)
        if len(cells):
            cut = np.searchsorted(cells, np.arange(blocks + 1) * -(-units * units // blocks))
            blobs = [_pack(cells[cut[k] : cut[k + 1]], total[cells[cut[k] : cut[k + 1]]]) for k in range(blocks)]
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(blocks, dtype=np.int32)), pa.array(blobs, pa.binary())], names=["block", "cells"])

    return run


def _pack(*arrays: np.ndarray) -> bytes:
    """Integer arrays, each at its least width, as one compressed blob."""
    parts = []
    for x in arrays:
        kind = x.dtype if x.dtype == np.uint64 or x.dtype == np.float64 else np.min_scalar_type(int(x.max()) if len(x) else 0)
        parts += [np.array([len(x)], np.int64).tobytes(), kind.str.ljust(8).encode(), x.astype(kind).tobytes()]
    raw = b"".join(parts)
    return np.array([len(raw)], np.int64).tobytes() + bytes(pa.compress(raw, codec="zstd", asbytes=True))


def _unpack(blob: bytes) -> list[np.ndarray]:
    raw = pa.decompress(blob[8:], decompressed_size=int(np.frombuffer(blob[:8], np.int64)[0]), codec="zstd", asbytes=True)
    out, at = [], 0
    while at < len(raw):
        n, kind = int(np.frombuffer(raw, np.int64, 1, at)[0]), np.dtype(raw[at + 8 : at + 16].decode().strip())
        out.append(np.frombuffer(raw, kind, n, at + 16))
        at += 16 + n * kind.itemsize
    return out


def _add_cells(pdf: pd.DataFrame) -> pd.DataFrame:
    cells, counts = zip(*(_unpack(x) for x in pdf["cells"]), strict=True)
    code, back = np.unique(np.concatenate(cells), return_inverse=True)
    n = np.bincount(back, weights=np.concatenate(counts)).astype(np.int64)
    return pd.DataFrame({"cells": [_pack(code.astype(np.int64), n)]})


def exchange(pairs: np.ndarray, classes: int, sweeps: int = 10) -> np.ndarray:
    """Class of each unit, from the counts of unit pairs. The last unit, the end, is the last class.

    Units start in order of frequency, dealt in turn; then each in turn goes to the class where the
    likelihood of the class bigrams is greatest, until a sweep moves none (or ``sweeps`` are over)."""
    units, k = len(pairs), classes + 1
    size = pairs.sum(axis=0)
    order = np.argsort(-size[:-1], kind="stable")
    cls = np.empty(units, np.int64)
    cls[order] = np.arange(units - 1) % classes
    cls[-1] = classes
    one = np.zeros((units, k))
    one[np.arange(units), cls] = 1
    g = one.T @ pairs @ one
    left, right = g.sum(axis=1), g.sum(axis=0)

    def f(x):
        return x * np.log(np.maximum(x, 1))

    own = np.arange(k)
    for _ in range(sweeps):
        moved = 0
        for u in order:
            if not size[u]:
                continue
            r = np.bincount(cls, weights=pairs[u], minlength=k)
            c = np.bincount(cls, weights=pairs[:, u], minlength=k)
            me, a = pairs[u, u], cls[u]
            r[a] -= me
            c[a] -= me
            g[a] -= r
            g[:, a] -= c
            g[a, a] -= me
            left[a] -= r.sum() + me
            right[a] -= c.sum() + me
            old, row, col = f(g), f(g + r), f(g.T + c)  # row k: what class k's row and column become
            gain = (row - old).sum(axis=1) + (col - old.T).sum(axis=1) - (row - old)[own, own] - (col - old.T)[own, own]
            gain += f(g[own, own] + r + c + me) - old[own, own]
            gain -= f(left + r.sum() + me) - f(left) + f(right + c.sum() + me) - f(right)
            b = int(np.argmax(gain[:classes]))
            if gain[b] <= gain[a] + 1e-9:
                b = a
            moved += b != a
            cls[u] = b
            g[b] += r
            g[:, b] += c
            g[b, b] += me
            left[b] += r.sum() + me
            right[b] += c.sum() + me
        if not moved:
            break
    return cls


@dataclass
class ClassModel:
    """``words(bucket, w, n, ending, cls)`` stays a table; the rest is bounded by the parameters of ``fit``."""

    words: DataFrame
    parts: int
    top: np.ndarray  # sorted hashes of the frequent words
    rank: np.ndarray  # their units
    endings: int
    cls: np.ndarray  # class of each unit, where every word begins
    of_ending: np.ndarray  # class of the unknown words of each family
    step: np.ndarray  # log10 of P(class | class before)
    spread: np.ndarray  # log10 of a class's tokens and places for words
    end_count: int
    tokens: int
    vocabulary: int


def fit(docs: DataFrame, text_col: str = "text", classes: int = 64, top: int = 1024, endings: int = 512, smoothing: float = 1.0, parts: int | None = None) -> ClassModel:
    """Counts over all texts of ``docs`` (null: empty) and the class model."""
    spark = docs.sparkSession
    parts = parts or 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    text = docs.select(F.col(text_col).alias("text"))
    seen = text.mapInArrow(_count(endings, parts), "bucket int, w long, n long, ending int")
    counts = written(seen.groupBy("bucket", "w").agg(F.sum("n").alias("n"), F.min("ending").alias("ending")), "word-counts")
    rows = text.count()
    by_ending = {r["ending"]: (r["n"], r["v"]) for r in counts.groupBy("ending").agg(F.sum("n").alias("n"), F.count("*").alias("v")).collect()}
    first = counts.orderBy(F.desc("n"), "w").limit(top).collect()
    h = np.array([r["w"] for r in first], np.int64).view(np.uint64)
    order = np.argsort(h)
    units = len(first) + endings + 1
    total, vocab = np.zeros(units), np.zeros(units)
    for e, (n, v) in by_ending.items():
        total[len(first) + e], vocab[len(first) + e] = n, v
    for k, r in enumerate(first):
        total[k], vocab[k] = r["n"], 1
        total[len(first) + r["ending"]] -= r["n"]
        vocab[len(first) + r["ending"]] -= 1
    total[-1], vocab[-1] = rows, rows > 0

    blocks = 16
    cells = text.mapInArrow(_pairs(h[order], order, endings, units, blocks), "block int, cells binary").groupBy("block").applyInPandas(_add_cells, "cells binary")
    pairs = np.zeros(units * units)
    for r in cells.collect():
        code, n = _unpack(r["cells"])
        pairs[code] = n
    pairs = pairs.reshape(units, units)
    cls = exchange(pairs, classes)
    one = np.zeros((units, classes + 1))
    one[np.arange(units), cls] = 1
    g, size, places = one.T @ pairs @ one, one.T @ total, one.T @ vocab
    n_all = int(total.sum())
    v_all = int(sum(v for _, v in by_ending.values())) + (rows > 0)
    words = counts.mapInArrow(_begin(h[order], order, cls), "bucket int, w long, n long, ending int, cls int")
    return ClassModel(words, parts, h[order], order, endings, cls, cls[len(first) : -1], _steps(g, size, smoothing), np.log10(size + places + 1), rows, n_all, v_all)


def _begin(top: np.ndarray, rank: np.ndarray, cls: np.ndarray):
    """The words with the classes of their units."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h, unit = batch.column("w").to_numpy().view(np.uint64), batch.column("ending").to_numpy() + len(top)
            if len(top):
                at = np.minimum(np.searchsorted(top, h), len(top) - 1)
                unit = np.where(top[at] == h, rank[at], unit)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cls[unit].astype(np.int32))], names=[*batch.schema.names, "cls"])

    return run


_ROWS = "chunk string, bucket int, blob binary, texts binary"


def _sequences(keep: list[str], parts: int, endings: int):
    """Rows of a chunk: its texts (bucket -1) as places among its distinct words, and these by hash range."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        import uuid

        for batch in chunks(batches, "__text", limit=CHUNK):
            chunk = uuid.uuid4().hex
            words = Words(batch.column("__text"))
            h, first, place = np.unique(words.hashes(), return_index=True, return_inverse=True)
            sink = pa.BufferOutputStream()
            texts = pa.RecordBatch.from_arrays([batch.column(c) for c in keep] + [pa.array(words.count + 1, pa.int64())], names=[*keep, "n_tokens"])
            with pa.ipc.new_stream(sink, texts.schema) as out:
                out.write_batch(texts)
            where = _ranges(h, parts)
            cut = np.append(np.flatnonzero(np.append(True, where[1:] != where[:-1])), len(where)) if len(where) else np.zeros(0, np.int64)
            buckets, blobs = [-1], [_pack(words.count, place, _endings(words, first, endings))]
            for lo, hi in zip(cut[:-1], cut[1:], strict=True):
                buckets.append(int(where[lo]))
                blobs.append(_pack(h[lo:hi]))
            rest = [None] * (len(buckets) - 1)
            yield pa.RecordBatch.from_arrays([pa.array([chunk] * len(buckets)), pa.array(buckets, pa.int32()), pa.array(blobs, pa.binary()), pa.array([sink.getvalue().to_pybytes(), *rest], pa.binary())], names=["chunk", "bucket", "blob", "texts"])

    return run


def _by_range(batches, counted, asked) -> Iterator[pa.RecordBatch]:
    """Rows come by hash range, its words (kind 0) before the rest. ``asked(words, chunk, blob)`` is called
    for each other row with the range's words by hash, ``counted(bucket, words)`` after the range."""
    now, held, words = None, [], None

    def ordered():
        cols = [np.concatenate(x) for x in zip(*held, strict=True)] if held else [np.zeros(0, np.int64)] * 4
        order = np.argsort(cols[0].view(np.uint64))
        return [x[order] for x in cols]

    for batch in batches:
        bucket = batch.column("bucket").to_numpy()
        kind = batch.column("kind").to_numpy()
        edge = np.flatnonzero(np.append(True, (bucket[1:] != bucket[:-1]) | (kind[1:] != kind[:-1])))
        for lo, hi in zip(edge, np.append(edge[1:], len(bucket)), strict=True):
            if bucket[lo] != now:
                if now is not None:
                    yield from counted(now, words or ordered())
                now, held, words = bucket[lo], [], None
            if not kind[lo]:
                held.append([batch.column(c).slice(lo, hi - lo).to_numpy() for c in ("w", "n", "ending", "cls")])
                continue
            words = words or ordered()
            yield from asked(words, batch.slice(lo, hi - lo))
    if now is not None:
        yield from counted(now, words or ordered())


def _at(words: list[np.ndarray], h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the hashes ``h`` among a range's words, and whether they are there."""
    known = words[0].view(np.uint64)
    if not len(known):
        return np.zeros(len(h), np.int64), np.zeros(len(h), bool)
    at = np.minimum(np.searchsorted(known, h), len(known) - 1)
    return at, known[at] == h


def _answer(share: int = 1, turn: int = 0):
    """Each question, hashes or the places of an earlier answer, gets per word its count and class (0 and
    0 if unknown), its place in the range and whether it is of the share."""

    def asked(words, batch):
        blobs = []
        for blob in batch.column("blob"):
            question = _unpack(blob.as_py())
            if len(question) == 1:
                at, known = _at(words, question[0])
            else:
                at, known = np.cumsum(question[0].astype(np.int64)), True
            n, cls, w = (np.where(known, words[k][at], 0) if len(words[0]) else at for k in (1, 3, 0))
            blobs.append(_pack(n, cls, np.diff(at, prepend=0), _of_share(w, share, turn)))
        yield pa.RecordBatch.from_arrays([batch.column("chunk"), batch.column("bucket"), pa.array(blobs, pa.binary()), pa.nulls(len(blobs), pa.binary())], names=["chunk", "bucket", "blob", "texts"])

    return lambda batches: _by_range(batches, lambda *_: (), asked)


def _of_share(w: np.ndarray, share: int, turn: int) -> np.ndarray:
    return (w.view(np.uint64) % U(share) == U(turn)).astype(np.uint8)


def _ordered(words: DataFrame, rows: DataFrame) -> DataFrame:
    """The words and the rows of each hash range together, words first."""
    width = int(words.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    no = [F.lit(None).cast("string").alias("chunk"), F.lit(None).cast("binary").alias("blob")]
    zero = [F.lit(0).cast(t).alias(c) for c, t in (("w", "long"), ("n", "long"), ("ending", "int"), ("cls", "int"))]
    left = words.select("bucket", F.lit(0).alias("kind"), "w", "n", "ending", "cls", *no)
    right = rows.select("bucket", F.lit(1).alias("kind"), *zero, "chunk", "blob")
    return left.unionByName(right).repartition(width, "bucket").sortWithinPartitions("bucket", "kind")


def _told(words: DataFrame, asked: DataFrame, questions: DataFrame, of: tuple[int, int] = (1, 0)):
    """Texts and answers of every chunk, grouped by chunk."""
    answers = _ordered(words, questions.where("bucket >= 0")).mapInArrow(_answer(*of), _ROWS)
    return answers.unionByName(asked.where("bucket = -1")).groupBy("chunk")


def sequences(docs: DataFrame, model: ClassModel, keep: tuple[str, ...] = ("doc_id",), text_col: str = "text") -> DataFrame:
    """Texts and questions of all chunks of ``docs``, for ``exchange_words`` and ``score``."""
    src = docs.select(*keep, F.col(text_col).alias("__text"))
    return written(src.mapInArrow(_sequences(list(keep), model.parts, model.endings), _ROWS), "sequences")


def _chunk(pdf: pd.DataFrame, of_ending: np.ndarray):
    """Words per text, place of each token, and of the distinct words: counts, classes, places by range,
    whether they are of the share."""
    own = pdf[pdf["bucket"] == -1].iloc[0]
    count, place, ending = (x.astype(np.int64) for x in _unpack(own["blob"]))
    answers = pdf[pdf["bucket"] != -1].sort_values("bucket")
    got = [_unpack(x) for x in answers["blob"]]
    n, cls = (np.concatenate([x[k] for x in got]).astype(np.int64) if got else place for k in (0, 1))
    cls = np.where(n > 0, cls, of_ending[ending])
    due = np.concatenate([x[3] for x in got]) > 0 if got else place > 0
    return own, count, place, n, cls, answers["bucket"].to_numpy(), [x[2] for x in got], due


def _class_steps(count: np.ndarray, seq: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """Transitions (from, to) of texts of ``count`` words, each begun and ended by ``end``."""
    stop = np.cumsum(count + 1)
    to = np.full(int(stop[-1]) if len(stop) else 0, end)
    place = np.ones(len(to), bool)
    place[stop - 1] = False
    to[place] = seq
    before = np.roll(to, 1)
    return before, to


def _contexts(k: int):
    """Per hash range, the classes beside a chunk's words of the share: ``2 k + 1`` cells a word, for the class after
    it, the class before it, and for the word itself after it. Row -1: the chunk's class transitions."""
    wide = 2 * k + 1

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        _, count, place, n, cls, buckets, at, due = _chunk(pdf, np.zeros(1 << 16, np.int64))
        a, b = _class_steps(count, cls[place], k - 1)
        x, y = _class_steps(count, place, -1)
        due = np.append(due, False)  # of the end
        p, q = due[x], due[y]
        cells = [x[p] * wide + b[p], y[q] * wide + k + a[q], x[p & (x == y)] * wide + 2 * k]
        code = np.concatenate(cells)
        code, times = np.unique(code.astype(np.int32) if len(n) * wide < 1 << 31 else code, return_counts=True)
        code = code.astype(np.int64)
        g, m = np.unique(a * k + b, return_counts=True)
        out, blobs, lo = [-1], [_pack(g, m)], 0
        for bucket, places in zip(buckets, at, strict=True):
            hi = lo + len(places)
            s = slice(*np.searchsorted(code, [lo * wide, hi * wide]))
            out.append(int(bucket))
            blobs.append(_pack(places, np.diff(code[s], prepend=lo * wide), times[s]))
            lo = hi
        return pd.DataFrame({"chunk": pdf["chunk"].iloc[0], "bucket": out, "blob": blobs})

    return run


def _f(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1))


def gains(r: np.ndarray, c: np.ndarray, me: np.ndarray, a: np.ndarray, g: np.ndarray) -> np.ndarray:
    """What the log likelihood of the class bigrams ``g`` gains if a word, taken out of its class ``a``,
    is put into each class. ``r``, ``c``: how often each class comes after and before each word;
    ``me``: how often the word itself does (counted in ``r`` and ``c`` too)."""
    r, c, rows = r.astype(float), c.astype(float), np.arange(len(a))
    r[rows, a] -= me
    c[rows, a] -= me
    out = np.zeros(r.shape)
    for mine, other, by in ((r, c, g), (c, r, g.T)):
        i, y = np.nonzero(mine)
        if not len(i):
            continue
        e, at = mine[i, y][:, None], np.arange(len(i))
        base = by.T[y].astype(float)  # of every class, what it has with class y once the word is out
        base[at, a[i]] -= e[:, 0]
        same = np.flatnonzero(y == a[i])
        base[same] -= other[i[same]]
        base[same, y[same]] -= me[i[same]]
        d = _f(base + e) - _f(base)
        d[at, y] = 0
        start = np.flatnonzero(np.append(True, i[1:] != i[:-1]))
        out[i[start]] += np.add.reduceat(d, start, axis=0)
    own = np.broadcast_to(np.diagonal(g).astype(float), r.shape).copy()
    own[rows, a] -= r[rows, a] + c[rows, a] + me
    out += _f(own + r + c + me[:, None]) - _f(own)
    for mine, total in ((r, g.sum(axis=1)), (c, g.sum(axis=0))):
        size = mine.sum(axis=1) + me
        rest = np.broadcast_to(total.astype(float), r.shape).copy()
        rest[rows, a] -= size
        out -= _f(rest + size[:, None]) - _f(rest)
    return out


def _move(g: np.ndarray, share: int, turn: int, block: int = 1024):
    """Each word of a hash range goes to its best class beside the class bigrams ``g``."""
    k = len(g)
    wide = 2 * k + 1

    def run(batches) -> Iterator[pa.RecordBatch]:
        seen: list[np.ndarray] = []

        def asked(words, batch):
            if not seen:
                seen.append(np.zeros(len(words[0]) * wide, np.int64))
            for blob in batch.column("blob"):
                places, code, n = _unpack(blob.as_py())
                code = np.cumsum(code.astype(np.int64))
                at = np.cumsum(places.astype(np.int64))
                seen[0][at[code // wide] * wide + code % wide] += n
            return ()

        def counted(bucket, words):
            w, n, ending, cls = words
            cells = seen.pop().reshape(-1, wide) if seen else np.zeros((len(w), wide), np.int64)
            best = cls.astype(np.int64)
            may = np.flatnonzero(_of_share(w, share, turn))
            for lo in range(0, len(may), block):
                at = may[lo : lo + block]
                x, a = cells[at], best[at]
                gain = gains(x[:, :k], x[:, k : 2 * k], x[:, 2 * k], a, g)
                to = gain[:, : k - 1].argmax(axis=1)
                own = np.arange(len(at))
                best[at] = np.where(gain[own, to] > gain[own, a] + 1e-9, to, a)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(w), bucket, np.int32)), pa.array(w), pa.array(n), pa.array(ending), pa.array(best.astype(np.int32))], names=["bucket", "w", "n", "ending", "cls"])

        return _by_range(batches, counted, asked)

    return run


def likelihood(g: np.ndarray) -> float:
    """Log likelihood of the class bigrams, up to a summand that no class changes."""
    return float(_f(g).sum() - _f(g.sum(axis=0)).sum() - _f(g.sum(axis=1)).sum())


def _freed(df: DataFrame, name: str) -> DataFrame:
    """``written``, and what was shuffled for it is removed."""
    conf, key = df.sparkSession.conf, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = conf.get(key, None)
    conf.set(key, "true")
    try:
        return written(df, name)
    finally:
        conf.unset(key) if before is None else conf.set(key, before)


def exchange_words(asked: DataFrame, model: ClassModel, sweeps: int = 1, shares: int = 4, least: int = 32) -> ClassModel:
    """``model`` after exchanging every word one by one; ``asked``: the ``sequences`` of its training texts.

    Each of ``sweeps`` visits every word. A pass counts the classes beside each word, by hash range, and moves each word of one share to its
    best class beside the class bigrams of all texts, which are all that reaches the driver. Words of a
    pass do not see each other's moves, so a pass that lowers the likelihood is undone and its words are
    dealt with again in halves, down to one of ``least`` shares."""
    if not model.tokens:
        return model
    k = len(model.step)

    def look(words, questions, of):
        rows = _freed(_told(words, asked, questions, of).applyInPandas(_contexts(k), "chunk string, bucket int, blob binary"), "contexts")
        cells = rows.where("bucket = -1").select(F.pmod(F.xxhash64("chunk"), F.lit(64)).alias("deal"), F.col("blob").alias("cells")).groupBy("deal").applyInPandas(_add_cells, "cells binary")
        g = np.zeros(k * k)
        for r in cells.collect():
            code, n = _unpack(r["cells"])
            g[code] += n
        return rows, g.reshape(k, k)

    words, todo = model.words, [(shares, turn) for turn in range(shares)] * sweeps
    rows, g = look(words, asked, todo[0])
    of = todo[0]
    while todo:
        share, turn = todo.pop(0)
        if share % of[0] or turn % of[0] != of[1]:
            of = (share, turn)
            rows, g = look(words, rows, of)
        moved = _freed(_ordered(words, rows.where("bucket >= 0")).mapInArrow(_move(g, share, turn), "bucket int, w long, n long, ending int, cls int"), "word-classes")
        after = todo[0] if todo else (least, 0)
        then, h = look(moved, rows, after)
        if likelihood(h) >= likelihood(g):
            words, rows, g, of = moved, then, h, after
        elif share < least:
            todo[:0] = [(2 * share, turn), (2 * share, turn + share)]
    of = words.groupBy("cls").agg(F.sum("n").alias("n"), F.count("*").alias("v")).collect()
    size, places = np.zeros(k), np.zeros(k)
    for r in of:
        size[r["cls"]], places[r["cls"]] = r["n"], r["v"]
    size[-1], places[-1] = model.end_count, model.end_count > 0
    like = words.groupBy("ending", "cls").count().groupBy("ending").agg(F.max(F.struct("count", (-F.col("cls")).alias("less"))).alias("m")).select("ending", (-F.col("m.less")).alias("cls"))
    of_ending = model.of_ending.copy()
    for r in like.collect():
        of_ending[r["ending"]] = r["cls"]
    return replace(model, words=words, of_ending=of_ending, step=_steps(g, size), spread=np.log10(size + places + 1))


def _steps(g: np.ndarray, size: np.ndarray, smoothing: float = 1.0) -> np.ndarray:
    """log10 of P(class | class before)."""
    prior = (size + 1) / (size + 1).sum()
    return np.log10((g + smoothing * prior) / (g.sum(axis=1, keepdims=True) + smoothing))


def _finish(of_ending: np.ndarray, step: np.ndarray, spread: np.ndarray, end_count: int, tokens: int, vocabulary: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        own, count, place, n, cls, _, _, _ = _chunk(pdf, of_ending)
        texts = pa.ipc.open_stream(own["texts"]).read_all().to_pandas()
        doc = np.repeat(np.arange(len(texts)), count)
        seen = n[place]
        value = np.bincount(doc, weights=np.log10(seen + 1.0), minlength=len(texts)) + np.log10(end_count + 1.0)
        a, b = _class_steps(count, cls[place], len(step) - 1)
        part = np.bincount(np.repeat(np.arange(len(texts)), count + 1), weights=step[a, b] - spread[b], minlength=len(texts))
        texts["n_known"] = np.bincount(doc, weights=seen > 0, minlength=len(texts)).astype(np.int64) + (end_count > 0)
        texts["base_score"] = value - texts["n_tokens"] * np.log10(tokens + vocabulary + 1.0)
        texts["score"] = value + part
        return texts

    return run


def score(docs: DataFrame, model: ClassModel, keep: tuple[str, ...] = ("doc_id",), text_col: str = "text", asked: DataFrame | None = None) -> DataFrame:
    """Columns ``keep`` and ``n_tokens``, ``n_known``, ``base_score``, ``score`` of every row.

    Scores are log10 probabilities of the whole text. The base is the add-one unigram model. Null and
    empty texts are one end token; rows are scored one by one, so repeated ids and null ids do not
    meet; an empty corpus gives counts of 0 (all tokens unknown). ``asked``: the
    ``sequences`` of ``docs`` where they are there already."""
    asked = sequences(docs, model, keep, text_col) if asked is None else asked
    fields = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    finish = _finish(model.of_ending, model.step, model.spread, model.end_count, model.tokens, model.vocabulary)
    return _told(model.words, asked, asked).applyInPandas(finish, f"{fields}, n_tokens long, n_known long, base_score double, score double")


def op6_class_lm(spark, sf_dir: str) -> DataFrame:
    """Contract query: all documents scored by the model of those that are not held out."""
    docs = table(spark, sf_dir, "documents")
    train = docs.where(~held_out())
    model = fit(train)
    asked = sequences(train, model)
    model = exchange_words(asked, model)
    out = score(docs, model, asked=asked.unionByName(sequences(docs.where(held_out()), model)))
    return out.select("doc_id", held_out().alias("held_out"), "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score")
