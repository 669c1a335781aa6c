"""Document fingerprints: MinHash signatures, near documents by bands, and likeness to neighbours.

Method. A document's set is its distinct five-word shingles. Multiply-add-shift functions over 64 bits,
strongly universal for the shingles' 32-bit hashes, take the place of permutations; the signature
holds each function's least value, found in numpy for all rows of a chunk at once. The fingerprint
keeps 16 bits a function, and the likeness of two fingerprints is their share of equal places.

Near documents. Bands of three signature places are joined in Spark: different sets that share a
bucket are in one cluster, directly or over others. A cluster's sets meet in one task, or, if they hold
over ``BLOCK_ITEMS`` shingles, in one task for each pair of its blocks. There the common shingles of
all its pairs are counted over an inverted index of the whole sets, so every link within a cluster is
found, and no pair is ever a row: a task returns one row for each of its sets. Two sets at the threshold
share no band with a probability of 0.00001, and less above it.

Neighbours. The next document is the one with the next smaller id. Ids are cut into segments of
at most ``SEGMENT_BYTES`` of text, or of one id. Texts travel once, compressed, to their segment; a
segment also gets the text that follows it. Rows of an id that holds more than a segment are dealt
over several buckets, as all of them have the same next document.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linecast.llm.neardup import components
from linecast.llm.scratch import table, written
from linecast.llm.words import GOLDEN, U, Words, buffers, chunks, mix, shingles

WORDS, FUNCTIONS, BANDS, BAND_ROWS, PERCENT = 5, 128, 16, 3, 80
#: Texts of a segment, and of a map task's rows that are compressed together.
SEGMENT_BYTES, PACK_BYTES = 16 << 20, 32 << 20
#: Segments at most; beyond, segments grow with the table.
SEGMENTS = 100_000
#: Text hashed at once, so that a chunk's shingles stay in the processor's cache.
HASH_BYTES = 256 << 10
#: Shingles of a cluster's sets that one block holds (one set at least).
BLOCK_ITEMS = 1 << 18
#: Bits of a filter of keys: 16 MB in a task, at most 32 MB of rows to the driver.
FILTER_BITS = 1 << 27


def functions(m: int, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """Factors and summands of ``m`` hash functions ``(factor * x + summand mod 2^64) >> 32``."""
    with np.errstate(over="ignore"):
        x = mix((np.arange(2 * m, dtype=np.uint64) + U(seed)) * GOLDEN)
    return x[:m] | U(1), x[m:]


def minhash(h: np.ndarray, first: np.ndarray, m: int = FUNCTIONS) -> np.ndarray:
    """Signatures (rows x m, uint32) of sets of hashes; rows without elements hold the largest value."""
    n = np.diff(first)
    sig = np.full((len(n), m), 0xFFFFFFFF, np.uint32)
    full = np.flatnonzero(n)
    if not len(full):
        return sig
    x = (h ^ (h >> U(32))) & U(0xFFFFFFFF)
    value, at = np.empty_like(x), first[:-1][full]
    least = np.empty((m, len(full)), np.uint32)
    for k, (a, b) in enumerate(zip(*functions(m), strict=True)):
        np.multiply(x, a, out=value)
        np.add(value, b, out=value)
        least[k] = np.minimum.reduceat(value, at) >> U(32)
    sig[full] = least.T
    return sig


def _sets(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    words = Words(column)
    return shingles(words, words.hashes(), WORDS)


def _nodes(h: np.ndarray, first: np.ndarray) -> list[bytes | None]:
    """A 128-bit name of each whole set; None for an empty one."""
    n = np.diff(first)
    with np.errstate(over="ignore"):
        halves = []
        for salt in (GOLDEN, U(0xD6E8FEB86659FD93)):
            s = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(h + salt), dtype=np.uint64)])
            halves.append(mix(s[first[1:]] - s[first[:-1]] + n.astype(np.uint64)))
    pair = np.stack(halves, axis=1)
    return [pair[i].tobytes() if n[i] else None for i in range(len(n))]


def fingerprint_rows(texts: list[str], m: int = FUNCTIONS) -> tuple[np.ndarray, list[bytes | None]]:
    """16-bit fingerprints (rows x m) and set names of texts."""
    sigs, nodes = [np.zeros((0, m), np.uint16)], []
    for batch in chunks([pa.RecordBatch.from_arrays([pa.array(texts, pa.large_string())], names=["text"])], limit=HASH_BYTES):
        h, first = _sets(batch.column(0))
        sigs.append(minhash(h, first, m).astype(np.uint16))
        nodes += _nodes(h, first)
    return np.concatenate(sigs), nodes


# --- near documents -----------------------------------------------------------------------------


def _sign(batches) -> Iterator[pa.RecordBatch]:
    for batch in chunks(batches, "__text", HASH_BYTES):
        h, first = _sets(batch.column("__text"))
        sig = minhash(h, first, BANDS * BAND_ROWS)[np.diff(first) > 0].reshape(-1, BANDS, BAND_ROWS).astype(np.uint64)
        with np.errstate(over="ignore"):
            key = np.zeros(sig.shape[:2], np.uint64) + np.arange(1, BANDS + 1, dtype=np.uint64) * GOLDEN
            for k in range(BAND_ROWS):
                key = mix(key ^ sig[:, :, k]) + GOLDEN
        ends = np.concatenate([[0], np.cumsum((np.diff(first) > 0) * BANDS)])
        yield pa.RecordBatch.from_arrays(
            [batch.column("__id"), pa.array(_nodes(h, first), pa.binary()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(key.reshape(-1).view(np.int64), pa.int64()))],
            names=["id", "node", "bands"],
        )


def _filter(hashes: DataFrame) -> np.ndarray:
    """Bits of the ``hash`` values of ``hashes``, as 64-bit words: a filter of ``FILTER_BITS`` in size,
    ored together in Spark, so that only its words that aren't zero reach the driver."""
    place = F.pmod("hash", F.lit(FILTER_BITS))
    rows = hashes.select(F.floor(place / 64).cast("int").alias("word"), F.expr(f"shiftleft(1L, int(pmod(hash, {FILTER_BITS}) % 64))").alias("bit"))
    found = rows.groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    out = np.zeros(FILTER_BITS // 64, np.uint64)
    out[found.column("word").to_numpy()] = found.column("bits").to_numpy().view(np.uint64)
    return out


def _marked(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    place = hashes.view(np.uint64) & U(FILTER_BITS - 1)
    return (bits[(place >> U(6)).astype(np.int64)] >> (place & U(63))) & U(1) == 1


def _shared_bands(bits: np.ndarray):
    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key = np.asarray(batch.column("bands").flatten(), np.int64)
            keep = np.flatnonzero(_marked(bits, key))
            row = pa.array(keep // BANDS)
            yield pa.RecordBatch.from_arrays([pa.array(key[keep]), batch.column("id").take(row), batch.column("node").take(row)], names=["key", "id", "node"])

    return run


def _chosen_sets(bits: np.ndarray):
    def run(batches) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            keep = np.flatnonzero(_marked(bits, np.asarray(whole.column("__hash"), np.int64)))
            for batch in chunks([whole.take(pa.array(keep))], "__text", HASH_BYTES):
                h, first = _sets(batch.column("__text"))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(_nodes(h, first), pa.binary()), pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(h.view(np.int64)))], names=["node", "items"]
                )

    return run


def linked_sets(sets: list[np.ndarray], side: np.ndarray, pct: int = PERCENT) -> tuple[np.ndarray, np.ndarray]:
    """Of each set, how many others it is linked with, and the first of their places (-1: none). ``side``:
    0 or 1; if both occur, only pairs of different sides are compared (the others are another task's)."""
    m, n = len(sets), np.array([len(x) for x in sets])
    doc, start = np.repeat(np.arange(m), n), np.concatenate([[0], np.cumsum(n)])
    item = np.unique(np.concatenate(sets), return_inverse=True)[1]
    df = np.bincount(item)
    posting, first = doc[np.argsort(item, kind="stable")], np.concatenate([[0], np.cumsum(df)])
    cross = side.min() != side.max()
    links, nearest = np.zeros(m, np.int64), np.full(m, -1)
    for x in range(m):
        t = item[start[x] : start[x + 1]]
        t = t[df[t] > 1]
        if not len(t):
            continue
        met = np.concatenate([posting[first[k] : first[k + 1]] for k in t])
        if 8 * len(met) < m:
            other, common = np.unique(met, return_counts=True)
        else:
            common = np.bincount(met, minlength=m)
            other = np.flatnonzero(common)
            common = common[other]
        hit = (100 * common >= pct * (n[x] + n[other] - common)) & (other != x)
        if cross:
            hit &= side[other] != side[x]
        other = other[hit]
        if len(other):
            links[x], nearest[x] = len(other), other[0]
    return links, nearest


def _linked(batches) -> Iterator[pa.RecordBatch]:
    """Rows sorted by task (cluster, i, j), then by id: the links of each task's sets."""
    now, nodes, ids, sets, side = None, [], [], [], []

    def close() -> pa.RecordBatch:
        links, nearest = linked_sets(sets, np.array(side)) if len(sets) > 1 else (np.zeros(0, np.int64),) * 2
        at = np.flatnonzero(links).tolist()
        near = [ids[k] for k in nearest[at].tolist()]
        columns = [pa.array([nodes[k] for k in at], pa.binary()), pa.array(links[at]), pa.array([x is None for x in near], pa.bool_()), pa.array(near, pa.int64())]
        return pa.RecordBatch.from_arrays(columns, names=["node", "links", "none", "near_id"])

    for batch in batches:
        cols = [batch.column(c).to_pylist() for c in ("cluster", "i", "j", "block", "node", "id")]
        items = batch.column("items")
        values, off = np.asarray(items.flatten(), np.int64), np.concatenate([[0], np.cumsum(items.value_lengths().to_numpy(zero_copy_only=False))])
        for k, (cluster, i, j, block, node, number) in enumerate(zip(*cols, strict=True)):
            if (cluster, i, j) != now:
                yield close()
                now, nodes, ids, sets, side = (cluster, i, j), [], [], [], []
            nodes.append(node)
            ids.append(number)
            sets.append(values[off[k] : off[k + 1]].copy())
            side.append(int(i != j and block == j))
    yield close()


def near_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, node, class_id, near_id, n_near) of the documents whose set is shared or near to another.

    ``class_id``: the smallest id with the same set (``node``). ``n_near``: how many other sets have a
    Jaccard similarity of 0.8 or more with this one. ``near_id``: the smallest id of these, null if there
    is none. Null ids come last, and texts without words have no set and take no part.
    """
    base = docs.select(F.col(id_col).cast("long").alias("__id"), F.coalesce(text_col, F.lit("")).alias("__text"))
    signed = written(base.mapInArrow(_sign, "id long, node binary, bands array<bigint>").where("node is not null"), "signatures")
    # The smallest id, null where a set has none; an aggregate skips nulls.
    classes = written(signed.groupBy("node").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("n"), F.first("bands").alias("bands")), "classes")
    shared = classes.select(F.explode("bands").alias("hash")).groupBy("hash").count().where("count > 1")
    rows = classes.mapInArrow(_shared_bands(_filter(shared)), "key long, id long, node binary")
    heads = rows.groupBy("key").agg(F.min("node").alias("a"), F.count(F.lit(1)).alias("n")).where("n > 1")
    stars = written(rows.join(heads.select("key", "a"), "key").where("a <> node").select("a", F.col("node").alias("b")).distinct(), "stars")
    cluster = components(stars).select(F.col("v").alias("node"), F.col("root").alias("cluster"))
    cluster = cluster.unionByName(cluster.select(F.col("cluster").alias("node"), "cluster")).distinct()
    cluster = written(cluster.join(classes.select("node", "id"), "node"), "clusters")

    ids = cluster.select(F.xxhash64("id").alias("hash"))
    chosen = base.withColumn("__hash", F.xxhash64("__id")).mapInArrow(_chosen_sets(_filter(ids)), "node binary, items array<bigint>")
    # Copies of a set are equal, so any of them will do.
    sets = chosen.where("node is not null").join(cluster.select("node"), "node", "left_semi").groupBy("node").agg(F.first("items").alias("items"))
    sets = written(cluster.join(sets, "node"), "sets")
    blocks = sets.groupBy("cluster").agg(F.ceil(F.sum(F.size("items")) / F.lit(BLOCK_ITEMS)).cast("int").alias("k"))
    # A set goes to the tasks of its block with each other one; most clusters have one block.
    dealt = sets.join(blocks, "cluster").withColumn("block", F.pmod(F.xxhash64("node"), F.col("k")).cast("int"))
    dealt = dealt.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
    dealt = dealt.select("cluster", F.least("block", "o").alias("i"), F.greatest("block", "o").alias("j"), "block", "node", "id", "items")
    width = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = dealt.repartition(width, "cluster", "i", "j").sortWithinPartitions("cluster", "i", "j", F.col("id").asc_nulls_last(), "node")
    found = dealt.mapInArrow(_linked, "node binary, links long, none boolean, near_id long")
    near = found.groupBy("node").agg(F.min(F.struct("none", "near_id"))["near_id"].alias("near_id"), F.sum("links").alias("n_near"))
    known = classes.select("node", F.col("id").alias("class_id"), "n").join(near, "node", "left").where("n > 1 OR n_near > 0")
    known = known.withColumn("n_near", F.coalesce("n_near", F.lit(0)))
    return signed.select("id", "node").join(known.drop("n"), "node").select("id", "node", "class_id", "near_id", "n_near").distinct()


# --- neighbours -----------------------------------------------------------------------------------


@dataclass
class Segments:
    """Segments in ascending order of ids: least and largest id, first bucket and number of buckets. The
    segment of rows without id, where there is one, is the first and has ``null`` set."""

    low: np.ndarray
    high: np.ndarray
    start: np.ndarray
    buckets: np.ndarray
    null: bool

    def of(self, ids: np.ndarray, none: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.low[int(self.null) :], ids, side="right") - 1 + int(self.null)
        return np.where(none, 0, at)

    def after(self, segment: int) -> range:
        """Buckets of the segment whose documents' next one ends this segment."""
        s = (segment + 1) % len(self.low)
        return range(int(self.start[s]), int(self.start[s] + self.buckets[s]))


def _cut(target: int):
    """Tasks over sorted (id, weight) rows: segments of at most ``target``, or of one id."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        low, high, weight = [], [], []
        for batch in batches:
            for i, w in zip(batch.column("id").to_pylist(), batch.column("weight").to_pylist(), strict=True):
                if low and low[-1] is not None and weight[-1] + w <= target:
                    high[-1], weight[-1] = i, weight[-1] + w
                else:
                    low.append(i)
                    high.append(i)
                    weight.append(w)
        yield pa.RecordBatch.from_arrays([pa.array(low, pa.int64()), pa.array(high, pa.int64()), pa.array(weight, pa.int64())], names=["low", "high", "weight"])

    return run


def _segments(base: DataFrame) -> Segments:
    weights = written(base.groupBy(F.col("__id").alias("id")).agg(F.sum(F.octet_length("__text") + 64).alias("weight")), "weights")
    total = weights.agg(F.sum("weight")).first()[0] or 0
    cores = base.sparkSession.sparkContext.defaultParallelism
    target = int(max(min(SEGMENT_BYTES, total // (4 * cores)), total // SEGMENTS, 1))
    rows = weights.repartitionByRange(F.col("id").asc_nulls_first()).sortWithinPartitions(F.col("id").asc_nulls_first()).mapInArrow(_cut(target), "low long, high long, weight long")
    found = sorted(map(tuple, rows.collect()), key=lambda r: (r[0] is not None, r[0] or 0))
    null = bool(found) and found[0][0] is None
    low, high, weight = (np.array([x or 0 for x in c], np.int64) for c in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 3
    buckets = np.where(low == high, -(-weight // target), 1)
    return Segments(low, high, np.cumsum(buckets) - buckets, buckets, null)


PACKED = "bucket int, kind int, n int, size long, blob binary"
#: Kinds of packed rows, in the order in which a bucket reads them.
FOLLOWS, NEAR, OWN = 0, 1, 2


def _pack(arrays: list[bytes]) -> tuple[int, bytes]:
    raw = b"".join(arrays)
    return len(raw), pa.compress(raw, "zstd", asbytes=True)


def _packs(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.binary()]
    columns = zip(*rows, strict=True) if rows else [[]] * 5
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["bucket", "kind", "n", "size", "blob"])


def _runs(sorted_values: np.ndarray) -> Iterator[tuple[int, int]]:
    if len(sorted_values):
        ends = np.flatnonzero(np.append(sorted_values[1:] != sorted_values[:-1], True)) + 1
        yield from zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)


def _deal(segments: Segments):
    """Tasks over rows (__id, __text): texts compressed by bucket, and those that end a segment."""

    def flush(held: list[pa.RecordBatch], task: int) -> pa.RecordBatch:
        rows = pa.Table.from_batches(held).combine_chunks()
        ids = rows.column("__id").combine_chunks()
        none = np.asarray(ids.is_null())
        ids = np.asarray(ids.fill_null(0), np.int64)
        texts = rows.column("__text").combine_chunks()
        at = segments.of(ids, none)
        bucket = segments.start[at] + task % segments.buckets[at]
        order = np.argsort(bucket, kind="stable")
        raw, off = buffers(texts.take(pa.array(order)))
        size, out = np.diff(off), []
        for i, j in _runs(bucket[order]):
            out.append((int(bucket[order[i]]), OWN, j - i, *_pack([size[i:j].tobytes(), ids[order[i:j]].tobytes(), raw[off[i] : off[j]].tobytes()])))
        last = np.flatnonzero(none | (ids == segments.high[at]))
        last = last[np.argsort(at[last], kind="stable")]
        for i, j in _runs(at[last]):
            least = min(texts.take(pa.array(last[i:j])).to_pylist()).encode()
            packed = _pack([least])
            out += [(b, FOLLOWS, 1, *packed) for b in segments.after(int(at[last[i]]))]
        return _packs(out)

    def run(batches) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        held, size = [], 0
        for batch in chunks(batches, "__text", PACK_BYTES):
            held.append(batch)
            size += batch.nbytes
            if size >= PACK_BYTES:
                yield flush(held, task)
                held, size = [], 0
        if held:
            yield flush(held, task)

    return run


def _deal_near(segments: Segments):
    """Tasks over rows of ``near_documents``: packed for all buckets of each row's segment."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            none = np.asarray(batch.column("id").is_null())
            at = segments.of(np.asarray(batch.column("id").fill_null(0), np.int64), none)
            order = np.argsort(at, kind="stable")
            out = []
            for i, j in _runs(at[order]):
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, batch.schema) as stream:
                    stream.write_batch(batch.take(pa.array(order[i:j])))
                packed = _pack([sink.getvalue().to_pybytes()])
                s = at[order[i]]
                out += [(b, NEAR, j - i, *packed) for b in range(int(segments.start[s]), int(segments.start[s] + segments.buckets[s]))]
            if out:
                yield _packs(out)

    return run


RESULT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, class_id long, near_id long, n_near long"


class Bucket:
    """Rows of one bucket: first the text that follows it, then its near documents, then its own texts."""

    def __init__(self, number: int, segments: Segments):
        s = int(np.searchsorted(segments.start, number, side="right")) - 1
        self.none = segments.null and s == 0
        self.streams = bool(segments.low[s] == segments.high[s])  # one id: its rows need no order
        self.follows: str | None = None
        self.near: dict = {}
        self.held: list[tuple[np.ndarray, list[str]]] = []

    def take(self, row: dict) -> pa.RecordBatch | None:
        raw = pa.decompress(row["blob"], row["size"], "zstd", asbytes=True)
        if row["kind"] == FOLLOWS:
            text = raw.decode()
            self.follows = text if self.follows is None else min(self.follows, text)
        elif row["kind"] == NEAR:
            for r in pa.ipc.open_stream(raw).read_all().to_pylist():
                self.near[r["id"], r["node"]] = r["class_id"], r["near_id"], r["n_near"]
        else:
            n = row["n"]
            off = np.concatenate([[0], np.cumsum(np.frombuffer(raw, np.int64, n))]) + 16 * n
            self.held.append((np.frombuffer(raw, np.int64, n, 8 * n), [raw[a:b].decode() for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)]))
            if self.streams:
                return self.rows()
        return None

    def rows(self) -> pa.RecordBatch | None:
        """Results of the texts held, which are dropped."""
        if not self.held:
            return None
        ids = np.concatenate([i for i, _ in self.held])
        texts = [t for _, ts in self.held for t in ts]
        self.held = []
        order = np.argsort(ids, kind="stable")
        ids, texts = ids[order], [texts[i] for i in order.tolist()]
        own, nodes = fingerprint_rows([*texts, self.follows])
        next_of, follows = np.empty(len(ids), np.int64), len(ids)
        for i, j in _runs(ids):
            next_of[i:j] = follows
            follows = min(range(i, j), key=texts.__getitem__)
        texts.append(self.follows)
        edited = [t[: len(t) - len(t) // 2] + texts[k][: len(t) // 2] for t, k in zip(texts, next_of.tolist(), strict=False)]
        theirs, edited_nodes = fingerprint_rows(edited)
        n = len(ids)
        empty = np.array([x is None for x in nodes])
        none_edited = np.array([x is None for x in edited_nodes], dtype=bool)
        near_edited = np.where(empty[:n] == none_edited, (own[:n] == theirs).mean(axis=1), 0.0)
        near_next = np.where(empty[:n] == empty[next_of], (own[:n] == own[next_of]).mean(axis=1), 0.0)
        out_ids = [None] * n if self.none else ids.tolist()
        found = [self.near.get((i, x), (i, None, 0)) for i, x in zip(out_ids, nodes, strict=False)]
        columns = [
            pa.array(out_ids, pa.int64()),
            pa.array([len(t) for t in texts[:n]], pa.int64()),
            pa.array([hashlib.sha256(t.encode()).hexdigest() for t in edited]),
            pa.array([x.tobytes().hex() for x in own[:n].astype(">u2")]),
            pa.array([x.tobytes().hex() for x in theirs.astype(">u2")]),
            pa.array(near_edited, pa.float64()),
            pa.array(near_next, pa.float64()),
            pa.array([f[0] for f in found], pa.int64()),
            pa.array([f[1] for f in found], pa.int64()),
            pa.array([f[2] for f in found], pa.int64()),
        ]
        return pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in RESULT.split(", ")])


def _fingerprinted(segments: Segments):
    def run(batches) -> Iterator[pa.RecordBatch]:
        number, bucket = None, None
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                if row["bucket"] != number:
                    if bucket and (rows := bucket.rows()):
                        yield rows
                    number, bucket = row["bucket"], Bucket(row["bucket"], segments)
                if rows := bucket.take(row):
                    yield rows
        if bucket and (rows := bucket.rows()):
            yield rows

    return run


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each document: its fingerprint, that of its edited text, and its near documents.

    The edited text has the last ``floor(n_chars / 2)`` code points replaced by the first as many (or all)
    of the next document, by descending id, after the last the first. Null texts are empty. Rows without
    id come last; rows of one id all have the same next document, and where an id with several rows is
    the next, its least text is. A single id is its own next. Texts of fewer than five words are one
    shingle; texts without words have an empty set, which is like another empty set (1.0) and unlike all
    others (0.0). ``class_id``, ``near_id`` and ``n_near`` are as in :func:`near_documents`; a document that
    is neither shared nor near has its own id, null and 0. An empty table gives no rows. Other columns of the
    input are not read, whatever their names.
    """
    base = docs.select(F.col(id_col).cast("long").alias("__id"), F.coalesce(text_col, F.lit("")).alias("__text"))
    near = written(near_documents(docs, id_col, text_col), "near")
    segments = _segments(base)
    dealt = base.mapInArrow(_deal(segments), PACKED).unionByName(near.mapInArrow(_deal_near(segments), PACKED))
    return dealt.repartition("bucket").sortWithinPartitions("bucket", "kind").mapInArrow(_fingerprinted(segments), RESULT)


def op11_fingerprints(spark, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents."""
    return fingerprints(table(spark, sf_dir, "documents"))
