"""Near-duplicate groups by SuperMinHash, banding, verification and union-find.

Method. A document's set is its distinct word shingles. SuperMinHash gives every element one random
rank *permutation* over the signature slots, so ranks of an element never collide and the signature
has a lower variance than independent hashes. Level ``j`` only writes values in ``[j, j + 1)``, so a
document stops as soon as all its slots are below the next level. Signatures are banded; texts that
share a band are candidates, and each candidate pair is confirmed on the two full sets.

Scale. Equal sets collapse to one node before anything is compared, so thousands of copies cost one
node. Each bucket gives one star of links from its smallest node, whose components are the clusters:
two nodes that share a bucket are in one cluster. A cluster's sets meet in one task, or, if they hold
over ``BLOCK_ITEMS`` shingles, in one task for each pair of its blocks. There a node is counted against
all others through an inverted index, and union-find tells when to stop: a few central nodes first,
then every node that is not yet in the largest component; all pairs that are left lie within one
component. So no pair of nodes is ever a row, and no link between components is lost. Tables between
the steps are written to the shared folder; nothing but counts reaches the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linecast.llm.scratch import table, written
from linecast.llm.words import GOLDEN, U, Words, chunks, mix, shingles

SIGNATURE = "__th long, n_shingles long, node binary, bands array<bigint>"
#: Shingles of a cluster's sets that one block holds (one set at least).
BLOCK_ITEMS = 1_000_000
#: Central nodes that are counted against all others first.
PIVOTS = 8
#: Links that one task's union-find forest takes.
FOREST_LINKS = 200_000


def superminhash(h: np.ndarray, first: np.ndarray, m: int, seed: int = 1) -> np.ndarray:
    """Signatures (rows x m) of sets of 64-bit elements; rows without elements hold infinity."""
    rows = len(first) - 1
    sig = np.full(rows * m, np.inf)
    row = np.repeat(np.arange(rows), np.diff(first))
    with np.errstate(over="ignore"):
        x = mix(h ^ mix(np.full(1, U(seed)) * GOLDEN))
        perm = at = None
        for j in range(m):
            if not len(row):
                break
            x = x + GOLDEN
            r = mix(x)
            slot = j + ((r & U(0xFFFFFFFF)) * U(m - j) >> U(32)).astype(np.int64)
            if perm is None:
                pos = slot
            else:
                pos = perm[at, slot].astype(np.int64)
                perm[at, slot] = perm[at, j]
            # the smallest rank of each (row, slot): sort place and rank as one number
            code = np.sort(((row * m + pos).astype(np.uint64) << U(32)) | (r >> U(32)))
            place = (code >> U(32)).astype(np.int64)
            first_of = np.flatnonzero(np.append(True, place[1:] != place[:-1]))
            place = place[first_of]
            sig[place] = np.minimum(sig[place], (code[first_of] & U(0xFFFFFFFF)).astype(np.float64) * 2.0**-32 + j)
            live = (sig.reshape(rows, m).max(axis=1) >= j + 1)[row]
            if perm is None:
                perm = np.tile(np.arange(m, dtype=np.uint16), (int(live.sum()), 1))
                at = np.arange(len(perm))
                perm[at, slot[live]] = 0
            else:
                at = at[live]
            row, x = row[live], x[live]
    return sig.reshape(rows, m)


def _sets(column: pa.Array, size: int):
    words = Words(column)
    return shingles(words, words.hashes(), size)


def _nodes(h: np.ndarray, first: np.ndarray) -> list[bytes | None]:
    """A 128-bit fingerprint of each whole set; None for an empty one."""
    with np.errstate(over="ignore"):
        a, b = mix(h + GOLDEN), mix(h ^ U(0xD6E8FEB86659FD93))
        sums = [np.concatenate([np.zeros(1, np.uint64), np.cumsum(v, dtype=np.uint64)]) for v in (a, b)]
        n = np.diff(first)
        pair = np.stack([mix(s[first[1:]] - s[first[:-1]] + n.astype(np.uint64)) for s in sums], axis=1)
    return [pair[i].tobytes() if n[i] else None for i in range(len(n))]


def _lists(values: np.ndarray, offsets: np.ndarray, kind) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, kind))


def _sign(size: int, m: int, rows: int):
    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "__text"):
            h, first = _sets(batch.column("__text"), size)
            n = np.diff(first)
            sig = superminhash(h, first, m)[n > 0]
            bits = sig.view(np.uint64).reshape(len(sig), m // rows, rows)
            with np.errstate(over="ignore"):
                key = np.zeros(bits.shape[:2], np.uint64) + np.arange(m // rows, dtype=np.uint64) * GOLDEN
                for k in range(rows):
                    key = mix(key ^ bits[:, :, k]) + GOLDEN
            ends = np.concatenate([[0], np.cumsum((n > 0) * (m // rows))])
            names = [c for c in batch.schema.names if c != "__text"]
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in names] + [pa.array(n, pa.int64()), pa.array(_nodes(h, first), pa.binary()), _lists(key.reshape(-1).view(np.int64), ends, pa.int64())],
                names=[*names, "n_shingles", "node", "bands"],
            )

    return run


def _blobs(size: int):
    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "__text"):
            h, first = _sets(batch.column("__text"), size)
            yield pa.RecordBatch.from_arrays([pa.array(_nodes(h, first), pa.binary()), pa.array([h[first[i] : first[i + 1]].tobytes() for i in range(len(first) - 1)], pa.binary())], names=["node", "items"])

    return run


class _Trees:
    """Union-find over places, with the unions that were made."""

    def __init__(self, n: int):
        self.root, self.size, self.made = list(range(n)), [1] * n, []

    def find(self, v: int) -> int:
        while self.root[v] != v:
            self.root[v] = v = self.root[self.root[v]]
        return v

    def union(self, a: int, b: int) -> None:
        p, q = self.find(a), self.find(b)
        if p != q:
            if self.size[p] < self.size[q]:
                p, q = q, p
            self.root[q] = p
            self.size[p] += self.size[q]
            self.made.append((a, b))


def cluster_links(sets: list[np.ndarray], side: np.ndarray, pct: int) -> list[tuple[int, int]]:
    """A spanning forest of the links between sets, as pairs of places. ``side``: 0 or 1; if both occur,
    only pairs of different sides are compared (the others are another task's)."""
    m = len(sets)
    n = np.array([len(x) for x in sets])
    doc = np.repeat(np.arange(m), n)
    items, item = np.unique(np.concatenate(sets), return_inverse=True)
    df = np.bincount(item)
    order = np.argsort(item, kind="stable")
    posting, first = doc[order].astype(np.int32), np.concatenate([[0], np.cumsum(df)])
    start = np.concatenate([[0], np.cumsum(n)])
    cross = side.min() != side.max()
    trees = _Trees(m)

    def count(x: int) -> None:
        t = item[start[x] : start[x + 1]]
        t = t[df[t] > 1]
        if not len(t):
            return
        both = np.bincount(np.concatenate([posting[first[k] : first[k + 1]] for k in t]), minlength=m)
        hit = 100 * both >= pct * (n[x] + n - both)
        if cross:
            hit &= side != side[x]
        for y in np.flatnonzero(hit):
            trees.union(x, int(y))

    # central: many shingles that most sets share, few others
    common = np.bincount(doc, weights=np.where(2 * df[item] > m, 1.0, -1.0), minlength=m)
    lead = np.argsort(-common, kind="stable")[:PIVOTS]
    for x in lead:
        count(int(x))
    root = np.array([trees.find(v) for v in range(m)])
    main = np.bincount(root).argmax()
    for x in np.flatnonzero(root != main):
        # what is not counted yet and has not joined the largest component is counted against all
        if x not in lead and trees.find(int(x)) != trees.find(int(main)):
            count(int(x))
    return trees.made


def _solve(pct: int):
    """Rows sorted by task (cluster, i, j): the links of each task's sets."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        now, nodes, sets, side = None, [], [], []

        def close() -> pa.RecordBatch:
            made = cluster_links(sets, np.array(side), pct) if len(sets) > 1 else []
            pairs = [sorted((nodes[a], nodes[b])) for a, b in made]
            return pa.RecordBatch.from_arrays([pa.array([p[0] for p in pairs], pa.binary()), pa.array([p[1] for p in pairs], pa.binary())], names=["a", "b"])

        for batch in batches:
            cols = [batch.column(c).to_pylist() for c in ("cluster", "i", "j", "block", "node")]
            for k, (cluster, i, j, block, node) in enumerate(zip(*cols, strict=True)):
                if (cluster, i, j) != now:
                    yield close()
                    now, nodes, sets, side = (cluster, i, j), [], [], []
                nodes.append(node)
                sets.append(np.frombuffer(batch.column("items")[k].as_py(), np.uint64))
                side.append(int(i != j and block == j))
        yield close()

    return run


def _forest(batches) -> Iterator[pa.RecordBatch]:
    """Union-find over one partition's links; returns a star for each of its trees."""
    root: dict[bytes, bytes] = {}

    def find(v):
        while root.setdefault(v, v) != v:
            root[v] = v = root[root[v]]
        return v

    for batch in batches:
        for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True):
            p, q = find(a), find(b)
            if p != q:
                root[max(p, q)] = min(p, q)
    pairs = [(find(v), v) for v in list(root) if find(v) != v]
    for at in range(0, len(pairs), 50_000):
        part = pairs[at : at + 50_000]
        yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in part], pa.binary()), pa.array([v for _, v in part], pa.binary())], names=["a", "b"])


def components(edges: DataFrame) -> DataFrame:
    """Connected components of a written table ``edges(a, b)`` as ``(v, root)``, root being a component's
    smallest node.

    Each task reduces up to ``FOREST_LINKS`` links to a union-find forest; if one task held them all,
    its stars are the components. Else every round maps each node to its smallest neighbour and
    contracts the links; the maps are then composed. Links and maps never reach the driver."""
    tasks = -(-edges.count() // FOREST_LINKS)
    edges = edges.select("a", "b")
    if tasks <= 1:
        return written(edges.coalesce(1).mapInArrow(_forest, "a binary, b binary").select(F.col("b").alias("v"), F.col("a").alias("root")), "components")
    edges = written(edges.repartition(tasks).mapInArrow(_forest, "a binary, b binary"), "links")
    maps = []
    while not edges.isEmpty():
        both = edges.select(F.col("a").alias("v"), F.col("b").alias("w")).unionByName(edges.select(F.col("b").alias("v"), F.col("a").alias("w")))
        step = written(both.groupBy("v").agg(F.least(F.min("w"), F.col("v")).alias("root")), "links-step")
        maps.append(step)
        left = step.select(F.col("v").alias("a"), F.col("root").alias("ra"))
        right = step.select(F.col("v").alias("b"), F.col("root").alias("rb"))
        edges = written(edges.join(left, "a").join(right, "b").where("ra <> rb").select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct(), "links")
    out = maps[0]
    for step in maps[1:]:
        out = out.join(step.select(F.col("v").alias("root"), F.col("root").alias("next")), "root", "left").select("v", F.coalesce("next", "root").alias("root"))
    return written(out, "components")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, threshold_pct: int = 80, bands: int = 24, rows: int = 4) -> DataFrame:
    """Rows ``(id, __th, node, n_shingles, component_id, kept)``, one for each row of ``docs``.

    Texts are lower-cased (A-Z) and split at ASCII white space. Two documents are linked if their
    shingle sets have ``100 * intersection >= threshold_pct * union``. ``component_id`` is the smallest
    id reachable over links; ``kept`` is ``id = component_id``. ``node`` is the set's fingerprint and
    ``__th`` the text's hash: both together tell rows with the same id apart.

    * null or empty text, or no words: empty set, no links, its own component, kept;
    * fewer words than ``words``: one shingle of the whole sequence;
    * null id: it takes part; a component of null ids only has a null ``component_id`` and is kept;
    * repeated rows: equal sets, so one component; each row is returned; other columns are ignored.
    """
    src = docs.select(F.col(id_col).alias(id_col), F.xxhash64(F.col(text_col)).alias("__th"), F.col(text_col).alias("__text"))
    id_type = docs.schema[id_col].dataType.simpleString()
    signed = written(src.mapInArrow(_sign(words, bands * rows, rows), f"{id_col} {id_type}, {SIGNATURE}"), "signatures")

    sets = signed.where("node IS NOT NULL")
    holder = F.min(F.struct(F.col(id_col).isNull().alias("no_id"), F.col(id_col), F.col("__th")))
    nodes = written(sets.groupBy("node").agg(F.first("n_shingles").alias("n"), F.first("bands").alias("bands"), holder.alias("h")), "nodes")
    slots = nodes.select("node", "n", F.explode("bands").alias("bucket"))
    shared = slots.groupBy("bucket").agg(F.count("*").alias("c")).where("c > 1").select("bucket")
    member = written(slots.join(shared, "bucket"), "members")

    near = member.select("node").distinct().join(nodes, "node").select("h.*").withColumnRenamed(id_col, "__id")
    same = F.col(id_col).eqNullSafe(F.col("__id")) & (src["__th"] == near["__th"])
    texts = src.join(near, same, "left_semi").select("__text")
    items = texts.mapInArrow(_blobs(words), "node binary, items binary").groupBy("node").agg(F.min("items").alias("items"))

    star = member.groupBy("bucket").agg(F.min("node").alias("a")).join(member, "bucket").where("a <> node").select("a", F.col("node").alias("b")).distinct()
    cluster = components(written(star, "stars")).select(F.col("v").alias("node"), F.col("root").alias("cluster"))
    cluster = written(cluster.unionByName(cluster.select(F.col("cluster").alias("node"), "cluster")).distinct(), "clusters")
    weight = cluster.join(member.select("node", "n").distinct(), "node").groupBy("cluster").agg(F.ceil(F.sum("n") / F.lit(BLOCK_ITEMS)).cast("int").alias("k"))
    block = F.pmod(F.xxhash64("node"), F.col("k")).cast("int")
    dealt = cluster.join(weight, "cluster").withColumn("block", block).join(items, "node")
    # a node goes to the tasks of its block with each other one; most clusters have one block
    dealt = dealt.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
    dealt = dealt.select("cluster", F.least("block", "o").alias("i"), F.greatest("block", "o").alias("j"), "block", "node", "items")
    width = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    linked = dealt.repartition(width, "cluster", "i", "j").sortWithinPartitions("cluster", "i", "j", "node").mapInArrow(_solve(threshold_pct), "a binary, b binary")
    roots = components(written(linked, "linked"))

    named = sets.select(id_col, "node").join(roots, F.col("node") == F.col("v"), "left").select(id_col, F.coalesce("root", "node").alias("node"))
    smallest = named.groupBy("node").agg(F.min(id_col).alias("component_id")).withColumnRenamed("node", "root")
    label = nodes.select("node").join(roots, F.col("node") == F.col("v"), "left").select("node", F.coalesce("root", "node").alias("root"))
    label = label.join(smallest, "root")
    out = signed.select(id_col, "__th", "node", "n_shingles").join(label, "node", "left")
    out = out.withColumn("component_id", F.when(F.col("node").isNull(), F.col(id_col)).otherwise(F.col("component_id")))
    return out.withColumn("kept", F.col(id_col).eqNullSafe(F.col("component_id")))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs``, all columns, with one row of each near-duplicate component: that of the smallest id.

    Rows without words all stay. Where several rows of a component share the smallest id, the one with
    the smallest text hash stays, once; a component of null ids keeps one row in the same way."""
    found = written(near_duplicates(docs, id_col, text_col, **options).where("kept"), "kept")
    one = found.where("node IS NOT NULL").groupBy("root").agg(F.min(F.struct(id_col, "__th")).alias("k"), F.count("*").alias("__rows")).select(F.col(f"k.{id_col}").alias("__id"), F.col("k.__th").alias("__h"), "__rows")
    keyed = docs.withColumn("__key", F.xxhash64(F.col(text_col)))
    mine = keyed.join(one, F.col(id_col).eqNullSafe(F.col("__id")) & (F.col("__key") == F.col("__h")))
    single = mine.where("__rows = 1").select(*docs.columns)
    if not one.where("__rows > 1").isEmpty():
        single = single.unionByName(mine.where("__rows > 1").dropDuplicates(["__id", "__h"]).select(*docs.columns))
    bare = docs.where(F.col(text_col).isNull() | ~F.col(text_col).rlike(r"[^\x20\x09-\x0D]"))
    return single.unionByName(bare)


def op7_near_duplicates(spark, sf_dir: str) -> DataFrame:
    """Contract query: links at 100 * intersection >= 85 * union over the whole documents table."""
    return near_duplicates(table(spark, sf_dir, "documents"), threshold_pct=85).select("doc_id", "n_shingles", "component_id", "kept")


ORACLE_OP7 = """
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws
  FROM documents),
g AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
    ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i : i + 4], ' ')) END) AS g FROM w),
n AS (SELECT doc_id, count(g) AS n FROM w LEFT JOIN g USING (doc_id) GROUP BY doc_id),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM g a JOIN g b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
link AS (SELECT a, b FROM common JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
reach(doc_id, other) AS (
  SELECT doc_id, doc_id FROM n UNION SELECT reach.doc_id, link.b FROM reach JOIN link ON link.a = reach.other)
SELECT doc_id, n.n AS n_shingles, min(other) AS component_id, min(other) = doc_id AS kept FROM reach JOIN n USING (doc_id) GROUP BY doc_id, n.n"""
