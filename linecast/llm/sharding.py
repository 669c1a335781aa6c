"""Sharding by extendible hashing: only oversized buckets split, on one more bit of the hash.

Method. A row's hash has 60 bits. The directory starts with one bucket of no bits; a bucket whose
bytes exceed the limit splits on the next bit, until every bucket fits. Rows of one hash can't be
split by bits: a bucket that is still too large at ``MAX_BITS`` becomes pages within the limit.

Scale. Bytes are summed per hash prefix with map-side aggregation, and deeper prefixes only for what
is still oversized. Documents find their bucket through the directory of ``STEP``-bit cells, broadcast
only when it is measured to be small, so texts are not shuffled. Pages number the rows of a hash per
written file part, so not even a third of all rows under one hash meets in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from linecast.llm.decontam import bounded
from linecast.llm.scratch import table, written

MAX_BITS = 60
STEP = 12


def row_hash(id_col: str, text_col: str):
    """The first 60 bits of md5 over id and text, so rows without id spread as well."""
    key = F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit("\n"), F.coalesce(F.col(text_col), F.lit("")))
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, 15), 16, 10).cast("long")


def bits(h, n):
    """The first ``n`` bits (a literal) of a hash."""
    return F.shiftright(h, MAX_BITS - n) if n else F.lit(0).cast("long")


def directory(sizes: DataFrame, limit: int) -> list[tuple[int, DataFrame]]:
    """Cells ``(cell, depth, shard_bytes)`` by their number of bits; ``depth`` is null where a cell
    itself is oversized and goes on in the next table. ``sizes`` has ``h`` and ``n_bytes``."""
    levels, done, open_ = [], 0, None
    while done < MAX_BITS:
        step = min(done + STEP, MAX_BITS)
        rows = sizes if open_ is None else sizes.join(open_, bits(F.col("h"), done) == F.col("open"), "left_semi")
        cells = written(rows.groupBy(bits(F.col("h"), step).alias("cell")).agg(F.sum("n_bytes").alias("b")), "cells")
        up = cells.select("cell", F.explode(F.sequence(F.lit(done + (done > 0)), F.lit(step))).alias("d"), "b")
        up = up.withColumn("prefix", F.expr(f"shiftright(cell, {step} - d)"))
        fits = up.groupBy("d", "prefix").agg(F.sum("b").alias("total")).where(F.col("total") <= limit)
        leaf = up.join(fits, ["d", "prefix"]).groupBy("cell").agg(F.min(F.struct("d", "total")).alias("m"))
        found = written(cells.join(leaf, "cell", "left").select("cell", F.col("m.d").alias("depth"), F.col("m.total").alias("shard_bytes")), "directory")
        levels.append((step, found))
        open_ = found.where("depth IS NULL").select(F.col("cell").alias("open"))
        if open_.isEmpty():
            break
        done = step
    return levels


def shard(docs: DataFrame, limit: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` plus ``shard`` (its hash bits as text; '' is the only bucket), ``depth`` (number of
    bits), ``page`` and ``n_bytes`` (UTF-8 bytes of the text), each ``(shard, page)`` within ``limit``.

    * null and empty texts have 0 bytes and belong to a shard like others;
    * a row larger than the limit has a page of its own; that is the only case over the limit;
    * rows of equal id and text share a hash; if they do not fit, they are paged (``page`` from 0);
    * a null id hashes as an empty one; an empty table gives no shards;
    * columns of ``docs`` named like an added one are replaced.
    """
    own = [c for c in docs.columns if c not in ("shard", "depth", "page", "n_bytes")]
    h, size = row_hash(id_col, text_col), F.coalesce(F.octet_length(F.col(text_col)), F.lit(0)).cast("long")
    sizes = written(docs.select(h.alias("h"), size.alias("n_bytes")), "sizes")
    out = docs.select(*own, h.alias("__h"), size.alias("n_bytes"))
    levels = directory(sizes, limit)
    depth = F.lit(None).cast("int")
    for n, found in levels:
        cells = bounded(found.where("depth IS NOT NULL").select(F.col("cell").alias(f"__cell{n}"), F.col("depth").alias(f"__depth{n}")), F.lit(24))
        out = out.join(cells, bits(F.col("__h"), n) == F.col(f"__cell{n}"), "left")
        depth = F.coalesce(depth, F.col(f"__depth{n}"))
    out = out.withColumn("__d", depth)
    name = F.substring(F.lpad(F.conv(F.col("__h").cast("string"), 10, 2), MAX_BITS, "0"), F.lit(1), F.coalesce(F.col("__d"), F.lit(MAX_BITS)))
    out = out.select(*own, "n_bytes", "__h", name.alias("shard"), F.coalesce(F.col("__d"), F.lit(MAX_BITS)).cast("int").alias("depth"), F.col("__d").isNull().alias("__over"))
    fits = out.where("NOT __over").drop("__over", "__h").withColumn("page", F.lit(0).cast("long"))
    if len(levels) * STEP < MAX_BITS or levels[-1][1].where("depth IS NULL").isEmpty():
        return fits.select(*own, "shard", "depth", "page", "n_bytes")

    rest = out.where("__over").withColumn("__part", F.spark_partition_id()).withColumn("__at", F.monotonically_increasing_id())
    rest = written(rest, "overflow")
    parts = rest.groupBy("__h", "__part").agg(F.count("*").alias("n"), F.max("n_bytes").alias("b"))
    before = F.sum("n").over(Window.partitionBy("__h").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
    most = F.max("b").over(Window.partitionBy("__h"))
    parts = parts.select(F.col("__h").alias("__ph"), F.col("__part").alias("__pp"), F.coalesce(before, F.lit(0)).alias("__before"), F.greatest(F.lit(1), F.floor(F.lit(limit) / most)).alias("__fit"))
    row = F.row_number().over(Window.partitionBy("__h", "__part").orderBy("__at")) - 1
    paged = rest.withColumn("__row", row).join(parts, (F.col("__h") == F.col("__ph")) & (F.col("__part") == F.col("__pp")))
    paged = paged.withColumn("page", F.floor((F.col("__before") + F.col("__row")) / F.col("__fit")).cast("long"))
    cols = [*own, "shard", "depth", "page", "n_bytes"]
    return fits.select(*cols).unionByName(paged.select(*cols))


#: Bytes of text in a shard.
SHARD_BYTES = 2 << 20


def op9_sharding(spark, sf_dir: str) -> DataFrame:
    """The shard of every document of the whole table."""
    return shard(table(spark, sf_dir, "documents"), SHARD_BYTES).select("doc_id", "shard", "depth", "page", "n_bytes")


ORACLE_OP9 = f"""
WITH d AS (SELECT doc_id, CAST(coalesce(strlen(text), 0) AS BIGINT) AS n_bytes, CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || chr(10) || coalesce(text, '')), 1, 15) AS BIGINT) AS h FROM documents),
p AS (SELECT n, h >> (60 - n) AS prefix, sum(n_bytes) AS b FROM d, (SELECT unnest(range(0, 61)) AS n) GROUP BY ALL),
leaf AS (SELECT d.doc_id, d.n_bytes, d.h, min(p.n) AS depth FROM d, p WHERE p.prefix = d.h >> (60 - p.n) AND p.b <= {SHARD_BYTES} GROUP BY ALL)
SELECT doc_id, CASE WHEN depth = 0 THEN '' ELSE substr(lpad(bin(h), 60, '0'), 1, CAST(depth AS INT)) END AS shard, CAST(depth AS INT) AS depth, CAST(0 AS BIGINT) AS page, n_bytes FROM leaf
"""
