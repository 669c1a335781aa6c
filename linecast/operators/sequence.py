"""Skew-safe ordered operators: previous row (``lag``) and as-of lookup.

A plain ``Window.partitionBy(key)`` puts every row of a key in one task; one hot game (a third
of all rows) would then be one task. Here each key is cut into segments of its order:

1. window over ``(key, segment)`` - the single shuffle of the big input;
2. one summary row per ``(key, segment)``, aggregated map-side from the (column-pruned) input, so
   only one row per key and segment crosses the network;
3. a window over the small summary carries the last value of earlier segments forward;
4. the carry is joined back on ``(key, segment)``: the big side is already partitioned on those
   keys, so only the summary moves (or is broadcast when AQE measures it small).

The result equals the whole-key window exactly. ``segment_seconds="auto"``, the default, cuts hot keys
at equal depth: about ``SAMPLES`` rows of every ``target_rows`` are sampled in one pruned pass without
a large shuffle, and a key with more samples than that gets every ``SAMPLES``-th as a bound. A row finds
its segment by binary search among its key's bounds. Bounds are values of the whole order (time and
tie-breaks), so neither a stray time, nor null times, nor many rows at one instant leave a segment
above twice the target. Without a hot key there are no segments: one plain window, one scan.
A number of seconds cuts all keys into segments of that width instead.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEY = "__seq_key"
SEG = "__seq_seg"
ORD = "__seq_ord"
DEFAULT_SEGMENT_SECONDS = 3600
DEFAULT_TARGET_ROWS = 1_000_000
#: Sampled rows that a segment of a hot key holds; the depth of segments varies by 1 / sqrt(SAMPLES).
SAMPLES = 32
#: Bounds that are broadcast; more go through a join that adaptive execution splits where it is skewed.
BROADCAST_BOUNDS = 1_000_000
#: An input is not sampled if it stays below the target even when its files are so many times compressed.
COMPRESSION = 16
_MIN_SEG = -(2**63)


def segment_of(ts: Column | str, segment_seconds: int) -> Column:
    """Integer time segment of a timestamp; null times go first, like nulls in an ascending sort."""
    c = F.col(ts) if isinstance(ts, str) else ts
    seg = F.floor(F.unix_micros(c.cast("timestamp")) / F.lit(int(segment_seconds) * 1_000_000))
    return F.coalesce(seg, F.lit(_MIN_SEG).cast("long"))


def _keyed(df: DataFrame, keys: Sequence[str], *more: Column) -> DataFrame:
    # The key columns travel once, inside one struct: a struct key compares null fields as equal
    # (null keys group together as in a window) and plain equality on it keeps the join keys
    # identical to the window's partitioning, so the big side is never shuffled a second time.
    rest = [F.col(c) for c in df.columns if c not in keys]
    return df.select(*rest, F.struct(*[F.col(k) for k in keys]).alias(KEY), *more)


def _may_hold_hot_keys(df: DataFrame, target_rows: int) -> bool:
    from linecast.session import estimated_bytes

    return estimated_bytes(df) * COMPRESSION >= target_rows * max(int(df._jdf.schema().defaultSize()), 1)


def hot_bounds(keyed: DataFrame, target_rows: int) -> tuple[DataFrame, int] | None:
    """Bounds of the hot keys of rows ``(KEY, ORD)``: one row per hot key with the sorted bounds that cut
    it into segments of about ``target_rows`` rows, and the steps a binary search of them takes. None
    without hot keys. At most ``SAMPLES / target_rows`` of the rows are gathered."""
    from linecast.session import ensure_checkpoint_dir

    if not _may_hold_hot_keys(keyed, target_rows):
        return None
    sample = keyed.select(KEY, ORD).where(F.rand(17) < SAMPLES / target_rows)
    per_key = sample.groupBy(KEY).agg(F.sort_array(F.collect_list(ORD)).alias("__s")).where(F.size("__s") > SAMPLES)
    bounds = per_key.select(KEY, F.filter("__s", lambda x, i: i % SAMPLES == SAMPLES - 1).alias("__bounds"))
    # Stored once in the shared checkpoint folder, so that all uses see the same sample.
    ensure_checkpoint_dir(keyed.sparkSession)
    bounds = bounds.checkpoint(eager=True)
    most, total = bounds.agg(F.max(F.size("__bounds")), F.sum(F.size("__bounds"))).first()
    if most is None:
        return None
    return (F.broadcast(bounds) if total <= BROADCAST_BOUNDS else bounds), int(most).bit_length()


def numbered(keyed: DataFrame, bounds: tuple[DataFrame, int]) -> DataFrame:
    """Add ``SEG``: how many bounds of its key are at or below the row (0 for keys that are not hot)."""
    table, steps = bounds
    out = keyed.join(table, on=KEY, how="left").withColumn(SEG, F.lit(0))
    for k in reversed(range(steps)):
        at = F.col(SEG) + F.lit(1 << k)
        # A place beyond the last bound is null, and the row stays below it.
        out = out.withColumn(SEG, F.when(F.get("__bounds", at - 1) <= F.col(ORD), at).otherwise(F.col(SEG)))
    return out.drop("__bounds")


def _unkey(keys: Sequence[str], columns: Sequence[str]) -> list[Column]:
    """Original column order, key columns taken back out of the struct key."""
    return [F.col(KEY)[c].alias(c) if c in keys else F.col(c) for c in columns]


def segmented_lag(
    df: DataFrame,
    keys: Sequence[str],
    ts: str,
    order: Sequence[str],
    values: Sequence[str],
    prefix: str = "prev_",
    segment_seconds: int | str = "auto",
    target_rows: int = DEFAULT_TARGET_ROWS,
) -> DataFrame:
    """Add ``prefix+v`` = value of ``v`` in the previous row of the same key ordered by ``order``.

    ``order`` must start with ``ts`` and should end in a unique tie-break for a deterministic result.
    """
    w = Window.partitionBy(*keys).orderBy(*[F.col(o).asc_nulls_first() for o in order])
    if segment_seconds == "auto":
        base = _keyed(df, keys, F.struct(*[F.col(o) for o in order]).alias(ORD))
        bounds = hot_bounds(base, target_rows)
        if bounds is None:
            return df.select("*", *[F.lag(v, 1).over(w).alias(prefix + v) for v in values])
        base = numbered(base, bounds).drop(ORD)
    else:
        base = _keyed(df, keys, segment_of(ts, int(segment_seconds)).alias(SEG))
    w = Window.partitionBy(KEY, SEG).orderBy(*[F.col(o).asc_nulls_first() for o in order])
    lags = [F.lag(F.col(v), 1).over(w).alias(f"__lag{i}") for i, v in enumerate(values)]
    local = base.select("*", F.lag(F.lit(True), 1).over(w).alias("__has"), *lags)

    # Last row of every non-empty segment: partial aggregation before its (small) shuffle.
    order_struct = F.struct(*[F.col(o) for o in order])
    seg_last = base.groupBy(KEY, SEG).agg(F.max_by(F.struct(*[F.col(v) for v in values]), order_struct).alias("__last"))
    carry = seg_last.select(KEY, SEG, F.lag("__last", 1).over(Window.partitionBy(KEY).orderBy(SEG)).alias("__carry"))

    joined = local.join(carry, on=[KEY, SEG], how="left")
    first = F.col("__has").isNull()
    prev = [F.when(first, F.col("__carry")[v]).otherwise(F.col(f"__lag{i}")).alias(prefix + v) for i, v in enumerate(values)]
    return joined.select(*_unkey(keys, df.columns), *prev)


def segmented_asof(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    left_ts: str,
    right_ts: str,
    right_values: Sequence[str],
    right_tie: Sequence[str] = (),
    how: str = "inner",
    segment_seconds: int | str = "auto",
    target_rows: int = DEFAULT_TARGET_ROWS,
) -> DataFrame:
    """As-of join: each left row gets the right row of the same key with the greatest
    ``(right_ts, *right_tie)`` such that ``right_ts <= left_ts``.

    Both sides are unioned and sorted together inside ``(key, segment)``; no pair of rows is ever
    materialised, so output size equals the left input. ``how='inner'`` drops left rows with no
    earlier right row; ``'left'`` keeps them with nulls.
    """
    lcols = left.columns
    # A poll without time is before or after nothing, and a left row without time has no partner.
    right = right.where(F.col(right_ts).isNotNull())
    if how == "inner":
        left = left.where(F.col(left_ts).isNotNull())
    fixed = segment_seconds != "auto"

    def side(df: DataFrame, ts: str, number: int, *more: Column) -> DataFrame:
        seg = [segment_of(ts, int(segment_seconds)).alias(SEG)] if fixed else []
        t = F.col(ts).cast("timestamp").alias("__t")
        return df.select(F.struct(*[F.col(k) for k in keys]).alias(KEY), *seg, t, F.lit(number).alias("__side"), *more)

    l_prep = side(left, left_ts, 1, F.struct(*[F.col(c) for c in lcols if c not in keys]).alias("__l"))
    tie = F.struct(*[F.col(t) for t in right_tie]) if right_tie else F.lit(0)
    r_prep = side(right, right_ts, 0, tie.alias("__tie"), F.struct(*[F.col(v) for v in right_values]).alias("__v"))
    both = l_prep.unionByName(r_prep, allowMissingColumns=True)
    part = [KEY, SEG]
    if not fixed:
        # Left rows of one instant need no order among them; a hash of the row lets them be cut apart.
        order = F.struct("__t", "__side", "__tie", F.when(F.col("__side") == 1, F.xxhash64("__l")).alias("h"))
        both = both.withColumn(ORD, order)
        bounds = hot_bounds(both, target_rows)
        if bounds is None:
            part = [KEY]
        else:
            both = numbered(both, bounds)
        both = both.drop(ORD)

    # Right rows sort before left rows at equal time (<=), then by their tie-break.
    w = (
        Window.partitionBy(*part)
        .orderBy(F.col("__t").asc_nulls_first(), "__side", "__tie")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    filled = both.withColumn("__loc", F.last("__v", ignorenulls=True).over(w))
    lefts = filled.where(F.col("__side") == 1)

    if SEG in part:
        # One summary row for every non-empty segment (left-only segments too), holding the last
        # right value inside it; max_by skips the rows whose ordering is null (the left rows).
        is_right = F.col("__side") == 0
        seg_last = filled.groupBy(KEY, SEG).agg(F.max_by("__v", F.when(is_right, F.struct("__t", "__tie"))).alias("__last"))
        wc = Window.partitionBy(KEY).orderBy(SEG).rowsBetween(Window.unboundedPreceding, -1)
        carry = seg_last.select(KEY, SEG, F.last("__last", ignorenulls=True).over(wc).alias("__carry"))
        joined = lefts.join(carry, on=[KEY, SEG], how="left")
        found = F.coalesce(F.col("__loc"), F.col("__carry"))
    else:
        joined, found = lefts, F.col("__loc")
    v = F.when(F.col("__t").isNotNull(), found)
    left_cols = [F.col(KEY)[c].alias(c) if c in keys else F.col("__l")[c].alias(c) for c in lcols]
    out = joined.select(*left_cols, *[v[x].alias(x) for x in right_values], v.isNotNull().alias("__hit"))
    if how == "inner":
        out = out.where("__hit")
    elif how != "left":
        raise ValueError(f"unsupported as-of join type: {how}")
    return out.drop("__hit")
