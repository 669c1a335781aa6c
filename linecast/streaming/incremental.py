"""Incremental (streaming) forms of the signal jobs.

``lag`` is not available on a streaming frame, so sharp money runs per micro-batch in
``foreachBatch``: the batch's rows are unioned with the last row of every series kept in a small
state table, the batch job runs on that union, and the new last rows become the next state.

Exactly-once: the output of batch ``n`` is written to partition ``batch_id=n`` with dynamic
overwrite and the state to ``v=n``; a replayed batch reads state ``< n`` and overwrites its own
partitions, so retries and restarts do not duplicate rows. Rows arriving later than the state of
their series go to a side output, or, with :func:`sharp_money_changes`, correct the signals they
change: its output is a log of signals with a signed ``change``, whose sums are the batch job's signals.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from linecast.functions.odds import MAJOR_BOOKS, SHARP_MONEY_THRESHOLD
from linecast.functions.timefn import with_timestamp
from linecast.operators.movement import SERIES_KEYS, sharp_money
from linecast.operators.odds import major_books
from linecast.operators.serving import latest_by
from linecast.sources.tables import folder_exists
from linecast.streaming.ingest import _trigger


def _read_state(spark: SparkSession, state_path: str, batch_id: int) -> DataFrame | None:
    """State of the last batch before ``batch_id``. Two slots are kept, so a replayed batch still finds
    its predecessor's. No folder means no state yet; any other failure is one."""
    if not folder_exists(spark, state_path):
        return None
    before = spark.read.parquet(state_path).where(F.col("v") < batch_id)
    last = before.select(F.max("v")).scalar()
    return before.where(F.col("v") == last).drop("v", "slot")


def sharp_money_batch(
    spark: SparkSession,
    batch: DataFrame,
    batch_id: int,
    out_path: str,
    state_path: str,
    books: Sequence[str] | None = MAJOR_BOOKS,
    threshold: float = SHARP_MONEY_THRESHOLD,
    computed_at: Column | None = None,
    keys: Sequence[str] = SERIES_KEYS,
    tie: Sequence[str] = (),
    late_path: str | None = None,
) -> None:
    """One micro-batch of incremental sharp money (flat odds in, signal rows appended)."""
    rows = with_timestamp(major_books(batch, books), "ingested_at", "__ts").persist()
    order = ["__ts", *tie]
    prev = _read_state(spark, state_path, batch_id)
    if prev is not None:
        last = prev.select(*keys, F.struct(*order).alias("__last"))
        now = F.struct(*order)
        # One state row per series: the join neither multiplies nor drops rows.
        same = [rows[k].eqNullSafe(last[k]) for k in keys]
        tagged = rows.join(last, same, "left").select(*[rows[c] for c in rows.columns], F.coalesce(now < F.col("__last"), F.lit(False)).alias("__late"))
        late, fresh = tagged.where("__late").drop("__late", "__ts"), tagged.where(~F.col("__late")).drop("__late")
        both = prev.select(*rows.columns).unionByName(fresh).persist()
    else:
        late, both = None, rows
    try:
        # State rows are the oldest of their series (late rows are out), so none is a "current" row.
        signals = sharp_money(both.drop("__ts"), books=None, threshold=threshold, computed_at=computed_at, keys=keys, tie=tie)
        _write_batch(signals, out_path, batch_id)
        if late is not None and late_path is not None:
            _write_batch(late, late_path, batch_id)
        state = latest_by(both, list(keys), order)
        state = state.withColumn("v", F.lit(batch_id)).withColumn("slot", F.lit(batch_id % 2))
        state.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("slot").parquet(state_path)
    finally:
        both.unpersist()
        rows.unpersist()


def _write_batch(df: DataFrame, path: str, batch_id: int) -> None:
    w = df.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    w.partitionBy("batch_id").parquet(path)


def incremental_sharp_money(
    spark: SparkSession,
    odds_stream: DataFrame,
    out_path: str,
    state_path: str,
    checkpoint: str,
    trigger: str | None = "availableNow",
    **kw,
) -> StreamingQuery:
    """Start the incremental sharp-money stream over a stream of flat odds rows."""

    def handle(batch: DataFrame, batch_id: int) -> None:
        sharp_money_batch(spark, batch, batch_id, out_path, state_path, **kw)

    w = odds_stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
    return _trigger(w, trigger).start()


CHANGE = "change"


def _series(keys: Sequence[str]) -> Column:
    # A struct compares null fields as equal, so plain equality on it joins null keys too.
    return F.struct(*[F.col(k) for k in keys]).alias("__series")


def sharp_money_changes_batch(
    spark: SparkSession,
    batch: DataFrame,
    batch_id: int,
    out_path: str,
    state_path: str,
    computed_at: Column,
    delay_seconds: int = 24 * 3600,
    books: Sequence[str] | None = MAJOR_BOOKS,
    threshold: float = SHARP_MONEY_THRESHOLD,
    keys: Sequence[str] = SERIES_KEYS,
    tie: Sequence[str] = (),
    late_path: str | None = None,
) -> None:
    """One micro-batch of :func:`sharp_money_changes`.

    The state is each series' history: its rows of the last ``delay_seconds`` of event time and the one
    row before them. The signals of the series that the batch touches are computed over the history
    without the batch and with it; what only the first has is cancelled (``change`` -1), what only the
    second has is added (+1). A late row so cancels its successor's move and adds two. Rows that are late by
    more than the delay, and rows without time, change nothing and go to ``late_path``.
    """
    rows = with_timestamp(major_books(batch, books), "ingested_at", "__ts").persist()
    prev = _read_state(spark, state_path, batch_id)
    prev = rows.limit(0) if prev is None else prev.select(*rows.columns).persist()
    delay = F.make_dt_interval(secs=F.lit(delay_seconds))
    horizon = prev.select((F.max("__ts") - delay).alias("__from")).scalar()
    in_time = F.col("__ts").isNotNull() & F.coalesce(F.col("__ts") >= horizon, F.lit(True))
    fresh = rows.where(in_time).persist()
    try:
        touched = fresh.select(_series(keys)).distinct()
        before = prev.withColumn("__series", _series(keys)).join(touched, "__series", "left_semi").drop("__series")

        def signals(of: DataFrame, sign: int) -> DataFrame:
            out = sharp_money(of.drop("__ts"), books=None, threshold=threshold, computed_at=computed_at, keys=keys, tie=tie)
            return out.withColumn("__sign", F.lit(sign))

        both = signals(before.unionByName(fresh), 1).unionByName(signals(before, -1))
        columns = [c for c in both.columns if c != "__sign"]
        changes = both.groupBy(*columns).agg(F.sum("__sign").cast("int").alias(CHANGE)).where(F.col(CHANGE) != 0)
        _write_batch(changes, out_path, batch_id)
        if late_path is not None:
            _write_batch(rows.where(~in_time).drop("__ts"), late_path, batch_id)
        history = prev.unionByName(fresh)
        kept_from = history.select((F.max("__ts") - delay).alias("__from")).scalar()
        recent = history.where(F.col("__ts") >= kept_from)
        anchors = latest_by(history.where(F.col("__ts") < kept_from), list(keys), ["__ts", *tie])
        state = recent.unionByName(anchors.select(*recent.columns))
        state = state.withColumn("v", F.lit(batch_id)).withColumn("slot", F.lit(batch_id % 2))
        state.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("slot").parquet(state_path)
    finally:
        for frame in (fresh, prev, rows):
            frame.unpersist()


def sharp_money_changes(
    spark: SparkSession,
    odds_stream: DataFrame,
    out_path: str,
    state_path: str,
    checkpoint: str,
    computed_at: Column,
    trigger: str | None = "availableNow",
    **kw,
) -> StreamingQuery:
    """Sharp money over a stream of flat odds rows that may arrive in any order within a delay: a log of
    signal rows with a signed ``change``. ``computed_at`` is an expression of the row, so that a cancelled
    signal carries the batch time it was written with. :func:`current_signals` sums the log."""

    def handle(batch: DataFrame, batch_id: int) -> None:
        sharp_money_changes_batch(spark, batch, batch_id, out_path, state_path, computed_at, **kw)

    w = odds_stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
    return _trigger(w, trigger).start()


def current_signals(changes: DataFrame) -> DataFrame:
    """The signals that a log of changes leaves, each as often as its changes sum to."""
    columns = [c for c in changes.columns if c not in (CHANGE, "batch_id")]
    net = changes.groupBy(*columns).agg(F.sum(CHANGE).alias("__n")).where("__n > 0")
    return net.withColumn("__n", F.explode(F.sequence(F.lit(1).cast("long"), "__n"))).drop("__n")


def corroboration_stream(
    sharp_stream: DataFrame,
    window: str = "2 minutes",
    watermark: str = "10 minutes",
    min_books: int = 2,
    ts: str = "ingested_at_ts",
) -> DataFrame:
    """W5 on a stream: flagged moves grouped by game, team, direction and tumbling window after a
    watermark; the set of moving books per window is bounded by the number of bookmakers."""
    # Watermarks need an instant type; wall-clock (NTZ) times are read as UTC.
    df = sharp_stream.where(F.col("is_sharp_signal")).withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, watermark)
    g = df.groupBy("sport_key", "home_team", "away_team", "team", "movement_direction", F.window(ts, window).alias("w")).agg(
        F.collect_set("bookmaker_key").alias("books"), F.count(F.lit(1)).alias("n_moves"), F.max("prob_movement").alias("max_prob_movement")
    )
    return g.select(
        "sport_key",
        "home_team",
        "away_team",
        "team",
        "movement_direction",
        F.col("w.start").cast("timestamp_ntz").alias("window_start"),
        F.col("w.end").cast("timestamp_ntz").alias("window_end"),
        F.size("books").cast("long").alias("n_books"),
        "n_moves",
        "max_prob_movement",
        (F.size("books") >= min_books).alias("is_corroborated"),
    )


def ticker_stream(
    game_stream: DataFrame,
    sport_dim: DataFrame,
    team_dim: DataFrame,
    out_path: str,
    checkpoint: str,
    markets: DataFrame | None = None,
    tz: str = "America/New_York",
    order: Sequence[str] = ("ingested_at",),
    trigger: str | None = "availableNow",
) -> StreamingQuery:
    """Chained stream (game events drive the market lookup): per micro-batch, the last record of
    each game (W4), its event ticker (J3) and, given a market table, its markets (J4, a
    stream-static join). Output partitioned by batch id with dynamic overwrite (idempotent)."""
    from linecast.operators.boards import drain_latest
    from linecast.operators.dims import games_to_tickers, ticker_lookup

    def handle(batch: DataFrame, batch_id: int) -> None:
        tickers = games_to_tickers(drain_latest(batch, order=order), sport_dim, team_dim, tz=tz)
        out = tickers if markets is None else ticker_lookup(tickers, markets)
        (
            out.withColumn("batch_id", F.lit(batch_id))
            .write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .partitionBy("batch_id")
            .parquet(out_path)
        )

    w = game_stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
    return _trigger(w, trigger).start()
