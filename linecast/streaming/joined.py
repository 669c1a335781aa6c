"""Streams with bounded state: messages delivered twice (W3), and game events joined to quotes that are a
stream as well (2.9). State goes when a watermark has passed it, so its size follows the delay, not the
length of the stream."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from linecast.streaming.ingest import _trigger


def _event_time(df: DataFrame, ts: str, delay: str) -> DataFrame:
    # Watermarks need an instant; wall-clock times are read as UTC.
    return df.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, delay)


def first_deliveries(stream: DataFrame, keys: Sequence[str], ts: str, delay: str) -> DataFrame:
    """The first delivery of each message; a repeat within ``delay`` of event time is dropped, and so is one
    that comes later than that (it is behind the watermark)."""
    return _event_time(stream, ts, delay).dropDuplicatesWithinWatermark(list(keys))


def dedup_stream(
    stream: DataFrame, dst: str, checkpoint: str, keys: Sequence[str], ts: str, delay: str = "10 minutes", trigger: str | None = "availableNow"
) -> StreamingQuery:
    """W3 as a stream: each message once in the Parquet table ``dst``, exactly once through its checkpoint.
    Dropped repeats are counted by the query's state operator (:func:`dropped_repeats`)."""
    kind = stream.schema[ts].dataType
    once = first_deliveries(stream, keys, ts, delay).withColumn(ts, F.col(ts).cast(kind))
    return _trigger(once.writeStream.format("parquet").option("checkpointLocation", checkpoint).outputMode("append"), trigger).start(dst)


def dropped_repeats(query: StreamingQuery) -> dict[str, int]:
    """Of the progress reports that a query still holds: repeats dropped by their key, and rows dropped
    because they came behind the watermark."""
    out = {"repeats": 0, "late": 0}
    for report in query.recentProgress:
        for op in report["stateOperators"]:
            out["repeats"] += int(op.get("customMetrics", {}).get("numDroppedDuplicateRows", 0))
            out["late"] += int(op.get("numRowsDroppedByWatermark", 0))
    return out


def quotes_near_games(
    games: DataFrame, quotes: DataFrame, keys: Sequence[str], game_ts: str, quote_ts: str, before: str, after: str, delay: str = "10 minutes"
) -> DataFrame:
    """Every game event with the quotes of its keys from ``before`` it until ``after`` it, whichever of the
    two arrives first. Both sides have a watermark of ``delay``; a row is held until no partner of it
    can still come, so state holds ``before + after + delay`` of each stream at most. Null keys match nothing.

    Time is cut into slots as long as the window: a game event looks into the two slots that its window
    touches and a quote is in one, so a row meets the rows of its keys near it, not all that state holds."""
    g, q = _event_time(games, game_ts, delay), _event_time(quotes, quote_ts, delay)
    g = g.withColumnsRenamed({k: f"__g_{k}" for k in keys})
    at = "timestamp_micros(0)"
    width = F.expr(f"greatest(abs(unix_micros({at} + INTERVAL {after}) - unix_micros({at} - INTERVAL {before})), 1000000)")

    def slot(ts: Column) -> Column:
        return F.floor((F.unix_micros(ts) - F.pmod(F.unix_micros(ts), width)) / width)

    first, last = (slot(F.col(game_ts) - F.expr(f"INTERVAL {before}")), slot(F.col(game_ts) + F.expr(f"INTERVAL {after}")))
    g = g.withColumn("__g_slot", F.explode(F.sequence(first, last)))
    q = q.withColumn("__slot", slot(F.col(quote_ts)))
    on = [F.col(f"__g_{k}") == F.col(k) for k in keys] + [F.col("__g_slot") == F.col("__slot")]
    on += [F.col(quote_ts) >= F.col(game_ts) - F.expr(f"INTERVAL {before}"), F.col(quote_ts) <= F.col(game_ts) + F.expr(f"INTERVAL {after}")]
    return g.join(q, on, "inner").drop(*[f"__g_{k}" for k in keys], "__g_slot", "__slot")


def join_quotes(
    games: DataFrame, quotes: DataFrame, dst: str, checkpoint: str, trigger: str | None = "availableNow", **kw
) -> StreamingQuery:
    """:func:`quotes_near_games` into the Parquet table ``dst``."""
    w = quotes_near_games(games, quotes, **kw).writeStream.format("parquet").option("checkpointLocation", checkpoint)
    return _trigger(w.outputMode("append"), trigger).start(dst)
