"""Per-game boards, chart series and scoreboards (A4-A6, A8-A10, T5, T7, U2, W4, W5, F9-F11 frames).

Everything that the studied dashboard shaped in the browser becomes an aggregate here; per-game
"first row" picks are ``max_by`` aggregates and global maxima are scalar subqueries.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linecast.functions.odds import KALSHI_HIGHER, divergence_severity, sharp_severity
from linecast.functions.scores import (
    away_winning,
    competition_columns,
    competition_sides,
    event_columns,
    event_sides,
    home_winning,
    period_label,
)
from linecast.functions.text import series_key, ticker_suffix
from linecast.functions.timefn import with_timestamp
from linecast.operators.serving import latest_by

GAME_KEY_COLS = ("away_team", "home_team")


def _game_key():
    return F.concat_ws("|", F.col("away_team"), F.col("home_team"))


def divergence_game_board(feed: DataFrame, tie: Sequence[str] = ("market_ticker", "computed_at")) -> DataFrame:
    """A5 + F12: one row per game from its top row by divergence (the feed's first row)."""
    top = F.max_by(
        F.struct("sport_key", "commence_time", "divergence", "signal_direction", "market_ticker"),
        F.struct(F.col("divergence"), *[F.col(t) for t in tie]),
    )
    g = feed.groupBy(*GAME_KEY_COLS).agg(top.alias("__top"), F.count(F.lit(1)).alias("n_rows"))
    return g.select(
        _game_key().alias("game_key"),
        *GAME_KEY_COLS,
        F.col("__top.sport_key").alias("sport_key"),
        F.col("__top.commence_time").alias("commence_time"),
        F.col("__top.market_ticker").alias("top_market_ticker"),
        (F.col("__top.divergence") * 100.0).alias("divergence_pct"),
        F.col("__top.signal_direction").alias("signal_direction"),
        F.when(F.col("__top.signal_direction") == KALSHI_HIGHER, "up").otherwise("down").alias("arrow"),
        divergence_severity(F.col("__top.divergence")).alias("severity"),
        "n_rows",
    )


def sharp_game_board(feed: DataFrame, tie: Sequence[str] = ("bookmaker_key", "team", "computed_at")) -> DataFrame:
    """A4 + F12: per game the top row's probability move, the largest move and the severity."""
    top = F.max_by(
        F.struct("sport_key", "commence_time", "prob_movement", "movement_direction", "bookmaker_key", "team"),
        F.struct(F.col("prob_movement"), *[F.col(t) for t in tie]),
    )
    g = feed.groupBy(*GAME_KEY_COLS).agg(
        top.alias("__top"), F.max("prob_movement").alias("__max"), F.count(F.lit(1)).alias("n_rows")
    )
    return g.select(
        _game_key().alias("game_key"),
        *GAME_KEY_COLS,
        F.col("__top.sport_key").alias("sport_key"),
        F.col("__top.commence_time").alias("commence_time"),
        (F.col("__top.prob_movement") * 100.0).alias("top_move_pct"),
        (F.col("__max") * 100.0).alias("max_move_pct"),
        F.col("__top.movement_direction").alias("movement_direction"),
        (F.col("__max") * 100.0 >= 10.0).alias("sharp_flash"),
        sharp_severity(F.col("__top.prob_movement"), F.col("__max")).alias("severity"),
        "n_rows",
    )


def bar_share(board: DataFrame, value_col: str, out_col: str = "bar_share") -> DataFrame:
    """Value / max(max value over the board, 1) - the maximum is a scalar subquery."""
    mx = board.select(F.max(value_col)).scalar()
    return board.withColumn(out_col, F.col(value_col) / F.greatest(F.coalesce(mx, F.lit(1.0)), F.lit(1.0)))


def bars_desc(board: DataFrame, value_col: str) -> DataFrame:
    """Bar items by value descending (game key as tie-break)."""
    return bar_share(board, value_col).orderBy(F.col(value_col).desc_nulls_last(), "game_key")


def board_order(board: DataFrame, scoreboard: DataFrame | None, value_col: str) -> DataFrame:
    """T5 (+ J5): live games first, then upcoming ones by start time, then the rest (finished or
    without a score); inside each group by the board value as the feed listed them."""
    b = board
    if scoreboard is not None:
        sb = scoreboard.select(*GAME_KEY_COLS, F.col("state").alias("score_state"))
        b = b.join(sb, on=list(GAME_KEY_COLS), how="left")
    else:
        b = b.withColumn("score_state", F.lit(None).cast("string"))
    rank = F.when(F.col("score_state") == "in", 0).when(F.col("score_state") == "pre", 1).otherwise(2)
    b = b.withColumn("state_rank", rank)
    pre_start = F.when(F.col("state_rank") == 1, F.col("commence_time"))
    return b.orderBy("state_rank", pre_start.asc_nulls_last(), F.col(value_col).desc_nulls_last(), "game_key")


def pivot_divergence_long(history: DataFrame, tie: Sequence[str] = ()) -> DataFrame:
    """A8 (long form): per game and true minute, the last value of each market series
    (``kalshi_<ticker suffix>``) and of ``sportsbook_avg``. The studied chart bucketed by clock label
    (same minute on two days merged); true minutes are used here (quirk Q16)."""
    base = history.withColumn("minute", F.date_trunc("minute", F.col("computed_at")).cast("timestamp_ntz"))
    market = base.select(
        "home_team",
        "away_team",
        "minute",
        F.concat(F.lit("kalshi_"), ticker_suffix("market_ticker")).alias("series"),
        F.col("kalshi_implied_prob").alias("value"),
        "computed_at",
        *tie,
    )
    book = base.select(
        "home_team",
        "away_team",
        "minute",
        F.lit("sportsbook_avg").alias("series"),
        F.col("sportsbook_home_prob").alias("value"),
        "computed_at",
        *tie,
    )
    both = market.unionByName(book)
    order = ("computed_at", *tie)
    return latest_by(both, ["home_team", "away_team", "minute", "series"], order).drop(*order)


def pivot_odds_long(history: DataFrame, tie: Sequence[str] = ()) -> DataFrame:
    """A9 (long form): per game and minute, the last plausible odds of each ``team__bookmaker`` series."""
    from linecast.operators.serving import plausible_odds

    base = plausible_odds(history).withColumn("minute", F.date_trunc("minute", F.col("computed_at")).cast("timestamp_ntz"))
    s = base.select(
        "home_team",
        "away_team",
        "minute",
        series_key("team", "bookmaker_key").alias("series"),
        F.col("american_odds").cast("double").alias("value"),
        "computed_at",
        *tie,
    )
    order = ("computed_at", *tie)
    return latest_by(s, ["home_team", "away_team", "minute", "series"], order).drop(*order)


def pivot_wide(long: DataFrame, keys: Sequence[str] = ("home_team", "away_team", "minute"), series: Sequence[str] | None = None) -> DataFrame:
    """A8/A9 wide form: one column per series. Pass ``series`` to avoid the distinct-values job;
    meant for one game's chart (the number of columns follows the data)."""
    g = long.groupBy(*keys)
    p = g.pivot("series", list(series)) if series is not None else g.pivot("series")
    return p.agg(F.first("value"))


def team_series_groups(history: DataFrame) -> DataFrame:
    """A10: per game and team, the sorted distinct ``team__bookmaker`` series of plausible odds.
    The set per team is bounded by the number of bookmakers."""
    from linecast.operators.serving import plausible_odds

    s = plausible_odds(history).select("home_team", "away_team", "team", series_key("team", "bookmaker_key").alias("k"))
    return s.groupBy("home_team", "away_team", "team").agg(F.sort_array(F.collect_set("k")).alias("series_keys"))


def drain_latest(game_events: DataFrame, order: Sequence[str] = ("ingested_at",), date_chars: int = 10) -> DataFrame:
    """Last record per (sport, home, away, game date) of one poll; the game date is the first
    ten characters of the start time as in the studied consumer."""
    df = game_events.withColumn("game_date", F.substring(F.col("commence_time").cast("string"), 1, date_chars))
    return latest_by(df, ["sport_key", "home_team", "away_team", "game_date"], order)


def multi_book_corroboration(
    sharp: DataFrame,
    window: str = "2 minutes",
    min_books: int = 2,
    ts: str = "ingested_at_ts",
    flagged_only: bool = True,
) -> DataFrame:
    """Moves of one game, team and direction inside the same tumbling window, counted over
    distinct bookmakers; corroborated when at least ``min_books`` books moved together."""
    df = sharp.where(F.col("is_sharp_signal")) if flagged_only else sharp
    g = df.groupBy("sport_key", "home_team", "away_team", "team", "movement_direction", F.window(ts, window).alias("w")).agg(
        F.count_distinct("bookmaker_key").alias("n_books"),
        F.count(F.lit(1)).alias("n_moves"),
        F.max("prob_movement").alias("max_prob_movement"),
    )
    return g.select(
        "sport_key",
        "home_team",
        "away_team",
        "team",
        "movement_direction",
        F.col("w.start").cast("timestamp_ntz").alias("window_start"),
        F.col("w.end").cast("timestamp_ntz").alias("window_end"),
        "n_books",
        "n_moves",
        "max_prob_movement",
        (F.col("n_books") >= min_books).alias("is_corroborated"),
    )


# ------------------------------------------------------------------------------------------------
# Scoreboards


def parse_scoreboard(
    events: DataFrame, event_col: str = "event", sport_col: str = "sport_key", stamp: bool = True, keep: Sequence[str] = ()
) -> DataFrame:
    """F9 as a frame: one game row per event, events without home/away dropped; S9 stamps ingest time."""
    # Sides are extracted once; the struct is then built from plain columns.
    home, away = event_sides(F.col(event_col))
    sides = events.select(F.col(event_col).alias("__e"), F.col(sport_col).alias("__s"), home.alias("__h"), away.alias("__a"), *keep)
    sides = sides.where(F.col("__h").isNotNull() & F.col("__a").isNotNull())
    g = sides.select(*event_columns("__e", "__s", F.col("__h"), F.col("__a")), *keep)
    if stamp:
        g = g.withColumn("ingested_at", F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"))
    return g


def scoreboard_entries(events: DataFrame, event_col: str = "event", order_cols: Sequence[str] = (), keep: Sequence[str] = ()) -> DataFrame:
    """F10 as a frame: one entry per competition of every event (home/away by ``homeAway``)."""
    pass_cols = list(dict.fromkeys([*order_cols, *keep]))
    e = events.select(*pass_cols, F.col(f"{event_col}.date").alias("__d"), F.posexplode(F.col(f"{event_col}.competitions")).alias("__cpos", "__c"))
    home, away = competition_sides(F.col("__c"))
    sides = e.select(*pass_cols, "__cpos", "__d", "__c", home.alias("__h"), away.alias("__a"))
    sides = sides.where(F.col("__h").isNotNull() & F.col("__a").isNotNull())
    return sides.select(*pass_cols, "__cpos", *competition_columns("__d", "__c", F.col("__h"), F.col("__a")))


def scoreboard_latest(
    events: DataFrame, event_col: str = "event", order_cols: Sequence[str] = ("seq",), keep: Sequence[str] = ()
) -> DataFrame:
    """F10 + U2: one entry per ``away|home`` key, the later entry winning (order: ``order_cols``
    then competition position), as the studied client's map assignment does."""
    entries = scoreboard_entries(events, event_col, order_cols, keep)
    latest = latest_by(entries, ["game_key"], [*order_cols, "__cpos"])
    return latest.drop(*[c for c in order_cols if c not in keep], "__cpos")


def merge_scores(boards: Sequence[DataFrame], order_col: str = "board_order") -> DataFrame:
    """Merge per-sport scoreboards, a later board winning on equal keys."""
    tagged = [b.withColumn(order_col, F.lit(i)) for i, b in enumerate(boards)]
    u = tagged[0]
    for t in tagged[1:]:
        u = u.unionByName(t, allowMissingColumns=True)
    return latest_by(u, ["game_key"], [order_col]).drop(order_col)


def score_board_columns(scoreboard: DataFrame, sport_col: str = "sport_key") -> DataFrame:
    """who is ahead and the period label of each scoreboard entry."""
    return scoreboard.select(
        "*",
        home_winning("home_score", "away_score").alias("home_winning"),
        away_winning("home_score", "away_score").alias("away_winning"),
        period_label(F.col(sport_col), F.col("period")).alias("period_label"),
    )
