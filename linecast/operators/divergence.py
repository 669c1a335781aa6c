"""Divergence between market quotes and the sportsbook consensus.

The studied job inner-joins quotes and home consensus on (home_team, away_team) only, pairing every
quote snapshot of a game with every odds poll of it (n x m rows per game). That all-pairs form is
not built here. Instead:

* :func:`divergence_asof` (J1): each quote is compared with the consensus of the latest poll at or
  before the quote's time for the same teams - one row per quote, linear in the input;
* :func:`divergence_latest_pair` (J2, the documented intent): the latest quote of each market
  against the latest consensus of its game - one row per market.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linecast.functions.odds import (
    DIVERGENCE_SIGNAL,
    DIVERGENCE_THRESHOLD,
    batch_time,
    divergence,
    divergence_direction,
    flag_at_least,
)
from linecast.functions.text import ticker_suffix
from linecast.functions.timefn import game_date, with_timestamp
from linecast.operators.sequence import segmented_asof
from linecast.operators.serving import latest_by
from linecast.schemas import divergence_signals

GAME_KEYS = ("home_team", "away_team")

_BOOK_VALUES = ("sport_key", "commence_time", "sportsbook_home_prob", "num_bookmakers")


def score_divergence(
    pairs: DataFrame, threshold: float = DIVERGENCE_THRESHOLD, computed_at: Column | str | None = None, quote_ts: str = "ingested_at"
) -> DataFrame:
    """F2 + F13 on rows holding ``kalshi_implied_prob`` and ``sportsbook_home_prob``. The quote's time
    (``quote_ts``) stays on the row: it tells the quotes of one run apart when loads repeat. Rows
    without that column get null for it."""
    if quote_ts in pairs.columns:
        pairs = with_timestamp(pairs, quote_ts, "quote_ingested_at")
    else:
        pairs = pairs.withColumn("quote_ingested_at", F.lit(None).cast("timestamp"))
    sides = ("kalshi_implied_prob", "sportsbook_home_prob")
    derived = {
        "signal_type": F.lit(DIVERGENCE_SIGNAL),
        "computed_at": batch_time(computed_at),
        "divergence": divergence(*sides),
        "signal_direction": divergence_direction(*sides),
        "is_divergence_signal": flag_at_least(divergence(*sides), threshold),
    }
    return pairs.select(*[derived.get(c, F.col(c)).alias(c) for c in divergence_signals().names])


def home_market_only(quotes: DataFrame, home_abbr: Column | str = "home_abbr") -> DataFrame:
    """Optional fix of quirk Q2: keep markets whose ticker suffix is the home team's abbreviation."""
    c = F.col(home_abbr) if isinstance(home_abbr, str) else home_abbr
    return quotes.where(ticker_suffix("market_ticker") == c)


GAME_DAY = "__game_day"


def _with_game_day(quotes: DataFrame, home_odds: DataFrame, tz: str) -> tuple[DataFrame, DataFrame]:
    """Quirk Q1 option: a game-day key on both sides (the quote's ``game_date``, the odds' start
    date in ``tz``), so two games between the same teams on different days do not mix."""
    q = quotes.withColumn(GAME_DAY, F.to_date(F.col("game_date").cast("string")))
    b = home_odds.withColumn(GAME_DAY, game_date(F.col("commence_time"), tz))
    return q, b


def divergence_asof(
    quotes: DataFrame,
    home_odds: DataFrame,
    threshold: float = DIVERGENCE_THRESHOLD,
    computed_at: Column | str | None = None,
    keys: Sequence[str] = GAME_KEYS,
    quote_ts: str = "ingested_at",
    book_ts: str = "ingested_at",
    book_tie: Sequence[str] = ("id",),
    segment_seconds: int | str = "auto",
    same_day: bool = False,
    day_tz: str = "UTC",
) -> DataFrame:
    """Every quote against the latest home consensus at or before it (inner: quotes before the
    first poll of their game have no partner and drop). ``same_day`` also requires the quote's
    game date to equal the odds' start date (in ``day_tz``), as the studied join did not (Q1)."""
    if same_day:
        quotes, home_odds = _with_game_day(quotes, home_odds, day_tz)
        keys = (*keys, GAME_DAY)
    q = with_timestamp(quotes, quote_ts, "__qts")
    b = with_timestamp(home_odds, book_ts, "__bts").select(*keys, "__bts", *book_tie, *_BOOK_VALUES)
    paired = segmented_asof(
        q,
        b,
        keys=keys,
        left_ts="__qts",
        right_ts="__bts",
        right_values=_BOOK_VALUES,
        right_tie=(*book_tie,),
        how="inner",
        segment_seconds=segment_seconds,
    )
    return score_divergence(paired, threshold, computed_at, "__qts")


def divergence_latest_pair(
    quotes: DataFrame,
    home_odds: DataFrame,
    threshold: float = DIVERGENCE_THRESHOLD,
    computed_at: Column | str | None = None,
    keys: Sequence[str] = GAME_KEYS,
    quote_order: Sequence[str] = ("ingested_at",),
    book_order: Sequence[str] = ("ingested_at", "id"),
    same_day: bool = False,
    day_tz: str = "UTC",
) -> DataFrame:
    """Latest quote per market x latest consensus per game; one row per market.

    Both sides are reduced to one row per key before the join, so the join inputs are bounded by the
    number of markets and games; AQE turns it into a broadcast join when the reduced side is small.
    ``same_day`` keys both sides by game date as well (one row per market and game day).
    """
    if same_day:
        quotes, home_odds = _with_game_day(quotes, home_odds, day_tz)
        keys = (*keys, GAME_DAY)
        q = latest_by(quotes, ["market_ticker", GAME_DAY], quote_order)
        b = latest_by(home_odds.select(*keys, *book_order, *[c for c in _BOOK_VALUES if c not in book_order]), list(keys), book_order)
        return score_divergence(with_timestamp(q, "ingested_at", "__qts").join(b.drop("ingested_at"), on=list(keys), how="inner"), threshold, computed_at, "__qts")
    q = latest_by(quotes, ["market_ticker"], quote_order)
    b = latest_by(home_odds.select(*keys, *book_order, *[c for c in _BOOK_VALUES if c not in book_order]), list(keys), book_order)
    paired = with_timestamp(q, "ingested_at", "__qts").join(b.drop("ingested_at"), on=list(keys), how="inner")
    return score_divergence(paired, threshold, computed_at, "__qts")
