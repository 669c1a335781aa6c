"""Record schemas of the three raw feeds, the two signal tables and the dimensions (Spark DDL)."""

from __future__ import annotations

from pyspark.sql.types import StructType

RAW_ODDS_DDL = (
    "id STRING, sport_key STRING, sport_title STRING, commence_time STRING, home_team STRING, away_team STRING, "
    "bookmakers ARRAY<STRUCT<key: STRING, title: STRING, markets: ARRAY<STRUCT<key: STRING, "
    "outcomes: ARRAY<STRUCT<name: STRING, price: BIGINT, point: DOUBLE>>>>>>, ingested_at STRING"
)

RAW_KALSHI_DDL = (
    "sport STRING, event_ticker STRING, away_team STRING, home_team STRING, game_date STRING, market_ticker STRING, "
    "title STRING, yes_ask_dollars STRING, yes_bid_dollars STRING, no_ask_dollars STRING, no_bid_dollars STRING, "
    "status STRING, volume BIGINT, open_interest BIGINT, ingested_at STRING"
)

RAW_GAME_EVENTS_DDL = (
    "sport STRING, game_id STRING, sport_key STRING, sport_title STRING, commence_time STRING, completed BOOLEAN, "
    "status_state STRING, status_description STRING, home_team STRING, away_team STRING, home_score STRING, "
    "away_score STRING, scores ARRAY<STRUCT<name: STRING, score: STRING>>, last_update STRING, ingested_at STRING, "
    "source STRING"
)

DIVERGENCE_DDL = (
    "signal_type STRING, computed_at TIMESTAMP, sport_key STRING, home_team STRING, away_team STRING, "
    "commence_time TIMESTAMP, event_ticker STRING, market_ticker STRING, kalshi_implied_prob DOUBLE, "
    "sportsbook_home_prob DOUBLE, divergence DOUBLE, signal_direction STRING, is_divergence_signal BOOLEAN, "
    "num_bookmakers INT, quote_ingested_at TIMESTAMP"
)

SHARP_MONEY_DDL = (
    "signal_type STRING, computed_at TIMESTAMP, sport_key STRING, home_team STRING, away_team STRING, "
    "commence_time TIMESTAMP, bookmaker_key STRING, team STRING, prev_odds INT, american_odds INT, "
    "odds_movement INT, prev_implied_prob DOUBLE, current_implied_prob DOUBLE, prob_movement DOUBLE, "
    "movement_direction STRING, is_sharp_signal BOOLEAN, ingested_at_ts TIMESTAMP"
)

# Nested scoreboard event (fields read by the two scoreboard parsers only).
SCOREBOARD_EVENT_DDL = (
    "id STRING, date STRING, status STRUCT<type: STRUCT<state: STRING, completed: BOOLEAN, description: STRING, "
    "shortDetail: STRING>>, competitions ARRAY<STRUCT<type: STRUCT<abbreviation: STRING>, "
    "status: STRUCT<period: INT, displayClock: STRING, type: STRUCT<state: STRING, description: STRING>>, "
    "competitors: ARRAY<STRUCT<`order`: INT, homeAway: STRING, score: STRING, team: STRUCT<displayName: STRING>>>>>"
)

SPORT_DIM_DDL = "sport_key STRING, active BOOLEAN, odds_api_key STRING, kalshi_prefix STRING, has_schedule BOOLEAN"
TEAM_DIM_DDL = "source STRING, sport_key STRING, team STRING, abbr STRING"
SCHEDULE_DIM_DDL = "sport_key STRING, tz STRING, day STRING, start_time STRING, end_time STRING"

FEEDS = {
    "odds": RAW_ODDS_DDL,
    "kalshi": RAW_KALSHI_DDL,
    "game_events": RAW_GAME_EVENTS_DDL,
}


def struct(ddl: str) -> StructType:
    return StructType.fromDDL(ddl)


def raw_odds() -> StructType:
    return struct(RAW_ODDS_DDL)


def raw_kalshi() -> StructType:
    return struct(RAW_KALSHI_DDL)


def raw_game_events() -> StructType:
    return struct(RAW_GAME_EVENTS_DDL)


def divergence_signals() -> StructType:
    return struct(DIVERGENCE_DDL)


def sharp_money_signals() -> StructType:
    return struct(SHARP_MONEY_DDL)


def scoreboard_event() -> StructType:
    return struct(SCOREBOARD_EVENT_DDL)


def feed_schema(feed: str) -> StructType:
    return struct(FEEDS[feed])
