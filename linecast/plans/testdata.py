"""Domain frames derived from the driver's test tables (FIXTURES.md part B).

The test tables are not odds feeds, so each feed is *derived* from them with row-wise column
expressions (no sampling, no row caps - every input row maps to one feed row):

* ``events`` rows that are not views -> sportsbook odds polls, built in the **nested** feed shape
  (bookmakers -> markets -> outcomes) so every job also runs the flatten step;
* ``events`` view rows -> prediction-market quotes in the raw string shape;
* ``orders`` -> scoreboard events (``o_orderstatus`` F/O/P -> post/pre/in);
* ``nation`` -> team abbreviations (25 names, so some teams have none).

Game of an event: ``user_id % 40``; teams ``H<game>`` (home) and ``A<game>`` (away).
``linecast.plans.oracle`` holds the same mapping as SQL for the DuckDB oracle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from linecast.functions.odds import american_to_prob

N_GAMES = 40
# Fixed values of the mapping: the four "major books" of the test data and the league keys.
TEST_BOOKS = ("click", "error", "purchase", "signup")
SPORT_KEYS = ("basketball_nba", "basketball_ncaab", "basketball_wncaab")
SPORT_TITLES = ("NBA", "NCAAB", "WNCAAB")
QUOTE_EVENT = "view"
AS_OF = "2024-01-31 00:00:00"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def game_of(user_id: Column) -> Column:
    return user_id % N_GAMES


def sport_key_of(game: Column) -> Column:
    m = game % 3
    return F.when(m == 0, SPORT_KEYS[0]).when(m == 1, SPORT_KEYS[1]).otherwise(SPORT_KEYS[2])


def sport_title_of(game: Column) -> Column:
    m = game % 3
    return F.when(m == 0, SPORT_TITLES[0]).when(m == 1, SPORT_TITLES[1]).otherwise(SPORT_TITLES[2])


def _game_cols(game: Column) -> list[Column]:
    g = game.cast("string")
    return [
        game.alias("id"),
        sport_key_of(game).alias("sport_key"),
        sport_title_of(game).alias("sport_title"),
        F.concat(F.lit("H"), g).alias("home_team"),
        F.concat(F.lit("A"), g).alias("away_team"),
    ]


def _odds_value(event_id: Column, value: Column) -> Column:
    base = F.lit(100) + F.floor(value).cast("long")
    return F.when(event_id % 4 < 2, -base).otherwise(base)


def _team(event_id: Column, game: Column) -> Column:
    return F.concat(F.when(event_id % 2 == 0, F.lit("H")).otherwise(F.lit("A")), game.cast("string"))


def raw_odds(spark: SparkSession, sf_dir: str, poll: str = "tick") -> DataFrame:
    """Nested odds feed: one poll row per non-view event, one bookmaker with an h2h and a spreads market.

    ``poll='tick'`` stamps the event time as ingest time; ``poll='day'`` truncates it to the day
    (the consensus poll of FIXTURES). ``commence_time`` is 23:00 UTC of the event's day.
    """
    ev = table(spark, sf_dir, "events").where(F.col("event_type") != QUOTE_EVENT)
    game = game_of(F.col("user_id"))
    ts = F.col("ts") if poll == "tick" else F.date_trunc("day", F.col("ts")).cast("timestamp_ntz")
    h2h = F.struct(
        F.lit("h2h").alias("key"),
        F.array(
            F.struct(
                _team(F.col("event_id"), game).alias("name"),
                _odds_value(F.col("event_id"), F.col("value")).alias("price"),
                F.lit(None).cast("double").alias("point"),
            )
        ).alias("outcomes"),
    )
    spreads = F.struct(
        F.lit("spreads").alias("key"),
        F.array(
            F.struct(
                _team(F.col("event_id"), game).alias("name"),
                F.lit(-110).cast("long").alias("price"),
                F.col("value").alias("point"),
            )
        ).alias("outcomes"),
    )
    book = F.struct(
        F.col("event_type").alias("key"),
        F.initcap(F.col("event_type")).alias("title"),
        F.array(spreads, h2h).alias("markets"),
    )
    return ev.select(
        *_game_cols(game),
        (F.date_trunc("day", F.col("ts")) + F.expr("INTERVAL 23 HOURS")).cast("timestamp_ntz").alias("commence_time"),
        ts.alias("ingested_at"),
        F.array(book).alias("bookmakers"),
        F.col("event_id"),
    )


def raw_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Market quotes in the raw string shape: one per view event; every fifth is closed, values
    under 1 have an unparsable ask ('n/a'). Market ticker suffix is the team the event backs."""
    ev = table(spark, sf_dir, "events").where(F.col("event_type") == QUOTE_EVENT)
    game = game_of(F.col("user_id"))
    g = game.cast("string")
    bid = F.least(F.col("value") / 100.0, F.lit(0.97))
    ask = bid + 0.02
    event_ticker = F.concat(F.lit("EVT-"), g)
    return ev.select(
        sport_key_of(game).alias("sport"),
        event_ticker.alias("event_ticker"),
        F.concat(F.lit("A"), g).alias("away_team"),
        F.concat(F.lit("H"), g).alias("home_team"),
        F.date_format(F.col("ts"), "yyyy-MM-dd").alias("game_date"),
        F.concat(event_ticker, F.lit("-"), _team(F.col("event_id"), game)).alias("market_ticker"),
        F.lit("Winner?").alias("title"),
        F.when(F.col("value") < 1, F.lit("n/a")).otherwise(ask.cast("string")).alias("yes_ask_dollars"),
        bid.cast("string").alias("yes_bid_dollars"),
        (F.lit(1.0) - bid).cast("string").alias("no_ask_dollars"),
        (F.lit(0.98) - bid).cast("string").alias("no_bid_dollars"),
        F.when(F.col("event_id") % 5 == 0, F.lit("closed")).otherwise(F.lit("active")).alias("status"),
        F.col("event_id").alias("volume"),
        F.col("user_id").alias("open_interest"),
        F.col("ts").alias("ingested_at"),
        F.col("event_id"),
    )


def team_abbr_dim(spark: SparkSession, sf_dir: str, source: str = "tickers") -> DataFrame:
    """Team abbreviations from ``nation``: game n (n < 25) has home ``H<n>`` -> ``HN<n>`` and away
    ``A<n>`` -> ``AN<n>``; teams of games 25-39 have none."""
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("k"))
    k = F.col("k").cast("string")
    home = n.select(sport_key_of(F.col("k")).alias("sport_key"), F.concat(F.lit("H"), k).alias("team"), F.concat(F.lit("HN"), k).alias("abbr"))
    away = n.select(sport_key_of(F.col("k")).alias("sport_key"), F.concat(F.lit("A"), k).alias("team"), F.concat(F.lit("AN"), k).alias("abbr"))
    return home.unionByName(away).select(F.lit(source).alias("source"), "sport_key", "team", "abbr")


def tournament_teams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tournament field for P12: the teams of games numbered like a nation key (0-24)."""
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("string").alias("k"))
    return n.select(F.explode(F.array(F.concat(F.lit("H"), "k"), F.concat(F.lit("A"), "k"))).alias("team"))


_STATE = {"F": "post", "O": "pre", "P": "in"}


def scoreboard_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested scoreboard events from ``orders``: one event per order, one competition, two competitors.

    Game ``o_custkey % 40``; home score ``floor(o_totalprice) % 120``, away ``o_orderkey % 110``;
    period ``o_orderkey % 6``; every seventh order lists its competitors away-first.
    """
    o = table(spark, sf_dir, "orders")
    game = (F.col("o_custkey") % N_GAMES).cast("string")
    state = F.when(F.col("o_orderstatus") == "F", _STATE["F"]).when(F.col("o_orderstatus") == "O", _STATE["O"]).otherwise(_STATE["P"])
    home = F.struct(
        F.lit(0).alias("order"),
        F.lit("home").alias("homeAway"),
        (F.floor(F.col("o_totalprice")).cast("long") % 120).cast("string").alias("score"),
        F.struct(F.concat(F.lit("H"), game).alias("displayName")).alias("team"),
    )
    away = F.struct(
        F.lit(1).alias("order"),
        F.lit("away").alias("homeAway"),
        (F.col("o_orderkey") % 110).cast("string").alias("score"),
        F.struct(F.concat(F.lit("A"), game).alias("displayName")).alias("team"),
    )
    competitors = F.when(F.col("o_orderkey") % 7 == 0, F.array(away, home)).otherwise(F.array(home, away))
    comp = F.struct(
        F.struct(F.col("o_orderpriority").alias("abbreviation")).alias("type"),
        F.struct(
            (F.col("o_orderkey") % 6).cast("int").alias("period"),
            F.concat((F.col("o_orderkey") % 20).cast("string"), F.lit(":00")).alias("displayClock"),
            F.struct(state.alias("state"), F.initcap(state).alias("description")).alias("type"),
        ).alias("status"),
        competitors.alias("competitors"),
    )
    event = F.struct(
        F.col("o_orderkey").cast("string").alias("id"),
        F.date_format(F.col("o_orderdate"), "yyyy-MM-dd'T'HH:mm'Z'").alias("date"),
        F.struct(
            F.struct(
                state.alias("state"),
                (state == "post").alias("completed"),
                F.initcap(state).alias("description"),
                F.concat(F.lit("Q"), (F.col("o_orderkey") % 4 + 1).cast("string")).alias("shortDetail"),
            ).alias("type")
        ).alias("status"),
        F.array(comp).alias("competitions"),
    )
    return o.select(
        sport_key_of(F.col("o_custkey") % N_GAMES).alias("sport_key"),
        F.col("o_orderkey").alias("seq"),
        event.alias("event"),
    )


_ALL_DAYS = ["monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday"]
_EVENING = {"start_time": "17:05", "end_time": "20:35"}
_EARLY = {"start_time": "09:20", "end_time": "20:35"}

# Invented configuration of the test mapping (same shape as the studied per-sport configuration):
# the NBA uses the simple weekly form, college the per-day form without Monday (closed), and the
# women's league has no schedule (always on) and no ticker prefix.
TEST_CONFIG = {
    "sports": {
        "basketball_nba": {
            "active": True,
            "odds_api_key": "basketball_nba",
            "kalshi_prefix": "KXNBAGAME",
            "team_abbr": {},
            "schedule": {"timezone": "America/Chicago", "days": _ALL_DAYS, "start_time": "16:10", "end_time": "22:40"},
        },
        "basketball_ncaab": {
            "active": True,
            "odds_api_key": "basketball_ncaab",
            "kalshi_prefix": "KXNCAAMBGAME",
            "team_abbr": {},
            "schedule": {
                "timezone": "America/Chicago",
                "day_schedules": {
                    "tuesday": _EARLY,
                    "wednesday": _EVENING,
                    "thursday": _EVENING,
                    "friday": _EVENING,
                    "saturday": _EARLY,
                    "sunday": _EVENING,
                },
            },
        },
        "basketball_wncaab": {"active": False, "odds_api_key": "basketball_wncaab", "kalshi_prefix": None, "team_abbr": {}, "schedule": None},
    }
}


def test_dims(spark: SparkSession, sf_dir: str):
    """(sport_dim, team_dim, schedule_dim): configuration dims plus abbreviations from ``nation``."""
    from linecast.operators.dims import config_from_dict, load_dims

    sport_dim, _, schedule_dim = load_dims(config_from_dict(spark, TEST_CONFIG))
    return sport_dim, team_abbr_dim(spark, sf_dir), schedule_dim
