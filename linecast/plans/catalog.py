"""Registry of named queries (one per operator of the inventory) and their oracle SQL.

Each query takes ``(spark, sf_dir)``, derives the feeds from the test tables and applies the
operator under test through the public library API - exactly what a user of the library writes.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType

from linecast import schemas as SC
from linecast.functions.odds import register_sql_functions
from linecast.functions.timefn import in_game_window
from linecast.operators import boards as B
from linecast.operators import dims as D
from linecast.operators import joins as J
from linecast.operators import serving as S
from linecast.operators.divergence import divergence_asof, divergence_latest_pair
from linecast.operators.movement import line_movement, sharp_money
from linecast.operators.odds import consensus, flatten_odds, home_consensus, major_books
from linecast.operators.quotes import kalshi_mid
from linecast.plans import jobs
from linecast.plans import oracle as O
from linecast.plans import testdata as td
from linecast.session import apply_defaults, scratch_path
from linecast.sources import tables as T
from linecast.streaming import incremental as INC
from linecast.streaming import ingest as ING

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query; the registered callable first applies the library's session settings
    (UTC session time zone, AQE), which every time expression here relies on."""

    def deco(fn):
        @wraps(fn)
        def run(spark: SparkSession, sf: str) -> DataFrame:
            apply_defaults(spark)
            return fn(spark, sf)

        QUERIES[name] = run
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return deco


def round_doubles(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round every double column (engines may differ in the last bits of sums and averages)."""
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (DoubleType, FloatType)):
            cols.append(F.round(F.col(f.name), digits).alias(f.name))
        else:
            cols.append(F.col(f.name))
    return df.select(*cols)


def round_sql(inner: str, cols: list[str], digits: int = 6) -> str:
    rep = ", ".join(f"round({c}, {digits}) AS {c}" for c in cols)
    return f"SELECT * REPLACE ({rep}) FROM (\n{inner}\n) t"


def batch_of(c: str = "ingested_at"):
    """Batch time of the test signals: the day of the input row (one signal run per day)."""
    return F.date_trunc("day", F.col(c)).cast("timestamp_ntz")


# ---------------------------------------------------------------------------------------------
# Shared builders (Spark side)


def flat_odds(spark: SparkSession, sf: str, poll: str = "tick") -> DataFrame:
    """P1 + P2 over the nested feed derived from ``events``."""
    return flatten_odds(td.raw_odds(spark, sf, poll=poll), keep=("event_id",))


def quotes(spark: SparkSession, sf: str) -> DataFrame:
    return kalshi_mid(td.raw_quotes(spark, sf), extra=("event_id",))


def home_odds(spark: SparkSession, sf: str) -> DataFrame:
    return home_consensus(consensus(flat_odds(spark, sf, poll="day")))


def sharp_signals(spark: SparkSession, sf: str) -> DataFrame:
    return sharp_money(flat_odds(spark, sf), books=td.TEST_BOOKS, computed_at=batch_of(), tie=("event_id",))


def divergence_signals(spark: SparkSession, sf: str) -> DataFrame:
    return divergence_asof(quotes(spark, sf), home_odds(spark, sf), computed_at=batch_of())


_SILVER: dict[tuple[str, str, str], str] = {}


def silver_path(spark: SparkSession, sf: str, name: str) -> str:
    """Signal table as the read side sees it: computed once per session and test folder, committed as
    Parquet partitioned by day (S10) in the shared checkpoint folder. Views, feeds and boards query
    this table, as the studied dashboard queried its warehouse."""
    key = (spark.sparkContext.applicationId, sf, name)
    if key not in _SILVER:
        df = divergence_signals(spark, sf) if name == "divergence" else sharp_signals(spark, sf)
        path = scratch_path(spark, f"silver-{name}")
        T.write_signals(df, path, versioned=True, flag="is_divergence_signal" if name == "divergence" else "is_sharp_signal")
        _SILVER[key] = path
    return _SILVER[key]


def silver(spark: SparkSession, sf: str, name: str, keep_partition: bool = False) -> DataFrame:
    out = T.read_signals(spark, silver_path(spark, sf, name))
    return out if keep_partition else out.drop("computed_date")


def silver_latest(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """A3 with the batch time of the table's commit: one literal day is read."""
    path = silver_path(spark, sf, name)
    return S.latest_batch(T.read_signals(spark, path), latest=T.latest_time(spark, path)).drop("computed_date")


def div_silver(spark, sf, keep_partition=False):
    return silver(spark, sf, "divergence", keep_partition)


def sharp_silver(spark, sf, keep_partition=False):
    return silver(spark, sf, "sharp", keep_partition)


DIV_DOUBLES = ["kalshi_implied_prob", "sportsbook_home_prob", "divergence"]
SHARP_DOUBLES = ["prev_implied_prob", "current_implied_prob", "prob_movement"]

# ---------------------------------------------------------------------------------------------
# Flatten nested odds, moneyline only

FLAT_COLS = (
    "id, sport_key, sport_title, home_team, away_team, commence_time, ingested_at, event_id, bookmaker_key, "
    "bookmaker_title, team, american_odds, implied_prob"
)


@query("flatten_odds", O.with_ctes(round_sql(f"SELECT {FLAT_COLS} FROM odds", ["implied_prob"]), "odds"))
def q_flatten_odds(spark, sf):
    return round_doubles(flat_odds(spark, sf))


@query(
    "h2h_only",
    O.with_ctes("SELECT bookmaker_key, count(*) AS n_rows, sum(american_odds) AS sum_odds FROM odds GROUP BY bookmaker_key", "odds"),
)
def q_h2h_only(spark, sf):
    # The operator's own market filter: spreads rows must all disappear.
    h2h = flatten_odds(td.raw_odds(spark, sf), market="h2h", keep=("event_id",))
    return h2h.groupBy("bookmaker_key").agg(F.count("*").alias("n_rows"), F.sum("american_odds").alias("sum_odds"))


# Market quotes, active, mid > 0
@query(
    "kalshi_mid",
    O.with_ctes(
        round_sql(
            "SELECT event_ticker, market_ticker, sport, home_team, away_team, game_date, ingested_at, title, event_id, "
            "yes_ask, yes_bid, kalshi_implied_prob FROM quotes",
            ["yes_ask", "yes_bid", "kalshi_implied_prob"],
        ),
        "quotes",
    ),
)
def q_kalshi_mid(spark, sf):
    return round_doubles(quotes(spark, sf))


# A1: consensus per game, poll and team
@query(
    "consensus_prob",
    O.with_ctes(round_sql("SELECT * FROM cons", ["avg_implied_prob"]), "cons"),
)
def q_consensus(spark, sf):
    return round_doubles(consensus(flat_odds(spark, sf, poll="day")))


# Home side of the consensus
@query(
    "home_side",
    O.with_ctes(round_sql("SELECT * FROM home_odds", ["sportsbook_home_prob"]), "home_odds"),
)
def q_home_side(spark, sf):
    return round_doubles(home_odds(spark, sf))


# P5: bookmaker filter (two books of the test data)
@query(
    "major_books",
    O.with_ctes(
        "SELECT bookmaker_key, team, count(*) AS n_rows FROM odds WHERE bookmaker_key IN ('click', 'purchase') "
        "GROUP BY bookmaker_key, team",
        "odds",
    ),
)
def q_major_books(spark, sf):
    kept = major_books(flat_odds(spark, sf), books=("click", "purchase"))
    return kept.groupBy("bookmaker_key", "team").agg(F.count("*").alias("n_rows"))


# W1 + F3 + F13: sharp money
@query("sharp_money", O.with_ctes(round_sql("SELECT * FROM sharp", SHARP_DOUBLES), "sharp"))
def q_sharp_money(spark, sf):
    return round_doubles(sharp_signals(spark, sf))


# J1 + F2: divergence, each quote against the latest consensus at or before it
@query("divergence_pairs", O.with_ctes(round_sql("SELECT * FROM div", DIV_DOUBLES), "div"))
def q_divergence_pairs(spark, sf):
    return round_doubles(divergence_signals(spark, sf))


# Latest quote per market against the latest consensus per game
@query(
    "divergence_latest_pair",
    O.with_ctes(
        round_sql(
            f"""SELECT 'divergence' AS signal_type, TIMESTAMP '{td.AS_OF}' AS computed_at, h.sport_key, q.home_team,
      q.away_team, h.commence_time, q.event_ticker, q.market_ticker, q.kalshi_implied_prob, h.sportsbook_home_prob,
      abs(q.kalshi_implied_prob - h.sportsbook_home_prob) AS divergence,
      CASE WHEN q.kalshi_implied_prob > h.sportsbook_home_prob THEN 'KALSHI_HIGHER' ELSE 'SPORTSBOOK_HIGHER' END
        AS signal_direction,
      abs(q.kalshi_implied_prob - h.sportsbook_home_prob) >= 0.05 AS is_divergence_signal, h.num_bookmakers, q.ingested_at AS quote_ingested_at
    FROM (SELECT * FROM quotes QUALIFY row_number() OVER (PARTITION BY market_ticker ORDER BY ingested_at DESC, event_id DESC) = 1) q
    JOIN (SELECT * FROM home_odds QUALIFY row_number() OVER (PARTITION BY home_team, away_team ORDER BY ingested_at DESC, id DESC) = 1) h
      ON q.home_team = h.home_team AND q.away_team = h.away_team""",
            DIV_DOUBLES,
        ),
        "quotes",
        "home_odds",
    ),
)
def q_divergence_latest_pair(spark, sf):
    out = divergence_latest_pair(
        quotes(spark, sf),
        home_odds(spark, sf),
        computed_at=F.lit(td.AS_OF).cast("timestamp_ntz"),
        quote_order=("ingested_at", "event_id"),
        book_order=("ingested_at", "id"),
    )
    return round_doubles(out)


# =============================================================================================
# Serving: filters, views, dedup, feeds, boards


LA = "America/Los_Angeles"
NOT_WOMENS = "sport_key NOT IN ('basketball_wncaab', 'basketball_ncaaw')"
FEED_DATE = "2024-01-30"


def sb_latest(spark, sf):
    return B.scoreboard_latest(td.scoreboard_events(spark, sf), order_cols=("seq",), keep=("sport_key",))


def _div_sql(body: str, *ctes: str, doubles=DIV_DOUBLES) -> str:
    return O.with_ctes(round_sql(body, list(doubles)), *ctes)


@query("exclude_womens", _div_sql(f"SELECT * FROM div WHERE {NOT_WOMENS}", "div"))
def q_exclude_womens(spark, sf):
    return round_doubles(S.exclude_womens(div_silver(spark, sf)))


@query(
    "by_local_date",
    _div_sql(f"SELECT * FROM div WHERE CAST({O.local_sql('commence_time', LA)} AS DATE) = DATE '2024-01-15'", "div"),
)
def q_by_local_date(spark, sf):
    return round_doubles(S.by_local_date(div_silver(spark, sf), "2024-01-15"))


@query("by_sport", _div_sql("SELECT * FROM sharp WHERE sport_key = 'basketball_nba'", "sharp", doubles=SHARP_DOUBLES))
def q_by_sport(spark, sf):
    return round_doubles(S.by_sport(sharp_silver(spark, sf), "basketball_nba"))


@query(
    "by_game",
    _div_sql(
        """SELECT * FROM div d WHERE EXISTS (SELECT 1 FROM sb_latest s WHERE s.state = 'in'
      AND s.home_team = d.home_team AND s.away_team = d.away_team)""",
        "div",
        "sb_latest",
    ),
)
def q_by_game(spark, sf):
    live = sb_latest(spark, sf).where(F.col("state") == "in")
    return round_doubles(S.by_game(div_silver(spark, sf), games=live))


@query(
    "plausible_odds",
    O.with_ctes(
        "SELECT home_team, away_team, team, bookmaker_key, computed_at, american_odds, prev_implied_prob, current_implied_prob "
        "FROM sharp WHERE american_odds BETWEEN -2500 AND 2500",
        "sharp",
    ),
)
def q_plausible_odds(spark, sf):
    return round_doubles(S.plausible_odds(sharp_silver(spark, sf)).select(*S.GAME_KEYS, *S.ODDS_HISTORY_COLS))


@query(
    "recent_hours",
    _div_sql(f"SELECT * FROM sharp WHERE computed_at >= TIMESTAMP '{td.AS_OF}' - INTERVAL 30 HOUR", "sharp", doubles=SHARP_DOUBLES),
)
def q_recent_hours(spark, sf):
    return round_doubles(S.recent_hours(sharp_silver(spark, sf, True), 30, td.AS_OF).drop("computed_date"))


@query(
    "tournament_only",
    _div_sql(
        """SELECT * FROM div WHERE sport_key IS NULL OR sport_key <> 'basketball_ncaab'
      OR (home_team IN (SELECT 'H' || CAST(n_nationkey AS VARCHAR) FROM nation)
          AND away_team IN (SELECT 'A' || CAST(n_nationkey AS VARCHAR) FROM nation))""",
        "div",
    ),
)
def q_tournament_only(spark, sf):
    return round_doubles(S.tournament_only(div_silver(spark, sf), td.tournament_teams(spark, sf)))


_LOCAL = O.local_sql("ingested_at", LA)
_DAY = f"lower(dayname({_LOCAL}))"
_HM = f"strftime({_LOCAL}, '%H:%M')"
_SCHED = O.local_sql("ingested_at", "America/Chicago")
_SCHED_DAY, _SCHED_HM = f"lower(dayname({_SCHED}))", f"strftime({_SCHED}, '%H:%M')"


@query(
    "in_schedule",
    O.with_ctes(
        f"""SELECT event_id, sport_key, ingested_at, CASE sport_key
        WHEN 'basketball_wncaab' THEN TRUE
        WHEN 'basketball_nba' THEN {_SCHED_HM} BETWEEN '16:10' AND '22:40'
        WHEN 'basketball_ncaab' THEN CASE WHEN {_SCHED_DAY} IN ('tuesday', 'saturday') THEN {_SCHED_HM} BETWEEN '09:20' AND '20:35'
                                          WHEN {_SCHED_DAY} = 'monday' THEN FALSE
                                          ELSE {_SCHED_HM} BETWEEN '17:05' AND '20:35' END
        ELSE FALSE END AS in_schedule
      FROM odds""",
        "odds",
    ),
)
def q_in_schedule(spark, sf):
    sport_dim, _, schedule_dim = td.test_dims(spark, sf)
    odds = flat_odds(spark, sf).select("event_id", "sport_key", "ingested_at")
    return D.in_schedule(odds, "ingested_at", sport_dim, schedule_dim)


@query(
    "in_game_window",
    O.with_ctes(
        f"""SELECT event_id, ingested_at, ({_HM} BETWEEN '15:00' AND '23:00')
        OR ({_DAY} IN ('thursday', 'friday') AND {_HM} >= '08:00' AND {_HM} < '15:00') AS in_game_window FROM odds""",
        "odds",
    ),
)
def q_in_game_window(spark, sf):
    return flat_odds(spark, sf).select("event_id", "ingested_at", in_game_window("ingested_at").alias("in_game_window"))


@query("latest_batch", _div_sql("SELECT * FROM latest_div", "latest_div"))
def q_latest_batch(spark, sf):
    return round_doubles(silver_latest(spark, sf, "divergence"))


_UNION = f"""SELECT sport_key, home_team, away_team, computed_at FROM div WHERE {NOT_WOMENS}
    UNION ALL SELECT sport_key, home_team, away_team, computed_at FROM sharp WHERE {NOT_WOMENS}"""


@query(
    "signals_summary",
    O.with_ctes(
        f"""SELECT sport_key, home_team, away_team, count(*) AS signal_count, max(computed_at) AS latest_computed_at
      FROM ({_UNION}) u GROUP BY sport_key, home_team, away_team ORDER BY sport_key, signal_count DESC""",
        "div",
        "sharp",
    ),
)
def q_signals_summary(spark, sf):
    return S.signals_summary(div_silver(spark, sf), sharp_silver(spark, sf))


@query("union_signals", O.with_ctes(_UNION, "div", "sharp"))
def q_union_signals(spark, sf):
    return S.union_signals(div_silver(spark, sf), sharp_silver(spark, sf))


@query("distinct_sports", O.with_ctes("SELECT sport_key FROM div UNION SELECT sport_key FROM sharp", "div", "sharp"))
def q_distinct_sports(spark, sf):
    return S.distinct_sports(div_silver(spark, sf), sharp_silver(spark, sf))


_DIV_TIE = ("computed_at", "quote_ingested_at", "kalshi_implied_prob", "sportsbook_home_prob", "commence_time", "event_ticker")


@query(
    "latest_dedup",
    _div_sql(
        f"""SELECT * FROM div WHERE computed_at >= (SELECT max(computed_at) FROM div) - INTERVAL 10 MINUTE AND {NOT_WOMENS}
      QUALIFY row_number() OVER (PARTITION BY home_team, away_team, market_ticker
        ORDER BY {', '.join(c + ' DESC' for c in _DIV_TIE)}) = 1""",
        "div",
    ),
)
def q_latest_dedup(spark, sf):
    path = silver_path(spark, sf, "divergence")
    recent = S.latest_dedup(T.read_signals(spark, path), S.DIVERGENCE_SERIES, order=_DIV_TIE, latest=T.latest_time(spark, path))
    return round_doubles(recent.drop("computed_date"))


@query(
    "minute_dedup",
    _div_sql(
        """SELECT * FROM sharp QUALIFY row_number() OVER (PARTITION BY home_team, away_team, bookmaker_key, team,
      ingested_at_ts, date_trunc('minute', computed_at) ORDER BY computed_at DESC) = 1""",
        "sharp",
        doubles=SHARP_DOUBLES,
    ),
)
def q_minute_dedup(spark, sf):
    # The same signal batch loaded twice (quirk Q11): dedup collapses the copies.
    s = sharp_silver(spark, sf)
    return round_doubles(S.minute_dedup(s.unionByName(s), S.SHARP_ROW, order=("computed_at",)))


def _feed_sql(view: str, col: str, cols: list[str], doubles) -> str:
    ties = ", ".join(f"{c} ASC NULLS LAST" for c in cols if c != col)
    return O.with_ctes(
        round_sql(
            f"""SELECT * FROM {view} WHERE CAST({O.local_sql('commence_time', LA)} AS DATE) = DATE '{FEED_DATE}'
      ORDER BY {col} DESC NULLS LAST, {ties} LIMIT 10000""",
            list(doubles),
        ),
        view,
    )


_DIV_COLS = [
    "signal_type", "computed_at", "sport_key", "home_team", "away_team", "commence_time", "event_ticker", "market_ticker",
    "kalshi_implied_prob", "sportsbook_home_prob", "divergence", "signal_direction", "is_divergence_signal", "num_bookmakers",
    "quote_ingested_at",
]
_SHARP_COLS = [
    "signal_type", "computed_at", "sport_key", "home_team", "away_team", "commence_time", "bookmaker_key", "team",
    "prev_odds", "american_odds", "odds_movement", "prev_implied_prob", "current_implied_prob", "prob_movement",
    "movement_direction", "is_sharp_signal", "ingested_at_ts",
]


@query("divergence_feed", _feed_sql("latest_div", "divergence", _DIV_COLS, DIV_DOUBLES))
def q_divergence_feed(spark, sf):
    return round_doubles(S.feed(silver_latest(spark, sf, "divergence"), "divergence", date=FEED_DATE))


@query("sharp_feed", _feed_sql("latest_sharp", "prob_movement", _SHARP_COLS, SHARP_DOUBLES))
def q_sharp_feed(spark, sf):
    return round_doubles(S.feed(silver_latest(spark, sf, "sharp"), "prob_movement", date=FEED_DATE))


@query(
    "divergence_history",
    _div_sql(
        "SELECT home_team, away_team, market_ticker, computed_at, kalshi_implied_prob, sportsbook_home_prob, divergence FROM div",
        "div",
    ),
)
def q_divergence_history(spark, sf):
    return round_doubles(S.history(div_silver(spark, sf), S.DIVERGENCE_HISTORY_COLS))


@query(
    "odds_history",
    O.with_ctes(
        "SELECT home_team, away_team, team, bookmaker_key, computed_at, american_odds, prev_implied_prob, current_implied_prob FROM sharp",
        "sharp",
    ),
)
def q_odds_history(spark, sf):
    return round_doubles(S.history(sharp_silver(spark, sf), S.ODDS_HISTORY_COLS))


_DIV_BOARD = """SELECT away_team || '|' || home_team AS game_key, away_team, home_team, sport_key, commence_time,
      market_ticker AS top_market_ticker, divergence * 100.0 AS divergence_pct, signal_direction,
      CASE WHEN signal_direction = 'KALSHI_HIGHER' THEN 'up' ELSE 'down' END AS arrow,
      CASE WHEN divergence * 100.0 >= 10 THEN 'high' WHEN divergence * 100.0 >= 5 THEN 'medium' ELSE 'low' END AS severity,
      n_rows
    FROM (SELECT *, row_number() OVER (PARTITION BY away_team, home_team
                                       ORDER BY divergence DESC, market_ticker DESC, computed_at DESC) AS rn,
                 count(*) OVER (PARTITION BY away_team, home_team) AS n_rows FROM latest_div) t WHERE rn = 1"""

_SHARP_BOARD = """SELECT away_team || '|' || home_team AS game_key, away_team, home_team, sport_key, commence_time,
      prob_movement * 100.0 AS top_move_pct, mx * 100.0 AS max_move_pct, movement_direction,
      mx * 100.0 >= 10.0 AS sharp_flash,
      CASE WHEN mx * 100.0 >= 10 THEN 'high' WHEN prob_movement * 100.0 >= 5 THEN 'medium' ELSE 'low' END AS severity,
      n_rows
    FROM (SELECT *, row_number() OVER (PARTITION BY away_team, home_team ORDER BY prob_movement DESC, bookmaker_key DESC,
                                       team DESC, computed_at DESC, ingested_at_ts DESC) AS rn,
                 max(prob_movement) OVER (PARTITION BY away_team, home_team) AS mx,
                 count(*) OVER (PARTITION BY away_team, home_team) AS n_rows FROM latest_sharp) t WHERE rn = 1"""
_SHARP_TIE = ("bookmaker_key", "team", "computed_at", "ingested_at_ts")


def div_board(spark, sf):
    return B.divergence_game_board(S.feed_rows(silver_latest(spark, sf, "divergence")))


def sharp_board(spark, sf):
    return B.sharp_game_board(S.feed_rows(silver_latest(spark, sf, "sharp")), tie=_SHARP_TIE)


@query("divergence_game_board", O.with_ctes(round_sql(_DIV_BOARD, ["divergence_pct"]), "latest_div"))
def q_divergence_game_board(spark, sf):
    return round_doubles(div_board(spark, sf))


@query("sharp_game_board", O.with_ctes(round_sql(_SHARP_BOARD, ["top_move_pct", "max_move_pct"]), "latest_sharp"))
def q_sharp_game_board(spark, sf):
    return round_doubles(sharp_board(spark, sf))


@query(
    "bar_share",
    O.with_ctes(
        round_sql(
            f"""SELECT *, top_move_pct / greatest(coalesce(max(top_move_pct) OVER (), 1.0), 1.0) AS bar_share
      FROM ({_SHARP_BOARD}) b""",
            ["top_move_pct", "max_move_pct", "bar_share"],
        ),
        "latest_sharp",
    ),
)
def q_bar_share(spark, sf):
    return round_doubles(B.bars_desc(sharp_board(spark, sf), "top_move_pct"))


@query(
    "board_order",
    O.with_ctes(
        round_sql(
            f"""SELECT b.*, s.state AS score_state,
        CASE WHEN s.state = 'in' THEN 0 WHEN s.state = 'pre' THEN 1 ELSE 2 END AS state_rank
      FROM ({_DIV_BOARD}) b LEFT JOIN sb_latest s ON b.away_team = s.away_team AND b.home_team = s.home_team""",
            ["divergence_pct"],
        ),
        "latest_div",
        "sb_latest",
    ),
)
def q_board_order(spark, sf):
    return round_doubles(B.board_order(div_board(spark, sf), sb_latest(spark, sf), "divergence_pct"))


@query(
    "attach_scores",
    _div_sql(
        """SELECT d.*, s.game_key, s.home_score, s.away_score, s.status, s.state, s.period, s.display_clock
      FROM latest_div d LEFT JOIN sb_latest s ON d.away_team = s.away_team AND d.home_team = s.home_team""",
        "latest_div",
        "sb_latest",
    ),
)
def q_attach_scores(spark, sf):
    return round_doubles(J.attach_scores(silver_latest(spark, sf, "divergence"), sb_latest(spark, sf)))


@query(
    "pivot_divergence",
    O.with_ctes(
        round_sql(
            """SELECT home_team, away_team, minute, series, value FROM (
        SELECT home_team, away_team, date_trunc('minute', computed_at) AS minute,
               'kalshi_' || split_part(market_ticker, '-', -1) AS series, kalshi_implied_prob AS value,
               computed_at, kalshi_implied_prob, sportsbook_home_prob FROM div
        UNION ALL
        SELECT home_team, away_team, date_trunc('minute', computed_at), 'sportsbook_avg', sportsbook_home_prob,
               computed_at, kalshi_implied_prob, sportsbook_home_prob FROM div) u
      QUALIFY row_number() OVER (PARTITION BY home_team, away_team, minute, series
        ORDER BY computed_at DESC, kalshi_implied_prob DESC, sportsbook_home_prob DESC) = 1""",
            ["value"],
        ),
        "div",
    ),
)
def q_pivot_divergence(spark, sf):
    return round_doubles(B.pivot_divergence_long(div_silver(spark, sf), tie=("kalshi_implied_prob", "sportsbook_home_prob")))


@query(
    "pivot_odds",
    O.with_ctes(
        round_sql(
            """SELECT home_team, away_team, date_trunc('minute', computed_at) AS minute, team || '__' || bookmaker_key AS series,
        CAST(american_odds AS DOUBLE) AS value FROM sharp WHERE american_odds BETWEEN -2500 AND 2500
      QUALIFY row_number() OVER (PARTITION BY home_team, away_team, date_trunc('minute', computed_at), team, bookmaker_key
        ORDER BY computed_at DESC, ingested_at_ts DESC) = 1""",
            ["value"],
        ),
        "sharp",
    ),
)
def q_pivot_odds(spark, sf):
    return round_doubles(B.pivot_odds_long(sharp_silver(spark, sf), tie=("ingested_at_ts",)))


@query(
    "team_series_groups",
    O.with_ctes(
        """SELECT home_team, away_team, team, array_to_string(list_sort(list_distinct(list(team || '__' || bookmaker_key))), ',')
        AS series_keys FROM sharp WHERE american_odds BETWEEN -2500 AND 2500 GROUP BY home_team, away_team, team""",
        "sharp",
    ),
)
def q_team_series_groups(spark, sf):
    g = B.team_series_groups(sharp_silver(spark, sf))
    return g.withColumn("series_keys", F.array_join("series_keys", ","))


_PARSED_COLS = (
    "sport, game_id, sport_key, sport_title, commence_time, completed, status_state, status_description, home_team, "
    "away_team, home_score, away_score, has_scores, last_update, source, seq"
)


def parsed_games(spark, sf):
    p = B.parse_scoreboard(td.scoreboard_events(spark, sf), stamp=False, keep=("seq",))
    return p.withColumn("has_scores", F.col("scores").isNotNull()).drop("scores")


@query("parse_scoreboard", O.with_ctes(f"SELECT {_PARSED_COLS} FROM sb_parsed", "sb_parsed"))
def q_parse_scoreboard(spark, sf):
    return parsed_games(spark, sf)


@query(
    "drain_latest",
    O.with_ctes(
        f"""SELECT {_PARSED_COLS}, substr(commence_time, 1, 10) AS game_date FROM sb_parsed
      QUALIFY row_number() OVER (PARTITION BY sport_key, home_team, away_team, substr(commence_time, 1, 10)
                                 ORDER BY seq DESC) = 1""",
        "sb_parsed",
    ),
)
def q_drain_latest(spark, sf):
    return B.drain_latest(parsed_games(spark, sf), order=("seq",))


@query("scoreboard_latest", O.with_ctes("SELECT * FROM sb_latest", "sb_latest"))
def q_scoreboard_latest(spark, sf):
    return sb_latest(spark, sf)


# Every event is read by one of the two boards: those of finished games, and all others.
_OVERLAP = """SELECT * EXCLUDE (b) FROM (
      SELECT 'A' || g || '|' || 'H' || g AS game_key, 'H' || g AS home_team, 'A' || g AS away_team, home_score, away_score,
        upper(substr(state, 1, 1)) || substr(state, 2) AS status, state, period, display_clock, date AS commence_time, sport_key, b
      FROM (SELECT *, state = 'post' AS b FROM sb_events
            QUALIFY row_number() OVER (PARTITION BY g, state = 'post' ORDER BY seq DESC) = 1) u)
    QUALIFY row_number() OVER (PARTITION BY game_key ORDER BY b DESC) = 1"""


@query("merge_scores", O.with_ctes(_OVERLAP, "sb_events"))
def q_merge_scores(spark, sf):
    """U2 on two boards with common games: the later board wins even where its entry is the older one."""
    ev = td.scoreboard_events(spark, sf)
    final = F.col("event.status.type.state") == "post"
    boards = [B.scoreboard_latest(ev.where(c), order_cols=("seq",), keep=("sport_key",)) for c in (~final, final)]
    return B.merge_scores(boards)


@query("merge_scores_whole", O.with_ctes("SELECT * FROM sb_latest", "sb_latest"))
def q_merge_scores_whole(spark, sf):
    """U2 on two boards of all events, the later of which is the latest: every game, at its latest event."""
    ev = td.scoreboard_events(spark, sf)
    first = B.scoreboard_latest(ev.withColumn("back", -F.col("seq")), order_cols=("back",), keep=("sport_key",))
    return B.merge_scores([first, sb_latest(spark, sf)])


@query(
    "score_leader",
    O.with_ctes(
        """SELECT *, coalesce(TRY_CAST(home_score AS BIGINT) > TRY_CAST(away_score AS BIGINT), FALSE) AS home_winning,
        coalesce(TRY_CAST(away_score AS BIGINT) > TRY_CAST(home_score AS BIGINT), FALSE) AS away_winning,
        CASE WHEN period IS NULL OR period = 0 THEN ''
             WHEN sport_key = 'basketball_nba' THEN CASE WHEN period <= 4 THEN 'Q' || period ELSE 'OT' || (period - 4) END
             WHEN sport_key = 'basketball_ncaab' THEN CASE WHEN period <= 2 THEN 'H' || period ELSE 'OT' || (period - 2) END
             ELSE 'P' || period END AS period_label
      FROM sb_latest""",
        "sb_latest",
    ),
)
def q_score_leader(spark, sf):
    return B.score_board_columns(sb_latest(spark, sf))


@query(
    "multi_book_corroboration",
    O.with_ctes(
        round_sql(
            """SELECT sport_key, home_team, away_team, team, movement_direction,
        time_bucket(INTERVAL 2 MINUTE, ingested_at_ts) AS window_start,
        time_bucket(INTERVAL 2 MINUTE, ingested_at_ts) + INTERVAL 2 MINUTE AS window_end,
        count(DISTINCT bookmaker_key) AS n_books, count(*) AS n_moves, max(prob_movement) AS max_prob_movement,
        count(DISTINCT bookmaker_key) >= 2 AS is_corroborated
      FROM sharp WHERE is_sharp_signal
      GROUP BY sport_key, home_team, away_team, team, movement_direction, time_bucket(INTERVAL 2 MINUTE, ingested_at_ts)""",
            ["max_prob_movement"],
        ),
        "sharp",
    ),
)
def q_multi_book_corroboration(spark, sf):
    return round_doubles(B.multi_book_corroboration(sharp_silver(spark, sf)))


# J3 + F4 + F5 over the drained scoreboard games (Eastern game date)
_PREFIX = "CASE sport_key WHEN 'basketball_nba' THEN 'KXNBAGAME' WHEN 'basketball_ncaab' THEN 'KXNCAAMBGAME' END"


def _ticker_sql(src: str, start: str, tz: str, cols: str) -> str:
    d = f"CAST(timezone('{tz}', timezone('UTC', CAST({start} AS TIMESTAMP))) AS DATE)"
    return f"""SELECT {cols}, {_PREFIX} AS kalshi_prefix, 'AN' || substr(away_team, 2) AS away_abbr,
        'HN' || substr(home_team, 2) AS home_abbr, {d} AS ticker_date,
        {_PREFIX} || '-' || upper(strftime({d}, '%y%b%d')) || 'AN' || substr(away_team, 2) || 'HN' || substr(home_team, 2)
          AS event_ticker
      FROM {src} WHERE {_PREFIX} IS NOT NULL AND CAST(substr(home_team, 2) AS INTEGER) < 25
        AND CAST(substr(away_team, 2) AS INTEGER) < 25"""


_DRAINED = f"""(SELECT {_PARSED_COLS}, substr(commence_time, 1, 10) AS game_date FROM sb_parsed
      QUALIFY row_number() OVER (PARTITION BY sport_key, home_team, away_team, substr(commence_time, 1, 10)
                                 ORDER BY seq DESC) = 1) dr"""


_GAMES_TO_TICKERS_SQL = O.with_ctes(_ticker_sql(_DRAINED, "commence_time", "America/New_York", _PARSED_COLS + ", game_date"), "sb_parsed")


@query("games_to_tickers", _GAMES_TO_TICKERS_SQL)
def q_games_to_tickers(spark, sf):
    sport_dim, team_dim, _ = td.test_dims(spark, sf)
    games = B.drain_latest(parsed_games(spark, sf), order=("seq",))
    return D.games_to_tickers(games, sport_dim, team_dim)


O.register("odds_games", "SELECT DISTINCT sport_key, home_team, away_team, commence_time FROM odds_day", ("odds_day",))
O.register(
    "quote_games",
    """SELECT sport AS sport_key, home_team, away_team, game_date, market_ticker, yes_ask, yes_bid, status, ingested_at,
      event_id FROM quotes_raw""",
    ("quotes_raw",),
)


@query(
    "ticker_lookup",
    O.with_ctes(
        f"""SELECT t.*, m.market_ticker, m.status, m.ingested_at, m.event_id
      FROM ({_ticker_sql('odds_games', 'commence_time', 'UTC', 'sport_key, home_team, away_team, commence_time')}) t
      JOIN ({_ticker_sql('quote_games', 'game_date', 'UTC', 'market_ticker, status, ingested_at, event_id')}) m
        ON t.event_ticker = m.event_ticker""",
        "odds_games",
        "quote_games",
    ),
)
def q_ticker_lookup(spark, sf):
    sport_dim, team_dim, _ = td.test_dims(spark, sf)
    games = flat_odds(spark, sf, poll="day").select("sport_key", "home_team", "away_team", "commence_time").distinct()
    tickers = D.games_to_tickers(games, sport_dim, team_dim, tz="UTC")
    q = td.raw_quotes(spark, sf).select(
        F.col("sport").alias("sport_key"), "home_team", "away_team", "game_date", "market_ticker", "status", "ingested_at", "event_id"
    )
    markets = D.games_to_tickers(q, sport_dim, team_dim, tz="UTC", start_col="game_date")
    return D.ticker_lookup(tickers, markets.select("event_ticker", "market_ticker", "status", "ingested_at", "event_id"))


@query(
    "attach_abbr",
    O.with_ctes(
        round_sql(
            f"""SELECT b.*, coalesce(a.abbr, b.away_team) AS away_abbr, coalesce(h.abbr, b.home_team) AS home_abbr,
        coalesce(a.abbr, b.away_team) || ' @ ' || coalesce(h.abbr, b.home_team) AS short_label
      FROM ({_DIV_BOARD}) b
      LEFT JOIN (SELECT 'A' || CAST(n_nationkey AS VARCHAR) AS team, 'AN' || CAST(n_nationkey AS VARCHAR) AS abbr FROM nation) a
        ON b.away_team = a.team
      LEFT JOIN (SELECT 'H' || CAST(n_nationkey AS VARCHAR) AS team, 'HN' || CAST(n_nationkey AS VARCHAR) AS abbr FROM nation) h
        ON b.home_team = h.team""",
            ["divergence_pct"],
        ),
        "latest_div",
    ),
)
def q_attach_abbr(spark, sf):
    dim = td.team_abbr_dim(spark, sf)
    b = J.attach_abbr(div_board(spark, sf), dim, "away_team", "away_abbr")
    b = J.attach_abbr(b, dim, "home_team", "home_abbr")
    return round_doubles(b.withColumn("short_label", F.concat_ws(" @ ", "away_abbr", "home_abbr")))


@query(
    "unmatched_teams",
    O.with_ctes(
        """SELECT DISTINCT sport_key, team FROM (SELECT sport_key, home_team AS team FROM sb_parsed
        UNION ALL SELECT sport_key, away_team FROM sb_parsed) s
      WHERE CAST(substr(team, 2) AS INTEGER) >= 25""",
        "sb_parsed",
    ),
)
def q_unmatched_teams(spark, sf):
    return J.unmatched_teams(parsed_games(spark, sf), td.team_abbr_dim(spark, sf))


@query(
    "american_to_prob",
    f"SELECT event_id, round({O.prob(O.ODDS_VALUE)}, 6) AS implied_prob FROM events WHERE event_type <> 'view'",
)
def q_american_to_prob(spark, sf):
    # F1 through its SQL registration (inlined SQL function, no Python worker).
    register_sql_functions(spark)
    td.table(spark, sf, "events").createOrReplaceTempView("linecast_events")
    return spark.sql(
        """SELECT event_id, round(american_to_prob(CASE WHEN event_id % 4 < 2 THEN -(100 + floor(value))
                                                       ELSE 100 + floor(value) END), 6) AS implied_prob
           FROM linecast_events WHERE event_type <> 'view'"""
    )


@query(
    "line_movement",
    O.with_ctes(
        round_sql(
            """SELECT id, bookmaker_key, team, ingested_at, event_id, american_odds, prev_odds, implied_prob, prev_prob
      FROM moves WHERE prev_odds IS NOT NULL""",
            ["implied_prob", "prev_prob"],
        ),
        "moves",
    ),
)
def q_line_movement(spark, sf):
    m = line_movement(flat_odds(spark, sf), tie=("event_id",))
    return round_doubles(
        m.select("id", "bookmaker_key", "team", "ingested_at", "event_id", "american_odds", "prev_odds", "implied_prob", "prev_prob")
    )


@query(
    "table_counts",
    O.with_ctes(
        """SELECT 'raw_odds' AS table_name, count(*) AS n_rows, CAST(NULL AS BIGINT) AS n_flagged FROM events WHERE event_type <> 'view'
      UNION ALL SELECT 'raw_kalshi', count(*), NULL FROM events WHERE event_type = 'view'
      UNION ALL SELECT 'raw_game_events', count(*), NULL FROM orders
      UNION ALL SELECT 'divergence_signals', count(*), count(*) FILTER (WHERE is_divergence_signal) FROM div
      UNION ALL SELECT 'sharp_money_signals', count(*), count(*) FILTER (WHERE is_sharp_signal) FROM sharp""",
        "div",
        "sharp",
    ),
)
def q_table_counts(spark, sf):
    from linecast.sources.tables import table_counts

    return table_counts(
        {
            "raw_odds": (td.raw_odds(spark, sf), None),
            "raw_kalshi": (td.raw_quotes(spark, sf), None),
            "raw_game_events": (td.scoreboard_events(spark, sf), None),
            "divergence_signals": (div_silver(spark, sf), "is_divergence_signal"),
            "sharp_money_signals": (sharp_silver(spark, sf), "is_sharp_signal"),
        }
    )


# =============================================================================================
# Streaming and file sinks (each run writes to a fresh folder under the shared checkpoint folder)


EVENTS_DDL = "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING, value DOUBLE, props STRING"


@query(
    "ingest_json_stream",
    "SELECT *, CAST(year(ts) AS INTEGER) AS year, CAST(month(ts) AS INTEGER) AS month, CAST(day(ts) AS INTEGER) AS day FROM events",
)
def q_ingest_json_stream(spark, sf):
    """S7 landing (year=/month=/day= by arrival time) then S1 once-per-file stream into Bronze."""
    base = scratch_path(spark, "ingest")
    ING.land_partitioned(td.table(spark, sf, "events"), f"{base}/landing", arrival="ts")
    schema = SC.struct(EVENTS_DDL + ", year INT, month INT, day INT")
    q = ING.ingest_json_stream(spark, f"{base}/landing", schema, f"{base}/bronze", f"{base}/_ckpt")
    ING.run(q)
    # A second run finds no new files and adds nothing.
    ING.run(ING.ingest_json_stream(spark, f"{base}/landing", schema, f"{base}/bronze", f"{base}/_ckpt"))
    return ING.read_bronze(spark, f"{base}/bronze")


@query(
    "load_history",
    O.with_ctes(round_sql("SELECT * FROM sharp WHERE is_sharp_signal", SHARP_DOUBLES), "sharp"),
)
def q_load_history(spark, sf):
    """S10 + S11 + S12 + W3: two signal runs export the same flagged rows under new file names, both
    exports are loaded (duplicates, quirk Q11), minute dedup collapses them."""
    base = scratch_path(spark, "history")
    sig = sharp_signals(spark, sf)
    T.write_signals(sig, f"{base}/silver")
    silver = T.read_signals(spark, f"{base}/silver").drop("computed_date")
    schema = SC.sharp_money_signals()
    for k in range(2):
        # the second export spells its names in upper case and carries broken lines
        T.export_signals_json(silver.toDF(*[c.upper() if k else c for c in silver.columns]), "is_sharp_signal", f"{base}/export")
        if k:
            broken = silver.select(F.concat(F.lit('{"computed_at": "never", "team": "'), "team", F.lit('"}')).alias("value"))
            broken.unionByName(silver.select(F.col("team").alias("value"))).write.mode("append").text(f"{base}/export")
        ING.run(ING.load_history(spark, f"{base}/export", schema, f"{base}/warehouse", f"{base}/_ckpt", errors=f"{base}/errors"))
    if spark.read.text(f"{base}/errors").count() != 2 * silver.count():
        raise RuntimeError("broken lines must all reach the error folder")
    loaded = spark.read.parquet(f"{base}/warehouse").drop(ING.LOAD, "load_date")
    dedup = S.minute_dedup(loaded, S.SHARP_ROW, order=("computed_at",))
    out = dedup.select(*[F.col(c).cast("timestamp_ntz").alias(c) if c in ("computed_at", "commence_time", "ingested_at_ts") else F.col(c) for c in dedup.columns])
    return round_doubles(out)


@query("incremental_sharp_money", O.with_ctes(round_sql("SELECT * FROM sharp", SHARP_DOUBLES), "sharp"))
def q_incremental_sharp_money(spark, sf):
    """Sharp money as a stream in two runs: the first half of the month, then the second half
    arrives; the second run continues every series from the state table."""
    base = scratch_path(spark, "incsharp")
    flat = flat_odds(spark, sf)
    cut = F.col("ingested_at") < F.lit("2024-01-16").cast("timestamp_ntz")
    schema = flat.schema
    kw = dict(books=td.TEST_BOOKS, computed_at=batch_of(), tie=("event_id",))
    for part, cond in (("a", cut), ("b", ~cut)):
        flat.where(cond).write.mode("overwrite").parquet(f"{base}/src/part={part}")
        stream = spark.readStream.schema(schema).parquet(f"{base}/src/part=*")
        ING.run(INC.incremental_sharp_money(spark, stream, f"{base}/out", f"{base}/state", f"{base}/_ckpt", **kw))
    return round_doubles(spark.read.parquet(f"{base}/out").drop("batch_id"))


_BOOKS_SQL = ", ".join(f"'{b}'" for b in td.TEST_BOOKS)
# Two runs: the first half of the month but for every seventh row, then the rest. A held-back row is late
# if the first run had a later row of its series.
_LATE = f"""SELECT o.*, NOT early AND EXISTS (SELECT 1 FROM marked f WHERE f.early AND f.id = o.id
        AND f.bookmaker_key = o.bookmaker_key AND f.team = o.team AND (f.ingested_at, f.event_id) > (o.ingested_at, o.event_id)) AS late
      FROM marked o"""
_MARKED = f"""SELECT *, ingested_at < TIMESTAMP '2024-01-16' AND event_id % 7 <> 3 AS early FROM odds
      WHERE bookmaker_key IN ({_BOOKS_SQL})"""
O.register("marked", _MARKED, ("odds",))
O.register("arrivals", _LATE, ("marked",))
O.register("ontime_moves", "SELECT *, lag(american_odds) OVER w AS prev_odds, lag(implied_prob) OVER w AS prev_prob FROM arrivals WHERE NOT late WINDOW w AS (PARTITION BY id, bookmaker_key, team ORDER BY ingested_at, event_id)", ("arrivals",))
O.register("ontime_sharp", O.CTES["sharp"][0].replace("FROM moves", "FROM ontime_moves"), ("ontime_moves",))


def _out_of_order(spark, sf, name):
    """Path of one output of a stream run in two parts, the second with late rows and replayed once."""
    base = scratch_path(spark, "incorder")
    flat = flat_odds(spark, sf)
    early = (F.col("ingested_at") < F.lit("2024-01-16").cast("timestamp_ntz")) & (F.col("event_id") % 7 != 3)
    kw = dict(books=td.TEST_BOOKS, computed_at=batch_of(), tie=("event_id",), late_path=f"{base}/late")
    for part, cond in (("a", early), ("b", ~early)):
        flat.where(cond).write.parquet(f"{base}/src/part={part}")
        stream = spark.readStream.schema(flat.schema).parquet(f"{base}/src/part=*")
        ING.run(INC.incremental_sharp_money(spark, stream, f"{base}/out", f"{base}/state", f"{base}/_ckpt", **kw))
    # a batch that is handled again replaces what it wrote
    INC.sharp_money_batch(spark, spark.read.schema(flat.schema).parquet(f"{base}/src/part=b"), 1, f"{base}/out", f"{base}/state", **kw)
    return spark.read.parquet(f"{base}/{name}").drop("batch_id")


@query("incremental_out_of_order", O.with_ctes(round_sql("SELECT * FROM ontime_sharp", SHARP_DOUBLES), "ontime_sharp"))
def q_incremental_out_of_order(spark, sf):
    return round_doubles(_out_of_order(spark, sf, "out"))


@query("incremental_late_rows", O.with_ctes("SELECT event_id, id, bookmaker_key, team, ingested_at, american_odds FROM arrivals WHERE late", "arrivals"))
def q_incremental_late_rows(spark, sf):
    return _out_of_order(spark, sf, "late").select("event_id", "id", "bookmaker_key", "team", "ingested_at", "american_odds")


@query(
    "route_by_topic",
    f"""SELECT CASE WHEN event_type = 'view' THEN 'kalshi' ELSE 'odds' END AS destination, count(*) AS n_rows,
      sum(event_id) AS sum_event_id FROM events WHERE event_type <> 'error' GROUP BY 1""",
)
def q_route_by_topic(spark, sf):
    """Messages of three topics, two routed to their landing folders, the unknown one skipped."""
    base = scratch_path(spark, "route")
    ev = td.table(spark, sf, "events")
    topic = F.when(F.col("event_type") == "view", "raw-kalshi-markets").when(F.col("event_type") == "error", "raw-unknown").otherwise("raw-odds")
    msgs = ev.select(topic.alias("topic"), F.to_json(F.struct("event_id", "event_type", "value")).alias("value"))
    msgs.write.parquet(f"{base}/topic_log")
    stream = spark.readStream.schema(msgs.schema).parquet(f"{base}/topic_log")
    routes = {"raw-odds": "odds", "raw-kalshi-markets": "kalshi"}
    for _ in range(2):  # the second run finds nothing new
        ING.run(ING.route_by_topic(stream, routes, f"{base}/landing", f"{base}/_ckpt"))
    u = spark.read.schema("event_id BIGINT, feed STRING").json(f"{base}/landing")
    return u.groupBy(F.col("feed").alias("destination")).agg(F.count(F.lit(1)).alias("n_rows"), F.sum("event_id").alias("sum_event_id"))


_TOPIC_COLS = FLAT_COLS.replace(", event_id", "")


@query("topic_log_to_bronze", O.with_ctes(round_sql(f"SELECT {_TOPIC_COLS} FROM odds", ["implied_prob"]), "odds"))
def q_topic_log_to_bronze(spark, sf):
    """S4/S6 -> S7 -> S1 -> P1: raw odds records in a topic log, routed, landed, drained into Bronze and
    flattened, equal the direct flattening. (The log is a folder; Kafka itself is not installed here.)"""
    base = scratch_path(spark, "topiclog")
    raw = td.raw_odds(spark, sf).drop("event_id")
    line = F.to_json(F.struct(*raw.columns), {"timestampNTZFormat": ING.JSON_TS_OPTIONS["timestampNTZFormat"]})
    raw.select(F.lit("raw-odds").alias("topic"), line.alias("value")).write.parquet(f"{base}/topic_log")
    stream = spark.readStream.schema("topic STRING, value STRING").parquet(f"{base}/topic_log")
    jobs.job_topics(spark, stream, {"raw-odds": "odds"}, f"{base}/landing", f"{base}/bronze", f"{base}/_ckpt")
    flat = flatten_odds(jobs.read_feed(spark, f"{base}/bronze", f"{base}/_ckpt", "odds"))
    times = [F.col(c).cast("timestamp").cast("timestamp_ntz").alias(c) if c in ("commence_time", "ingested_at") else F.col(c) for c in flat.columns]
    flat = flat.select(*times).withColumn("id", F.col("id").cast("long"))  # the feed declares text ids
    return round_doubles(flat.select(*[c.strip() for c in _TOPIC_COLS.split(",")]))


@query(
    "quarantine",
    """SELECT event_id, CASE WHEN event_id % 10 IN (0, 1, 2) THEN NULL ELSE CAST(json_extract(props, '$.k') AS BIGINT) END AS k,
      event_id % 10 IN (0, 1, 2) AS quarantined FROM events""",
)
def q_quarantine(spark, sf):
    """Of ten messages one is cut short (not JSON), one has a text where a number is declared, one
    is an array; all three go to the error side. One repeats its key with the same value, and stays."""
    n = F.col("event_id") % 10
    ev = td.table(spark, sf, "events")
    value = F.when(n == 0, F.expr("substr(props, 1, length(props) - 1)")).when(n == 1, F.lit('{"k": "abc"}'))
    value = value.when(n == 2, F.concat(F.lit("["), "props", F.lit("]"))).when(n == 3, F.expr("concat(substr(props, 1, length(props) - 1), ', ', substr(props, 2))"))
    raw = ev.select("event_id", value.otherwise(F.col("props")).alias("value"))
    good, bad = ING.quarantine(raw, "value", SC.struct("k BIGINT"), keep=("event_id",))
    return good.select("event_id", "k", F.lit(False).alias("quarantined")).unionByName(
        bad.select("event_id", F.lit(None).cast("long").alias("k"), F.lit(True).alias("quarantined"))
    )


@query(
    "evolve_schema",
    "SELECT event_id, ts, user_id, event_type, value, CASE WHEN event_type = 'view' THEN NULL ELSE props END AS props FROM events",
)
def q_evolve_schema(spark, sf):
    """The first landing files lack ``props``, which is not declared either; the files of the second
    run carry it. The stream takes the grown schema before it reads them, so no value is lost."""
    base = scratch_path(spark, "evolve")
    ev = td.table(spark, sf, "events")
    declared = SC.struct("event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING, value DOUBLE")
    for part in (ev.where(F.col("event_type") == "view").drop("props"), ev.where(F.col("event_type") != "view")):
        part.write.mode("append").options(**ING.JSON_TS_OPTIONS).json(f"{base}/landing")
        schema = ING.evolving_schema(spark, f"{base}/landing", f"{base}/_schema", declared)
        ING.run(ING.ingest_json_stream(spark, f"{base}/landing", schema, f"{base}/bronze", f"{base}/_ckpt"))
    return ING.read_bronze(spark, f"{base}/bronze")


@query(
    "infer_json_schema",
    """SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') AS ts, user_id, event_type, value, props,
      CAST(year(ts) AS INTEGER) AS year, CAST(month(ts) AS INTEGER) AS month, CAST(day(ts) AS INTEGER) AS day FROM events""",
)
def q_infer_json_schema(spark, sf):
    """S3 + S1: infer the landing files' schema once (stored next to the checkpoint), then ingest
    with it; a second inference call reuses the stored schema."""
    base = scratch_path(spark, "infer")
    ING.land_partitioned(td.table(spark, sf, "events"), f"{base}/landing", arrival="ts")
    schema = ING.infer_json_schema(spark, f"{base}/landing", f"{base}/_schema")
    again = ING.infer_json_schema(spark, f"{base}/landing", f"{base}/_schema")
    if again != schema:
        raise RuntimeError("stored schema was not reused")
    ING.run(ING.ingest_json_stream(spark, f"{base}/landing", schema, f"{base}/bronze", f"{base}/_ckpt"))
    return ING.read_bronze(spark, f"{base}/bronze")


@query(
    "active_sports",
    O.with_ctes(
        "SELECT event_id, sport_key, bookmaker_key, team, american_odds FROM odds "
        "WHERE sport_key IN ('basketball_nba', 'basketball_ncaab')",
        "odds",
    ),
)
def q_active_sports(spark, sf):
    """Odds rows of the sports the configuration marks active (semi-join with the small dim)."""
    sport_dim, _, _ = td.test_dims(spark, sf)
    active = D.active_sports(sport_dim).select("sport_key")
    odds = flat_odds(spark, sf).select("event_id", "sport_key", "bookmaker_key", "team", "american_odds")
    return odds.join(active, "sport_key", "left_semi")


@query("ticker_stream", _GAMES_TO_TICKERS_SQL)
def q_ticker_stream(spark, sf):
    """Chained stream: parsed game events arrive as files; each micro-batch drains the last record
    per game and builds its ticker (all files pending at start form one availableNow batch, so the
    result equals the batch job)."""
    base = scratch_path(spark, "tickerstream")
    games = parsed_games(spark, sf)
    games.write.parquet(f"{base}/games")
    sport_dim, team_dim, _ = td.test_dims(spark, sf)
    stream = spark.readStream.schema(games.schema).parquet(f"{base}/games")
    ING.run(INC.ticker_stream(stream, sport_dim, team_dim, f"{base}/out", f"{base}/_ckpt", order=("seq",)))
    return spark.read.parquet(f"{base}/out").drop("batch_id")


# =============================================================================================
# One-game reads with bound values (T3, T4, P9), S9 and the jobs of SURVEY 2.11

GAME = ("H7", "A7")
_GAME_SQL = "home_team = 'H7' AND away_team = 'A7'"


@query("by_game_bound", _div_sql(f"SELECT * FROM div WHERE {_GAME_SQL}", "div"))
def q_by_game_bound(spark, sf):
    return round_doubles(S.by_game(div_silver(spark, sf), *GAME))


@query("divergence_history_game", _div_sql(f"SELECT home_team, away_team, {', '.join(S.DIVERGENCE_HISTORY_COLS)} FROM div WHERE {_GAME_SQL}", "div"))
def q_divergence_history_game(spark, sf):
    return round_doubles(S.history(div_silver(spark, sf), S.DIVERGENCE_HISTORY_COLS, *GAME))


@query("odds_history_game", O.with_ctes(f"SELECT home_team, away_team, {', '.join(S.ODDS_HISTORY_COLS)} FROM sharp WHERE {_GAME_SQL}", "sharp"))
def q_odds_history_game(spark, sf):
    return round_doubles(S.history(sharp_silver(spark, sf), S.ODDS_HISTORY_COLS, *GAME))


@query("stamp_ingested_at", "SELECT event_id, TRUE AS replaced, TRUE AS well_formed FROM events")
def q_stamp_ingested_at(spark, sf):
    """An earlier value is replaced, and the new one is UTC ISO-8601 of this run."""
    ev = td.table(spark, sf, "events").select("event_id", F.lit("2000-01-01T00:00:00Z").alias("ingested_at"))
    now = ING.stamp_ingested_at(ev)
    form = r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d\.\d{6}Z$"
    return now.select("event_id", (F.col("ingested_at") > "2020").alias("replaced"), F.col("ingested_at").rlike(form).alias("well_formed"))


def _signals_job(spark, sf) -> jobs.SignalOutputs:
    base = scratch_path(spark, "jobsignals")
    raw_odds, raw_quotes = td.raw_odds(spark, sf).drop("event_id"), td.raw_quotes(spark, sf).drop("event_id")
    width = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        return jobs.job_signals(spark, raw_odds, raw_quotes, base, batch_of(), sharp_books=td.TEST_BOOKS)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", width)  # the job sizes it for its own inputs


@query("job_history_divergence", _div_sql("SELECT * FROM div WHERE is_divergence_signal", "div"))
def q_job_history_divergence(spark, sf):
    """W3 on divergence: one export loaded twice under new file names gives each flagged row once."""
    base = scratch_path(spark, "jobhistory")
    for _ in range(2):
        T.export_signals_json(div_silver(spark, sf), "is_divergence_signal", f"{base}/export")
        out = jobs.job_history(spark, {"divergence": f"{base}/export"}, f"{base}/warehouse", f"{base}/_ckpt")["divergence"]
    times = ("computed_at", "commence_time", "quote_ingested_at")
    return round_doubles(out.select(*[F.col(c).cast("timestamp_ntz").alias(c) if c in times else F.col(c) for c in out.columns]))


@query("job_sharp_money", O.with_ctes("SELECT count(*) AS n_rows, count(*) FILTER (is_sharp_signal) AS n_flagged, sum(odds_movement) AS sum_movement FROM sharp", "sharp"))
def q_job_sharp_money(spark, sf):
    """The sharp-money half of ``job_signals``, from the committed table."""
    s = T.read_signals(spark, _signals_job(spark, sf).sharp_path)
    return s.agg(F.count("*").alias("n_rows"), F.count_if("is_sharp_signal").alias("n_flagged"), F.sum("odds_movement").alias("sum_movement"))


@query("job_board_divergence", O.with_ctes(round_sql(f"SELECT *, divergence_pct / greatest(coalesce(max(divergence_pct) OVER (), 1.0), 1.0) AS bar_share, CAST(NULL AS VARCHAR) AS score_state, 2 AS state_rank FROM ({_DIV_BOARD}) b", ["divergence_pct", "bar_share"]), "latest_div"))
def q_job_board_divergence(spark, sf):
    return round_doubles(jobs.job_board(div_silver(spark, sf, True), sharp_silver(spark, sf, True))["divergence"])


@query("job_series_odds", ORACLE["pivot_odds"])
def q_job_series_odds(spark, sf):
    return round_doubles(jobs.job_series(div_silver(spark, sf), sharp_silver(spark, sf))["odds"])


@query("job_tickers", _GAMES_TO_TICKERS_SQL)
def q_job_tickers(spark, sf):
    sport_dim, team_dim, _ = td.test_dims(spark, sf)
    markets = spark.createDataFrame([], "event_ticker STRING, market_ticker STRING")
    return jobs.job_tickers(parsed_games(spark, sf), sport_dim, team_dim, markets, order=("seq",))["tickers"]


def _job_tickers(spark, sf):
    """The job over the games of the odds feed, with the markets of ``ticker_lookup``."""
    sport_dim, team_dim, _ = td.test_dims(spark, sf)
    games = flat_odds(spark, sf, poll="day").select("sport_key", "home_team", "away_team", "commence_time").distinct()
    q = td.raw_quotes(spark, sf).select(
        F.col("sport").alias("sport_key"), "home_team", "away_team", "game_date", "market_ticker", "status", "ingested_at", "event_id"
    )
    markets = D.games_to_tickers(q, sport_dim, team_dim, tz="UTC", start_col="game_date")
    markets = markets.select("event_ticker", "market_ticker", "status", "ingested_at", "event_id")
    return jobs.job_tickers(games, sport_dim, team_dim, markets, tz="UTC", order=("commence_time",))


_ODDS_DRAINED = """(SELECT sport_key, home_team, away_team, commence_time, substr(CAST(commence_time AS VARCHAR), 1, 10) AS game_date
      FROM odds_games QUALIFY row_number() OVER (PARTITION BY sport_key, home_team, away_team, substr(CAST(commence_time AS VARCHAR), 1, 10)
                                                 ORDER BY commence_time DESC) = 1) dr"""


@query(
    "job_tickers_markets",
    O.with_ctes(
        f"""SELECT t.*, m.market_ticker, m.status, m.ingested_at, m.event_id
      FROM ({_ticker_sql(_ODDS_DRAINED, 'commence_time', 'UTC', 'sport_key, home_team, away_team, commence_time, game_date')}) t
      JOIN ({_ticker_sql('quote_games', 'game_date', 'UTC', 'market_ticker, status, ingested_at, event_id')}) m
        ON t.event_ticker = m.event_ticker""",
        "odds_games",
        "quote_games",
    ),
)
def q_job_tickers_markets(spark, sf):
    return _job_tickers(spark, sf)["markets"]


@query(
    "job_tickers_unmatched",
    O.with_ctes(
        """SELECT DISTINCT sport_key, team FROM (SELECT sport_key, home_team AS team FROM odds_games
        UNION ALL SELECT sport_key, away_team FROM odds_games) s
      WHERE CAST(substr(team, 2) AS INTEGER) >= 25 AND sport_key IN ('basketball_nba', 'basketball_ncaab')""",
        "odds_games",
    ),
)
def q_job_tickers_unmatched(spark, sf):
    return _job_tickers(spark, sf)["unmatched"]


# Rows that need more than one table or run; they register themselves here.
from linecast.plans import flows  # noqa: E402, F401
