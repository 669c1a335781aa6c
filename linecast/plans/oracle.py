"""The test-data mapping of ``linecast.plans.testdata`` and the signal jobs, as DuckDB SQL.

Used only by ``__spark_entry__.oracle_sql()``: the driver runs these texts on the same parquet
tables and compares results with the Spark queries. CTEs are declared once with their
dependencies; :func:`with_ctes` assembles the ``WITH`` chain a query needs.
"""

from __future__ import annotations

GAME = "user_id % 40"
SPORT = (
    f"CASE WHEN {GAME} % 3 = 0 THEN 'basketball_nba' WHEN {GAME} % 3 = 1 THEN 'basketball_ncaab' "
    "ELSE 'basketball_wncaab' END"
)
TITLE = f"CASE WHEN {GAME} % 3 = 0 THEN 'NBA' WHEN {GAME} % 3 = 1 THEN 'NCAAB' ELSE 'WNCAAB' END"
TEAM = f"concat(CASE WHEN event_id % 2 = 0 THEN 'H' ELSE 'A' END, CAST({GAME} AS VARCHAR))"
ODDS_VALUE = (
    "CASE WHEN event_id % 4 < 2 THEN -(100 + CAST(floor(value) AS BIGINT)) ELSE 100 + CAST(floor(value) AS BIGINT) END"
)


def prob(o: str) -> str:
    """F1 in SQL."""
    return (
        f"CASE WHEN {o} IS NULL THEN NULL WHEN {o} < 0 THEN -CAST({o} AS DOUBLE) / (-CAST({o} AS DOUBLE) + 100.0) "
        f"ELSE 100.0 / (CAST({o} AS DOUBLE) + 100.0) END"
    )


def _odds(poll: str) -> str:
    return f"""SELECT {GAME} AS id, {SPORT} AS sport_key, {TITLE} AS sport_title,
      concat('H', CAST({GAME} AS VARCHAR)) AS home_team, concat('A', CAST({GAME} AS VARCHAR)) AS away_team,
      date_trunc('day', ts) + INTERVAL 23 HOUR AS commence_time, {poll} AS ingested_at, event_id,
      event_type AS bookmaker_key, upper(substr(event_type, 1, 1)) || substr(event_type, 2) AS bookmaker_title,
      {TEAM} AS team, {ODDS_VALUE} AS american_odds, {prob(ODDS_VALUE)} AS implied_prob
    FROM events WHERE event_type <> 'view'"""


CTES: dict[str, tuple[str, tuple[str, ...]]] = {
    # flat odds, ingest time = event time (sharp money) and truncated to the day (consensus polls)
    "odds": (_odds("ts"), ()),
    "odds_day": (_odds("date_trunc('day', ts)"), ()),
    "quotes_raw": (
        f"""SELECT {SPORT} AS sport, concat('EVT-', CAST({GAME} AS VARCHAR)) AS event_ticker,
      concat('A', CAST({GAME} AS VARCHAR)) AS away_team, concat('H', CAST({GAME} AS VARCHAR)) AS home_team,
      strftime(ts, '%Y-%m-%d') AS game_date,
      concat('EVT-', CAST({GAME} AS VARCHAR), '-', {TEAM}) AS market_ticker, 'Winner?' AS title,
      CASE WHEN value < 1 THEN NULL ELSE least(value / 100.0, 0.97) + 0.02 END AS yes_ask,
      least(value / 100.0, 0.97) AS yes_bid,
      CASE WHEN event_id % 5 = 0 THEN 'closed' ELSE 'active' END AS status,
      event_id AS volume, user_id AS open_interest, ts AS ingested_at, event_id
    FROM events WHERE event_type = 'view'""",
        (),
    ),
    "quotes": (
        """SELECT event_ticker, market_ticker, sport, home_team, away_team, game_date, ingested_at, title, event_id,
      yes_ask, yes_bid, (yes_ask + yes_bid) / 2 AS kalshi_implied_prob
    FROM quotes_raw WHERE status = 'active' AND (yes_ask + yes_bid) / 2 IS NOT NULL AND (yes_ask + yes_bid) / 2 > 0""",
        ("quotes_raw",),
    ),
    "cons": (
        """SELECT id, sport_key, sport_title, home_team, away_team, commence_time, ingested_at, team,
      avg(implied_prob) AS avg_implied_prob, CAST(count(bookmaker_key) AS INTEGER) AS num_bookmakers
    FROM odds_day GROUP BY id, sport_key, sport_title, home_team, away_team, commence_time, ingested_at, team""",
        ("odds_day",),
    ),
    "home_odds": (
        """SELECT id, sport_key, home_team, away_team, commence_time, ingested_at,
      avg_implied_prob AS sportsbook_home_prob, num_bookmakers FROM cons WHERE team = home_team""",
        ("cons",),
    ),
    "div_pairs": (
        """SELECT q.*, h.sport_key, h.commence_time, h.sportsbook_home_prob, h.num_bookmakers
    FROM quotes q ASOF JOIN home_odds h
      ON q.home_team = h.home_team AND q.away_team = h.away_team AND q.ingested_at >= h.ingested_at""",
        ("quotes", "home_odds"),
    ),
    "div": (
        """SELECT 'divergence' AS signal_type, date_trunc('day', ingested_at) AS computed_at, sport_key, home_team,
      away_team, commence_time, event_ticker, market_ticker, kalshi_implied_prob, sportsbook_home_prob,
      abs(kalshi_implied_prob - sportsbook_home_prob) AS divergence,
      CASE WHEN kalshi_implied_prob > sportsbook_home_prob THEN 'KALSHI_HIGHER' ELSE 'SPORTSBOOK_HIGHER' END
        AS signal_direction,
      abs(kalshi_implied_prob - sportsbook_home_prob) >= 0.05 AS is_divergence_signal, num_bookmakers,
      ingested_at AS quote_ingested_at
    FROM div_pairs""",
        ("div_pairs",),
    ),
    "moves": (
        """SELECT *, lag(american_odds) OVER w AS prev_odds, lag(implied_prob) OVER w AS prev_prob
    FROM odds WHERE bookmaker_key IN ('click', 'error', 'purchase', 'signup')
    WINDOW w AS (PARTITION BY id, bookmaker_key, team ORDER BY ingested_at, event_id)""",
        ("odds",),
    ),
    "sharp": (
        """SELECT 'sharp_money' AS signal_type, date_trunc('day', ingested_at) AS computed_at, sport_key, home_team,
      away_team, commence_time, bookmaker_key, team, prev_odds, american_odds,
      abs(american_odds - prev_odds) AS odds_movement, round(prev_prob, 4) AS prev_implied_prob,
      round(implied_prob, 4) AS current_implied_prob, round(abs(implied_prob - prev_prob), 4) AS prob_movement,
      CASE WHEN american_odds > prev_odds THEN 'ODDS_LENGTHENING' ELSE 'ODDS_SHORTENING' END AS movement_direction,
      abs(american_odds - prev_odds) >= 10 AS is_sharp_signal, ingested_at AS ingested_at_ts
    FROM moves WHERE prev_odds IS NOT NULL""",
        ("moves",),
    ),
}


def register(name: str, sql: str, deps: tuple[str, ...] = ()) -> None:
    CTES[name] = (sql, deps)


def with_ctes(body: str, *needed: str) -> str:
    """``WITH`` chain holding ``needed`` and everything they depend on, in dependency order."""
    order: list[str] = []

    def visit(n: str) -> None:
        if n in order:
            return
        for d in CTES[n][1]:
            visit(d)
        order.append(n)

    for n in needed:
        visit(n)
    if not order:
        return body
    parts = ",\n".join(f"{n} AS (\n  {CTES[n][0]}\n)" for n in order)
    return f"WITH {parts}\n{body}"


def sport_sql(game: str) -> str:
    return (
        f"CASE WHEN {game} % 3 = 0 THEN 'basketball_nba' WHEN {game} % 3 = 1 THEN 'basketball_ncaab' "
        "ELSE 'basketball_wncaab' END"
    )


def local_sql(ts: str, tz: str) -> str:
    """Wall clock of UTC instant ``ts`` in ``tz``."""
    return f"timezone('{tz}', timezone('UTC', {ts}))"


INITCAP_STATE = "upper(substr(state, 1, 1)) || substr(state, 2)"

register(
    "sb_events",
    f"""SELECT o_orderkey AS seq, {sport_sql('o_custkey % 40')} AS sport_key, CAST(o_custkey % 40 AS VARCHAR) AS g,
      CASE o_orderstatus WHEN 'F' THEN 'post' WHEN 'O' THEN 'pre' ELSE 'in' END AS state,
      CAST(CAST(floor(o_totalprice) AS BIGINT) % 120 AS VARCHAR) AS home_score,
      CAST(o_orderkey % 110 AS VARCHAR) AS away_score, CAST(o_orderkey % 6 AS INTEGER) AS period,
      CAST(o_orderkey % 20 AS VARCHAR) || ':00' AS display_clock,
      strftime(o_orderdate, '%Y-%m-%dT%H:%MZ') AS date, o_orderpriority AS abbreviation
    FROM orders""",
)
register(
    "sb_parsed",
    f"""SELECT sport_key AS sport, CAST(seq AS VARCHAR) AS game_id, sport_key, abbreviation AS sport_title,
      date AS commence_time, state = 'post' AS completed, state AS status_state, {INITCAP_STATE} AS status_description,
      'H' || g AS home_team, 'A' || g AS away_team, home_score, away_score, state IN ('in', 'post') AS has_scores,
      'Q' || CAST(seq % 4 + 1 AS VARCHAR) AS last_update, 'espn' AS source, seq
    FROM sb_events""",
    ("sb_events",),
)
register(
    "sb_latest",
    f"""SELECT 'A' || g || '|' || 'H' || g AS game_key, 'H' || g AS home_team, 'A' || g AS away_team, home_score,
      away_score, {INITCAP_STATE} AS status, state, period, display_clock, date AS commence_time, sport_key
    FROM sb_events QUALIFY row_number() OVER (PARTITION BY g ORDER BY seq DESC) = 1""",
    ("sb_events",),
)
register(
    "latest_div",
    """SELECT * FROM div WHERE computed_at = (SELECT max(computed_at) FROM div)
      AND sport_key NOT IN ('basketball_wncaab', 'basketball_ncaaw')""",
    ("div",),
)
register(
    "latest_sharp",
    """SELECT * FROM sharp WHERE computed_at = (SELECT max(computed_at) FROM sharp)
      AND sport_key NOT IN ('basketball_wncaab', 'basketball_ncaaw')""",
    ("sharp",),
)
