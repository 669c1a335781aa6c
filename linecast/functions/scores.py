"""Scoreboard expressions (F9, F10, F11): nested event structs to flat game columns.

Competitors are looked up with ``array_position`` over the extracted field array - plain
expressions that whole-stage codegen compiles and de-duplicates (a lambda ``filter`` per field
would run interpreted, once per use).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the studied pipeline.
SCORE_SOURCE = "espn"
DEFAULT_STATE = "pre"
DEFAULT_SCORE = "0"
DEFAULT_STATUS = "Scheduled"
LIVE_STATES = ("in", "post")
PERIODS_BY_SPORT = {"basketball_nba": ("Q", 4), "basketball_ncaab": ("H", 2)}


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _or_default(c: Column, default) -> Column:
    """JavaScript ``x || d``: null and empty text both take the default."""
    if isinstance(default, str):
        return F.when(c.isNull() | (c == F.lit("")), F.lit(default)).otherwise(c)
    return F.when(c.isNull() | (c == F.lit(0)), F.lit(default)).otherwise(c)


def first_match(arr: Column, field: str, value) -> Column:
    """First element of an array of structs whose ``field`` equals ``value``, else null."""
    return F.get(arr, F.array_position(arr[field], F.lit(value)).cast("int") - 1)


def event_sides(event: Column | str) -> tuple[Column, Column]:
    """Home (order 0) and away (order 1) competitor of an event's first competition."""
    competitors = F.get(_col(event)["competitions"], 0)["competitors"]
    return first_match(competitors, "order", 0), first_match(competitors, "order", 1)


def competition_sides(competition: Column | str) -> tuple[Column, Column]:
    """Home and away competitor of a competition by ``homeAway``."""
    competitors = _col(competition)["competitors"]
    return first_match(competitors, "homeAway", "home"), first_match(competitors, "homeAway", "away")


def event_columns(event: Column | str, sport_key: Column | str, home: Column | None = None, away: Column | None = None) -> list[Column]:
    """F9 fields of one scoreboard event as named columns (first competition only; ``scores`` only
    for live or finished games). Pass ``home``/``away`` when extracted by an earlier projection."""
    e = _col(event)
    sport = _col(sport_key)
    comp = F.get(e["competitions"], 0)
    if home is None or away is None:
        home, away = event_sides(e)
    stype = e["status"]["type"]
    state = F.coalesce(stype["state"], F.lit(DEFAULT_STATE))
    home_score = F.coalesce(home["score"], F.lit(DEFAULT_SCORE))
    away_score = F.coalesce(away["score"], F.lit(DEFAULT_SCORE))
    home_name = F.coalesce(home["team"]["displayName"], F.lit(""))
    away_name = F.coalesce(away["team"]["displayName"], F.lit(""))
    scores = F.when(
        state.isin(*LIVE_STATES),
        F.array(
            F.struct(home_name.alias("name"), home_score.alias("score")),
            F.struct(away_name.alias("name"), away_score.alias("score")),
        ),
    )
    return [
        sport.alias("sport"),
        e["id"].alias("game_id"),
        sport.alias("sport_key"),
        F.coalesce(comp["type"]["abbreviation"], sport).alias("sport_title"),
        e["date"].alias("commence_time"),
        F.coalesce(stype["completed"], F.lit(False)).alias("completed"),
        state.alias("status_state"),
        F.coalesce(stype["description"], F.lit("")).alias("status_description"),
        home_name.alias("home_team"),
        away_name.alias("away_team"),
        home_score.alias("home_score"),
        away_score.alias("away_score"),
        scores.alias("scores"),
        F.coalesce(stype["shortDetail"], F.lit("")).alias("last_update"),
        F.lit(SCORE_SOURCE).alias("source"),
    ]


def competition_columns(event_date: Column | str, competition: Column | str, home: Column | None = None, away: Column | None = None) -> list[Column]:
    """F10 fields of one competition as named columns; home/away by ``homeAway``; key ``away|home``."""
    comp = _col(competition)
    if home is None or away is None:
        home, away = competition_sides(comp)
    status = comp["status"]
    home_name = home["team"]["displayName"]
    away_name = away["team"]["displayName"]
    return [
        F.concat_ws("|", away_name, home_name).alias("game_key"),
        home_name.alias("home_team"),
        away_name.alias("away_team"),
        _or_default(home["score"], DEFAULT_SCORE).alias("home_score"),
        _or_default(away["score"], DEFAULT_SCORE).alias("away_score"),
        _or_default(status["type"]["description"], DEFAULT_STATUS).alias("status"),
        _or_default(status["type"]["state"], DEFAULT_STATE).alias("state"),
        F.coalesce(status["period"], F.lit(0)).alias("period"),
        _or_default(status["displayClock"], "").alias("display_clock"),
        _or_default(_col(event_date), "").alias("commence_time"),
    ]


def leading_int(s: Column | str) -> Column:
    """JavaScript ``parseInt``: leading integer of the text, null when there is none."""
    txt = _or_default(_col(s), DEFAULT_SCORE)
    digits = F.regexp_extract(txt, r"^\s*([+-]?\d+)", 1)
    return F.when(digits != "", digits.cast("long"))


def home_winning(home_score: Column | str, away_score: Column | str) -> Column:
    return F.coalesce(leading_int(home_score) > leading_int(away_score), F.lit(False))


def away_winning(home_score: Column | str, away_score: Column | str) -> Column:
    return F.coalesce(leading_int(away_score) > leading_int(home_score), F.lit(False))


def period_label(sport_key: Column | str, period: Column | str) -> Column:
    """Q1..Q4 / OTn for the NBA, H1..H2 / OTn for college, Pn otherwise, '' before tip-off."""
    sport = _col(sport_key)
    p = _col(period).cast("int")
    label = F.concat(F.lit("P"), p.cast("string"))
    for key, (letter, regular) in PERIODS_BY_SPORT.items():
        label = F.when(
            sport == key,
            F.when(p <= regular, F.concat(F.lit(letter), p.cast("string"))).otherwise(
                F.concat(F.lit("OT"), (p - regular).cast("string"))
            ),
        ).otherwise(label)
    return F.when(p.isNull() | (p == 0), F.lit("")).otherwise(label)
