"""Read-side operators over the two signal tables: filters, views, dedup, feeds (P6-P12, A2, A3, A7,
U1, W2, W3, T1-T4, T6).

"Latest" and "dedup" rows are picked with ``max_by`` aggregates rather than ``row_number`` windows:
one row per key and task crosses the shuffle (whole-row structs make it a sort aggregate, so each task
sorts its own rows first), and a hot game never meets in a single task.
Global maxima are scalar subqueries (``DataFrame.scalar()``), never a window over the whole table.
"""

from __future__ import annotations

import datetime as _dt
from collections.abc import Sequence
from zoneinfo import ZoneInfo

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType, IntegralType, MapType, VariantType

from linecast.functions.timefn import DASHBOARD_TZ, local_date

# Fixed values of the studied views.
WOMENS_SPORTS = ("basketball_wncaab", "basketball_ncaaw")
COLLEGE_SPORT = "basketball_ncaab"
FEED_LIMIT = 10_000
ODDS_MIN, ODDS_MAX = -2500, 2500
DEDUP_WINDOW_MINUTES = 10
GAME_KEYS = ("home_team", "away_team")
DIVERGENCE_SERIES = ("home_team", "away_team", "market_ticker")
SHARP_SERIES = ("home_team", "away_team", "bookmaker_key", "team")
# Identity of one sharp-money row: its series and the poll it compares (dedup of repeated loads).
SHARP_ROW = (*SHARP_SERIES, "ingested_at_ts")
# Identity of one divergence row: its market and the quote it judges.
DIVERGENCE_ROW = (*DIVERGENCE_SERIES, "quote_ingested_at", "kalshi_implied_prob")
SUMMARY_COLS = ("sport_key", "home_team", "away_team", "computed_at")


def exclude_womens(df: DataFrame, sports: Sequence[str] = WOMENS_SPORTS) -> DataFrame:
    """``sport_key NOT IN (...)``; a null sport key is dropped too (three-valued logic)."""
    return df.where(~F.col("sport_key").isin(list(sports)))


def by_local_date(df: DataFrame, date: str | _dt.date | None, ts: str = "commence_time", tz: str = DASHBOARD_TZ) -> DataFrame:
    """Rows whose ``ts`` falls on ``date`` in ``tz``; ``None`` keeps all."""
    if date is None:
        return df
    kind = df.schema[ts].dataType.typeName()
    if kind not in ("timestamp", "timestamp_ntz"):
        return df.where(local_date(ts, tz) == F.lit(str(date)).cast("date"))
    # The day's bounds as instants, so that the range reaches the scan.
    day = _dt.date.fromisoformat(str(date))
    bounds = [_dt.datetime.combine(d, _dt.time(), ZoneInfo(tz)).astimezone(_dt.UTC) for d in (day, day + _dt.timedelta(days=1))]
    text = [b.strftime("%Y-%m-%d %H:%M:%S") + ("" if kind == "timestamp_ntz" else "Z") for b in bounds]
    lo, hi = (F.lit(t).cast(kind) for t in text)
    return df.where((F.col(ts) >= lo) & (F.col(ts) < hi))


def by_sport(df: DataFrame, sport: str | None) -> DataFrame:
    """Equality unless the sport is null or 'all'."""
    if sport is None or sport == "all":
        return df
    return df.where(F.col("sport_key") == F.lit(sport))


def by_game(df: DataFrame, home: str | None = None, away: str | None = None, games: DataFrame | None = None) -> DataFrame:
    """Rows of one game (bound values, never string-built SQL) or of a set of games (semi-join)."""
    if games is not None:
        return df.join(games.select(*GAME_KEYS).distinct(), on=list(GAME_KEYS), how="left_semi")
    return df.where((F.col("home_team") == F.lit(home)) & (F.col("away_team") == F.lit(away)))


def plausible_odds(df: DataFrame, col: str = "american_odds", lo: int = ODDS_MIN, hi: int = ODDS_MAX) -> DataFrame:
    """P10: numeric odds within [lo, hi]."""
    kind = df.schema[col].dataType
    if isinstance(kind, (IntegralType, DecimalType)):  # compared as they are: the bounds reach the scan
        return df.where((F.col(col) >= lo) & (F.col(col) <= hi))
    v = F.col(col).try_cast("double")
    return df.where(v.isNotNull() & ~F.isnan(v) & (v >= lo) & (v <= hi))


def recent_hours(df: DataFrame, hours: float | None, as_of: str | Column, ts: str = "computed_at") -> DataFrame:
    """Rows at or after ``as_of - hours``; ``None`` keeps all. ``as_of`` is explicit (no wall clock)."""
    if hours is None:
        return df
    ref = as_of if isinstance(as_of, Column) else F.lit(as_of).cast("timestamp")
    cutoff = ref - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(float(hours) * 3600.0))
    return since_day(df, cutoff, ts).where(F.col(ts).cast("timestamp") >= cutoff)


def since_day(df: DataFrame, cutoff: Column, ts: str = "computed_at", day_partition: str = "computed_date") -> DataFrame:
    """On a table partitioned by the day of ``ts``, only the partitions from the cutoff's day on."""
    if ts != "computed_at" or day_partition not in df.columns:
        return df
    return df.where(F.col(day_partition) >= F.to_date(cutoff))


def tournament_only(df: DataFrame, teams: DataFrame, college_sport: str = COLLEGE_SPORT, team_col: str = "team") -> DataFrame:
    """College rows need both teams in the tournament field; other sports (and null sport) pass.

    One pass: the field is joined twice (broadcast by Spark where its size allows) and the rows filtered.
    """
    field = teams.select(F.col(team_col).alias("__t")).distinct()
    h = field.select(F.col("__t").alias("__h"), F.lit(True).alias("__hin"))
    a = field.select(F.col("__t").alias("__a"), F.lit(True).alias("__ain"))
    j = df.join(h, F.col("home_team") == F.col("__h"), "left").join(a, F.col("away_team") == F.col("__a"), "left")
    keep = (
        F.col("sport_key").isNull()
        | (F.col("sport_key") != F.lit(college_sport))
        | (F.coalesce(F.col("__hin"), F.lit(False)) & F.coalesce(F.col("__ain"), F.lit(False)))
    )
    return j.where(keep).select(*df.columns)


def latest_batch(
    df: DataFrame,
    ts: str = "computed_at",
    exclude: Sequence[str] | None = WOMENS_SPORTS,
    day_partition: str | None = "computed_date",
    latest: str | None = None,
) -> DataFrame:
    """A3: rows of the latest batch - ``ts`` equal to the maximum over the *whole* table, taken
    before the sport filter (quirk Q6 kept) - then P6. The maximum is a scalar subquery.

    On a table partitioned by the day of ``ts`` (``day_partition``), both the maximum and the rows
    are read from the newest day partition only (scalar-subquery partition pruning). With ``latest``,
    the batch time that the table's commit names (``tables.latest_time``), no maximum is computed and
    one literal day is read."""
    if latest is not None:
        day = _dt.date.fromisoformat(str(latest)[:10])
        src = df.where(F.col(day_partition) == F.lit(day)) if day_partition and day_partition in df.columns else df
        out = src.where(F.col(ts) == F.lit(str(latest)).cast(df.schema[ts].dataType))
        return exclude_womens(out, exclude) if exclude else out
    src = df
    if day_partition and day_partition in df.columns:
        last_day = df.select(F.max(day_partition)).scalar()
        src = df.where(F.col(day_partition) == last_day)
    mx = src.select(F.max(ts)).scalar()
    out = src.where(F.col(ts) == mx)
    return exclude_womens(out, exclude) if exclude else out


def latest_by(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Last row per key by ``order`` (``max_by`` over a struct of the other columns). Equal rows of
    ``order`` are told apart by all other columns, so the result does not depend on the plan."""
    cols = [c for c in df.columns if c not in keys]
    row = F.struct(*[F.col(c) for c in cols])
    ties = [c for c in cols if c not in order and not isinstance(df.schema[c].dataType, (MapType, VariantType))]
    latest = df.groupBy(*keys).agg(F.max_by(row, F.struct(*[F.col(o) for o in (*order, *ties)])).alias("__row"))
    return latest.select(*keys, *[F.col("__row")[c].alias(c) for c in cols]).select(*df.columns)


def latest_dedup(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str] = ("computed_at",),
    window_minutes: float = DEDUP_WINDOW_MINUTES,
    ts: str = "computed_at",
    exclude: Sequence[str] | None = WOMENS_SPORTS,
    latest: str | None = None,
) -> DataFrame:
    """Rows within ``window_minutes`` of the table's latest ``ts`` (``latest``, where the caller has
    it from the table's commit), then the latest row per key."""
    mx = df.select(F.max(ts)).scalar() if latest is None else F.lit(latest).cast(df.schema[ts].dataType)
    cutoff = mx - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(float(window_minutes) * 60.0))
    recent = since_day(df, cutoff, ts).where(F.col(ts) >= cutoff)
    if exclude:
        recent = exclude_womens(recent, exclude)
    return latest_by(recent, keys, order)


def minute_dedup(df: DataFrame, keys: Sequence[str], order: Sequence[str] = ("computed_at",), ts: str = "computed_at") -> DataFrame:
    """Truncate ``ts`` to the minute and keep the last row per key and minute (collapses rows
    loaded twice); the kept row keeps its original ``ts``."""
    with_min = df.withColumn("__minute", F.date_trunc("minute", F.col(ts)))
    out = latest_by(with_min, [*keys, "__minute"], order)
    return out.drop("__minute")


def union_signals(divergence: DataFrame, sharp: DataFrame, exclude: Sequence[str] | None = WOMENS_SPORTS) -> DataFrame:
    """The four shared columns of both signal tables, UNION ALL, each side filtered by P6."""
    d = divergence.select(*SUMMARY_COLS)
    s = sharp.select(*SUMMARY_COLS)
    if exclude:
        d, s = exclude_womens(d, exclude), exclude_womens(s, exclude)
    return d.unionByName(s)


def signals_summary(divergence: DataFrame, sharp: DataFrame, exclude: Sequence[str] | None = WOMENS_SPORTS) -> DataFrame:
    """A2 + T6: signal count and latest batch time per (sport, home, away), sport asc, count desc."""
    u = union_signals(divergence, sharp, exclude)
    agg = u.groupBy("sport_key", "home_team", "away_team").agg(
        F.count(F.lit(1)).alias("signal_count"), F.max("computed_at").alias("latest_computed_at")
    )
    return agg.orderBy(F.col("sport_key").asc(), F.col("signal_count").desc(), "home_team", "away_team")


def summary_partials(df: DataFrame, day: str = "computed_date") -> DataFrame:
    """A2's additive part of a signal table: count and latest batch time per day, sport and game. Null
    sports and excluded ones are kept; the filter belongs to the reading side."""
    return df.groupBy(day, "sport_key", *GAME_KEYS).agg(F.count(F.lit(1)).alias("n"), F.max("computed_at").alias("latest"))


def merge_summaries(*partials: DataFrame, exclude: Sequence[str] | None = WOMENS_SPORTS) -> DataFrame:
    """A2 + T6 from the partials of any number of tables and days: equal to :func:`signals_summary`."""
    u = partials[0].drop("computed_date")
    for p in partials[1:]:
        u = u.unionByName(p.drop("computed_date"))
    if exclude:
        u = exclude_womens(u, exclude)
    agg = u.groupBy("sport_key", *GAME_KEYS).agg(F.sum("n").alias("signal_count"), F.max("latest").alias("latest_computed_at"))
    return agg.orderBy(F.col("sport_key").asc(), F.col("signal_count").desc(), *GAME_KEYS)


def distinct_sports(divergence: DataFrame, sharp: DataFrame) -> DataFrame:
    """Distinct sport keys over both signal sets."""
    return divergence.select("sport_key").unionByName(sharp.select("sport_key")).distinct()


def feed_rows(latest: DataFrame, date: str | None = None, sport: str | None = None, tz: str = DASHBOARD_TZ) -> DataFrame:
    """All rows of a latest view on a local date and of a sport (P7 + P8), without order or limit."""
    return by_sport(by_local_date(latest, date, tz=tz), sport)


def feed(
    latest: DataFrame,
    order_col: str,
    date: str | None = None,
    sport: str | None = None,
    limit: int = FEED_LIMIT,
    tz: str = DASHBOARD_TZ,
) -> DataFrame:
    """P7 + P8 over a latest view, ``order_col DESC NULLS LAST`` then every other column as
    tie-break (a deterministic top-k), ``LIMIT`` - planned as TakeOrderedAndProject (per-partition
    top-k, then a k-row merge). The limit belongs to these two listings; boards group ``feed_rows``."""
    df = feed_rows(latest, date, sport, tz)
    ties = [F.col(c).asc_nulls_last() for c in df.columns if c != order_col]
    return df.orderBy(F.col(order_col).desc_nulls_last(), *ties).limit(limit)


DIVERGENCE_HISTORY_COLS = ("market_ticker", "computed_at", "kalshi_implied_prob", "sportsbook_home_prob", "divergence")
ODDS_HISTORY_COLS = ("team", "bookmaker_key", "computed_at", "american_odds", "prev_implied_prob", "current_implied_prob")


def history(
    df: DataFrame,
    cols: Sequence[str],
    home: str | None = None,
    away: str | None = None,
    games: DataFrame | None = None,
) -> DataFrame:
    """A game's (or every game's) history columns, time ascending. With neither a game nor
    a set of games, all games are returned with their keys, sorted by game then time."""
    if home is not None or games is not None:
        df = by_game(df, home, away, games)
    return df.select(*GAME_KEYS, *cols).orderBy(*GAME_KEYS, "computed_at", *[c for c in cols if c != "computed_at"])
