"""Time expressions: parsing, zone conversion, local dates and the game window.

Every function assumes ``spark.sql.session.timeZone=UTC`` (set by ``linecast.session``), so a
timestamp's wall clock is its UTC time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, TimestampNTZType, TimestampType

# Fixed values of the studied pipeline.
DASHBOARD_TZ = "America/Los_Angeles"
TICKER_TZ = "America/New_York"
GAME_WINDOW_START = "15:00"
GAME_WINDOW_END = "23:00"
EARLY_WINDOW_DAYS = ("thursday", "friday")
EARLY_WINDOW_START = "08:00"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


# ISO-8601 shapes seen in the feeds beyond what a plain cast accepts (minute precision, 'Z').
_EXTRA_FORMATS = ("yyyy-MM-dd'T'HH:mmX", "yyyy-MM-dd'T'HH:mmXXX")


def parse_ts(c: Column | str) -> Column:
    """ISO-8601 text to timestamp; unparsable text gives null instead of an error."""
    s = _col(c).cast("string")
    return F.coalesce(F.try_to_timestamp(s), *[F.try_to_timestamp(s, F.lit(f)) for f in _EXTRA_FORMATS])


def with_timestamp(df: DataFrame, name: str, out: str | None = None) -> DataFrame:
    """Ensure ``name`` is a timestamp column: keep timestamp types, parse strings."""
    dtype = df.schema[name].dataType
    out = out or name
    if isinstance(dtype, (TimestampType, TimestampNTZType)):
        return df if out == name else df.withColumn(out, F.col(name))
    if isinstance(dtype, StringType):
        return df.withColumn(out, parse_ts(name))
    return df.withColumn(out, F.col(name).cast("timestamp"))


def utc_wall(ts: Column | str) -> Column:
    """Timestamp as UTC wall clock without zone (timestamp_ntz)."""
    return _col(ts).cast("timestamp_ntz")


def to_zone(ts: Column | str, tz: str) -> Column:
    """Wall clock of a UTC instant in zone ``tz`` (timestamp_ntz)."""
    return F.convert_timezone(F.lit("UTC"), F.lit(tz), utc_wall(ts))


def local_date(ts: Column | str, tz: str = DASHBOARD_TZ) -> Column:
    """Calendar date of an instant in ``tz`` (P7's DATE(CONVERT_TIMEZONE(tz, ts)))."""
    return F.to_date(to_zone(ts, tz))


def game_date(commence: Column | str, tz: str = TICKER_TZ) -> Column:
    """Game date used in market tickers (F5); ``tz='UTC'`` gives the plain date prefix."""
    return F.to_date(to_zone(parse_ts(commence), tz))


def hhmm(ts_local: Column | str) -> Column:
    return F.date_format(_col(ts_local), "HH:mm")


def weekday_name(ts_local: Column | str) -> Column:
    """Lower-case English weekday of a local wall clock."""
    return F.lower(F.date_format(_col(ts_local), "EEEE"))


def in_game_window(ts: Column | str, tz: str = DASHBOARD_TZ) -> Column:
    """15:00-23:00 local daily (ends inclusive), plus 08:00-15:00 on Thursday and Friday."""
    local = to_zone(ts, tz)
    t = hhmm(local)
    day = weekday_name(local)
    evening = (t >= F.lit(GAME_WINDOW_START)) & (t <= F.lit(GAME_WINDOW_END))
    early = day.isin(*EARLY_WINDOW_DAYS) & (t >= F.lit(EARLY_WINDOW_START)) & (t < F.lit(GAME_WINDOW_START))
    return evening | early
