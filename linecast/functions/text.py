"""String expressions: market tickers and chart series keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SERIES_SEP = "__"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ticker_date(d: Column | str) -> Column:
    """Date as upper-case ``yyMMMdd`` (e.g. 26MAR24); text that is not a date gives null."""
    parsed = F.to_date(F.try_to_timestamp(_col(d).cast("string")))
    return F.upper(F.date_format(parsed, "yyMMMdd"))


def event_ticker(prefix: Column | str, d: Column | str, away_abbr: Column | str, home_abbr: Column | str) -> Column:
    """``prefix-YYMMMDD`` + away + home abbreviations; any null part gives null."""
    return F.concat(_col(prefix), F.lit("-"), ticker_date(d), _col(away_abbr), _col(home_abbr))


def ticker_suffix(ticker: Column | str) -> Column:
    """text after the last '-' (the whole text when there is none)."""
    return F.substring_index(_col(ticker), "-", -1)


def series_key(team: Column | str, book: Column | str) -> Column:
    """F8: chart series key ``team__bookmaker``."""
    return F.concat_ws(SERIES_SEP, _col(team), _col(book))
