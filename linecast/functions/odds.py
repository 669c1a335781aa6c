"""Odds and signal expressions.

All are native Column expressions: they stay inside whole-stage codegen, no Python worker.
"""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

# Fixed values that must equal the studied pipeline's for equal results.
DIVERGENCE_THRESHOLD = 0.05  # probability points; flag when |market - book| >= this
SHARP_MONEY_THRESHOLD = 10  # American odds points; flag when |odds - prev odds| >= this
KALSHI_HIGHER = "KALSHI_HIGHER"
SPORTSBOOK_HIGHER = "SPORTSBOOK_HIGHER"
ODDS_LENGTHENING = "ODDS_LENGTHENING"
ODDS_SHORTENING = "ODDS_SHORTENING"
DIVERGENCE_SIGNAL = "divergence"
SHARP_MONEY_SIGNAL = "sharp_money"
MAJOR_BOOKS = ("fanduel", "draftkings", "betmgm", "betrivers")
# Board severity bands, in percent of probability.
SEVERITY_HIGH_PCT = 10.0
SEVERITY_MEDIUM_PCT = 5.0


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def american_to_prob(odds: Column | str) -> Column:
    """Implied probability of American odds: o<0 -> -o/(-o+100), else 100/(o+100); null stays null."""
    o = _col(odds).cast("double")
    return F.when(o.isNull(), F.lit(None).cast("double")).when(o < 0, -o / (-o + 100.0)).otherwise(100.0 / (o + 100.0))


def register_sql_functions(spark: SparkSession) -> None:
    """Make F1 callable from SQL as an inlined SQL function (no Python worker)."""
    spark.sql(
        "CREATE OR REPLACE TEMPORARY FUNCTION american_to_prob(o DOUBLE) RETURNS DOUBLE RETURN "
        "CASE WHEN o IS NULL THEN NULL WHEN o < 0 THEN -o / (-o + 100.0) ELSE 100.0 / (o + 100.0) END"
    )


def divergence(market_prob: Column | str, book_prob: Column | str) -> Column:
    return F.abs(_col(market_prob) - _col(book_prob))


def divergence_direction(market_prob: Column | str, book_prob: Column | str) -> Column:
    """Equal or null probabilities fall to SPORTSBOOK_HIGHER, as in the studied job."""
    return F.when(_col(market_prob) > _col(book_prob), F.lit(KALSHI_HIGHER)).otherwise(F.lit(SPORTSBOOK_HIGHER))


def movement_direction(odds: Column | str, prev_odds: Column | str) -> Column:
    """Unchanged odds fall to ODDS_SHORTENING, as in the studied job."""
    return F.when(_col(odds) > _col(prev_odds), F.lit(ODDS_LENGTHENING)).otherwise(F.lit(ODDS_SHORTENING))


def flag_at_least(value: Column | str, threshold: float) -> Column:
    """Inclusive threshold flag; a null value gives a null flag."""
    return _col(value) >= F.lit(threshold)


def divergence_severity(div: Column | str, high_pct: float = SEVERITY_HIGH_PCT, medium_pct: float = SEVERITY_MEDIUM_PCT) -> Column:
    pct = _col(div) * 100.0
    return F.when(pct >= high_pct, "high").when(pct >= medium_pct, "medium").otherwise("low")


def sharp_severity(
    top_move: Column | str,
    max_move: Column | str,
    high_pct: float = SEVERITY_HIGH_PCT,
    medium_pct: float = SEVERITY_MEDIUM_PCT,
) -> Column:
    """High when the largest jump reaches the high band, medium when the top row reaches the medium band."""
    return (
        F.when(_col(max_move) * 100.0 >= high_pct, "high")
        .when(_col(top_move) * 100.0 >= medium_pct, "medium")
        .otherwise("low")
    )


def batch_time(computed_at: Column | str | None) -> Column:
    """``computed_at`` of a batch: a given column/literal, else the query's current timestamp."""
    if computed_at is None:
        return F.current_timestamp()
    if isinstance(computed_at, Column):
        return computed_at
    return F.lit(computed_at).cast("timestamp")
