"""End-to-end jobs composed from the operators, plus a runner for all of them.

Each job takes explicit input frames or folders, thresholds and an explicit batch time, writes its
outputs once and reports counts from the written tables (one action per output, no repeated
evaluation of the same lineage). Folders must be shared storage on a cluster.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from functools import partial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from linecast import schemas
from linecast.functions.odds import DIVERGENCE_THRESHOLD, MAJOR_BOOKS, SHARP_MONEY_THRESHOLD
from linecast.operators import boards as B
from linecast.operators import dims as D
from linecast.operators import serving as S
from linecast.operators.divergence import divergence_asof, divergence_latest_pair
from linecast.operators.joins import unmatched_teams
from linecast.operators.movement import sharp_money
from linecast.operators.odds import consensus, flatten_odds, home_consensus
from linecast.operators.quotes import kalshi_mid
from linecast.sources import tables as T
from linecast.streaming import ingest as ING
from linecast.streaming import rescue as RES


@dataclass
class SignalOutputs:
    divergence_path: str
    sharp_path: str
    export_paths: dict[str, str]
    counts: list[tuple] = field(default_factory=list)


def job_bronze(spark: SparkSession, landing: Mapping[str, str], bronze: str, checkpoints: str) -> dict:
    """S1-S3 x3 + S14: drain the landing folders into Bronze tables (once-per-file), the streams running
    concurrently. Each feed starts from its declared schema and grows by what its files bring; what does
    not fit is kept (:mod:`linecast.streaming.rescue`). Returns the rows each table gained and the Bronze
    table counts as a frame, with rescued rows and broken lines as flagged; both come from the counts
    observed while writing, and neither scans a table."""

    def totals(feed: str) -> tuple[int, int]:
        row = RES.ingest_ledger(spark, f"{checkpoints}/{feed}").agg(F.sum("n_rows"), F.sum("n_rescued")).first()
        return row[0] or 0, row[1] or 0

    before = {feed: totals(feed)[0] for feed in landing}
    queries = [RES.ingest_rescued(spark, src, schemas.feed_schema(feed), f"{bronze}/{feed}", f"{checkpoints}/{feed}") for feed, src in landing.items()]
    for q in queries:
        ING.run(q)
    after = {feed: totals(feed) for feed in landing}
    rows = [(f"raw_{feed}", n, flagged) for feed, (n, flagged) in after.items()]
    tables = spark.createDataFrame(rows, "table_name STRING, n_rows LONG, n_flagged LONG")
    return {"ingested": {feed: after[feed][0] - before[feed] for feed in landing}, "tables": tables}


def read_feed(spark: SparkSession, bronze: str, checkpoints: str, feed: str) -> DataFrame:
    """A Bronze table of :func:`job_bronze` by its schema of now, without the columns of the ingest."""
    return RES.read_rescued(spark, f"{bronze}/{feed}", f"{checkpoints}/{feed}").drop(RES.RESCUED, RES.BATCH)


def job_topics(spark: SparkSession, messages: DataFrame, routes: Mapping[str, str], landing: str, bronze: str, checkpoints: str) -> dict:
    """S4/S6 -> S7 -> S1: a stream of ``topic, value`` messages routed to dated landing folders, drained
    into Bronze. ``messages`` is :func:`linecast.sources.kafka.kafka_source` or any such stream."""
    ING.run(ING.route_by_topic(messages, routes, landing, f"{checkpoints}/topics"))
    return job_bronze(spark, {feed: f"{landing}/feed={feed}" for feed in routes.values()}, bronze, checkpoints)


def job_signals(
    spark: SparkSession,
    raw_odds: DataFrame,
    raw_quotes: DataFrame,
    out: str,
    computed_at: Column | str | None = None,
    divergence_threshold: float = DIVERGENCE_THRESHOLD,
    sharp_threshold: float = SHARP_MONEY_THRESHOLD,
    sharp_books: Sequence[str] | None = MAJOR_BOOKS,
    consensus_books: Sequence[str] | None = None,
    latest_pair: bool = False,
    tie: Sequence[str] = (),
    segment_seconds: int | str = "auto",
) -> SignalOutputs:
    """job_divergence + job_sharp_money: both signal tables written once each (S10), the flagged
    rows exported as JSON from the written tables (S11), counts observed while writing (S14).
    Shuffle partitions are sized from the inputs' estimated size first."""
    from linecast.session import size_shuffle_partitions

    size_shuffle_partitions(spark, raw_odds, raw_quotes)
    flat = flatten_odds(raw_odds, keep=tuple(tie))
    home = home_consensus(consensus(flat, books=consensus_books))
    quotes = kalshi_mid(raw_quotes)
    if latest_pair:
        div = divergence_latest_pair(quotes, home, divergence_threshold, computed_at)
    else:
        div = divergence_asof(quotes, home, divergence_threshold, computed_at, segment_seconds=segment_seconds)
    sharp = sharp_money(flat, books=sharp_books, threshold=sharp_threshold, computed_at=computed_at, tie=tie, segment_seconds=segment_seconds)

    paths = {"divergence": f"{out}/silver/divergence_signals", "sharp": f"{out}/silver/sharp_money_signals"}
    T.write_signals(div, paths["divergence"], versioned=True, flag="is_divergence_signal")
    T.write_signals(sharp, paths["sharp"], versioned=True, flag="is_sharp_signal")
    d = T.read_signals(spark, paths["divergence"], schema=T.written_schema(div))
    s = T.read_signals(spark, paths["sharp"], schema=T.written_schema(sharp))
    exports = {
        "divergence": T.export_signals_json(d.drop("computed_date"), "is_divergence_signal", f"{out}/processed/divergence_signals"),
        "sharp": T.export_signals_json(s.drop("computed_date"), "is_sharp_signal", f"{out}/processed/sharp_money_signals"),
    }
    counts = T.commit_counts(spark, {"divergence_signals": paths["divergence"], "sharp_money_signals": paths["sharp"]}).collect()
    return SignalOutputs(paths["divergence"], paths["sharp"], exports, [tuple(r) for r in counts])


def job_history(spark: SparkSession, exports: Mapping[str, str], warehouse: str, checkpoints: str) -> dict[str, DataFrame]:
    """S12 for both exports (append unseen files, malformed lines to ``<name>_errors``) -> W3 minute
    dedup views."""
    specs = {"divergence": schemas.divergence_signals(), "sharp": schemas.sharp_money_signals()}
    out = {}
    for name, src in exports.items():
        ING.run(ING.load_history(spark, src, specs[name], f"{warehouse}/{name}", f"{checkpoints}/{name}", errors=f"{warehouse}/{name}_errors"))
        expected = T.written_schema(spark.createDataFrame([], ING.lower_names(specs[name])), None)
        expected = expected.add(ING.LOAD, "long").add("load_date", "date")
        loaded = T.read_signals(spark, f"{warehouse}/{name}", schema=expected).drop(ING.LOAD, "load_date")
        keys = S.DIVERGENCE_ROW if name == "divergence" else S.SHARP_ROW
        out[name] = S.minute_dedup(loaded, keys)
    return out


def job_board(
    divergence: DataFrame,
    sharp: DataFrame,
    scoreboard: DataFrame | None = None,
    tournament: DataFrame | None = None,
    date: str | None = None,
    sport: str | None = None,
) -> dict[str, DataFrame]:
    """A3 -> P6, P7, P8, P12 -> J5 -> A4/A5 -> F12 -> T5 for both tabs, plus A2 summary."""
    out = {}
    # A total order, so that a game with equal moves shows the same row in every run.
    sharp_board = partial(B.sharp_game_board, tie=("bookmaker_key", "team", "computed_at", "ingested_at_ts"))
    for name, df, board in (("divergence", divergence, B.divergence_game_board), ("sharp", sharp, sharp_board)):
        latest = S.latest_batch(df)
        if "computed_date" in latest.columns:
            latest = latest.drop("computed_date")
        rows = S.feed_rows(latest, date, sport)
        if tournament is not None:
            rows = S.tournament_only(rows, tournament)
        b = board(rows)
        value = "divergence_pct" if name == "divergence" else "top_move_pct"
        out[name] = B.board_order(B.bar_share(b, value), scoreboard, value)
    out["summary"] = S.signals_summary(divergence.drop("computed_date"), sharp.drop("computed_date"))
    return out


def job_series(divergence: DataFrame, sharp: DataFrame, hours: float | None = None, as_of: str | None = None) -> dict[str, DataFrame]:
    """T3/T4 -> P10, P11 -> A8/A9 (long form; ``pivot_wide`` gives the chart's columns)."""
    d, s = divergence, sharp
    if hours is not None:
        d, s = S.recent_hours(d, hours, as_of), S.recent_hours(s, hours, as_of)
    # Total orders, so a minute with several rows gives the same value in every run.
    divergence_long = B.pivot_divergence_long(d, tie=("kalshi_implied_prob", "sportsbook_home_prob"))
    return {"divergence": divergence_long, "odds": B.pivot_odds_long(s, tie=("ingested_at_ts", "american_odds")), "groups": B.team_series_groups(s)}


def job_tickers(
    game_events: DataFrame,
    sport_dim: DataFrame,
    team_dim: DataFrame,
    markets: DataFrame,
    tz: str = "America/New_York",
    order: Sequence[str] = ("ingested_at",),
) -> dict[str, DataFrame]:
    """F9 rows -> W4 -> F5 -> J3 -> J4, with the J7 report of teams lacking an abbreviation."""
    active = D.active_sports(sport_dim).select("sport_key")
    games = B.drain_latest(game_events.join(F.broadcast(active), "sport_key", "left_semi"), order=order)
    tickers = D.games_to_tickers(games, sport_dim, team_dim, tz=tz)
    return {
        "tickers": tickers,
        "markets": D.ticker_lookup(tickers, markets),
        "unmatched": unmatched_teams(games, team_dim),
    }


def run_all_jobs(spark: SparkSession, raw_odds: DataFrame, raw_quotes: DataFrame, out: str, computed_at=None, **kw) -> dict:
    """Signals, then history and board, then series - the order of the studied schedule."""
    sig = job_signals(spark, raw_odds, raw_quotes, out, computed_at, **kw)
    hist = job_history(spark, sig.export_paths, f"{out}/warehouse", f"{out}/_checkpoints/history")
    d = T.read_signals(spark, sig.divergence_path, schema=T.written_schema(spark.createDataFrame([], schemas.divergence_signals())))
    s = T.read_signals(spark, sig.sharp_path, schema=T.written_schema(spark.createDataFrame([], schemas.sharp_money_signals())))
    board = job_board(d, s)
    series = job_series(hist["divergence"], hist["sharp"])
    return {"signals": sig, "history": hist, "board": board, "series": series}


__all__ = [
    "SignalOutputs",
    "job_board",
    "job_bronze",
    "job_history",
    "job_series",
    "job_signals",
    "job_tickers",
    "job_topics",
    "read_feed",
    "run_all_jobs",
]
