"""Command line: run the jobs and the read-side queries on a cluster.

Run as ``python -m linecast <command> ...`` where the session's master comes from the Spark
configuration, or ``spark-submit --py-files linecast.zip linecast/__main__.py <command> ...``:

    bronze  --landing odds=s3://b/odds kalshi=s3://b/kalshi --out s3://b/bronze
    signals --odds s3://b/bronze/odds --quotes s3://b/bronze/kalshi --out s3://b/signals
    history --signals s3://b/signals --out s3://b/warehouse
    feed    --table s3://b/signals/silver/divergence_signals --order divergence \\
            --date 2026-03-24 --sport basketball_nba --out s3://b/feeds/divergence
    game    --table s3://b/signals/silver/sharp_money_signals --kind odds \\
            --home "Phoenix Suns" --away "Denver Nuggets" --out s3://b/feeds/game

Every command reads and writes shared folders; checkpoints go under ``--out`` (or the session's
``spark.checkpoint.dir``). Game and sport values are bound as literals, never spliced into SQL.
"""

from __future__ import annotations

import argparse
import json

from pyspark.sql import SparkSession


def _session() -> SparkSession:
    from linecast.session import apply_defaults, ensure_checkpoint_dir

    spark = SparkSession.builder.appName("linecast").getOrCreate()
    apply_defaults(spark)
    ensure_checkpoint_dir(spark)
    return spark


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="linecast")
    sub = p.add_subparsers(dest="cmd", required=True)

    b = sub.add_parser("bronze", help="drain landing folders into Bronze tables (S1)")
    b.add_argument("--landing", nargs="+", required=True, help="feed=folder pairs (odds, kalshi, game_events)")
    b.add_argument("--out", required=True)

    s = sub.add_parser("signals", help="divergence and sharp-money signal tables (S10, S11, S14)")
    s.add_argument("--odds", required=True)
    s.add_argument("--quotes", required=True)
    s.add_argument("--out", required=True)
    s.add_argument("--divergence-threshold", type=float, default=None)
    s.add_argument("--sharp-threshold", type=float, default=None)
    s.add_argument("--latest-pair", action="store_true", help="J2 instead of the as-of pairing")
    s.add_argument("--sharp-books", nargs="+", help="bookmakers of the sharp-money job (default: the four major books)")
    s.add_argument("--segment-seconds", default=None, help="time-segment width of the skew-safe windows, or 'auto'")

    h = sub.add_parser("history", help="load exported signals and dedup them (S12, W3)")
    h.add_argument("--signals", required=True, help="the --out folder of the signals command")
    h.add_argument("--out", required=True)

    f = sub.add_parser("feed", help="latest-batch feed with date and sport filters (T1, T2)")
    f.add_argument("--table", required=True)
    f.add_argument("--order", required=True, choices=["divergence", "prob_movement"])
    f.add_argument("--date")
    f.add_argument("--sport")
    f.add_argument("--limit", type=int, default=10_000)
    f.add_argument("--out", required=True)

    g = sub.add_parser("game", help="one game's history (T3, T4)")
    g.add_argument("--table", required=True)
    g.add_argument("--kind", required=True, choices=["divergence", "odds"])
    g.add_argument("--home", required=True)
    g.add_argument("--away", required=True)
    g.add_argument("--out", required=True)

    a = p.parse_args(argv)
    spark = _session()

    from linecast import schemas
    from linecast.operators import serving as S
    from linecast.plans import jobs
    from linecast.sources import tables as T

    if a.cmd == "bronze":
        landing = dict(x.split("=", 1) for x in a.landing)
        res = jobs.job_bronze(spark, landing, a.out, f"{a.out}/_checkpoints")
        print(json.dumps({"ingested": res["ingested"], "tables": [list(r) for r in res["tables"].collect()]}))
    elif a.cmd == "signals":
        kw = {"latest_pair": a.latest_pair}
        if a.divergence_threshold is not None:
            kw["divergence_threshold"] = a.divergence_threshold
        if a.sharp_threshold is not None:
            kw["sharp_threshold"] = a.sharp_threshold
        if a.sharp_books:
            kw["sharp_books"] = tuple(a.sharp_books)
        if a.segment_seconds:
            kw["segment_seconds"] = a.segment_seconds if a.segment_seconds == "auto" else int(a.segment_seconds)
        odds = spark.read.schema(schemas.raw_odds()).parquet(a.odds)
        quotes = spark.read.schema(schemas.raw_kalshi()).parquet(a.quotes)
        out = jobs.job_signals(spark, odds, quotes, a.out, **kw)
        print(json.dumps({"divergence": out.divergence_path, "sharp": out.sharp_path, "counts": out.counts}))
    elif a.cmd == "history":
        exports = {"divergence": f"{a.signals}/processed/divergence_signals", "sharp": f"{a.signals}/processed/sharp_money_signals"}
        for name, df in jobs.job_history(spark, exports, f"{a.out}/loaded", f"{a.out}/_checkpoints").items():
            df.write.mode("overwrite").parquet(f"{a.out}/clean/{name}")
    elif a.cmd == "feed":
        spec = schemas.divergence_signals() if a.order == "divergence" else schemas.sharp_money_signals()
        table = T.read_signals(spark, a.table, schema=T.written_schema(spark.createDataFrame([], spec)))
        latest = S.latest_batch(table)
        if "computed_date" in latest.columns:
            latest = latest.drop("computed_date")
        S.feed(latest, a.order, a.date, a.sport, a.limit).write.mode("overwrite").json(a.out)
    elif a.cmd == "game":
        cols = S.DIVERGENCE_HISTORY_COLS if a.kind == "divergence" else S.ODDS_HISTORY_COLS
        spec = schemas.divergence_signals() if a.kind == "divergence" else schemas.sharp_money_signals()
        table = T.read_signals(spark, a.table, schema=T.written_schema(spark.createDataFrame([], spec)))
        S.history(table, cols, home=a.home, away=a.away).write.mode("overwrite").json(a.out)


if __name__ == "__main__":
    main()
