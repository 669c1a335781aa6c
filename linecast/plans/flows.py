"""Registered queries of flows: ingest that keeps every value, corrected signals, load accounting, streams
joined to streams, and the whole jobs. Same rules as :mod:`linecast.plans.catalog`, which imports this."""

from __future__ import annotations

from pyspark.sql import functions as F

from linecast import schemas as SC
from linecast.operators import serving as S
from linecast.plans import catalog as C
from linecast.plans import jobs
from linecast.plans import oracle as O
from linecast.plans import testdata as td
from linecast.plans.catalog import DIV_DOUBLES, SHARP_DOUBLES, query, round_doubles, round_sql
from linecast.session import scratch_path
from linecast.sources import tables as T
from linecast.streaming import incremental as INC
from linecast.streaming import ingest as ING
from linecast.streaming import joined as JS
from linecast.streaming import landing as LAND
from linecast.streaming import rescue as RES

# -- S1 + S2: rescued ingest ------------------------------------------------------------------------

_DECLARED = "event_id BIGINT, user_id BIGINT, event_type STRING, value DOUBLE, props STRUCT<k: BIGINT>"


def _event_lines(ev):
    """Events as JSON lines. Of ten, one is cut short, one has text for a number, one a new field, one a new
    nested field, one is a list."""
    n = F.col("event_id") % 10
    value = F.when(n == 1, F.concat(F.lit('"n/a-'), "event_id", F.lit('"'))).otherwise(F.col("value").cast("string"))
    deep = F.when(n == 3, F.concat(F.lit(', "deep": {"x": '), "user_id", F.lit("}}"))).otherwise(F.lit("}"))
    new = F.when(n == 2, F.concat(F.lit(', "brand_new": '), F.col("user_id") * 2)).otherwise(F.lit(""))
    line = F.concat(
        F.lit('{"event_id": '), "event_id", F.lit(', "user_id": '), "user_id", F.lit(', "event_type": "'), "event_type", F.lit('", "value": '), value,
        F.lit(', "props": '), F.expr("substr(props, 1, length(props) - 1)"), deep, new, F.lit("}"),
    )
    cut = F.when(n == 0, F.substring(line, F.lit(1), F.length(line) - 2)).when(n == 4, F.concat(F.lit("["), line, F.lit("]"))).otherwise(line)
    return ev.select(cut.alias("value"))


@query(
    "ingest_rescued",
    """SELECT CASE WHEN n IN (0, 4) THEN NULL ELSE event_id END AS event_id, CASE WHEN n IN (0, 4) THEN NULL ELSE user_id END AS user_id,
      CASE WHEN n IN (0, 4) THEN NULL ELSE event_type END AS event_type, CASE WHEN n IN (0, 1, 4) THEN NULL ELSE value END AS value,
      CASE WHEN n IN (0, 4) THEN NULL ELSE CAST(json_extract(props, '$.k') AS BIGINT) END AS k, CASE WHEN n = 3 THEN user_id END AS deep_x,
      CASE WHEN n = 2 THEN user_id * 2 END AS brand_new, CASE WHEN n = 1 THEN 'value' END AS left_over,
      CASE WHEN n = 1 THEN 'n/a-' || CAST(event_id AS VARCHAR) END AS raw_value, CASE WHEN n IN (0, 4) THEN event_id END AS broken_id
    FROM (SELECT *, event_id % 10 AS n FROM events) e""",
)
def q_ingest_rescued(spark, sf):
    """S1 + S2: broken lines, values of a wrong type, new fields and new nested fields in one load; all are
    kept, and what the schema has grown to is typed."""
    base = scratch_path(spark, "rescued")
    _event_lines(td.table(spark, sf, "events")).write.text(f"{base}/landing")
    for _ in range(2):  # the second run finds nothing new
        ING.run(RES.ingest_rescued(spark, f"{base}/landing", SC.struct(_DECLARED), f"{base}/bronze", f"{base}/_ckpt"))
    rows = RES.read_rescued(spark, f"{base}/bronze", f"{base}/_ckpt")
    line, fields = F.col("_rescued.line"), F.col("_rescued.fields")
    broken = F.when(line.isNotNull() & fields.isNull(), F.regexp_extract(line, r'"event_id": (\d+)', 1).cast("long"))
    return rows.select(
        "event_id", "user_id", "event_type", "value", F.col("props.k").alias("k"), F.col("props.deep.x").alias("deep_x"), "brand_new",
        F.array_join(fields, ",").alias("left_over"), F.when(fields.isNotNull(), F.get_json_object(line, "$.value")).alias("raw_value"), broken.alias("broken_id"),
    )


@query(
    "evolve_schema_race",
    """SELECT event_id, event_type, value, CASE WHEN event_type = 'view' THEN NULL ELSE CAST(json_extract(props, '$.k') AS BIGINT) END AS k,
      CASE WHEN event_type = 'view' THEN NULL ELSE user_id END AS user_id FROM events""",
)
def q_evolve_schema_race(spark, sf):
    """Files with fields that no schema had land after the schema was read and before the stream takes
    them. Their values are kept, and typed from then on; later files carry them as columns."""
    base = scratch_path(spark, "race")
    ev = td.table(spark, sf, "events")
    declared = SC.struct("event_id BIGINT, event_type STRING, value DOUBLE")
    kinds = F.col("event_type")
    whole = F.to_json(F.struct("event_id", "event_type", "value", "user_id", F.struct(F.get_json_object("props", "$.k").cast("long").alias("k")).alias("props")))
    drops = [(kinds == "view", F.to_json(F.struct("event_id", "event_type", "value"))), (kinds == "click", whole), (~kinds.isin("view", "click"), whole)]
    for cond, line in drops:
        ev.where(cond).select(line.alias("value")).write.mode("append").text(f"{base}/landing")
        ING.run(RES.ingest_rescued(spark, f"{base}/landing", declared, f"{base}/bronze", f"{base}/_ckpt"))
    rows = RES.read_rescued(spark, f"{base}/bronze", f"{base}/_ckpt").where("_rescued IS NULL")
    return rows.select("event_id", "event_type", "value", F.col("props.k").alias("k"), "user_id")


@query("landing_archive", "SELECT event_id, value, CAST(year(ts) AS INTEGER) AS year, CAST(month(ts) AS INTEGER) AS month, CAST(day(ts) AS INTEGER) AS day FROM events")
def q_landing_archive(spark, sf):
    """S7 with a bound in bytes: lines land in many small files, the days are archived, more lines land on
    some of them, and those are archived anew."""
    base = scratch_path(spark, "archive")
    ev = td.table(spark, sf, "events")
    for part in (F.col("event_type") != "view", F.col("event_type") == "view"):
        rows = ev.where(part).select("ts", F.to_json(F.struct("event_id", "value")).alias("line"))
        ING.with_arrival_partitions(rows, "ts").drop("ts").write.mode("append").partitionBy("year", "month", "day").text(f"{base}/landing")
        LAND.compact_landed(spark, f"{base}/landing", f"{base}/archive")
    rows = LAND.read_archive(spark, f"{base}/archive").withColumn("r", F.from_json("value", "event_id BIGINT, value DOUBLE"))
    return rows.select("r.event_id", "r.value", "year", "month", "day")


# -- 2.9: corrected signals ---------------------------------------------------------------------------


@query("sharp_retractions", O.with_ctes(round_sql("SELECT * FROM sharp", SHARP_DOUBLES), "sharp"))
def q_sharp_retractions(spark, sf):
    """Odds rows arrive in three parts that each span the month, so nearly every row of the later parts is
    late; the changes sum to the batch job's signals. One part is handled twice."""
    base = scratch_path(spark, "retract")
    flat = C.flat_odds(spark, sf)
    kw = dict(books=td.TEST_BOOKS, tie=("event_id",), delay_seconds=40 * 86400)
    for part in (2, 0, 1):
        flat.where(F.col("event_id") % 3 == part).write.parquet(f"{base}/src/part={part}")
        stream = spark.readStream.schema(flat.schema).parquet(f"{base}/src/part=*")
        ING.run(INC.sharp_money_changes(spark, stream, f"{base}/out", f"{base}/state", f"{base}/_ckpt", C.batch_of(), **kw))
    again = spark.read.schema(flat.schema).parquet(f"{base}/src/part=1")
    INC.sharp_money_changes_batch(spark, again, 2, f"{base}/out", f"{base}/state", C.batch_of(), **kw)
    return round_doubles(INC.current_signals(spark.read.parquet(f"{base}/out")))


# -- S12: load accounting -----------------------------------------------------------------------------


@query(
    "load_ledger",
    """SELECT event_type AS feed, count(*) AS n_lines, count(*) FILTER (n > 1) AS n_loaded, count(*) FILTER (n <= 1) AS n_rejected,
      count(*) FILTER (n <= 1) > 0 AS has_error FROM (SELECT *, event_id % 10 AS n FROM events) e GROUP BY event_type""",
)
def q_load_ledger(spark, sf):
    """Exports of four feeds, of ten lines one broken and one with text for a number; the ledger's files
    summed by feed. A second load finds every file in the ledger."""
    base = scratch_path(spark, "ledger")
    n = F.col("event_id") % 10
    line = F.to_json(F.struct(F.col("event_type").alias("TEAM"), F.col("event_id").alias("Prev_Odds"), F.col("ts").alias("computed_at")), ING.JSON_TS_OPTIONS)
    line = F.when(n == 0, F.substring(line, F.lit(1), F.length(line) - 1)).when(n == 1, F.lit('{"prev_odds": "many"}')).otherwise(line)
    td.table(spark, sf, "events").select(line.alias("value"), F.col("event_type").alias("feed")).write.partitionBy("feed").text(f"{base}/export")
    schema = SC.struct("team STRING, prev_odds BIGINT, computed_at TIMESTAMP")
    for _ in range(2):
        ING.run(ING.load_history(spark, f"{base}/export", schema, f"{base}/warehouse", f"{base}/_ckpt", errors=f"{base}/errors"))
    found = ING.load_ledger(spark, f"{base}/_ckpt").withColumn("feed", F.regexp_extract("file", "feed=([^/]+)/", 1))
    return found.groupBy("feed").agg(
        F.sum("n_lines").alias("n_lines"), F.sum("n_loaded").alias("n_loaded"), F.sum("n_rejected").alias("n_rejected"), F.bool_or(F.col("first_error").isNotNull()).alias("has_error")
    )


# -- Clustered reads and counts at write --------------------------------------------------------------


@query("divergence_history_game_clustered", C.ORACLE["divergence_history_game"])
def q_divergence_history_game_clustered(spark, sf):
    """T3 for one game on a table whose days are clustered by teams."""
    path = scratch_path(spark, "clustered")
    T.write_signals(C.div_silver(spark, sf), path, versioned=True)
    T.cluster_signals(spark, path)
    return round_doubles(S.history(T.read_signals(spark, path), S.DIVERGENCE_HISTORY_COLS, *C.GAME))


@query(
    "commit_counts",
    O.with_ctes(
        """SELECT 'divergence_signals' AS table_name, count(*) AS n_rows, count(*) FILTER (WHERE is_divergence_signal) AS n_flagged FROM div
      UNION ALL SELECT 'sharp_money_signals', count(*), count(*) FILTER (WHERE is_sharp_signal) FROM sharp""",
        "div",
        "sharp",
    ),
)
def q_commit_counts(spark, sf):
    """S14 from the counts that the commits of both signal tables hold."""
    return T.commit_counts(spark, {"divergence_signals": C.silver_path(spark, sf, "divergence"), "sharp_money_signals": C.silver_path(spark, sf, "sharp")})


@query("summary_additive", C.ORACLE["signals_summary"])
def q_summary_additive(spark, sf):
    """A2 from day partials: both tables are written in two halves of the month, then one day of each is
    first written short and then again whole."""
    paths = []
    for name in ("divergence", "sharp"):
        rows, path = C.silver(spark, sf, name), scratch_path(spark, f"days-{name}")
        early = F.col("computed_at") < F.lit("2024-01-16").cast(rows.schema["computed_at"].dataType)
        day = F.to_date("computed_at") == F.lit("2024-01-20").cast("date")
        for part in (early, ~early, day & (F.col("home_team") < "H3"), day):
            T.write_days(rows.where(part), path)
        paths.append(path)
    return T.read_summary(spark, *paths)


# -- Streams: repeated messages, quotes joined to games --------------------------------------------------


@query("dedup_stream", "SELECT event_id, event_type, value, ts FROM events")
def q_dedup_stream(spark, sf):
    """W3 on a stream: the producer sends the log a second time, after the first was taken; every record
    arrives once."""
    base = scratch_path(spark, "redelivered")
    ev = td.table(spark, sf, "events").select("event_id", "event_type", "value", "ts")
    for part in ("a", "b"):
        ev.write.parquet(f"{base}/log/part={part}")
        stream = spark.readStream.schema(ev.schema).parquet(f"{base}/log/part=*").drop("part")
        ING.run(JS.dedup_stream(stream, f"{base}/out", f"{base}/_ckpt", ["event_id"], "ts", "40 days"))
    return spark.read.parquet(f"{base}/out")


@query(
    "quotes_near_games",
    f"""SELECT g.event_id AS game_event_id, q.event_id AS quote_event_id, g.user_id % 40 AS game, g.ts AS game_ts, q.ts AS quote_ts
    FROM events g JOIN events q ON g.event_type <> 'view' AND q.event_type = 'view' AND {O.GAME.replace('user_id', 'g.user_id')} = {O.GAME.replace('user_id', 'q.user_id')}
      AND q.ts >= g.ts - INTERVAL 30 MINUTE AND q.ts <= g.ts + INTERVAL 60 MINUTE""",
)
def q_quotes_near_games(spark, sf):
    """2.9 chained: game events meet the quotes of their game from half an hour before to an hour after, both
    as streams, the month in two runs."""
    base = scratch_path(spark, "neargames")
    ev = td.table(spark, sf, "events")
    game = td.game_of(F.col("user_id")).alias("game")
    games = ev.where(F.col("event_type") != td.QUOTE_EVENT).select(F.col("event_id").alias("game_event_id"), game, F.col("ts").alias("game_ts"))
    quotes = ev.where(F.col("event_type") == td.QUOTE_EVENT).select(F.col("event_id").alias("quote_event_id"), game, F.col("ts").alias("quote_ts"))
    for early in (True, False):
        for name, frame, ts in (("games", games, "game_ts"), ("quotes", quotes, "quote_ts")):
            before = F.col(ts) < F.lit("2024-01-16").cast("timestamp_ntz")
            frame.where(before if early else ~before).write.mode("append").parquet(f"{base}/{name}")
        left, right = (spark.readStream.schema(f.schema).parquet(f"{base}/{n}") for n, f in (("games", games), ("quotes", quotes)))
        ING.run(JS.join_quotes(left, right, f"{base}/out", f"{base}/_ckpt", keys=["game"], game_ts="game_ts", quote_ts="quote_ts", before="30 minutes", after="60 minutes"))
    out = spark.read.parquet(f"{base}/out")
    return out.select("game_event_id", "quote_event_id", "game", *[F.col(c).cast("timestamp_ntz").alias(c) for c in ("game_ts", "quote_ts")])


# -- Whole jobs -----------------------------------------------------------------------------------------

O.register("cons_tick", O.CTES["cons"][0].replace("odds_day", "odds"), ("odds",))
O.register("home_tick", O.CTES["home_odds"][0].replace("FROM cons", "FROM cons_tick"), ("cons_tick",))
O.register("div_tick_pairs", O.CTES["div_pairs"][0].replace("home_odds", "home_tick"), ("quotes", "home_tick"))
O.register("div_tick", O.CTES["div"][0].replace("div_pairs", "div_tick_pairs"), ("div_tick_pairs",))


@query("job_divergence", O.with_ctes(round_sql("SELECT * FROM div_tick", DIV_DOUBLES), "div_tick"))
def q_job_divergence(spark, sf):
    """The divergence half of ``job_signals``, row by row: every quote against the consensus of the latest
    single poll at or before it."""
    return round_doubles(T.read_signals(spark, C._signals_job(spark, sf).divergence_path).drop("computed_date"))


@query("job_sharp_money_rows", O.with_ctes(round_sql("SELECT * FROM sharp", SHARP_DOUBLES), "sharp"))
def q_job_sharp_money_rows(spark, sf):
    """The sharp-money half of ``job_signals``, row by row."""
    return round_doubles(T.read_signals(spark, C._signals_job(spark, sf).sharp_path).drop("computed_date"))


_DAY, _SPORT = "2024-01-30", "basketball_ncaab"
_TAB = f"""SELECT * FROM {{src}} WHERE CAST({O.local_sql('commence_time', C.LA)} AS DATE) = DATE '{_DAY}' AND sport_key = '{_SPORT}'
      AND home_team IN (SELECT 'H' || CAST(n_nationkey AS VARCHAR) FROM nation)
      AND away_team IN (SELECT 'A' || CAST(n_nationkey AS VARCHAR) FROM nation)"""
O.register("div_tab", _TAB.format(src="latest_div"), ("latest_div",))
O.register("sharp_tab", _TAB.format(src="latest_sharp"), ("latest_sharp",))


def _tab_sql(board: str, view: str, value: str, doubles: list[str]) -> str:
    body = f"""SELECT b.*, {value} / greatest(coalesce(max({value}) OVER (), 1.0), 1.0) AS bar_share, s.state AS score_state,
        CASE WHEN s.state = 'in' THEN 0 WHEN s.state = 'pre' THEN 1 ELSE 2 END AS state_rank
      FROM ({board.replace('latest_' + view, view + '_tab')}) b LEFT JOIN sb_latest s ON b.away_team = s.away_team AND b.home_team = s.home_team"""
    return O.with_ctes(round_sql(body, [*doubles, "bar_share"]), f"{view}_tab", "sb_latest")


def _tabs(spark, sf):
    d, s = (T.read_signals(spark, C.silver_path(spark, sf, n)) for n in ("divergence", "sharp"))
    return jobs.job_board(d, s, C.sb_latest(spark, sf), td.tournament_teams(spark, sf), _DAY, _SPORT)


@query("job_board_divergence_tab", _tab_sql(C._DIV_BOARD, "div", "divergence_pct", ["divergence_pct"]))
def q_job_board_divergence_tab(spark, sf):
    """The dashboard's first tab: a day and a sport, tournament games only, with scores and bars."""
    return round_doubles(_tabs(spark, sf)["divergence"])


@query("job_board_sharp_tab", _tab_sql(C._SHARP_BOARD, "sharp", "top_move_pct", ["top_move_pct", "max_move_pct"]))
def q_job_board_sharp_tab(spark, sf):
    """The dashboard's second tab, with the same filters."""
    return round_doubles(_tabs(spark, sf)["sharp"])


_HOURS, _AS_OF = 36, "2024-01-30 12:00:00"
O.register("div_hours", f"SELECT * FROM div WHERE computed_at >= TIMESTAMP '{_AS_OF}' - INTERVAL {_HOURS} HOUR", ("div",))
O.register("sharp_hours", f"SELECT * FROM sharp WHERE computed_at >= TIMESTAMP '{_AS_OF}' - INTERVAL {_HOURS} HOUR", ("sharp",))


def _series(spark, sf, name):
    d, s = (T.read_signals(spark, C.silver_path(spark, sf, n)) for n in ("divergence", "sharp"))
    return jobs.job_series(d, s, hours=_HOURS, as_of=_AS_OF)[name]


@query(
    "job_series_divergence",
    O.with_ctes(
        round_sql(
            """SELECT home_team, away_team, date_trunc('minute', computed_at) AS minute, series, value FROM (
        SELECT *, 'kalshi_' || regexp_replace(market_ticker, '^.*-', '') AS series, kalshi_implied_prob AS value FROM div_hours
        UNION ALL SELECT *, 'sportsbook_avg', sportsbook_home_prob FROM div_hours) u
      QUALIFY row_number() OVER (PARTITION BY home_team, away_team, date_trunc('minute', computed_at), series
        ORDER BY computed_at DESC, kalshi_implied_prob DESC, sportsbook_home_prob DESC) = 1""",
            ["value"],
        ),
        "div_hours",
    ),
)
def q_job_series_divergence(spark, sf):
    """A8 of the last hours of both charts' job."""
    return round_doubles(_series(spark, sf, "divergence"))


@query(
    "job_series_odds_hours",
    O.with_ctes(
        round_sql(
            """SELECT home_team, away_team, date_trunc('minute', computed_at) AS minute, team || '__' || bookmaker_key AS series,
        CAST(american_odds AS DOUBLE) AS value FROM sharp_hours WHERE american_odds BETWEEN -2500 AND 2500
      QUALIFY row_number() OVER (PARTITION BY home_team, away_team, date_trunc('minute', computed_at), team, bookmaker_key
        ORDER BY computed_at DESC, ingested_at_ts DESC) = 1""",
            ["value"],
        ),
        "sharp_hours",
    ),
)
def q_job_series_odds_hours(spark, sf):
    """A9 of the last hours."""
    return round_doubles(_series(spark, sf, "odds"))


@query(
    "job_series_groups",
    O.with_ctes(
        """SELECT home_team, away_team, team, array_to_string(list_sort(list_distinct(list(team || '__' || bookmaker_key))), ',')
        AS series_keys FROM sharp_hours WHERE american_odds BETWEEN -2500 AND 2500 GROUP BY home_team, away_team, team""",
        "sharp_hours",
    ),
)
def q_job_series_groups(spark, sf):
    """A10 of the last hours."""
    return _series(spark, sf, "groups").withColumn("series_keys", F.array_join("series_keys", ","))
