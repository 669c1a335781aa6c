"""Plan checks: native expressions only, pushdown, and the driver contract."""

import re

import duckdb

import __spark_entry__ as entry
from linecast.plans import catalog

SF = "/root/testdata/sf0.001"


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_signal_jobs_have_no_python_udf(spark):
    for name in ("sharp_money", "divergence_pairs", "divergence_latest_pair", "consensus_prob"):
        plan = _plan(entry.queries()[name](spark, SF))
        assert "PythonUDF" not in plan and "BatchEvalPython" not in plan and "ArrowEvalPython" not in plan, name


def test_filters_and_columns_reach_the_scan(spark):
    df = entry.queries()["kalshi_mid"](spark, SF)
    text = df._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(event_type), EqualTo(event_type,view)]" in text
    assert "ReadSchema: struct<event_id:bigint,ts:timestamp_ntz,user_id:bigint,event_type:string,value:double>" in text


def test_entry_runs(spark):
    df = entry.entry(spark)
    assert df.count() > 0
    assert "is_sharp_signal" in df.columns


def test_every_query_has_an_oracle_or_is_documented():
    q, o = entry.queries(), entry.oracle_sql()
    assert set(o) <= set(q)
    assert len(q) >= 50


def test_queries_match_oracle_at_small_scale(spark):
    from tools.oracle_check import TABLES, digest

    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    from tools.plan_report import STREAMING

    # Flows have tests of their own; all other rows are compared here.
    for name in [n for n in catalog.ORACLE if n not in STREAMING] + ["load_history"]:
        df = catalog.QUERIES[name](spark, SF)
        s_rows = [tuple(r) for r in df.collect()]
        res = con.execute(catalog.ORACLE[name])
        d_cols = [c[0] for c in res.description]
        assert sorted(df.columns) == sorted(d_cols), name
        assert digest(df.columns, s_rows)[0] == digest(d_cols, res.fetchall())[0], name


def test_checkpoint_dir_is_read_from_the_session(spark):
    from linecast.session import ensure_checkpoint_dir, scratch_path

    configured = spark.conf.get("spark.checkpoint.dir", None)
    got = ensure_checkpoint_dir(spark)
    if configured:
        assert got == configured  # a cluster's shared folder is used as is, never replaced
    assert scratch_path(spark, "x").startswith(got.rstrip("/") + "/x-")


def test_no_cross_joins_or_python_in_any_query(spark):
    from tools.plan_report import STREAMING

    for name, fn in catalog.QUERIES.items():
        if name in STREAMING:
            continue
        plan = _plan(fn(spark, SF))
        for node in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython"):
            assert node not in plan, (name, node)


def test_read_side_filters_reach_the_scan(spark):
    from linecast.operators import serving as S

    div, sharp = catalog.div_silver(spark, SF, True), catalog.sharp_silver(spark, SF, True)
    assert "GreaterThanOrEqual(commence_time" in _plan(S.by_local_date(div, "2024-01-15"))
    assert "GreaterThanOrEqual(american_odds,-2500)" in _plan(S.plausible_odds(sharp))
    assert "PartitionFilters: [isnotnull(computed_date" in _plan(S.recent_hours(sharp, 30, "2024-01-30"))
    assert "EqualTo(home_team,H7)" in _plan(S.history(div, S.DIVERGENCE_HISTORY_COLS, "H7", "A7"))
    latest = catalog.silver_latest(spark, SF, "divergence")
    assert re.search(r"PartitionFilters: \[isnotnull\(computed_date#\d+\), \(computed_date#\d+ = ", _plan(latest))


def test_merged_boards_of_the_whole_table(spark):
    from tools.oracle_check import digest

    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in ("orders", "nation", "customer", "lineitem", "events"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    df = entry.queries()["merge_scores_whole"](spark, SF)
    rows = [tuple(r) for r in df.collect()]
    res = con.execute(entry.oracle_sql()["merge_scores_whole"])
    cols = [c[0] for c in res.description]
    assert sorted(df.columns) == sorted(cols) and digest(df.columns, rows)[0] == digest(cols, res.fetchall())[0]
    at = df.columns.index("period")
    assert {r[at] for r in rows} == {0, 1, 2, 3, 4, 5}


def test_ticker_job_looks_up_markets_and_reports_teams(spark):
    from tools.oracle_check import digest

    sf = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in ("orders", "nation", "customer", "lineitem", "events"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    for name in ("job_tickers_markets", "job_tickers_unmatched"):
        df = entry.queries()[name](spark, sf)
        rows = [tuple(r) for r in df.collect()]
        res = con.execute(entry.oracle_sql()[name])
        cols = [c[0] for c in res.description]
        assert rows and sorted(df.columns) == sorted(cols), name
        assert digest(df.columns, rows)[0] == digest(cols, res.fetchall())[0], name
