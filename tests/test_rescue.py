"""Ingest that keeps every value, load accounting, and counts and clustering of committed tables."""

import json
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from linecast import schemas
from linecast.sources import tables as T
from linecast.streaming import ingest as ING
from linecast.streaming import rescue as RES


def _drop(spark, base, *lines):
    spark.createDataFrame([(x if isinstance(x, str) or x is None else json.dumps(x),) for x in lines], "value STRING").coalesce(1).write.mode("append").text(f"{base}/src")


def _ingest(spark, base, declared):
    ING.run(RES.ingest_rescued(spark, f"{base}/src", schemas.struct(declared), f"{base}/bronze", f"{base}/ckpt"))
    return RES.read_rescued(spark, f"{base}/bronze", f"{base}/ckpt")


def test_nothing_is_lost_and_later_schemas_type_it(spark):
    base = tempfile.mkdtemp(prefix="lc-rescue-")
    declared = "id BIGINT, name STRING, price DOUBLE, at TIMESTAMP, ok BOOLEAN, books ARRAY<STRUCT<k: STRING, n: BIGINT>>"
    _drop(
        spark,
        base,
        {"id": 1, "name": "a", "price": 1, "at": "2026-03-24T20:00:00Z", "ok": True, "books": [{"k": "x", "n": 2}]},
        {"id": "many", "name": 5, "price": "cheap", "at": "soon", "ok": "perhaps", "books": [{"k": "x", "n": "two"}]},
        {"id": 3, "fresh": {"deep": [1, 2]}, "books": [{"k": "y", "extra": 7.5}]},
        {"id": 4.5, "Name": "case", "we.ird 'name": True, "what? 'it.is'": 1},
        {"id": None, "books": []},
        '{"id": 6, "n":',
        "not json",
        '[{"id": 7}]',
        '{"id": 8, "id": 9}',
        "",
        None,
    )
    rows = _ingest(spark, base, declared).collect()
    assert len(rows) == 9  # blank lines are no records
    by = {r.id: r for r in rows if r.id is not None}
    assert sorted(by) == [1, 3] and by[1]._rescued is None
    assert (by[1].price, by[1].ok, by[1].books[0].n, str(by[1]["at"])) == (1.0, True, 2, "2026-03-24 20:00:00")
    assert by[3].fresh.deep == [1, 2] and by[3].books[0].extra == 7.5 and by[3]._rescued is None  # grown, nested too
    odd = next(r for r in rows if r.name == "5")
    assert sorted(odd._rescued.fields) == ["at", "books", "id", "ok", "price"]
    assert json.loads(odd._rescued.line)["price"] == "cheap" and odd.price is None and odd.books[0].n is None
    case = next(r for r in rows if r["we.ird 'name"])
    assert sorted(case._rescued.fields) == ["Name", "id", "what? 'it.is'"]  # 4.5 is no whole number, Name is the same column to Parquet
    broken = sorted(r._rescued.line for r in rows if r._rescued and r._rescued.fields is None)
    assert broken == ['[{"id": 7}]', "not json", '{"id": 6, "n":', '{"id": 8, "id": 9}']


def test_files_between_look_and_read_are_typed(spark):
    base = tempfile.mkdtemp(prefix="lc-race-")
    _drop(spark, base, {"id": 1})
    _ingest(spark, base, "id BIGINT")
    _drop(spark, base, {"id": 2, "brand_new": 20}, {"id": 3, "brand_new": 30})  # no call looked at this file
    assert {r.id: r.brand_new for r in _ingest(spark, base, "id BIGINT").collect()} == {1: None, 2: 20, 3: 30}
    _drop(spark, base, {"id": 4, "brand_new": "text now"})
    rows = {r.id: r for r in _ingest(spark, base, "id BIGINT").collect()}
    assert rows[4].brand_new is None and json.loads(rows[4]._rescued.line)["brand_new"] == "text now" and rows[3].brand_new == 30
    ledger = {r.batch_id: (r.n_rows, r.n_rescued, r.n_broken) for r in RES.ingest_ledger(spark, f"{base}/ckpt").collect()}
    assert ledger == {0: (1, 0, 0), 1: (2, 2, 0), 2: (1, 1, 0)}


def test_keys_that_are_data_do_not_widen_the_schema(spark, monkeypatch):
    monkeypatch.setattr(RES, "MAX_NEW_FIELDS", 5)
    base = tempfile.mkdtemp(prefix="lc-wide-")
    _drop(spark, base, *[{"id": k, f"key{k}": k} for k in range(9)])
    rows = _ingest(spark, base, "id BIGINT").collect()
    assert rows[0].asDict().keys() == {"id", "_rescued", "batch_id"}
    assert {r._rescued.fields[0] for r in rows} == {f"key{k}" for k in range(9)}


def test_empty_landing_folder(spark):
    base = tempfile.mkdtemp(prefix="lc-none-")
    os.makedirs(f"{base}/src")
    assert _ingest(spark, base, "id BIGINT").collect() == []


def test_load_ledger_counts_and_survives_a_lost_checkpoint(spark):
    base = tempfile.mkdtemp(prefix="lc-ledger-")
    schema = schemas.struct("team STRING, prev_odds INT, computed_at TIMESTAMP")
    good = '{"TEAM": "x", "Prev_Odds": 5, "computed_at": "2024-01-02T03:04:05Z"}'
    for name, lines in (("a", [good, "broken", '{"prev_odds": "many"}', ""]), ("b", [good] * 3)):
        spark.createDataFrame([(x,) for x in lines], "value STRING").coalesce(1).write.text(f"{base}/src/{name}")

    def load():
        ING.run(ING.load_history(spark, f"{base}/src/*", schema, f"{base}/dst", f"{base}/ckpt", errors=f"{base}/bad"))
        return {r.file.split("/")[-2]: (r.n_lines, r.n_loaded, r.n_rejected, r.first_error) for r in ING.load_ledger(spark, f"{base}/ckpt").collect()}

    expected = {"a": (3, 1, 2, "broken"), "b": (3, 3, 0, None)}
    assert load() == expected
    os.rename(f"{base}/ckpt", f"{base}/lost")
    assert load() == expected and spark.read.parquet(f"{base}/dst").count() == 4
    assert sorted(r.value for r in spark.read.text(f"{base}/bad").collect()) == ["broken", '{"prev_odds": "many"}']


def test_names_in_several_cases(spark):
    lines = spark.createDataFrame([('{"a": 1, "A": 2, "B": 3}',), ('{"A": 2, "a": 1}',)], "value STRING")
    got = ING.history_records(lines, schemas.struct("a INT, b INT"))
    assert sorted((r.a, r.b, r["__bad"]) for r in got.collect()) == [(1, 3, False), (2, None, False)]


def test_commits_hold_counts_and_take_one_writer_each(spark):
    base = tempfile.mkdtemp(prefix="lc-count-")
    df = spark.range(50).select("id", (F.col("id") % 3 == 0).alias("hit"), (F.lit("2024-01-01").cast("timestamp") + F.make_dt_interval(F.col("id"))).alias("computed_at"))
    T.write_signals(df, f"{base}/t", versioned=True, flag="hit")
    commit = T.last_commit(spark, f"{base}/t")
    assert (commit["n_rows"], commit["n_flagged"], commit["latest"]) == (50, 17, "2024-02-19 00:00:00")
    assert [tuple(r) for r in T.commit_counts(spark, {"t": f"{base}/t"}).collect()] == [("t", 50, 17)]
    with pytest.raises(Exception, match="exists"):
        T.add_commit(spark, f"{base}/t", 0, {"version": "other"})
    assert T.last_commit(spark, f"{base}/t") == commit
    T.write_signals(df.limit(0), f"{base}/t", versioned=True)
    assert T.latest_time(spark, f"{base}/t") is None and T.read_signals(spark, f"{base}/t").count() == 0


def test_clustered_days_let_a_game_skip_row_groups(spark):
    import glob

    import pyarrow.parquet as pq

    base = tempfile.mkdtemp(prefix="lc-cluster-")
    game = (F.col("id") * 7919 % 40).cast("string")
    df = spark.range(40000).select(
        F.concat(F.lit("H"), game).alias("home_team"), F.concat(F.lit("A"), game).alias("away_team"), F.xxhash64("id").alias("v"),
        F.when(F.col("id") % 2 == 0, F.lit("2024-01-01 10:00:00")).otherwise(F.lit("2024-01-02 10:00:00")).cast("timestamp").alias("computed_at"),
    )

    def share():
        version = T.last_commit(spark, f"{base}/t")["version"]
        hit = total = 0
        for f in glob.glob(f"{base}/t/_versions/{version}/*/*.parquet"):
            meta = pq.ParquetFile(f).metadata
            for g in range(meta.num_row_groups):
                stats = meta.row_group(g).column(meta.schema.names.index("home_team")).statistics
                hit += stats.min <= "H7" <= stats.max
                total += 1
        return hit / total

    T.write_signals(df.repartition(8), f"{base}/t", versioned=True, flag=None)
    before = share()
    T.cluster_signals(spark, f"{base}/t", row_group_bytes=16 << 10)
    assert before == 1.0 and share() <= 0.25
    assert T.read_signals(spark, f"{base}/t").where("home_team = 'H7'").count() == 1000
    assert T.last_commit(spark, f"{base}/t")["n_rows"] == 40000


def test_summary_follows_rewritten_days(spark):
    base = tempfile.mkdtemp(prefix="lc-days-")
    row = lambda game, day, n: [("nba", f"H{game}", f"A{game}", f"2024-01-{day:02d} 10:00:00")] * n

    def write(rows):
        df = spark.createDataFrame(rows, "sport_key STRING, home_team STRING, away_team STRING, computed_at STRING")
        return T.write_days(df.withColumn("computed_at", F.col("computed_at").cast("timestamp")), f"{base}/t")

    def summary():
        return {r.home_team: (r.signal_count, str(r.latest_computed_at)[:10]) for r in T.read_summary(spark, f"{base}/t").collect()}

    assert summary() == {}
    assert write(row(1, 1, 3) + row(2, 2, 4)) == ["2024-01-01", "2024-01-02"]
    assert write([]) == []
    assert write(row(1, 3, 1)) == ["2024-01-03"]
    assert summary() == {"H1": (4, "2024-01-03"), "H2": (4, "2024-01-02")}
    write(row(2, 1, 2))  # day 1 again: game 1 is no longer in it
    assert summary() == {"H1": (1, "2024-01-03"), "H2": (6, "2024-01-02")}
    assert write([("nba", "H9", "A9", None)]) == [""]
    assert summary()["H9"] == (1, "None")


def test_batches_and_archived_files_keep_within_their_bytes(spark):
    import glob

    from linecast.streaming import landing as LAND

    base = tempfile.mkdtemp(prefix="lc-land-")
    lines = [f"line {k} of a topic log, of some length" for k in range(400)]
    spark.createDataFrame([(x,) for x in lines], "value STRING").repartition(20).write.text(f"{base}/log")
    largest = max(os.path.getsize(f) for f in glob.glob(f"{base}/log/*.txt"))
    day = F.when(F.substring("value", 6, 1) == "1", 1).otherwise(2)
    stream = LAND.bounded_lines(spark, f"{base}/log", 3 * largest).withColumn("year", F.lit(2024)).withColumn("month", F.lit(1)).withColumn("day", day)
    w = stream.writeStream.format("text").option("checkpointLocation", f"{base}/ckpt").partitionBy("year", "month", "day").trigger(availableNow=True)
    q = ING.run(w.start(f"{base}/landing"))
    assert len([p for p in q.recentProgress if p["numInputRows"]]) >= 6  # not one batch of all
    sizes = [os.path.getsize(f) for f in glob.glob(f"{base}/landing/year=*/month=*/day=*/*.txt")]
    assert max(sizes) <= 3 * largest and len(sizes) > 10

    assert LAND.compact_landed(spark, f"{base}/landing", f"{base}/archive", before="2024-01-02", file_bytes=2000) == ["year=2024/month=1/day=1"]
    assert LAND.compact_landed(spark, f"{base}/landing", f"{base}/archive", file_bytes=2000) == ["year=2024/month=1/day=2"]
    assert LAND.compact_landed(spark, f"{base}/landing", f"{base}/archive") == []
    got = LAND.read_archive(spark, f"{base}/archive")
    assert sorted(r.value for r in got.collect()) == sorted(lines)
    assert {r.value[5] == "1" for r in got.where("day = 1").collect()} == {True}
    files = [os.path.getsize(f) for f in glob.glob(f"{base}/archive/_versions/*/*.txt")]
    assert max(files) < 2 * 2000 and len(files) < len(sizes)
