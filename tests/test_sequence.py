import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from linecast.operators.sequence import segmented_asof, segmented_lag


def _rows(n, seed):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        key = rnd.choice(["a", "b", None]) if rnd.random() < 0.9 else "hot"
        ts = None if rnd.random() < 0.03 else f"2024-01-{rnd.randint(1, 3):02d} {rnd.randint(0, 23):02d}:{rnd.randint(0, 59):02d}:00"
        val = None if rnd.random() < 0.05 else rnd.randint(-300, 300)
        rows.append((key, ts, i, val))
    return rows


def test_segmented_lag_equals_window_lag(spark):
    df = spark.createDataFrame(_rows(400, 1), "k STRING, ts STRING, tie BIGINT, v BIGINT").withColumn("ts", F.col("ts").cast("timestamp"))
    w = Window.partitionBy("k").orderBy(F.col("ts").asc_nulls_first(), "tie")
    want = sorted(df.select("tie", F.lag("v").over(w).alias("prev_v")).collect())
    for seg in (60, 3600, 86400 * 10):
        got = segmented_lag(df, ["k"], "ts", ["ts", "tie"], ["v"], segment_seconds=seg)
        assert sorted(got.select("tie", "prev_v").collect()) == want


def test_segmented_asof_equals_brute_force(spark):
    rnd = random.Random(7)
    left = [(rnd.choice(["x", "y"]), f"2024-01-01 {rnd.randint(0, 23):02d}:{rnd.randint(0, 59):02d}:00", i) for i in range(150)]
    right = [(rnd.choice(["x", "y"]), f"2024-01-01 {rnd.randint(0, 23):02d}:{rnd.randint(0, 59):02d}:00", j, float(j)) for j in range(40)]
    L = spark.createDataFrame(left, "k STRING, t STRING, lid BIGINT").withColumn("t", F.col("t").cast("timestamp"))
    R = spark.createDataFrame(right, "k STRING, rt STRING, rid BIGINT, val DOUBLE").withColumn("rt", F.col("rt").cast("timestamp"))
    expect = {}
    for k, t, lid in left:
        cands = [(rt, rid, v) for (rk, rt, rid, v) in right if rk == k and rt <= t]
        expect[lid] = max(cands)[2] if cands else None
    for seg in (300, 3600, 86400):
        got = segmented_asof(L, R, ["k"], "t", "rt", ["val"], right_tie=["rid"], how="left", segment_seconds=seg)
        assert {r.lid: r.val for r in got.collect()} == expect
        inner = segmented_asof(L, R, ["k"], "t", "rt", ["val"], right_tie=["rid"], how="inner", segment_seconds=seg)
        assert inner.count() == sum(1 for v in expect.values() if v is not None)


def test_hot_key_is_spread_over_tasks(spark):
    """One key holds a third of all rows: a plain window puts it in one task, the segmented one
    spreads it over the shuffle partitions by time segment."""
    from linecast.operators import sequence as SQ

    n = 30000
    df = spark.range(n).select(
        F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise((F.col("id") % 997).cast("string")).alias("k"),
        (F.lit("2024-01-01").cast("timestamp") + F.make_dt_interval(F.lit(0), F.lit(0), F.col("id") % 7000)).alias("ts"),
        F.col("id").alias("tie"),
        (F.col("id") % 500).alias("v"),
    )
    prev = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plain = df.repartition(8, "k")
        share_plain = max(r[1] for r in plain.groupBy(F.spark_partition_id()).count().collect()) / n
        seg = SQ._keyed(df, ["k"], SQ.segment_of("ts", 600).alias(SQ.SEG)).repartition(8, SQ.KEY, SQ.SEG)
        share_seg = max(r[1] for r in seg.groupBy(F.spark_partition_id()).count().collect()) / n
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", prev)
    assert share_plain > 0.33
    assert share_seg < 0.2
    # and the operator's own exchange is on (key, segment)
    out = segmented_lag(df, ["k"], "ts", ["ts", "tie"], ["v"], segment_seconds=600)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(__seq_key" in plan and "__seq_seg" in plan


def test_auto_segments_equal_window_and_split_hot_key(spark):
    from linecast.operators import sequence as SQ

    df = spark.createDataFrame(_rows(600, 3), "k STRING, ts STRING, tie BIGINT, v BIGINT").withColumn("ts", F.col("ts").cast("timestamp"))
    w = Window.partitionBy("k").orderBy(F.col("ts").asc_nulls_first(), "tie")
    want = sorted(df.select("tie", F.lag("v").over(w).alias("prev_v")).collect())
    got = segmented_lag(df, ["k"], "ts", ["ts", "tie"], ["v"], segment_seconds="auto", target_rows=20)
    assert sorted(got.select("tie", "prev_v").collect()) == want
    keyed = SQ._keyed(df, ["k"], F.struct("ts", "tie").alias(SQ.ORD))
    per_seg = SQ.numbered(keyed, SQ.hot_bounds(keyed, 20)).groupBy(SQ.KEY, SQ.SEG).count().agg(F.max("count")).first()[0]
    assert per_seg <= 40  # no segment above twice the target instead of whole days of a key


def _awkward(spark, n=20000):
    """One key: a stray time in 1970, a fifth of null times, a fifth at one instant; few other rows."""
    i = F.col("id")
    ts = F.when(i == 5, F.lit("1970-01-01").cast("timestamp")).when(i % 5 == 1, F.lit(None).cast("timestamp"))
    ts = ts.when(i % 5 == 2, F.lit("2024-01-01 12:00:00").cast("timestamp"))
    ts = ts.otherwise(F.lit("2024-01-01").cast("timestamp") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), i % 9000))
    key = F.when(i % 50 == 0, F.concat(F.lit("k"), (i % 7).cast("string"))).otherwise(F.lit("hot"))
    return spark.range(n).select(key.alias("k"), ts.alias("ts"), F.xxhash64("id").alias("tie"), (i % 500).alias("v"))


def test_stray_null_and_shared_times_leave_no_large_segment(spark):
    from linecast.operators import sequence as SQ

    df = _awkward(spark)
    keyed = SQ._keyed(df, ["k"], F.struct("ts", "tie").alias(SQ.ORD))
    bounds = SQ.hot_bounds(keyed, 1000)
    sizes = [r[2] for r in SQ.numbered(keyed, bounds).groupBy(SQ.KEY, SQ.SEG).count().collect()]
    assert max(sizes) <= 2000 and sum(sizes) == 20000 and len(sizes) > 15
    w = Window.partitionBy("k").orderBy(F.col("ts").asc_nulls_first(), "tie")
    want = sorted(df.select("tie", F.lag("v").over(w).alias("prev_v")).collect())
    got = segmented_lag(df, ["k"], "ts", ["ts", "tie"], ["v"], target_rows=1000)
    assert sorted(got.select("tie", "prev_v").collect()) == want


def test_asof_splits_left_rows_of_one_instant(spark):
    left = _awkward(spark).select("k", F.col("ts").alias("t"), F.col("tie").alias("lid"))
    right = _awkward(spark, 3000).where("ts IS NOT NULL").select("k", F.col("ts").alias("rt"), F.col("tie").alias("rid"), F.col("v").alias("val"))
    a = segmented_asof(left, right, ["k"], "t", "rt", ["val"], right_tie=["rid"], how="left", target_rows=500)
    b = segmented_asof(left, right, ["k"], "t", "rt", ["val"], right_tie=["rid"], how="left", segment_seconds=10**9)
    assert "__bounds" in a._jdf.queryExecution().analyzed().toString()
    assert sorted(a.select("lid", "val").collect()) == sorted(b.select("lid", "val").collect())


def test_small_inputs_are_one_plain_window(spark):
    df = spark.createDataFrame(_rows(100, 5), "k STRING, ts STRING, tie BIGINT, v BIGINT").withColumn("ts", F.col("ts").cast("timestamp"))
    plan = segmented_lag(df, ["k"], "ts", ["ts", "tie"], ["v"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Join" not in plan


def test_auto_asof_equals_fixed(spark):
    rnd = random.Random(11)
    left = [(rnd.choice(["x", "y"]), f"2024-01-01 {rnd.randint(0, 23):02d}:{rnd.randint(0, 59):02d}:00", i) for i in range(200)]
    right = [(rnd.choice(["x", "y"]), f"2024-01-01 {rnd.randint(0, 23):02d}:{rnd.randint(0, 59):02d}:00", j, float(j)) for j in range(60)]
    L = spark.createDataFrame(left, "k STRING, t STRING, lid BIGINT").withColumn("t", F.col("t").cast("timestamp"))
    R = spark.createDataFrame(right, "k STRING, rt STRING, rid BIGINT, val DOUBLE").withColumn("rt", F.col("rt").cast("timestamp"))
    a = {r.lid: r.val for r in segmented_asof(L, R, ["k"], "t", "rt", ["val"], right_tie=["rid"], how="left", segment_seconds="auto", target_rows=15).collect()}
    b = {r.lid: r.val for r in segmented_asof(L, R, ["k"], "t", "rt", ["val"], right_tie=["rid"], how="left").collect()}
    assert a == b
