"""The registered queries and the pipeline on the smallest tables."""

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from linecast.llm import catalog, decontam, toxicity
from linecast.llm.scratch import table
from tests.llm.test_neardup import brute as near_brute

SF = "/root/testdata/sf0.001"
TABLES = "documents embeddings pages benchmark labels conversations".split()


def test_thirteen_queries():
    assert sorted(int(n[2:].split("_")[0]) for n in catalog.QUERIES) == list(range(1, 14))
    assert set(catalog.ORACLE) <= set(catalog.QUERIES)


@pytest.mark.parametrize("name", sorted(catalog.ORACLE))
def test_equals_its_sql(spark, name):
    from tools.oracle_check import digest

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    df = catalog.QUERIES[name](spark, SF)
    res = con.execute(catalog.ORACLE[name])
    cols = [c[0] for c in res.description]
    assert sorted(df.columns) == sorted(cols)
    assert digest(df.columns, [tuple(r) for r in df.collect()])[0] == digest(cols, res.fetchall())[0]


@pytest.mark.parametrize("name", ["op2_perspective_rotation", "op3_temperature_mixing", "op10_benchmark_decontamination"])
def test_native_plans(spark, name):
    plan = catalog.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    for node in ("Python", "Pandas", "Arrow", "CartesianProduct", "NestedLoop"):
        assert node not in plan


def test_pipeline_stages(spark):
    docs = table(spark, SF, "documents")
    steps = dict(corpus_pipeline.STAGES)
    clean = steps["toxicity"](spark, docs, SF)
    weights = toxicity.train(docs, table(spark, SF, "labels"))
    low = {r.doc_id for r in toxicity.score(docs, weights).collect() if r.score < 0.3}
    assert {r.doc_id for r in clean.collect()} == low

    once = steps["near_duplicates"](spark, clean, SF)
    expected = {r[0] for r in near_brute([(r.doc_id, r.text) for r in clean.collect()], 80) if r[3]}
    assert sorted(r.doc_id for r in once.collect()) == sorted(expected)

    free = steps["decontamination"](spark, once, SF)
    bad = {r.doc_id for r in decontam.decontaminate(once, table(spark, SF, "benchmark")).collect() if r.contaminated}
    assert {r.doc_id for r in free.collect()} == expected - bad
    for stage in (clean, once, free):
        assert stage.columns == docs.columns

    mixed = steps["mixing"](spark, free, SF)
    assert mixed.columns == docs.columns
    copies = {}
    for r in mixed.collect():
        copies[r.doc_id] = copies.get(r.doc_id, 0) + 1
    assert set(copies) == expected - bad and set(copies.values()) <= {1, 2}


def test_run_gives_every_row_a_shard(spark):
    out = corpus_pipeline.run(spark, SF).collect()
    assert out and all(r["shard"] is not None for r in out)


def test_run_on_empty_tables(spark, tmp_path):
    for t in ("documents", "labels", "benchmark"):
        table(spark, SF, t).limit(0).write.parquet(str(tmp_path / f"{t}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_run_on_awkward_rows(spark, tmp_path):
    """Null and empty texts, null and repeated ids, repeated rows, a very long text, extra columns."""
    docs = table(spark, SF, "documents")
    long_text = " ".join(f"word{k}" for k in range(60_000))
    names = {f.name for f in docs.schema.fields}
    odd = [(None, None), (None, ""), (9_000_001, None), (9_000_002, ""), (9_000_003, long_text), (9_000_004, "one two"), (9_000_004, "three four"), (9_000_004, "three four")]
    more = spark.createDataFrame([(i, t, "en", "odd", 0) for i, t in odd], "doc_id long, text string, lang string, source string, n_chars long")
    assert names == set(more.columns)
    both = docs.unionByName(more).withColumns({"score": F.lit("x"), "node": F.lit(1), "id": F.lit(2.5), "bands": F.lit("b"), "hits": F.lit(True)})
    both.write.parquet(str(tmp_path / "documents.parquet"))
    for t in ("labels", "benchmark"):
        table(spark, SF, t).write.parquet(str(tmp_path / f"{t}.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert set(both.columns) < set(out.columns)
    found = [(r.doc_id, r.text) for r in out.where("source = 'odd'").collect()]
    expected = {(None, None), (None, ""), (9_000_001, None), (9_000_002, ""), (9_000_003, long_text), (9_000_004, "one two"), (9_000_004, "three four")}
    assert set(found) == expected and out.where("shard IS NULL").count() == 0
    assert {r.score for r in out.collect()} == {"x"}
