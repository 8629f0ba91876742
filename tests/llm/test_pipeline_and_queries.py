"""The pipeline's stages on planted documents, and queries against their SQL."""

import random

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from checks.run import TABLES, canonical
from newsfunnel.llm import queries

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    con.execute("SET enable_progress_bar = false")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = canonical(queries.queries()[name](spark, SF).toPandas())
    want = canonical(con.execute(queries.oracle_sql()[name]).df())
    assert list(got.columns) == list(want.columns) and got.equals(want)


def test_stages_keep_clean_documents_and_take_their_decisions(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rng = random.Random(9)
    fresh = lambda n: " ".join(f"q{rng.randrange(10**6)}" for _ in range(n))
    item = spark.read.parquet(f"{SF}/benchmark.parquet").orderBy("item_id").first()["text"]
    base, passage = fresh(120), fresh(70)
    near = base.split()
    near[50] = "other"
    planted = {
        900001: base, 900002: " ".join(near), 900003: fresh(90) + " " + passage, 900004: passage + " " + fresh(90),
        900005: fresh(40) + " " + item + " " + fresh(40), 900006: fresh(100), 900007: "",
    }
    extra = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in planted.items()] + [(None, fresh(60), None, None, None)], docs.schema)
    current = docs.unionByName(extra)
    kept = {}
    for name, step in corpus_pipeline.STAGES:
        out = step(spark, current, SF)
        if name != "packing":
            assert out.columns == COLUMNS
        out.write.parquet(str(tmp_path / name))
        current = spark.read.parquet(str(tmp_path / name))
        kept[name] = {r["doc_id"] for r in current.select("doc_id").collect()}
    assert 900007 not in kept["quality"] and {900001, 900006, None} <= kept["quality"]
    assert {900001, 900003, 900004, 900005, None} <= kept["near_duplicates"] and 900002 not in kept["near_duplicates"]
    text = {r["doc_id"]: r["text"] for r in spark.read.parquet(str(tmp_path / "passages")).collect()}
    assert text[900003] == planted[900003] and text[900004] == " ".join(planted[900004].split()[70:])
    assert 900005 not in kept["decontamination"] and {900001, 900003, 900006, None} <= kept["decontamination"]
    assert kept["packing"] == kept["decontamination"]


def test_clashing_columns_and_repeated_rows(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(60)
    names = ["keep", "cut", "n_hit", "row", "p_junk", "spans", "count", "component_id", "lot", "bin", "doc"]
    current = docs.union(docs.limit(20))
    for n in names:
        current = current.withColumn(n, F.lit("mine"))
    for name, step in corpus_pipeline.STAGES:
        out = step(spark, current, SF)
        if name != "packing":
            assert out.columns == [*COLUMNS, *names]
        out.write.parquet(str(tmp_path / name))
        current = spark.read.parquet(str(tmp_path / name))
        if name != "packing":
            assert all(r[n] == "mine" for r in current.collect() for n in names)
    assert current.count() > 0


def test_empty_documents_go_through(spark, tmp_path):
    current = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for name, step in corpus_pipeline.STAGES:
        step(spark, current, SF).write.parquet(str(tmp_path / name))
        current = spark.read.parquet(str(tmp_path / name))
    assert current.count() == 0
