"""The corpus pipeline stage by stage, and the registered queries."""

import brute
import duckdb
import pytest

import __spark_entry__ as driver
import corpus_pipeline
from check_oracles import TABLES, rows_of
from rowtrail.llm import queries

SF = "/root/testdata/sf0.001"


def test_stages_in_a_row(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    sizes = [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, stage(spark, docs, SF)
        if name != "best_fit_packing":
            assert docs.columns == columns and docs.dtypes == before.dtypes
            docs = spark.createDataFrame(docs.collect(), docs.schema)
            sizes.append(docs.count())
        if name == "line_dedup":
            cut = brute.lines([(r["doc_id"], r["text"]) for r in before.collect()])
            assert {r["doc_id"]: r["text"] for r in docs.collect()} == {i: t for i, (n, gone, t) in cut.items() if gone < n}
            assert all(r["n_chars"] == len(r["text"]) for r in docs.collect())
        if name == "minhash_near_dedup":
            near = brute.near([(r["doc_id"], r["text"]) for r in before.collect()], k=5)
            assert {r["doc_id"] for r in docs.collect()} == {c for _, c in near.values()}
    assert sizes == sorted(sizes, reverse=True) and sizes[-1] > 50
    whole = {(r["doc_id"], r["piece"], r["ids_crc32"]) for r in corpus_pipeline.run(spark, SF).collect()}
    assert whole == {(r["doc_id"], r["piece"], r["ids_crc32"]) for r in docs.collect()}


def test_stages_on_an_empty_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
        assert docs.count() == 0


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_same_rows_as_sql(spark, name):
    con = duckdb.connect()
    for table in TABLES.split():
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    df = queries.QUERIES[name](spark, SF)
    result = con.execute(queries.SQL[name])
    columns = [d[0] for d in result.description]
    assert sorted(df.columns) == sorted(columns) and rows_of(df.columns, df.collect()) == rows_of(columns, result.fetchall())


def test_all_are_registered():
    assert {f"op{i}_" for i in range(1, 11)} == {n.split("_")[0] + "_" for n in queries.QUERIES}
    assert {"pipeline", *queries.QUERIES} <= set(driver.queries())
