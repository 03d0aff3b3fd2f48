"""Every registered query that SQL can express, against DuckDB over the same files."""

import duckdb
import pytest

from tablesync.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(name, spark):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    frame = QUERIES[name](spark, SF)
    columns = sorted(frame.columns)
    got = sorted((tuple(r) for r in frame.select(columns).collect()), key=repr)
    cursor = con.execute(ORACLES[name])
    names = [c[0] for c in cursor.description]
    assert sorted(names) == columns
    assert got == sorted((tuple(r[names.index(c)] for c in columns) for r in cursor.fetchall()), key=repr)


@pytest.mark.parametrize("name", ["op1_packing", "op4_simhash", "op5_language_id", "op9_toxicity"])
def test_one_answer_for_each_document(name, spark):
    documents = spark.read.parquet(f"{SF}/documents.parquet")
    answered = QUERIES[name](spark, SF).select("doc_id").distinct()
    assert answered.join(documents, "doc_id").count() == documents.count()
