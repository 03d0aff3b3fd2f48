"""JDBC reader and writer against the embedded database that ships with Spark.

It lives in memory inside the local Spark process, so these tests need no server; for the same
reason no registered query uses it, as executors elsewhere would not see it.
"""

import uuid

import pytest

from tablesync.operators.increment import id_window
from tablesync.sinks.jdbc import append_table, run_statements, split_statements
from tablesync.sources.jdbc import JdbcConnection, max_id, read_query, read_table, split_bounds


@pytest.fixture(scope="module")
def conn(spark, sf_dir):
    connection = JdbcConnection(f"jdbc:derby:memory:t{uuid.uuid4().hex};create=true", "org.apache.derby.jdbc.EmbeddedDriver")
    run_statements(spark, connection, ["CREATE TABLE ORDERS (O_KEY BIGINT, O_STATUS VARCHAR(1), O_PRICE DOUBLE)"])
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").selectExpr("o_orderkey O_KEY", "o_orderstatus O_STATUS", "o_totalprice O_PRICE")
    append_table(orders, connection, "ORDERS", partitions=1)
    return connection


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_columns_and_filter_reach_the_database(spark, conn, tables, rows):
    df = read_table(spark, conn, "ORDERS", ["O_KEY", "O_PRICE"], "O_STATUS = 'F' AND O_PRICE > 100000")
    want = tables.orders.where("o_orderstatus = 'F' AND o_totalprice > 100000").select("o_orderkey", "o_totalprice")
    assert rows(df) == rows(want)
    assert "WHERE O_STATUS = 'F' AND O_PRICE > 100000" in _plan(df) and "ReadSchema: struct<O_KEY:bigint,O_PRICE:double>" in _plan(df)
    assert "*EqualTo(O_KEY,7)" in _plan(df.where("O_KEY = 7"))


def test_filter_may_use_functions_of_the_database(spark, conn, tables):
    df = read_table(spark, conn, "ORDERS", ["O_KEY"], "MOD(O_KEY, 2) = 0 AND {fn UCASE(O_STATUS)} = 'O'", split_pk="O_KEY")
    assert df.count() == tables.orders.where("o_orderkey % 2 = 0 AND o_orderstatus = 'O'").count()


def test_split_scan_reads_every_row_once(spark, conn, tables, rows):
    df = read_table(spark, conn, "ORDERS", ["O_KEY"], split_pk="O_KEY", channels=4)
    assert df.rdd.getNumPartitions() == 4
    assert rows(df) == rows(tables.orders.select("o_orderkey"))


def test_without_split_key_one_slice(spark, conn):
    assert read_table(spark, conn, "ORDERS").rdd.getNumPartitions() == 1


def test_split_bounds_respect_the_filter(spark, conn):
    assert split_bounds(spark, conn, "ORDERS", "O_KEY", "O_KEY >= 7 AND O_KEY < 90") == (7, 89)
    assert split_bounds(spark, conn, "ORDERS", "O_KEY", "O_KEY < 0") == (None, None)


def test_query_replaces_table_columns_and_filter(spark, conn):
    df = read_table(spark, conn, "NOWHERE", ["NOTHING"], "1 = 0", query_sql="SELECT COUNT(*) AS N FROM ORDERS")
    assert df.collect()[0][0] == read_query(spark, conn, "SELECT O_KEY FROM ORDERS").count()


def test_max_id(spark, conn, tables):
    run_statements(spark, conn, ["CREATE TABLE EMPTY_ORDERS (O_KEY BIGINT)"])
    top = tables.orders.agg({"o_orderkey": "max"}).collect()[0][0]
    assert max_id(spark, conn, "ORDERS", "O_KEY") == top
    assert max_id(spark, conn, "EMPTY_ORDERS", "O_KEY") == 0
    with pytest.raises(Exception):
        max_id(spark, conn, "MISSING", "O_KEY").bit_length()
    window = id_window(read_table(spark, conn, "ORDERS", ["O_KEY"]), "O_KEY", 10, top)
    assert window.agg({"O_KEY": "max"}).collect()[0][0] < top


def test_split_statements():
    assert split_statements("DELETE FROM a\nWHERE x = 1;\r\n ;INSERT INTO b VALUES (1)") == ["DELETE FROM a WHERE x = 1", "INSERT INTO b VALUES (1)"]
    assert split_statements(None) == []


def test_pre_and_post_statements(spark, conn):
    run_statements(spark, conn, ["CREATE TABLE T2 (A BIGINT, B VARCHAR(9))", "CREATE TABLE NOTES (TXT VARCHAR(20))"])
    rows_in = spark.createDataFrame([(1, "x"), (2, "y")], "A bigint, B string")
    append_table(rows_in, conn, "T2", ["A", "B"], pre_sql="INSERT INTO NOTES VALUES ('pre')", post_sql="INSERT INTO NOTES\nVALUES ('post');")
    append_table(rows_in, conn, "T2", pre_sql="DELETE FROM T2")
    assert read_table(spark, conn, "T2").count() == 2
    assert {r[0] for r in read_table(spark, conn, "NOTES").collect()} == {"pre", "post"}


def test_post_statements_need_a_successful_write(spark, conn):
    run_statements(spark, conn, ["CREATE TABLE T3 (A BIGINT NOT NULL)", "CREATE TABLE DONE3 (A INT)"])
    bad = spark.createDataFrame([(None,)], "A bigint")
    with pytest.raises(Exception):
        append_table(bad, conn, "T3", post_sql="INSERT INTO DONE3 VALUES (1)")
    assert read_table(spark, conn, "DONE3").count() == 0


def test_text_keys_and_queries_are_read_in_ranges_of_rows(spark, conn, tables, rows):
    run_statements(spark, conn, ["CREATE TABLE NAMES (K VARCHAR(30), V BIGINT)"])
    data = spark.range(1000).selectExpr("concat('n', char(39), lpad(CAST(id * id AS STRING), 9, '0')) AS K", "id AS V")
    append_table(data, conn, "NAMES", partitions=1)
    run_statements(spark, conn, ["INSERT INTO NAMES VALUES (NULL, 7)"])
    split = read_table(spark, conn, "NAMES", ["K", "V"], split_pk="K", channels=4, by_rows=True)
    sizes = split.rdd.mapPartitions(lambda part: [sum(1 for _ in part)]).collect()
    assert len(sizes) == 4 and max(sizes) <= 2 * min(sizes)
    assert split.where("K IS NULL").count() == 1 and rows(split.where("K IS NOT NULL")) == rows(data)
    query = read_table(spark, conn, query_sql="SELECT O_KEY, O_PRICE FROM ORDERS WHERE O_STATUS = 'F'", split_pk="O_KEY", channels=5)
    assert query.rdd.getNumPartitions() == 5
    assert rows(query) == rows(tables.orders.where("o_orderstatus = 'F'").select("o_orderkey", "o_totalprice"))
    run_statements(spark, conn, ["CREATE TABLE SAME_KEY (K BIGINT)"])
    append_table(spark.range(30).selectExpr("7L AS K"), conn, "SAME_KEY", partitions=1)
    same = read_table(spark, conn, "SAME_KEY", split_pk="K", channels=4, by_rows=True)
    assert same.count() == 30
