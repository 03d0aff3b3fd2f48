"""Registered scans. Databases need one of their own, so those are covered by the unit tests;
here the same operators read the given tables, and files written from them."""

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablesync.operators.common import ntz
from tablesync.queries.registry import query
from tablesync.session import scratch_path
from tablesync.sinks.files import write_documents, write_files, write_partition_dir
from tablesync.sources import cells, documents, files, generated, jdbc, tables

_ORDER_COLUMNS = "o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate"


@query("scan_table", "SELECT o_orderkey, o_totalprice, o_orderdate FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 100000")
def scan_table(t):
    return tables.select_table(t.orders, ["o_orderkey", "o_totalprice", "o_orderdate"], "o_orderstatus = 'F' AND o_totalprice > 100000")


@query("scan_split_pk", """SELECT CAST((l_orderkey - b.lo) // CAST(ceil((b.hi - b.lo + 1) / 7) AS BIGINT) AS INTEGER) AS slice, min(l_orderkey) AS first_key,
  max(l_orderkey) AS last_key, count(*) AS rows_read FROM lineitem, (SELECT min(l_orderkey) AS lo, max(l_orderkey) AS hi FROM lineitem) b GROUP BY 1""")
def scan_split_pk(t):
    sliced = jdbc.with_split_slice(t.lineitem.select("l_orderkey"), "l_orderkey", 7)
    return sliced.groupBy("slice").agg(
        F.min("l_orderkey").alias("first_key"), F.max("l_orderkey").alias("last_key"), F.count(F.lit(1)).alias("rows_read")
    )


@query("scan_query_sql", """SELECT c_mktsegment, o_orderstatus, count(*) AS orders_n, round(sum(o_totalprice), 2) AS total
FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_orderdate >= TIMESTAMP '1997-01-01 00:00:00' GROUP BY 1, 2""")
def scan_query_sql(t):
    sql = """SELECT c_mktsegment, o_orderstatus, count(*) AS orders_n, round(sum(o_totalprice), 2) AS total
        FROM {orders} JOIN {customer} ON c_custkey = o_custkey WHERE o_orderdate >= CAST(:since AS TIMESTAMP_NTZ) GROUP BY 1, 2"""
    return tables.run_query(t.spark, sql, {"orders": t.orders, "customer": t.customer}, {"since": "1997-01-01 00:00:00"})


@query("scan_multi_table", """SELECT c_custkey AS id, c_name AS name, c_nationkey AS nation, c_acctbal AS balance FROM customer
UNION ALL SELECT s_suppkey, s_name, s_nationkey, s_acctbal FROM supplier""")
def scan_multi_table(t):
    shape = ["id", "name", "nation", "balance"]
    people = t.customer.select("c_custkey", "c_name", "c_nationkey", "c_acctbal").toDF(*shape)
    firms = t.supplier.select("s_suppkey", "s_name", "s_nationkey", "s_acctbal").toDF(*shape)
    return tables.read_multi([people, firms])


@query("scan_delimited", f"SELECT {_ORDER_COLUMNS}, 'batch-7' AS tag FROM orders")
def scan_delimited(t):
    rows = t.orders.select("o_orderkey", "o_orderpriority", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate")
    path = write_files(rows, scratch_path(t.spark, "delimited"), "orders", "text", sep="\u0001", header=True)
    columns = [
        {"index": 0, "type": "long", "name": "o_orderkey"}, {"index": 2, "type": "long", "name": "o_custkey"},
        {"index": 3, "type": "string", "name": "o_orderstatus"}, {"index": 4, "type": "double", "name": "o_totalprice"},
        {"index": 5, "type": "date", "name": "o_orderdate"}, {"value": "batch-7", "type": "string", "name": "tag"},
    ]
    return files.read_delimited(t.spark, path, columns, sep="\u0001", skip_header=True)


@query("scan_file_types", " UNION ALL ".join(f"SELECT '{kind}' AS kind, p_partkey, p_brand, p_size, p_retailprice FROM part" for kind in files.READABLE_TYPES))
def scan_file_types(t):
    rows = t.part.select("p_partkey", "p_brand", "p_size", "p_retailprice")
    columns = [{"index": i, "type": ty, "name": n} for i, (n, ty) in enumerate([("p_partkey", "long"), ("p_brand", "string"), ("p_size", "long"), ("p_retailprice", "double")])]

    def back(kind):
        found = files.read_file(t.spark, write_files(rows, scratch_path(t.spark, kind), "part", kind), kind, columns)
        return found.select(F.lit(kind).alias("kind"), "p_partkey", "p_brand", F.col("p_size").cast("int").alias("p_size"), "p_retailprice")

    return reduce(DataFrame.unionAll, map(back, files.READABLE_TYPES))


@query("scan_partition_path", """SELECT event_id, user_id, value, '2024-01-05' AS p_data_day FROM events
WHERE ts >= TIMESTAMP '2024-01-05 00:00:00' AND ts < TIMESTAMP '2024-01-06 00:00:00'""")
def scan_partition_path(t):
    rows = t.events.select("event_id", "user_id", "value", F.date_format("ts", "yyyy-MM-dd").alias("p_data_day"))
    root = write_partition_dir(rows, scratch_path(t.spark, "partitioned"), "p_data_day")
    return files.read_partition(
        t.spark, root, "p_data_day=2024-01-05", "event_id bigint, user_id bigint, value double", p_data_day="2024-01-05"
    )


_LATEST = """SELECT rowkey, arg_max(value, ver) FILTER (qualifier = 'name') AS name, arg_max(value, ver) FILTER (qualifier = 'nation') AS nation,
  arg_max(value, ver) FILTER (qualifier = 'segment') AS segment FROM cells GROUP BY rowkey"""


@query("scan_cells_latest", _LATEST, "cells")
def scan_cells_latest(t):
    return cells.scan_latest(t.cells, ["cf:name", "cf:nation", "cf:segment"])


@query("scan_cells_versions", """SELECT rowkey, family, qualifier, ver, value FROM cells WHERE qualifier IN ('nation', 'segment')
QUALIFY row_number() OVER (PARTITION BY rowkey, family, qualifier ORDER BY ver DESC) <= 2""", "cells")
def scan_cells_versions(t):
    return cells.scan_versions(t.cells, ["cf:nation", "cf:segment"], 2)


@query("scan_rowkey_range", "SELECT * FROM cells WHERE rowkey >= '10' AND rowkey < '2'", "cells")
def scan_rowkey_range(t):
    return cells.rowkey_range(t.cells, "10", "2")


@query("scan_documents", """SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events""")
def scan_documents(t):
    return documents.parse_documents(t.events.select("event_id", "props"), "props", ["k:long"])


@query("scan_generated", "SELECT o_orderkey, 10 AS c0, 'hello, world' AS c1, TRUE AS c2, TIMESTAMP '2024-01-01 00:00:00' AS c3, 1.5::DOUBLE AS c4 FROM orders".replace("10 AS", "CAST(10 AS BIGINT) AS"))
def scan_generated(t):
    columns = [
        {"name": "c0", "type": "long", "value": "10"}, {"name": "c1", "type": "string", "value": "hello, world"},
        {"name": "c2", "type": "bool", "value": "true"}, {"name": "c3", "type": "date", "value": "2024-01-01 00:00:00"},
        {"name": "c4", "type": "double", "value": "1.5"},
    ]
    return generated.generate_columns(t.orders.select("o_orderkey"), "o_orderkey", columns)


def _bits(name):
    return f"CAST('0x' || substring(md5(CAST(o_orderkey AS VARCHAR) || ':42:{name}'), 1, 15) AS BIGINT)"


@query("scan_generated_random", f"""SELECT o_orderkey, 2 + {_bits('c0')} % 9 AS c0, left(sha256(CAST(o_orderkey AS VARCHAR) || ':42:c1'), {_bits('c1')} % 11) AS c1,
  {_bits('c2')} % 10 >= 3 AS c2, TIMESTAMP '2014-07-07 00:00:00' + to_seconds({_bits('c3')} % 63158401) AS c3,
  round({_bits('c4')} % 9007199254740992 / 9007199254740992.0::DOUBLE * 10, 9) AS c4 FROM orders""")
def scan_generated_random(t):
    columns = [
        {"name": "c0", "type": "long", "random": "2, 10"}, {"name": "c1", "type": "string", "random": "0, 10"},
        {"name": "c2", "type": "bool", "random": "3, 7"}, {"name": "c3", "type": "date", "random": "2014-07-07 00:00:00, 2016-07-07 00:00:00"},
        {"name": "c4", "type": "double", "random": "0, 10"},
    ]
    made = generated.generate_columns(t.orders.select("o_orderkey"), "o_orderkey", columns, seed=42)
    return made.withColumn("c4", F.round("c4", 9))


@query("sink_documents", "SELECT o_orderkey AS id, o_orderstatus AS status, o_totalprice AS price, o_orderdate AS placed FROM orders")
def sink_documents(t):
    fields = ["id:long", "status:string", "price:double", "placed:date"]
    path = scratch_path(t.spark, "documents")
    write_documents(t.orders.select("o_orderkey", "o_orderstatus", "o_totalprice", "o_orderdate"), path, fields)
    return documents.read_documents(t.spark, path, fields)
