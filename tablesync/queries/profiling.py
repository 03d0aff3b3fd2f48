"""Registered source profiles."""

from pyspark.sql import functions as F

from tablesync.operators import profile
from tablesync.queries.registry import query
from tablesync.session import scratch_path


def _key(table, columns):
    names = columns.split(",")
    value = names[0] if len(names) == 1 else f"({', '.join(names)})"
    nulls = " OR ".join(f"{n} IS NULL" for n in names)
    return f"(SELECT count(DISTINCT {value}) = count(*) AND count(*) FILTER ({nulls}) = 0 FROM {table})"


_CUSTOMER = [("c_custkey", "bigint"), ("c_name", "string"), ("c_nationkey", "int"), ("c_acctbal", "double"), ("c_mktsegment", "string")]


@query("describe_table", " UNION ALL ".join(
    f"SELECT {i} AS position, '{n}' AS name, '{ty}' AS type, TRUE AS nullable, CAST(NULL AS VARCHAR) AS comment, {_key('customer', n)} AS is_key, '{i}:{n}:{ty}' AS spec"
    for i, (n, ty) in enumerate(_CUSTOMER)))
def describe_table(t):
    return profile.describe_table(t.customer, profile.candidate_keys(t.customer))


_LINE = "l_orderkey l_partkey l_suppkey l_linenumber l_quantity l_extendedprice l_discount l_tax l_returnflag l_linestatus l_shipdate".split()
_ORDER = "o_orderkey o_custkey o_orderstatus o_totalprice o_orderdate o_orderpriority".split()
_LINE_PAIRS = [("l_orderkey", "l_linenumber"), ("l_orderkey", "l_partkey"), ("l_linenumber", "l_partkey")]
_ORDER_PAIRS = [("o_orderkey", "o_custkey")]


@query("candidate_keys", " UNION ALL ".join(
    f"SELECT '{c}' AS columns, {_key(table, c)} AS is_key"
    for table, names in (("lineitem", [*_LINE, *map(",".join, _LINE_PAIRS)]), ("orders", [*_ORDER, *map(",".join, _ORDER_PAIRS)])) for c in names))
def candidate_keys(t):
    return profile.candidate_keys(t.lineitem, _LINE, _LINE_PAIRS).unionAll(profile.candidate_keys(t.orders, _ORDER, _ORDER_PAIRS))


@query("infer_document_schema", """SELECT field, type, count(*) AS documents FROM (
  SELECT key AS field, CASE json_type(value) WHEN 'UBIGINT' THEN 'long' WHEN 'BIGINT' THEN 'long' WHEN 'VARCHAR' THEN 'string' WHEN 'BOOLEAN' THEN 'bool'
    WHEN 'DOUBLE' THEN 'double' WHEN 'OBJECT' THEN 'object' WHEN 'ARRAY' THEN 'array' END AS type
  FROM (SELECT unnest(json_keys(doc)) AS key, doc FROM event_docs WHERE json_valid(doc)), LATERAL (SELECT json_extract(doc, '$.' || key) AS value))
WHERE type IS NOT NULL GROUP BY 1, 2
UNION ALL SELECT NULL, 'invalid', count(*) FROM event_docs WHERE doc IS NOT NULL AND NOT json_valid(doc) HAVING count(*) > 0""", "event_docs")
def infer_document_schema(t):
    return profile.infer_document_schema(t.event_docs, "doc")


@query("infer_document_schema_nested", """WITH RECURSIVE walk(path, value) AS (
  SELECT key, json_extract(doc, '$.' || key) FROM (SELECT unnest(json_keys(doc)) AS key, doc FROM event_docs WHERE json_valid(doc))
  UNION ALL
  SELECT path || CASE WHEN key = '' THEN '[]' ELSE '.' || key END, value FROM (
    SELECT path, unnest(CASE json_type(value) WHEN 'OBJECT' THEN list_transform(json_keys(value), lambda k: {'key': k, 'value': json_extract(value, '$.' || k)})
      ELSE list_transform(CAST(json_extract(value, '$[*]') AS JSON[]), lambda x: {'key': '', 'value': x}) END, recursive := true)
    FROM walk WHERE json_type(value) IN ('OBJECT', 'ARRAY')))
SELECT path, CASE json_type(value) WHEN 'UBIGINT' THEN 'long' WHEN 'BIGINT' THEN 'long' WHEN 'VARCHAR' THEN 'string' WHEN 'BOOLEAN' THEN 'bool'
    WHEN 'DOUBLE' THEN 'double' WHEN 'OBJECT' THEN 'object' WHEN 'ARRAY' THEN 'array' ELSE 'null' END AS type, count(*) AS count FROM walk GROUP BY ALL
UNION ALL SELECT NULL, 'invalid', count(*) FROM event_docs WHERE doc IS NOT NULL AND NOT json_valid(doc) HAVING count(*) > 0""", "event_docs")
def infer_document_schema_nested(t):
    return profile.infer_document_schema_nested(t.event_docs, "doc")


@query("infer_cell_columns", """SELECT family || ':' || qualifier AS "column", count(DISTINCT CASE WHEN value IS NOT NULL THEN rowkey END) AS filled,
  round(count(DISTINCT CASE WHEN value IS NOT NULL THEN rowkey END) / (SELECT count(DISTINCT rowkey) FROM cells), 6) AS fill_rate FROM cells GROUP BY 1""", "cells")
def infer_cell_columns(t):
    return profile.infer_cell_columns(t.cells).withColumn("fill_rate", F.round("fill_rate", 6))


def _profile(table, columns):
    return " UNION ALL ".join(
        f"SELECT '{table}' AS table_name, {i} AS position, '{c}' AS name, count(*) AS row_count, count(*) - count({c}) AS null_count, CAST(min({c}) AS VARCHAR) AS min_value, "
        f"CAST(max({c}) AS VARCHAR) AS max_value, count(DISTINCT {c}) AS distinct_count FROM {table}" for i, c in enumerate(columns))


@query("profile_table", f"{_profile('orders', _ORDER)} UNION ALL {_profile('lineitem', _LINE)}")
def profile_table(t):
    each = [profile.profile_table(getattr(t, n), c).select(F.lit(n).alias("table_name"), "*") for n, c in (("orders", _ORDER), ("lineitem", _LINE))]
    return each[0].unionAll(each[1])


@query("profile_files", " UNION ALL ".join(
    f"SELECT {i} AS position, '{c}' AS name, count(*) AS row_count, count(*) - count({c}) AS null_count, CAST(min({c}) AS VARCHAR) AS min_value, "
    f"CAST(max({c}) AS VARCHAR) AS max_value, TRUE AS distinct_close FROM orders" for i, c in enumerate(_ORDER)))
def profile_files(t):
    """Orders arrive in two loads; each load is read once, and the estimate of distinct values is held against the exact count."""
    path, store = scratch_path(t.spark, "profiled"), scratch_path(t.spark, "profiles")
    early = F.col("o_orderdate") < F.lit("1996-01-01").cast("timestamp_ntz")
    for part in (t.orders.where(early), t.orders.where(~F.coalesce(early, F.lit(False)))):
        part.select(*_ORDER).write.mode("append").parquet(path)
        merged = profile.profile_files(t.spark, path, store, _ORDER)
    exact = profile.profile_table(t.orders, _ORDER).select("name", F.col("distinct_count").alias("exact"))
    close = F.abs(F.col("distinct_count") - F.col("exact")) <= 0.05 * F.col("exact")
    return merged.join(exact, "name").select("position", "name", "row_count", "null_count", "min_value", "max_value", close.alias("distinct_close"))


@query("schema_compat", """SELECT * FROM (VALUES
  (0, 'c_custkey', 'bigint', 's_suppkey', 'bigint', 'renamed', (SELECT count(c_custkey) FROM customer)),
  (1, 'c_name', 'string', 'c_name', 'string', 'same', (SELECT count(c_name) FROM customer)),
  (2, 'c_nationkey', 'int', 'c_nationkey', 'string', 'type_change', (SELECT count(c_nationkey) FROM customer)),
  (3, 'c_acctbal', 'double', NULL, NULL, 'missing', (SELECT count(c_acctbal) FROM customer)),
  (4, 'c_mktsegment', 'string', NULL, NULL, 'missing', (SELECT count(c_mktsegment) FROM customer)))
  v(position, reader_name, reader_type, writer_name, writer_type, status, reader_values)""")
def schema_compat(t):
    writer = t.supplier.select("s_suppkey", F.col("s_name").alias("c_name"), F.col("s_nationkey").cast("string").alias("c_nationkey"))
    return profile.schema_compat(t.customer, writer)
