"""Registered sinks, mappings, quality gates and whole syncs."""

from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from tablesync.operators import mapping
from tablesync.operators.common import upsert
from tablesync.plans.sync import SyncSpec, batch_sync, run_sync, sync_counters, target_rows
from tablesync.queries.registry import query
from tablesync.session import scratch_path
from tablesync.sinks import cells as cell_sink
from tablesync.sinks.files import write_files, write_nowhere, write_partition_dir
from tablesync.sinks.jdbc import run_catalog_statements, with_statements
from tablesync.sources.files import read_delimited
from tablesync.sources.tables import run_query

_RAW_TYPES = [("f_id", "long"), ("f_ts", "date"), ("f_value", "double"), ("f_flag", "bool")]
_DIRTY = "event_id % 9 = 0 OR event_type = 'error'"


@query("sink_delimited", "SELECT c_custkey AS no, c_name AS name, c_acctbal AS score FROM customer")
def sink_delimited(t):
    declared = [("no", "long"), ("name", "string"), ("score", "double")]
    path = write_files(t.customer.select("c_custkey", "c_name", "c_acctbal"), scratch_path(t.spark, "text"), "customer", "text", declared)
    return read_delimited(t.spark, path, [{"index": i, "type": ty, "name": n} for i, (n, ty) in enumerate(declared)])


@query("sink_pre_post_sql", """SELECT o_orderstatus, count(*) AS orders_n, round(sum(o_totalprice), 2) AS total
FROM orders WHERE o_orderpriority <> '5-LOW' GROUP BY 1""")
def sink_pre_post_sql(t):
    """Statements before the load create the tables, those after it tidy up and take stock."""
    root = scratch_path(t.spark, "statements")
    name = root.rsplit("-", 1)[1]
    target, audit = f"target_{name}", f"audit_{name}"
    pre = f"""CREATE TABLE {target} (o_orderkey BIGINT, o_orderstatus STRING, o_totalprice DOUBLE, o_orderpriority STRING)
        USING parquet LOCATION '{root}/target';
        CREATE TABLE {audit} (o_orderstatus STRING, orders_n BIGINT, total DOUBLE) USING parquet LOCATION '{root}/audit'"""
    post = f"""INSERT INTO {audit} SELECT o_orderstatus, count(*), round(sum(o_totalprice), 2) FROM {target}
        WHERE o_orderpriority <> '5-LOW' GROUP BY 1; DROP TABLE {target}; DROP TABLE {audit}"""
    rows = t.orders.select("o_orderkey", "o_orderstatus", "o_totalprice", "o_orderpriority")
    with_statements(lambda statements: run_catalog_statements(t.spark, statements), pre, lambda: rows.write.insertInto(target), post)
    return t.spark.read.schema("o_orderstatus string, orders_n bigint, total double").parquet(f"{root}/audit")


@query("sink_non_conflict", "SELECT p_partkey, p_retailprice, TRUE AS second_refused FROM part")
def sink_non_conflict(t):
    path, rows = scratch_path(t.spark, "once"), t.part.select("p_partkey", "p_retailprice")
    write_files(rows, path, "part", "orc", mode="nonConflict")
    try:
        write_files(rows, path, "part", "orc", mode="nonConflict")
        refused = False
    except AnalysisException:
        refused = True
    return t.spark.read.orc(f"{path}/part").withColumn("second_refused", F.lit(refused))


@query("sink_append", """SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderdate < TIMESTAMP '1997-01-01 00:00:00'
UNION ALL SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderdate >= TIMESTAMP '1996-01-01 00:00:00'""")
def sink_append(t):
    path = scratch_path(t.spark, "append")
    for where in ("o_orderdate < TIMESTAMP_NTZ '1997-01-01 00:00:00'", "o_orderdate >= TIMESTAMP_NTZ '1996-01-01 00:00:00'"):
        write_files(t.orders.where(where).select("o_orderkey", "o_totalprice"), path, "orders", "orc", mode="append")
    return t.spark.read.orc(f"{path}/orders")


@query("sink_partition_dir", "SELECT event_id, value, strftime(ts, '%Y-%m-%d') AS p_day FROM events")
def sink_partition_dir(t):
    rows = t.events.select("event_id", "value", F.date_format("ts", "yyyy-MM-dd").alias("p_day"))
    path = scratch_path(t.spark, "by-day")
    write_partition_dir(rows, path, "p_day")
    write_partition_dir(rows.where("p_day >= '2024-01-20'"), path, "p_day")  # a rerun replaces its own days only
    return t.spark.read.schema("event_id bigint, value double, p_day string").parquet(path)


_CELLS = """SELECT 'k-' || CAST(o_orderkey AS VARCHAR) AS rowkey, 'cf' AS family, q.qualifier, CAST(7 AS BIGINT) AS ver,
  CASE q.qualifier WHEN 'status' THEN o_orderstatus WHEN 'cust' THEN CAST(o_custkey AS VARCHAR) ELSE CASE WHEN o_orderpriority <> '5-LOW' THEN o_orderpriority END END AS value
FROM orders, (VALUES ('status'), ('cust'), ('priority')) q(qualifier)"""


def _order_cells(t, null_mode):
    rows = t.orders.select(
        "o_orderkey", "o_custkey", "o_orderstatus", F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_orderpriority")).alias("priority")
    )
    columns = [(2, "cf:cust"), (3, "cf:status"), (4, "cf:priority")]
    return cell_sink.rows_to_cells(rows, '[{"value": "k-"}, {"index": 0}]', columns, 7, null_mode)


@query("sink_cells", f"SELECT * FROM ({_CELLS}) WHERE value IS NOT NULL")
def sink_cells(t):
    path = scratch_path(t.spark, "cells")
    made = _order_cells(t, "skip")
    made.write.parquet(path)
    return t.spark.read.schema(made.schema).parquet(path)


@query("sink_cells_null_mode", f"SELECT rowkey, family, qualifier, ver, coalesce(value, '') AS value FROM ({_CELLS})")
def sink_cells_null_mode(t):
    return _order_cells(t, "empty")


@query("sink_upsert", """
WITH batch AS (SELECT o_orderkey, o_orderstatus, o_totalprice + 1 AS o_totalprice FROM orders WHERE o_orderdate >= TIMESTAMP '1997-01-01 00:00:00')
SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderdate < TIMESTAMP '1998-01-01 00:00:00' AND o_orderkey NOT IN (SELECT o_orderkey FROM batch)
UNION ALL SELECT * FROM batch""")
def sink_upsert(t):
    columns = ["o_orderkey", "o_orderstatus", "o_totalprice"]
    target = t.orders.where("o_orderdate < TIMESTAMP_NTZ '1998-01-01 00:00:00'").select(columns)
    fresh = t.orders.where("o_orderdate >= TIMESTAMP_NTZ '1997-01-01 00:00:00'").select(columns)
    batch = fresh.unionByName(fresh.withColumn("o_totalprice", F.col("o_totalprice") + 1))  # each key twice, the dearer one counts
    return upsert(target, batch, ["o_orderkey"], [F.col("o_totalprice").desc()])


@query("sink_console_or_noop", """SELECT count(*) AS rows_read, count(*) FILTER (l_returnflag = 'A') AS returned, CAST(sum(l_orderkey) AS BIGINT) AS key_sum FROM lineitem""")
def sink_console_or_noop(t):
    """What the discarding sink saw go by."""
    seen = write_nowhere(t.lineitem, returned=F.count_if(F.col("l_returnflag") == "A"), key_sum=F.sum("l_orderkey"))
    return t.spark.createDataFrame([(seen["rows"], seen["returned"], seen["key_sum"])], "rows_read bigint, returned bigint, key_sum bigint")


@query("map_columns", "SELECT o_orderkey AS id, o_orderstatus AS state, o_totalprice AS amount FROM orders")
def map_columns(t):
    return mapping.map_columns(t.orders, ["o_orderkey", "o_orderstatus", "o_totalprice"], ["id", "state", "amount"])


@query("filter_where", "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_returnflag = 'A' AND l_quantity < 24")
def filter_where(t):
    return mapping.filter_where(t.lineitem, "l_returnflag = 'A' AND l_quantity < 24").select("l_orderkey", "l_linenumber", "l_quantity")


@query("cast_declared", f"""SELECT event_id AS f_id, ts AS f_ts, CASE WHEN event_id % 9 <> 0 THEN value END AS f_value,
  CASE event_type WHEN 'error' THEN NULL WHEN 'click' THEN TRUE ELSE FALSE END AS f_flag, event_type AS f_type,
  CASE WHEN {_DIRTY} THEN concat_ws('; ', CASE WHEN event_id % 9 = 0 THEN 'f_value is not double' END,
                                           CASE WHEN event_type = 'error' THEN 'f_flag is not bool' END) END AS dirty_reason FROM events""")
def cast_declared(t):
    return mapping.flag_dirty(t.raw_events, _RAW_TYPES).drop("dirty_record")


@query("constant_column", "SELECT c_custkey, '2018-05-14' AS p_data_day, CAST(42 AS BIGINT) AS batch FROM customer")
def constant_column(t):
    day = mapping.substitute_params("${p_data_day}", mapping.parse_definitions("-Dp_data_day=2018-05-14"))
    rows = mapping.constant_column(t.customer.select("c_custkey"), "p_data_day", day)
    return mapping.constant_column(rows, "batch", "42", "long")


@query("substitute_params", """SELECT o_orderkey, o_orderdate FROM orders
WHERE o_orderdate >= TIMESTAMP '1996-03-01 00:00:00' AND o_orderdate < TIMESTAMP '1998-06-01 00:00:00'""")
def substitute_params(t):
    params = mapping.parse_definitions("-DlastTime=1996-03-01 -DcurrentTime=1998-06-01")
    sql = mapping.bind_params("""SELECT o_orderkey, o_orderdate FROM {orders}
        WHERE o_orderdate >= CAST(${lastTime} AS TIMESTAMP_NTZ) AND o_orderdate < CAST(${currentTime} AS TIMESTAMP_NTZ)""")
    return run_query(t.spark, sql, {"orders": t.orders}, params)


@query("error_limit", f"""SELECT count(*) AS read_count, count(*) FILTER (NOT ({_DIRTY})) AS good_count, count(*) FILTER ({_DIRTY}) AS dirty_count FROM events""")
def error_limit(t):
    return mapping.quality_counts(mapping.flag_dirty(t.raw_events, _RAW_TYPES))


@query("split_dirty_good", f"SELECT event_id AS f_id, value AS f_value FROM events WHERE NOT ({_DIRTY})")
def split_dirty_good(t):
    good, _ = mapping.split_dirty(mapping.flag_dirty(t.raw_events, _RAW_TYPES))
    return good.select("f_id", "f_value")


@query("split_dirty", f"""SELECT CAST(event_id AS VARCHAR) AS f_id, concat_ws('; ', CASE WHEN event_id % 9 = 0 THEN 'f_value is not double' END,
  CASE WHEN event_type = 'error' THEN 'f_flag is not bool' END) AS dirty_reason FROM events WHERE {_DIRTY}""")
def split_dirty(t):
    _, rejects = mapping.split_dirty(mapping.flag_dirty(t.raw_events, _RAW_TYPES))
    return rejects.select(F.get_json_object("dirty_record", "$.f_id").alias("f_id"), "dirty_reason")


def _copy_spec(t, folder, table, target, **more):
    columns = getattr(t, table).columns
    return SyncSpec(lambda spark: getattr(t, table), f"{folder}/{target}", columns, columns, **more)


@query("batch_sync", """SELECT 'ods_orders' AS target, count(*) AS row_count FROM orders UNION ALL SELECT 'ods_customer', count(*) FROM customer
UNION ALL SELECT 'ods_part', count(*) FROM part""")
def batch_sync_query(t):
    folder = scratch_path(t.spark, "batch-sync")
    names = ["orders", "customer", "part"]
    targets = [f"ods_{n}" for n in names]
    batch_sync(t.spark, names, targets, lambda source, target: _copy_spec(t, folder, source, target))
    counts = [
        target_rows(t.spark, _copy_spec(t, folder, n, g)).agg(F.lit(g).alias("target"), F.count(F.lit(1)).alias("row_count"))
        for n, g in zip(names, targets)
    ]
    return counts[0].unionAll(counts[1]).unionAll(counts[2])


@query("batch_sync_results", f"""SELECT 'ods_orders' AS target, count(*) AS read_count, count(*) AS write_count, CAST(NULL AS VARCHAR) AS failed FROM orders
UNION ALL SELECT 'ods_events', 0, 0, 'ErrorLimitExceeded' FROM events WHERE {_DIRTY} HAVING count(*) > 0
UNION ALL SELECT 'ods_customer', count(*), count(*), NULL FROM customer""")
def batch_sync_results(t):
    """A batch of three tables; the one with dirty rows is refused, the others are written."""
    folder = scratch_path(t.spark, "batch-results")

    def make(source, target):
        types = dict(_RAW_TYPES) if source == "raw_events" else {}
        return _copy_spec(t, folder, source, target, types=types)

    done = batch_sync(t.spark, ["orders", "raw_events", "customer"], ["ods_orders", "ods_events", "ods_customer"], make)
    counted = [(r.target.rsplit("/", 1)[-1], r.read_count, r.write_count, r.error and r.error.split(":")[0]) for r in done]
    return t.spark.createDataFrame(counted, "target string, read_count bigint, write_count bigint, failed string")


@query("sync_counters", f"""SELECT 'events' AS target, count(*) AS read_count, count(*) FILTER (NOT ({_DIRTY})) AS write_count,
  count(*) FILTER ({_DIRTY}) AS fail_count FROM events""")
def sync_counters_query(t):
    columns = t.raw_events.columns
    spec = SyncSpec(
        lambda spark: t.raw_events, f"{scratch_path(t.spark, 'counted')}/events", columns, columns, types=dict(_RAW_TYPES),
        max_dirty_records=None, max_dirty_ratio=0.5,
    )
    return sync_counters(t.spark, [run_sync(t.spark, spec)]).select("target", "read_count", "write_count", "fail_count")


@query("shard_slice", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey % 5 = 3")
def shard_slice(t):
    return mapping.shard_slice(t.orders.select("o_orderkey", "o_totalprice"), "o_orderkey", 3, 5)


@query("shard_slice_hashed", "SELECT c_name FROM customer")
def shard_slice_hashed(t):
    shards = [mapping.shard_slice(t.customer.select("c_name"), "c_name", i, 3) for i in range(3)]
    return shards[0].unionAll(shards[1]).unionAll(shards[2])


_SYNCED = f"SELECT event_id AS id, event_type AS kind, value AS amount FROM events WHERE NOT ({_DIRTY})"


def _sync_into(t, sink, **options):
    """The raw events through mapping, gate and one of the sinks; returns the folder written."""
    path = scratch_path(t.spark, f"sync-{sink}")
    spec = SyncSpec(
        lambda spark: t.raw_events, scratch_path(t.spark, "checked"), ["f_id", "f_type", "f_value", "f_flag"], ["id", "kind", "amount", "flag"],
        types={"id": "long", "amount": "double", "flag": "bool"}, sink=sink, sink_options={"path": path} | options, max_dirty_records=None, max_dirty_ratio=0.9,
    )
    run_sync(t.spark, spec)
    return path


_EVENT_FIELDS = [{"index": 0, "type": "long", "name": "id"}, {"index": 1, "type": "string", "name": "kind"}, {"index": 2, "type": "double", "name": "amount"}]


@query("sync_text", _SYNCED)
def sync_text(t):
    path = _sync_into(t, "text", file_name="events", sep="\u0001")
    return read_delimited(t.spark, f"{path}/events", _EVENT_FIELDS, sep="\u0001")


@query("sync_orc", _SYNCED)
def sync_orc(t):
    return t.spark.read.orc(f"{_sync_into(t, 'orc', file_name='events')}/events").select("id", "kind", "amount")


@query("sync_partition", _SYNCED)
def sync_partition(t):
    return t.spark.read.schema("id bigint, amount double, kind string").parquet(_sync_into(t, "partition", fields=["kind"])).select("id", "kind", "amount")


@query("sync_documents", _SYNCED)
def sync_documents(t):
    return t.spark.read.schema("id bigint, kind string, amount double").json(_sync_into(t, "documents"))


@query("sync_cells", f"""SELECT CAST(id AS VARCHAR) AS rowkey, 'cf' AS family, q.qualifier, CAST(1 AS BIGINT) AS ver, CASE q.qualifier WHEN 'kind' THEN kind ELSE CAST(flag AS VARCHAR) END AS value
FROM (SELECT event_id AS id, event_type AS kind, event_type = 'click' AS flag FROM events WHERE NOT ({_DIRTY})), (VALUES ('kind'), ('flag')) q(qualifier)""")
def sync_cells(t):
    path = _sync_into(t, "cells", layout='[{"index": 0}]', columns=[(2, "cf:kind"), (4, "cf:flag")])
    return t.spark.read.schema("rowkey string, ver bigint, family string, qualifier string, value string").parquet(path)
