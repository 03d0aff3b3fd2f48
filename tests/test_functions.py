"""Credentials, URLs, and log mining against known values."""

import json

import pytest
from pyspark.sql import functions as F

from tablesync.functions import credentials, sources
from tablesync.operators import logmine, profile
from tablesync.queries import QUERIES

# A stored value: the text "root" under this seed.
SEED, ROOT = "AD42F6697B035B75", "yRjwDFuoPKlqya9h9H2Amg=="


def test_known_cipher_text(spark):
    row = spark.createDataFrame([("root",)], "v string").select(
        credentials.encrypt(F.col("v"), SEED).alias("e"), credentials.decrypt(F.lit(ROOT), SEED).alias("d"),
        credentials.decrypt(F.col("v"), SEED).alias("n"), credentials.ensure_encrypted(F.lit(ROOT), SEED).alias("s"),
        credentials.ensure_encrypted(F.col("v"), SEED).alias("t"),
    ).collect()[0]
    assert (row.e, row.d, row.n, row.s, row.t) == (ROOT, "root", None, ROOT, ROOT)


def test_job_credentials_change_and_nothing_else(spark):
    side = {"name": "r", "parameter": {"username": "root", "password": "root", "column": ["a"], "where": "", "n": 1.5, "username2": "root"}}
    job = {"job": {"setting": {"errorLimit": {"percentage": 0.02}}, "content": [{"reader": side, "writer": side}, {"reader": side, "writer": side}]}, "x": None}
    df = spark.createDataFrame([(json.dumps(job),)], "j string")
    masked = json.loads(df.select(credentials.encrypt_job(F.col("j"), SEED)).collect()[0][0])
    for entry in masked["job"]["content"]:
        for block in entry.values():
            assert block["parameter"] == side["parameter"] | {"username": ROOT, "password": ROOT}
    again = df.select(credentials.decrypt_job(credentials.encrypt_job(F.col("j"), SEED), SEED)).collect()[0][0]
    assert json.loads(again) == job
    plain = df.select(credentials.decrypt_job(F.col("j"), SEED)).collect()[0][0]
    assert json.loads(plain) == job  # what cannot be decrypted stays


def test_jobs_of_one_file_are_masked_by_many_tasks(spark, tmp_path):
    segments = spark.range(200).selectExpr("IF(id < 20, id, NULL) AS c_custkey", "IF(id % 9 = 0, NULL, concat('S', id)) AS c_mktsegment")
    segments.unionAll(segments.where("c_custkey < 5")).coalesce(1).write.parquet(f"{tmp_path}/customer.parquet")
    found = QUERIES["fn_mask_json_credentials"](spark, str(tmp_path))
    tasks = found.groupBy(F.spark_partition_id().alias("task")).count().collect()
    assert len(tasks) > 1 and sum(r["count"] for r in tasks) == 205
    known = found.where("username IS NOT NULL").collect()
    assert sorted((r.id, r.username, r.password, r.second_column, r.channel, r.hidden) for r in known) == sorted(
        (k, f"u{k % 7}", "q", f"s{k}", 3, True) for k in range(20) if k % 9 for _ in range(1 + (k < 5)))


def test_url_types_and_hosts(spark):
    urls = {
        "jdbc:mysql://DB1:3306/x?a=b//c": ("mysql", "db1:3306/x"), "jdbc:oracle:thin:@Host:1521:orcl": ("oracle", "host:1521:orcl"),
        "jdbc:log4jdbc:unknown://h": ("log4jdbc", "h"), "jdbc:hive2://h:1/d": ("hive", "h:1/d"), "mongodb://u@H/d": (None, "h/d"), "plain": (None, "plain"),
    }
    df = spark.createDataFrame([(u,) for u in urls], "u string").select("u", sources.database_type(F.col("u")).alias("t"), sources.jdbc_host(F.col("u")).alias("h"))
    assert {r.u: (r.t, r.h) for r in df.collect()} == urls


STATS = """2015-12-17 11:20:25.263 [job-0] INFO  JobContainer -
任务启动时刻                    : 2015-12-17 11:20:15
任务结束时刻                    : 2015-12-17 11:20:25
任务总计耗时                    :                 10s
任务平均流量                    :              205B/s
记录写入速度                    :              5rec/s
读出记录总数                    :                  50
读写失败总数                    :                   0""".splitlines()


def test_sample_run_statistics(spark):
    lines = spark.createDataFrame([(1, i, line) for i, line in enumerate(STATS, 1)] + [(1, 20, "读出记录总数 51"), (2, 1, "nothing")], "log_id int, line_no int, line string")
    stats = logmine.parse_run_stats(lines.where("line_no < 20"))
    row = stats.collect()[0]
    assert tuple(row) == (1, "2015-12-17 11:20:15", "2015-12-17 11:20:25", "10s", "205B/s", "5rec/s", 50, 0)
    assert tuple(logmine.parse_units(stats).collect()[0]) == (1, 10.0, 205.0, 5.0)
    assert logmine.parse_run_stats(lines).collect()[0].read_count is None  # the last match has no colon: the whole line, not a number


def test_task_spans_take_the_last_begin(spark):
    text = [
        "2024-01-01 00:00:00.1 [0-0-1-reader] INFO CommonRdbmsReader$Task - Begin to read record by Sql: [select 1 from T_a",
        "] jdbcUrl:[jdbc:mysql://DB:1/x?y=z].",
        "2024-01-01 00:00:09.1 [0-0-1-reader] INFO CommonRdbmsReader$Task - Finished read record by Sql: [select 1 from T_a",
        "2024-01-01 00:01:00.1 [0-0-1-reader] INFO CommonRdbmsReader$Task - Begin to read record by Sql: [select 1 from T_b where x] jdbcUrl: [jdbc:mysql://own:1/x]",
        "other",
        "2024-01-01 00:02:00.1 [0-0-2-reader] INFO CommonRdbmsReader$Task - Finished read record by Sql: []",
        "2024-01-01 00:00:00.1 [0-0-3-reader] INFO CommonRdbmsReader$Task - BEGIN  to read record by sql: [select 1 FROM t_c",
        "2024-01-01 00:00:30.1 [0-0-3-reader] INFO CommonRdbmsReader$Task - finished read record by sql:",
        "garbled           [0-0-4-writer] begin to commit blocks",
        "1970-01-01 00:00:05 [0-0-4-writer] commit blocks ok",
    ]
    lines = spark.createDataFrame([(1, i, line) for i, line in enumerate(text, 1)], "log_id int, line_no int, line string")
    spans = logmine.read_task_spans(lines, "2024-01-01 00:10:00")
    got = {r.task: (r.stat, r.done - r.wake, r.host, r.path) for r in spans.collect()}
    assert got == {"0-0-1-reader": ("R", 540, "own:1/x", "t_b"), "0-0-3-reader": ("D", 30, "", "t_c")}
    assert [tuple(r)[2:] for r in logmine.write_task_spans(lines, "2024-01-01 00:10:00").collect()] == [("D", 0, 5)]
    summary = logmine.profile_summary(spans).collect()[0]
    assert (summary.tasks, summary.servers, summary.total_s, summary.wall_s) == (2, 2, 570, 600)
    assert round(summary.max_tilt, 4) == round(540 / 285, 4)


def test_profile_exact_and_sketched(tables):
    exact = {r.name: r for r in profile.profile_table(tables.orders).collect()}
    rough = {r.name: r for r in profile.profile_table(tables.orders, exact_distinct=False).collect()}
    assert exact["o_orderkey"].distinct_count == tables.orders.count()
    assert abs(rough["o_orderkey"].distinct_count / exact["o_orderkey"].distinct_count - 1) < 0.2
    assert {n: r.max_value for n, r in exact.items()} == {n: r.max_value for n, r in rough.items()}


def test_candidate_keys_with_nulls(spark):
    df = spark.createDataFrame([(1, 1, None), (2, 1, 3), (3, 2, 4)], "a int, b int, c int")
    got = {r.columns: r.is_key for r in profile.candidate_keys(df, pairs=True).collect()}
    assert got == {"a": True, "b": False, "c": False, "a,b": True, "a,c": False, "b,c": False}


def test_nested_document_schema(spark):
    docs = ['{"a":{"b":[{"c":1},{"c":"x"},[2]],"d.e":null},"f":true}', '{"a":7,"f":{"g":{"h":{"i":2.5}}}}', "{", None, "[1,{\"z\":0}]", "3"]
    frame = spark.createDataFrame([(d,) for d in docs], "doc string")
    got = {(r.path, r.type): r["count"] for r in profile.infer_document_schema_nested(frame, "doc").collect()}
    assert got == {
        (None, "invalid"): 1, ("a", "object"): 1, ("a", "long"): 1, ("f", "bool"): 1, ("f", "object"): 1, ("a.b", "array"): 1, ('a."d.e"', "null"): 1,
        ("a.b[]", "object"): 2, ("a.b[]", "array"): 1, ("a.b[].c", "long"): 1, ("a.b[].c", "string"): 1, ("a.b[][]", "long"): 1,
        ("f.g", "object"): 1, ("f.g.h", "object"): 1, ("f.g.h.i", "double"): 1, ("[]", "long"): 1, ("[]", "object"): 1, ("[].z", "long"): 1,
    }
    assert "f" in profile.merged_document_schema(frame.limit(2), "doc").first().schema


def test_keys_are_searched_by_sketches_first(spark, monkeypatch):
    frame = spark.range(5000).selectExpr("id AS a", "id % 7 AS b", "id div 7 AS c", "IF(id = 9, NULL, id) AS d", "IF(id = 4999, 0, id) AS e", "'x' AS f")
    grouped = []
    monkeypatch.setattr(type(frame), "groupBy", lambda self, *c, plain=type(frame).groupBy: grouped.append(c) or plain(self, *c))
    got = {r.columns: r.is_key for r in profile.candidate_keys(frame, pairs=True).collect()}
    want = {c: len({tuple(r) for r in frame.select(*c.split(",")).collect()}) == 5000 and not frame.where(" OR ".join(f"{x} IS NULL" for x in c.split(","))).count() for c in got}
    assert got == want and got["a"] and got["b,c"] and got["a,f"] and not got["e"] and not got["a,d"]
    assert len(grouped) < len(got) / 2


def test_profiles_of_files_merge_and_only_new_files_are_read(spark, tables, rows):
    from tablesync.session import scratch_path

    path, store = scratch_path(spark, "files"), scratch_path(spark, "store")
    whole = tables.orders.withColumn("o_orderpriority", F.when(F.col("o_orderkey") % 9 > 0, F.col("o_orderpriority")))
    whole.where("o_orderkey % 2 = 0").write.parquet(path)
    profile.profile_files(spark, path, store)
    first = spark.read.parquet(store).count()
    whole.where("o_orderkey % 2 = 1").write.mode("append").parquet(path)
    merged = profile.profile_files(spark, path, store)
    files = spark.read.parquet(store)
    assert first < files.count() == files.select("file").distinct().count() == len(spark.read.parquet(path).inputFiles())
    exact = {r.name: r for r in profile.profile_table(whole).collect()}
    for r in merged.collect():
        e = exact[r.name]
        assert (r.row_count, r.null_count, r.min_value, r.max_value) == (e.row_count, e.null_count, e.min_value, e.max_value)
        assert abs(r.distinct_count - e.distinct_count) <= 0.05 * e.distinct_count
    before = set(spark.read.parquet(store).inputFiles())
    assert rows(profile.profile_files(spark, path, store)) == rows(merged) and set(spark.read.parquet(store).inputFiles()) == before
    rest = scratch_path(spark, "rest")
    whole.limit(0).write.parquet(rest)
    assert profile.profile_files(spark, rest, scratch_path(spark, "store")).first().row_count == 0
