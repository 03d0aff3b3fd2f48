"""Line numbers over log files that are read in blocks."""

import os

import pytest

from tablesync.session import scratch_path
from tablesync.sources.logs import log_lines, write_log_files


@pytest.fixture
def blocks(spark):
    """Reads files in blocks of 300 bytes."""
    for key, value in (("spark.sql.files.maxPartitionBytes", "300"), ("spark.sql.files.openCostInBytes", "50"), ("spark.sql.adaptive.coalescePartitions.enabled", "false")):
        spark.conf.set(key, value)
    yield
    for key in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes", "spark.sql.adaptive.coalescePartitions.enabled"):
        spark.conf.unset(key)


def _folder(spark, files):
    root = scratch_path(spark, "logs").removeprefix("file:")
    for name, text in files.items():
        os.makedirs(os.path.dirname(f"{root}/{name}"), exist_ok=True)
        with open(f"{root}/{name}", "w", newline="") as f:
            f.write(text)
    return root


def test_a_file_of_many_blocks(spark, blocks):
    logs = {7: [f"line {i} " + "x" * (i * 37 % 90) for i in range(400)], 8: ["one"], 9: [], 11: ["", "", "after two empty lines", ""]}
    root = _folder(spark, {f"2024-01-0{1 + k % 3}/{k}.log": "".join(line + "\n" for line in lines) for k, lines in logs.items()} | {"2024-01-01/notes.txt": "no log\n"})
    frame = log_lines(spark, root)
    assert spark.read.option("recursiveFileLookup", "true").text(root).rdd.getNumPartitions() > 20
    got = {}
    for r in frame.collect():
        got.setdefault(r.log_id, {})[r.line_no] = r.line
    assert got == {k: dict(enumerate(lines, 1)) for k, lines in logs.items() if lines}


def test_line_ends_and_a_missing_last_one(spark, blocks):
    root = _folder(spark, {"5.log": "a\r\nb\rc\n" + "long " * 200 + "\nlast"})
    assert [(r.line_no, r.line[:4]) for r in log_lines(spark, root).orderBy("line_no").collect()] == [(1, "a"), (2, "b"), (3, "c"), (4, "long"), (5, "last")]


def test_a_log_in_several_files(spark, blocks, rows):
    lines = spark.range(3000).selectExpr("IF(id % 3 = 0, id % 5, 99) AS log_id", "id * 7 AS line_no", "concat('line ', id) AS line").repartition(5)
    root = write_log_files(lines, scratch_path(spark, "logs"))
    assert len([f for f in spark.read.option("recursiveFileLookup", "true").text(root).inputFiles() if "log_id=99/" in f]) > 1
    want = {}
    for r in lines.orderBy("line_no").collect():
        want.setdefault(r.log_id, []).append(r.line)
    assert rows(log_lines(spark, root)) == sorted(((k, i, line) for k, v in want.items() for i, line in enumerate(v, 1)), key=repr)


def test_small_logs_share_files(spark, rows):
    """Files follow the bytes, not the number of logs."""
    texts = "CASE id % 5 WHEN 0 THEN '' WHEN 1 THEN NULL WHEN 2 THEN concat(id, '\\t', id) WHEN 3 THEN '\\tx' ELSE concat('9\\t', id) END"
    lines = spark.range(2000).selectExpr("IF(id % 500 = 499, NULL, id % 500 - 20) AS log_id", "2000 - id AS line_no", f"{texts} AS line").repartition(5)
    root = write_log_files(lines, scratch_path(spark, "logs"))
    assert len(spark.read.option("recursiveFileLookup", "true").text(root).inputFiles()) <= 4
    want = {}
    for r in lines.orderBy("line_no").collect():
        want.setdefault(r.log_id, []).append(r.line or "")
    assert len(want.pop(None)) == 4  # lines of no log have no number
    assert rows(log_lines(spark, root)) == sorted(((k, i, line) for k, v in want.items() for i, line in enumerate(v, 1)), key=repr)


def test_large_and_small_logs_in_many_blocks(spark, blocks, rows):
    """A log of more than a block has its own files; a small one may still lie across two blocks."""
    lines = spark.range(1000).selectExpr("CASE WHEN id % 2 = 0 THEN -7 ELSE id % 100 END AS log_id", "id AS line_no", "concat('line ', id) AS line").repartition(5)
    root = write_log_files(lines, scratch_path(spark, "logs"))
    folders = {f.rsplit("/", 2)[1] for f in spark.read.option("recursiveFileLookup", "true").text(root).inputFiles()}
    assert folders == {"log_id=-7", "log_id=shared"}
    want = {}
    for r in lines.orderBy("line_no").collect():
        want.setdefault(r.log_id, []).append(r.line)
    assert rows(log_lines(spark, root)) == sorted(((k, i, line) for k, v in want.items() for i, line in enumerate(v, 1)), key=repr)


def test_small_logs_are_dealt_without_a_sample(spark, blocks, rows, monkeypatch):
    """Lines of no log are many here, and go to many tasks all the same."""
    lines = spark.range(2000).selectExpr("IF(id % 2 = 0, NULL, id % 400) AS log_id", "2000 - id AS line_no", "'x' AS line").repartition(5)

    def sampled(*_):
        raise AssertionError("the lines are sampled")

    monkeypatch.setattr(type(lines), "repartitionByRange", sampled)
    root = write_log_files(lines, scratch_path(spark, "logs"))
    of_none = spark.read.option("recursiveFileLookup", "true").text(root).where("startswith(value, '\t')")
    assert of_none.count() == 1000 and of_none.select("_metadata.file_path").distinct().count() > 1
    assert rows(log_lines(spark, root)) == sorted(((k, i, "x") for k in range(1, 400, 2) for i in range(1, 6)), key=repr)


def test_lines_meet_their_block_unsorted(spark):
    root = write_log_files(spark.range(100).selectExpr("id % 2 AS log_id", "id AS line_no", "'x' AS line"), scratch_path(spark, "logs"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = log_lines(spark, root)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "ShuffledHashJoin" in plan and "SortMergeJoin" not in plan


def test_a_text_no_line_can_carry(spark):
    lines = spark.createDataFrame([(1, 1, "a\nb")], "log_id long, line_no long, line string")
    with pytest.raises(Exception, match="can't carry"):
        write_log_files(lines, scratch_path(spark, "logs"))


def test_the_text_is_read_once_and_only_blocks_are_ordered(spark):
    root = write_log_files(spark.range(100).selectExpr("id % 2 AS log_id", "id AS line_no", "'x' AS line"), scratch_path(spark, "logs"))
    plan = log_lines(spark, root)._jdf.queryExecution().executedPlan().toString()
    assert "FileScan text" not in plan and plan.index("Window") < plan.index("HashAggregate")
