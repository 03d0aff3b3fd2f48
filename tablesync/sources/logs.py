"""Run-log files as rows (log_id, line_no, line), with line numbers over splittable text.

A log may be one file or several that follow each other by name, each read in many blocks by as many tasks. A task sees the lines
of a block in order, so a line's number is its place in the block plus the lines of all earlier blocks of its log.

Most logs are small, and a file for each costs more than its text. Written logs that don't fill a read block share files, in
which each line starts with its log's id; the number of files follows the bytes, not the number of logs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tablesync.session import materialise

LOG_FILE = r"((?:(?<==)-)?\d+)(?:\.log|/part-[^/]*)$"
"""What names a log in a file's path: ``2024-01-05/17.log``, or ``log_id=17/part-00000.txt`` as ``write_log_files`` has it."""
SHARED_FILE = "/log_id=shared/part-"
"""Files of ``write_log_files`` that hold several logs, one after the other, as lines ``log_id<tab>line``."""


def log_lines(spark: SparkSession, path: str, name: str = LOG_FILE) -> DataFrame:
    """``(log_id, line_no, line)`` of every log file below ``path``, numbered from 1; files of other names are left out.

    The text is read once, into a table that keeps each line's place, so numbers never depend on how a second read
    would be split. Only one row per block is ordered, and lines meet their block by hash, unsorted.
    """
    text = spark.read.option("recursiveFileLookup", "true").text(path)
    file, value = F.col("_metadata.file_path"), F.col("value")
    shared = F.contains(file, F.lit(SHARED_FILE))
    log_id = F.when(shared, F.substring_index(value, "\t", 1)).otherwise(F.regexp_extract(file, name, 1))
    lines = text.select(
        F.nullif(log_id, F.lit("")).cast("long").alias("log_id"), file.alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("at"), F.when(shared, F.substring(value, F.instr(value, "\t") + 1, F.lit(2**31 - 1))).otherwise(value).alias("line"),
    ).where("log_id IS NOT NULL")
    lines = materialise(lines, "log-lines")
    key = ["log_id", "file", "block"]
    earlier = Window.partitionBy("log_id").orderBy("file", "block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = lines.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("first"))
    blocks = blocks.select(*key, (F.coalesce(F.sum("n").over(earlier), F.lit(0)) - F.col("first") + 1).alias("shift"))
    return lines.join(blocks.hint("shuffle_hash"), key).select("log_id", (F.col("at") + F.col("shift")).alias("line_no"), "line")


def write_log_files(lines: DataFrame, path: str) -> str:
    """Write ``(log_id, line_no, line)`` as text below ``path``; lines of one log may fill several files, in order.

    A log of more bytes than a read block (``spark.sql.files.maxPartitionBytes``) has the folder ``log_id=n``, the others share files in
    ``log_id=shared``. Ranges of (log, line) are dealt to tasks, so a log that holds most of the lines is written by many of them;
    if all logs are small, whole logs are dealt by hash, which needs no sample of the lines first.
    """
    spark = lines.sparkSession
    block = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get("spark.sql.files.maxPartitionBytes"))
    sizes = lines.groupBy("log_id").agg(F.sum(F.coalesce(F.octet_length("line"), F.lit(0)) + 1).alias("bytes"))
    large = materialise(sizes.where((F.col("bytes") > block) & F.col("log_id").isNotNull()).select("log_id", F.col("log_id").cast("string").alias("folder")), "large-logs")
    broken = F.col("line").contains("\n") | F.col("line").contains("\r")
    line = F.when(broken, F.raise_error(F.concat(F.lit("a log line can't carry this text: "), "line"))).otherwise(F.coalesce("line", F.lit("")))
    placed = lines.select("log_id", "line_no", line.alias("line")).join(large, "log_id", "left").withColumn("folder", F.coalesce("folder", F.lit("shared")))
    order = ["folder", "log_id", "line_no"]
    # lines of no log have no order, and can be many
    dealt = placed.repartition("log_id", F.when(F.col("log_id").isNull(), F.col("line_no"))) if large.isEmpty() else placed.repartitionByRange(*order)
    dealt = dealt.sortWithinPartitions(*order)
    named = F.concat_ws("\t", F.coalesce(F.col("log_id").cast("string"), F.lit("")), "line")
    text = dealt.select(F.col("folder").alias("log_id"), F.when(F.col("folder") == "shared", named).otherwise(F.col("line")).alias("line"))
    text.write.mode("append").partitionBy("log_id").text(path)
    return path
