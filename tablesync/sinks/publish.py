"""Directories of a table: each run writes a new one, and a marker makes it count.

Readers follow marked directories only, so a failed or refused run leaves the table as it was.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Markers: the directory is the whole table, is added to it, or has been merged into a table elsewhere.
FULL, PART, MERGED = "_FULL", "_PART", "_MERGED"


def _filesystem(spark: SparkSession, path: str):
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()), hadoop_path


def path_exists(spark: SparkSession, path: str) -> bool:
    fs, p = _filesystem(spark, path)
    return fs.exists(p)


def total_bytes(spark: SparkSession, path: str) -> int:
    """Size of the files below ``path``."""
    fs, p = _filesystem(spark, path)
    return int(fs.getContentSummary(p).getLength())


def remove(spark: SparkSession, path: str) -> None:
    fs, p = _filesystem(spark, path)
    fs.delete(p, True)


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file, there as a whole or not at all."""
    fs, p = _filesystem(spark, f"{path}.tmp")
    stream = fs.create(p, True)
    stream.write(bytearray(text.encode()))
    stream.close()
    if not fs.rename(p, spark._jvm.org.apache.hadoop.fs.Path(path)):
        raise FileExistsError(path)


def read_text(spark: SparkSession, path: str) -> str | None:
    fs, p = _filesystem(spark, path)
    if not fs.exists(p):
        return None
    stream = fs.open(p)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def versions(spark: SparkSession, root: str) -> list[int]:
    """Numbers of the directories below ``root``, marked or not."""
    fs, p = _filesystem(spark, root)
    if not fs.exists(p):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(p)]
    return sorted(int(n[2:]) for n in names if n.startswith("v=") and n[2:].isdigit())


def version_path(root: str, version: int) -> str:
    return f"{root}/v={version:08d}"


def next_version(spark: SparkSession, root: str) -> int:
    """The next number. Writing is an error where the directory exists, so of two runs that ask at once one fails."""
    return max(versions(spark, root), default=0) + 1


def marker(spark: SparkSession, root: str, version: int) -> str | None:
    """Kind of a marked directory."""
    base = version_path(root, version)
    return next((kind for kind in (FULL, PART, MERGED) if path_exists(spark, f"{base}/{kind}")), None)


def mark(spark: SparkSession, root: str, version: int, kind: str = FULL, note: str = "") -> None:
    """Make a written directory count. ``note`` is text that belongs to it."""
    write_text(spark, f"{version_path(root, version)}/{kind}", note)


def newest_note(spark: SparkSession, root: str) -> str | None:
    """Note of the newest marked directory that has one."""
    for version in reversed(versions(spark, root)):
        kind = marker(spark, root, version)
        note = kind and read_text(spark, f"{version_path(root, version)}/{kind}")
        if note:
            return note
    return None


def current_parts(spark: SparkSession, root: str) -> list[str]:
    """Directories that make up the table now: the newest whole one, and those added after it."""
    parts: list[str] = []
    for version in reversed(versions(spark, root)):
        kind = marker(spark, root, version)
        if kind in (FULL, PART):
            parts.append(version_path(root, version))
        if kind == FULL:
            break
    return parts[::-1]


def good_rows(df: DataFrame) -> DataFrame:
    """Rows of a written directory without the rejected ones, which stay in the same files with their reason."""
    if "dirty_reason" not in df.columns:
        return df
    return df.where(F.col("dirty_reason").isNull()).drop("dirty_reason", "dirty_record")


def rejected_rows(spark: SparkSession, path: str) -> DataFrame:
    """Rejected rows of a written directory: the reason, and the row as it was read."""
    return spark.read.parquet(path).where(F.col("dirty_reason").isNotNull()).select("dirty_reason", "dirty_record")


def read_current(spark: SparkSession, root: str) -> DataFrame | None:
    """The rows of a table that only grows or is replaced; ``None`` before its first marked directory."""
    parts = [good_rows(spark.read.parquet(path)) for path in current_parts(spark, root)]
    return reduce(DataFrame.unionByName, parts) if parts else None
