"""Inserts into relational tables, with statements before and after the load."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession

from tablesync.sources.jdbc import JdbcConnection

DEFAULT_BATCH = 512
"""Fixed value: rows per insert batch."""


def split_statements(text: str | None) -> list[str]:
    """Statements of a script: line breaks become blanks, ``;`` separates."""
    flat = re.sub(r"[\r\n]+", " ", text or "")
    return [s.strip() for s in flat.split(";") if s.strip()]


def run_statements(spark: SparkSession, conn: JdbcConnection, statements: Sequence[str]) -> None:
    """Run statements once, from the driver, over the database's own connection."""
    if not statements:
        return
    jvm = spark._jvm
    options = jvm.org.apache.spark.sql.execution.datasources.jdbc.JDBCOptions
    settings = jvm.PythonUtils.toScalaMap(conn.as_options() | {"dbtable": "t"})
    factory = jvm.org.apache.spark.sql.jdbc.JdbcDialects.get(conn.url).createConnectionFactory(options(settings))
    connection = factory.apply(-1)
    try:
        statement = connection.createStatement()
        for sql in statements:
            statement.execute(sql)
    finally:
        connection.close()


def run_catalog_statements(spark: SparkSession, statements: Sequence[str]) -> None:
    for sql in statements:
        spark.sql(sql)


def with_statements(run: Callable[[Sequence[str]], None], pre_sql: str | None, write: Callable[[], None], post_sql: str | None) -> None:
    """Pre statements, the write, then post statements; these only after a write that succeeded."""
    run(split_statements(pre_sql))
    write()
    run(split_statements(post_sql))


def append_table(
    df: DataFrame, conn: JdbcConnection, table: str, columns: Sequence[str] | None = None, batch: int = DEFAULT_BATCH,
    pre_sql: str | None = None, post_sql: str | None = None, partitions: int | None = None,
) -> None:
    """Insert the named columns.

    Each task commits on its own, so a task repeated after the loss of an executor can insert
    its rows again. Where that matters, load a staging table and merge it by key in ``post_sql``.
    ``partitions`` caps the number of connections the database has to serve.
    """
    rows = df.select(*columns) if columns else df

    def write():
        writer = rows.write.format("jdbc").mode("append").options(**conn.as_options())
        if partitions:
            writer = writer.option("numPartitions", str(partitions))
        writer.option("dbtable", table).option("batchsize", str(batch)).save()

    with_statements(lambda s: run_statements(df.sparkSession, conn, s), pre_sql, write, post_sql)
