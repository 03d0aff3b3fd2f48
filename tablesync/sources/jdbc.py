"""Tables and queries of relational databases, read in parallel ranges of a split key."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablesync.operators.common import blank

DEFAULT_CHANNELS = 3
"""Fixed value: parallel slices of a split scan unless told otherwise."""


@dataclass(frozen=True)
class JdbcConnection:
    """Connection settings; any database whose driver is on Spark's class path works alike."""

    url: str
    driver: str | None = None
    user: str | None = None
    password: str | None = None
    options: dict[str, str] = field(default_factory=dict)

    def as_options(self) -> dict[str, str]:
        given = {"url": self.url, "driver": self.driver, "user": self.user, "password": self.password}
        return {k: v for k, v in given.items() if v is not None} | self.options


def read_query(spark: SparkSession, conn: JdbcConnection, sql: str) -> DataFrame:
    """Result of a query the database runs as a whole."""
    return spark.read.format("jdbc").options(**conn.as_options()).option("query", sql).load()


def split_bounds(spark: SparkSession, conn: JdbcConnection, table: str, split_pk: str, where: str | None = None):
    """Smallest and largest split key, fetched as one row from the database."""
    condition = "" if blank(where) else f" WHERE {where}"
    sql = f"SELECT MIN({split_pk}) AS lo, MAX({split_pk}) AS hi FROM {table}{condition}"
    row = read_query(spark, conn, sql).first()
    return (None, None) if row is None else (row[0], row[1])


NTH_ROW = "SELECT {key} FROM {source} WHERE {key} IS NOT NULL ORDER BY {key} OFFSET {n} ROWS FETCH NEXT 1 ROWS ONLY"
"""The ``n``-th key in order; databases without this clause take another text."""


def _literal(value) -> str:
    if isinstance(value, (int, float)):
        return str(value)
    return "'" + str(value).replace("'", "''") + "'"


def row_ranges(spark: SparkSession, conn: JdbcConnection, source: str, split_pk: str, channels: int = DEFAULT_CHANNELS, nth_row: str = NTH_ROW) -> list[str]:
    """Conditions that cut ``source`` into at most ``channels`` ranges of about as many rows each, whatever the key's type and skew.

    The database is asked for the keys at the cuts; rows without a key go with the first range.
    """
    rows = int(read_query(spark, conn, f"SELECT COUNT({split_pk}) AS n FROM {source}").first()[0])
    cuts = []
    for i in range(1, channels):
        if rows * i // channels:
            found = read_query(spark, conn, nth_row.format(key=split_pk, source=source, n=rows * i // channels)).first()
            if found is not None and found[0] not in cuts:
                cuts.append(found[0])
    if not cuts:
        return ["1 = 1"]
    edges = [_literal(c) for c in cuts]
    middle = [f"{split_pk} >= {a} AND {split_pk} < {b}" for a, b in zip(edges, edges[1:])]
    return [f"{split_pk} < {edges[0]} OR {split_pk} IS NULL", *middle, f"{split_pk} >= {edges[-1]}"]


def read_table(
    spark: SparkSession,
    conn: JdbcConnection,
    table: str | None = None,
    columns: Sequence[str] = (),
    where: str | None = None,
    query_sql: str | None = None,
    split_pk: str | None = None,
    channels: int = DEFAULT_CHANNELS,
    by_rows: bool = False,
    nth_row: str = NTH_ROW,
) -> DataFrame:
    """Columns of a table with an optional filter; a query, when given, replaces all three.

    The filter is the database's own text and runs there, as does the projection. With a split
    key the scan runs as ``channels`` ranges between its smallest and largest value, otherwise
    as one. ``by_rows`` cuts ranges of equal row counts instead, which suits skewed and text keys; a query is always cut so.
    """
    if not blank(query_sql) and blank(split_pk):
        return read_query(spark, conn, query_sql)
    if not blank(query_sql) or (by_rows and not blank(split_pk)):
        whole = f"({query_sql}) src" if not blank(query_sql) else table if blank(where) else f"(SELECT * FROM {table} WHERE {where}) src"
        given = conn.as_options()
        ranges = row_ranges(spark, conn, whole, split_pk, channels, nth_row)
        df = spark.read.jdbc(given["url"], whole, predicates=ranges, properties={k: v for k, v in given.items() if k != "url"})
        return df.select(*columns) if columns and blank(query_sql) else df
    source = table if blank(where) else f"(SELECT * FROM {table} WHERE {where}) src"
    reader = spark.read.format("jdbc").options(**conn.as_options()).option("dbtable", source)
    if not blank(split_pk):
        lo, hi = split_bounds(spark, conn, table, split_pk, where)
        if lo is not None and lo != hi:
            reader = reader.options(
                partitionColumn=split_pk, lowerBound=str(lo), upperBound=str(hi), numPartitions=str(channels)
            )
    df = reader.load()
    return df.select(*columns) if columns else df


def max_id(spark: SparkSession, conn: JdbcConnection, table: str, pk: str) -> int:
    """Largest key of a table, 0 only when it is empty; a failing query raises."""
    row = read_query(spark, conn, f"SELECT MAX({pk}) AS hi FROM {table}").first()
    return 0 if row is None or row[0] is None else int(row[0])


def with_split_slice(df: DataFrame, split_pk: str, channels: int = DEFAULT_CHANNELS, out: str = "slice") -> DataFrame:
    """Number of the equal-width key range each row falls into, as a split scan would cut them."""
    bounds = df.agg(F.struct(F.min(split_pk).alias("lo"), F.max(split_pk).alias("hi"))).scalar()
    width = F.ceil((F.col("_bounds.hi") - F.col("_bounds.lo") + 1) / channels)
    return df.withColumn("_bounds", bounds).withColumn(out, F.floor((F.col(split_pk) - F.col("_bounds.lo")) / width).cast("int")).drop("_bounds")
