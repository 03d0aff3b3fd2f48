"""Shared helpers of the operators: appending columns from Arrow batches, and connected components of a link table."""

from __future__ import annotations

import sys
import types
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tablesync.session import materialise

#: Bytes of a lower-cased word of the contamination and toxicity contracts: digits, a-z and everything beyond ASCII.
WORD_BYTES = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256)
)


def word_bytes(text: str | None) -> list[bytes]:
    """The words of ``text`` as UTF-8; none for null."""
    return text.encode("utf-8", "surrogatepass").translate(WORD_BYTES).split() if text else []


def append_columns(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], list]], fields: list[T.StructField]) -> DataFrame:
    """``df`` with columns computed batch by batch; ``make()`` runs once per task and gives the function of a batch."""
    schema = T.StructType([*df.schema.fields, *fields])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = make()
        for batch in batches:
            columns = [c.cast(f.type) if c.type != f.type else c for c, f in zip(batch.columns, arrow, strict=False)]
            added = [pa.array(c, f.type) if not isinstance(c, pa.Array) else c for c, f in zip(of(batch), list(arrow)[len(columns) :], strict=True)]
            yield pa.RecordBatch.from_arrays([*columns, *added], schema=arrow)

    return df.mapInArrow(run, schema)


def carried(docs: DataFrame, **columns: Column) -> DataFrame:
    """Whole rows under the one name ``row``, so that no column of theirs can clash, beside the columns an operator works on."""
    return docs.select(F.struct("*").alias("row"), *(c.alias(n) for n, c in columns.items()))


def spread(df: DataFrame, docs: DataFrame) -> DataFrame:
    """The rows of ``carried`` again, with the columns of ``docs``."""
    return df.select(*(F.col("row").getField(c).alias(c) for c in docs.columns))


def components(links: DataFrame) -> DataFrame:
    """``(node, root)``: for every linked node the smallest node it can reach.

    ``links`` has two long columns. Large-star and small-star steps alternate until the table of links no longer changes;
    each round is written to the shared folder, and all state stays in tables.
    """
    a, b = links.columns
    edges = materialise(
        links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct(), "links"
    )
    before = None
    while True:
        sign = edges.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))")).first()
        if sign == before or sign[0] == 0:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = sign
        both = edges.select(F.col("u").alias("x"), F.col("v").alias("y")).union(edges.select(F.col("v"), F.col("u")))
        # Written first, so that adaptive execution can split the edges of a node that most others reach.
        least = materialise(both.groupBy("x").agg(F.least(F.min("y"), F.col("x")).alias("m")), "least")
        large = both.where("y > x").join(least, "x").select(F.col("y").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = materialise(large, "links")
        down = materialise(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        small = large.join(down, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        edges = materialise(small.union(down.select("u", F.col("m").alias("v"))).distinct(), "links")


def root_of(steps: DataFrame) -> DataFrame:
    """``(node, root)`` for a table of nodes and the next node of each: where the steps end. There must be no cycle.

    Each round doubles the steps behind every row, so rounds grow with the logarithm of the longest way.
    """
    node, _ = steps.columns
    now = materialise(steps.toDF(node, "root"), "roots")
    while True:
        ahead = now.select(F.col(node).alias("root"), F.col("root").alias("next"))
        moved = materialise(now.join(ahead, "root", "left").select(node, F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        if not moved.where("moved").limit(1).count():
            return moved.drop("moved")
        now = moved.drop("moved")


def worker_store(name: str) -> dict:
    """A dictionary that stays with the Python worker from task to task."""
    return sys.modules.setdefault("_tablesync_worker", types.ModuleType("_tablesync_worker")).__dict__.setdefault(name, {})
