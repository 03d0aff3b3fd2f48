"""Small relational building blocks shared by the operator modules.

No broadcast hint appears anywhere in the library: Spark broadcasts a join side when its
measured size is below ``spark.sql.autoBroadcastJoinThreshold`` (at planning time, or at run
time through adaptive execution), and otherwise sort-merge joins with skew splitting.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablesync.operators.select import By, selectable, slice_rows

DEEP = 10_000
"""Rows up to the end of a page beyond which the page is cut out by counting instead of ordering all rows before it."""


def ntz(value: str | dt.datetime) -> Column:
    """A zone-free timestamp literal."""
    return F.lit(str(value)).cast("timestamp_ntz")


def blank(text: str | None) -> bool:
    return text is None or not str(text).strip()


def contains(column: str, text: str) -> Column:
    """``LIKE '%text%'`` without wildcards inside ``text``."""
    return F.col(column).contains(text)


def page(df: DataFrame, order: Sequence[Column | By], offset: int = 0, size: int | None = None, deep: int = DEEP) -> DataFrame:
    """Ordered page. Offset and limit over a sort run as one top-k per task, then one merge.

    A top-k holds all rows up to the page's end. Where these are more than ``deep`` and the order is one of numbers and times,
    the keys of the page's two ends are counted out first, and only the rows between them are sorted.
    """
    if size and offset + size > deep and all(isinstance(o, By) for o in order) and selectable(df, order):
        return slice_rows(df, order, offset, size)
    df = df.orderBy(*[o.order() if isinstance(o, By) else o for o in order])
    if offset:
        df = df.offset(offset)
    return df if size is None else df.limit(size)


def dealt(df: DataFrame, *columns: str) -> DataFrame:
    """Rows dealt to tasks by the values of ``columns``, before work that takes long for each row.

    A table of short rows is read by few tasks whatever its number of rows. The number of tasks is given, so that adaptive
    execution, which goes by bytes, doesn't merge them again.
    """
    spark = df.sparkSession
    return df.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism), *columns)


def newest_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int = 1) -> DataFrame:
    """The first ``n`` rows of each key in ``order``.

    Spark keeps at most ``n`` rows per key and task before the shuffle (window group
    limit), so a hot key moves ``n`` rows per task rather than its whole group. That holds for
    ``n`` below ``spark.sql.optimizer.windowGroupLimitThreshold``, 1000 unless set.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n).drop("_rn")


def upsert(
    target: DataFrame, batch: DataFrame, keys: Sequence[str], order: Sequence[Column] | None = None
) -> DataFrame:
    """Target state after the batch: replaced by key, inserted where new.

    ``order`` picks the surviving row when the batch repeats a key (first in order wins).
    """
    if order:
        batch = newest_per_key(batch, keys, order)
    asked = batch.select(*[F.col(k).alias(f"_{k}") for k in keys])
    same = reduce(and_, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys])  # null is a key like any other
    return target.join(asked, same, "left_anti").unionByName(batch)


def newest_first(time: str, key: str) -> Column:
    """Order of a time and then a whole-number key as one fixed-width value, which hash aggregation can keep a maximum of."""
    micros = F.timestamp_diff("MICROSECOND", ntz("1970-01-01 00:00:00"), F.col(time)).cast("decimal(18,0)")
    return micros * F.lit("1" + 19 * "0").cast("decimal(20,0)") + F.col(key).cast("decimal(19,0)")


def in_range(column: str, start=None, end=None, inclusive_end: bool = True) -> Column:
    """Range predicate with optional ends; plain comparisons, so it reaches the scan."""
    cond = F.lit(True)
    if start is not None:
        cond = cond & (F.col(column) >= start)
    if end is not None:
        cond = cond & ((F.col(column) <= end) if inclusive_end else (F.col(column) < end))
    return cond
