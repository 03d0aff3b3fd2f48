"""The n-th row of a table in an order, found without sorting the table.

Rows are counted in parts of equal width of the first column of the order; the part that holds the place is counted in parts
again until it is small, or a single value, or null. Among the rows of a single value the next column decides. Each pass is one
grouping with at most ``PARTS`` groups, whatever the ties, and filters what it counts by plain comparisons. Only the
last, small part is put in order.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Parts that one pass counts, and rows of a part that is put in order.
PARTS, SMALL = 4096, 50_000

_WHOLE = ("byte", "short", "integer", "long")
_EPOCH = dt.datetime(1970, 1, 1)


@dataclass(frozen=True)
class By:
    """A column of an order. Nulls come first, or last when descending, as in any sort."""

    column: str
    descending: bool = False

    def order(self) -> Column:
        return F.desc(self.column) if self.descending else F.asc(self.column)


def selectable(df: DataFrame, order: Sequence[By]) -> bool:
    """Whether every column of the order can be counted in parts of equal width."""
    return all(df.schema[by.column].dataType.typeName() in (*_WHOLE, "date", "timestamp_ntz") for by in order)


def _number(kind: str, column: str) -> Column:
    if kind == "timestamp_ntz":
        return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), F.col(column))
    return F.unix_date(column) if kind == "date" else F.col(column).cast("long")


def _literal(kind: str, number: int) -> Column:
    if kind == "timestamp_ntz":
        return F.lit(str(_EPOCH + dt.timedelta(microseconds=number))).cast("timestamp_ntz")
    if kind == "date":
        return F.lit((_EPOCH + dt.timedelta(days=number)).date())
    return F.lit(number).cast("long")


def nth_row(df: DataFrame, order: Sequence[By], n: int) -> tuple | None:
    """Values of the order's columns in the row at place ``n`` (from 0); none if there are fewer rows."""
    if not selectable(df, order):
        raise ValueError("the order needs whole numbers, dates or zone-free times")
    rows, rest = df.select(*dict.fromkeys(by.column for by in order)), n
    for by in order:
        kind = df.schema[by.column].dataType.typeName()
        number = _number(kind, by.column)
        total, known, low, high = rows.agg(F.count(F.lit(1)), F.count(by.column), F.min(number), F.max(number)).first()
        if rest >= total:
            return None
        before = 0 if by.descending else total - known
        if not before <= rest < before + known:  # among the nulls
            rest -= known if by.descending else 0
            rows = rows.where(F.col(by.column).isNull())
            continue
        rest -= before
        rows = rows.where(F.col(by.column).isNotNull())
        while low < high and known > SMALL:
            width = (high - low) // PARTS + 1
            gap = number - F.lit(low) if high - low < 1 << 63 else number.cast("decimal(20,0)") - F.lit(low)
            # Rounding of the quotient moves where parts meet, no more: a part is known by the values it holds.
            part = F.floor(gap.cast("double") / F.lit(float(width)))
            counts = rows.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n"), F.min(number).alias("low"), F.max(number).alias("high")).collect()
            for row in sorted(counts, key=lambda r: r.low, reverse=by.descending):
                if rest < row.n:
                    break
                rest -= row.n
            known, low, high = row.n, row.low, row.high
            rows = rows.where(F.col(by.column).between(_literal(kind, low), _literal(kind, high)))
        if known <= SMALL:
            return tuple(rows.orderBy(*[b.order() for b in order]).offset(rest).limit(1).select(*[b.column for b in order]).first())
    return tuple(rows.select(*[b.column for b in order]).first())  # equal rows


def _beside(order: Sequence[By], row: tuple, after: bool) -> Column:
    """Rows before, or after, ``row``, by plain comparisons that reach a scan."""
    ways, same = [], F.lit(True)
    for by, value in zip(order, row, strict=True):
        column = F.col(by.column)
        up = after != by.descending  # larger values are on the asked side
        if value is None:
            # Nulls stand at the low end of the values.
            ways.append(same & (column.isNotNull() if up else F.lit(False)))
            same = same & column.isNull()
        else:
            at = F.lit(str(value)).cast("timestamp_ntz") if isinstance(value, dt.datetime) else F.lit(value)
            ways.append(same & (column > at if up else (column < at) | column.isNull()))
            same = same & (column == at)
    return reduce(or_, ways)


def rows_after(order: Sequence[By], row: tuple) -> Column:
    """Rows that stand after ``row``."""
    return _beside(order, row, True)


def rows_before(order: Sequence[By], row: tuple) -> Column:
    return _beside(order, row, False)


def _same(order: Sequence[By], row: tuple) -> Column:
    return reduce(and_, [F.col(by.column).eqNullSafe(F.lit(str(v)).cast("timestamp_ntz") if isinstance(v, dt.datetime) else F.lit(v)) for by, v in zip(order, row, strict=True)])


def slice_rows(df: DataFrame, order: Sequence[By], offset: int, size: int) -> DataFrame:
    """Rows ``offset`` to ``offset + size`` of the order, which has to end with a unique column; only these are sorted."""
    first = nth_row(df, order, offset)
    if first is None:
        return df.where(F.lit(False))
    last = nth_row(df, order, offset + size - 1)
    rows = df.where(rows_after(order, first) | _same(order, first))
    if last is not None:
        rows = rows.where(rows_before(order, last) | _same(order, last))
    return rows.orderBy(*[by.order() for by in order]).limit(size)
