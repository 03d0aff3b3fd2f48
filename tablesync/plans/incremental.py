"""Incremental runs of a sync: window from the state, sync, and the new state stored with what was written."""

from __future__ import annotations

import datetime as dt
import json
from collections.abc import Mapping
from dataclasses import asdict, dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablesync.operators.common import ntz
from tablesync.operators.increment import EPOCH_SECONDS, INC_ID, INC_PARTITION, INC_TIME, TIME_FORMATS, id_window, max_id, partition_value, time_window
from tablesync.operators.mapping import bind_params
from tablesync.plans.sync import SyncResult, SyncSpec, run_sync
from tablesync.sinks.publish import newest_note
from tablesync.sources.tables import run_query

# The time formats in the notation of the standard library.
_PATTERN = {f: f.replace("yyyy", "%Y").replace("MM", "%m").replace("dd", "%d").replace("HH", "%H").replace("mm", "%M").replace("ss", "%S") for f in TIME_FORMATS}


@dataclass(frozen=True)
class IncrementState:
    """Where the next run of a job starts. ``partition`` is a ``field,offset,format`` setting."""

    increment_type: int
    column: str
    start_time: str = "1970-01-01 00:00:00"
    start_id: int = 0
    partition: str | None = None
    time_format: str | None = None


@dataclass(frozen=True)
class QuerySource:
    """A query text with ``${name}`` parameters for the window's bounds, over named tables."""

    sql: str
    tables: Mapping[str, DataFrame] = field(default_factory=dict)


def _partition(state: IncrementState) -> tuple[int, str]:
    _, offset, fmt = (state.partition or f"{state.column},0,yyyy-MM-dd").split(",")
    return int(offset), fmt


def window_of(df: DataFrame, state: IncrementState, now: str, end_id: int | None = None) -> DataFrame:
    """The rows the run at ``now`` has to move."""
    if state.increment_type == INC_TIME:
        return time_window(df, state.column, state.start_time, now)
    if state.increment_type == INC_ID:
        return id_window(df, state.column, state.start_id, end_id)
    if state.increment_type == INC_PARTITION:
        offset, fmt = _partition(state)
        value = partition_value(ntz(now[:19]), offset, fmt)
        if df.schema[state.column].dataType.typeName() in ("date", "timestamp", "timestamp_ntz"):
            day = F.date_add(ntz(now[:19]).cast("date"), offset).cast("timestamp_ntz")
            return df.where((F.col(state.column) >= day) & (F.col(state.column) < day + F.expr("INTERVAL '1' DAY")))
        return df.where(F.col(state.column) == value)
    return df


def bounds(state: IncrementState, now: str, end_id: int | None = None) -> dict[str, object]:
    """Values of ``${lastTime}``, ``${currentTime}``, ``${startId}``, ``${endId}`` and ``${partition}`` in a query."""
    if state.increment_type == INC_TIME:
        def text(moment):
            at = dt.datetime.fromisoformat(moment[:19])
            if (state.time_format or EPOCH_SECONDS) == EPOCH_SECONDS:
                return str(int(at.replace(tzinfo=dt.timezone.utc).timestamp()))
            return at.strftime(_PATTERN[state.time_format])

        return {"lastTime": text(state.start_time), "currentTime": text(now)}
    if state.increment_type == INC_ID:
        return {"startId": state.start_id, "endId": end_id}
    if state.increment_type == INC_PARTITION:
        offset, fmt = _partition(state)
        day = dt.datetime.fromisoformat(now[:19]) + dt.timedelta(days=offset)
        return {"partition": day.strftime(_PATTERN.get(fmt) or fmt.replace("yyyy", "%Y").replace("MM", "%m").replace("dd", "%d"))}
    return {}


def stored_state(spark: SparkSession, spec: SyncSpec, first: IncrementState) -> IncrementState:
    """The state stored with the target's newest version, ``first`` before there is one."""
    note = newest_note(spark, spec.target)
    return first if note is None else IncrementState(**json.loads(note))


def run_incremental(
    spark: SparkSession, spec: SyncSpec, state: IncrementState, now: str, query: QuerySource | None = None
) -> tuple[SyncResult, IncrementState]:
    """Run one window. Only a run that succeeds returns an advanced state; an error leaves it as it was.

    The new state is written inside the version and becomes visible with it, so a crash after that loses nothing:
    ``stored_state`` has it. A source that shrank or is empty never moves the state back. With ``query`` the rows come from
    its text, the bounds bound as values, instead of a window over ``spec.read``.
    """
    end_id = None
    if state.increment_type == INC_ID:
        end_id = max(state.start_id, int(max_id(spec.read(spark), state.column).first()[0]))
    after = state
    if state.increment_type == INC_ID:
        after = replace(state, start_id=end_id)
    elif state.increment_type == INC_TIME:
        after = replace(state, start_time=max(state.start_time, now[:19]))

    def read(s):
        if query is None:
            return window_of(spec.read(s), state, now, end_id)
        asked = {k: v for k, v in bounds(state, now, end_id).items() if f"${{{k}}}" in query.sql}
        return run_query(s, bind_params(query.sql), query.tables, asked)

    return run_sync(spark, replace(spec, read=read), note=json.dumps(asdict(after))), after
