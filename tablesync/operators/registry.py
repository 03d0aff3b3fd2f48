"""Executor heartbeats: who is alive, under which addresses, and how loaded."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablesync.operators.catalog import generic_page
from tablesync.operators.common import newest_first, ntz

DEAD_TIMEOUT_S = 90
"""Fixed value: seconds without a heartbeat after which an executor counts as dead."""

METRICS = ("cpu_usage", "memory_usage", "load_average")


def registry_latest(heartbeats: DataFrame) -> DataFrame:
    """Newest heartbeat per group, key and value; reduced inside each task before the shuffle."""
    keys = ["registry_group", "registry_key", "registry_value"]
    newest = newest_first("update_time", "id")
    return heartbeats.groupBy(*keys).agg(*[F.max_by(c, newest).alias(c) for c in ("update_time", "id", *METRICS)])


def _deadline(now, timeout_s: int) -> Column:
    return ntz(now) - F.expr(f"INTERVAL '{timeout_s}' SECOND")


def registry_dead(registry: DataFrame, now, timeout_s: int = DEAD_TIMEOUT_S) -> DataFrame:
    return registry.where(F.col("update_time") < _deadline(now, timeout_s))


def registry_alive(registry: DataFrame, now, timeout_s: int = DEAD_TIMEOUT_S) -> DataFrame:
    """Alive rows; a heartbeat exactly at the deadline is neither alive nor dead."""
    return registry.where(F.col("update_time") > _deadline(now, timeout_s))


def group_addresses(groups: DataFrame, registry: DataFrame, now, timeout_s: int = DEAD_TIMEOUT_S) -> DataFrame:
    """Automatic groups with the sorted addresses of their alive executors, null without any.

    Heartbeats shrink to distinct addresses first, so a list is only as long as its fleet.
    """
    alive = registry_alive(registry, now, timeout_s).where(F.col("registry_group") == "EXECUTOR")
    fleet = alive.select(F.col("registry_key").alias("app_name"), "registry_value").distinct()
    lists = fleet.groupBy("app_name").agg(F.array_join(F.array_sort(F.collect_list("registry_value")), ",").alias("address_list"))
    return groups.where(F.col("address_type") == 0).select("id", "app_name").join(lists, "app_name", "left")


def registry_page(registry: DataFrame, params: dict) -> DataFrame:
    """Page of registry rows, searched by part of the key."""
    return generic_page(registry, params, like=("registry_key", "registry_value"))


def resource_trend(registry: DataFrame, bucket: str = "5 minutes") -> DataFrame:
    """Average and peak load per executor and time bucket."""
    metrics = [f(m).alias(f"{n}_{m}") for m in METRICS for n, f in (("avg", F.avg), ("max", F.max))]
    per = registry.groupBy("registry_value", F.window("update_time", bucket).alias("w")).agg(F.count(F.lit(1)).alias("samples"), *metrics)
    return per.select("registry_value", F.col("w.start").alias("bucket_start"), "samples", *[f"{n}_{m}" for m in METRICS for n in ("avg", "max")])


def resource_flags(latest: DataFrame, max_load: float, memory_reserve: float) -> DataFrame:
    """Executors over the load limit, or with less free memory than the reserve."""
    return latest.where((F.col("load_average") > max_load) | (1 - F.col("memory_usage") < memory_reserve))
