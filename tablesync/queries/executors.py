"""Registered queries over executor heartbeats."""

from pyspark.sql import functions as F

from tablesync.operators import registry as reg
from tablesync.queries.registry import NOW, query

_LATEST = """SELECT registry_group, registry_key, registry_value, cpu_usage, memory_usage, load_average, update_time, id FROM job_registry
QUALIFY row_number() OVER (PARTITION BY registry_group, registry_key, registry_value ORDER BY update_time DESC, id DESC) = 1"""


@query("registry_latest", _LATEST, "job_registry")
def registry_latest(t):
    return reg.registry_latest(t.job_registry)


@query("registry_dead", f"SELECT id, registry_value, update_time FROM job_registry WHERE update_time < TIMESTAMP '{NOW}' - INTERVAL 3600 SECOND", "job_registry")
def registry_dead(t):
    return reg.registry_dead(t.job_registry, NOW, 3600).select("id", "registry_value", "update_time")


@query("registry_alive", f"SELECT id, registry_value, update_time FROM job_registry WHERE update_time > TIMESTAMP '{NOW}' - INTERVAL 3600 SECOND", "job_registry")
def registry_alive(t):
    return reg.registry_alive(t.job_registry, NOW, 3600).select("id", "registry_value", "update_time")


@query("group_addresses", f"""SELECT g.id, g.app_name, r.address_list FROM job_group g
LEFT JOIN (SELECT registry_key, string_agg(DISTINCT registry_value, ',' ORDER BY registry_value) AS address_list FROM job_registry
           WHERE registry_group = 'EXECUTOR' AND update_time > TIMESTAMP '{NOW}' - INTERVAL 3600 SECOND GROUP BY registry_key) r
  ON r.registry_key = g.app_name WHERE g.address_type = 0""", "job_group job_registry")
def group_addresses(t):
    return reg.group_addresses(t.job_group, t.job_registry, NOW, 3600)


@query("registry_page", """SELECT id, registry_key, registry_value, update_time FROM job_registry
WHERE registry_key LIKE '%app-3%' ORDER BY update_time DESC LIMIT 25 OFFSET 50""", "job_registry")
def registry_page(t):
    rows = reg.registry_page(t.job_registry, {"current": 3, "size": 25, "descs": "updateTime", "registryKey": "app-3"})
    return rows.select("id", "registry_key", "registry_value", "update_time")


@query("resource_trend", """SELECT registry_value, time_bucket(INTERVAL 5 MINUTE, update_time) AS bucket_start, count(*) AS samples,
  round(avg(cpu_usage), 9) AS avg_cpu_usage, max(cpu_usage) AS max_cpu_usage,
  round(avg(memory_usage), 9) AS avg_memory_usage, max(memory_usage) AS max_memory_usage,
  round(avg(load_average), 9) AS avg_load_average, max(load_average) AS max_load_average
FROM job_registry GROUP BY 1, 2""", "job_registry")
def resource_trend(t):
    rows = reg.resource_trend(t.job_registry)
    return rows.select(*[F.round(c, 9).alias(c) if c.startswith("avg_") else F.col(c) for c in rows.columns])


@query("resource_flags", f"""SELECT registry_key, registry_value, memory_usage, load_average FROM ({_LATEST})
WHERE load_average > 6 OR 1 - memory_usage < 0.305""", "job_registry")
def resource_flags(t):
    rows = reg.resource_flags(reg.registry_latest(t.job_registry), 6.0, 0.305)
    return rows.select("registry_key", "registry_value", "memory_usage", "load_average")
