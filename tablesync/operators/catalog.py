"""Queries over jobs, templates, projects, groups, users and data sources."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablesync.operators.common import blank, contains, page
from tablesync.operators.select import By

PRE_READ_MS = 5000
"""Fixed value: how far ahead of its time a job is picked up, and how late it may still start."""


def _filter_owned(df: DataFrame, job_group=0, job_desc=None, user_id=0, project_ids: Sequence[int] | None = None) -> DataFrame:
    if job_group > 0:
        df = df.where(F.col("job_group") == job_group)
    if not blank(job_desc):
        df = df.where(contains("job_desc", job_desc))
    if user_id > 0:
        df = df.where(F.col("user_id") == user_id)
    if project_ids:
        df = df.where(F.col("project_id").isin(*project_ids))
    return df


def filter_jobs(jobs: DataFrame, trigger_status: int = -1, glue_type: str | None = None, **owned) -> DataFrame:
    jobs = _filter_owned(jobs, **owned)
    if trigger_status >= 0:
        jobs = jobs.where(F.col("trigger_status") == trigger_status)
    if not blank(glue_type):
        jobs = jobs.where(contains("glue_type", glue_type))
    return jobs


def filter_templates(templates: DataFrame, executor_handler: str | None = None, **owned) -> DataFrame:
    templates = _filter_owned(templates, **owned)
    if not blank(executor_handler):
        templates = templates.where(contains("executor_handler", executor_handler))
    return templates


def _project_names(projects: DataFrame) -> DataFrame:
    return projects.select(F.col("id").alias("project_id"), F.col("name").alias("project_name"))


def _user_names(users: DataFrame) -> DataFrame:
    return users.select(F.col("id").alias("user_id"), "username")


def job_page(jobs, projects, users, offset: int = 0, size: int | None = 10, **filters) -> DataFrame:
    """Page of jobs with project and user name, newest id first."""
    rows = filter_jobs(jobs, **filters).join(_project_names(projects), "project_id").join(_user_names(users), "user_id")
    return page(rows, [By("id", descending=True)], offset, size)


def job_page_count(jobs, projects, **filters) -> DataFrame:
    """Count for the page. It joins the projects only, so it also counts jobs whose user is gone."""
    return filter_jobs(jobs, **filters).join(_project_names(projects), "project_id").agg(F.count(F.lit(1)).alias("total"))


def job_list(jobs: DataFrame) -> DataFrame:
    return jobs.orderBy("job_desc", "id")


def jobs_by_group(jobs: DataFrame, job_group: int) -> DataFrame:
    return jobs.where(F.col("job_group") == job_group)


def job_count(jobs: DataFrame) -> DataFrame:
    return jobs.agg(F.count(F.lit(1)).alias("total"))


def job_due(jobs: DataFrame, now_ms: int, limit: int | None = None) -> DataFrame:
    """Active jobs whose next start is at most the pre-read span away."""
    due = jobs.where((F.col("trigger_status") == 1) & (F.col("trigger_next_time") <= now_ms + PRE_READ_MS))
    return page(due, [F.col("id")], size=limit)


def job_due_class(jobs: DataFrame, now_ms: int) -> DataFrame:
    """Class of each due job, and the second slot of those still to come."""
    late = F.lit(now_ms) - F.col("trigger_next_time")
    kind = F.when(late > PRE_READ_MS, "misfire").when(late > 0, "fire").otherwise("upcoming")
    slot = F.when(late <= 0, F.floor(F.col("trigger_next_time") / 1000) % 60)
    return job_due(jobs, now_ms).select("id", "trigger_next_time", kind.alias("due_class"), slot.cast("bigint").alias("ring_second"))


def template_page(templates, projects, users, offset: int = 0, size: int | None = 10, **filters) -> DataFrame:
    rows = filter_templates(templates, **filters).join(_project_names(projects), "project_id").join(_user_names(users), "user_id")
    return page(rows, [By("id", descending=True)], offset, size)


def template_count(templates, **filters) -> DataFrame:
    """Count of templates for the page's filter; it joins nothing."""
    return filter_templates(templates, **filters).agg(F.count(F.lit(1)).alias("total"))


def project_page(projects, users, search: str | None = None, offset: int = 0, size: int | None = 10) -> DataFrame:
    """Active projects with their owner's name, newest first."""
    rows = project_list(projects)
    if not blank(search):
        rows = rows.where(contains("name", search))
    rows = rows.join(_user_names(users), "user_id")
    return page(rows, [F.col("create_time").desc(), F.col("id").desc()], offset, size)


def project_list(projects: DataFrame) -> DataFrame:
    return projects.where(F.col("flag") == 1)


def group_search(groups, app_name=None, title=None, address_list=None) -> DataFrame:
    for column, text in (("app_name", app_name), ("title", title), ("address_list", address_list)):
        if not blank(text):
            groups = groups.where(contains(column, text))
    return groups


def group_list(groups: DataFrame, address_type: int | None = None) -> DataFrame:
    if address_type is not None:
        groups = groups.where(F.col("address_type") == address_type)
    return groups.orderBy("sort_order", "id")


def user_search(users: DataFrame, username: str | None = None) -> DataFrame:
    return users if blank(username) else users.where(contains("username", username))


def user_page(users, username: str | None = None, offset: int = 0, size: int | None = 10) -> DataFrame:
    """Users by name, without their password."""
    rows = user_search(users, username).select("id", "username", "role", "permission")
    return page(rows, [F.col("username"), F.col("id")], offset, size)


def user_count(users, username: str | None = None) -> DataFrame:
    return user_search(users, username).agg(F.count(F.lit(1)).alias("total"))


def user_list(users, username: str | None = None) -> DataFrame:
    return user_search(users, username).select("id", "username", "role", "permission").orderBy("id")


def users_by_ids(users, ids: Sequence[int]) -> DataFrame:
    return users.where(F.col("id").isin(*ids))


def user_permissions(user_id: int, users, role_user, roles, permission_role, permissions) -> DataFrame:
    """Permissions of one user over roles; a missing link leaves a row of nulls."""
    return (
        users.where(F.col("id") == user_id).select(F.col("id").alias("job_user_id"))
        .join(role_user, "job_user_id", "left")
        .join(roles.select(F.col("id").alias("job_role_id"), F.col("id").alias("role_id")), "job_role_id", "left")
        .join(permission_role, "role_id", "left")
        .join(permissions.withColumn("permission_id", F.col("id")), "permission_id", "left")
        .select("id", "name", "description", "url", "pid")
    )


# Columns searched by substring, and parameters that steer paging instead of filtering.
LIKE_COLUMNS = ("plugin_name", "datasource_name")
PAGE_PARAMETERS = ("current", "size", "ascs", "descs")


def snake_case(name: str) -> str:
    return re.sub(r"(?<!^)(?=[A-Z])", "_", name).lower()


def generic_page(df: DataFrame, params: Mapping[str, object], like: Sequence[str] = LIKE_COLUMNS, key: Sequence[str] | None = None) -> DataFrame:
    """Page driven by request parameters: ``current``, ``size``, ``ascs``, ``descs``; the rest filter. ``key`` tells rows apart."""
    for name, value in params.items():
        column = snake_case(name)
        if name in PAGE_PARAMETERS or blank(None if value is None else str(value)):
            continue
        df = df.where(contains(column, str(value)) if column in like else F.col(column) == F.lit(value))
    order = []
    for asked, descending in (("ascs", False), ("descs", True)):
        names = params.get(asked) or []
        names = names.split(",") if isinstance(names, str) else names
        order += [By(snake_case(n.strip()), descending) for n in names if not blank(n)]
    size = int(params.get("size") or 10)
    offset = (int(params.get("current") or 1) - 1) * size
    # The key comes last, or else all columns: without a total order pages would repeat and skip rows.
    order += [By(c) for c in key or (["id"] if "id" in df.columns else df.columns)]
    return page(df, order, offset, size)


def group_in_use(groups: DataFrame, jobs: DataFrame) -> DataFrame:
    """Per group: its number of jobs, and whether it may be removed (unused and not the last one)."""
    used = jobs.groupBy(F.col("job_group").alias("id")).agg(F.count(F.lit(1)).alias("jobs"))
    total = groups.agg(F.count(F.lit(1))).scalar()
    rows = groups.select("id", "app_name").join(used, "id", "left")
    rows = rows.select("id", "app_name", F.coalesce("jobs", F.lit(0)).cast("bigint").alias("jobs"))
    return rows.withColumn("removable", (F.col("jobs") == 0) & (total > 1))


def active_datasources(datasources: DataFrame) -> DataFrame:
    """Data sources not marked as deleted."""
    return datasources.where(F.col("status") == 1)


def patch_datasource(datasources: DataFrame, patch: DataFrame) -> DataFrame:
    """Data sources after overwriting only the fields the patch sets."""
    fields = [c for c in patch.columns if c != "id"]
    renamed = patch.select("id", *[F.col(c).alias(f"_new_{c}") for c in fields])
    new = [F.coalesce(f"_new_{c}", c).alias(c) if c in fields else F.col(c) for c in datasources.columns]
    return datasources.join(renamed, "id", "left").select(*new)
