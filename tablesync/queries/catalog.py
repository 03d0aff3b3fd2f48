"""Registered queries over the control tables."""

from tablesync.operators import catalog
from tablesync.queries.registry import query

NOW_MS = 1704067200000
_JOB = ["id", "job_group", "job_desc", "project_name", "username", "trigger_status"]
_JOBS = ["id", "job_group", "job_desc", "project_id", "user_id"]


@query("job_page", """SELECT t.id, t.job_group, t.job_desc, p.name AS project_name, u.username, t.trigger_status
FROM job_info t JOIN job_project p ON t.project_id = p.id JOIN job_user u ON t.user_id = u.id
WHERE t.trigger_status = 1 AND t.job_desc LIKE '%00%' AND t.glue_type LIKE '%GLUE%' AND t.project_id IN (1, 2, 3, 4, 6, 8)
ORDER BY t.id DESC LIMIT 15 OFFSET 5""", "job_info job_project job_user")
def job_page(t):
    return catalog.job_page(
        t.job_info, t.job_project, t.job_user, 5, 15, trigger_status=1, job_desc="00", glue_type="GLUE", project_ids=[1, 2, 3, 4, 6, 8]
    ).select(_JOB)


@query("job_page_count", """SELECT count(*) AS total FROM job_info t JOIN job_project p ON t.project_id = p.id
WHERE t.job_group = 2 AND t.user_id = 3""", "job_info job_project")
def job_page_count(t):
    return catalog.job_page_count(t.job_info, t.job_project, job_group=2, user_id=3)


@query("job_list", "SELECT id, job_group, job_desc, project_id, user_id FROM job_info ORDER BY job_desc, id", "job_info")
def job_list(t):
    return catalog.job_list(t.job_info).select(_JOBS)


@query("jobs_by_group", "SELECT id, job_group, job_desc, project_id, user_id FROM job_info WHERE job_group = 4", "job_info")
def jobs_by_group(t):
    return catalog.jobs_by_group(t.job_info, 4).select(_JOBS)


@query("job_count", "SELECT count(*) AS total FROM job_info", "job_info")
def job_count(t):
    return catalog.job_count(t.job_info)


@query("job_due", f"""SELECT id, trigger_next_time FROM job_info
WHERE trigger_status = 1 AND trigger_next_time <= {NOW_MS} + 5000 ORDER BY id""", "job_info")
def job_due(t):
    return catalog.job_due(t.job_info, NOW_MS).select("id", "trigger_next_time")


@query("job_due_class", f"""SELECT id, trigger_next_time,
  CASE WHEN {NOW_MS} > trigger_next_time + 5000 THEN 'misfire' WHEN {NOW_MS} > trigger_next_time THEN 'fire' ELSE 'upcoming' END AS due_class,
  CASE WHEN {NOW_MS} <= trigger_next_time THEN (trigger_next_time // 1000) % 60 END AS ring_second
FROM job_info WHERE trigger_status = 1 AND trigger_next_time <= {NOW_MS} + 5000""", "job_info")
def job_due_class(t):
    return catalog.job_due_class(t.job_info, NOW_MS)


@query("template_page", """SELECT t.id, t.job_desc, t.executor_handler, p.name AS project_name, u.username
FROM job_template t JOIN job_project p ON t.project_id = p.id JOIN job_user u ON t.user_id = u.id
WHERE t.job_group = 2 AND t.executor_handler LIKE '%A%' AND t.job_desc LIKE '%e%' ORDER BY t.id DESC LIMIT 20 OFFSET 0""",
       "job_template job_project job_user")
def template_page(t):
    return catalog.template_page(
        t.job_template, t.job_project, t.job_user, 0, 20, job_group=2, executor_handler="A", job_desc="e"
    ).select("id", "job_desc", "executor_handler", "project_name", "username")


@query("template_count", "SELECT count(*) AS total FROM job_template WHERE user_id = 5 AND project_id IN (1, 27)", "job_template")
def template_count(t):
    return catalog.template_count(t.job_template, user_id=5, project_ids=[1, 27])


@query("project_page", """SELECT p.id, p.name, p.user_id, p.flag, p.create_time, u.username
FROM job_project p JOIN job_user u ON p.user_id = u.id WHERE p.flag = 1 AND p.name LIKE '%1%'
ORDER BY p.create_time DESC, p.id DESC LIMIT 5 OFFSET 2""", "job_project job_user")
def project_page(t):
    return catalog.project_page(t.job_project, t.job_user, "1", 2, 5)


@query("project_list", "SELECT * FROM job_project WHERE flag = 1", "job_project")
def project_list(t):
    return catalog.project_list(t.job_project)


@query("group_search", "SELECT * FROM job_group WHERE app_name LIKE '%app%' AND title LIKE '%A%' AND address_list LIKE '%10.0.0.7%'", "job_group")
def group_search(t):
    return catalog.group_search(t.job_group, "app", "A", "10.0.0.7")


@query("group_list", "SELECT * FROM job_group WHERE address_type = 0 ORDER BY sort_order", "job_group")
def group_list(t):
    return catalog.group_list(t.job_group, 0)


@query("user_page", "SELECT id, username, role, permission FROM job_user WHERE username LIKE '%A%' ORDER BY username LIMIT 3", "job_user")
def user_page(t):
    return catalog.user_page(t.job_user, "A", 0, 3)


@query("user_count", "SELECT count(*) AS total FROM job_user WHERE username LIKE '%A%'", "job_user")
def user_count(t):
    return catalog.user_count(t.job_user, "A")


@query("user_list", "SELECT id, username, role, permission FROM job_user ORDER BY id", "job_user")
def user_list(t):
    return catalog.user_list(t.job_user)


@query("users_by_ids", "SELECT * FROM job_user WHERE id IN (1, 3)", "job_user")
def users_by_ids(t):
    return catalog.users_by_ids(t.job_user, [1, 3])


@query("user_permissions", """WITH mine AS (SELECT job_role_id FROM role_user WHERE job_user_id = 2),
held AS (SELECT m.job_role_id, (SELECT max(id) FROM job_role WHERE id = m.job_role_id) AS known FROM mine m),
granted AS (SELECT h.job_role_id, g.permission_id FROM held h LEFT JOIN job_permission_role g ON g.role_id = h.known),
listed AS (SELECT what.* FROM granted g LEFT JOIN job_permission what ON what.id = g.permission_id)
SELECT id, name, description, url, pid FROM listed
UNION ALL SELECT NULL, NULL, NULL, NULL, NULL FROM job_user WHERE id = 2 AND NOT EXISTS (SELECT 1 FROM mine)""", "job_user role_user job_role job_permission_role job_permission")
def user_permissions(t):
    return catalog.user_permissions(2, t.job_user, t.role_user, t.job_role, t.job_permission_role, t.job_permission)


@query("generic_page", """SELECT id, datasource_name, datasource_group, jdbc_username, jdbc_url, status, comments FROM job_datasource
WHERE datasource_name LIKE '%00%' AND status = 1 ORDER BY datasource_group, id DESC LIMIT 8 OFFSET 8""", "job_datasource")
def generic_page(t):
    return catalog.generic_page(
        t.job_datasource,
        {"current": 2, "size": 8, "ascs": "datasourceGroup", "descs": ["id"], "datasourceName": "00", "status": 1, "comments": " "},
    )


@query("generic_page_deep", """SELECT l_orderkey, l_linenumber, l_shipdate, l_quantity FROM lineitem WHERE l_linenumber <> 7
ORDER BY l_shipdate DESC, l_orderkey, l_linenumber, l_partkey, l_suppkey LIMIT 50 OFFSET 49950""")
def generic_page_deep(t):
    """Page 1000, most of it among rows of equal dates."""
    rows = t.lineitem.where("l_linenumber <> 7").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_quantity")
    order = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    asked = {"current": 1000, "size": 50, "descs": ["l_shipdate"], "ascs": []}
    return catalog.generic_page(rows, asked, key=order).select("l_orderkey", "l_linenumber", "l_shipdate", "l_quantity")


@query("group_in_use", """SELECT g.id, g.app_name, count(j.id) AS jobs,
  count(j.id) = 0 AND (SELECT count(*) FROM job_group) > 1 AS removable
FROM job_group g LEFT JOIN job_info j ON j.job_group = g.id GROUP BY g.id, g.app_name""",
       "job_group job_info")
def group_in_use(t):
    return catalog.group_in_use(t.job_group, t.job_info)


@query("active_datasources", "SELECT id, datasource_name, jdbc_url FROM job_datasource WHERE status = 1", "job_datasource")
def active_datasources(t):
    return catalog.active_datasources(t.job_datasource).select("id", "datasource_name", "jdbc_url")


@query("patch_datasource", """SELECT d.id, coalesce(p.datasource_name, d.datasource_name) AS datasource_name,
  coalesce(p.datasource_group, d.datasource_group) AS datasource_group, d.jdbc_username,
  coalesce(p.jdbc_url, d.jdbc_url) AS jdbc_url, coalesce(p.status, d.status) AS status, d.comments
FROM job_datasource d LEFT JOIN datasource_patch p ON p.id = d.id""", "job_datasource datasource_patch")
def patch_datasource(t):
    return catalog.patch_datasource(t.job_datasource, t.datasource_patch)
