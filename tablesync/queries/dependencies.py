"""Registered queries over dependencies and callbacks."""

from pyspark.sql import functions as F

from tablesync.operators import dependencies as deps
from tablesync.operators.common import ntz
from tablesync.queries.registry import NOW, query

_VALID = "regexp_full_match(e.entry, '[+-]?[0-9]+') AND coalesce(TRY_CAST(e.entry AS BIGINT), 0) > 0"


def _edges(view):
    return f"""SELECT e.parent_id, e.position, e.entry, CASE WHEN {_VALID} THEN TRY_CAST(e.entry AS BIGINT) END AS child_id, {_VALID} AS valid
FROM (SELECT id AS parent_id, CAST(generate_subscripts(l, 1) AS INTEGER) AS position, unnest(l) AS entry
      FROM (SELECT id, string_split(child_jobid, ',') AS l FROM {view})) e"""


_ACCEPTED = """SELECT c.log_id, c.code, c.msg FROM callbacks c JOIN job_log l ON l.id = c.log_id AND l.handle_code = 0
QUALIFY row_number() OVER (PARTITION BY c.log_id ORDER BY c.arrival) = 1"""


@query("child_edges", _edges("job_info"), "job_info")
def child_edges(t):
    return deps.child_edges(t.job_info)


@query("child_triggers", f"""SELECT a.log_id, e.parent_id, e.child_id FROM ({_ACCEPTED}) a JOIN job_log l ON l.id = a.log_id
JOIN ({_edges('job_info')}) e ON e.parent_id = l.job_id AND e.valid WHERE a.code = 200""", "job_log callbacks job_info")
def child_triggers(t):
    return deps.child_triggers(t.job_log, t.callbacks, t.job_info)


@query("invalid_children", f"""SELECT parent_id, position, entry, CASE WHEN valid THEN 'missing' ELSE 'malformed' END AS reason
FROM ({_edges('job_info')}) WHERE NOT valid OR child_id NOT IN (SELECT id FROM job_info)""", "job_info")
def invalid_children(t):
    return deps.invalid_children(t.job_info)


@query("dependency_closure", f"""
WITH RECURSIVE edges AS (SELECT DISTINCT parent_id, child_id FROM ({_edges('job_tree')}) WHERE valid AND child_id IN (SELECT id FROM job_tree)),
reach(id, depth) AS (SELECT 1, 0 UNION SELECT e.child_id, r.depth + 1 FROM reach r JOIN edges e ON e.parent_id = r.id WHERE r.depth < 48)
SELECT id, min(depth) AS depth FROM reach WHERE id <> 1 GROUP BY id""", "job_tree")
def dependency_closure(t):
    return deps.dependency_closure(t.job_tree, 1)


_REACH = f"""WITH RECURSIVE edges AS (SELECT DISTINCT parent_id, child_id FROM ({_edges('job_chain')}) WHERE valid AND child_id IN (SELECT id FROM job_chain)),
reach(ancestor, descendant, depth) AS (SELECT parent_id, child_id, 1 FROM edges
  UNION SELECT r.ancestor, e.child_id, r.depth + 1 FROM reach r JOIN edges e ON e.parent_id = r.descendant WHERE r.depth < 24)
SELECT ancestor, descendant, min(depth) AS depth FROM reach GROUP BY ancestor, descendant"""


@query("dependency_closure_all", _REACH, "job_chain")
def dependency_closure_all(t):
    return deps.dependency_closure_all(t.job_chain)


@query("dependency_cycles", f"""SELECT a.ancestor AS id, min(a.descendant) AS cycle, count(*) AS jobs FROM ({_REACH}) a
JOIN ({_REACH}) b ON b.ancestor = a.descendant AND b.descendant = a.ancestor
WHERE a.ancestor IN (SELECT ancestor FROM ({_REACH}) WHERE ancestor = descendant) GROUP BY a.ancestor""", "job_chain")
def dependency_cycles(t):
    return deps.dependency_cycles(deps.dependency_closure_all(t.job_chain))


@query("callback_first_wins", _ACCEPTED, "callbacks job_log")
def callback_first_wins(t):
    return deps.accepted_callbacks(t.job_log, t.callbacks).select("log_id", "code", "msg")


@query("callback_apply", f"""SELECT l.id, CASE WHEN a.code IS NULL THEN l.handle_time ELSE TIMESTAMP '{NOW}' END AS handle_time,
  coalesce(a.code, l.handle_code) AS handle_code,
  CASE WHEN a.code IS NULL THEN l.handle_msg
       ELSE coalesce(l.handle_msg || '<br>', '') || coalesce(a.msg, '') END AS handle_msg
FROM job_log l LEFT JOIN ({_ACCEPTED}) a ON a.log_id = l.id""", "callbacks job_log")
def callback_apply(t):
    return deps.callback_apply(t.job_log, t.callbacks, ntz(NOW)).select("id", "handle_time", "handle_code", "handle_msg")


@query("callback_message_cap", """SELECT doc_id, length(text) AS msg_length, coalesce(length(text) > 50000, FALSE) AS over_size, md5(text) AS digest FROM documents""")
def callback_message_cap(t):
    """Whole messages, and which of them a column of 50 000 characters would not hold."""
    return t.documents.select(
        "doc_id", F.length("text").cast("bigint").alias("msg_length"), deps.over_column_size(F.col("text"), 50_000).alias("over_size"), F.md5("text").alias("digest")
    )


@query("timeout_kill_list", "SELECT id, job_id, executor_address, process_id FROM job_log WHERE handle_code = 502 AND process_id <> ''", "job_log")
def timeout_kill_list(t):
    return deps.timeout_kill_list(t.job_log).select("id", "job_id", "executor_address", "process_id")


@query("duplicate_triggers", "SELECT log_id, count(*) - 1 AS rejected FROM callbacks GROUP BY log_id HAVING count(*) > 1", "callbacks")
def duplicate_triggers(t):
    return deps.duplicate_triggers(t.callbacks)


@query("job_validation", f"""
SELECT * FROM (SELECT id, concat_ws(',',
  CASE WHEN glue_type = 'BEAN' AND length(trim(coalesce(job_json, ''))) <= 2 THEN 'job_json_missing' END,
  CASE WHEN trim(coalesce(job_desc, '')) = '' THEN 'description_missing' END,
  CASE WHEN coalesce(user_id, 0) = 0 THEN 'user_missing' END,
  CASE WHEN coalesce(executor_route_strategy, '') NOT IN ('FIRST', 'ROUND') THEN 'route_strategy_unknown' END,
  CASE WHEN coalesce(executor_block_strategy, '') NOT IN ('COVER_EARLY', 'SERIAL_EXECUTION') THEN 'block_strategy_unknown' END,
  CASE WHEN glue_type NOT IN ('BEAN', 'GLUE_SHELL') THEN 'glue_type_unknown' END,
  CASE WHEN glue_type = 'BEAN' AND trim(coalesce(executor_handler, '')) = '' THEN 'handler_missing' END,
  CASE WHEN id IN (SELECT parent_id FROM ({_edges('job_form')}) WHERE NOT valid) THEN 'child_invalid' END) AS broken
FROM job_form) WHERE broken <> ''""", "job_form")
def job_validation(t):
    return deps.job_validation(t.job_form).select("id", F.array_join("broken_rules", ",").alias("broken"))
