"""Job dependencies, run callbacks and job validation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablesync.operators.common import newest_per_key
from tablesync.operators.runs import NOT_REPORTED, SUCCESS, TIMED_OUT
from tablesync.session import materialise, scratch_path

# Names a job may use.
ROUTE_STRATEGIES = (
    "FIRST", "LAST", "ROUND", "RANDOM", "CONSISTENT_HASH", "LEAST_FREQUENTLY_USED",
    "LEAST_RECENTLY_USED", "FAILOVER", "BUSYOVER", "SHARDING_BROADCAST",
)
BLOCK_STRATEGIES = ("SERIAL_EXECUTION", "DISCARD_LATER", "COVER_EARLY")
GLUE_TYPES = ("BEAN", "GLUE_GROOVY", "GLUE_SHELL", "GLUE_PYTHON", "GLUE_PHP", "GLUE_NODEJS", "GLUE_POWERSHELL")


def _child_ids(column: str = "child_jobid") -> Column:
    """Entries of a comma list; trailing separators end the list, they add no entry."""
    text = F.regexp_replace(F.col(column), ",+$", "")
    return F.when(F.length(F.trim(text)) > 0, F.split(text, ","))


def _as_job_id(entry: Column) -> Column:
    """A positive integer, or null. Blanks inside an entry make it malformed."""
    number = F.when(entry.rlike(r"^[+-]?[0-9]+$"), entry.try_cast("bigint"))
    return F.when(number > 0, number)


def child_edges(jobs: DataFrame) -> DataFrame:
    """One row per entry of each job's child list; ``child_id`` is null where the entry is invalid."""
    entries = jobs.select(F.col("id").alias("parent_id"), F.posexplode(_child_ids()).alias("pos", "entry"))
    child = _as_job_id(F.col("entry"))
    return entries.select("parent_id", (F.col("pos") + 1).alias("position"), "entry", child.alias("child_id"), child.isNotNull().alias("valid"))


def _first_callbacks(callbacks: DataFrame) -> DataFrame:
    return newest_per_key(callbacks, ["log_id"], [F.col("arrival")])


def accepted_callbacks(log: DataFrame, callbacks: DataFrame) -> DataFrame:
    """Callbacks that take effect, with their job: the run exists, has no result yet, and this is the first to arrive."""
    open_runs = log.where(F.col("handle_code") <= NOT_REPORTED).select(F.col("id").alias("log_id"), "job_id")
    return _first_callbacks(callbacks).join(open_runs, "log_id")


def child_triggers(log: DataFrame, callbacks: DataFrame, jobs: DataFrame) -> DataFrame:
    """Child runs to start: one per accepted successful callback and valid child entry."""
    parents = accepted_callbacks(log, callbacks).where(F.col("code") == SUCCESS).select("log_id", "job_id")
    # The child list travels with its job row and is exploded last, after the joins.
    lists = jobs.where(_child_ids().isNotNull()).select(F.col("id").alias("job_id"), _child_ids().alias("children"))
    rows = parents.join(lists, "job_id").select("log_id", F.col("job_id").alias("parent_id"), F.explode("children").alias("entry"))
    return rows.select("log_id", "parent_id", _as_job_id(F.col("entry")).alias("child_id")).where(F.col("child_id").isNotNull())


def invalid_children(jobs: DataFrame) -> DataFrame:
    """Child entries that are malformed, or name a job that does not exist."""
    edges = child_edges(jobs)
    malformed = edges.where(~F.col("valid")).withColumn("reason", F.lit("malformed"))
    known = jobs.select(F.col("id").alias("child_id"))
    missing = edges.where("valid").join(known, "child_id", "left_anti").withColumn("reason", F.lit("missing"))
    columns = ["parent_id", "position", "entry", "reason"]
    return malformed.select(columns).unionByName(missing.select(columns))


def dependency_closure(jobs: DataFrame, root: int) -> DataFrame:
    """All existing descendants of ``root`` with their smallest depth.

    Breadth-first search: each round joins the newest level with the edges, drops jobs already reached and writes the rest to
    the shared folder; so no level is computed twice, a cycle ends by itself, and only a row count returns to the driver.
    """
    spark = jobs.sparkSession
    known = jobs.select(F.col("id").alias("child_id"))
    edges = child_edges(jobs).where("valid").join(known, "child_id", "left_semi")
    edges = materialise(edges.select("parent_id", "child_id").distinct(), "edges")
    reached_schema = "id bigint, depth int"
    frontier = spark.createDataFrame([(root, 0)], reached_schema)
    paths: list[str] = []
    while True:
        depth = len(paths) + 1
        step = edges.join(frontier.select(F.col("id").alias("parent_id")), "parent_id")
        found = step.where(F.col("child_id") != root).select(F.col("child_id").alias("id")).distinct().withColumn("depth", F.lit(depth))
        if paths:
            found = found.join(spark.read.schema(reached_schema).parquet(*paths).select("id"), "id", "left_anti")
        path = scratch_path(spark, "reached")
        found.write.parquet(path)
        paths.append(path)
        frontier = spark.read.schema(reached_schema).parquet(path)
        if frontier.isEmpty():
            return spark.read.schema(reached_schema).parquet(*paths)


def dependency_closure_all(jobs: DataFrame) -> DataFrame:
    """``(ancestor, descendant, depth)`` of all existing jobs, with the smallest depth; a job in a cycle descends from itself.

    Path doubling: a shortest way of more than 2^k steps and at most twice as many is one of exactly 2^k steps and another of
    at most 2^k. So each round joins the pairs of exactly 2^k steps with all pairs so far; rounds grow with the logarithm
    of the longest shortest way, cycles end by themselves, and each round's new pairs are written once.
    """
    spark = jobs.sparkSession
    schema = "ancestor bigint, descendant bigint, depth int"
    known = jobs.select(F.col("id").alias("child_id"))
    edges = child_edges(jobs).where("valid").join(known, "child_id", "left_semi").distinct()
    edges = edges.select(F.col("parent_id").cast("bigint").alias("ancestor"), F.col("child_id").alias("descendant"), F.lit(1).alias("depth")).distinct()
    paths, steps = [scratch_path(spark, "closure")], 1
    edges.write.parquet(paths[0])
    while True:
        pairs = spark.read.schema(schema).parquet(*paths)
        first = pairs.where(F.col("depth") == steps).select("ancestor", F.col("descendant").alias("middle"))
        then = pairs.select(F.col("ancestor").alias("middle"), "descendant", (F.col("depth") + steps).alias("depth"))
        longer = first.join(then, "middle").groupBy("ancestor", "descendant").agg(F.min("depth").alias("depth"))
        path = scratch_path(spark, "closure")
        longer.join(pairs, ["ancestor", "descendant"], "left_anti").write.parquet(path)
        if spark.read.schema(schema).parquet(path).isEmpty():
            return pairs
        paths.append(path)
        steps *= 2


def dependency_cycles(closure: DataFrame) -> DataFrame:
    """Jobs that depend on themselves: ``(id, cycle, jobs)``, the cycle named by its smallest job, with its number of jobs.

    Jobs of one cycle reach each other, so they are the strongly connected components of more than one job, or of a job
    that names itself.
    """
    looped = closure.where("ancestor = descendant").select(F.col("ancestor").alias("id"))
    back = closure.select(F.col("descendant").alias("ancestor"), F.col("ancestor").alias("descendant"))
    mutual = closure.select("ancestor", "descendant").join(back, ["ancestor", "descendant"], "left_semi")
    named = mutual.groupBy(F.col("ancestor").alias("id")).agg(F.min("descendant").alias("cycle"), F.count(F.lit(1)).alias("jobs"))
    return named.join(looped, "id", "left_semi")


def callback_apply(log: DataFrame, callbacks: DataFrame, handle_time, message_limit: int | None = None) -> DataFrame:
    """Runs after applying the accepted callbacks: result, time, and the message appended.

    ``message_limit`` cuts stored messages for a target column of that many characters; without it they stay whole.
    """
    new = _first_callbacks(callbacks).select(F.col("log_id").alias("id"), F.col("code").alias("_code"), F.col("msg").alias("_msg"))
    text = F.concat(F.coalesce(F.concat("handle_msg", F.lit("<br>")), F.lit("")), F.coalesce("_msg", F.lit("")))
    text = text if message_limit is None else F.substring(text, 1, message_limit)
    changed = F.col("_code").isNotNull() & (F.col("handle_code") <= NOT_REPORTED)
    state = {
        "handle_time": F.when(changed, handle_time).otherwise(F.col("handle_time")),
        "handle_code": F.when(changed, F.col("_code")).otherwise(F.col("handle_code")),
        "handle_msg": F.when(changed, text).otherwise(F.col("handle_msg")),
    }
    return log.join(new, "id", "left").select(*[state[c].alias(c) if c in state else F.col(c) for c in log.columns])


def over_column_size(column: Column, size: int) -> Column:
    """Whether a target column of ``size`` characters would not hold the text; nothing is cut."""
    return F.coalesce(F.length(column) > size, F.lit(False))


def timeout_kill_list(log: DataFrame) -> DataFrame:
    """Timed-out runs that still name a process."""
    return log.where((F.col("handle_code") == TIMED_OUT) & (F.length("process_id") > 0))


def duplicate_triggers(triggers: DataFrame) -> DataFrame:
    """Log ids triggered more than once, with the number of rejected repeats."""
    return triggers.groupBy("log_id").agg((F.count(F.lit(1)) - 1).alias("rejected")).where("rejected > 0")


def accepted_triggers(triggers: DataFrame) -> DataFrame:
    """Triggers without repeats of a log id."""
    return triggers.dropDuplicates(["log_id"])


def job_validation(jobs: DataFrame) -> DataFrame:
    """Every job that breaks a rule, with the array of rules it breaks."""

    def is_blank(column):
        return F.length(F.trim(F.coalesce(F.col(column), F.lit("")))) == 0

    def unknown(column, names):
        return F.coalesce(~F.col(column).isin(*names), F.lit(True))

    bean = F.col("glue_type") == "BEAN"
    bad_child = F.exists(_child_ids(), lambda entry: _as_job_id(entry).isNull())
    rules = {
        "job_json_missing": bean & (F.length(F.trim(F.coalesce("job_json", F.lit("")))) <= 2),
        "description_missing": is_blank("job_desc"),
        "user_missing": F.coalesce("user_id", F.lit(0)) == 0,
        "route_strategy_unknown": unknown("executor_route_strategy", ROUTE_STRATEGIES),
        "block_strategy_unknown": unknown("executor_block_strategy", BLOCK_STRATEGIES),
        "glue_type_unknown": unknown("glue_type", GLUE_TYPES),
        "handler_missing": bean & is_blank("executor_handler"),
        "child_invalid": bad_child,
    }
    broken = F.filter(F.array(*[F.when(cond, name) for name, cond in rules.items()]), lambda r: r.isNotNull())
    return jobs.select("id", broken.alias("broken_rules")).where(F.size("broken_rules") > 0)
