"""Line dedup: repeated runs of lines from a suffix array over line ids, by distributed prefix doubling.

Every line has an id, its place in the order of line hashes; a document is a sequence of ids that nothing crosses. The suffixes
of all sequences are ranked by their first line, then by twice as many lines with each round: a suffix's new rank is its old one
refined by the rank of the suffix that starts where its known lines end. Suffixes that share their lines with no other
are settled and leave. After the rounds, suffixes of equal rank are the intervals of the suffix array whose longest
common prefix is ``least`` lines or more. In each interval the first suffix stays, and the lines of later ones are deleted;
overlapping and touching ones join to maximal runs. With ``words``, shorter runs count too if they hold that many words; the
ranks then grow by one line a round, so that every length below ``least`` is looked at.

Only DataFrame functions are used. Ranks are running totals over pre-aggregated (rank, next rank) groups, so a common line
is one group a task and not one row a document.

Defined results: the first copy is the one with the smallest (id, row, line), null ids last; repeated rows are copies like any
other. Lines are what stands between line feeds, blank ones included. Null and empty texts have no lines. An empty table gives
an empty result. Columns other than id and text are not looked at.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablesync.session import materialise

#: Lines of the shortest run that counts whatever it holds, and words from which fewer lines count too.
LEAST = 3
WORDS = 51
#: Ranks that agree but for their last bits form a block.
BLOCK_BITS = 10


def line_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *more: Column) -> DataFrame:
    """Every line: row, id, at (its number in the row), 128 bits of hash, and ``more`` made from ``line``."""
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    lines = rows.where("text <> ''").select("row", "id", F.posexplode(F.split("text", "\n")).alias("at", "line"))
    return lines.select("row", "id", "at", F.xxhash64("line").alias("h"), F.xxhash64(F.lit(1), "line").alias("g"), *more)


def _line_ranks(lines: DataFrame) -> DataFrame:
    """``(h, g, rank)`` of the lines that occur more than once: how many such lines come before, in the order of hashes."""
    repeated = lines.groupBy("h", "g").agg(F.count("*").alias("n")).where("n > 1").withColumn("part", F.shiftright("h", 52))
    repeated = materialise(repeated, "repeated")
    parts = repeated.groupBy("part").agg(F.sum("n").alias("n"))  # 4096 rows at most
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("below"))
    inside = Window.partitionBy("part").orderBy("h", "g").rowsBetween(Window.unboundedPreceding, -1)
    ranked = repeated.withColumn("inside", F.coalesce(F.sum("n").over(inside), F.lit(0))).join(F.broadcast(parts), "part")
    return ranked.select("h", "g", (F.col("below") + F.col("inside")).alias("rank"))


def _next(step: int) -> Column:
    """Rank of the suffix ``step`` lines on, null if it is settled or the document ends."""
    on = Window.partitionBy("row").orderBy("at")
    # settled suffixes are missing, so the wanted one is at most ``step`` rows ahead
    found = [F.when(F.lead("at", k).over(on) == F.col("at") + step, F.lead("rank", k).over(on)) for k in range(1, step + 1)]
    return F.coalesce(*found)


def _refined(classes: DataFrame) -> DataFrame:
    """``(rank, next, refined)``: the rank plus how many suffixes of the class continue with a smaller one.

    A common line has many continuations, so a class is summed up in blocks of ``next`` first, and then over its blocks.
    """
    upto = (Window.unboundedPreceding, -1)
    blocked = classes.withColumn("block", F.shiftright("next", BLOCK_BITS))
    inside = Window.partitionBy("rank", "block").orderBy("next").rowsBetween(*upto)
    blocks = blocked.groupBy("rank", "block").agg(F.sum("n").alias("n"))
    before = Window.partitionBy("rank").orderBy("block").rowsBetween(*upto)
    blocks = blocks.select("rank", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("below"))
    counted = blocked.withColumn("inside", F.coalesce(F.sum("n").over(inside), F.lit(0))).join(blocks, ["rank", "block"])
    return counted.select("rank", "next", (F.col("rank") + F.col("below") + F.col("inside")).alias("refined"))


def _refined_by(suffixes: DataFrame, step: int, *carry: str) -> DataFrame:
    """Suffixes that agree in ``step`` more lines with another one, ranked by these too."""
    pairs = materialise(suffixes.withColumn("next", _next(step)).where("next IS NOT NULL"), "suffixes")
    classes = pairs.groupBy("rank", "next").agg(F.count("*").alias("n")).where("n > 1")
    refined = materialise(_refined(classes), "classes")  # read from files, both sides of the join are dealt out and a common line can be split
    return pairs.join(refined, ["rank", "next"]).select("row", "id", "at", F.col("refined").alias("rank"), *carry)


def ranked_suffixes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST) -> DataFrame:
    """Suffixes whose first ``least`` lines occur more than once: row, id, at, rank by those lines."""
    lines = materialise(line_table(docs, id_col, text_col), "lines")
    suffixes = lines.join(_line_ranks(lines), ["h", "g"]).select("row", "id", "at", "rank")
    known = 1
    while known < least:
        step = min(known, least - known)
        suffixes = _refined_by(suffixes, step)
        known += step
    return materialise(suffixes, "suffixes")


def _later(suffixes: DataFrame, *carry: str) -> DataFrame:
    """Suffixes that are not the first of their rank."""
    place = F.struct(F.col("id").isNull().alias("none"), F.col("id").alias("id"), F.col("row").alias("row"), F.col("at").alias("at"))
    first = materialise(suffixes.groupBy("rank").agg(F.min(place).alias("first")), "first")
    return suffixes.join(first, "rank").where(place > F.col("first")).select("row", "id", "at", *carry)


def _later_by_words(docs: DataFrame, id_col: str, text_col: str, least: int, words: int) -> DataFrame:
    """``(row, id, at, to)`` of later copies of ``least`` lines, and of fewer lines that hold ``words`` words."""
    lines = line_table(docs, id_col, text_col, F.regexp_count("line", F.lit(r"\S+")).alias("words"))
    on = Window.partitionBy("row").orderBy("at")
    held = [sum((F.lead("words", j, 0).over(on) for j in range(1, k)), F.col("words")) >= words for k in range(1, least)]
    lines = materialise(lines.withColumn("enough", F.array(*held, F.lit(True))).drop("words"), "lines")
    suffixes = materialise(lines.join(_line_ranks(lines), ["h", "g"]).select("row", "id", "at", "rank", "enough"), "suffixes")
    found = []
    for known in range(1, least + 1):
        if known > 1:
            suffixes = materialise(_refined_by(suffixes, 1, "enough"), "suffixes")
        # the copy that stays holds the same words, so all of its class can go
        found.append(_later(suffixes.where(F.col("enough")[known - 1])).withColumn("to", F.col("at") + known))
    return reduce(DataFrame.union, found)


def repeated_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST, words: int | None = None) -> DataFrame:
    """One row per run of lines to delete: row, id, first_line, n_lines."""
    in_row = Window.partitionBy("row").orderBy("at")
    if words is None:
        later = _later(ranked_suffixes(docs, id_col, text_col, least)).withColumn("to", F.col("at") + least)
        opens = F.col("at") > F.lag("to").over(in_row)
    else:
        later = _later_by_words(docs, id_col, text_col, least, words)
        opens = F.col("at") > F.max("to").over(in_row.rowsBetween(Window.unboundedPreceding, -1))
    in_run = in_row.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    runs = later.withColumn("opens", F.coalesce(opens, F.lit(True)).cast("int")).withColumn("run", F.sum("opens").over(in_run))
    return runs.groupBy("row", "id", "run").agg(F.min("at").alias("first_line"), (F.max("to") - F.min("at")).alias("n_lines")).drop("run")


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST, words: int | None = None) -> DataFrame:
    """One row per deleted run: id, first_line (from 0), n_lines."""
    found = repeated_runs(docs, id_col, text_col, least, words)
    return found.select(F.col("id").alias(id_col), F.col("first_line").cast("long").alias("first_line"), F.col("n_lines").cast("long").alias("n_lines"))


def kept_lines(text: Column, runs: Column) -> Column:
    """``text`` without the lines of ``runs``, an array of structs with first_line and n_lines."""
    lines = F.split(text, "\n")
    stays = F.filter(lines, lambda _, i: ~F.exists(runs, lambda r: (i >= r["first_line"]) & (i < r["first_line"] + r["n_lines"])))
    return F.array_join(stays, "\n")


ORACLE = r"""
WITH lines AS (
  SELECT doc_id, pos, line, len(regexp_extract_all(line, '[^ \t\n\x0B\f\r]+')) AS words
  FROM (SELECT doc_id, generate_subscripts(l, 1) - 1 AS pos, unnest(l) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE text <> ''))),
ahead AS (SELECT *, lead(line) OVER w AS b, lead(line, 2) OVER w AS c, lead(words) OVER w AS words_b FROM lines WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
one AS (SELECT doc_id, pos, pos + 1 AS upto, row_number() OVER (PARTITION BY line ORDER BY doc_id, pos) AS n FROM ahead WHERE words >= 51),
two AS (SELECT doc_id, pos, pos + 2 AS upto, row_number() OVER (PARTITION BY line, b ORDER BY doc_id, pos) AS n FROM ahead WHERE b IS NOT NULL AND words + words_b >= 51),
three AS (SELECT doc_id, pos, pos + 3 AS upto, row_number() OVER (PARTITION BY line, b, c ORDER BY doc_id, pos) AS n FROM ahead WHERE c IS NOT NULL),
later AS (SELECT doc_id, pos, max(upto) AS upto FROM (FROM one UNION ALL FROM two UNION ALL FROM three) WHERE n > 1 GROUP BY doc_id, pos),
opened AS (
  SELECT *, CASE WHEN pos <= max(upto) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS opens FROM later),
grouped AS (SELECT *, sum(opens) OVER (PARTITION BY doc_id ORDER BY pos) AS run FROM opened)
SELECT doc_id, CAST(min(pos) AS BIGINT) AS first_line, CAST(max(upto) - min(pos) AS BIGINT) AS n_lines FROM grouped GROUP BY doc_id, run
"""
