"""Source profiling: columns, keys, inferred shapes, and comparison of two tables."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce
from itertools import combinations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablesync.session import materialise
from tablesync.sinks.publish import path_exists

COLUMN_SCHEMA = "position int, name string, type string, nullable boolean, comment string, is_key boolean, spec string"


def describe_table(df: DataFrame, keys: Iterable[str] | DataFrame = ()) -> DataFrame:
    """One row per column of a table or query, ``spec`` being its ``index:name:type``.

    Taken from the analysed schema; reads no data but that of ``keys``, a list of names or the result of ``candidate_keys``.
    """
    listed = set() if isinstance(keys, DataFrame) else set(keys)
    rows = [
        (i, f.name, f.dataType.simpleString(), f.nullable, (f.metadata or {}).get("comment"), f.name in listed,
         f"{i}:{f.name}:{f.dataType.simpleString()}")
        for i, f in enumerate(df.schema.fields)
    ]
    made = df.sparkSession.createDataFrame(rows, COLUMN_SCHEMA)
    if not isinstance(keys, DataFrame):
        return made
    known = keys.select(F.col("columns").alias("name"), F.col("is_key").alias("_key"))
    return made.join(known, "name", "left").select(*[F.coalesce("_key", F.lit(False)).alias(c) if c == "is_key" else F.col(c) for c in made.columns])


SKETCH_DOUBT = 0.5
"""A combination whose sketch sees fewer distinct values than this share of the rows is no key; sketches are off by five percent or so."""


def _sketched(df: DataFrame, combos: Sequence[tuple[str, ...]]) -> dict[tuple[str, ...], bool]:
    """Whether each combination can be a key, by one scan: no nulls, and a sketch of as many distinct values as rows, about."""
    def value(combo):
        return F.xxhash64(*combo) if len(combo) > 1 else F.col(combo[0])

    singles = sorted({c for combo in combos for c in combo})
    seen = df.agg(
        F.count(F.lit(1)).alias("n"), *[F.count(c).alias(f"c{i}") for i, c in enumerate(singles)],
        *[F.approx_count_distinct(value(combo)).alias(f"d{i}") for i, combo in enumerate(combos)],
    ).first()
    full = {c: seen[f"c{i}"] == seen["n"] for i, c in enumerate(singles)}
    return {combo: all(full[c] for c in combo) and seen[f"d{i}"] >= SKETCH_DOUBT * seen["n"] for i, combo in enumerate(combos)}


def candidate_keys(df: DataFrame, columns: Sequence[str] | None = None, pairs: Sequence[tuple[str, str]] | bool = False) -> DataFrame:
    """Which columns, and on request pairs, are unique and free of nulls.

    One scan counts nulls and distinct values by sketches, which rules out nearly all combinations. A pair of a key and a
    column without nulls is a key itself. What is left is grouped whole, so what is called a key is one.
    ``pairs`` lists the pairs, or asks for all of ``columns``.
    """
    columns = list(columns or df.columns)
    combos = [(c,) for c in columns] + (list(combinations(columns, 2)) if pairs is True else list(pairs or ()))
    can, is_key = _sketched(df, combos), {}
    for combo in sorted(combos, key=len):
        if len(combo) > 1 and can[combo] and any(is_key.get((c,)) for c in combo):
            is_key[combo] = True
        else:
            is_key[combo] = can[combo] and df.groupBy(*combo).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").isEmpty()
    return df.sparkSession.createDataFrame([(",".join(c), is_key[c]) for c in combos], "columns string, is_key boolean")


def key_columns(df: DataFrame, columns: Sequence[str] | None = None) -> list[str]:
    """Names of the single columns that identify a row."""
    return [r["columns"] for r in candidate_keys(df, columns).where("is_key").collect()]


def _by_column(totals: DataFrame, columns: Sequence[str], **measures) -> DataFrame:
    """One wide row of per-column measures into one row per column."""
    rows = [
        F.struct(F.lit(i).alias("position"), F.lit(c).alias("name"), *[measure(c).alias(m) for m, measure in measures.items()])
        for i, c in enumerate(columns)
    ]
    return totals.select(F.inline(F.array(*rows)))


def profile_table(df: DataFrame, columns: Sequence[str] | None = None, exact_distinct: bool = True) -> DataFrame:
    """Rows, nulls, smallest and largest value (as text) and distinct values per column.

    All but the exact distinct counts come from one pass whose tasks each return one row.
    """
    columns = list(columns or df.columns)
    basic = df.agg(
        F.count(F.lit(1)).alias("n"),
        *[F.count(c).alias(f"count_{c}") for c in columns],
        *[F.min(c).cast("string").alias(f"min_{c}") for c in columns],
        *[F.max(c).cast("string").alias(f"max_{c}") for c in columns],
        *([] if exact_distinct else [F.approx_count_distinct(c).alias(f"distinct_{c}") for c in columns]),
    )
    measures = dict(
        row_count=lambda c: F.col("n"), null_count=lambda c: F.col("n") - F.col(f"count_{c}"),
        min_value=lambda c: F.col(f"min_{c}"), max_value=lambda c: F.col(f"max_{c}"),
    )
    if not exact_distinct:
        return _by_column(basic, columns, **measures, distinct_count=lambda c: F.col(f"distinct_{c}"))
    # One grouping for each column: counted in one aggregate they would multiply every row by the number of columns.
    distinct = df.sparkSession.range(1).select(*[df.select(c).distinct().agg(F.count(c)).scalar().alias(f"distinct_{c}") for c in columns])
    per_column = _by_column(distinct, columns, distinct_count=lambda c: F.col(f"distinct_{c}"))
    return _by_column(basic, columns, **measures).join(per_column.drop("position"), "name").select(
        "position", "name", "row_count", "null_count", "min_value", "max_value", "distinct_count"
    )


def _file_measures(columns: Sequence[str]) -> list:
    """Sums and sketches of one file that merge: counts, ends of the range, and a sketch of the distinct values."""
    hashed = lambda c: F.when(F.col(c).isNotNull(), F.xxhash64(c))
    each = [(F.count(c).alias(f"count_{i}"), F.min(c).alias(f"min_{i}"), F.max(c).alias(f"max_{i}"), F.hll_sketch_agg(hashed(c)).alias(f"sketch_{i}")) for i, c in enumerate(columns)]
    return [F.count(F.lit(1)).alias("n"), *(m for four in each for m in four)]


def profile_files(spark: SparkSession, path: str, store: str, columns: Sequence[str] | None = None, file_format: str = "parquet") -> DataFrame:
    """The profile of a table of files, as ``profile_table`` has it with estimated distinct values, from stored profiles of its files.

    ``store`` holds one row per file. Only files it doesn't know are read, and their rows are added; files that are gone are
    left out of the result. Files are told apart by their path, so a file must not be written anew under its old name, which
    Spark never does. A run repeated after a failure adds at most a second row for a file, of which one counts.
    """
    table = spark.read.format(file_format).load(path)
    columns = list(columns or table.columns)
    plain = F.regexp_replace("path", "^([A-Za-z0-9+.-]+):/+", "$1:/").alias("file")  # one way to write a path, whoever tells it
    files = spark.createDataFrame([(f,) for f in table.inputFiles()], "path string").select("path", plain)
    known = spark.read.parquet(store) if path_exists(spark, store) else None
    new = [r.path for r in (files if known is None else files.join(known.select("file"), "file", "left_anti")).collect()]
    if new:
        rows = spark.read.format(file_format).schema(table.schema).load(new).select(*columns, F.col("_metadata.file_path").alias("path")).select(*columns, plain)
        rows.groupBy("file").agg(*_file_measures(columns)).write.mode("append").parquet(store)
        known = spark.read.parquet(store)
    if known is None:
        return profile_table(table, columns, exact_distinct=False)
    kept = known.join(files, "file", "left_semi").dropDuplicates(["file"])
    merged = kept.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n"),
        *[F.coalesce(F.sum(f"count_{i}"), F.lit(0)).alias(f"count_{c}") for i, c in enumerate(columns)],
        *[F.min(f"min_{i}").cast("string").alias(f"min_{c}") for i, c in enumerate(columns)],
        *[F.max(f"max_{i}").cast("string").alias(f"max_{c}") for i, c in enumerate(columns)],
        *[F.coalesce(F.hll_sketch_estimate(F.hll_union_agg(f"sketch_{i}")), F.lit(0)).alias(f"distinct_{c}") for i, c in enumerate(columns)],
    )
    return _by_column(
        merged, columns, row_count=lambda c: F.col("n"), null_count=lambda c: F.col("n") - F.col(f"count_{c}"), min_value=lambda c: F.col(f"min_{c}"),
        max_value=lambda c: F.col(f"max_{c}"), distinct_count=lambda c: F.col(f"distinct_{c}"),
    )


_FIELD_KIND = (
    ("OBJECT", "object"), ("ARRAY", "array"), ("STRING", "string"), ("BOOLEAN", "bool"),
    ("BIGINT", "long"), ("DECIMAL", "double"), ("DOUBLE", "double"),
)


def infer_document_schema(df: DataFrame, column: str) -> DataFrame:
    """Field names and types over all documents of a JSON text column, with how many carry them.

    Null fields are left out and nested documents are not expanded. Text that is no document is counted under the type
    ``invalid`` with a null field.
    """
    docs = df.select(F.try_parse_json(column).alias("doc"), F.col(column).isNotNull().alias("given"))
    fields = docs.sparkSession.sql(
        "SELECT f.key AS field, schema_of_variant(f.value) AS kind FROM {docs}, LATERAL variant_explode(doc) AS f", docs=docs
    )
    kind = F.col("kind")
    for prefix, name in reversed(_FIELD_KIND):
        kind = F.when(F.startswith(F.col("kind"), F.lit(prefix)), name).otherwise(kind)
    found = fields.where("kind <> 'VOID'").groupBy("field", kind.alias("type")).agg(F.count(F.lit(1)).alias("documents"))
    bad = docs.where("given AND doc IS NULL").agg(F.count(F.lit(1)).alias("documents")).where("documents > 0")
    return found.unionByName(bad.select(F.lit(None).cast("string").alias("field"), F.lit("invalid").alias("type"), "documents"))


def merged_document_schema(df: DataFrame, column: str) -> DataFrame:
    """One row: the schema that all documents of a JSON text column share, as Spark merges it; text that is no document is left out."""
    return df.select(F.try_parse_json(column).alias("doc")).agg(F.schema_of_variant_agg("doc").alias("schema"))


def infer_document_schema_nested(df: DataFrame, column: str) -> DataFrame:
    """``(path, type, count)`` of every value inside the documents of a JSON text column, at any depth.

    A path is keys joined by dots, ``[]`` standing for the elements of an array; a key with a dot or a bracket is quoted. Nulls are
    counted as type ``null``. Each round goes one level down and writes what is still nested to the shared folder, so there
    are as many rounds as levels, and no level is parsed twice. Text that is no document is counted as ``invalid``.
    """
    spark = df.sparkSession
    docs = df.select(F.try_parse_json(column).alias("value"), F.col(column).isNotNull().alias("given"))
    bad = docs.where("given AND value IS NULL").agg(F.count(F.lit(1)).alias("count")).where("count > 0")
    levels = [bad.select(F.lit(None).cast("string").alias("path"), F.lit("invalid").alias("type"), "count")]
    kind = F.col("kind")
    for prefix, name in reversed((*_FIELD_KIND, ("VOID", "null"))):
        kind = F.when(F.startswith(F.col("kind"), F.lit(prefix)), name).otherwise(kind)
    level = docs.where("value IS NOT NULL").select(F.lit("").alias("path"), "value")
    while True:
        step = spark.sql(
            """SELECT concat(path, CASE WHEN f.key IS NULL THEN '[]' ELSE concat(CASE WHEN path = '' THEN '' ELSE '.' END,
                 CASE WHEN contains(f.key, '.') OR contains(f.key, '[') THEN concat('"', f.key, '"') ELSE f.key END) END) AS path, f.value AS value, schema_of_variant(f.value) AS kind
               FROM {level}, LATERAL variant_explode(value) AS f""", level=level
        )
        step = materialise(step.select("path", "value", kind.alias("type")), "paths")
        levels.append(step.groupBy("path", "type").agg(F.count(F.lit(1)).alias("count")))
        level = step.where("type IN ('object', 'array')").select("path", "value")
        if level.isEmpty():
            return reduce(DataFrame.unionAll, levels)


def infer_cell_columns(cells: DataFrame) -> DataFrame:
    """``family:qualifier`` of a cell table with the number and share of row keys that fill it."""
    total = cells.agg(F.count_distinct("rowkey")).scalar()
    filled = F.when(F.col("value").isNotNull(), F.col("rowkey"))
    per = cells.groupBy("family", "qualifier").agg(F.count_distinct(filled).alias("filled"))
    return per.select(F.concat("family", F.lit(":"), "qualifier").alias("column"), "filled", (F.col("filled") / total).alias("fill_rate"))


def schema_compat(reader: DataFrame, writer: DataFrame) -> DataFrame:
    """Reader and writer columns side by side by position: same, renamed, type_change, missing or extra.

    ``reader_values`` counts the non-null values a difference affects.
    """
    filled = reader.agg(*[F.count(c).alias(f"count_{c}") for c in reader.columns])
    values = _by_column(filled, reader.columns, reader_values=lambda c: F.col(f"count_{c}")).select("position", "reader_values")
    left = describe_table(reader).select("position", F.col("name").alias("reader_name"), F.col("type").alias("reader_type"))
    right = describe_table(writer).select("position", F.col("name").alias("writer_name"), F.col("type").alias("writer_type"))
    status = (
        F.when(F.col("writer_name").isNull(), "missing").when(F.col("reader_name").isNull(), "extra")
        .when(F.col("reader_type") != F.col("writer_type"), "type_change")
        .when(F.col("reader_name") != F.col("writer_name"), "renamed").otherwise("same")
    )
    pairs = left.join(right, "position", "full").withColumn("status", status)
    return pairs.join(values, "position", "left").select(
        "position", "reader_name", "reader_type", "writer_name", "writer_type", "status", "reader_values"
    )
