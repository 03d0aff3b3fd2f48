import pytest
from pyspark.sql import types as T

#: Columns of documents, and others whose names clash with those that operators make.
DOCS = T.StructType(
    [T.StructField(n, t) for n, t in [("doc_id", T.LongType()), ("text", T.StringType()), ("lang", T.StringType()), ("row", T.StringType()), ("score", T.StringType()), ("kept", T.StringType()), ("id", T.StringType()), ("fp", T.StringType()), ("spans", T.StringType()), ("hash", T.StringType())]]
)


@pytest.fixture
def docs(spark):
    """Documents from ``(doc_id, text)`` or ``(doc_id, text, lang)`` rows, with columns of clashing names."""

    def make(rows, parts=3):
        full = [(r[0], r[1], r[2] if len(r) > 2 else None, "r", "s", "k", "i", "f", "sp", "h") for r in rows]
        return spark.createDataFrame(full, DOCS).repartition(parts)

    return make


ODD = [
    (1, None),
    (2, ""),
    (3, " \n\t "),
    (4, "..."),
    (5, "one"),
    (6, "two words"),
    (7, "Ünï cödé — words ∑ 漢字 and more"),
    (None, "a text without an id"),
    (9, "long " * 30_000),
    (10, "x" * 100_000),
    (11, "same text again"),
    (11, "same text again"),
    (12, "same text again"),
    (-3, "Same text again"),
]


@pytest.fixture
def odd():
    return list(ODD)
