"""Exact dedup by an extendible-hash index on shared files.

Every text gets a 64-bit hash, whose leading bits name a bucket, and a SHA-256 digest. The directory starts at a depth that
fits the number of keys; buckets that hold more than ``capacity`` keys are split by doubling it. The tasks that own a range
of buckets chain the texts of a key and compare their bytes (grouping by text). Index and directory are tables in the
shared folder; the chains are summed up before the shuffle, so a group of copies costs one row a task.

Defined results: null counts as empty text. The row with the largest id stays; null ids lose against any other. Rows that repeat
both id and text are copies like any other, and exactly one of them is kept. An empty table gives an empty result. Columns other
than id and text are not looked at.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablesync.llm.common import carried, spread
from tablesync.session import materialise

#: Keys a bucket holds before it is split.
CAPACITY = 1 << 16

KEY = ["hash", "digest"]


@dataclass
class Index:
    """``keys``: hash, digest, keep_id, group_size, n_keep, bucket. ``directory``: slot, bucket. ``chains``: only for keys of several texts, by text."""

    keys: DataFrame
    directory: DataFrame
    depth: int
    chains: DataFrame | None
    repeats: bool


def _hash(text: Column) -> Column:
    return F.xxhash64(text)


def _digest(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def _entries(docs: DataFrame, id_col: str, text_col: str, hash_of=_hash, digest_of=_digest) -> DataFrame:
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(F.col(id_col).alias("id"), text.alias("text")).select("id", "text", hash_of(F.col("text")).alias("hash"), digest_of(F.col("text")).alias("digest"))


def _prefix(depth: int) -> Column:
    return F.shiftrightunsigned("hash", 64 - depth) if depth else F.lit(0).cast("long")


def build_directory(keys: DataFrame, capacity: int = CAPACITY) -> tuple[DataFrame, int]:
    """Directory ``(slot, bucket)`` over the leading bits of ``hash`` and its depth; a bucket is named by its bits."""
    depth = max(0, math.ceil(math.log2(max(1.0, keys.count() / capacity))) - 1)
    leaves, hashes = [], keys.select("hash")
    while True:
        counts = materialise(hashes.groupBy(_prefix(depth).alias("p")).count(), "buckets")
        over = counts.where(F.col("count") > capacity)
        full = depth < 63 and not over.isEmpty()
        leaves.append((depth, counts.where(F.col("count") <= capacity) if full else counts))
        if not full:
            break
        hashes = hashes.join(over.select("p"), _prefix(depth) == F.col("p"), "left_semi")
        depth += 1
    slots = [
        leaf.select(
            F.explode(F.sequence(F.shiftleft("p", depth - d), F.shiftleft(F.col("p") + 1, depth - d) - 1)).alias("slot"),
            (F.lpad(F.bin("p"), d, "0") if d else F.lit("")).alias("bucket"),
        )
        for d, leaf in leaves
    ]
    directory = slots[0]
    for more in slots[1:]:
        directory = directory.union(more)
    return materialise(directory, "directory"), depth


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, hash_of=_hash, digest_of=_digest) -> tuple[Index, DataFrame]:
    """The index of all texts, and the entries ``(id, hash, digest)`` it was made from. ``hash_of`` and ``digest_of`` can be replaced in tests."""
    rows = _entries(docs, id_col, text_col, hash_of, digest_of)
    entries = materialise(rows.select("id", *KEY), "entries")
    by_id = entries.groupBy(*KEY, "id").agg(F.count("*").alias("n"))
    keys = by_id.groupBy(*KEY).agg(F.max("id").alias("keep_id"), F.sum("n").alias("group_size"), F.coalesce(F.max_by("n", "id"), F.max("n")).alias("n_keep"))
    keys = materialise(keys, "keys")
    directory, depth = build_directory(keys, capacity)
    found = keys.withColumn("slot", _prefix(depth)).join(directory, "slot").drop("slot")
    index = materialise(found.repartitionByRange("bucket", "hash").sortWithinPartitions("bucket", "hash"), "index")
    texts = rows.groupBy(*KEY, "text").agg(F.count("*").alias("n"))
    collided = materialise(texts.groupBy(*KEY).agg(F.count("*").alias("texts")).where("texts > 1"), "collided")
    chains = None
    if not collided.isEmpty():
        each = rows.join(collided.select(*KEY), KEY, "left_semi").groupBy(*KEY, "text", "id").agg(F.count("*").alias("n"))
        chains = each.groupBy(*KEY, "text").agg(F.max("id").alias("keep_id"), F.sum("n").alias("group_size"), F.coalesce(F.max_by("n", "id"), F.max("n")).alias("n_keep"))
        chains = materialise(chains, "chains")
    repeats = not index.where("n_keep > 1").isEmpty() or (chains is not None and not chains.where("n_keep > 1").isEmpty())
    return Index(index, directory, depth, chains, repeats), entries


def _found(rows: DataFrame, index: Index, with_text: DataFrame | None) -> DataFrame:
    """``rows`` (id, hash, digest and more) with keep_id, group_size and kept; ``with_text`` has the same rows with their texts."""
    plain = index.keys
    if index.chains is not None:
        plain = plain.join(index.chains.select(*KEY).distinct(), KEY, "left_anti")
    found = rows.join(plain.drop("bucket"), KEY)
    if index.chains is not None:
        found = found.unionByName(with_text.join(index.chains, [*KEY, "text"]).drop("text"))
    found = found.withColumn("kept", F.col("id").eqNullSafe(F.col("keep_id")))
    if index.repeats:
        tied = F.col("kept") & (F.col("n_keep") > 1)
        one = Window.partitionBy(*KEY, "group_size", "keep_id").orderBy("id")
        found = found.where(~tied).unionByName(found.where(tied).withColumn("kept", F.row_number().over(one) == 1))
    return found


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, hash_of=_hash, digest_of=_digest) -> DataFrame:
    """One row per row of ``docs``: id, keep_id, group_size, kept, and the SHA-256 of the text in hex."""
    index, entries = build_index(docs, id_col, text_col, capacity, hash_of, digest_of)
    texts = _entries(docs, id_col, text_col, hash_of, digest_of)
    if index.chains is None:
        found = _found(entries, index, None).withColumn("text_sha256", F.lower(F.hex("digest")))
    else:
        entries = texts.withColumn("text_sha256", F.sha2("text", 256))
        found = _found(entries.drop("text"), index, entries)
    return found.select(F.col("id").alias(id_col), "keep_id", "group_size", "kept", "text_sha256")


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns."""
    index, _ = build_index(docs, id_col, text_col, capacity)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = carried(docs, id=F.col(id_col), text=text).withColumns({"hash": _hash(F.col("text")), "digest": _digest(F.col("text"))})
    return spread(_found(rows.drop("text"), index, rows).where("kept"), docs)


ORACLE = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""
