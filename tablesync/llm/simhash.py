"""SimHash near-dedup with pigeonring filtering.

A fingerprint has ``max_bits + 1`` segments on a ring. If two fingerprints differ in at most ``max_bits`` bits, some start
on the ring has every chain of l segments differ in at most ``l * max_bits // segments`` bits. The chains of length one and
two ask for an equal segment whose successor differs in one bit at most, so one half of the successor is equal too: that
pair of values is the join key. Candidates must then keep the budgets of all longer chains from one start, and at last the
whole distance. Fingerprints are made distinct first, so copies cost nothing.

A key shared by more than ``hot`` distinct fingerprints is not paired up. Its fingerprints are linked through the points of
Hamming space instead: two of them are within two bits exactly if one point is within one bit of both. A point has at most
65 fingerprints near it, and each is linked to the smallest of them. Both ways are exact.

Defined results: null and word-free texts have fingerprint zero and are linked like any other. Texts of fewer words than a
shingle are one shingle. Null ids take part, but a component's id is its smallest id that is not null. An empty table gives an empty
result. Repeated rows get the same answer each. Columns other than id and text are not looked at.
"""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablesync.llm.common import append_columns, carried, components, spread
from tablesync.session import materialise

#: Distinct fingerprints under one key from which points replace pairs.
HOT_KEY = 256

SEED = 42


def fingerprint(text: str | None, words: int = 3) -> int:
    """64-bit fingerprint as a signed integer."""
    parts = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    n = len(parts)
    if not n:
        return 0
    whole = b" ".join(parts)
    digest = xxhash.xxh64_intdigest
    if n <= words:
        hashes = [digest(whole, SEED)]
    else:
        lengths = np.fromiter(map(len, parts), np.int64, n)
        ends = np.cumsum(lengths + 1) - 1
        starts = (ends - lengths)[: n - words + 1].tolist()
        hashes = [digest(whole[a:b], SEED) for a, b in zip(starts, ends[words - 1 :].tolist(), strict=True)]
    total = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        block = np.array(hashes[at : at + (1 << 16)], np.uint64)
        total += np.unpackbits(block.view(np.uint8), bitorder="little").reshape(-1, 64).sum(0, dtype=np.int64)
    return int(np.packbits(total * 2 > len(hashes), bitorder="little").view(np.int64)[0])


def with_fingerprint(df: DataFrame, text_col: str = "text", words: int = 3) -> DataFrame:
    """``df`` with its text column replaced by the long column ``fp``."""
    at = df.columns.index(text_col)

    def make():
        return lambda batch: [[fingerprint(t, words) for t in batch.column(at).to_pylist()]]

    return append_columns(df, make, [T.StructField("fp", T.LongType())]).drop(text_col)


def _segments(max_bits: int) -> list[tuple[int, int]]:
    """Offset and width of each segment."""
    m = max_bits + 1
    cuts = [64 * i // m for i in range(m + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:], strict=False)]


def _bits(value: Column, offset: int, width: int) -> Column:
    if width == 64:
        return value
    return F.shiftrightunsigned(value, offset).bitwiseAND(F.lit((1 << width) - 1))


def _keys(fp: Column, max_bits: int) -> list[Column]:
    """Join keys: for each start on the ring the first segment and one half of the second."""
    segments, keys = _segments(max_bits), []
    for i, (offset, width) in enumerate(segments):
        after, wide = segments[(i + 1) % len(segments)]
        half = wide // 2
        for at, bits in ((after, half), (after + half, wide - half)):
            keys.append(F.xxhash64(F.lit(len(keys)), _bits(fp, offset, width), _bits(fp, at, bits)))
    return keys


def _within(a: Column, b: Column, max_bits: int) -> Column:
    """Some chain keeps every budget, and the whole distance fits."""
    differ, segments = a.bitwiseXOR(b), _segments(max_bits)
    m = len(segments)
    each = [F.bit_count(_bits(differ, o, w)) for o, w in segments]
    chains = F.lit(False)
    for i in range(m):
        fits, total = F.lit(True), F.lit(0)
        for length in range(1, m + 1):
            total = total + each[(i + length - 1) % m]
            fits = fits & (total <= length * max_bits // m)
        chains = chains | fits
    return chains & (F.bit_count(differ) <= max_bits)


def _signed(value: int) -> int:
    return value - (1 << 64) if value >= 1 << 63 else value


def near_links(fps: DataFrame, max_bits: int = 2, hot: int = HOT_KEY) -> DataFrame:
    """``(a, b)`` links that connect the distinct fingerprints ``fp`` exactly as all pairs within ``max_bits`` would."""
    if max_bits not in (1, 2):
        raise ValueError("max_bits is 1 or 2")
    fp = F.col("fp")
    keyed = fps.select("fp", F.explode(F.array(*_keys(fp, max_bits))).alias("key"))
    shared = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    keyed = materialise(keyed.join(shared, "key"), "keyed")
    few = keyed.where(F.col("n") <= hot)
    a, b = few.select("key", F.col("fp").alias("a")), few.select("key", F.col("fp").alias("b"))
    pairs = a.join(b, "key").where("a < b").where(_within(F.col("a"), F.col("b"), max_bits)).select("a", "b")
    flips = [_signed(1 << i) for i in range(64)]
    if max_bits == 2:
        points = F.array(fp, *(fp.bitwiseXOR(F.lit(x)) for x in flips))
    else:
        points = F.array(*(F.struct(F.lit(i).alias("bit"), fp.bitwiseOR(F.lit(x)).alias("rest")) for i, x in enumerate(flips)))
    crowd = keyed.where(F.col("n") > hot).select("fp").distinct().select("fp", F.explode(points).alias("point"))
    groups = crowd.groupBy("point").agg(F.collect_list("fp").alias("near")).where(F.size("near") > 1)
    stars = groups.select(F.explode("near").alias("a"), F.array_min("near").alias("b")).where("a <> b")
    return pairs.union(stars).distinct()


def near_groups(fps: DataFrame, id_col: str, max_bits: int = 2, hot: int = HOT_KEY) -> DataFrame:
    """``(fp, component_id)`` for each distinct ``fp`` of a table of ids and fingerprints."""
    nodes = materialise(fps.groupBy("fp").agg(F.min(id_col).alias("least")), "fingerprints")
    linked = components(near_links(nodes.select("fp"), max_bits, hot))
    rooted = nodes.join(linked, nodes.fp == linked.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    smallest = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    return rooted.join(smallest, "root").select("fp", "component_id")


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, max_bits: int = 2, hot: int = HOT_KEY) -> DataFrame:
    """One row per row of ``docs``: id, fingerprint in hex, component_id (the smallest id that is reachable over links)."""
    fps = with_fingerprint(docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")), "text", words)
    fps = materialise(fps, "simhash")
    found = fps.join(near_groups(fps, "id", max_bits, hot), "fp")
    return found.select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, max_bits: int = 2) -> DataFrame:
    """The rows whose id is their component's, with all columns; ids are taken as unique, as after exact dedup.

    Rows with a null id stay only if no row of their component has one.
    """
    fps = with_fingerprint(docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")), "text", words)
    fps = materialise(fps, "simhash")
    stays = fps.join(near_groups(fps, "id", max_bits), "fp").where(F.col("id").eqNullSafe(F.col("component_id"))).select(F.col("id").alias("stays")).distinct()
    rows = carried(docs, id=F.col(id_col))
    return spread(rows.join(stays, F.col("id").eqNullSafe(F.col("stays")), "left_semi"), docs)
