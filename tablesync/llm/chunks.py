"""Substring dedup by content-defined chunking.

A gear rolling hash over the last sixteen bytes decides at each word's start whether a chunk ends there, so the same passage
falls into the same chunks wherever it stands and whatever was inserted before it. A word of over 32 bytes, as in scripts without spaces or encoded data, is taken in pieces that
the same hash cuts between letters, and each piece counts as a word. Chunks have ``least`` to ``most`` words.
They are deduplicated by digest over all documents: a chunk stays in the document with the smallest id that has it. A run of such
later chunks counts as a copied passage if it has at least two chunks and ``passage`` words, so phrases that
chance repeats stay, and a clash of two 64-bit digests alone removes nothing.

Defined results: rows with the same id count as one document, so neither repeats within a document nor repeated rows lose text; a
null id counts as the largest. Null and empty texts have no chunks. An empty
table gives an empty result. Columns other than id and text are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tablesync.session import materialise

#: Words of a chunk, at least and at most, and the share of word starts that end one, as a power of two.
LEAST, MOST, SHARE_BITS = 3, 32, 2
#: Words of a run of copied chunks from which it is removed.
PASSAGE = 20
#: Bytes hashed at a time.
BLOCK = 1 << 20
#: A word of more bytes is taken in pieces of so many bytes on average, each counted as a word.
LONG, PIECE = 32, 6

_GAP = 16
_SPACE = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])


def gear_table(seed: int = 20) -> np.ndarray:
    """A random 32-bit number for each byte."""
    return np.random.default_rng(seed).integers(0, 1 << 32, 256, dtype=np.uint32)


def _ends(raw: np.ndarray, gear: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word starts, those of the pieces of long words among them, and which of them may end a chunk: the rolling hash just before has its leading bits zero."""
    h = np.where(inside, gear[raw], np.uint32(0))
    width = 1
    while width < _GAP:  # h over 2w bytes from h over w bytes
        h[width:] += h[:-width].copy() << np.uint32(width)
        width *= 2
    space = _SPACE[raw] | ~inside
    starts = np.flatnonzero(~space & np.concatenate(([True], space[:-1])))
    ends = np.flatnonzero(space & np.concatenate(([False], ~space[:-1])))
    long = ends - starts > LONG
    if long.any():
        step = np.zeros(len(raw) + 1, np.int8)
        step[starts[long] + _GAP] += 1  # from there on the hash sees this word only
        step[ends[long]] -= 1
        letters = np.flatnonzero((np.cumsum(step[:-1]) > 0) & (raw & 0xC0 != 0x80))
        width = 1 + sum((np.logical_and.reduce([raw[letters - j] & 0xC0 == 0x80 for j in range(1, k + 1)]) for k in (1, 2, 3)), np.zeros(len(letters), np.int64))
        piece = h[letters - 1] >> np.uint32(32 - SHARE_BITS - 8) & np.uint32(255)
        starts = np.union1d(starts, letters[piece < 256 * width // PIECE])
    before = h[starts - 1]
    return starts, (before >> np.uint32(32 - SHARE_BITS) == 0) & inside[starts - 1]


def chunk(texts: list[bytes], gear: np.ndarray, least: int = LEAST, most: int = MOST) -> list[list[tuple[int, int, int]]]:
    """For each text its chunks: from byte, to byte, words. They cover the text from its first word to its end."""
    gap = b"\0" * _GAP
    whole = np.frombuffer(gap + gap.join(texts) + gap, np.uint8)
    sizes = np.array([len(t) for t in texts])
    begins = np.concatenate(([0], np.cumsum(sizes + _GAP)[:-1])) + _GAP
    mark = np.zeros(len(whole) + 1, np.int8)
    np.add.at(mark, begins, 1)
    np.add.at(mark, begins + sizes, -1)
    starts, may = _ends(whole, gear, np.cumsum(mark[:-1]) > 0)
    first = np.searchsorted(starts, begins)
    last = np.searchsorted(starts, begins + sizes)
    cuts = np.flatnonzero(may)
    out = []
    for begin, size, a, b in zip(begins.tolist(), sizes.tolist(), first.tolist(), last.tolist(), strict=True):
        chunks, at = [], a
        mine = cuts[np.searchsorted(cuts, a) : np.searchsorted(cuts, b)].tolist()
        for cut in [*mine, b]:
            while cut - at > most:
                chunks.append((at, at + most))
                at += most
            if cut - at >= least or (cut == b and cut > at):
                chunks.append((at, cut))
                at = cut
        place = starts[a:b].tolist()
        out.append([(place[x - a] - begin, place[y - a] - begin if y < b else size, y - x) for x, y in chunks])
    return out


_CHUNK = [("k", T.IntegerType()), ("from", T.LongType()), ("to", T.LongType()), ("words", T.IntegerType()), ("digest", T.LongType())]


def chunk_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST, most: int = MOST) -> DataFrame:
    """Every chunk of every row: row, id, k (its number in the row), from, to, words, digest."""
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    schema = T.StructType([T.StructField("row", T.LongType()), T.StructField("id", T.LongType()), *(T.StructField(n, t) for n, t in _CHUNK)])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gear, digest = gear_table(), xxhash.xxh3_64_intdigest
        for batch in batches:
            texts = batch.column(2).to_pylist()
            at = 0
            while at < len(texts):
                block, size, begin = [], 0, at
                while at < len(texts) and size < BLOCK:
                    block.append((texts[at] or "").encode("utf-8", "surrogatepass"))
                    size += len(block[-1])
                    at += 1
                take, columns = [], [[], [], [], [], []]
                for r, (text, found) in enumerate(zip(block, chunk(block, gear, least, most), strict=True)):
                    take += [begin + r] * len(found)
                    for k, (a, b, words) in enumerate(found):
                        d = digest(text[a:b].rstrip())
                        for c, v in zip(columns, (k, a, b, words, d - (1 << 64) if d >> 63 else d), strict=True):
                            c.append(v)
                rows = pa.array(take, pa.int64())
                fields = [pa.array(c, f.type) for c, f in zip(columns, list(arrow)[2:], strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), batch.column(1).take(rows), *fields], schema=arrow)

    return rows.mapInArrow(run, schema)


def copied_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", passage: int = PASSAGE, least: int = LEAST, most: int = MOST) -> DataFrame:
    """One row per passage to remove: row, id, from and to (bytes of the UTF-8 text), words, first_id (the document that keeps it)."""
    chunks = materialise(chunk_table(docs, id_col, text_col, least, most), "chunks")
    ordered = F.coalesce("id", F.lit((1 << 63) - 1))
    spread = chunks.select("digest", ordered.alias("order")).groupBy("digest").agg(F.min("order").alias("first_id"), F.max("order").alias("last_id"))
    shared = materialise(spread.where("first_id < last_id").select("digest", "first_id"), "shared")  # on its own it lets Spark split a common chunk
    later = chunks.join(shared, "digest").where(ordered > F.col("first_id"))
    in_row = Window.partitionBy("row").orderBy("k")
    runs = later.withColumn("run", F.col("k") - F.row_number().over(in_row))
    found = runs.groupBy("row", "id", "run").agg(
        F.min("from").alias("from"), F.max("to").alias("to"), F.sum("words").alias("words"), F.count("*").alias("chunks"), F.min("first_id").alias("first_id")
    )
    return found.where((F.col("chunks") >= 2) & (F.col("words") >= passage)).select("row", "id", "from", "to", "words", "first_id")


def without(text: str | None, spans: list[tuple[int, int]]) -> str | None:
    """``text`` without the bytes in ``spans``; chunks begin and end between letters, so no character is cut."""
    if not text or not spans:
        return text
    raw, keep, at = text.encode("utf-8", "surrogatepass"), [], 0
    for a, b in sorted(spans):
        keep.append(raw[at:a])
        at = max(at, b)
    return b"".join([*keep, raw[at:]]).decode("utf-8", "surrogatepass")
