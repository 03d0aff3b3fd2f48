"""Language ID by prediction by partial matching over bytes.

Every language has a tree of byte contexts up to three bytes long, with counts from all its training texts (A-Z in lower
case). A byte's code length under a language is that of the longest known context: the byte's share there, or, if it was
never seen there, the escape's share (escapes count as often as there are different bytes, method C) and the code length
after one byte less, down to one of 256. The statistics are frozen, so a language's code lengths are one sorted table for each
order of context, and a text is scored by looking up its different stretches of four bytes. The language with the
shortest code wins.

Counts are taken in the tasks and summed up in Spark over every training row. All counted stretches are kept, so the model grows
with what the training texts hold: about 16 bytes for each stretch on the driver, 50 in each Python worker.

Defined results: null texts, texts without a letter, and all texts if nothing could be learned are ``und`` with score 0. Rows with a
null id are predicted but not learned from. Ties go to the first language by name.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablesync.llm.common import append_columns, worker_store
from tablesync.session import materialise

UNKNOWN = "und"
#: Bytes of context.
ORDER = 3
#: Bytes counted or scored at a time.
BLOCK = 1 << 20

_START = b"   "


def held_out(doc_id: Column) -> Column:
    """Rows that are never learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def _raw(text: str) -> bytes:
    return text.encode("utf-8", "surrogatepass").lower()


def _count(block: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Stretches of four bytes, as numbers, and how often they occur; the first bytes of a text follow three spaces."""
    raw = np.frombuffer(b"".join(_START + x for x in block), np.uint8).astype(np.uint32)
    if len(raw) < 4:
        return np.zeros(0, np.uint32), np.zeros(0, np.int64)
    grams = raw[:-3] << 24 | raw[1:-2] << 16 | raw[2:-1] << 8 | raw[3:]
    inside = np.ones(len(grams), bool)
    ends = np.cumsum([len(x) + 3 for x in block])[:-1]
    for back in (3, 2, 1):  # stretches that reach into the next text's spaces
        inside[ends - back] = False
    return np.unique(grams[inside], return_counts=True)


def _sum(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    grams, back = np.unique(np.concatenate([g for g, _ in parts]), return_inverse=True)
    return grams, np.bincount(back, np.concatenate([n for _, n in parts])).astype(np.int64)


def count_grams(rows: DataFrame) -> DataFrame:
    """``(lang, gram, n)`` over all rows ``(lang, text)``."""
    schema = pa.schema([("lang", pa.string()), ("gram", pa.int64()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: dict[str, list[bytes]] = {}
        sizes: dict[str, int] = {}
        sums: dict[str, tuple[np.ndarray, np.ndarray]] = {}

        def add(lang: str) -> None:
            if block := waiting.pop(lang, None):
                sizes[lang] = 0
                part = _count(block)
                sums[lang] = _sum([sums[lang], part]) if lang in sums else part

        def out(lang: str) -> pa.RecordBatch:
            grams, n = sums.pop(lang)
            return pa.RecordBatch.from_arrays([pa.array([lang] * len(grams), pa.string()), pa.array(grams.astype(np.int64)), pa.array(n)], schema=schema)

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                raw = _raw(text)
                waiting.setdefault(lang, []).append(raw)
                sizes[lang] = sizes.get(lang, 0) + len(raw)
                if sizes[lang] >= BLOCK:
                    add(lang)
                    if len(sums[lang][0]) > BLOCK:
                        yield out(lang)
        for lang in [*waiting]:
            add(lang)
        for lang in [*sums]:
            yield out(lang)

    counted = rows.select("lang", "text").mapInArrow(run, "lang string, gram long, n long")
    return counted.groupBy("lang", "gram").agg(F.sum("n").alias("n"))


@dataclass
class Counts:
    """Stretches and counts of each language, the languages in order."""

    languages: list[str]
    grams: list[np.ndarray]
    counts: list[np.ndarray]

    def digest(self) -> str:
        h = hashlib.sha256(repr(self.languages).encode())
        for a in (*self.grams, *self.counts):
            h.update(a.tobytes())
        return h.hexdigest()


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Counts:
    """Counts over every row that has text, lang and id and is not held out."""
    rows = docs.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"), F.col(id_col).alias("id"))
    rows = rows.where("lang IS NOT NULL AND text IS NOT NULL AND id IS NOT NULL").where(~held_out(F.col("id")))
    counted = materialise(count_grams(rows), "grams")
    languages = sorted(r.lang for r in counted.select("lang").distinct().toLocalIterator())
    out = Counts(languages, [], [])
    for lang in languages:
        found = counted.where(F.col("lang") == lang).select("gram", "n").toArrow()
        gram, n = (found.column(c).to_numpy() for c in ("gram", "n"))
        order = np.argsort(gram)
        out.grams.append(gram[order].astype(np.int64))
        out.counts.append(n[order].astype(np.int64))
    return out


def _at(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the wanted numbers are in the sorted keys, and which of them are there."""
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return at, keys[at] == wanted


class Tables:
    """Code lengths of each language and order: of (context, byte) pairs, and of the escape of each context."""

    def __init__(self, counts: Counts):
        self.orders = [[self._order(g, n, order) for order in range(ORDER, -1, -1)] for g, n in zip(counts.grams, counts.counts, strict=True)]

    @staticmethod
    def _order(grams: np.ndarray, n: np.ndarray, order: int) -> tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        mask = (1 << 8 * (order + 1)) - 1
        pairs, c = (grams, n) if order == ORDER else _sum([(grams & mask, n)])
        contexts, of = np.unique(pairs >> 8, return_inverse=True)
        whole, different = np.bincount(of, c, len(contexts)), np.bincount(of, minlength=len(contexts))
        bits = -np.log2(c / (whole + different)[of])
        return mask, pairs.astype(np.uint32), bits.astype(np.float32), contexts.astype(np.uint32), np.log2((whole + different) / different).astype(np.float32)

    def _bits(self, grams: np.ndarray) -> np.ndarray:
        """Code length of the last byte of each stretch under each language."""
        out = np.zeros((len(grams), len(self.orders)))
        for lang, orders in enumerate(self.orders):
            left = np.arange(len(grams))
            for mask, pairs, bits, contexts, escapes in orders:
                wanted = grams[left] & np.uint32(mask)
                at, seen = _at(pairs, wanted)
                out[left[seen], lang] += bits[at[seen]]
                left, wanted = left[~seen], wanted[~seen]
                at, known = _at(contexts, wanted >> np.uint32(8))
                out[left[known], lang] += escapes[at[known]]
            out[left, lang] += 8.0
        return out

    def bits_of(self, block: list[bytes]) -> np.ndarray:
        """Code length of each text under each language."""
        sizes = np.array([len(x) for x in block])
        raw = np.frombuffer(b"".join(_START + x for x in block), np.uint8).astype(np.uint32)
        grams, back = np.unique(raw[:-3] << 24 | raw[1:-2] << 16 | raw[2:-1] << 8 | raw[3:], return_inverse=True)
        each = self._bits(grams)[back]
        starts = np.concatenate(([0], np.cumsum(sizes + 3)[:-1]))
        sums = np.concatenate((np.zeros((1, each.shape[1])), np.cumsum(each, 0)))
        return sums[starts + sizes] - sums[starts]


def _blocks(texts: list[str | None]) -> Iterator[tuple[list[int], list[bytes]]]:
    places, block, size = [], [], 0
    for k, t in enumerate(texts):
        if t and any(map(str.isalpha, t)):
            places.append(k)
            block.append(_raw(t))
            size += len(block[-1])
            if size >= BLOCK:
                yield places, block
                places, block, size = [], [], 0
    if block:
        yield places, block


def predict(texts: list[str | None], tables: Tables | None, languages: list[str]) -> tuple[list[str], list[float]]:
    """Language and score (its share among the languages, given the code lengths) of each text."""
    names, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
    if tables is not None:
        for places, block in _blocks(texts):
            bits = tables.bits_of(block)
            best = bits.argmin(1)
            share = 1.0 / np.exp2(np.maximum(bits.min(1, keepdims=True) - bits, -1000)).sum(1)
            for k, b, s in zip(places, best.tolist(), share.tolist(), strict=True):
                names[k], scores[k] = languages[b], s
    return names, scores


def language_of(docs: DataFrame, counts: Counts, text_col: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score``, names that must be free."""
    at, digest = docs.columns.index(text_col), counts.digest()

    def make():
        store = worker_store("languages")
        if digest not in store:
            store.clear()
            store[digest] = Tables(counts) if counts.languages else None
        tables = store[digest]
        return lambda batch: list(predict(batch.column(at).to_pylist(), tables, counts.languages))

    return append_columns(docs, make, [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])


def languages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """One row per document: id, held_out, lang_pred, score."""
    counts = fit(docs, id_col, text_col, lang_col)
    found = language_of(docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")), counts)
    return found.select(F.col("id").alias(id_col), held_out(F.col("id")).alias("held_out"), "lang_pred", "score")
