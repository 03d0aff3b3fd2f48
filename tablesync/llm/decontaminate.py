"""Benchmark decontamination with an FM-index per shard of the corpus.

Words that occur in no benchmark phrase cannot be part of a match, so a document becomes its runs of benchmark words that are
long enough for the shortest phrase. Each task joins the runs of a block of documents to one sequence of word numbers and
indexes it: a suffix array by prefix doubling, its Burrows-Wheeler transform in a wavelet matrix, and every eighth suffix
position. All phrases are searched backwards at once, their occurrences are located by walking to a sampled suffix, and
overlapping occurrences are merged to spans.

The benchmark is the query set: it goes to the tasks in blocks of bounded size, and the spans found so far travel with
the rows.

Defined results: null and word-free documents have no words and no spans. Items without words match nothing; an item shorter than a
window is one phrase. Items with the same text all count; a repeated item id counts once. Null item ids match but are not listed.
An empty benchmark leaves every document clean.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablesync.llm.common import append_columns, carried, spread, word_bytes
from tablesync.session import materialise

#: Words of a window.
WINDOW = 13
#: Characters of the benchmark in one block of the query set.
BLOCK_CHARS = 1 << 24
#: Symbols in one FM-index; a longer document has one of its own.
SHARD_SYMBOLS = 1 << 19
#: Every so many suffix positions are kept.
SAMPLE = 8


class Phrases:
    """Windows of a block of items as rows of word numbers from 1 on; ``items[p]`` are the ids of the items that hold phrase ``p``."""

    def __init__(self, items: list[tuple[str | None, str | None]], window: int = WINDOW):
        self.numbers: dict[bytes, int] = {}
        found: dict[tuple[int, ...], set] = {}
        for item, text in items:
            words = [self.numbers.setdefault(w, len(self.numbers) + 1) for w in word_bytes(text)]
            for i in range(max(1, len(words) - window + 1) if words else 0):
                found.setdefault(tuple(words[i : i + window]), set()).add(item)
        self.items = [sorted(x for x in s if x is not None) for s in found.values()]
        self.lengths = np.array([len(p) for p in found], np.int64)
        self.shortest = int(self.lengths.min()) if found else 0
        self.words = np.zeros((len(found), window), np.int64)
        for row, phrase in zip(self.words, found, strict=True):
            row[window - len(phrase) :] = phrase


class FMIndex:
    """Index of a sequence of word numbers in which 0 separates runs; the first and the last symbol are 0."""

    def __init__(self, symbols: np.ndarray, sample: int = SAMPLE):
        n = len(symbols)
        ends = symbols == 0
        runs = int(ends.sum())
        values, dense = np.unique(symbols, return_inverse=True)
        self.values = values
        rank = np.where(ends, np.cumsum(ends) - 1, dense + runs - 1).astype(np.int64)  # separators differ, so no comparison passes one
        step = 1
        while True:
            after = np.zeros(n, np.int64)
            after[: max(0, n - step)] = rank[step:]
            after[ends] = 0
            key = rank * (2 * n + 1) + after
            suffixes = np.argsort(key, kind="stable")
            ordered = key[suffixes]
            new = np.empty(n, np.int64)
            new[suffixes] = np.concatenate(([0], np.cumsum(ordered[1:] != ordered[:-1])))
            rank = new
            if rank[suffixes[-1]] == n - 1:
                break
            step *= 2
        transform = dense[suffixes - 1]
        self.first = np.concatenate(([0], np.cumsum(np.bincount(dense, minlength=len(values)))))
        self.bits = max(1, int(len(values) - 1).bit_length())
        self.ones, self.zeros = [], []
        level = transform
        for bit in range(self.bits - 1, -1, -1):
            up = (level >> bit) & 1
            self.ones.append(np.concatenate(([0], np.cumsum(up))).astype(np.int32))
            self.zeros.append(int(n - up.sum()))
            level = np.concatenate((level[up == 0], level[up == 1]))
        self.starts = self._rank(np.arange(len(values)), np.zeros(len(values), np.int64))
        self.kept = (suffixes % sample == 0) | (symbols[suffixes - 1] == 0)
        self.kept_before = np.cumsum(self.kept) - self.kept
        self.positions = suffixes[self.kept]

    def _rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Position below the last level of the wavelet matrix; less ``starts``, the number of ``symbol`` before ``at``."""
        for k, (ones, zeros) in enumerate(zip(self.ones, self.zeros, strict=True)):
            up = ones[at]
            at = np.where((symbol >> (self.bits - 1 - k)) & 1, zeros + up, at - up)
        return at

    def _back(self, at: np.ndarray) -> np.ndarray:
        """Row of the suffix that starts one symbol earlier."""
        symbol, row = np.zeros(len(at), np.int64), at
        for ones, zeros in zip(self.ones, self.zeros, strict=True):
            up = ones[row]
            bit = ones[row + 1] - up
            symbol = symbol * 2 + bit
            row = np.where(bit, zeros + up, row - up)
        return self.first[symbol] + row - self.starts[symbol]

    def search(self, phrases: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows ``[low, high)`` of the suffixes that begin with each phrase; phrases stand at the right of their rows."""
        width = phrases.shape[1]
        low, high = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.first[-1], np.int64)
        alive = np.arange(len(phrases))
        for back in range(1, width + 1):
            alive = alive[(lengths[alive] >= back) & (high[alive] > low[alive])]
            if not len(alive):
                break
            words = phrases[alive, width - back]
            symbol = np.minimum(np.searchsorted(self.values, words), len(self.values) - 1)
            there = self.values[symbol] == words
            gone = alive[~there]
            low[gone] = high[gone] = 0
            alive, symbol = alive[there], symbol[there]
            base = self.first[symbol] - self.starts[symbol]
            low[alive], high[alive] = base + self._rank(symbol, low[alive]), base + self._rank(symbol, high[alive])
        none = high <= low
        low[none] = high[none] = 0
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Start of the suffix of each row."""
        out, at, left, steps = np.zeros(len(rows), np.int64), rows.astype(np.int64), np.arange(len(rows)), 0
        while len(left):
            done = self.kept[at]
            out[left[done]] = self.positions[self.kept_before[at[done]]] + steps
            left, at = left[~done], self._back(at[~done])
            steps += 1
        return out


def _runs(words: np.ndarray, shortest: int) -> Iterator[tuple[int, int]]:
    """Stretches of non-zero numbers of at least ``shortest``."""
    edges = np.flatnonzero(np.diff(np.concatenate(([0], (words > 0).view(np.int8), [0]))))
    starts, ends = edges[::2], edges[1::2]
    long = ends - starts >= shortest
    return zip(starts[long].tolist(), ends[long].tolist(), strict=True)


def find_spans(texts: list[str | None], phrases: Phrases) -> tuple[list[int], list[list[tuple[int, int]]], list[list[str]]]:
    """For each text its number of words, merged spans ``(from, to)`` of word positions, and the ids of the items found."""
    counts, spans, items = [], [[] for _ in texts], [set() for _ in texts]
    numbers = phrases.numbers.get
    parts: list[tuple[int, int, np.ndarray]] = []
    size = 0

    def flush() -> None:
        nonlocal parts, size
        if parts:
            _search(parts, phrases, spans, items)
        parts, size = [], 0

    for doc, text in enumerate(texts):
        words = word_bytes(text)
        counts.append(len(words))
        if not phrases.shortest or len(words) < phrases.shortest:
            continue
        known = np.array([numbers(w, 0) for w in words], np.int64)
        for a, b in _runs(known, phrases.shortest):
            parts.append((doc, a, known[a:b]))
            size += b - a + 1
        if size >= SHARD_SYMBOLS:
            flush()
    flush()
    return counts, spans, [sorted(x) for x in items]


def _search(parts: list[tuple[int, int, np.ndarray]], phrases: Phrases, spans: list, items: list) -> None:
    gap = np.zeros(1, np.int64)
    symbols = np.concatenate([gap, *(x for _, _, run in parts for x in (run, gap))])
    begins = np.cumsum([1, *(len(run) + 1 for _, _, run in parts)])[:-1]
    index = FMIndex(symbols)
    low, high = index.search(phrases.words, phrases.lengths)
    there = np.flatnonzero(high > low)
    if not len(there):
        return
    many = high[there] - low[there]
    which = np.repeat(there, many)
    rows = np.repeat(low[there] - np.concatenate(([0], np.cumsum(many)[:-1])), many) + np.arange(many.sum())
    at = index.locate(rows)
    part = np.searchsorted(begins, at, side="right") - 1
    docs = np.array([d for d, _, _ in parts])
    cover = np.zeros(len(symbols) + 1, np.int64)
    np.add.at(cover, at, 1)
    np.add.at(cover, at + phrases.lengths[which], -1)
    hit = (np.cumsum(cover) > 0).view(np.int8)
    edges = np.flatnonzero(np.diff(np.concatenate(([0], hit))))
    for a, b in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
        doc, offset, _ = parts[p := int(np.searchsorted(begins, a, side="right")) - 1]
        spans[doc].append((offset + a - int(begins[p]), offset + b - int(begins[p])))
    both = np.unique(docs[part] * len(phrases.items) + which)
    for x in both.tolist():
        items[x // len(phrases.items)].update(phrases.items[x % len(phrases.items)])


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans in order, with those that overlap or touch joined."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


_SPAN = T.StructType([T.StructField("from", T.LongType()), T.StructField("to", T.LongType())])
FOUND = [T.StructField("n_words", T.LongType()), T.StructField("spans", T.ArrayType(_SPAN)), T.StructField("items", T.ArrayType(T.StringType()))]


def with_spans(docs: DataFrame, text_col: str, benchmark: DataFrame, item_col: str = "item_id", item_text: str = "text", window: int = WINDOW, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """``docs`` with ``n_words``, merged ``spans`` of hit words and the sorted ``items`` found. The three names must be free in ``docs``."""
    asked = benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(item_text).cast("string").alias("text"))
    chars = asked.agg(F.sum(F.length("text").cast("long"))).first()[0] or 0
    blocks = max(1, math.ceil(chars / block_chars))
    found = docs
    for block in range(blocks):
        mine = F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == block
        items = [(r.item, r.text) for r in asked.where(mine).toLocalIterator()]
        if block:
            found = found.withColumnsRenamed({f.name: f"{f.name}_before" for f in FOUND})
        found = append_columns(found, _searcher(found.columns, text_col, items, window, block > 0), FOUND)
        found = found.drop(*(f"{f.name}_before" for f in FOUND if block))
        if blocks > 1:
            found = materialise(found, "spans")
    return found


def _searcher(columns: list[str], text_col: str, items: list, window: int, again: bool):
    at = columns.index(text_col)

    def make():
        phrases = Phrases(items, window)

        def of(batch):
            counts, spans, found = find_spans(batch.column(at).to_pylist(), phrases)
            if again:
                for k, (s, i) in enumerate(zip(batch.column(batch.num_columns - 2).to_pylist(), batch.column(batch.num_columns - 1).to_pylist(), strict=True)):
                    spans[k] = merged(spans[k] + [(x["from"], x["to"]) for x in s])
                    found[k] = sorted({*found[k], *i})
            return [counts, [[{"from": a, "to": b} for a, b in s] for s in spans], found]

        return of

    return make


def remove_spans(text: str | None, spans: list[tuple[int, int]]) -> str | None:
    """``text`` without the words in ``spans`` and what stands between them."""
    if not text or not spans:
        return text
    import regex

    places = [m.span() for m in regex.finditer(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text)]
    keep, at = [], 0
    for a, b in spans:
        keep.append(text[at : places[a][0]])
        at = places[b - 1][1]
    return "".join([*keep, text[at:]])


def _hits():
    return F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["to"] - s["from"])


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, share: int = 20) -> DataFrame:
    """One row per document: id, n_words, n_hit, spans, items, contaminated (one word in ``share`` or more is hit)."""
    found = with_spans(docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")), "text", benchmark, window=window)
    found = found.select("id", "n_words", _hits().alias("n_hit"), "spans", "items")
    return found.select(F.col("id").alias(id_col), "n_words", "n_hit", "spans", "items", ((F.col("n_hit") > 0) & (share * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", window: int = WINDOW, share: int = 20) -> DataFrame:
    """The rows of ``docs`` that are not contaminated, unchanged."""
    found = with_spans(carried(docs, text=F.col(text_col).cast("string")), "text", benchmark, window=window)
    return spread(found.where(~((_hits() > 0) & (share * _hits() >= F.col("n_words")))), docs)


def contamination_digest(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The contract's columns."""
    found = contamination(docs, benchmark)
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), "contaminated")


ORACLE = r"""
WITH words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
asked AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
windows AS (
  SELECT DISTINCT item_id, least(len(w), 13) AS n, array_to_string(w[i : i + least(len(w), 13) - 1], ' ') AS phrase
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 13, 0) + 2)) AS i FROM asked WHERE len(w) > 0)),
lengths AS (SELECT DISTINCT n FROM windows),
starts AS (
  SELECT doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') AS phrase
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM words, lengths WHERE len(w) >= n)),
found AS (SELECT s.doc_id, s.i, s.n, b.item_id FROM starts s JOIN windows b ON s.n = b.n AND s.phrase = b.phrase),
hits AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM found) GROUP BY doc_id),
named AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
          FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM found) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(d.w) AS contaminated
FROM words d LEFT JOIN hits h ON d.doc_id = h.doc_id LEFT JOIN named m ON d.doc_id = m.doc_id
"""
