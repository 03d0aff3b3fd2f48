"""Ranked lexical search with sparse ball trees, exact.

A document is a sparse vector over the terms that the questions hold, with the integer value of each term's occurrences; a
question is the vector of its terms' integer weights, and a score is their inner product. Terms that no question holds add
nothing to any product and have no coordinate; they count in the lengths. Tasks build a ball tree over each few thousand
documents: a node has the centroid of its documents and the largest distance from it, and is split between two documents far
apart. No product below a node exceeds ``question . centroid + |question| * radius``, a bound that is rounded up beyond the
error of its floating-point sums. Each question opens nodes by descending bound and stops when the best bound left is below its
k-th score so far, which it carries from tree to tree through a task. At the leaves scores are sums of 64-bit integers. The
k best of every task meet in Spark.

Questions come in blocks of bounded size, all documents are read for each block; document frequencies and the totals are
counted over all documents. An item is all rows with its id, and holds each term once.

Defined results: null and empty texts hold no term, on either side; items without a term, and documents that score nothing,
give no row. Equal scores stand by ascending id, null ids first; repeated rows of a document each have a rank. Empty tables
give an empty result. Columns other than ids and texts are not looked at. Length and values are 64-bit integers, which bounds a
corpus to 10^17 terms times the longest document.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tablesync.llm.common import WORD_BYTES, word_bytes
from tablesync.session import materialise

#: Characters of question texts in one block.
BLOCK_CHARS = 1 << 17
#: Documents of a tree, and at most so many in a leaf that can be split.
TREE, LEAF = 4096, 32
#: Bytes of a text that are taken apart at once.
PIECE = 1 << 22


def pieces(text: str | None) -> Iterator[list[bytes]]:
    """The terms of ``text`` in lists of bounded size."""
    data = text.encode("utf-8", "surrogatepass").translate(WORD_BYTES) if text else b""
    at = 0
    while at < len(data):
        end = len(data) if len(data) - at <= PIECE else data.find(b" ", at + PIECE)
        end = len(data) if end < 0 else end
        yield data[at:end].split()
        at = end


def value(tf, m):
    """Integer value of ``tf`` occurrences in a document of relative length ``m``."""
    return (1_000_000_000 * tf) // (1000 * tf + 8 * m)


def relative_length(n, documents: int, terms: int):
    return 10 + (90 * n * documents) // terms


def weight(documents: int, holding: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * holding + 1)))


class Rows:
    """Sparse rows: columns, values and where each row begins; no row is empty."""

    def __init__(self, cols: np.ndarray, vals: np.ndarray, lengths: np.ndarray, names: np.ndarray):
        self.cols, self.vals, self.lengths, self.names = cols, vals, lengths, names
        self.starts = np.cumsum(lengths) - lengths

    def take(self, mask: np.ndarray) -> Rows:
        each = np.repeat(mask, self.lengths)
        return Rows(self.cols[each], self.vals[each], self.lengths[mask], self.names[mask])

    def row(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        part = slice(self.starts[i], self.starts[i] + self.lengths[i])
        return self.cols[part], self.vals[part]

    def dot(self, dense: np.ndarray) -> np.ndarray:
        return np.add.reduceat(self.vals * dense[self.cols], self.starts)


class Tree:
    """A ball tree; ``bounds[node]`` holds an upper bound of each question's scores below the node."""

    def __init__(self, rows: Rows, dims: int, questions: Rows, leaf: int = LEAF):
        self.bounds, self.children, self.leaves = [], [], []
        norms = np.sqrt(np.add.reduceat(questions.vals.astype(float) ** 2, questions.starts))
        waiting = [(rows, -1)]
        while waiting:
            part, parent = waiting.pop()
            node, count = len(self.bounds), len(part.names)
            if parent >= 0:
                self.children[parent].append(node)
            vals = part.vals.astype(float)
            square = np.add.reduceat(vals * vals, part.starts)
            centre = np.bincount(part.cols, vals, dims) / count
            # Distances are taken as larger than they can be by the rounding of the sums they come from.
            unsure = 2.0**-48 * (part.lengths + count + 16) * (square + centre @ centre)
            apart = np.maximum(square + centre @ centre - 2 * part.dot(centre), 0) + unsure
            radius = math.sqrt(apart.max()) * (1 + 2.0**-40)
            self.bounds.append((questions.dot(centre) + norms * radius) * (1 + 2.0**-30) + 1)
            self.children.append([])
            mask = self._sides(part, square, apart, dims) if count > leaf else None
            self.leaves.append(part if mask is None else None)
            if mask is not None:
                waiting += [(part.take(mask), node), (part.take(~mask), node)]

    @staticmethod
    def _sides(part: Rows, square: np.ndarray, apart: np.ndarray, dims: int) -> np.ndarray | None:
        """Which rows are nearer to one of two rows far apart; none if all rows are alike."""
        ends, at = [], int(apart.argmax())
        for _ in range(2):
            dense = np.zeros(dims)
            cols, vals = part.row(at)
            dense[cols] = vals
            ends.append(square + square[at] - 2 * part.dot(dense))
            at = int(ends[0].argmax())
        mask = ends[0] < ends[1]
        return None if mask.all() or not mask.any() else mask


class Best:
    """The k best of each question so far, best first: (-score, whether the id is known, id)."""

    def __init__(self, questions: int, k: int):
        self.k, self.found = k, [[] for _ in range(questions)]

    def least(self, q: int) -> int:
        return -self.found[q][-1][0] if len(self.found[q]) == self.k else 1

    def add(self, q: int, scores: np.ndarray, names: list) -> None:
        self.found[q] = heapq.nsmallest(self.k, [*self.found[q], *((-s, x is not None, x) for s, x in zip(scores.tolist(), names, strict=True))], key=lambda x: (x[0], x[1], x[2]) if x[1] else (x[0], False))


def search(tree: Tree, questions: Rows, dims: int, ids: list, best: Best) -> int:
    """Bring ``best`` up to date with the documents of ``tree``; returns the number of leaves opened."""
    weights, opened = np.zeros(dims, np.int64), 0
    for q in range(len(questions.names)):
        cols, vals = questions.row(q)
        weights[cols] = vals
        queue = [(-tree.bounds[0][q], 0)]
        while queue:
            bound, node = heapq.heappop(queue)
            if -bound < best.least(q):
                break
            part = tree.leaves[node]
            if part is None:
                for child in tree.children[node]:
                    heapq.heappush(queue, (-tree.bounds[child][q], child))
                continue
            opened += 1
            scores = part.dot(weights)
            good = scores >= best.least(q)
            if good.any():
                best.add(q, scores[good], [ids[i] for i in part.names[good]])
        weights[cols] = 0
    return opened


def _vectors(docs: DataFrame, terms: dict[bytes, int]) -> DataFrame:
    """``(id, n, terms, tfs)`` of every document; ``terms`` and ``tfs`` hold the terms asked for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths, cols, tfs, ends = [], [], [], [0]
            for text in batch.column(1):
                counts, n = Counter(), 0
                for words in pieces(text.as_py()):
                    n += len(words)
                    counts.update(map(terms.get, words))
                counts.pop(None, None)
                lengths.append(n)
                cols += counts
                tfs += counts.values()
                ends.append(len(cols))
            ends = pa.array(ends, pa.int32())
            lists = [pa.ListArray.from_arrays(ends, pa.array(x, t)) for x, t in ((cols, pa.int32()), (tfs, pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lengths, pa.int64()), *lists], names=["id", "n", "terms", "tfs"])

    kind = docs.schema["id"].dataType.simpleString()
    return docs.mapInArrow(run, f"id {kind}, n long, terms array<int>, tfs array<long>")


def _questions(items: dict, terms: dict[bytes, int], weights: np.ndarray) -> Rows:
    cols = [sorted(terms[t] for t in held) for held in items.values()]
    flat = np.array([c for row in cols for c in row], np.int64)
    return Rows(flat, weights[flat], np.array([len(c) for c in cols], np.int64), np.arange(len(cols)))


def _search_block(docs: DataFrame, items: dict, k: int, tree_size: int, leaf: int) -> DataFrame:
    """``(item, id, score)`` with the k best of each task for each item; ``item`` is its place in ``items``."""
    kind = docs.schema["id"].dataType.simpleString()
    terms = {t: i for i, t in enumerate(sorted(set().union(*items.values())))}
    vectors = materialise(_vectors(docs, terms), "vectors")
    documents, total = vectors.where("n > 0").agg(F.count("*"), F.sum("n")).first()
    holding = vectors.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("n")).toArrow()
    weights = np.zeros(len(terms), np.int64)
    for term, n in zip(holding.column(0).to_pylist(), holding.column(1).to_pylist(), strict=True):
        weights[term] = weight(documents, n)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        questions, best = _questions(items, terms, weights), Best(len(items), k)
        for batch in batches:
            for at in range(0, batch.num_rows, tree_size):
                part = batch.slice(at, tree_size)
                ids = part.column(0).to_pylist()
                cols, tfs = part.column(2), part.column(3).flatten().to_numpy()
                lengths = np.diff(cols.offsets.to_numpy()).astype(np.int64)
                m = relative_length(part.column(1).to_numpy(), documents, total)
                rows = Rows(cols.flatten().to_numpy().astype(np.int64), value(tfs, np.repeat(m, lengths)), lengths, np.arange(len(ids)))
                search(Tree(rows, len(terms), questions, leaf), questions, len(terms), ids, best)
        out = [(q, x[2], -x[0]) for q, found in enumerate(best.found) for x in found]
        columns = zip(*out, strict=True) if out else ([], [], [])
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), arrow_kind, pa.int64()), strict=True)], names=["item", "id", "score"])

    arrow_kind = to_arrow_type(docs.schema["id"].dataType)
    return vectors.where(F.size("terms") > 0).mapInArrow(run, f"item int, id {kind}, score long")


def ranked(docs: DataFrame, asked: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", k: int = 10, block_chars: int = BLOCK_CHARS, tree_size: int = TREE, leaf: int = LEAF) -> DataFrame:
    """The ``k`` highest-scoring documents of each item: item id, rank from 1, document id, score."""
    spark = docs.sparkSession
    asked = asked.select(F.col(item_col).alias("item"), F.col(item_text).cast("string").alias("text"))
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    chars = asked.agg(F.sum(F.length("text").cast("long"))).first()[0] or 0
    blocks = max(1, math.ceil(chars / block_chars))
    found = None
    for block in range(blocks):
        mine = F.pmod(F.xxhash64("item"), F.lit(blocks)) == block
        items: dict = {}
        for row in asked.where(mine).toLocalIterator():
            items.setdefault(row.item, set()).update(word_bytes(row.text))
        items = {i: held for i, held in items.items() if held}
        if not items:
            continue
        names = spark.createDataFrame([(n, i) for n, i in enumerate(items)], f"item int, name {asked.schema['item'].dataType.simpleString()}")
        part = _search_block(docs, items, k, tree_size, leaf).join(names, "item").select("name", "id", "score")
        part = materialise(part, "best")
        found = part if found is None else found.union(part)
    if found is None:
        found = docs.select(F.lit(None).cast(asked.schema["item"].dataType).alias("name"), "id", F.lit(None).cast("long").alias("score")).where("false")
    order = Window.partitionBy("name").orderBy(F.desc("score"), F.col("id").asc_nulls_first())
    top = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return top.select(F.col("name").alias(item_col), "rank", F.col("id").alias(id_col), "score")


ORACLE = r"""
WITH words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w
  FROM documents),
asked AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM benchmark),
totals AS (SELECT CAST(count(*) AS BIGINT) AS n_docs, CAST(sum(len(w)) AS BIGINT) AS n_terms FROM words WHERE len(w) > 0),
held AS (
  SELECT doc_id, n, term, CAST(count(*) AS BIGINT) AS tf
  FROM (SELECT doc_id, CAST(len(w) AS BIGINT) AS n, unnest(w) AS term FROM words)
  WHERE term IN (SELECT term FROM asked) GROUP BY ALL),
weighed AS (
  SELECT term, CAST(floor(1000 * ln((2 * n_docs + 2) / CAST(2 * df + 1 AS DOUBLE))) AS BIGINT) AS weight
  FROM (SELECT term, count(*) AS df FROM held GROUP BY term), totals),
scored AS (
  SELECT item_id, doc_id, CAST(sum(weight * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * n_docs) // n_terms)))) AS BIGINT) AS score
  FROM asked JOIN held USING (term) JOIN weighed USING (term), totals GROUP BY item_id, doc_id),
ranks AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank, doc_id, score FROM scored WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM ranks WHERE rank <= 10
"""
