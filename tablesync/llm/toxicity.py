"""Toxicity: subword-bag embeddings averaged into a linear softmax, trained jointly in numpy.

A word is the bag of its character n-grams (and itself) between word marks, each hashed to a bucket with a vector. A document
is the average over its words of the sum of their subword vectors, and a linear softmax over it gives the two classes. Vectors
and softmax are trained together by Adam on a bounded sample of labelled documents. A misspelled or unseen word shares most
of its n-grams, and so their vectors, with words that were seen.

Because the softmax is linear, a word's share of the margin between the classes is one number, which scoring computes
once for each word that a task meets and then only looks up.

Defined results: null, empty and word-free texts score by the bias alone. Labels of documents that are not there, null
labels and rows with a null id are not learned from; of several labels of a document the highest counts, and of repeated documents
one. Without labelled rows of both classes every score is the share of the class that is there, or 0 if there is none.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablesync.llm.common import append_columns, carried, spread, word_bytes
from tablesync.session import materialise

#: Labelled documents that are learned from at most, toxic and other ones; the bound of the training sample.
TRAIN_TOXIC = 1200
TRAIN_OTHER = 2400
#: Longer documents are not taken into the sample.
TRAIN_CHARS = 8_000
#: Characters of the whole sample; with longer documents it holds fewer of them.
TRAIN_ALL_CHARS = 12_000_000
THRESHOLD = 0.3
BUCKETS = 1 << 20
GRAMS = (3, 4, 5)
DIMENSIONS = 2
EPOCHS = 60
RATE = 0.3
#: Weight decay of the vectors, and how far each step pulls a whole vector towards zero, so that chance n-grams lose theirs.
DECAY = 1e-5
SHRINK = 0.8
#: N-grams in fewer documents of the sample keep the zero vector: they say nothing about any other document.
LEAST_DOCUMENTS = 2
#: Words that training remembers the n-grams of, and words a task remembers.
TRAIN_WORDS = 1 << 15
REMEMBERED = 1 << 19


def subwords(word: bytes) -> list[int]:
    """Buckets of a word and of its n-grams."""
    marked = b"<" + word + b">"
    crc, mask = zlib.crc32, BUCKETS - 1
    return [crc(marked) & mask, *(crc(marked[i : i + n]) & mask for n in GRAMS for i in range(len(marked) - n + 1))]


@dataclass
class Model:
    """``margin``: toxic less other, for each bucket; ``bias`` the same."""

    margin: np.ndarray
    bias: float

    def scorer(self):
        """Function from text to probability, which remembers the margins of words."""
        bias, known, crc, mask = self.bias, {}, zlib.crc32, BUCKETS - 1
        at = np.flatnonzero(self.margin)
        part = dict(zip(at.tolist(), self.margin[at].astype(float).tolist(), strict=True)).get

        def score(text: str | None) -> float:
            words = word_bytes(text)
            total = 0.0
            for w in words:
                m = known.get(w)
                if m is None:
                    if len(known) >= REMEMBERED:
                        known.clear()
                    marked = b"<" + w + b">"
                    ends = len(marked) + 1
                    m = part(crc(marked) & mask, 0.0)
                    for n in GRAMS:
                        for i in range(ends - n):
                            m += part(crc(marked[i : i + n]) & mask, 0.0)
                    known[w] = m
                total += m
            x = bias + (total / len(words) if words else 0.0)
            return 1.0 / (1.0 + math.exp(-x)) if x > -700 else 0.0

        return score


def train(texts: list[str | None], labels: list[int], seed: int = 7, of_class: tuple[int, int] | None = None) -> Model:
    """Vectors and softmax from labelled texts; order of the rows doesn't matter beyond rounding.

    ``of_class``: documents of class 0 and 1 that the texts stand for. A class that is drawn from more sparsely weighs more.
    """
    share = sum(labels) / len(labels) if labels else 0.0
    if share in (0.0, 1.0):
        return Model(np.zeros(BUCKETS, np.float32), 800.0 if share else -800.0)
    buckets, weights = [], []
    of_word: dict[bytes, list[int]] = {}
    for text in texts:
        words = word_bytes(text)
        bag: dict[int, int] = {}
        for w in words:
            subs = of_word.get(w)
            if subs is None:
                if len(of_word) >= TRAIN_WORDS:
                    of_word.clear()
                subs = of_word[w] = subwords(w)
            for s in subs:
                bag[s] = bag.get(s, 0) + 1
        buckets.append(np.fromiter(bag.keys(), np.int32, len(bag)))
        weights.append(np.fromiter(bag.values(), np.float32, len(bag)) / max(1, len(words)))
    n, of_word = len(texts), {}
    doc = np.repeat(np.arange(n, dtype=np.int32), [len(b) for b in buckets])
    bucket, buckets = np.concatenate(buckets), []  # one after the other, so that few copies are held at a time
    weight, weights = np.concatenate(weights), []
    spread_over = np.bincount(bucket, minlength=BUCKETS)
    fit_for = spread_over >= LEAST_DOCUMENTS
    used = np.flatnonzero(fit_for)
    m, column_of = len(used), np.zeros(BUCKETS, np.int32)
    column_of[used] = np.arange(m)
    fit_for = fit_for[bucket]
    doc, weight = doc[fit_for], weight[fit_for]
    column = column_of[bucket[fit_for]]
    del bucket, fit_for
    by_column = np.argsort(column, kind="stable").astype(np.int32)
    row_starts, column_starts = np.searchsorted(doc, np.arange(n)), np.searchsorted(column[by_column], np.arange(m))
    filled = np.bincount(doc, minlength=n) > 0
    doc_c, weight_c = doc[by_column], weight[by_column]
    del doc, by_column

    rng = np.random.default_rng(seed)
    y = np.eye(2, dtype=np.float32)[np.asarray(labels)]
    drawn = np.bincount(labels, minlength=2)
    stands_for = np.asarray(drawn if of_class is None else of_class) / drawn
    counts_as = (stands_for[np.asarray(labels)] / (stands_for * drawn).sum()).astype(np.float32)[:, None]  # sums to 1
    params = [np.zeros((m, DIMENSIONS), np.float32), rng.normal(0, 1, (DIMENSIONS, 2)).astype(np.float32), np.zeros(2, np.float32)]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    for step in range(1, EPOCHS + 1):
        vectors, softmax, bias = params
        bags = np.zeros((n, DIMENSIONS), np.float32)
        for j in range(DIMENSIONS if m else 0):
            bags[filled, j] = np.add.reduceat(vectors[:, j][column] * weight, row_starts[filled])
        logits = bags @ softmax + bias
        e = np.exp(logits - logits.max(1, keepdims=True))
        error = (e / e.sum(1, keepdims=True) - y) * counts_as
        into = error @ softmax.T
        pulled = [np.add.reduceat(into[:, j][doc_c] * weight_c, column_starts) for j in range(DIMENSIONS)] if m else [np.zeros(0, np.float32)] * DIMENSIONS
        grads = [np.stack(pulled, 1) + DECAY * vectors, bags.T @ error, error.sum(0)]
        for k, g in enumerate(grads):
            first[k] = 0.9 * first[k] + 0.1 * g
            second[k] = 0.99 * second[k] + 0.01 * g * g
            params[k] = params[k] - RATE * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-7)
        norm = np.maximum(np.linalg.norm(params[0], axis=1, keepdims=True), 1e-9)
        params[0] = params[0] * np.maximum(0, 1 - RATE * SHRINK / norm)
    vectors, softmax, bias = params
    margin = np.zeros(BUCKETS, np.float32)
    margin[used] = vectors @ (softmax[:, 1] - softmax[:, 0])
    return Model(margin, float(bias[1] - bias[0]))


def held_out(doc_id: Column) -> Column:
    """Rows that are never learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", label_id: str = "doc_id") -> Model:
    """Train on a bounded sample: of each class the usable rows with the smallest hashes, labelled, not held out, and with a text that is not too long."""
    known = labels.select(F.col(label_id).alias("id"), F.col(label_col).cast("int").alias("y")).where("id IS NOT NULL AND y IN (0, 1)")
    known = known.where(~held_out(F.col("id"))).groupBy("id").agg(F.max("y").alias("y"))
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).where(F.length("text") <= TRAIN_CHARS)
    usable = materialise(texts.select("id").distinct().join(known, "id").select("id", "y"), "usable")
    drawn = [usable.where(F.col("y") == y).orderBy(F.xxhash64("id"), "id").limit(n) for y, n in ((1, TRAIN_TOXIC), (0, TRAIN_OTHER))]
    chosen = F.broadcast(drawn[0].union(drawn[1]))  # TRAIN_TOXIC + TRAIN_OTHER rows of two numbers
    one = texts.join(chosen, "id").groupBy("id", "y").agg(F.max("text").alias("text"))
    upto = Window.orderBy(F.xxhash64("id"), "id").rowsBetween(Window.unboundedPreceding, Window.currentRow)  # over the sample only
    fits = one.withColumn("chars", F.sum(F.length("text")).over(upto)).where(F.col("chars") <= TRAIN_ALL_CHARS)
    of_class = dict(usable.groupBy("y").count().collect())
    return _trained(fits.select("id", "y", "text"), (of_class.get(0, 0), of_class.get(1, 0)))


def _trained(sample: DataFrame, of_class: tuple[int, int]) -> Model:
    """Train in one task, so that the bounded sample never reaches the driver; what comes back are margins and the bias."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted(row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns), strict=True))
        model = train([t for _, _, t in rows], [y for _, y, _ in rows], of_class=of_class)
        at = np.flatnonzero(model.margin)
        for columns in (([-1], [model.bias]), (at, model.margin[at])):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.float64()), strict=True)], names=["bucket", "margin"])

    found = sample.coalesce(1).mapInArrow(run, "bucket int, margin double").toArrow()
    bucket, value = (found.column(i).to_numpy() for i in range(2))
    margin = np.zeros(BUCKETS, np.float32)
    margin[bucket[bucket >= 0]] = value[bucket >= 0]
    bias = value[bucket < 0]
    return Model(margin, float(bias[0]) if len(bias) else -800.0)


def with_score(df: DataFrame, text_col: str, model: Model) -> DataFrame:
    """``df`` with the column ``score``, a name that must be free."""
    at = df.columns.index(text_col)
    margin, bias = model.margin, model.bias
    used = np.flatnonzero(margin)
    values = margin[used]

    def make():
        whole = np.zeros(BUCKETS, np.float32)
        whole[used] = values
        score = Model(whole, bias).scorer()
        return lambda batch: [[score(t) for t in batch.column(at).to_pylist()]]

    return append_columns(df, make, [T.StructField("score", T.DoubleType())])


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: id, held_out, score, predicted."""
    model = fit(docs, labels, id_col, text_col)
    scored = with_score(docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")), "text", model)
    return scored.select(F.col("id").alias(id_col), held_out(F.col("id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that score below the threshold, unchanged."""
    model = fit(docs, labels, id_col, text_col)
    return spread(with_score(carried(docs, text=F.col(text_col).cast("string")), "text", model).where(F.col("score") < threshold), docs)
