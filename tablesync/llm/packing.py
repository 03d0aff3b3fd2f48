"""Packing of tokenised documents into sequences: cutting stock by column generation.

Documents become token ids; those longer than a sequence are cut, and only the last piece of a document can be shorter than
a sequence. The lengths, in steps of ``unit``, make a histogram of bounded size. On it a linear program asks for the fewest
sequences: its columns are patterns of lengths that fit into one, priced by a knapsack over the duals until no pattern is
worth more than a sequence, or the bound on what is left to gain is small. Pattern counts are rounded down, what remains is filled
by the largest fractions that fit and by best fit. Pieces are ranked within their length, and a rank says which pattern,
which copy of it and which slot a piece gets.

Ranks come from (length, salt) groups of about the square root of a length's count and their running totals, so a common
length is no hot group. Only the histogram and the plan pass through the driver.

Defined results: null and empty texts are the closing id alone. Repeated rows are packed each. An empty table gives
an empty result. Columns other than id and text are not looked at.
"""

from __future__ import annotations

import unicodedata
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tablesync.llm.common import append_columns, worker_store
from tablesync.session import materialise

SEQUENCE = 2048
#: Id that closes a document.
CLOSING = 1
#: Step of the length histogram; a piece wastes less than this to rounding.
UNIT = 4
#: Column generation ends when this share of the sequences is the most that is left to gain.
GAP = 2e-3
#: Characters of stretches that a worker remembers; a block can go beyond it by its own.
REMEMBERED = 1 << 23
#: Characters tokenised at a time.
BLOCK_CHARS = 1 << 23
#: Stretches whose ids are put in place at a time.
GATHERED = 1 << 18

TOKENIZER = "word_bpe_49k.json"


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """Token ids of whole texts, as arrays, remembered by stretches without space or line feed.

    The tokenizer splits at white space and drops it, so a text's ids are those of its stretches; each distinct one of a block is
    looked up once. Where it lower-cases and splits off runs of letters, as the given one does, closing marks are taken off a
    stretch and what is left goes to its model as a word, if it is letters alone.
    """

    MARKS = ".,;:!?\"#$%&()*+-/=@[\\]^_`{}~"

    def __init__(self, path: str):
        import json

        import tokenizers

        self.tokenizer = tokenizers.Tokenizer.from_file(path)
        self.small = np.dtype("<u2" if self.tokenizer.get_vocab_size(with_added_tokens=True) <= 1 << 16 else "<u4")
        self.code = "H" if self.small.itemsize == 2 else "I"
        made = json.loads(self.tokenizer.to_str())
        steps = [x.get("type") for part, many in (("normalizer", "normalizers"), ("pre_tokenizer", "pretokenizers")) for x in (made[part] or {}).get(many, [])]
        self.by_word = steps == ["NFC", "Replace", "Lowercase", "Split", "ByteLevel"] and made["model"]["type"] == "BPE" and made["model"]["dropout"] is None
        self.marks = "".join(c for c in self.MARKS if not any(c in t["content"] for t in made["added_tokens"]))
        self.known: dict[str, bytes] = {"": b""}
        self.held = 0
        shown = [b for b in range(256) if chr(b).isprintable() and not chr(b).isspace() and b != 0xAD]
        hidden = [b for b in range(256) if b not in shown]
        self.glyph = [chr(256 + hidden.index(b)) if b in hidden else chr(b) for b in range(256)]  # how byte-level models write a byte

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, self.small).tobytes() for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]

    def _word(self, word: str) -> bytes:
        """Ids of one lower-cased run of letters."""
        marked = word if word.isascii() else "".join(map(self.glyph.__getitem__, word.encode("utf-8")))
        return array(self.code, [t.id for t in self.model.tokenize(marked)]).tobytes()

    def _learn(self, missing: set[str], heads: list[str], tails: set[str]) -> None:
        known = self.known
        if self.held + sum(map(len, missing)) > REMEMBERED:
            known = self.known = {"": b""}
            missing, self.held = {*heads, *tails} - known.keys(), 0
        self.held += sum(map(len, missing))
        self.model = self.tokenizer.model
        other, by_word = [], self.by_word
        for s in missing:
            if by_word and s.isalpha():
                low = s.lower() if s.isascii() else unicodedata.normalize("NFC", s).lower()
                if low.isascii() or low.isalpha() and "\u03c2" not in low and "\u03a3" not in s:
                    known[s] = self._word(low)
                    continue
            other.append(s)
        if other:
            known.update(zip(other, self._whole(other), strict=True))

    def _lowered(self, text: str) -> str:
        """Lower-cased where the tokenizer does the same letter by letter, so that fewer stretches differ."""
        if self.by_word:
            try:
                return text.lower() if text.isascii() or text.encode("latin-1") else text
            except UnicodeEncodeError:
                pass
        return text

    def _cut(self, stretches: list[str]) -> tuple[list[str], list[str]]:
        """What is looked up for each stretch: itself without its closing marks, and these. Marks after another sign stay with it."""
        if not self.by_word:
            return stretches, [""] * len(stretches)
        marks = self.marks
        heads = [s.rstrip(marks) for s in stretches]
        heads = [h if len(h) == len(s) or not h or h[-1].isalpha() or h[-1] in "0123456789" else s for h, s in zip(heads, stretches, strict=True)]
        return heads, [s[len(h) :] for h, s in zip(heads, stretches, strict=True)]

    def _ids(self, stretches: list[str]) -> list[bytes]:
        heads, tails = self._cut(stretches)
        found, kinds = list(map(self.known.get, heads)), set(tails)
        missing = {h for h, ids in zip(heads, found, strict=True) if ids is None} | (kinds - self.known.keys())
        if missing:
            self._learn(missing, heads, kinds)
            found = list(map(self.known.__getitem__, heads))
        marks = {t: self.known[t] for t in kinds}
        return [ids + marks[t] if t else ids for ids, t in zip(found, tails, strict=True)]

    def __call__(self, texts: list[str]) -> list[np.ndarray]:
        parts = pc.split_pattern(pa.array([self._lowered(t).replace("\n", " ") for t in texts], pa.large_string()), " ")
        coded = parts.flatten().dictionary_encode()
        found = self._ids(coded.dictionary.to_numpy(zero_copy_only=False).tolist())
        flat = np.frombuffer(b"".join(found), self.small)
        size = np.fromiter(map(len, found), np.int64, len(found)) // self.small.itemsize
        first, which = np.cumsum(size) - size, coded.indices.to_numpy()
        ends = np.concatenate([[0], np.cumsum(size[which])])
        ids = np.empty(ends[-1], self.small)
        for at in range(0, len(which), GATHERED):
            some = which[at : at + GATHERED]
            low, high = ends[at], ends[at + len(some)]
            ids[low:high] = flat[np.repeat(first[some] - ends[at : at + len(some)], size[some]) + np.arange(low, high)]
        return np.split(ids, ends[np.cumsum(pc.list_value_length(parts).to_numpy())[:-1]]) if texts else []


_PIECE = [("start", T.LongType()), ("length", T.LongType()), ("ids_crc32", T.LongType()), ("doc_tokens", T.LongType())]


def _blocks(texts: list[str | None]) -> Iterator[list[str]]:
    block, size = [], 0
    for t in texts:
        block.append(t or "")
        size += len(block[-1])
        if size >= BLOCK_CHARS:
            yield block
            block, size = [], 0
    if block:
        yield block


def pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, sequence: int = SEQUENCE) -> DataFrame:
    """Pieces of at most ``sequence`` ids: id, start, length, ids_crc32, doc_tokens."""
    df = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    schema = T.StructType([df.schema["id"], *(T.StructField(n, t) for n, t in _PIECE)])
    arrow, path, closing = to_arrow_schema(schema), tokenizer or tokenizer_path(), CLOSING.to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store = worker_store("encoders")
        encode = store.get(path) or store.setdefault(path, Encoder(path))
        for batch in batches:
            ids, at = batch.column(0), 0
            for block in _blocks(batch.column(1).to_pylist()):
                rows, columns = [], [[], [], [], []]
                for ids_of in encode(block):
                    raw = ids_of.astype("<u4").tobytes() + closing
                    n = len(raw) // 4
                    for start in range(0, n, sequence):
                        part = raw[4 * start : 4 * (start + sequence)]
                        rows.append(at)
                        for c, v in zip(columns, (start, len(part) // 4, zlib.crc32(part), n), strict=True):
                            c.append(v)
                    at += 1
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(rows, pa.int64())).cast(arrow.field(0).type), *(pa.array(c, pa.int64()) for c in columns)], schema=arrow)

    return df.mapInArrow(run, schema)


@dataclass
class Plan:
    """Pattern ``p`` stands ``copies[p]`` times; ``patterns[p]`` maps a length class to its pieces in one copy."""

    patterns: list[dict[int, int]]
    copies: list[int]

    @property
    def sequences(self) -> int:
        return sum(self.copies)


def _price(duals: np.ndarray, sizes: np.ndarray, room: int) -> tuple[float, dict[int, int]]:
    """The pattern of the highest sum of duals: knapsack by dynamic programming, with repeats."""
    value, last = np.zeros(room + 1), np.full(room + 1, -1)
    fitting = np.searchsorted(sizes, np.arange(room + 1), side="right").tolist()
    for space in range(1, room + 1):
        value[space] = value[space - 1]
        if n := fitting[space]:
            worth = value[space - sizes[:n]] + duals[:n]
            best = int(worth.argmax())
            if worth[best] > value[space]:
                value[space], last[space] = worth[best], best
    pattern: dict[int, int] = {}
    space = room
    while space > 0:
        if (k := int(last[space])) < 0:
            space -= 1
            continue
        pattern[k] = pattern.get(k, 0) + 1
        space -= int(sizes[k])
    return float(value[room]), pattern


def _relax(sizes: np.ndarray, demand: np.ndarray, room: int, gap: float) -> tuple[list[dict[int, int]], np.ndarray]:
    """Patterns and their fractional counts: the linear program by revised simplex, columns made by ``_price``.

    Prices are drawn towards each length's share of a sequence, the duals of a packing without waste, as long as they find
    columns that improve; any prices give a bound on the sequences needed, and within ``gap`` of the best bound it ends.
    """
    m = len(sizes)
    patterns: list[dict[int, int] | None] = [{k: int(room // s)} for k, s in enumerate(sizes)]
    inverse = np.diag(1.0 / (room // sizes))
    amount, cost = inverse @ demand, np.ones(m)
    even, pull, bound = sizes / room, 0.95, 0.0
    for _ in range(100 * m):
        duals = cost @ inverse
        if amount @ cost <= bound * (1 + gap):
            break
        below = int(duals.argmin())
        if duals[below] < -1e-9:  # more of a length than asked for costs nothing
            pattern, entering = None, -inverse[:, below]
        else:
            prices = pull * even + (1 - pull) * duals
            worth, pattern = _price(prices, sizes, room)
            bound = max(bound, float(prices @ demand) / max(1.0, worth))
            at, many = list(pattern), np.array(list(pattern.values()), float)
            if duals[at] @ many <= 1 + 1e-9:
                if pull == 0:
                    break
                pull = pull / 2 if pull > 0.01 else 0.0
                continue
            entering = inverse[:, at] @ many
        ratio = np.where(entering > 1e-9, amount / np.where(entering > 1e-9, entering, 1), np.inf)
        out = int(ratio.argmin())
        pivot, step = inverse[out] / entering[out], ratio[out]
        inverse -= np.outer(entering, pivot)
        inverse[out] = pivot
        amount = np.maximum(amount - step * entering, 0)
        amount[out], cost[out], patterns[out] = step, float(pattern is not None), pattern
    real = [k for k, p in enumerate(patterns) if p is not None]
    return [patterns[k] for k in real], amount[real]


def make_plan(histogram: dict[int, int], room: int, gap: float = GAP) -> Plan:
    """Patterns for ``histogram`` (length class to number of pieces); a pattern's classes sum up to ``room`` at most."""
    classes = np.array(sorted(c for c, n in histogram.items() if n), np.int64)
    plan = Plan([], [])
    if not len(classes):
        return plan
    left = np.array([histogram[int(c)] for c in classes], np.int64)

    def take(pattern: dict[int, int], copies: int) -> None:
        plan.patterns.append({int(classes[k]): n for k, n in pattern.items()})
        plan.copies.append(copies)
        for k, n in pattern.items():
            left[k] -= n * copies

    patterns, amount = _relax(classes, left.astype(float), room, gap)
    for pattern, x in zip(patterns, amount, strict=True):
        copies = min([int(x + 1e-6), *(int(left[k] // n) for k, n in pattern.items())])
        if copies > 0:
            take(pattern, copies)
    for p in sorted(range(len(patterns)), key=lambda p: -(amount[p] % 1)):
        if amount[p] % 1 > 0.3 and all(left[k] >= n for k, n in patterns[p].items()):
            take(patterns[p], 1)
    spare: dict[int, list[int]] = {}  # bins by what room they have left
    open_rooms: list[int] = []
    bins: list[dict[int, int]] = []
    for k in range(len(classes) - 1, -1, -1):
        size = int(classes[k])
        for _ in range(int(left[k])):
            fits = [r for r in spare if r >= size and spare[r]]
            if fits:
                best = min(fits)
                b = spare[best].pop()
            else:
                best, b = room, len(bins)
                bins.append({})
            bins[b][k] = bins[b].get(k, 0) + 1
            spare.setdefault(best - size, []).append(b)
    same: dict[tuple, int] = {}
    for b in bins:
        key = tuple(sorted(b.items()))
        same[key] = same.get(key, 0) + 1
    for key, copies in same.items():
        take(dict(key), copies)
    return plan


#: A class and a rank in one number.
_RANKS = 1 << 50


def _slots(plan: Plan) -> tuple[np.ndarray, ...]:
    """For each (class, pattern), ordered: first rank, first sequence, pieces a copy, first slot."""
    rows, sequence, ranks = [], 0, {}
    for pattern, copies in zip(plan.patterns, plan.copies, strict=True):
        slot = 0
        for size in sorted(pattern, reverse=True):
            rank = ranks.get(size, 0)
            rows.append((size * _RANKS + rank, sequence, pattern[size], slot))
            ranks[size] = rank + pattern[size] * copies
            slot += pattern[size]
        sequence += copies
    rows.sort()
    return tuple(np.array(c, np.int64) for c in zip(*rows, strict=True)) if rows else (np.zeros(0, np.int64),) * 4


def assign(ranked: DataFrame, plan: Plan) -> DataFrame:
    """Adds ``sequence_id`` and ``slot`` to pieces with ``class`` and ``rank``."""
    first, sequence, each, slot = _slots(plan)
    size_at, rank_at = ranked.columns.index("class"), ranked.columns.index("rank")

    def make():
        def of(batch):
            key = batch.column(size_at).to_numpy(zero_copy_only=False) * _RANKS + batch.column(rank_at).to_numpy(zero_copy_only=False)
            row = np.searchsorted(first, key, side="right") - 1
            copy, place = np.divmod(key - first[row], each[row])
            return [pa.array(sequence[row] + copy), pa.array(slot[row] + place)]

        return of

    return append_columns(ranked, make, [T.StructField("sequence_id", T.LongType()), T.StructField("slot", T.LongType())])


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, sequence: int = SEQUENCE, unit: int = UNIT) -> DataFrame:
    """One row per piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    cut = pieces(docs, id_col, text_col, tokenizer, sequence).withColumn("class", F.ceil(F.col("length") / unit).cast("long"))
    cut = materialise(cut.withColumn("piece", F.monotonically_increasing_id()), "pieces")  # written, so that the number stays
    counts = cut.groupBy("class").agg(F.count("*").alias("n"))
    histogram = {r["class"]: r.n for r in counts.collect()}  # sequence / unit rows at most
    plan = make_plan(histogram, sequence // unit)
    salts = F.broadcast(counts.select("class", F.ceil(F.sqrt("n")).cast("long").alias("salts")))  # as many rows
    salted = cut.join(salts, "class").withColumn("salt", F.pmod(F.xxhash64("piece"), "salts")).drop("salts")
    groups = salted.groupBy("class", "salt").agg(F.count("*").alias("n"))
    before = Window.partitionBy("class").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    groups = groups.select("class", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    within = Window.partitionBy("class", "salt").orderBy("id", "start", "piece")
    ranked = salted.withColumn("place", F.row_number().over(within)).join(groups, ["class", "salt"])
    ranked = ranked.withColumn("rank", F.col("before") + F.col("place") - 1).select("id", "start", "length", "ids_crc32", "doc_tokens", "class", "rank")
    filled = Window.partitionBy("sequence_id").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    placed = assign(ranked, plan).withColumn("offset", F.coalesce(F.sum("length").over(filled), F.lit(0)).cast("long"))
    return placed.select(F.col("id").alias(id_col), "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
