"""Spelling variants by a variable-length gram index.

A gram starts at every letter of a word and grows until the vocabulary holds it at most ``prune`` times; it ends there, at a
longest length, or at the end of the word. The grams that go on growing are the dictionary: those that occur more often than
that, counted over the whole vocabulary. ``prune`` rises with the vocabulary so that the dictionary never has more than
``5 * DICTIONARY`` entries, and it is the only thing that every task gets whole.

What a gram is depends on the letters it covers alone (and on the end of the word, if it was cut there), so one edit can only
affect the grams that cover its place. Grams of one word that cover no place in common are affected by it one at a time: of
two of them, at least one stands unharmed in any word that is one edit away, at the same place or moved by one. So every word
is entered in the lists of all its grams, a list being a gram, a word length and a place, and asks only the two lists that
are shortest by the dictionary among pairs of grams with no place in common. Both lists are merged and each candidate is
verified by its edit distance. Words over ``LONG`` letters have their two halves as grams.

A list that is too long to compare with everything that asks it is not merged. Its words, and those that ask it, are joined
over what is left of them when one letter is left out, which finds the same pairs and grows with the number of words. Both
ways are exact, no pair is lost.

Defined results: null and empty texts have no words; a null id counts as empty text in the hash. An empty table gives an empty
result. Repeated rows count each time. Columns other than id and text are not looked at. A word in a long list costs the
square of its length there; elsewhere all is linear in the texts.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablesync.llm.common import root_of
from tablesync.session import materialise

#: Fewest letters of a word, shortest gram and longest gram.
LETTERS, SHORTEST, LONGEST = 7, 2, 7
#: A gram that the vocabulary holds more often grows on; most grams of one length that do.
PRUNE, DICTIONARY = 512, 20_000
#: Words of more letters have two grams, their halves.
LONG = 64
#: Entries or questions from which a list counts as too long to be merged.
HOT_LIST = 128
#: Words that a task counts before it hands them on.
COUNTED = 300_000
#: Every how manyth hash deletes a letter.
EVERY = 31

_LOWER = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))


def runs(text: str | None, least: int) -> Counter:
    """Maximal runs of at least ``least`` letters, A-Z lower-cased, one byte a letter, with their counts."""
    data = text.encode("latin-1", "replace").translate(_LOWER) if text else b""
    pattern = re.compile(rb"[a-z\xc0-\xff]{%d,}" % least)
    return Counter(pattern.findall(data) if len(data) < 1 << 22 else map(re.Match.group, pattern.finditer(data)))


def typed(run: bytes, seeded: int, every: int) -> bytes:
    """``run``, less one letter if its hash says so; ``seeded`` is the hash of what stands before it."""
    hashed = zlib.crc32(run if run.isascii() else run.decode("latin-1").encode("utf-8"), seeded)
    if hashed % every:
        return run
    at = hashed % len(run)
    return run[:at] + run[at + 1 :]


def _handed_on(counts: Counter) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([w.decode("latin-1") if isinstance(w, bytes) else w for w in counts], pa.string()), pa.array(counts.values(), pa.int64())], names=["word", "n"])


def vocabulary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", letters: int = LETTERS, least: int = 2, every: int = EVERY) -> DataFrame:
    """``(word, n)`` of words with at least ``letters`` letters that occur ``least`` times or more."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                seeded = zlib.crc32(f"{'' if key is None else key}:".encode())
                for run, n in runs(text.as_py(), letters).items():
                    word = typed(run, seeded, every)
                    if len(word) >= letters:
                        total[word] += n
                if len(total) > COUNTED:
                    yield _handed_on(total)
                    total.clear()
        yield _handed_on(total)

    rows = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


def gram_dictionary(words: DataFrame) -> tuple[dict[str, int], int]:
    """Grams of two to six letters that occur over ``prune`` times in the vocabulary, with their counts, and ``prune``."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        for batch in batches:
            short = [w for w in batch.column(0).to_pylist() if len(w) <= LONG]
            for size in range(SHORTEST, LONGEST):
                total.update(w[p : p + size] for w in short for p in range(len(w) - size + 1))
            if len(total) > COUNTED:
                yield _handed_on(total)
                total.clear()
        yield _handed_on(total)

    places = words.agg(F.sum(F.when(F.length("word") <= LONG, F.length("word")))).first()[0] or 0
    prune = max(PRUNE, places // DICTIONARY)
    counted = words.select("word").mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    found = counted.where(F.col("n") > prune).toArrow()
    return dict(zip(found.column(0).to_pylist(), found.column(1).to_pylist(), strict=True)), prune


def grams(word: str, longest: int, dictionary: dict[str, int]) -> list[tuple[int, int, int]]:
    """``(start, end, last)`` of the gram at each letter; ``last`` is the last place an edit at which affects it."""
    found, size = [], len(word)
    for p in range(size - SHORTEST + 1):
        end, most = p + SHORTEST, min(p + longest, size)
        while end < most and word[p:end] in dictionary:
            end += 1
        cut = end == size and end < p + longest and word[p:end] in dictionary
        found.append((p, end, size if cut else end - 1))
    return found


def _two(word: str, parts: list[tuple[int, int, int]], dictionary: dict[str, int], prune: int) -> tuple[tuple, tuple]:
    """The two grams with no place in common whose lists are shortest by the dictionary, the earlier one first."""
    cost = [dictionary.get(word[p:end], prune // 2) for p, end, _ in parts]
    best, chosen, k, left = None, None, 0, None
    for b, (p, _, _) in enumerate(parts):
        while parts[k][2] < p:  # the last places never go back from one gram to the next
            if left is None or cost[k] < cost[left]:
                left = k
            k += 1
        if left is not None and (best is None or cost[left] + cost[b] < best):
            best, chosen = cost[left] + cost[b], (parts[left], parts[b])
    return chosen


def _split(word: str, short: int, dictionary: dict[str, int]) -> list[tuple[int, int, int]]:
    """Grams of ``word`` for an index of words of ``short`` letters."""
    if short > LONG:
        half, size = short // 2, len(word)
        return [(0, half, half - 1), (size - half, size, size - 1)]
    return grams(word, min(short - SHORTEST, LONGEST), dictionary)


def _key(gram: str, short: int, place: int) -> int:
    return int.from_bytes(xxhash.xxh64_digest(f"{short},{place},{gram}"), "big", signed=True)


def entries(word: str, letters: int, dictionary: dict[str, int], prune: int) -> tuple[list[int], list[int]]:
    """Keys of the lists that hold ``word``, and of those it asks: words of its length, and of one letter less."""
    size = len(word)
    parts = _split(word, size, dictionary)
    held = [_key(word[p:end], size, p) for p, end, _ in parts]
    asked = [_key(word[p:end], size, p) for p, end, _ in _two(word, parts, dictionary, prune)]
    if size > letters:
        first, second = _two(word, _split(word, size - 1, dictionary), dictionary, prune)
        # A letter left out behind the first gram leaves it where it is, any other moves the second by one place.
        asked += [_key(word[first[0] : first[1]], size - 1, first[0]), _key(word[second[0] : second[1]], size - 1, second[0] - 1)]
    return held, asked


def near_words(words: DataFrame, letters: int = LETTERS, hot: int = HOT_LIST) -> DataFrame:
    """``(a, a_n, b, b_n)``, each pair of words at edit distance one once, with their counts."""
    if letters < SHORTEST + 5:
        raise ValueError("words need seven letters at least")
    dictionary, prune = gram_dictionary(words)

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, counts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for at in range(0, len(texts), 4096):
                keys, asks, rows = [], [], []
                for i in range(at, min(at + 4096, len(texts))):
                    for ask, found in enumerate(entries(texts[i], letters, dictionary, prune)):
                        keys += found
                        asks += [bool(ask)] * len(found)
                        rows += [i] * len(found)
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(asks, pa.bool_()), batch.column(0).take(pa.array(rows, pa.int32())), pa.array([counts[i] for i in rows], pa.int64())], names=["key", "asks", "word", "n"])

    lists = materialise(words.select("word", "n").mapInArrow(index, "key long, asks boolean, word string, n long"), "grams")
    sizes = lists.groupBy("key").agg(F.count_if(~F.col("asks")).alias("held"), F.count_if("asks").alias("asked")).where("held > 0 AND asked > 0")
    sizes = materialise(sizes.select("key", (F.greatest("held", "asked") > hot).alias("long")), "lists")
    met = materialise(lists.join(sizes, "key"), "met")
    few = met.where(~F.col("long"))
    a = few.where(~F.col("asks")).select("key", F.col("word").alias("a"), F.col("n").alias("a_n"))
    b = few.where("asks").select("key", F.col("word").alias("b"), F.col("n").alias("b_n"))
    merged = a.join(b, "key").where((F.col("a") != F.col("b")) & (F.levenshtein("a", "b", 1) == 1)).drop("key")
    crowd = met.where("long").select("word", "n").distinct()
    both = materialise(_ordered(merged).union(_ordered(_one_left_out(crowd))), "near")
    return both.distinct()


def _ordered(pairs: DataFrame) -> DataFrame:
    a, b = F.struct(F.col("a").alias("w"), F.col("a_n").alias("n")), F.struct(F.col("b").alias("w"), F.col("b_n").alias("n"))
    pairs = pairs.select(F.least(a, b).alias("x"), F.greatest(a, b).alias("y"))
    return pairs.select(F.col("x.w").alias("a"), F.col("x.n").alias("a_n"), F.col("y.w").alias("b"), F.col("y.n").alias("b_n"))


def _one_left_out(words: DataFrame) -> DataFrame:
    """Pairs at edit distance one by a join over the words less one letter."""
    rests = F.expr("transform(sequence(1, length(word)), i -> concat(substring(word, 1, i - 1), substring(word, i + 1)))")
    cut = words.select(F.col("word"), F.col("n"), F.posexplode(rests).alias("at", "rest"))
    a = cut.select("at", "rest", F.col("word").alias("a"), F.col("n").alias("a_n"))
    b = cut.select("at", "rest", F.col("word").alias("b"), F.col("n").alias("b_n"))
    replaced = a.join(b, ["at", "rest"]).where("a < b").select("a", "a_n", "b", "b_n")
    whole = words.select(F.col("word").alias("rest"), F.col("word").alias("b"), F.col("n").alias("b_n"))
    return replaced.union(a.join(whole, "rest").select("a", "a_n", "b", "b_n"))


def spelling_forms(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", letters: int = LETTERS, least: int = 2, times: int = 10, hot: int = HOT_LIST) -> DataFrame:
    """One row per word of the corpus: word, form, root, n, n_near, form_n.

    ``form`` is the near word of largest n (ties: smallest) if that n is at least ``times`` the word's, ``root`` where forms end.
    """
    words = materialise(vocabulary(docs, id_col, text_col, letters, least), "words")
    near = near_words(words, letters, hot)
    sides = near.select(F.col("a").alias("word"), F.col("b").alias("other"), F.col("b_n").alias("other_n"))
    sides = sides.union(near.select(F.col("b"), F.col("a"), F.col("a_n")))
    best = sides.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("less"), "other")).alias("best"))
    found = words.join(best, "word", "left").withColumn("fits", -F.col("best.less") >= times * F.col("n"))
    found = found.select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(F.col("fits"), F.col("best.other")).alias("form"), F.when(F.col("fits"), -F.col("best.less")).alias("form_n"))
    found = materialise(found, "forms")
    roots = root_of(found.where("form IS NOT NULL").select("word", "form"))
    return found.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


ORACLE = r"""
WITH RECURSIVE poly AS (
  SELECT list_transform(range(256), lambda i: list_reduce(list_concat([CAST(i AS BIGINT)], range(8)),
    lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
found AS (
  SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run
  FROM documents),
counted AS (SELECT doc_id, run, count(*) AS n FROM found WHERE length(run) >= 7 GROUP BY ALL),
bytes AS (
  SELECT run, n, flatten(list_transform(string_split(doc_id || ':' || run, ''), lambda c: CASE WHEN unicode(c) < 128 THEN [CAST(unicode(c) AS BIGINT)]
    ELSE [CAST(192 + (unicode(c) >> 6) AS BIGINT), CAST(128 + (unicode(c) & 63) AS BIGINT)] END)) AS b
  FROM counted),
hashed AS (
  SELECT run, n, xor(list_reduce(list_concat([CAST(4294967295 AS BIGINT)], b), lambda c, x: xor(c >> 8, t[1 + (xor(c, x) & 255)])), 4294967295) AS h
  FROM bytes, poly),
words AS (
  SELECT word, CAST(sum(n) AS BIGINT) AS n
  FROM (SELECT CASE WHEN h % 31 = 0 THEN left(run, CAST(h % length(run) AS INT)) || substr(run, CAST(h % length(run) AS INT) + 2) ELSE run END AS word, n FROM hashed)
  WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
cut AS (
  SELECT word, n, i, left(word, CAST(i AS INT)) || substr(word, CAST(i AS INT) + 2) AS rest
  FROM (SELECT word, n, unnest(range(length(word))) AS i FROM words)),
near AS (
  SELECT a.word, b.word AS other, b.n AS other_n FROM cut a JOIN cut b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT a.word, w.word, w.n FROM cut a JOIN words w ON a.rest = w.word
  UNION SELECT w.word, a.word, a.n FROM cut a JOIN words w ON a.rest = w.word),
best AS (
  SELECT word, count(*) AS n_near, first(other ORDER BY other_n DESC, other) AS other, max(other_n) AS other_n FROM near GROUP BY word),
forms AS (
  SELECT w.word, w.n, CAST(coalesce(n_near, 0) AS BIGINT) AS n_near,
         CASE WHEN other_n >= 10 * w.n THEN other END AS form, CASE WHEN other_n >= 10 * w.n THEN other_n END AS form_n
  FROM words w LEFT JOIN best b ON w.word = b.word),
walk AS (
  SELECT word, word AS at FROM forms
  UNION ALL SELECT k.word, f.form FROM walk k JOIN forms f ON k.at = f.word WHERE f.form IS NOT NULL)
SELECT f.word, f.form, k.at AS root, f.n, f.n_near, f.form_n
FROM forms f JOIN walk k ON f.word = k.word JOIN forms last ON k.at = last.word AND last.form IS NULL
"""
