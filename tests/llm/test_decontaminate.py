import hashlib
import random
import re

import numpy as np
import pytest

from tablesync.llm import decontaminate as d


def words(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def brute(rows, items, window=13):
    out = {}
    phrases = [(i, tuple(w[k : k + window])) for i, t in items for w in [words(t)] for k in range(max(1, len(w) - window + 1) if w else 0)]
    for doc, text in rows:
        w, hit, found = words(text), set(), set()
        for item, p in phrases:
            for k in range(len(w) - len(p) + 1):
                if tuple(w[k : k + len(p)]) == p:
                    hit.update(range(k, k + len(p)))
                    found.add(str(item))
        digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out[doc] = (len(w), len(hit), len(found), digest, bool(hit) and 20 * len(hit) >= len(w))
    return out


def corpus(seed=3):
    rng = random.Random(seed)
    vocabulary = ["alpha", "Beta", "gamma", "délta", "5", "eps"]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.choice([1, 2, 5, 13, 14, 30])))) for i in range(12)] + [(50, None), (51, "..."), (52, "Beta, Beta")]
    rows = []
    for i in range(40):
        parts = []
        for _ in range(rng.randint(0, 6)):
            parts.append(" ".join(rng.choices([*vocabulary, "noise", "more"], k=rng.randint(1, 40))))
            if rng.random() < 0.4:
                parts.append((rng.choice(items)[1] or "").upper())
        rows.append((i, rng.choice([" ", "\n", "--"]).join(parts)))
    return rows, items


def frame(spark, items):
    return spark.createDataFrame(items, "item_id long, text string")


@pytest.mark.parametrize("least", [1, 5])
def test_against_brute_force(spark, docs, least):
    rows, items = corpus()
    items = [x for x in items if len(words(x[1])) >= least or not words(x[1])]
    rows += [(100, None), (101, ""), (102, "word " * 5000)]
    got = {r.doc_id: tuple(r)[1:] for r in d.contamination_digest(docs(rows), frame(spark, items)).collect()}
    assert got == brute(rows, items)


def test_blocks_of_the_query_set_change_nothing(spark, docs):
    rows, items = corpus(5)
    table = docs(rows).select("doc_id", "text")
    one = d.with_spans(table, "text", frame(spark, items))
    many = d.with_spans(table, "text", frame(spark, items), block_chars=100)
    assert many.columns == one.columns
    as_set = lambda f: {(r.doc_id, r.n_words, tuple(map(tuple, d.merged([tuple(s) for s in r.spans]))), tuple(r["items"])) for r in f.collect()}
    assert as_set(one) == as_set(many)


def test_fm_index_counts_and_locates():
    rng = np.random.default_rng(1)
    for n in (3, 50, 400):
        symbols = rng.integers(0, 4, n)
        symbols[0] = symbols[-1] = 0
        index = d.FMIndex(symbols, 4)
        for size in (1, 2, 3):
            phrase = rng.integers(1, 5, size)
            low, high = index.search(phrase[None, :], np.array([size]))
            at = sorted(index.locate(np.arange(low[0], high[0])).tolist())
            assert at == [i for i in range(n - size + 1) if (symbols[i : i + size] == phrase).all()]


def test_empty_tables(spark, docs):
    assert d.contamination_digest(docs([]), frame(spark, [(1, "a b")])).collect() == []
    clean = d.contamination_digest(docs([(1, "a b")]), frame(spark, [])).first()
    assert tuple(clean)[:4] == (1, 2, 0, 0) and not clean.contaminated


def test_stage_and_removal(spark, docs):
    rows = [(1, "clean text"), (2, "before ONE two three after"), (3, None), (4, "one two three " + "filler " * 100)]
    items = frame(spark, [(1, "one two three")])
    table = docs(rows)
    out = d.drop_contaminated(table, items)
    assert out.columns == table.columns and sorted(r.doc_id for r in out.collect()) == [1, 3, 4]
    found = {r.doc_id: [tuple(s) for s in r.spans] for r in d.contamination(table, items).collect()}
    assert d.remove_spans(rows[1][1], found[2]).split() == ["before", "after"]
