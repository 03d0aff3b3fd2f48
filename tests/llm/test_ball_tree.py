import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from tablesync.llm import ball_tree

ITEM = "item_id long, text string, score string, rank string, id string"


def terms_of(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", low)


def slow_ranked(rows, items, k=10):
    held = [(i, Counter(terms_of(t))) for i, t in rows]
    held = [(i, c, sum(c.values())) for i, c in held if c]
    n_docs, n_terms = len(held), sum(n for _, _, n in held)
    df = Counter(t for _, c, _ in held for t in c)
    asked = {}
    for item, text in items:
        asked.setdefault(item, set()).update(terms_of(text))
    out = []
    for item, terms in asked.items():
        scores = []
        for i, c, n in held:
            m = 100 - 90 + (90 * n * n_docs) // n_terms
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 8 * m)) for t in terms if c[t])
            if score > 0:
                scores.append((-score, i is not None, i))
        scores.sort(key=lambda x: (x[0], x[1], x[2] or 0))
        out += [(item, r, x[2], -x[0]) for r, x in enumerate(scores[:k], 1)]
    return sorted(out, key=repr)


def corpus(seed, size=300):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(60)] + ["Ünï", "漢字", "é", "x1"]
    texts = [" ".join(rng.choices(words, [1 / (1 + i) for i in range(len(words))], k=rng.randint(1, 40))) for _ in range(size)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(1000 + i, texts[3]) for i in range(60)] + [(5, texts[4])]
    items = [(i, " ".join(rng.choices(words, k=rng.randint(1, 9)))) for i in range(25)]
    return rows, items


@pytest.mark.parametrize("tree_size, leaf, block", [(4096, 32, 1 << 17), (50, 4, 1 << 17), (64, 1, 60)])
def test_equals_brute_force(spark, docs, odd, tree_size, leaf, block):
    rows, items = corpus(leaf)
    rows, items = rows + odd, [*items, (77, None), (78, ""), (79, "..."), (80, "W1 w1, W1!"), (None, "w2 w3"), (81, "no such term"), (3, "w59 same text"), (82, "long"), (82, "text")]
    asked = spark.createDataFrame([(i, t, "s", "r", "i") for i, t in items], ITEM)
    found = ball_tree.ranked(docs(rows), asked, tree_size=tree_size, leaf=leaf, block_chars=block)
    assert found.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted((tuple(r) for r in found.collect()), key=repr) == slow_ranked(rows, items)


def test_bounds_hold_and_prune():
    rng = np.random.default_rng(5)
    dims, middle = 400, rng.integers(0, 400, (20, 12))
    cols = [np.unique(np.concatenate([middle[i % 20], rng.integers(0, dims, 2)])) for i in range(2000)]
    lengths = np.array([len(c) for c in cols])
    rows = ball_tree.Rows(np.concatenate(cols), rng.integers(10_000, 1_000_000, lengths.sum()), lengths, np.arange(2000))
    asked = [np.unique(middle[i]) for i in range(20)]
    sizes = np.array([len(a) for a in asked])
    questions = ball_tree.Rows(np.concatenate(asked), rng.integers(1, 9000, sizes.sum()), sizes, np.arange(20))
    tree = ball_tree.Tree(rows, dims, questions)
    below = {}
    for node in range(len(tree.bounds) - 1, -1, -1):
        part = tree.leaves[node]
        below[node] = part.names.tolist() if part is not None else sum((below[c] for c in tree.children[node]), [])
    best = ball_tree.Best(20, 10)
    opened = ball_tree.search(tree, questions, dims, list(range(2000)), best)
    for q in range(20):
        dense = np.zeros(dims, np.int64)
        dense[questions.row(q)[0]] = questions.row(q)[1]
        scores = rows.dot(dense)
        assert all(scores[below[n]].max() <= tree.bounds[n][q] for n in below)
        assert [(-s, i) for s, _, i in best.found[q]] == sorted(((int(s), i) for i, s in enumerate(scores)), key=lambda x: (-x[0], x[1]))[:10]
    leaves = sum(x is not None for x in tree.leaves)
    assert sorted(below[0]) == list(range(2000)) and opened < 0.5 * 20 * leaves


def test_nothing(spark, docs):
    rows, items = corpus(1, 5)
    none = spark.createDataFrame([], ITEM)
    asked = spark.createDataFrame([(i, t, "s", "r", "i") for i, t in items], ITEM)
    assert ball_tree.ranked(docs(rows), none).collect() == []
    assert ball_tree.ranked(docs([]), asked).collect() == []
    assert ball_tree.ranked(docs([(1, None), (2, "")]), asked).collect() == []


def test_long_texts_in_pieces(monkeypatch):
    text = " ".join(f"w{i % 7}" for i in range(500)) + "y" * 300
    monkeypatch.setattr(ball_tree, "PIECE", 16)
    assert [w for part in ball_tree.pieces(text) for w in part] == [w.encode() for w in text.split()]
