import random
import re
import zlib
from collections import Counter

import pytest

from tablesync.llm import spelling


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def slow_words(rows):
    counts = Counter()
    for i, text in rows:
        for run in re.findall(r"[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}


def slow_forms(words):
    rows = {}
    for w, n in words.items():
        near = [(-m, x) for x, m in words.items() if one_edit(w, x)]
        best = min(near, default=None)
        form = best[1] if best and -best[0] >= 10 * n else None
        rows[w] = [form, n, len(near), -best[0] if form else None]
    for w, row in rows.items():
        root = w
        while rows[root][0]:
            root = rows[root][0]
        row.insert(1, root)
    return {w: tuple(r) for w, r in rows.items()}


def vocabulary(seed, size=400):
    rng = random.Random(seed)
    parts = ["men", "te", "ción", "tion", "ra", "é", "ba", "lo", "ing", "s"]
    base = ["".join(rng.choice(parts) for _ in range(rng.randint(3, 6))) for _ in range(size)]
    out = set(w for w in base if len(w) >= 7)
    for w in list(out):
        for _ in range(3):
            i, c = rng.randrange(len(w)), rng.choice("abénz")
            out.add(rng.choice([w[:i] + w[i + 1 :], w[:i] + c + w[i + 1 :], w[:i] + c + w[i:], w + c, c + w]))
    out |= {"y" * 40 + "abc" * 20, "y" * 40 + "abc" * 20 + "d", "y" * 40 + "abc" * 19 + "abd", "q" * 64, "q" * 65, "q" * 66}
    return {w: rng.choice([2, 3, 40, 900]) for w in out if len(w) >= 7}


@pytest.mark.parametrize("prune, hot", [(1, 128), (20, 128), (20, 3), (512, 128), (512, 0)])
def test_near_words_equal_all_pairs(spark, monkeypatch, prune, hot):
    monkeypatch.setattr(spelling, "PRUNE", prune)
    words = vocabulary(prune)
    found = spelling.near_words(spark.createDataFrame(list(words.items()), "word string, n long"), hot=hot).collect()
    want = {(a, b) for a in words for b in words if a < b and one_edit(a, b)}
    assert len(found) == len(want) and {(r.a, r.b) for r in found} == want
    assert all(words[r.a] == r.a_n and words[r.b] == r.b_n for r in found)


def test_one_of_two_grams_survives_any_edit():
    rng = random.Random(3)
    dictionary = {g: rng.randint(3, 50) for w in vocabulary(5) for s in range(2, 7) for g in (w[p : p + s] for p in range(len(w) - s + 1)) if rng.random() < 0.7 or s < 4}
    dictionary = {g: n for g, n in dictionary.items() if all(g[a:b] in dictionary for a in range(len(g)) for b in range(a + 2, len(g) + 1))}
    for word in vocabulary(5):
        held = set(spelling.entries(word, 7, dictionary, 10)[0])
        for i in range(len(word)):
            for other in {word[:i] + "z" + word[i + 1 :], word[:i] + "z" + word[i:], word + "z"}:
                assert held & set(spelling.entries(other, 7, dictionary, 10)[1])


def test_documents(spark, docs, odd):
    rng = random.Random(1)
    words = list(vocabulary(2, 60))
    rows = odd + [(100 + i, " ".join(rng.choices(words, [1 + 300 * (k % 7 == 0) for k in range(len(words))], k=400))) for i in range(20)]
    rows += [(900, "ÉCOLEÉ×TÉ école÷éàü ÉCOLEÉ×TÉĀabcdefgh\U0001f600abcdefgh"), (None, "threlyes threlyes"), (901, "threlyes-threlye threlye_threlyes")]
    frame = docs(rows)
    found = spelling.spelling_forms(frame)
    assert found.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    got = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in found.collect()}
    assert got == slow_forms(slow_words(rows)) and any(v[0] for v in got.values())


def test_nothing(docs):
    assert spelling.spelling_forms(docs([])).collect() == []
    assert spelling.spelling_forms(docs([(1, None), (2, "short words only")])).collect() == []


def test_roots_end_long_ways(spark):
    from tablesync.llm.common import root_of

    steps = spark.createDataFrame([(f"w{i:03}", f"w{i + 1:03}") for i in range(70)] + [("x", "w003")], "word string, form string")
    assert {r.word: r.root for r in root_of(steps).collect()} == {**{f"w{i:03}": "w070" for i in range(70)}, "x": "w070"}
