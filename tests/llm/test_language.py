import math
import random
import zlib
from collections import Counter

import numpy as np

from tablesync.llm import language


def corpus(n=240, seed=1):
    rng = random.Random(seed)
    parts = {"aa": ["the", "and", "of", "ing", "ther"], "bb": ["der", "und", "sch", "ung", "über"], "cc": ["que", "les", "ment", "été", "aux"]}
    rows = []
    for i in range(n):
        lang = rng.choice([*parts])
        text = " ".join("".join(rng.choices(parts[lang], k=rng.randint(1, 3))) for _ in range(rng.randint(5, 40)))
        rows.append((i, text, lang if rng.random() < 0.9 else None))
    return rows


def slow_bits(counts, text):
    """Code length by walking the contexts, from the kept stretches."""
    trees = []
    for grams, n in zip(counts.grams, counts.counts, strict=True):
        tree = {}
        for g, c in zip(grams.tolist(), n.tolist(), strict=True):
            raw = g.to_bytes(4, "big")
            for order in range(4):
                tree.setdefault(raw[3 - order : 3], Counter())[raw[3]] += c
        trees.append(tree)
    raw = b"   " + text.encode().lower()
    out = []
    for tree in trees:
        bits = 0.0
        for i in range(3, len(raw)):
            for order in (3, 2, 1, 0, -1):
                if order < 0:
                    bits += 8
                    break
                seen = tree.get(raw[i - order : i])
                if not seen:
                    continue
                whole = sum(seen.values()) + len(seen)
                if raw[i] in seen:
                    bits -= math.log2(seen[raw[i]] / whole)
                    break
                bits -= math.log2(len(seen) / whole)
        out.append(bits)
    return out


def test_counts_are_exact(docs):
    rows = corpus(60)
    want = Counter()
    for i, text, lang in rows:
        if lang and zlib.crc32(str(i).encode()) % 3 != 1:
            raw = b"   " + text.encode().lower()
            want.update((lang, raw[k : k + 4]) for k in range(len(raw) - 3))
    counts = language.fit(docs(rows))
    got = {(lang, int(g).to_bytes(4, "big")): int(n) for lang, gs, ns in zip(counts.languages, counts.grams, counts.counts, strict=True) for g, n in zip(gs, ns, strict=True)}
    assert got == want


def test_code_lengths(docs):
    rows = corpus(60)
    counts = language.fit(docs(rows))
    tables = language.Tables(counts)
    texts = [t for _, t, _ in rows[:10]] + ["zzz ünseen 漢字 the", "a", "über " * 50]
    got = tables.bits_of([language._raw(t) for t in texts])
    assert np.allclose(got, [slow_bits(counts, t) for t in texts], rtol=1e-4)


def test_a_small_language_keeps_its_contexts_beside_a_large_one(docs):
    rng = random.Random(4)
    letters = [chr(c) for c in range(0x4E00, 0x4E00 + 3000)]
    rows = [(i, "".join(rng.choices(letters, k=400)), "zz") for i in range(300)]
    rows += [(1000 + i, t, "aa") for i, (_, t, _) in enumerate(corpus(40))]
    counts = language.fit(docs(rows))
    assert counts.languages == ["aa", "zz"] and len(counts.grams[1]) > 60_000  # nothing is left out
    texts = ["the andther ing", "".join(rng.choices(letters, k=30)), "über 漢字"]
    got = language.Tables(counts).bits_of([language._raw(t) for t in texts])
    assert np.allclose(got, [slow_bits(counts, t) for t in texts], rtol=1e-4)


def test_held_out_accuracy(docs):
    rows = corpus()
    lang = {i: x for i, _, x in rows}
    out = language.languages(docs(rows)).collect()
    held = [r for r in out if r.held_out and lang[r.doc_id]]
    assert {r.doc_id for r in out if r.held_out} == {i for i in lang if zlib.crc32(str(i).encode()) % 3 == 1}
    assert sum(r.lang_pred == lang[r.doc_id] for r in held) / len(held) > 0.98 and all(0 <= r.score <= 1 for r in out)


def test_odd_rows(docs, odd):
    out = language.languages(docs(odd + corpus(60))).collect()
    assert len(out) == len(odd) + 60
    by = {r.doc_id: r for r in out if r.doc_id in (-3,)}
    assert by[-3].lang_pred in ("aa", "bb", "cc")
    again = language.predict([None, "", "...", "12 34"], None, [])
    assert again == (["und"] * 4, [0.0] * 4)


def test_nothing_to_learn(docs, odd):
    assert {r.lang_pred for r in language.languages(docs(odd)).collect()} == {"und"}
    assert language.languages(docs([])).collect() == []
