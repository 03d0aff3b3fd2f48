import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from tablesync.llm import packing


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(packing.tokenizer_path())


def ids_of(tokenizer, text):
    return [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]


def check(rows, out, tokenizer):
    """Every id in one piece, pieces with the right digests, sequences gapless and not too long."""
    want = sorted((i, len(ids := ids_of(tokenizer, t)), zlib.crc32(np.array(ids, "<u4").tobytes())) for i, t in rows if i is not None and len(ids_of(tokenizer, t)) <= 2048)
    single = sorted((r.doc_id, r.doc_tokens, r.ids_crc32) for r in out if r.doc_id is not None and r.doc_tokens <= 2048)
    assert single == want
    for i, t in rows:
        ids = ids_of(tokenizer, t)
        for r in out:
            if r.doc_id == i and r.doc_tokens == len(ids) > 2048:
                assert zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes()) == r.ids_crc32
    assert sum(r.length for r in out) == sum(len(ids_of(tokenizer, t)) for _, t in rows)
    sequences = defaultdict(list)
    for r in out:
        sequences[r.sequence_id].append((r.offset, r.length))
    assert sorted(sequences) == list(range(len(sequences)))
    for parts in sequences.values():
        parts.sort()
        assert [o for o, _ in parts] == [sum(n for _, n in parts[:k]) for k in range(len(parts))]
        assert sum(n for _, n in parts) <= 2048
    return len(sequences)


def test_documents(docs, odd, tokenizer):
    rng = random.Random(4)
    rows = odd + [(1000 + i, " ".join(rng.choices(["The", "quick", "brown.", "fox", "Zürich,", "l'été", "漢字", "42"], k=rng.randint(1, 900)))) for i in range(300)]
    out = packing.pack(docs(rows)).collect()
    n = check(rows, out, tokenizer)
    assert sum(r.length for r in out) / (2048 * n) > 0.97


def test_empty(docs):
    assert packing.pack(docs([])).collect() == []


TEXTS = ["a\tb \u2003 c d e\x1cf it's I'LL don't\n\nfoo<|endoftext|>bar <|startoftext|>", "é ́x", "ΑΣ ΟΔΟΣ.", "日本語 テスト 123 45\r\n", "\u200b x\x85y \ufeff", "<|endoftext|>", "İstanbul ﬁ 가 각", "a ̸= b", "x\u0000y", "Wort. Ende!! a.. ...", "Straße, ẞ Å Å", "ǅ ǈ ...!?", "", "  ", "\n"]


def test_encoder_equals_the_tokenizer(tokenizer, monkeypatch):
    encode = packing.Encoder(packing.tokenizer_path())
    for text, ids in zip(TEXTS, encode(TEXTS), strict=True):
        assert ids.tolist() == tokenizer.encode(text, add_special_tokens=False).ids, text
    monkeypatch.setattr(packing, "REMEMBERED", 2)
    for text in TEXTS * 2:
        assert encode([text])[0].tolist() == tokenizer.encode(text, add_special_tokens=False).ids


def test_closing_marks_cost_no_new_word(tokenizer, monkeypatch):
    """A word is learnt once, whatever marks close it, and only what isn't a word goes through the whole tokenizer."""
    words, marks = ["thedtiea", "écheau", "Straße", "ÖFEN", "x1", "漢字"], [a + b for a in packing.Encoder.MARKS + "'<|>" for b in ("", "$$$", ",", "'", ">")]
    texts = [w + m for w in words for m in marks] + [m + w for w in words for m in marks] + marks + ["it's, DON'T! 'll. ''. -_- é\u0301. a\u0338= 3.14! x<|endoftext|> x<|endoftext|>. <|endoftext|"]
    encode = packing.Encoder(packing.tokenizer_path())
    for text, ids in zip([*texts, " ".join(texts)], encode([*texts, " ".join(texts)]), strict=True):
        assert ids.tolist() == tokenizer.encode(text, add_special_tokens=False).ids, text
    encode, whole = packing.Encoder(packing.tokenizer_path()), []
    monkeypatch.setattr(encode, "_whole", lambda texts, real=encode._whole: (whole.extend(texts), real(texts))[1])
    encode([f"eringhe eringhe{m} écheau{m}" for m in ("%%%", "***", ",&&&", "$", "-", ").")])
    assert sorted(whole) == sorted(["%%%", "***", ",&&&", "$", "-", ")."]) and encode.known.keys() == {"", "eringhe", "écheau", *whole}


def test_ids_are_put_in_place_in_parts(tokenizer, monkeypatch):
    monkeypatch.setattr(packing, "GATHERED", 3)
    texts = ["", "a b c d e f, g", "", " ", "It  is\nlong: " * 20, "x", ""]
    encode = packing.Encoder(packing.tokenizer_path())
    assert [ids.tolist() for ids in encode(texts)] == [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    assert encode([]) == [] and [len(ids) for ids in encode(["", ""])] == [0, 0]


@pytest.mark.parametrize("seed", range(4))
def test_plan_packs_everything_near_the_bound(seed):
    rng = np.random.default_rng(seed)
    histogram = {int(c): int(n) for c, n in zip(rng.choice(np.arange(1, 65), 30, replace=False), rng.integers(1, 4000, 30), strict=True)}
    plan = packing.make_plan(histogram, 64)
    packed = defaultdict(int)
    for pattern, copies in zip(plan.patterns, plan.copies, strict=True):
        assert sum(c * n for c, n in pattern.items()) <= 64
        for c, n in pattern.items():
            packed[c] += n * copies
    assert packed == histogram
    patterns, amount = packing._relax(np.array(sorted(histogram)), np.array([histogram[c] for c in sorted(histogram)], float), 64, 0.0)
    assert sum(amount) - 1e-6 <= plan.sequences <= sum(amount) * 1.01 + 30


def test_pricing_is_the_best_pattern():
    rng = np.random.default_rng(0)
    for _ in range(20):
        sizes = np.sort(rng.choice(np.arange(2, 14), 4, replace=False))
        duals = rng.normal(0.3, 0.3, 4)
        worth, pattern = packing._price(duals, sizes, 20)
        best = {0: 0.0}
        for room in range(1, 21):
            best[room] = max([best[room - 1], *(best[room - s] + d for s, d in zip(sizes, duals, strict=True) if s <= room)])
        assert abs(worth - best[20]) < 1e-9 and abs(sum(duals[k] * n for k, n in pattern.items()) - worth) < 1e-9
        assert sum(sizes[k] * n for k, n in pattern.items()) <= 20


def test_plan_of_nothing():
    assert packing.make_plan({}, 512).sequences == 0
