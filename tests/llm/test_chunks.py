import random

import numpy as np

from tablesync.llm import chunks


def slow_ends(text, gear):
    """Word starts (in bytes) before which a chunk may end, by rolling the hash byte by byte."""
    out, number = [], 0
    for i in range(len(text)):
        if text[i] not in b" \t\n\v\f\r" and (i == 0 or text[i - 1] in b" \t\n\v\f\r"):
            if i:
                h = 0
                for b in text[max(0, i - 16) : i]:
                    h = ((h << 1) + int(gear[b])) & 0xFFFFFFFF
                if h >> 30 == 0:
                    out.append(number)
            number += 1
    return out, number


def slow_chunks(text, gear, least=3, most=32):
    ends, words = slow_ends(text, gear)
    sizes, at = [], 0
    for end in [*ends, words]:
        while end - at > most:
            sizes.append(most)
            at += most
        if end - at >= least or (end == words and end > at):
            sizes.append(end - at)
            at = end
    return sizes


def prose(rng, n):
    return " ".join("".join(rng.choices("abcdefghij", k=rng.randint(1, 9))) for _ in range(n))


def test_chunks_follow_the_rolling_hash():
    rng, gear = random.Random(1), chunks.gear_table()
    texts = [prose(rng, n).encode() for n in (0, 1, 2, 5, 40, 300)] + [b"  lead", "ü ñ ".encode() * 30, b"x" * 5000, b" \n "]
    for text, found in zip(texts, chunks.chunk(texts, gear), strict=True):
        assert [w for _, _, w in found] == slow_chunks(text, gear)
        assert all(a[1] == b[0] for a, b in zip(found, found[1:], strict=False)) and (not found or found[-1][1] == len(text))


def found(df):
    return {(r.id, r["from"], r.to, r.words, r.first_id) for r in df.collect()}


def test_shared_passages_are_found_wherever_they_stand(docs):
    rng = random.Random(2)
    rows, planted = [], set()
    shared = [prose(rng, 55) for _ in range(20)]
    for i in range(60):
        text = prose(rng, rng.randint(20, 120))
        if i < 40:
            text += " " + shared[i % 20] + "\n" + prose(rng, 30)
            if i >= 20:
                planted.add(i)
        rows.append((i, text))
    out = found(chunks.copied_passages(docs(rows)))
    assert {i for i, *_ in out} == planted
    for i, a, b, words, first in out:
        assert first == i - 20 and rows[i][1].encode()[a:b].strip() in rows[first][1].encode() and words >= chunks.PASSAGE
        assert words >= 25


def test_odd_rows(docs, odd):
    rng = random.Random(3)
    text = prose(rng, 60)
    rows = [*odd, (20, text), (20, text), (21, text), (None, text)]
    out = found(chunks.copied_passages(docs(rows)))
    assert {(i, f) for i, _, _, _, f in out} == {(21, 20), (None, 20)}
    assert chunks.copied_passages(docs([])).collect() == []
    size = len(text)
    assert chunks.without(text, [(0, size)]) == "" and chunks.without(None, [(0, 1)]) is None


def test_gear_numbers_differ():
    assert len(np.unique(chunks.gear_table())) == 256


def test_passages_without_spaces(docs):
    rng = random.Random(6)
    han, code = [chr(c) for c in range(0x4E00, 0x4E00 + 2000)], "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    for letters, n in ((han, 150), (code, 500)):
        passage, some = "".join(rng.choices(letters, k=n)), lambda k, x=letters: "".join(rng.choices(x, k=k))
        rows = [(1, some(90) + passage + some(70)), (2, some(41) + passage + some(55)), (3, some(200)), (4, passage[: n // 2] + some(1) + passage[n // 2 :])]
        out = found(chunks.copied_passages(docs(rows)))
        assert {(i, f) for i, *_, f in out} >= {(2, 1), (4, 1)} and 3 not in {i for i, *_ in out}
        for i, a, b, _, _ in out:
            piece = dict(rows)[i].encode()[a:b].decode()  # no letter is cut
            assert len(piece) >= 20 and (i != 2 or piece in passage)
