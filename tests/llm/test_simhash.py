import random
import re

import pytest
import xxhash

from tablesync.llm import simhash


def slow_fingerprint(text, words=3):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    parts = re.findall(r"[^\x20\x09-\x0D]+", low)
    shingles = [" ".join(parts[i : i + words]) for i in range(len(parts) - words + 1)] or ([" ".join(parts)] if parts else [])
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(fps, bits):
    """Smallest reachable of ``{node: fingerprint}``."""
    root = {n: n for n in fps}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    nodes = sorted(fps)
    for i, a in enumerate(nodes):
        for b in nodes[i + 1 :]:
            if (fps[a] ^ fps[b]).bit_count() <= bits:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {n: find(n) for n in fps}


def test_fingerprints(odd):
    for _, text in odd:
        assert simhash.fingerprint(text) % (1 << 64) == slow_fingerprint(text)


def clustered(seed, centres=6, each=40):
    rng = random.Random(seed)
    out = {}
    for c in range(centres):
        middle = rng.getrandbits(64)
        for _ in range(each):
            out[len(out)] = middle ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 4)))
    for _ in range(100):
        out[len(out)] = rng.getrandbits(64)
    return out


@pytest.mark.parametrize("bits", [1, 2])
@pytest.mark.parametrize("hot", [0, 5, 256])
def test_components_equal_all_pairs(spark, bits, hot):
    fps = clustered(bits)
    signed = [(n, f - (1 << 64) if f >> 63 else f) for n, f in fps.items()]
    frame = spark.createDataFrame(signed, "id long, fp long")
    groups = {r.fp: r.component_id for r in simhash.near_groups(frame, "id", bits, hot).collect()}
    assert {n: groups[f] for n, f in signed} == brute_components(fps, bits)


def test_documents(docs, odd):
    rows = [r for r in odd if r[0] is not None] + [(100 + i, f"a b c d e f g h {i % 3} and the rest of the text stays the same here") for i in range(9)]
    fps = {}
    for i, t in rows:
        fps.setdefault(i, slow_fingerprint(t))
    want = brute_components(fps, 2)
    found = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.simhash_groups(docs(rows)).collect()}
    assert found == {i: (f"{f:016x}", want[i]) for i, f in fps.items()}


def test_null_id_joins_a_component(docs):
    found = {r.doc_id: r.component_id for r in simhash.simhash_groups(docs([(None, "p q r s"), (4, "p q r s"), (None, "other words stand here")])).collect()}
    assert found[4] == 4 and simhash.simhash_groups(docs([])).collect() == []


def test_stage_leaves_one_document_of_each_group(docs):
    rows = [(i, "one two three four five") for i in (5, 3, 9)] + [(7, "quite another text of words"), (8, None), (6, "")]
    frame = docs(rows)
    out = simhash.drop_near_copies(frame)
    assert out.columns == frame.columns and sorted(r.doc_id for r in out.collect()) == [3, 6, 7]
