import hashlib

import pytest
from pyspark.sql import functions as F

from tablesync.llm import exact_dedup


def brute(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(t or "", []).append(i)
    out = []
    for t, ids in groups.items():
        known = [i for i in ids if i is not None]
        keep = max(known) if known else None
        digest = hashlib.sha256(t.encode()).hexdigest()
        spent = False
        for i in sorted(ids, key=lambda x: (x is None, x)):
            out.append((i, keep, len(ids), i == keep and not spent, digest))
            spent |= i == keep
    return sorted(out, key=repr)


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_odd_rows(docs, odd):
    assert got(exact_dedup.exact_groups(docs(odd))) == brute(odd)


def test_all_ids_null(docs):
    rows = [(None, "a"), (None, "a"), (None, "b")]
    assert got(exact_dedup.exact_groups(docs(rows))) == brute(rows)


@pytest.mark.parametrize("capacity", [1, 4, 1000])
def test_directory_splits_until_no_bucket_is_overfull(docs, capacity):
    rows = [(i, f"text {i % 40}") for i in range(100)]
    index, _ = exact_dedup.build_index(docs(rows), capacity=capacity)
    sizes = [r["count"] for r in index.keys.groupBy("bucket").count().collect()]
    assert sum(sizes) == 40 and max(sizes) <= capacity
    slots = [r.slot for r in index.directory.collect()]
    assert len(slots) == len(set(slots)) and (not slots or max(slots) < 2**index.depth)
    assert got(exact_dedup.exact_groups(docs(rows), capacity=capacity)) == brute(rows)


def test_colliding_keys_are_told_apart_by_bytes(docs):
    rows = [(1, "aa"), (2, "ab"), (3, "aa"), (4, "b"), (5, None), (5, None)]
    weak = {"hash_of": lambda t: F.length(t).cast("long"), "digest_of": lambda t: F.encode(F.substring(t, 1, 1), "utf-8")}
    assert got(exact_dedup.exact_groups(docs(rows), **weak)) == brute(rows)


def test_empty(docs):
    assert got(exact_dedup.exact_groups(docs([]))) == []
    assert exact_dedup.drop_copies(docs([])).collect() == []


def test_stage_keeps_columns_and_one_row_of_each_text(docs, odd):
    frame = docs(odd)
    out = exact_dedup.drop_copies(frame)
    assert out.columns == frame.columns
    rows = [(r.doc_id, r.text) for r in out.collect()]
    texts = [t or "" for _, t in rows]
    assert sorted(texts) == sorted({t or "" for _, t in odd})
    assert {r[0] for r in rows if r[1] == "same text again"} == {12}


def test_hot_group(docs):
    rows = [(i, "copy") for i in range(2000)] + [(i, f"t{i}") for i in range(2000, 3000)]
    found = got(exact_dedup.exact_groups(docs(rows, 7)))
    assert found == brute(rows)
