import collections
import re

import corpus_pipeline
import pytest
import tokenizers
from pyspark.sql import functions as F
from test_packing import check
from test_simhash import brute_components, slow_fingerprint

from tablesync.llm import decontaminate, exact_dedup, packing, simhash, toxicity

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for _, stage in corpus_pipeline.STAGES:
        out.append(stage(spark, out[-1], SF).cache())
    yield out
    for frame in out[1:]:
        frame.unpersist()


def test_each_stage_does_its_operator(spark, stages):
    docs, clean, exact, near, decontaminated, packed = stages
    ids = lambda f: sorted(r.doc_id for r in f.select("doc_id").collect())
    labels, benchmark = spark.read.parquet(f"{SF}/labels.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")
    assert all(f.columns == docs.columns for f in (clean, exact, near, decontaminated))
    assert ids(clean) == ids(toxicity.toxicity(docs, labels).where("predicted = 0"))
    by_text = collections.defaultdict(list)
    for r in clean.collect():
        by_text[r.text or ""].append(r.doc_id)
    assert ids(exact) == sorted(max(x) for x in by_text.values())
    assert ids(near) == ids(simhash.simhash_groups(exact).where(F.col("doc_id") == F.col("component_id")))
    assert ids(decontaminated) == ids(decontaminate.contamination_digest(near, benchmark).where("NOT contaminated"))
    assert sorted({r.doc_id for r in packed.collect()}) == ids(decontaminated)
    assert ids(exact_dedup.exact_groups(clean).where("kept")) == ids(exact)
    assert packed.columns == packing.pack(docs).columns


def words(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def test_near_copies_by_all_pairs(stages):
    _, _, exact, near, *_ = stages
    fingerprints = {r.doc_id: slow_fingerprint(r.text) for r in exact.collect()}
    roots = brute_components(fingerprints, 2)
    assert sorted(r.doc_id for r in near.collect()) == sorted(i for i, root in roots.items() if i == root)


def test_contamination_by_sliding_windows(spark, stages):
    _, _, _, near, decontaminated, _ = stages
    asked = [words(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    windows = {tuple(w[k : k + 13]) for w in asked if w for k in range(max(1, len(w) - 12))}
    keeps = []
    for r in near.collect():
        held, hit = words(r.text), set()
        for n in {len(w) for w in windows}:
            for k in range(len(held) - n + 1):
                if tuple(held[k : k + n]) in windows:
                    hit.update(range(k, k + n))
        if not (hit and 20 * len(hit) >= len(held)):
            keeps.append(r.doc_id)
    assert sorted(r.doc_id for r in decontaminated.collect()) == sorted(keeps)


def test_packing_gives_every_id_once(stages):
    tokenizer = tokenizers.Tokenizer.from_file(packing.tokenizer_path())
    *_, decontaminated, packed = stages
    check([(r.doc_id, r.text) for r in decontaminated.collect()], packed.collect(), tokenizer)


def test_run_gives_the_last_stage(spark, stages):
    assert corpus_pipeline.run(spark, SF).count() == stages[-1].count()
