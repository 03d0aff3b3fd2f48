import math
import random
import re
import zlib

import numpy as np

from tablesync.llm import toxicity

STEMS = ["grumpf", "snarlo", "blighty"]


def corpus(n=600, seed=2):
    rng = random.Random(seed)
    clean = ["".join(rng.choices("aeioubcdlmnrst", k=rng.randint(2, 8))) for _ in range(400)]
    rows, labels = [], []
    for i in range(n):
        text = rng.choices(clean, k=rng.randint(20, 80))
        bad = rng.random() < 0.3
        if bad:
            for _ in range(3):
                text[rng.randrange(len(text))] = rng.choice(STEMS) + "".join(rng.choices("xyz", k=2))  # never the same word
        rows.append((i, " ".join(text)))
        labels.append((i, int(bad)))
    return rows, labels


def frame(spark, labels):
    return spark.createDataFrame(labels, "doc_id long, toxic int")


def test_held_out_rows_are_found_by_their_subwords(spark, docs):
    rows, labels = corpus()
    found = {r.doc_id: r for r in toxicity.toxicity(docs(rows), frame(spark, labels)).collect()}
    want = dict(labels)
    assert {i for i, r in found.items() if r.held_out} == {i for i in want if zlib.crc32(str(i).encode()) % 4 == 2}
    held = [r for r in found.values() if r.held_out]
    right = sum(r.predicted == want[r.doc_id] for r in held) / len(held)
    assert right > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in found.values())


def test_labels_of_held_out_rows_do_not_matter(spark, docs):
    rows, labels = corpus(200)
    other = [(i, 1 - y if zlib.crc32(str(i).encode()) % 4 == 2 else y) for i, y in labels]
    a, b = (toxicity.toxicity(docs(rows), frame(spark, x)).orderBy("doc_id").collect() for x in (labels, other))
    assert a == b


def test_scorer_forgets_without_changing_scores(monkeypatch):
    rows, labels = corpus(200)
    model = toxicity.train([t for _, t in rows], [y for _, y in labels])
    scores = [model.scorer()(t) for _, t in rows]
    monkeypatch.setattr(toxicity, "REMEMBERED", 3)
    score = model.scorer()
    assert [score(t) for _, t in rows] == scores


def test_odd_rows(spark, docs, odd):
    rows, labels = corpus(200)
    labels += [(10_000, 1), (1, 1), (1, 0), (None, 1), (2, None)]
    out = toxicity.toxicity(docs(odd + rows), frame(spark, labels)).collect()
    assert len(out) == len(odd) + len(rows) and all(r.score is not None for r in out)
    none = toxicity.toxicity(docs(odd), frame(spark, [])).collect()
    assert len(none) == len(odd) and {r.predicted for r in none} == {0}
    assert toxicity.toxicity(docs([]), frame(spark, labels)).collect() == []


def test_stage_keeps_columns_and_rows_below_the_threshold(spark, docs):
    rows, labels = corpus(300)
    table, known = docs(rows), frame(spark, labels)
    out = toxicity.drop_toxic(table, known)
    stays = {r.doc_id for r in toxicity.toxicity(table, known).collect() if not r.predicted}
    assert out.columns == table.columns and {r.doc_id for r in out.collect()} == stays


def test_a_cue_of_every_toxic_document_is_learned():
    rng = random.Random(5)
    clean = ["".join(rng.choices("aeioubcdlmnrst", k=rng.randint(2, 8))) for _ in range(400)]
    labels = [int(i % 3 == 0) for i in range(300)]
    texts = [" ".join([*rng.choices(clean, k=30), *["zyxwvq"] * (2 * y)]) for y in labels]
    score = toxicity.train(texts, labels).scorer()
    assert all((score(t) >= 0.5) == bool(y) for t, y in zip(texts, labels, strict=True))


def test_classes_weigh_what_they_stand_for():
    texts, labels = ["one and the same"] * 200, [0, 1] * 100
    share = toxicity.train(texts, labels, of_class=(900, 100)).scorer()(texts[0])
    assert abs(share - 0.1) < 0.03


def test_labels_without_a_usable_document_take_no_place(spark, docs, monkeypatch):
    monkeypatch.setattr(toxicity, "TRAIN_TOXIC", 60)
    rows, labels = corpus(600)
    long = [(10_000 + i, "x" * (toxicity.TRAIN_CHARS + 1)) for i in range(300)]
    absent = [(20_000 + i, 1) for i in range(20_000)]
    found = toxicity.toxicity(docs(rows + long), frame(spark, labels + [(i, 1) for i, _ in long] + absent)).collect()
    want = dict(labels)
    held = [r for r in found if r.held_out and r.doc_id in want]
    assert sum(r.predicted == want[r.doc_id] for r in held) / len(held) > 0.95


def slow_margins(texts, labels, of_class, epochs, seed=7):
    """Plain loops over documents and subwords, in double precision: margin of each bucket, and the bias."""
    bags = []
    for text in texts:
        words = re.findall(r"[a-z]+", text)
        bag = {}
        for w in words:
            for s in toxicity.subwords(w.encode()):
                bag[s] = bag.get(s, 0) + 1 / len(words)
        bags.append(bag)
    used = sorted(s for s in {s for b in bags for s in b} if sum(s in b for b in bags) >= 2)
    drawn = [labels.count(0), labels.count(1)]
    total = sum(of_class)
    weigh = [of_class[y] / drawn[y] / total for y in labels]
    params = {("v", s, j): 0.0 for s in used for j in range(2)} | {("b", c): 0.0 for c in range(2)}
    params |= {("w", j, c): float(x) for (j, c), x in np.ndenumerate(np.random.default_rng(seed).normal(0, 1, (2, 2)).astype(np.float32))}
    first, second = dict.fromkeys(params, 0.0), dict.fromkeys(params, 0.0)
    for step in range(1, epochs + 1):
        grads = {k: toxicity.DECAY * v if k[0] == "v" else 0.0 for k, v in params.items()}
        for bag, y, weight in zip(bags, labels, weigh, strict=True):
            held = [(s, x) for s, x in bag.items() if ("v", s, 0) in params]
            mean = [sum(params["v", s, j] * x for s, x in held) for j in range(2)]
            logits = [sum(mean[j] * params["w", j, c] for j in range(2)) + params["b", c] for c in range(2)]
            odds = [math.exp(x - max(logits)) for x in logits]
            for c in range(2):
                error = (odds[c] / sum(odds) - (y == c)) * weight
                grads["b", c] += error
                for j in range(2):
                    grads["w", j, c] += mean[j] * error
                    for s, x in held:
                        grads["v", s, j] += error * params["w", j, c] * x
        for k, g in grads.items():
            first[k] = 0.9 * first[k] + 0.1 * g
            second[k] = 0.99 * second[k] + 0.01 * g * g
            params[k] -= toxicity.RATE * (first[k] / (1 - 0.9**step)) / (math.sqrt(second[k] / (1 - 0.99**step)) + 1e-7)
        for s in used:
            norm = max(math.hypot(params["v", s, 0], params["v", s, 1]), 1e-9)
            for j in range(2):
                params["v", s, j] *= max(0.0, 1 - toxicity.RATE * toxicity.SHRINK / norm)
    return {s: sum(params["v", s, j] * (params["w", j, 1] - params["w", j, 0]) for j in range(2)) for s in used}, params["b", 1] - params["b", 0]


def test_training_equals_plain_loops(monkeypatch):
    rows, labels = corpus(24, seed=5)
    monkeypatch.setattr(toxicity, "EPOCHS", 8)
    texts, y = [t for _, t in rows], [x for _, x in labels]
    model = toxicity.train(texts, y, of_class=(900, 100))
    margins, bias = slow_margins(texts, y, (900, 100), 8)
    got = np.array([model.margin[s] for s in margins])
    want = np.array(list(margins.values()))
    assert np.abs(want).max() > 0.1 and abs(model.bias - bias) < 1e-3
    assert np.quantile(np.abs(got - want), 0.99) < 1e-2 and np.corrcoef(got, want)[0, 1] > 0.999
    assert not np.delete(model.margin, list(margins)).any()
