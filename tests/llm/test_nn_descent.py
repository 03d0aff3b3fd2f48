import numpy as np
import pytest

from tablesync.llm import nn_descent


def brute(rows, threshold=0.9):
    """{position: (links, component)} and all pairs of linked positions."""
    fine = [i for i, (_, v) in enumerate(rows) if v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    links = set()
    for at, i in enumerate(fine):
        for j in fine[at + 1 :]:
            a, b = np.float32(rows[i][1]).astype(float), np.float32(rows[j][1]).astype(float)
            if len(a) == len(b) and a @ b / np.sqrt((a @ a) * (b @ b)) >= threshold:
                links.add((i, j))
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, j in links:
        x, y = find(i), find(j)
        root[max(x, y)] = min(x, y)
    degree = np.bincount([x for p in links for x in p], minlength=len(rows))
    least = {}
    for i, (name, _) in enumerate(rows):
        r = find(i)
        least[r] = name if least.get(r) is None else least[r] if name is None else min(least[r], name)
    return [(int(degree[i]), least[find(i)]) for i in range(len(rows))], len(links)


def planted(seed, dims=24, alone=400, clusters=((90, 0.15), (40, 0.2), (5, 0.25))):
    rng = np.random.default_rng(seed)
    found = [rng.standard_normal(dims) for _ in range(alone)]
    for size, noise in clusters:
        middle = rng.standard_normal(dims)
        found += [middle + noise * rng.standard_normal(dims) for _ in range(size)]
    return [x.astype(np.float32).tolist() for x in found]


def table(spark, rows):
    return spark.createDataFrame([(i, v, 1, "n", "h") for i, v in rows], "vec_id long, embedding array<float>, label int, node string, hash string").repartition(3)


@pytest.mark.parametrize("seed", [1, 2])
def test_links_of_clusters(spark, seed):
    rows = list(enumerate(planted(seed)))
    want, total = brute(rows)
    found = {r.vec_id: r for r in nn_descent.near_vectors(table(spark, rows)).collect()}
    assert len(found) == len(rows)
    assert all(found[i].n_links <= want[i][0] for i in found)
    assert sum(r.n_links for r in found.values()) >= 0.97 * 2 * total > 1000
    assert all(found[i].component_id == want[i][1] and found[i].kept == (i == want[i][1]) for i in found)


def test_odd_rows(spark):
    base, inf, nan = [1.0, 2.0, 3.0], float("inf"), float("nan")
    rows = [(9, base), (4, base), (4, base), (None, base), (7, [2.0, 4.0, 6.0]), (1, None), (2, []), (3, [0.0, 0.0, 0.0]), (5, [None, 1.0, 1.0])]
    rows += [(6, [nan, 1.0, 1.0]), (8, [inf, 1.0, 1.0]), (10, [1.0, 2.0]), (11, [-1.0, -2.0, -3.0]), (12, [1e-30, 2e-30, 3e-30]), (13, [1e30, 2e30, 3e30]), (None, [5.0, 0.0, 0.0]), (None, None)]
    found = nn_descent.near_vectors(table(spark, rows))
    assert found.columns == ["vec_id", "n_links", "component_id", "kept"]
    want = [(i, n, c, i == c) for (i, _), (n, c) in zip(rows, brute(rows)[0], strict=True)]
    assert sorted(map(tuple, found.collect()), key=repr) == sorted(want, key=repr)
    assert nn_descent.near_vectors(table(spark, [])).collect() == []


def test_audit_tells_what_is_missing(spark):
    rows = list(enumerate(planted(4, alone=50)))
    nodes = table(spark, rows).selectExpr("vec_id AS node", "embedding AS vector")
    copies = nn_descent._copies(nodes)
    lists, share = nn_descent.neighbour_lists(copies, 0.88)
    assert share >= 0.97 and nn_descent.audit(copies, lists.where("u % 2 = 0"), 0.88) < 0.6


def test_pairs_are_verified_in_double(spark):
    rows = [(0, [1.0, 0.0]), (1, [0.9, float(np.sqrt(1 - 0.81)) + 1e-4]), (2, [0.9, float(np.sqrt(1 - 0.81)) - 1e-4])]
    found = {r.vec_id: r.n_links for r in nn_descent.near_vectors(table(spark, rows)).collect()}
    assert found == {0: 1, 1: 1, 2: 2}


def test_on_the_given_vectors(spark):
    vectors = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in vectors.orderBy("vec_id").collect()]
    want, total = brute(rows)
    found = {r.vec_id: r.n_links for r in nn_descent.near_vectors(vectors).collect()}
    assert sum(found.values()) >= 0.97 * 2 * total
