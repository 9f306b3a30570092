from __future__ import annotations

import numpy as np

from slopeworks.llm import vectors
from slopeworks.llm.vectors import near_vectors


def rows_of(spark, matrix, extra=()):
    rows = [(int(k), [float(x) for x in row]) for k, row in enumerate(matrix)]
    frame = spark.createDataFrame([*rows, *extra], "vec_id long, embedding array<float>")
    return frame.selectExpr("*", "1 as label", "2 as id", "3 as times", "4 as root").repartition(3)


def brute_force(matrix, threshold=0.9):
    rows = matrix.astype(np.float32).astype(np.float64)
    unit = rows / np.linalg.norm(rows, axis=1)[:, None]
    near = unit @ unit.T >= threshold
    links = near.sum(1) - 1
    root = np.arange(len(rows))
    while True:
        low = np.array([root[near[k]].min() for k in range(len(rows))])
        if (low == root).all():
            return links, root
        root = low


def planted(count=900, size=24, seed=1):
    random = np.random.default_rng(seed)
    base = random.normal(size=(count, size))
    near = [base[k % 40] + random.normal(size=size) * scale for k, scale in enumerate(np.linspace(0.05, 0.6, 300))]
    hot = [base[7] + random.normal(size=size) * 0.1 for _ in range(150)]
    return np.vstack([base, near, hot, base[:20], base[:5] * 3.0])


def check(found, matrix):
    links, root = brute_force(matrix)
    got = {r.vec_id: (r.n_links, r.component_id) for r in found.collect()}
    assert got == {k: (int(links[k]), int(root[k])) for k in range(len(matrix))}


def test_certain_reach_finds_every_link(spark):
    matrix = planted()
    check(near_vectors(rows_of(spark, matrix), reach=1.0), matrix)


def test_default_reach_recall(spark):
    matrix = planted(seed=2)
    links, _ = brute_force(matrix)
    found = near_vectors(rows_of(spark, matrix)).agg({"n_links": "sum"}).first()[0]
    assert 0.99 * links.sum() <= found <= links.sum()


def test_blocks_of_a_list(spark, monkeypatch):
    """Lists cut into many small blocks give the same links."""
    monkeypatch.setattr(vectors, "MEMBERS", 32)
    monkeypatch.setattr(vectors, "QUERIES", 48)
    matrix = planted(count=200)
    check(near_vectors(rows_of(spark, matrix), reach=1.0), matrix)


def test_unusable_vectors_link_with_nothing(spark):
    matrix = planted(count=60)[:80]
    own = [float(x) for x in matrix[0]]
    bad = [(1000, None), (1001, [0.0] * 24), (1002, [float("nan"), *own[1:]]), (1003, [None, *own[1:]]), (1004, [])]
    bad += [(1005, [float("inf"), *own[1:]]), (1006, own[:3]), (1007, own[:3])]
    found = {r.vec_id: tuple(r)[1:] for r in near_vectors(rows_of(spark, matrix, bad), reach=1.0).collect()}
    links, root = brute_force(matrix)
    assert all(found[k] == (int(links[k]), int(root[k])) for k in range(80))
    assert all(found[k] == (0, k) for k in range(1000, 1006))
    assert found[1006] == (1, 1006) and found[1007] == (1, 1006)


def test_no_rows(spark):
    assert near_vectors(rows_of(spark, np.zeros((0, 3)))).count() == 0
    assert near_vectors(rows_of(spark, np.zeros((0, 3)), [(1, None)])).collect()[0].n_links == 0
