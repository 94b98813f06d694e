from __future__ import annotations

import numpy as np
import pytest

from corpusflow.llm import neighbours


def frame(spark, x, ids=None):
    return spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids if ids is not None else range(len(x)), x)], "vec_id bigint, embedding array<float>").repartition(3)


def exact(x, k):
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = x @ x.T
    np.fill_diagonal(s, -2)
    return np.argsort(-s, axis=1, kind="stable")[:, :k], s


@pytest.mark.parametrize("clustered", [True, False])
def test_recall_of_every_row(spark, clustered):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(3000, 24)).astype(np.float32)
    if clustered:
        x = x * 0.4 + rng.normal(size=(60, 24))[rng.integers(0, 60, 3000)].astype(np.float32)
    found = neighbours.nearest(frame(spark, x), k=10, every=1, block=100).collect()
    best, s = exact(x, 10)
    by = {}
    for r in found:
        by.setdefault(r["vec_id"], {})[r["rank"]] = r
        assert abs(r["similarity"] - s[r["vec_id"], r["neighbour_id"]]) < 1e-5
    assert len(by) == 3000 and all(sorted(v) == list(range(1, 11)) for v in by.values())
    hit = sum(len({r["neighbour_id"] for r in by[i].values()} & set(best[i].tolist())) for i in range(3000))
    assert hit >= 0.9 * 30_000


def test_small_tables_are_exact(spark):
    x = np.random.default_rng(4).normal(size=(40, 5)).astype(np.float32)
    found = {(r["vec_id"], r["rank"]): r["neighbour_id"] for r in neighbours.nearest(frame(spark, x), k=3, every=1).collect()}
    best, _ = exact(x, 3)
    assert found == {(i, r + 1): int(best[i, r]) for i in range(40) for r in range(3)}


def test_queue_takes_the_nearest_leaves_of_all_trees():
    rng = np.random.default_rng(5)
    forest = neighbours.Forest.build(rng.normal(size=(2000, 8)).astype(np.float32), 2000, 3, 100)
    p = forest.project(rng.normal(size=(1, 8)).astype(np.float32))[0]
    every = []
    for t in range(3):
        for leaf in range(1 << forest.depth):
            far, node = 0.0, 0
            for d in range(forest.depth):
                side = leaf >> (forest.depth - 1 - d) & 1
                gap = p[t][d] - forest.medians[t, (1 << d) - 1 + node]
                far += gap * gap if (gap > 0) != side else 0
                node = 2 * node + side
            every.append((far, t, leaf))
    forest.radius = sorted(every)[11][0]
    asked = forest.probes(p)
    assert sorted(asked) == sorted((t, leaf) for _, t, leaf in sorted(every)[:12])
    leaves = np.array([[leaf] * 3 for _, _, leaf in every])
    far = forest.distance(np.repeat(p[None], len(every), axis=0), leaves)
    assert np.allclose([far[i, t] for i, (_, t, _) in enumerate(every)], [f for f, _, _ in every])


def test_queries_are_every_fiftieth_id(spark):
    x = np.random.default_rng(6).normal(size=(400, 16)).astype(np.float32)
    rows = neighbours.nearest(frame(spark, x)).collect()
    assert neighbours.Forest.build(x, 400).depth > 0, "even so small a table has more than one leaf"
    want, _ = exact(x, 10)
    assert {r["vec_id"] for r in rows} == set(range(0, 400, 50)) and len(rows) == 80
    assert sum(r["neighbour_id"] in want[r["vec_id"]] for r in rows) >= 72


def test_ties_go_to_the_lesser_id(spark):
    rows = neighbours.nearest(frame(spark, np.ones((60, 4))), k=5, block=7).collect()
    assert sorted((r["vec_id"], r["rank"], r["neighbour_id"]) for r in rows) == [(0, i, i) for i in range(1, 6)] + [(50, i + 1, i) for i in range(5)]


def test_repeated_ids_are_one_item(spark):
    """One id fifty times near the query, and every id twelve times: against brute force over items."""
    rng = np.random.default_rng(8)
    x = rng.normal(size=(200, 6))
    ids = [*range(200), *[999] * 50]
    rows = np.concatenate([x, x[50] + rng.normal(size=(50, 6)) * 0.01])
    found = [r["neighbour_id"] for r in sorted(neighbours.nearest(frame(spark, rows, ids), recall=1.0).where("vec_id = 50").collect(), key=lambda r: r["rank"])]
    assert len(found) == 10 and found[0] == 999 and len(set(found)) == 10
    copies = neighbours.nearest(frame(spark, np.repeat(x[:50], 12, axis=0), np.repeat(np.arange(50), 12)), every=1).collect()
    want, _ = exact(x[:50], 10)
    assert {(r["vec_id"], r["rank"]): r["neighbour_id"] for r in copies} == {(i, j + 1): int(want[i, j]) for i in range(50) for j in range(10)}


def test_odd_rows(spark):
    good = [(1, [1.0, 0.0]), (2, [0.9, 0.1]), (2, [0.9, 0.1]), (3, [0.9, 0.1]), (1, [1.0, 0.0])]
    bad = [(4, None), (5, []), (6, [0.0, 0.0]), (7, [1.0, 2.0, 3.0]), (None, [1.0, 0.0]), (8, [float("nan"), 1.0]), (9, [None, 1.0])]
    df = spark.createDataFrame([(i, v, "r", 0) for i, v in good + bad], "vec_id bigint, embedding array<float>, rank string, id int")
    found = sorted((r["vec_id"], r["rank"], r["neighbour_id"]) for r in neighbours.nearest(df, k=5, every=1).collect())
    assert found == [(1, 1, 2), (1, 2, 3), (2, 1, 3), (2, 2, 1), (3, 1, 2), (3, 2, 1)]
    assert neighbours.nearest(df.where("false"), every=1).count() == 0
    assert neighbours.nearest(df.where("vec_id = 1"), every=1).count() == 0
