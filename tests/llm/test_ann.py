import numpy as np
from pyspark.sql import Row
from pyspark.sql import functions as F

from lineagram.llm import ann


def brute(ids, vec, queries, k=5):
    unit = vec / np.linalg.norm(vec, axis=1, keepdims=True)
    out = {}
    for q in queries:
        sim = unit @ unit[q]
        order = sorted((i for i in range(len(ids)) if i != q), key=lambda i: (-round(float(sim[i]), 12), ids[i]))[:k]
        out[ids[q]] = [ids[i] for i in order]
    return out


def test_recall_and_odd_vectors(spark):
    rng = np.random.default_rng(8)
    centres = rng.normal(0, 1, (6, 24))
    vec = (centres[rng.integers(6, size=1500)] + rng.normal(0, 0.6, (1500, 24))).astype(np.float32).astype(float)
    vec[700:900] = vec[3]  # one vector in many rows
    ids = list(range(len(vec)))
    odd = [None, [0.0] * 24, [float("nan")] * 24, [None] * 24, [], [1.0, 2.0], [float("inf")] * 24]
    rows = [Row(vec_id=i, embedding=v.tolist(), score="clash") for i, v in enumerate(vec)] + [Row(vec_id=5000 + 50 * i, embedding=v, score="x") for i, v in enumerate(odd)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score string")
    got: dict = {}
    for r in ann.nearest(table, F.col("vec_id") % 50 == 0).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score, r["rank"]))
    want = brute(ids, vec, range(0, 1500, 50))
    assert set(got) == set(want)
    assert all([x[2] for x in v] == [1, 2, 3, 4, 5] and q not in [x[0] for x in v] for q, v in got.items())
    recall = np.mean([len({x[0] for x in got[q]} & set(want[q])) / 5 for q in want])
    assert recall >= 0.97, recall
    assert [x[0] for x in got[750]] == [3, 700, 701, 702, 703]
    for q, v in got.items():
        for i, score, _ in v:
            assert abs(score - vec[i] @ vec[q] / np.linalg.norm(vec[i]) / np.linalg.norm(vec[q])) < 1e-9


def test_few_rows(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert ann.nearest(empty, F.col("vec_id") % 50 == 0).count() == 0
    two = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 1.0])], "vec_id long, embedding array<float>")
    assert [tuple(r)[:3] for r in ann.nearest(two, F.col("vec_id") % 50 == 0).collect()] == [(0, 1, 1)]


def test_repeated_ids_null_ids_and_ties(spark):
    rows = [(0, [1.0, 0.0]), (0, [1.0, 0.0]), (0, [0.0, 1.0]), (None, [1.0, 0.0]), (7, [1.0, 0.0]), (8, [2.0, 0.0]), (9, [0.0, -1.0]), (10, [0.0, 3.0])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    got = [(r.query_id, r["rank"], r.vec_id, round(r.score, 12)) for r in ann.nearest(table, F.col("vec_id") % 50 == 0).orderBy("query_id", "rank").collect()]
    # the id 0 has two vectors: each is a query of its own, and neither finds the id 0
    assert sorted(got) == sorted([(0, 1, 7, 1.0), (0, 2, 8, 1.0), (0, 3, 9, 0.0), (0, 4, 10, 0.0), (0, 1, 10, 1.0), (0, 2, 7, 0.0), (0, 3, 8, 0.0), (0, 4, 9, -1.0)])


def test_few_nodes_are_visited(spark):
    """On rows with structure the search meets a small share of them and still finds the nearest."""
    rng = np.random.default_rng(4)
    centres = rng.normal(0, 1, (60, 16))
    vec = centres[rng.integers(60, size=6000)] + rng.normal(0, 0.35, (6000, 16))
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vec)], "vec_id long, embedding array<double>").repartition(4)
    points = ann.written(ann.nodes(table, show=6))
    starts = points.where("node % 50 = 0").select(F.col("node").alias("q"))
    found = ann.search(points, ann.graph(points), starts).collect()
    want = brute(list(range(6000)), vec, range(0, 6000, 50))
    recall = np.mean([len({b.u for b in r.best[:6]} & set(want[r.q])) / 5 for r in found])
    visited = np.mean([len(r.seen) for r in found]) / 6000
    assert recall >= 0.95 and visited < 0.15, (recall, visited)
