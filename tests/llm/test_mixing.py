import re

import numpy as np
from pyspark.sql import Row

from lineagram.llm import mixing as m


def test_targets():
    got = m.targets([("b", 100), ("a", 10), (None, 1000), ("c", 100)])
    assert got["a"] == 30.0  # weighs 5, stops at 3 times its size
    assert abs(sum(got.values()) - 1210) < 1e-9
    assert all(got[s] <= 3 * n + 1e-9 for s, n in (("b", 100), ("c", 100), (None, 1000)))
    assert m.targets([]) == {} and m.targets([("x", 0)]) == {"x": 0.0}


def test_split_keeps_counts():
    got = m.split(np.array([1000, 7, 0, 333]), 13, 1)
    assert (got.sum(0) == [1000, 7, 0, 333]).all() and (got >= 0).all()
    assert np.ptp(got.sum(1)) <= 4


def test_mix(spark):
    rng = np.random.default_rng(1)
    rows = [Row(doc_id=i, text=" ".join(["w"] * int(rng.integers(1, 200))), source=[None, "s1", "s2", "é", "s3"][i % 5 if i % 3 else 1], taken="clash") for i in range(3000)]
    rows += [Row(doc_id=9000 + i, text=t, source="s2", taken="x") for i, t in enumerate(["", None, " \n", "a\x0bb\tc  d ", "long " * 20000])]
    docs = spark.createDataFrame(rows).repartition(5)
    got = m.assign(docs).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r["size"] == len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))
        assert r.taken == r["size"] * len(r.shards) <= 3 * r["size"]
    own, taken, due = {}, {}, {}
    for r in got:
        own[r.source] = own.get(r.source, 0) + r["size"]
        taken[r.source] = taken.get(r.source, 0) + r.taken
        due[r.source] = r.target
    want = m.targets(list(own.items()))
    for s in own:
        assert abs(want[s] - due[s]) < 1e-6
        assert abs(taken[s] - due[s]) < 0.02 * due[s] + 200, (s, taken[s], due[s])
    assert {(r.doc_id, r.taken, str(r.shards)) for r in m.assign(docs.repartition(3)).collect()} == {(r.doc_id, r.taken, str(r.shards)) for r in got}
    mixed = m.mix(docs)
    assert mixed.count() == sum(len(r.shards) for r in got)
    assert "text" in mixed.columns


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, source string")
    assert m.assign(docs).count() == 0 and m.mix(docs).count() == 0


def test_targets_equal_a_level():
    """Targets are min(3 * size, weight * level) for the level at which they sum to all sizes; found here by bisection."""
    rng = np.random.default_rng(5)
    for _ in range(50):
        sizes = [(None if i == 3 else "s%02d" % i, int(rng.integers(0, 10 ** int(rng.integers(1, 6))))) for i in range(int(rng.integers(1, 9)))]
        order = sorted(sizes, key=lambda x: (x[0] is None, x[0] or ""))
        total, lo, hi = sum(n for _, n in order), 0.0, 1e9
        level = lambda x: {s: min(3 * n, (5, 2, 1)[i % 3] * x) for i, (s, n) in enumerate(order)}
        for _ in range(200):
            mid = (lo + hi) / 2
            lo, hi = (mid, hi) if sum(level(mid).values()) < total else (lo, mid)
        got, want = m.targets(sizes), level(hi)
        assert all(abs(got[s] - want[s]) <= 1e-6 * max(total, 1) for s, _ in sizes)


def test_a_shard_is_a_partition_and_blocks_grow(spark):
    docs = spark.range(4000).selectExpr("id as doc_id", "repeat('w ', 1 + cast(id % 7 as int)) as text", "if(id % 3 = 0, 'a', 'b') as source", "'x' as __block", "1 as __source")
    mixed = m.mix(docs, 5)
    assert mixed.columns == docs.columns and mixed.rdd.getNumPartitions() == 5
    sizes = mixed.rdd.glom().map(len).collect()
    assert min(sizes) > 0.5 * max(sizes)
    quotas, draws = m.plan(docs.withColumn("x", m.F.lit(1)), 300)
    blocks = draws.select("__source", "__block").distinct().count()
    assert blocks > m.BLOCKS  # more shards, more blocks
