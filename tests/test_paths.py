import pytest
from pyspark.sql import Row

from lineagram.operators import paths
from tests.test_operators import events, replay


def closure(rows):
    _, edges, version = replay(rows)
    into = {}
    for h, _, _, a, av, b, bv in edges:
        into.setdefault((h, b, bv), set()).add((h, a, av))
    known = {}

    def above(node):
        if node not in known:
            seen, todo = {node}, [node]
            while todo:
                for x in into.get(todo.pop(), ()):
                    if x not in seen:
                        seen.add(x)
                        todo.append(x)
            known[node] = seen
        return known[node]

    return version, above, edges


@pytest.mark.parametrize("seed", [5, 6])
def test_path_factors_equal_brute_force(spark, seed):
    rows = events(seed, 50)
    version, above, _ = closure(rows)
    ends = sorted(version)
    pairs = [Row(host=a[0], x=a[1], y=b[1]) for a in ends for b in ends if a[0] == b[0]] + [Row(host="h0", x="none", y="proc:a")]
    got = {(r.host, r.x, r.y): r.path_factor for r in paths.path_factors(spark.createDataFrame(rows), spark.createDataFrame(pairs)).collect()}
    for p in pairs:
        key, want = (p.host, p.x, p.y), None
        if (p.host, p.x) in version:
            x = set().union(*[above((p.host, p.x, v)) for v in range(1, version[p.host, p.x] + 1)])
            y = set().union(*[above((p.host, p.y, v)) for v in range(1, version[p.host, p.y] + 1)])
            common = x & y
            minimal = common - set().union(*[above(b) - {b} for b in common], set())
            if any((p.host, p.x, v) in y for v in range(1, version[p.host, p.x] + 1)):
                want = len(minimal) or None
        assert got[key] == want, key


def test_distances_equal_search(spark):
    rows = events(7, 50)
    version, _, edges = closure(rows)
    start = Row(host="h0", entity="proc:a")
    best = {("h0", "proc:a", v): 0 for v in range(1, version["h0", "proc:a"] + 1)}
    for _ in range(200):
        for h, _, kind, a, av, b, bv in edges:
            n = best.get((h, a, av), 1 << 30) + (kind == "DATA_FLOW" and a != b)
            if n < best.get((h, b, bv), 1 << 30):
                best[h, b, bv] = n
    want = {}
    for (h, e, _), n in best.items():
        if n < 1 << 30:
            want[h, e] = min(n, want.get((h, e), 1 << 30))
    got = {(r.host, r.entity): r.hops for r in paths.distances(spark.createDataFrame(rows), spark.createDataFrame([start])).collect()}
    assert got == want
