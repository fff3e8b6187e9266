"""Graph paths of hosts in a worker against plain searches."""

import random

import numpy as np
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from lineagram import session
from lineagram.operators import classes, hosts, hsg, links, paths
from lineagram.operators.rules import DEMO_RULES, Rule
from lineagram.plans import catalog, extended  # noqa: F401
from tests.test_operators import events

SF = "/root/testdata/sf0.001"
RULES = [Rule("a", stage=1, prerequisites=("shared_entity",)), Rule("b", stage=2), Rule("c", stage=3, prerequisites=("graph_path",), max_path_factor=2), Rule("d", prerequisites=("graph_path",))]


def found(spark, rows, seed):
    rng = random.Random(seed)
    some = [Row(host=r.host, seq=r.seq, rule_id=rng.choice("abcd"), subject=r.subject if rng.random() < 0.9 else None, object=r.object, severity=float(rng.randrange(1, 9)), stage=1) for r in rows for _ in range(2)]
    df = spark.createDataFrame(some, "host string, seq long, rule_id string, subject string, object string, severity double, stage int")
    return hsg.with_ids(df.dropDuplicates(["seq", "rule_id"]).withColumn("rule_order", F.ascii("rule_id") - 97))


def joined(ev, m, most, policy="union"):
    """Path edges by joining candidates and path factors."""
    met = links.candidates(m, RULES, most=most, policy=policy)
    way = lambda a, b: met.select("host", F.col(f"{a}.first").alias("src"), F.col(f"{b}.first").alias("dst"), F.col(f"{a}.object").alias("x"), F.col(f"{b}.object").alias("y"), "path_limit", (F.col("left.n") * F.col("right.n")).alias("links"))
    both = session.cut(way("left", "right").union(way("right", "left")).where("x is not null and y is not null"))
    pf = paths.path_factors(ev, both.select("host", "x", "y").distinct()).where("path_factor > 0")
    return both.join(pf, ["host", "x", "y"]).where("path_limit is null or path_factor <= path_limit").select("host", "src", "dst", F.col("path_factor").cast("double"), "links")


@pytest.mark.parametrize("seed", [1, 2])
def test_edges_equal_joins(spark, monkeypatch, seed):
    monkeypatch.setattr(classes, "BLOCK", 50)
    ev = spark.createDataFrame(rows := events(seed, 120))
    m = found(spark, rows, seed).localCheckpoint()
    for most, policy in ((10**6, "union"), (3, "union"), (10**6, "dst_only")):
        got = links.graph_path_edges(ev, m, RULES, None if most > 9 else most, policy).select("host", "src_node", "dst_node", "path_factor", "links").collect()
        assert sorted(map(tuple, got)) == sorted(map(tuple, joined(ev, m, most, policy).collect())) and any(r.path_factor > 1 for r in got)


@pytest.mark.parametrize("bits", [1, 1 << 31])
def test_factors_equal_replay(spark, monkeypatch, bits):
    monkeypatch.setattr(hosts, "BITS", bits)
    for seed in range(3, 9):
        rng = random.Random(seed)
        rows = [Row(host="h", seq=i, subject=f"proc:{rng.randrange(60)}", op=rng.choice(["read", "write", "fork", "exec"]), object=rng.choice(["proc", "file"]) + f":{rng.randrange(60)}") for i in range(400)]
        ev = spark.createDataFrame(rows)
        g, n = hosts.Graph(hosts.moves(ev).toArrow()), 0
        version, reach = paths._replay(paths._steps(ev).toPandas().sort_values("seq")[["src", "dst", "bumped"]].itertuples(index=False))
        now = {e: reach[e, v] for e, v in version.items()}
        want = {}
        for i, x in enumerate(g.names):
            for j, y in enumerate(g.names):
                if i != j and x in now[y]:
                    want[i * len(g.names) + j] = len(paths.minimal_ancestors(now[x], now[y], reach))
        every = np.array([i * len(g.names) + j for i in range(len(g.names)) for j in range(len(g.names)) if i != j])
        keys, got = classes.factors(g, every)
        assert dict(zip(keys.tolist(), got.tolist(), strict=True)) == want and max(want.values()) > 3


def _no_cut(df):
    raise AssertionError("rows were written down")


@pytest.mark.parametrize("name", ["graph_path_edges", "scenario_graph"])
def test_pairs_are_not_shuffled(spark, monkeypatch, name):
    monkeypatch.setattr(session, "cut", _no_cut)
    assert catalog.CATALOG[name](spark, SF).count()


def test_no_cap_on_candidates(spark, tmp_path):
    # 300 users change one key of one host: each of them has a path to all others
    raw = spark.range(300).select(F.col("id").alias("event_id"), F.timestamp_seconds("id").alias("ts"), (F.col("id") * 50).alias("user_id"), F.lit("error").alias("event_type"), F.lit(1.0).alias("value"), F.lit('{"k": 1}').alias("props"))
    raw.write.parquet(str(tmp_path / "events.parquet"))
    assert catalog.CATALOG["graph_path_edges"](spark, str(tmp_path)).count() == 300 * 299


@pytest.mark.parametrize("seed", [4])
def test_scored_equals_build(spark, monkeypatch, seed):
    monkeypatch.setattr(classes, "BLOCK", 50)
    rng = random.Random(seed)
    rows = [Row(host=f"h{i % 3}", seq=i, subject=f"proc:{rng.randrange(25)}", op=rng.choice(["read", "write", "fork"]), object=rng.choice(["proc", "file", "reg"]) + f":{rng.randrange(25)}") for i in range(150)]
    ev = spark.createDataFrame(rows)
    m = found(spark, rows, seed).where("seq % 3 > 0").localCheckpoint()
    kept, edges = hsg.build(ev, m, RULES, 3)
    want = sorted(map(tuple, hsg.legacy_scores(kept, RULES, edges).collect()))
    got = sorted(map(tuple, hsg.scored(ev, m, RULES, 3).collect()))
    assert [r[:6] for r in got] == [r[:6] for r in want] and np.allclose([r[6:] for r in got], [r[6:] for r in want], atol=2e-6)
    assert any(r[1] > 1 for r in got) and any(r[1] == 1 for r in got) and any(r[7] > 1 for r in got)
