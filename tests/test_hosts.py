"""Host graphs in a worker against the index and searches by rounds."""

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from lineagram import session
from lineagram.operators import graph, hosts, hsg, links, online, paths, state
from lineagram.operators.rules import Rule
from lineagram.plans import catalog, extended  # noqa: F401
from tests.test_operators import events

SF = "/root/testdata/sf0.001"


def found(spark, rows):
    some = [Row(host=r.host, seq=r.seq, rule_id="abc"[r.seq % 3], rule_order=r.seq % 3, subject=r.subject, object=r.object) for r in rows if r.seq % 4]
    return hsg.with_ids(spark.createDataFrame(some))


def index(ev, m):
    return online.extend(None, graph.edges(ev), new_rows=online.seeds(m, graph.versions(ev)), fan_out=10**9)


@pytest.mark.parametrize("seed", [1, 2])
def test_gate_equals_index(spark, seed):
    ev = spark.createDataFrame(rows := events(seed, 60))
    m = found(spark, rows)
    for needs in ({"b": ("a",)}, {"b": ("b", "c"), "c": ("a",)}):
        want = online.gate(m, graph.versions(ev), index(ev, m), needs).select("match_id", "passes").collect()
        got = hosts.gate(ev, m, needs, online.DEPTH).select("match_id", "passes").collect()
        assert sorted(got) == sorted(want) and {r.passes for r in got} == {True, False}


def test_lookups_equal_index(spark):
    ev = spark.createDataFrame(rows := events(3, 60))
    m = found(spark, rows)
    columns = ["host", "entity", "version", "rule_id", "matches", "hops", "seq"]
    want = online.lookups(index(ev, m)).select(columns).collect()
    assert sorted(map(tuple, hosts.lookups(ev, m, online.DEPTH).select(columns).collect())) == sorted(map(tuple, want))


def test_lots_equal_whole(spark):
    ev = spark.createDataFrame(rows := [r for r in events(4, 80) if r.host == "h0"])
    g = hosts.Graph(hosts.moves(ev).toArrow())
    seeds = hosts._seeds(g, [r.seq for r in rows], [r.subject for r in rows], [r.object for r in rows])
    one, many = {}, {}
    for size, into in ((1000, one), (7, many)):
        for lo, node, sets in hosts._met(g, seeds, size, 2):
            into[node] = [a | b << lo for a, b in zip(into.get(node, [0] * 3), sets, strict=True)]
    assert one == many and one
    marks = [[x] for x in range(len(g.entity))]
    whole, parts = next(g.spread(marks, 1000))[1], [0] * len(marks)
    for lo, sets in g.spread(marks, 7):
        parts = [a | b << lo for a, b in zip(parts, sets, strict=True)]
    assert parts == whole


def asked(spark, rows):
    return spark.createDataFrame(rows, hosts.ASKED)


@pytest.mark.parametrize("seed", [5, 6])
def test_reached_equals_search(spark, seed):
    ev = spark.createDataFrame(events(seed, 80))
    nodes = graph.nodes(ev).select("host", F.concat("entity", F.lit("#"), "version").alias("start"), "entity", "version")
    want = paths.search(graph.edges(ev), nodes).select("host", "start", "entity", "version").collect()
    given = nodes.select("*", F.lit(None).cast("long").alias("seq"), F.lit(False).alias("goal"))
    assert sorted(map(tuple, hosts.reached(ev, given, nodes=True).collect())) == sorted(map(tuple, want))
    told = state.with_relations(ev)
    for names in (["spawned_by", "acts_on"], ["read", "write"], []):
        want = paths.semantic_reach(graph.semantic_edges(told), graph.edges(ev), nodes, names).select("host", "start", "entity").distinct().collect()
        assert sorted(map(tuple, hosts.reached(told, given, names).collect())) == sorted(map(tuple, want))
    goals = nodes.select("host", "start", F.lit("file:x").alias("entity"), F.lit(None).cast("int").alias("version"), F.lit(None).cast("long").alias("seq"), F.lit(True).alias("goal"))
    got = hosts.reached(told, given.union(goals), names).collect()
    assert sorted(map(tuple, got)) == sorted(tuple(r) for r in want if r.entity == "file:x")


def _no_cut(df):
    raise AssertionError("rows were written down")


@pytest.mark.parametrize("name", ["online_gate", "online_lookups", "version_descendants", "spawn_write_paths"])
def test_hosts_are_not_searched_by_rounds(spark, monkeypatch, name):
    monkeypatch.setattr(session, "cut", _no_cut)
    assert catalog.CATALOG[name](spark, SF).count()


def test_existence_lists_no_candidates(spark, monkeypatch):
    monkeypatch.setattr(links, "_symbol_table", lambda *a: pytest.fail("a host's candidates were listed for each match"))
    ev = spark.createDataFrame([Row(host="h", seq=1, subject="proc:a", op="connect", object="ip:1"), Row(host="g", seq=2, subject="proc:b", op="write", object="file:x")])
    m = spark.createDataFrame([Row(host=h, node=i, seq=3, rule_id="r", bindings={"subject": "proc:a"}) for i, h in enumerate("hg")])
    tree = {"operator": "AND", "conditions": [{"type": "event_existence", "target_node": "External_IP_Node"}]}
    got = links.evaluate(m, [Rule("r", prerequisite_ast=tree)], ev)
    assert {r.host: r.satisfied for r in got.collect()} == {"h": True, "g": False}
