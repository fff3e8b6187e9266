"""Links, scenarios, searches and the online index against plain searches."""

import itertools
import random

from pyspark.sql import Row
from pyspark.sql import functions as F

from lineagram.operators import graph, hsg, links, online, paths, state
from lineagram.operators.rules import Rule
from tests.test_operators import events, replay

RULES = [Rule("a", stage=1, prerequisites=("shared_entity",)), Rule("b", stage=2), Rule("c", stage=3, prerequisites=("graph_path",), max_path_factor=2)]


def some_matches(spark, seed, n=40):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        rows.append(Row(host="h0", seq=i, rule_id=rng.choice("abc"), subject=rng.choice(["proc:a", "proc:b"]), object=rng.choice(["file:x", "file:y", "ip:1", "proc:a"]), stage=rng.randrange(1, 4), severity=2.0, cvss=5.0, bytes=i, op="write"))
    df = spark.createDataFrame(rows).withColumn("rule_order", F.ascii("rule_id") - 97).withColumn("ts", F.timestamp_seconds(F.col("seq") * 60))
    return rows, hsg.with_ids(df)


def test_counts_and_components_equal_pairs(spark):
    rows, df = some_matches(spark, 1)
    linked = [(x, y) for x, y in itertools.combinations(range(len(rows)), 2) if (rows[x].subject == rows[y].subject or rows[x].object == rows[y].object) and "a" in (rows[x].rule_id, rows[y].rule_id)]
    total = links.link_counts(df.withColumn("scenario", F.lit(1)), RULES, "scenario").first().links
    assert total == len(linked)
    by = {(r.role, r.entity, r.rule_a, r.rule_b): r.links for r in links.shared_entity_edges(df, RULES).collect()}
    want = {}
    for x, y in itertools.combinations(rows, 2):
        if "a" in (x.rule_id, y.rule_id):
            for role in ("subject", "object"):
                if x[role] == y[role]:
                    key = (role, x[role], *sorted((x.rule_id, y.rule_id)))
                    want[key] = want.get(key, 0) + 1
    assert by == want
    root = list(range(len(rows)))
    for x, y in linked:
        a, b = sorted((root[x], root[y]))
        root = [a if r == b else r for r in root]
    got = {r.seq: r.scenario for r in hsg.scenarios(df, links.star_links(df, RULES)).collect()}
    groups = lambda m: {frozenset(k for k in m if m[k] == v) for v in m.values()}
    assert groups(got) == groups(dict(enumerate(root)))


def test_candidates_and_path_edges(spark):
    rows, df = some_matches(spark, 2)
    ev = events(9, 80)
    evs = spark.createDataFrame([r for r in ev if r.host == "h0"])
    edges = links.graph_path_edges(evs, df, RULES, most=50).collect()
    pf = {(r.x, r.y): r.path_factor for r in paths.path_factors(evs, spark.createDataFrame([Row(host="h0", x=a, y=b) for a in {r.object for r in rows} for b in {r.object for r in rows}])).collect()}
    first = {}
    for r in sorted(rows, key=lambda r: r.seq):
        first.setdefault((r.rule_id, r.subject, r.object), r.seq * 8192 + ord(r.rule_id) - 97)
    want = set()
    for p, q in itertools.permutations(first, 2):
        if "c" in (p[0], q[0]) and set(p[1:]) & set(q[1:]) and (pf[p[2], q[2]] or 9) <= 2:
            want.add((first[p], first[q], float(pf[p[2], q[2]])))
    assert {(r.src_node, r.dst_node, r.path_factor) for r in edges} == want and len(edges) == len(want) > 0
    few = links.candidates(df, RULES, most=1).groupBy("right").count().collect()
    assert all(r["count"] == 1 for r in few)
    got = links.active(df, RULES, links.graph_path_edges(evs, df, RULES, most=50))
    act = {r.node for r in got.where("active").collect()}
    node = lambda r: r.seq * 8192 + ord(r.rule_id) - 97
    shared = {node(r) for r in rows for x in rows if x.seq != r.seq and "a" in (x.rule_id, r.rule_id) and (x.subject == r.subject or x.object == r.object)}
    forward = {v for a, b, _ in want if a < b for v in (a, b)}
    classed = {node(r) for r in rows if first[r.rule_id, r.subject, r.object] in forward}
    assert act == {node(r) for r in rows if r.rule_id == "b"} | shared | classed


def test_conditions(spark):
    ev = [Row(host="h", seq=i, ts=None, subject=s, op=o, object=t) for i, (s, o, t) in enumerate([("proc:a", "write", "file:x"), ("proc:b", "read", "file:x"), ("proc:b", "connect", "ip:9"), ("proc:a", "fork", "proc:c")])]
    evs = spark.createDataFrame(ev, "host string, seq long, ts timestamp, subject string, op string, object string")
    say = lambda **c: {"operator": "AND", "conditions": [c]}
    trees = {
        "path": say(type="path_factor", source_node="subject", target_node="object", threshold="path_thres", op="<="),
        "no_path": say(type="path_factor", source_node="object", target_node="subject", threshold=3, op="le"),
        "wrote": say(type="relation_check", source_node="$current_process", target_node="$target_file", relation="ACTS_ON"),
        "spawned": say(type="relation_check", source_node="object", target_node="subject", relation="spawned_by"),
        "state": say(type="node_state", target_node="$current_process", attribute="is_executable", expected_value=True),
        "not_state": say(type="node_state", target_node="$target_file", attribute="is_executable", expected_value=True),
        "exists": say(type="event_existence", target_node="$dns_query"),
        "outside": say(type="event_existence", target_node="Untrusted_External_Node"),
        "tainted": say(type="path_factor", source_node="Compromised_Process", target_node="object", threshold=5, op="le"),
        "either": {"operator": "OR", "conditions": [{"type": "event_existence", "target_node": "$dns_query"}, {"type": "event_existence", "target_node": "subject"}]},
        "odd": say(type="unknown"),
        "none": {"operator": "AND", "conditions": []},
    }
    rows = [Row(host="h", node=i, seq=3, rule_id=r, bindings={"subject": "proc:a", "object": "proc:c" if r == "spawned" else "file:x"}) for i, r in enumerate(trees)]
    tainted = spark.createDataFrame([("h", "proc:a", 0)], "host string, entity string, tainted_seq long")
    got = links.evaluate(spark.createDataFrame(rows), [Rule(r, prerequisite_ast=t) for r, t in trees.items()], evs, tainted, {"path_thres": 3.0})
    held = {r.rule_id: r.satisfied for r in got.collect()}
    assert held == {"path": True, "no_path": False, "wrote": True, "spawned": True, "state": True, "not_state": False, "exists": False, "outside": True, "tainted": True, "either": True, "odd": False, "none": True}
    asep = spark.range(1).select(links.node_state(F.lit("reg:HKLM\\Software\\Microsoft\\Windows\\CurrentVersion\\Run\\x"), "is_asep_key", True).alias("a"), links.node_state(F.lit("reg:HKLM\\x"), "is_asep_key", False).alias("b"), links.node_state(F.lit("file:A.EXE"), "is_executable", True).alias("c"))
    assert tuple(asep.first()) == (True, True, True)


def shortest(edges, starts):
    best = {s: (0, 0) for s in starts}
    for _ in range(len(edges)):
        moved = False
        for h, _, kind, a, av, b, bv in edges:
            if (h, a, av) in best:
                n, k = best[h, a, av]
                new = (n + (kind == "DATA_FLOW"), k + 1)
                if new < best.get((h, b, bv), (1 << 30, 0)):
                    best[h, b, bv], moved = new, True
        if not moved:
            break
    return best


def test_searches(spark):
    rows = events(11, 60)
    _, edges, version = replay(rows)
    df = spark.createDataFrame(rows)
    ge, gn = graph.edges(df), graph.nodes(df)
    start = ("h0", "proc:a", 1)
    want = shortest(edges, [start])
    s = spark.createDataFrame([(start[0], "s", start[1], start[2])], "host string, start string, entity string, version int")
    assert {(r.host, r.entity, r.version): r.hops for r in paths.search(ge, s).collect()} == {k: v[0] for k, v in want.items()}
    assert {(r.host, r.entity, r.version) for r in paths.search(ge, s, most_hops=1).collect()} == {k for k, v in want.items() if v[0] <= 1}
    back = {(r.host, r.entity, r.version) for r in paths.search(ge, s, forward=False).collect()}
    assert back == {start}
    pairs = spark.createDataFrame([("h0", "proc:a#v1", "file:x"), ("h0", "file:x", "proc:b"), ("h0", "proc:a#v1", "none")], "host string, x string, y string")
    got = {(r.x, r.y): r.hops for r in paths.connected(ge, pairs, gn).collect()}
    assert got["proc:a#v1", "file:x"] == min(v[0] for k, v in want.items() if k[1] == "file:x") and ("proc:a#v1", "none") not in got
    steps = {(f"{a}#v{av}", f"{b}#v{bv}") for h, _, _, a, av, b, bv in edges if h == "h0"}
    for r in paths.shortest_paths(ge, pairs, gn).collect():
        assert r.hops == got[r.x, r.y] and all(p in steps for p in zip(r.nodes, r.nodes[1:])) and r.nodes[-1].startswith(r.y)
    place = {(r.host, r.entity, r.version): r.place for r in paths.topological(gn).collect()}
    assert all(place[h, a, av] < place[h, b, bv] for h, _, _, a, av, b, bv in edges)
    assert paths.capped(paths.search(ge, s), 1).count() == len(want)
    told = state.with_relations(df)
    sem = graph.semantic_edges(told).collect()
    by_event = {e.seq: e for e in rows}
    assert sem and all(version[r.host, r.src] >= r.src_version and by_event[r.seq].host == r.host for r in sem)
    reached = {(r.entity, r.version) for r in paths.semantic_reach(graph.semantic_edges(told), ge, s, ["write"]).collect()}
    assert ("proc:a", 1) in reached and reached <= {(e, v) for h, e, v in {(h, e, i) for (h, e), m in version.items() for i in range(1, m + 1)} if h == "h0"}


def test_common_ancestors(spark):
    rows = [Row(host="h", seq=i, subject=s, op="write", object=o) for i, (s, o) in enumerate([("file:r", "file:x"), ("file:r", "file:y"), ("file:x", "file:z"), ("file:y", "file:z")])]
    df = spark.createDataFrame(rows)
    got = {(r.entity, r.minimal) for r in paths.common_ancestors(df, spark.createDataFrame([Row(host="h", x="file:x", y="file:y")])).collect()}
    assert ("file:r", True) in got
    lin = graph.ancestors(spark.createDataFrame([Row(host="h", seq=i, subject=s, op="fork", object=o) for i, (s, o) in enumerate([("proc:r", "proc:a"), ("proc:r", "proc:b"), ("proc:q", "proc:c")])]))
    pairs = spark.createDataFrame([("h", "proc:a", "proc:b"), ("h", "proc:a", "proc:c"), ("h", "proc:r", "proc:a")], "host string, x string, y string")
    assert {(r.x, r.y) for r in paths.common_process_ancestor(lin, pairs).collect()} == {("proc:a", "proc:b"), ("proc:r", "proc:a")}


def test_online_index_in_batches_equals_one(spark):
    rows = [r for r in events(12, 60) if r.host == "h0"]
    df = spark.createDataFrame(rows)
    v, ge = graph.versions(df), graph.edges(df)
    found = df.where("seq % 7 = 0").selectExpr("host", "seq", "subject", "object", "concat('m', seq) as match_id", "if(seq % 2 = 0, 'a', 'b') as rule_id")
    whole = online.extend(None, ge, new_rows=online.seeds(found, v))
    first = online.extend(None, ge.where("seq < 30"), new_rows=online.seeds(found.where("seq < 30"), v.where("seq < 30")))
    both = online.extend(first, ge, ge.where("seq >= 30"), online.seeds(found.where("seq >= 30"), v))
    pick = lambda d: {tuple(r) for r in d.select(*online.ROW, "hops", "seq").collect()}
    assert pick(whole) == pick(both) and len(pick(whole)) > 20
    rest = online.extend(None, ge, new_rows=online.seeds(found.where("match_id != 'm0'"), v))
    assert pick(online.remove(whole, spark.createDataFrame([("m0",)], "match_id string"))) == pick(rest)
    gone = graph.nodes(df).where("version = 1").select("host", "entity", "version")
    assert all(r.version > 1 and not r.origin.endswith("#v1") for r in online.prune(whole, gone).collect())
    gated = online.gate(found, v, whole, {"b": ("a",)})
    assert all(r.passes for r in gated.where("rule_id = 'a'").collect())
    reach = {}
    for r in whole.collect():
        reach.setdefault((r.entity, r.version), set()).add((r.match_id, r.rule_id, r.seq))
    at = {(r.seq, r.entity): r.after for r in v.collect()}
    for r in gated.where("rule_id = 'b'").collect():
        assert r.passes == any(rule == "a" and s < r.seq for e in (r.subject, r.object) for _, rule, s in reach[e, at[r.seq, e]])
    assert online.lookups(whole).where("hops > 5").count() == 0


def test_chains(spark):
    ev = [("proc:p", "fork", "proc:c", 1), ("proc:p", "write", "file:f", 2), ("proc:d", "read", "file:f", 3), ("proc:q", "write", "file:f", 6)]
    evs = spark.createDataFrame([Row(host="h", seq=q, subject=s, op=o, object=t) for s, o, t, q in ev])
    found = spark.createDataFrame([Row(host="h", seq=q, subject=s, rule_id=r) for s, r, q in [("proc:p", "first", 2), ("proc:c", "second", 4), ("proc:d", "second", 5), ("proc:p", "second", 2), ("proc:q", "second", 9), ("proc:c", "third", 8)]])
    got = {(r.dst, r.dst_rule, r.src, r.src_rule, r.distance) for r in state.chains(evs, found, {"second": ("first",), "third": ("second", "first")}).collect()}
    assert got == {("proc:c", "second", "proc:p", "first", 1), ("proc:d", "second", "proc:p", "first", 1), ("proc:c", "third", "proc:c", "second", 0)}


def test_state(spark):
    rows = [("h", 1, "proc:a", "low", None, False), ("h", 2, "proc:a", "high", None, False), ("h", 3, "proc:a", None, 5, False), ("h", 4, "proc:b", None, 0, False), ("h", 5, "proc:c", None, None, False)]
    got = {r.seq: (r.level, r.high, r.system, r.root, r.elevated) for r in state.privileges(spark.createDataFrame(rows, "host string, seq long, subject string, integrity string, euid int, elevated boolean")).collect()}
    assert got == {1: (1, False, False, False, True), 2: (3, True, False, False, True), 3: (3, True, False, False, True), 4: (None, False, False, True, True), 5: (None, False, False, False, False)}
    found = spark.createDataFrame([("h", 1, "r", {"subject": "proc:a", "$x": "file:f"}), ("h", 2, "s", {"subject": "proc:b"}), ("h", 3, "t", {"subject": "proc:c"})], "host string, seq long, rule_id string, bindings map<string,string>")
    rules = [Rule("r", stage=1, entity_bindings=({"symbol": "$x"},)), Rule("s"), Rule("t", stage=3)]
    assert {(r.seq, r.entity) for r in state.seeds(found, rules).collect()} == {(1, "file:f"), (2, "proc:b")}
    last = spark.createDataFrame([("h", "a", 1, 100), ("h", "b", 1, 990), ("h", "c", 1, None), ("h", "d", 1, 50)], "host string, entity string, tainted_seq long, t long").selectExpr("host", "entity", "tainted_seq", "timestamp_seconds(t) as last_ts")
    keep = spark.createDataFrame([("h", "d")], "host string, entity string")
    assert {r.entity for r in state.evict_taint(last, F.timestamp_seconds(F.lit(1000)), 500, keep).collect()} == {"b", "c", "d"}
    assert [r.entity for r in state.tainted_of(spark.createDataFrame([("proc:a",), ("file:b",)], "entity string"), "PROC").collect()] == ["proc:a"]
    assert {r.entity for r in state.forget(last, keep).collect()} == {"a", "b", "c"}
    ev = spark.createDataFrame([("h", 1, "proc:a", "exit", "proc:a"), ("h", 2, "proc:b", "exit", "proc:b"), ("h", 900, "proc:c", "write", "proc:b")], "host string, t long, subject string, op string, object string").withColumn("ts", F.timestamp_seconds("t"))
    assert {r.entity for r in state.ended(ev, F.timestamp_seconds(F.lit(1000)), 500).collect()} == {"proc:a"}


def test_scores_goldens(spark):
    rows = [(1, 10, 8.0, 1, None), (1, 11, 9.5, 3, 9.5), (1, 12, 3.0, 3, 3.0), (2, 20, 40.0, None, 40.0)]
    df = spark.createDataFrame(rows, "scenario long, node long, severity double, stage int, cvss double").withColumn("cvss", F.coalesce("cvss", "severity"))
    assert {r.scenario: r.paper_score for r in hsg.paper_scores(df).collect()} == {1: round(1.8 * 1.95, 6), 2: 2.0}
    assert {r.scenario: r.exact_score for r in hsg.exact_scores(df).collect()} == {1: 80.0, 2: 10.0}
    import math

    edges = spark.createDataFrame([(1, 1.0, 2), (1, 2.0, 1)], "scenario long, path_factor double, links long")
    s = hsg.path_sums(edges).first()
    assert (s.paths, s.strength, round(s.mean_strength, 6), s.multiplier) == (3, 2.5, round(2.5 / 3, 6), min(2.0, 1 + 2 * math.log(2) + math.log(1.5)))
    one = spark.createDataFrame([(1, 3.0, 1)], "scenario long, path_factor double, links long")
    assert {r.scenario: r.paper_score for r in hsg.paper_scores(df, path_edges=one).collect()}[1] == round(1.8 * 1.95 * (1 + math.log(4 / 3)), 6)
    raised = spark.createDataFrame([("s", i, i, sev, st) for i, (sev, st) in enumerate([(50.0, 1), (40.0, 1), (5.0, 1), (4.0, 1), (2.0, 2), (11.0, 2)])], "scenario string, seq long, node long, severity double, stage int")
    assert [(r.seq, r.total, r.stages) for r in hsg.alerts(raised).orderBy("seq").collect()] == [(1, 90.0, 1), (4, 101.0, 2), (5, 112.0, 2)]
    n = hsg.numbered(spark.range(1000).selectExpr("(id * 7919) % 1000 as v").repartition(7), "v")
    assert n.where("v + 1 != number").count() == 0


def test_capacities(spark):
    rows = [("h", i, st, i * 10, d) for i, (st, d) in enumerate([(1, 5), (3, 0), (1, 0), (None, 2)])]
    df = spark.createDataFrame(rows, "host string, node long, stage int, t long, degree long").withColumn("ts", F.timestamp_seconds("t"))
    assert [r.node for r in hsg.evict_pending(df, 2).orderBy("node").collect()] == [0, 2]
    assert [r.node for r in hsg.evict_active(df.drop("degree"), df.select("node", "degree"), 2).orderBy("node").collect()] == [1, 2]
    edges = spark.createDataFrame([("h", 1, 2, "shared_entity", None, 5), ("h", 1, 3, "graph_path", 0.5, 9), ("h", 2, 3, "graph_path", 0.5, 1), ("h", 3, 4, "graph_path", 1.0, 0)], "host string, src_node long, dst_node long, relation string, weight double, last_seen long")
    gone, closed = hsg.evict_edges(edges, 3)
    assert [(r.src_node, r.dst_node) for r in gone.collect()] == [(1, 3)] and {r.node for r in closed.collect()} == {1, 3}
    assert [(r.src_node, r.dst_node) for r in hsg.evict_paths(edges, 2).collect()] == [(2, 3)]
    assert hsg.among(edges, spark.createDataFrame([(1,), (2,), (3,)], "node long")).count() == 3
    pend = spark.createDataFrame([("h", 1, "proc:a", "file:x"), ("h", 2, "proc:b", "file:y")], "host string, node long, subject string, object string")
    act = spark.createDataFrame([("h", 9, "proc:c", "file:z")], "host string, node long, subject string, object string")
    reach = spark.createDataFrame([("h", "file:x", "proc:c"), ("h", "proc:c", "file:y")], "host string, src string, dst string")
    assert [r.node for r in hsg.activated(pend, act, reach).collect()] == [1]


def test_cheap_candidates(spark):
    met = links.candidates(some_matches(spark, 2)[1], RULES, most=50)
    none = spark.createDataFrame([], "host string, src string, dst string")
    alike = {(r.left.first, r.right.first) for r in links.cheap_candidates(met, none).collect()}
    assert alike == {(r.left.first, r.right.first) for r in met.collect() if {x.split(":")[0] for x in (r.left.subject, r.left.object)} & {x.split(":")[0] for x in (r.right.subject, r.right.object)}}
    one = spark.createDataFrame([Row(host="h", left=Row(subject="proc:a", object="file:x"), right=Row(subject="ip:1", object="reg:k"))])
    assert links.cheap_candidates(one, none).count() == 0
    assert links.cheap_candidates(one, spark.createDataFrame([("h", "file:x", "reg:k")], "host string, src string, dst string")).count() == 1


def test_ranked_equals_candidates(spark):
    df = some_matches(spark, 2)[1]
    for most in (1, 3, 50):
        want = links.candidates(df, RULES, most=most).select("host", "left.first", F.col("right.first"), "common", "place").collect()
        assert sorted(map(tuple, links.ranked(df, RULES, most=most).collect())) == sorted(map(tuple, want)) and want
