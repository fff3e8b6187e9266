"""Operators against plain replays of their definitions, on small random inputs."""

import random

import pytest
from pyspark.sql import Row

from lineagram.operators import graph, rules, state


def events(seed, n=120):
    rng = random.Random(seed)
    ops = ["read", "write", "exec", "fork", "recv", "connect"]
    names = ["proc:a", "proc:b", "file:x", "file:y", "ip:1"]
    return [Row(seq=i, host=f"h{rng.randrange(2)}", subject=rng.choice(names), op=rng.choice(ops), object=rng.choice(names)) for i in range(n)]


def replay(rows):
    """Version graph by replay: (nodes, edges)."""
    version, nodes, edges = {}, set(), set()
    for e in rows:
        s, o = (e.host, e.subject), (e.host, e.object)
        src, dst = (o, s) if e.op in ("read", "exec", "recv") else (s, o)
        for x in (s, o):
            if x not in version:
                version[x] = 1
                nodes.add((*x, 1))
        bump = set()
        if e.op in ("read", "recv") or (e.op == "exec" and e.subject.startswith("proc")):
            bump.add(s)
        if e.op == "write":
            bump.add(o)
        bump = (bump or {o}) | {dst}
        before = dict(version)
        for x in bump:
            version[x] += 1
            nodes.add((*x, version[x]))
            edges.add((e.host, e.seq, "VERSION_TRANSITION", x[1], before[x], x[1], version[x]))
        edges.add((e.host, e.seq, "DATA_FLOW", src[1], before[src], dst[1], version[dst]))
    return nodes, edges, version


@pytest.mark.parametrize("seed", [1, 2])
def test_version_graph_equals_replay(spark, seed):
    rows = events(seed)
    df = spark.createDataFrame(rows)
    nodes, edges, version = replay(rows)
    assert {(r.host, r.entity, r.version) for r in graph.nodes(df).collect()} == nodes
    got = graph.edges(df).collect()
    assert {tuple(r) for r in got} == edges and len(got) == len(edges)
    assert graph.violations(df).first().backward == 0
    assert {((r.host, r.entity), r.version) for r in graph.current(df).collect()} == set(version.items())


def test_reach_equals_search(spark):
    rows = events(3, 60)
    _, edges, version = replay(rows)
    into = {}
    for h, _, _, a, av, b, bv in edges:
        into.setdefault((h, b, bv), set()).add((h, a, av))
    want = set()
    for (h, e), v in version.items():
        seen, todo = set(), [(h, e, v)]
        while todo:
            for x in into.get(todo.pop(), ()):
                if x not in seen:
                    seen.add(x)
                    todo.append(x)
        best = {}
        for _, a, av in seen:
            best[a] = max(best.get(a, 0), av)
        want |= {(h, e, a, av) for a, av in best.items() if a != e}
    assert {tuple(r) for r in graph.entity_reach(spark.createDataFrame(rows)).collect()} == want


def passes(e):
    """(from, to) of taint by an event's relations, from the published table."""
    s, o = e.subject, e.object
    sp, op_, out = s.split(":")[0], o.split(":")[0], []
    if e.op == "fork" and sp == op_ == "proc":
        out += [(s, o), (s, o)]
    if e.op == "exec" and op_ == "proc":
        out.append((o, s))
    if e.op == "write" and (sp, op_) == ("proc", "file"):
        out.append((s, o))
    if e.op == "read" and (sp, op_) == ("proc", "file"):
        out.append((o, s))
    if e.op == "connect" or op_ == "ip":
        out.append((s, o))
    return out


def test_taint_equals_replay(spark):
    rows = events(4)
    seeds = [Row(host="h0", seq=5, entity="proc:a"), Row(host="h1", seq=40, entity="file:x")]
    want, tainted = set(), set()
    for e in rows:
        for src, dst in passes(e):
            if (e.host, src) in tainted and (e.host, dst) not in tainted:
                tainted.add((e.host, dst))
                want.add((e.host, dst, e.seq))
        for s in seeds:
            if s.seq == e.seq and (s.host, s.entity) not in tainted:
                tainted.add((s.host, s.entity))
                want.add((s.host, s.entity, s.seq))
    got = {tuple(r) for r in state.taint(spark.createDataFrame(rows), spark.createDataFrame(seeds)).collect()}
    # a seed counts from its own event on, whichever host that event is on
    late = {s.host: s.seq for s in seeds}
    assert {g for g in got if g[2] not in late.values()} == {w for w in want if w[2] not in late.values()} and len(got) > 4
    assert {tuple(r) for r in state.taint(spark.createDataFrame(rows), spark.createDataFrame(seeds), rounds=True).collect()} == got


def logic(selectors, condition):
    return {"selectors": {k: {"type": "object", "items": v} for k, v in selectors.items()}, "condition": condition}


def item(field, value, *modifiers):
    return {"type": "field_match", "field": field, "value": value, "modifiers": list(modifiers)}


def test_rule_conditions(spark):
    df = spark.createDataFrame([Row(seq=1, host="h", subject="proc:a", op="write", object="file:/tmp/–x")])
    ref = lambda s: {"type": "selector_ref", "selector": s}
    cases = [
        (logic({"s": [item("op", "write")]}, ref("s")), True),
        (logic({"s": [item("op", "WRITE")]}, ref("s")), False),  # values compare by case
        (logic({"s": [item("nothing", {})]}, ref("s")), True),  # wildcard, even of a field that isn't there
        (logic({"s": [item("nothing", "x")]}, ref("s")), False),
        (logic({"s": [item("object", ["a", "/tmp/-"], "contains", "windash")]}, ref("s")), True),
        (logic({"s": [item("object", ["a", "-tmp--x"], "contains", "windash")]}, ref("s")), True),
        (logic({"s": [item("object", "(", "re")]}, ref("s")), False),  # a broken pattern matches nothing
        (logic({"s": [item("object", "^file:.tmp", "re")]}, ref("s")), True),
        (logic({"s": [item("op", "read")]}, {"type": "logical", "operator": "NOT", "operands": [ref("s")]}), True),
        (logic({"s": [item("op", "write")]}, {"type": "logical", "operator": "NOT", "operands": []}), False),
        (logic({"s": [item("op", "read")]}, {"type": "logical", "operator": "AND", "operands": []}), True),
        (logic({"a": [item("op", "write")], "b": [item("op", "read")], "c": [item("host", "h")]}, {"type": "selector_group", "count": 2, "selectors": ["a", "b", "c"]}), True),
        (logic({"a": [item("op", "write")]}, ref("missing")), False),
    ]
    found = rules.matches(df, [rules.Rule(f"r{i}", match_logic=c) for i, (c, _) in enumerate(cases)] + [rules.Rule("all")])
    assert {r.rule_id for r in found.collect()} == {f"r{i}" for i, (_, want) in enumerate(cases) if want} | {"all"}
    with pytest.raises(ValueError):
        rules.check([rules.Rule("a"), rules.Rule("a")])


def test_components(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(1, 12)] + [(20, 22), (22, 21)], "a long, b long")
    assert {tuple(r) for r in graph.components(links).collect()} == {(i, 1) for i in range(1, 13)} | {(20, 20), (21, 20), (22, 20)}


def test_flags_and_memory(spark):
    rows = [Row(seq=1, host="h", subject="proc:a", op="connect", object="ip:1", subject_state_change=True, object_state_change=False), Row(seq=2, host="h", subject="proc:a", op="write", object="proc:a", subject_state_change=False, object_state_change=False)]
    got = {(r.entity, r.seq): (r.before, r.after) for r in graph.versions(spark.createDataFrame(rows)).collect()}
    assert got == {("proc:a", 1): (1, 2), ("ip:1", 1): (1, 2), ("proc:a", 2): (2, 3)}
    rel = "array<struct<relation:string,src:string,dst:string>>"
    mem = [(i, "h", "proc:a", "mmap", "mem:1:0xa:0", [("make_mem_exec", "proc:a", "mem:1:0xa:0")] if x else []) for i, x in enumerate((False, True, False, True))] + [(9, "h", "proc:a", "read", "file:x", [])]
    out = {r.seq: r for r in graph.with_memory_versions(spark.createDataFrame(mem, f"seq long, host string, subject string, op string, object string, relations {rel}")).collect()}
    assert [out[i].object for i in range(4)] == ["mem:1:0xa:1", "mem:1:0xa:2", "mem:1:0xa:2", "mem:1:0xa:3"] and out[9].object == "file:x"
    assert out[1].relations[0].dst == "mem:1:0xa:2"


def test_rules_that_cant_be_used():
    for r in (rules.Rule("a", stage=8), rules.Rule("a", cvss=11.0), rules.Rule("a", max_path_factor=-1), rules.Rule("a", event_predicate="x", match_logic={"a": 1})):
        with pytest.raises(ValueError):
            rules.check([r])
    assert rules.check(rules.DEMO_RULES) == rules.DEMO_RULES


def test_types_predicates_and_bindings(spark):
    df = spark.createDataFrame(
        [(1, "h", "proc:a", "write", "file:x", "proc_to_file", "C:/img", ["linux", "linux/auditd"]), (2, "h", "file:x", "send", "ip:9", "file_to_ip", None, [])],
        "seq long, host string, subject string, op string, object string, event_type string, image string, source_tokens array<string>",
    )
    made = [
        rules.Rule("by_type", event_predicate={"event_type": "proc_to_file"}), rules.Rule("by_op", event_predicate={"op": "send"}), rules.Rule("from_proc", source_types=("process",)), rules.Rule("to_ip", target_types=("ip",)),
        rules.Rule("linux", source_types=("linux/auditd",)), rules.Rule("windows", source_types=("windows/etw",)),
        rules.Rule("bound", event_predicate={"op": "write"}, entity_bindings=({"symbol": "$current_process", "entity_type": "process"}, {"symbol": "$target_file", "entity_type": "file"}, {"symbol": "img", "entity_type": "file", "fields": ["none", "image"]})),
        rules.Rule("unbound", event_predicate={"op": "write"}, entity_bindings=({"symbol": "$remote_ip", "entity_type": "ipaddress"},)),
        rules.Rule("unseen", event_predicate={"op": "write"}, entity_bindings=({"symbol": "$current_file", "entity_type": "artifact", "fields": ["image"]},)),
    ]
    found = rules.matches(df, made)
    by = {(r.rule_id, r.seq) for r in found.collect()}
    assert {("by_type", 1), ("by_op", 2), ("from_proc", 1), ("to_ip", 2), ("linux", 1), ("linux", 2), ("windows", 2)} <= by and not {("windows", 1), ("from_proc", 2)} & by
    seen = spark.createDataFrame([("h", "file:C:/img", 0)], "host string, entity string, first_seq long")
    kept, dropped = rules.bind(found, made, first_seen=seen)
    got = {(r.rule_id, r.seq): r.bindings for r in kept.collect()}
    assert got["bound", 1] == {"subject": "proc:a", "object": "file:x", "$current_process": "proc:a", "$target_file": "file:x", "img": "file:C:/img"}
    assert {(r.rule_id, r.symbol, r.reason) for r in dropped.collect()} == {("unbound", "$remote_ip", "binding_symbol_unresolved"), ("unseen", "$current_file", "binding_entity_missing_in_graph")}
