import json

import pytest

from lineagram.operators import ruleset as rs
from lineagram.operators.rules import Rule

YAML = """
scoring: {alpha: 2.5}
rules:
  - {rule_id: r1, name: One, source_types: [process], event_predicate: {op: write}, severity: 3, stage: 4}
  - rule_id: r2
    name: Two
    prerequisites: [shared_entity, {type: path_factor, max_path_factor: 2}, graph_path]
    apt_stage: Lateral Movement
    match_logic: {engine: sigma, selectors: {}, condition: {}}
    entity_bindings: [{symbol: $x, entity_type: file, fields: [a]}]
    bypass_benign_filter: true
"""


def test_yaml(tmp_path):
    pytest.importorskip("yaml")
    (tmp_path / "a.yaml").write_text(YAML)
    got = rs.load_rules(tmp_path / "a.yaml")
    one, two = got.rules
    assert (got.alpha, got.says_alpha) == (2.5, True)
    assert (one.stage, one.apt_stage, one.severity, one.event_predicate, one.source_types) == (4, "Privilege Escalation", 3.0, {"op": "write"}, ("process",))
    assert (two.prerequisites, two.max_path_factor, two.apt_stage, two.bypass_benign_filter) == (("shared_entity", "graph_path"), 2, "Move Laterally", True)
    (tmp_path / "b.yml").write_text("")
    assert rs.load_rules(tmp_path / "b.yml") == rs.RuleSet()
    with pytest.raises(ValueError):
        rs.load_rules(tmp_path / "c.txt")


def test_json(tmp_path):
    tree = {"operator": "OR", "conditions": [{"type": "event_existence", "target_node": "$x"}]}
    (tmp_path / "a.json").write_text(json.dumps([{"rule_id": "j", "name": "J", "severity_score": 7, "prerequisites": tree}]))
    (rule,) = rs.load_rules(tmp_path / "a.json").rules
    assert (rule.severity, rule.cvss, rule.prerequisite_ast, rule.prerequisites) == (7.0, 7.0, tree, ())


@pytest.mark.parametrize(
    "change",
    [
        {"rule_id": 3}, {"name": None}, {"stage": 9}, {"stage": "x"}, {"cvss": 11}, {"severity": "x"}, {"apt_stage": "none"}, {"source_types": "process"}, {"event_predicate": {"op": ""}}, {"event_predicate": {"op": "a", "event_type": "b"}},
        {"prerequisites": [{"type": "path_factor"}]}, {"prerequisites": [{"type": "path_factor", "max_path_factor": -1}]}, {"prerequisites": [{"type": "path_factor", "max_path_factor": 1, "op": "ge"}]}, {"prerequisites": "graph_path"}, {"bypass_benign_filter": "yes"}, {"entity_bindings": ["x"]},
    ],
)
def test_rules_that_are_wrong(tmp_path, change):
    (tmp_path / "a.json").write_text(json.dumps({"rules": [{"rule_id": "a", "name": "A"} | change]}))
    pytest.importorskip("yaml")
    (tmp_path / "a.yaml").write_text(json.dumps({"rules": [{"rule_id": "a", "name": "A"} | change]}))  # JSON is YAML
    with pytest.raises(ValueError):
        rs.load_rules(tmp_path / "a.yaml")


def test_pairs_and_bindings(tmp_path):
    a, b, c = Rule("a", prerequisites=("graph_path",), max_path_factor=3), Rule("b", prerequisites=("shared_entity",), max_path_factor=2), Rule("c")
    assert rs.link_kinds(a, b) == {"graph_path", "shared_entity"} and rs.link_kinds(a, b, "dst_only") == {"shared_entity"} and rs.path_limit(a, b) == 2 and rs.path_limit(b, c, "dst_only") is None
    assert rs.allowed_pairs([a, c], "graph_path") == [("a", "a", 3), ("a", "c", 3), ("c", "a", 3)]
    assert rs.allowed_pairs([a, c], "graph_path", allowlist={("c", "a")}) == [("c", "a", 3)]
    config = {"by_pair": {"a->b": {"from_binding": "x", "to_binding": "y"}}, "by_right_rule_id": {"b": {"from_binding": "p"}}, "default": {"from_binding": "d"}}
    assert [rs.path_bindings(*p, config)["from_binding"] for p in (("a", "b"), ("c", "b"), ("c", "c"))] == ["x", "p", "d"]
    (tmp_path / "l.json").write_text(json.dumps({"pairs": ["a->b", "c, d", ["e", "f"], {"left": "g", "to": "h"}, 5]}))
    assert rs.load_allowlist(tmp_path / "l.json") == {("a", "b"), ("c", "d"), ("e", "f"), ("g", "h")} and rs.load_allowlist("none") is None
    with pytest.raises(ValueError):
        rs.link_kinds(a, b, "other")
    assert rs.infer_stage(Rule("x", technique="file_to_ip")) == 5 and rs.infer_stage(Rule("x")) == 1 and rs.infer_cvss(Rule("x", severity=40.0)) == 10.0


def test_literals_and_configuration(tmp_path):
    words = rs.keywords([Rule("rule-x", "Name", match_logic={"a": [{"value": "file:/tmp/Evil.sh"}, {"value": "ab"}]})], ["More"])
    assert {"more", "rule-x", "name", "file:/tmp/evil.sh", "evil.sh", "/tmp/evil.sh"} == words
    assert rs.markers([("process_image:chrome", "file:/usr/lib/x.so")]) == {"chrome", "/usr/lib/x.so", "x.so"}
    (tmp_path / "n.json").write_text(json.dumps({"drop": {"rule_ids": ["a"], "match_id": ["m"]}, "min_path_factor": 2, "path_factor_op": "le"}))
    got = rs.load_noise_config(tmp_path / "n.json")
    assert (got.drop_rules, got.drop_matches, got.min_path_factor, got.path_factor_op) == ({"a"}, {"m"}, 2.0, "le") and rs.load_noise_config(None) == rs.NoiseConfig()
    (tmp_path / "bad.json").write_text(json.dumps({"path_factor_op": "eq"}))
    with pytest.raises(ValueError):
        rs.load_noise_config(tmp_path / "bad.json")
    assert rs.settings({"a": 1, "b": 2}, {"x": {"a": 5, "b": 6}}, {"b": 3}, {"a": ("x", "a"), "b": ("x", "b")}) == {"a": 5, "b": 3}
    for bad in ({}, {"events": 1, "watch_dir": 2}, {"kafka_topic": "t"}):
        with pytest.raises(ValueError):
            rs.check_sources(bad)
    (tmp_path / "p.json").write_text(json.dumps({"stage_weights": [1] * 7, "severity_map": {"low": 2}}))
    (tmp_path / "q.json").write_text(json.dumps({"tau": 1378.0, "stage_weights": [2] * 7}))
    assert rs.load_parameters(tmp_path / "p.json", tmp_path / "q.json").sources == {"stage_weights": "paper", "severity_map": "paper", "tau": "assumption"}
    with pytest.raises(ValueError):
        rs.load_parameters(tmp_path / "p.json")
