import pytest
from pyspark.sql import Row

from lineagram.operators import evaluate as e
from lineagram.operators import sigma

RULE = {
    "id": "x1", "title": "Encoded shell", "logsource": {"product": "windows"}, "level": "high", "tags": ["attack.execution", "attack.t1059"],
    "detection": {
        "selection": {"Image|endswith": "\\powershell.exe", "CommandLine|contains|all": ["-enc", "hidden"]},
        "filter_one": {"User": "SYSTEM"}, "filter_two": {"Ip|cidr": "10.0.0.0/8"}, "condition": "selection and not 1 of filter_*",
    },
}


def test_detection(spark):
    rows = [
        ("C:\\x\\PowerShell.exe", "ps -ENC a -w Hidden", "bob", "1.2.3.4", True),
        ("C:\\x\\powershell.exe", "ps -enc a", "bob", "1.2.3.4", False),
        ("C:\\x\\powershell.exe", "ps -enc hidden", "system", "1.2.3.4", False),
        ("C:\\x\\powershell.exe", "ps -enc hidden", "bob", "10.200.3.4", False),
        (None, None, None, None, False),
    ]
    df = spark.createDataFrame([Row(n=i, Image=a, CommandLine=b, User=c, Ip=d) for i, (a, b, c, d, _) in enumerate(rows)], "n int, Image string, CommandLine string, User string, Ip string")
    assert {r.n for r in sigma.detect(df, RULE["detection"]).collect()} == {i for i, r in enumerate(rows) if r[4]}
    keyword = {"words": ["mimi*z", "lsass"], "condition": "words"}
    raw = spark.createDataFrame([("run MIMIKATZ now",), ("else",)], "raw string")
    assert [r.raw for r in sigma.detect(raw, keyword).collect()] == ["run MIMIKATZ now"]


def test_conditions():
    names = ["a", "b", "filter_x", "filter_y"]
    assert sigma.parse("a and b or not filter_x", names) == {"or": [{"and": [{"ref": "a"}, {"ref": "b"}]}, {"not": {"ref": "filter_x"}}]}
    assert sigma.parse("all of filter_*", names) == {"of": ["filter_x", "filter_y"], "least": 2}
    assert sigma.parse("1 of them", names)["of"] == names
    for bad in ("a and", "(a", "a b", "nothing"):
        with pytest.raises(ValueError):
            sigma.parse(bad, names)


def test_translate_and_lint():
    r = sigma.translate(RULE)
    assert (r.rule_id, r.stage, r.severity) == ("x1", 2, 8.0)
    assert r.match_logic["condition"]["compiled"]["operator"] == "AND"
    assert sigma.lint(RULE) == []
    bad = {"id": "y", "title": "t", "logsource": {"a": 1}, "detection": {"s": {"f|re": "("}, "t": {"g": 1}, "condition": "s"}}
    assert sigma.lint(bad) == ["search 't' is never used", "broken pattern in s.f|re"]


def test_evaluation(spark):
    alerts = spark.createDataFrame([("a", 9.0, ["s1", "s2"], ["x", "y"]), ("b", 8.0, ["s1"], ["x", "y"]), ("c", 7.0, [], ["q"]), ("d", 6.0, ["s3"], ["file:/w/1"]), ("e", 5.0, ["s3"], ["file:/v/1"])], "alert_id string, score double, stages array<string>, entities array<string>")
    truth = spark.createDataFrame([("s", ["s1", "s2"], ["y"], []), ("t", [], ["w"], []), ("u", ["s3"], ["none"], ["/w/"])], "scenario_id string, stages array<string>, exact array<string>, contains array<string>")
    r = e.coverage(alerts, truth).first()
    assert (r.tp, r.fp, r.fn) == (1, 4, 2) and (round(r.precision, 4), round(r.recall, 4), round(r.f1, 4), round(r.fragmentation, 4)) == (0.2, 0.3333, 0.25, 0.3333)
    assert [x.alert_id for x in e.diverse(alerts, 2)] == ["a", "c"]
    events = spark.createDataFrame([(i, 1 + i % 3, 8.0) for i in range(10)], "seq long, stage int, severity double").repartition(3)
    windows = spark.createDataFrame([("one", 0, 4, [1, 3, 4]), ("two", 5, 5, [5]), ("three", 6, 9, None)], "campaign string, first long, last long, stage_ends array<long>")
    assert {tuple(x) for x in e.campaigns(events, windows, 64.0).collect()} == {("one", 1, 1, 1), ("two", None, 8, None), ("three", 7, None, 1)}
    table = e.grid([2, 3], [50.0], lambda m, t: {"f1": 1.0 if m == 3 else 0.5, "recall": 1.0, "fragmentation": 0.0})
    assert table[0]["max_path_factor"] == 3
    done = e.experiment(lambda: "model", lambda m, a, b: {"f1": a, "recall": 0, "fragmentation": 0}, lambda m, a, b: (m, a, b), [2, 4], [80.0])
    assert done["result"] == ("model", 4, 80.0)
    assert e.throughput(lambda df: df.where("seq > 3"), events, 1)["events"] == 10


def test_vertex_cut(spark):
    rows = [(1, "s", "t", a, b) for a, b in (("s", "a"), ("s", "b"), ("a", "c"), ("b", "c"), ("c", "t"), ("s", "d"), ("d", "t"))] + [(2, "s", "t", "s", "t"), (3, "s", "t", "t", "s"), (4, "A", "B", "A", "X"), (4, "A", "B", "X", "B"), (5, "A", "B", "A", "X"), (5, "A", "B", "X", "B"), (5, "A", "B", "A", "Y"), (5, "A", "B", "Y", "B")]
    cuts = e.min_vertex_cut(spark.createDataFrame(rows, "pair long, source string, sink string, src string, dst string"))
    assert {tuple(r) for r in cuts.collect()} == {(1, 2), (2, 0), (3, None), (4, 1), (5, 2)}
    from lineagram.operators.paths import legacy_factor

    assert {r.pair: r.f for r in cuts.select("pair", legacy_factor(e.F.col("cut")).alias("f")).collect()} == {1: 1 / 3, 2: 0.5, 3: None, 4: 0.5, 5: 1 / 3}


def test_base64_and_aggregation(spark):
    import base64

    rows = [(i, "x" * i + base64.b64encode(b"ab"[: i % 3] + b"FromBase64String" + b"zz").decode(), f"2024-01-01 00:{i:02d}:00", 10.0 * i) for i in range(6)] + [(9, "nothing", "2024-01-01 00:01:00", 1.0)]
    df = spark.createDataFrame(rows, "n int, c string, t string, size double").selectExpr("n", "c", "cast(t as timestamp) as ts", "size", "n % 2 as k")
    found = sigma.detect(df, {"s": {"c|base64offset|contains": "FromBase64String"}, "condition": "s"})
    assert {r.n for r in found.collect()} == set(range(6))
    assert sigma.encoded("ab", False, True) == [base64.b64encode("ab".encode("utf-16-le")).decode()]
    agg = {"s": {"c|contains": "x"}, "timeframe": "1h", "condition": "s | sum(size) by k > 40"}
    assert [(r.k, r.value) for r in sigma.aggregate(df, agg).collect()] == [(1, 90.0), (0, 60.0)] or {(r.k, r.value) for r in sigma.aggregate(df, agg).collect()} == {(1, 90.0), (0, 60.0)}
    assert {(r.k, r.value) for r in sigma.aggregate(df, agg | {"condition": "s | count(n) by k >= 2"}).collect()} == {(0, 2), (1, 3)}
    assert {(r.k, r.value) for r in sigma.aggregate(df, agg | {"condition": "s | count() by k > 2"}).collect()} == {(1, 3)}
    with pytest.raises(ValueError):
        sigma.timeframe("soon")


def test_graph_rules():
    from lineagram.operators.ruleset import build

    rule = RULE | {"logsource": {"product": "windows", "category": "process_creation"}, "tags": ["attack.privilege-escalation", "attack.t1"]}
    got = sigma.to_graph_rule(rule)
    assert got["match_logic"]["relation"] == "EXECUTE" and got["match_logic"]["object"]["type"] == "Process" and got["apt_stage"] == "Privilege Escalation"
    assert "User" not in got["match_logic"]["object"]["attributes"] and got["prerequisites"]["predicates"][0]["source_stage"] == "Internal Recon"
    assert sigma.check_graph_rule(got) == []
    broken = {"match_logic": {"relation": "SPAWN", "subject": {"type": "File", "attributes": {"CommandLine": "x y z"}}, "object": {"type": "File", "attributes": {}}, "entity_bindings": {"a": "$x"}}, "prerequisites": {"operator": "AND", "predicates": [{"type": "stage_path", "target_node": "$y"}]}}
    assert sigma.check_graph_rule(broken) == ["what is spawned is a process", "fields of processes at a subject that is none: CommandLine", "unbound variable '$y'"]
    run = sigma.to_runtime({**got, "match_logic": {"relation": "READ", "subject": {"attributes": {"a": "*mid*", "b": "x*y"}}, "object": {"attributes": {"c": "*.exe", "d|contains": ["p", "q"]}}}}, "R1")
    items = {i["field"]: (i["modifiers"], i["value"]) for s in run["match_logic"]["selectors"].values() for i in s["items"]}
    assert items["a"] == (["contains"], {"type": "literal", "value": "mid"}) and items["c"][0] == ["endswith"] and items["b"][0] == ["regex"] and items["b"][1]["value"] == "^x.*y$"
    assert items["d"][0] == ["contains"] and items["cdr.semantic_relations{}.relation"][1]["value"] == "read"
    assert build(run, as_json=True).prerequisite_ast["operator"] == "AND"
    good, bad = sigma.translated([rule, {"id": "z", "detection": {"s": {"x": "a"}, "condition": "s"}}])
    assert len(good) == 1 and "too broad" in bad["z"]
    assert sigma.bundle(good)["rules"][0]["rule_id"] == "SIGMA_000001"
    assert sigma.report([RULE, RULE])["problems"]["x1"] == ["several rules have this id"] and sigma.stage_of("Defense Evasion") == 4 and sigma.stage_of("?") == 1


def test_synthetic_stream_and_best_alerts(spark):
    a = e.synthetic_events(spark, 2000, 50, 3)
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, e.synthetic_events(spark, 2000, 50, 3).repartition(5).collect()))
    attacks = a.where("op != 'read'").count()
    assert 10 < attacks < 100 and e.synthetic_events(spark, 2000, 50, 4).exceptAll(a).count() > 0
    alerts = spark.createDataFrame([("a", "s", 5.0, ["x"]), ("b", "s", 5.0, ["x", "y"]), ("c", "s", 4.0, []), ("d", "", 1.0, []), ("f", None, 1.0, [])], "alert_id string, scenario_id string, score double, stages array<string>")
    assert sorted(r.alert_id for r in e.best_by_scenario(alerts).collect()) == ["b", "d", "f"]
