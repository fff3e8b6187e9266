import json

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from lineagram.operators import graph, hsg, links
from lineagram.operators.rules import DEMO_RULES
from lineagram.sources import follow, logs, sinks
from lineagram.streaming import engine


def rows(n=60):
    ops = [("write", "file:/tmp/{}"), ("connect", "ip:10.0.3.{}"), ("modify", "reg:k{}"), ("fork", "proc:c{}"), ("read", "file:/tmp/{}")]
    return [{"seq": i, "ts": f"2024-01-{1 + i // 24:02d}T{i % 24:02d}:00:00Z", "host": f"h{i % 2}", "subject": f"proc:{i % 3}", "op": ops[i % 5][0], "object": ops[i % 5][1].format(i % 4), "bytes": i * 10} for i in range(n)]


def test_engine_in_batches(spark, tmp_path):
    (tmp_path / "in").mkdir()
    seen = []
    e = engine.Engine(spark, str(tmp_path / "state"), DEMO_RULES, engine.Options(threshold=20.0, gc_every=0), [lambda name, df: seen.append(name)])
    stream = lambda: spark.readStream.schema(logs.EVENT).json(str(tmp_path / "in"))
    for k, part in enumerate((rows()[:30], rows()[30:])):
        (tmp_path / "in" / f"{k}.json").write_text("\n".join(map(json.dumps, part)))
        e.run(stream(), str(tmp_path / "ck"))
    whole = spark.read.schema(logs.EVENT).json(str(tmp_path / "in"))
    found = hsg.with_ids(engine.matches(whole, DEMO_RULES).join(engine.rule_table(spark, DEMO_RULES), "rule_id"))
    assert {r.match_id for r in e.table("matches").collect()} == {r.match_id for r in found.collect()}
    kept, paths = hsg.build(whole, found, DEMO_RULES)
    pick = lambda df: {(r.scenario, r.nodes, r.edges, r.weighted, r.paper_score) for r in df.collect()}
    want = hsg.legacy_scores(kept, DEMO_RULES, paths).join(hsg.paper_scores(kept, path_edges=paths), "scenario")
    assert pick(e.latest("scores")) == pick(want) and want.count() > 0
    assert e.table("alerts").count() >= hsg.alerts(kept, 20.0).count() > 0 and e.table("alerts").groupBy("scenario", "node").count().where("count > 1").count() == 0
    assert e.summary().first().events == 60 and {"events", "matches", "scores", "alerts"} <= set(seen)
    metrics = spark.read.json(str(tmp_path / "state/metrics")).collect()
    assert sum(r.events for r in metrics) == 60
    again = e.table("matches").count()
    e.process(whole.where("seq < 30"), 0)  # a batch that is run again replaces itself
    assert e.table("matches").count() == again
    assert e.protected().count() > 0 and e.pruned(most_nodes=10).count() > 0
    e.options.retention_days = 0.5
    assert e.collect_garbage() and e.table("events").count() == 30


def test_followed_files(spark, tmp_path):
    folder, out = tmp_path / "logs", str(tmp_path / "out")
    folder.mkdir()
    (folder / "a.jsonl").write_text('{"n": 1}\n{"n": 2}\n{"half": ')

    def run():
        q = follow.follow(spark, str(folder)).writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
        q.awaitTermination(120)
        return sorted(r.value for r in spark.read.schema(follow.SCHEMA).parquet(out).collect())

    assert run() == ['{"n": 1}', '{"n": 2}']
    with open(folder / "a.jsonl", "a") as f:
        f.write("3}\n\n")
    (folder / "b.jsonl").write_text("other\n")
    assert run() == ["other", '{"half": 3}', '{"n": 1}', '{"n": 2}']
    (folder / "a.jsonl").write_text("new\n")  # shorter than it was
    assert run() == ["new", "other", '{"half": 3}', '{"n": 1}', '{"n": 2}']
    assert [r.seq for r in follow.from_rows(spark, ["x", "", "y"]).collect()] == [1, 3]


def test_sinks(spark, tmp_path):
    ev = spark.createDataFrame([Row(**r) for r in rows(20)]).withColumn("ts", F.to_timestamp("ts"))
    found = hsg.with_ids(engine.matches(ev, DEMO_RULES).join(engine.rule_table(spark, DEMO_RULES), "rule_id"))
    edges = links.graph_path_edges(ev, found, DEMO_RULES)
    scores = spark.createDataFrame([(1, 2.0)], "scenario long, score double")
    sinks.snapshot(str(tmp_path / "s"), ev, found, edges, scores)
    got = spark.read.json(str(tmp_path / "s/summary")).first()
    assert (got.events, got.matches, got.scenarios, got.top_score) == (20, found.count(), 1, 2.0)
    assert "stage" in spark.read.json(str(tmp_path / "s/matches")).columns and "stage" not in sinks.match_rows(found, legacy=True).columns
    sinks.lines(scores, str(tmp_path / "a"), append=True)
    sinks.lines(scores, str(tmp_path / "a"), append=True)
    assert spark.read.json(str(tmp_path / "a")).count() == 2
    sinks.table_csv(spark.createDataFrame([(1, ["a", "b"])], "n int, x array<string>"), str(tmp_path / "c"))
    assert spark.read.option("header", True).csv(str(tmp_path / "c")).first().n == "1"
    ents = spark.createDataFrame([("h0", "proc:0"), ("h0", "file:/tmp/0")], "host string, entity string")
    nodes = sinks.provenance_nodes(ev, ents, ents.where("entity = 'none'"))
    parts = sinks.provenance_elements(graph.edges(ev), nodes)
    sinks.artifact(str(tmp_path / "art"), "scenario-1", sinks.scenario_graph(found, edges), parts)
    one = spark.read.json(str(tmp_path / "art/scenario-1")).first()
    assert one.scenario_id == "scenario-1" and len(one.hsg.nodes) == found.count() and {n.data.kind for n in one.provenance.nodes} == {"entity", "version_node"}
    inside = {(r.host, r.entity, r.version) for r in nodes.collect()}
    assert all((r.host, r.src, r.src_version) in inside and (r.host, r.dst, r.dst_version) in inside for r in sinks.induced(graph.edges(ev), nodes).collect())
    raw = spark.createDataFrame([(i, json.dumps({"ts": f"2024-01-0{i}"})) for i in range(1, 6)] + [(9, "{bad")], "seq long, value string")
    assert [r.seq for r in sinks.sample(raw, 2, "2024-01-02", "2024-01-04").collect()] == [2, 3]
    with pytest.raises(Exception, match="kafka"):
        follow.kafka(spark, "x:1", "t")


def test_raw_lines_of_two_dialects(spark, tmp_path):
    lines = [
        {"host": "h", "op": "write", "subject": "proc:a", "object": "file:/tmp/x", "ts": "2024-01-01T00:00:00Z"},
        {"hostname": "g", "syscall": "connect", "pid": 3, "addr": "10.0.3.1", "ts": "2024-01-01T00:00:01Z"},
        {"host": "h", "op": "write", "subject": "proc:chrome", "object": "file:/tmp/benign", "ts": "2024-01-01T00:00:02Z"},
    ]
    e = engine.Engine(spark, str(tmp_path / "state"), DEMO_RULES, engine.Options(gc_every=0))
    e.process_lines(follow.from_rows(spark, [json.dumps(x) for x in lines]), 0, (["benign"], ["evil"]))
    assert {(r.host, r.rule_id, r.subject) for r in e.table("matches").collect()} == {("h", "tmp_write", "proc:a"), ("g", "odd_subnet", "proc_pid:3@2024-01-01T00:00:01Z")}
