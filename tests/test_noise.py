import json

from pyspark.sql import Row
from pyspark.sql import functions as F

from lineagram.operators import graph, noise
from lineagram.operators.ruleset import NoiseConfig

REL = "array<struct<relation:string,src:string,dst:string>>"


def found(spark, rows):
    return spark.createDataFrame([Row(host="h", seq=i, node=i, match_id=f"m{i}", rule_id=r, subject=s, object=o, bytes=b, op="write") for i, (r, s, o, b) in enumerate(rows)], "host string, seq long, node long, match_id string, rule_id string, subject string, object string, bytes long, op string")


def test_limits_and_filter(spark):
    learn = found(spark, [("r", "proc:a", "file:x", 10), ("r", "proc:a", "file:x", 30), ("r", "proc:a", "file:y", 4), ("q", "proc:a", "file:x", 0), ("q", None, "file:x", 9), ("s", "proc:b", "file:x", 1)])
    limits = {(r.rule_id, r.subject, r.object): (r.samples, r.largest, r.threshold) for r in noise.dynamic_thresholds(learn).collect()}
    assert limits == {("r", "proc:a", "file:x"): (2, 40, 50), ("r", "proc:a", "file:y"): (1, 4, 5), ("r", None, None): (3, 44, 55), ("s", "proc:b", "file:x"): (1, 1, 2), ("s", None, None): (1, 1, 2)}
    assert noise.dynamic_thresholds(learn, min_samples=3).count() == 1
    seen = found(spark, [("r", "proc:a", "file:x", 45), ("r", "proc:a", "file:x", 5), ("r", "proc:a", "file:x", 1), ("r", "proc:z", "file:x", 50), ("r", "proc:y", "file:x", 6), ("u", "proc:a", "file:x", 1), ("r", "proc:a", "file:x", None), ("r", "proc:a", "file:x", 0)])
    got = {r.seq: r.dropped for r in noise.dynamic_filter(seen, noise.dynamic_thresholds(learn)).collect()}
    assert got == {0: True, 1: True, 2: False, 3: True, 4: False, 5: False, 6: False, 7: False}


def test_profile_and_bypass(spark):
    def event(i, image, relations):
        return (i, "h", relations, image, None)

    a, b = ("write", "proc_guid:1", "file:x"), ("read", "proc_guid:1", " file:y ")
    rows = [event(0, "C:\\Chrome.exe", [a]), event(1, "/opt/chrome.exe", [a, b]), event(2, None, [a]), event(3, "x", [("write", "uuid:1", "file:x")]), event(4, "x", [])]
    ev = spark.createDataFrame(rows, f"seq long, host string, relations {REL}, image string, target_image string")
    known = noise.relation_profile(ev, 2)
    assert [(r.subject, r.relation, r.object, r.n) for r in known.collect()] == [("process_image:chrome.exe", "write", "file:x", 2)]
    assert {r.seq for r in noise.benign_events(ev, known).collect()} == {0}
    m = spark.createDataFrame([("h", 0, "r", False), ("h", 0, "s", True), ("h", 1, "r", False)], "host string, seq long, rule_id string, bypass boolean")
    kept, gone = noise.drop_benign_events(m, noise.benign_events(ev, known))
    assert {(r.seq, r.rule_id) for r in kept.collect()} == {(0, "s"), (1, "r")} and [(r.rule_id, r.reason) for r in gone.collect()] == [("r", "benign_profile_drop")]
    key = known.select(noise.pattern_key("subject", "relation", "object").alias("k")).first().k
    assert key == json.dumps({"object": "file:x", "relation": "write", "subject": "process_image:chrome.exe"}, separators=(",", ":"))


def test_apply_and_counts(spark, tmp_path):
    m = found(spark, [("r", "proc:a", "file:x", 10), ("r", "proc:a", "file:x", 1000), ("drop", "proc:a", "file:x", 10), ("q", "proc:b", "file:z", 5)])
    edges = spark.createDataFrame([(1, 3, "graph_path", 0.5, 2.0), (1, 3, "shared_entity", None, None), (0, 1, "graph_path", 1.0, 1.0), (1, 2, "shared_entity", None, None)], "src_node long, dst_node long, relation string, weight double, path_factor double")
    config = NoiseConfig(frozenset({"drop"}), frozenset({"m0"}), frozenset(), 0.4, 2.0, "le")
    kept, left = noise.apply(m, edges, config)
    assert {r.match_id for r in kept.collect()} == {"m1", "m3"} and {(r.src_node, r.relation) for r in left.collect()} == {(1, "graph_path"), (1, "shared_entity")}
    assert noise.filter_edges(edges, NoiseConfig(drop_links=frozenset({"shared_entity"}), path_factor_op="ge")).count() == 2
    n = {r.what: (r.before, r.after, r.dropped) for r in noise.counts((m, edges), (kept, left)).collect()}
    assert n == {"matches": (4, 2, 2), "edges": (4, 2, 2)}
    models = noise.train(m, min_samples=1)
    noise.save(models, str(tmp_path / "m"))
    back = noise.load(spark, str(tmp_path / "m"))
    assert sorted(map(tuple, back["limits"].collect()), key=str) == sorted(map(tuple, models["limits"].collect()), key=str)
    spark.createDataFrame([("r", 5)], "rule_id string, threshold long").write.parquet(str(tmp_path / "old" / "volumes"))
    assert noise.load(spark, str(tmp_path / "old"), ("volumes",))["volumes"].first().p95 == 5.0
    multi = spark.createDataFrame([("h", 1, [0, 1]), ("h", 2, [2]), ("h", 3, [9])], "host string, node long, seqs array<long>")
    assert {r.node: r.bytes for r in noise.match_bytes(multi, m.withColumn("bytes", F.when(F.col("seq") != 2, F.col("bytes")))).collect()} == {1: 1010, 2: None, 3: None}


def test_prunable_equals_plain_rules(spark):
    import random

    rng = random.Random(3)
    rows = [Row(host="h", seq=i, t=i * 10, subject=rng.choice(["proc:a", "proc:b"]), op=rng.choice(["read", "write"]), object=rng.choice(["file:x", "file:y", "file:z"])) for i in range(30)]
    df = spark.createDataFrame(rows).withColumn("ts", F.timestamp_seconds("t"))
    made = {(r.entity, r.version): r.created_seq for r in graph.nodes(df).collect()}
    edges = [(r.src, r.src_version, r.dst, r.dst_version) for r in graph.edges(df).collect()]
    seen = {}
    for r in graph.versions(df).collect():
        for v in {r.before, r.after}:
            seen[r.entity, v] = max(seen.get((r.entity, v), 0), r.seq * 10)
    last = {e: max(v for f, v in made if f == e) for e, _ in made}
    keep = spark.createDataFrame([("h", "file:x")], "host string, entity string")
    for cap_n, cap_e, low in ((0, 0, 1.0), (20, 0, 0.5), (0, 15, 1.0)):
        stays = {("file:x", last["file:x"])}
        gone = {n for n in made if seen[n] <= max(seen.values()) - 200 and n not in stays}
        touch = {n: sum(n in ((a, b), (c, d)) for a, b, c, d in edges) for n in made}
        tn = max(1, -(-int(cap_n * low * 1000) // 1000)) if cap_n and len(made) > cap_n else cap_n
        te = cap_e
        n, e = len(made) - len(gone), len(edges) - sum(touch[x] for x in gone)
        for x in sorted((x for x in made if x not in stays), key=lambda x: (seen[x], *x)):
            if (not cap_n and not cap_e) or ((not cap_n or n <= tn) and (not cap_e or e <= te)):
                break
            if x not in gone:
                gone.add(x)
                n, e = n - 1, e - touch[x]
        got = graph.prunable(df, 200, keep, cap_n, cap_e, low)
        assert {(r.entity, r.version) for r in got.collect()} == gone, (cap_n, cap_e)
        left = graph.without(graph.edges(df), got)
        assert left.count() == sum((a, b) not in gone and (c, d) not in gone for a, b, c, d in edges)
    assert {r.change for r in graph.delta(df.where("seq < 20").select("seq"), df.where("seq > 5").select("seq")).collect()} == {"added", "removed"}
    assert graph.adjacency(df).count() == len({(a, c) for a, _, c, _ in edges if a != c})
