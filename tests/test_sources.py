import json

from pyspark.sql import Row

from lineagram.operators.rules import DEMO_RULES
from lineagram.sources import logs
from lineagram.streaming import job


def test_normalize(spark, tmp_path):
    lines = [{"seq": 1, "id": "a", "timestamp": "1700000000", "op": "write", "subject": "proc:1", "object": "file:/x", "sent_bytes": "3", "recv_bytes": 4}, {"seq": 2}]
    (tmp_path / "a.jsonl").write_text("\n".join(map(json.dumps, lines)) + "\n\n{broken\n")
    got = {r.seq: r for r in logs.normalize(logs.raw_lines(spark, str(tmp_path))).collect()}
    assert set(got) == {1, 2}
    assert (got[1].event_id, got[1].event_type, got[1].bytes) == ("a", "write", 7)
    assert (got[2].event_id, got[2].event_type, got[2].bytes) == ("evt-2", "unknown", None)


def test_prefilter(spark):
    df = spark.createDataFrame([Row(value=v) for v in ("Chrome update", "chrome MIMIKATZ", "else", '{"datum": {}} chrome')])
    assert [r.value for r in logs.prefilter(df, ["chrome"], ["mimikatz"]).collect()] == ["chrome MIMIKATZ", "else", '{"datum": {}} chrome']


def test_as_of_without_keys(spark):
    ev = spark.createDataFrame([(i, None) for i in range(5)], "seq long, uuid string")
    defs = spark.createDataFrame([(0, "u", "one")], "seq long, uuid string, name string")
    assert [r.name for r in logs.as_of(ev, defs, "uuid", "name").collect()] == [None] * 5


def test_as_of(spark):
    ev = spark.createDataFrame([(1, "u"), (5, "u"), (9, "u"), (9, "v")], "seq long, uuid string")
    defs = spark.createDataFrame([(2, "u", "one"), (9, "u", "two")], "seq long, uuid string, name string")
    assert {tuple(r) for r in logs.as_of(ev, defs, "uuid", "name").collect()} == {(1, "u", None), (5, "u", "one"), (9, "u", "two"), (9, "v", None)}


def test_stream_equals_batch(spark, tmp_path):
    rows = [{"seq": i, "ts": f"2024-01-01T{i % 24:02d}:00:00Z", "host": "h", "subject": "proc:a", "op": "write" if i % 2 else "read", "object": f"file:/tmp/{i % 3}", "bytes": i} for i in range(40)]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text("\n".join(map(json.dumps, rows[:25])))
    stream = job.detect(job.read_events(spark, str(tmp_path / "in")), DEMO_RULES)
    job.run_available(stream, str(tmp_path / "out"), str(tmp_path / "ck"))
    (tmp_path / "in" / "b.json").write_text("\n".join(map(json.dumps, rows[25:])))
    job.run_available(job.detect(job.read_events(spark, str(tmp_path / "in")), DEMO_RULES), str(tmp_path / "out"), str(tmp_path / "ck"))
    batch = job.detect(spark.read.schema(logs.EVENT).json(str(tmp_path / "in")), DEMO_RULES)
    pick = lambda df: sorted((r.seq, r.rule_id) for r in df.collect())
    assert pick(spark.read.parquet(str(tmp_path / "out"))) == pick(batch) and batch.count() > 0
