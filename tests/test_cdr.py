import json

from pyspark.sql import Row

from lineagram.functions import scalars as fn
from lineagram.sources import cdr


def events(spark, records):
    lines = spark.createDataFrame([Row(seq=i, value=json.dumps(r) if not isinstance(r, str) else r) for i, r in enumerate(records, 1)])
    return {r.seq: r for r in cdr.to_events(lines).collect()}


def said(row):
    return [(x.relation, x.src, x.dst) for x in row.relations]


def test_windows(spark):
    made = {"event_type": "process_creation", "ts": "2025-01-01T00:00:00Z", "logsource": {"product": "windows"}}
    got = events(spark, [
        made | {"ProcessGuid": "c", "ParentProcessGuid": "p", "IntegrityLevel": "S-1 High Label", "TokenElevation": "1", "Image": "C:\\x\\a.exe"},
        made | {"ProcessId": 300, "ParentProcessId": 200},
        {"Image": "a", "event_type": "image_load", "ProcessGuid": "c", "ImageLoaded": "C:\\x.dll"},
        {"Image": "a", "event_type": "network_connect", "ProcessGuid": "c", "DestinationIp": "1.2.3.4"},
        {"Image": "a", "EventType": "remote_thread", "SourceProcessGuid": "c", "TargetProcessGuid": "t"},
    ])
    assert (got[1].subject, got[1].object, said(got[1])) == ("proc_guid:p", "proc_guid:c", [("execute", "proc_guid:p", "proc_guid:c"), ("spawn", "proc_guid:p", "proc_guid:c")])
    assert (got[1].integrity, got[1].elevated, got[1].dialect, got[1].source_type) == ("high", True, "etw", "windows/etw")
    assert got[2].subject == "proc_pid:200@2025-01-01T00:00:00Z" and got[2].object == "proc_pid:300@2025-01-01T00:00:00Z"
    assert said(got[3]) == [("read", "proc_guid:c", "file:C:\\x.dll")] and said(got[4]) == [("connect", "proc_guid:c", "ip:1.2.3.4")]
    assert said(got[5]) == [("inject", "proc_guid:c", "proc_guid:t")] and got[5].event_type == "remote_thread"


def test_linux(spark):
    base = {"pid": 4242, "ts": "2025-01-01T00:00:00Z", "logsource": {"product": "linux", "service": "auditd"}}
    got = events(spark, [
        base | {"syscall": "mprotect", "addr": "0x1000", "prot": "PROT_READ|PROT_EXEC", "euid": 0},
        base | {"syscall": "mprotect", "addr": "0x1000", "prot": "PROT_READ"},
        base | {"syscall": "openat", "path": "/tmp/test.txt"},
        base | {"syscall": "execve", "path": "/bin/sh"},
        base | {"syscall": "clone", "child_pid": 5},
        base | {"syscall": "connect", "addr": "10.0.0.1"},
        base | {"syscall": "nothing", "name": "x"},
    ])
    me = "proc_pid:4242@2025-01-01T00:00:00Z"
    assert said(got[1]) == [("protect_memory_exec", me, "mem:4242:0x1000:0")] and got[1].euid == 0 and got[1].event_type == "mprotect"
    assert said(got[2]) == [] and got[2].object == "mem:4242:0x1000:0"
    assert said(got[3]) == [("read", me, "file:/tmp/test.txt")] and said(got[4]) == [("execute", me, "file:/bin/sh")]
    assert said(got[5]) == [("spawn", me, "proc_pid:5@2025-01-01T00:00:00Z")] and said(got[6]) == [("connect", me, "ip:10.0.0.1")]
    assert said(got[7]) == [] and got[7].object == "file:x"
    assert set(got[1].source_tokens) == {"linux", "auditd", "linux/auditd"}


def test_generic(spark):
    got = events(spark, [
        {"op": "fork", "subject": "proc:a", "object": "proc:b"},
        {"event_type": "exec", "subject": "proc:a", "object": "proc:b"},
        {"type": "proc_to_registry", "subject": "proc:a", "object": "reg:HKCU"},
        {"op": "write", "subject": "proc:a", "object": "ip:1.1.1.1"},
        {"op": "Thread_Inject", "subject": "proc:a", "object": "proc:b"},
        {"op": "write", "subject": "proc:a", "object": "file:x", "semantic_relations": [{"relation": "Spawned_By", "src": "x", "dst": "y"}, {"relation": "z"}]},
        "{broken",
        {"subject": "proc:a", "bytes": "12.9", "len": 4, "object_state_change": 2},
    ])
    assert said(got[1]) == [("spawn", "proc:a", "proc:b"), ("execute", "proc:a", "proc:b")] and said(got[2]) == [("execute", "proc:b", "proc:a")]
    assert said(got[3]) == [("write", "proc:a", "reg:HKCU")] and said(got[4]) == [("connect", "proc:a", "ip:1.1.1.1")] and said(got[5]) == [("inject", "proc:a", "proc:b")]
    assert said(got[6]) == [("spawn", "x", "y")] and 7 not in got
    assert (got[8].event_id, got[8].event_type, got[8].bytes, got[8].object_state_change, got[8].object) == ("evt-8", "unknown", 12, True, None)


def test_darpa(spark):
    ns = "com.bbn.tc.schema.avro.cdm18."
    got = events(spark, [
        {"hostId": "h", "event_id": "e", "eventType": "EVENT_EXECVE", "subject": {"type": "Subject", "uuid": "proc-1"}, "predicateObjectPath": "/bin/bash", "timestampNanos": 1700000000000000000},
        {"datum": {ns + "Event": {"uuid": "e2", "type": "EVENT_WRITE", "subject": {ns + "UUID": "S1"}, "predicateObject": {ns + "UUID": "F1"}}}},
        {"datum": {ns + "Subject": {"uuid": "S1", "cmdLine": {"string": "/bin/sh -c x"}}}},
        {"datum": {ns + "FileObject": {"uuid": "F1", "baseObject": {"properties": {"map": {"path": "/etc/passwd"}}}}}},
        {"datum": {ns + "NetFlowObject": {"uuid": "N1", "remoteAddress": "9.9.9.9"}}},
        {"datum": {ns + "Event": {"uuid": "e3", "type": "EVENT_READ", "subject": {ns + "UUID": "S1"}, "predicateObject": {ns + "UUID": "F1"}}}, "source": "ta1-trace"},
        {"datum": {ns + "Event": {"uuid": "e4", "type": "EVENT_CONNECT", "subject": {ns + "UUID": "S1"}, "predicateObject": {ns + "UUID": "N1"}}}},
        {"hostId": "h", "eventType": "EVENT_ODD", "subject": "S9", "predicateObject": {"type": "file", "path": {"string": "/x"}}},
    ])
    assert said(got[1]) == [("execute", "proc_guid:proc-1", "file:/bin/bash")] and got[1].event_type == "event_execve" and str(got[1].ts).startswith("2023-11-14")
    assert said(got[2]) == [("write", "proc_guid:S1", "entity:F1")]  # used before it is defined
    assert said(got[6]) == [("read", "proc_guid:S1", "file:/etc/passwd")] and got[6].source_type == "darpa/tc/trace" and got[6].event_id == "e3"
    assert said(got[7]) == [("connect", "proc_guid:S1", "ip:9.9.9.9")] and got[7].command_line == "/bin/sh -c x" and got[7].image == "/bin/sh"
    assert said(got[8]) == [("write", "proc_guid:S9", "file:/x")]


def test_field_paths_and_shapes(spark):
    row = Row(value='{"a": {"b": ["x", {"c": 3}]}, "l": [{"n": "p"}, {"n": "q\\"r"}]}', ip="2001:DB8:0:0:1::5", v4="10.1.2.3:443", odd="::1::2", q='"C:\\Program Files\\A.EXE"')
    df = spark.createDataFrame([row])
    F = fn.F
    got = df.select(
        fn.field_values(F.col("value"), "a.b").alias("ab"), fn.field_values(F.col("value"), "l{}.n").alias("ln"), fn.field_values(F.col("value"), "none").alias("no"),
        fn.ip_shape(F.col("ip")).alias("ip6"), fn.ip_shape(F.col("v4")).alias("ip4"), fn.ip_shape(F.col("odd")).alias("odd"), fn.basename(F.col("q")).alias("base"),
        fn.process_name([F.lit(None).cast("string")], [F.lit("  /usr/bin/Curl -s x")], [F.lit("z")]).alias("proc"), fn.cvss(F.lit("High")).alias("cvss"), fn.truthy(F.lit("2")).alias("two"),
    ).first()
    assert (got.ab, got.ln, got.no) == (["x", "3"], ["p", 'q"r'], [])
    assert (got.ip6, got.ip4, got.odd) == ("subnet=2001:db8::/64", "subnet=10.1.2.0/24", "subnet=invalid")
    assert (got.base, got.proc, got.cvss, got.two) == ("a.exe", "curl", 8.0, True)


def test_ip6_nets_equal_the_library(spark):
    import ipaddress

    addresses = ["::", "::1", "fe80::1", "2001:db8:1:2:3:4:5:6", "1:0:0:4::", "0:1::", "a::b", "1:2:3::", "1::2:3:4:5:6:7", "ff02::1:ff00:0", "1:2", "g::", "1:2:3:4:5:6:7:8:9", "12345::", ":::"]
    got = spark.createDataFrame([(a,) for a in addresses], "a string").select("a", fn.ip_shape(fn.F.col("a")).alias("s")).collect()
    for r in got:
        try:
            want = "subnet=" + str(ipaddress.ip_network(r.a + "/64", strict=False))
        except ValueError:
            want = "subnet=invalid"
        assert r.s == want, (r.a, r.s, want)


def test_adapters_can_be_added(spark):
    cdr.register("mine", lambda: cdr.has("my_kind"), lambda: {"subject": cdr.field("who"), "object": cdr.field("what"), "relations": cdr.relations(cdr.relation("write", fn.F.col("subject"), fn.F.col("object"))), "event_type": cdr.field("my_kind")})
    try:
        got = events(spark, [{"my_kind": "k", "who": "proc:a", "what": "file:b", "syscall": "read"}, {"syscall": "openat", "path": "x"}])
        assert (got[1].dialect, said(got[1]), got[1].event_type) == ("mine", [("write", "proc:a", "file:b")], "k") and got[2].dialect == "auditd"
    finally:
        cdr.unregister("mine")


def test_raw_lookup_and_counts(spark):
    from lineagram.operators import rules
    from lineagram.sources import logs

    lines = [{"Image": "C:\\a.exe", "cdr": {"semantic_relations": [{"relation": "write"}, {"relation": "read"}]}}, {"image": "b"}]
    df = spark.createDataFrame([Row(seq=i, host="h", subject="proc:a", op="x", object="file:b", raw=json.dumps(x)) for i, x in enumerate(lines)])
    item = lambda f, v, *m: {"type": "field_match", "field": f, "modifiers": list(m), "value": v}
    made = [rules.Rule(n, match_logic={"selectors": {"s": {"type": "object", "items": [i]}}, "condition": {"type": "selector_ref", "selector": "s"}}) for n, i in (("path", item("cdr.semantic_relations{}.relation", "read")), ("case", item("IMAGE", "a.exe", "endswith")), ("exact", item("image", "b")))]
    assert {(r.seq, r.rule_id) for r in rules.matches(df, made, rules.raw_lookup()).collect()} == {(0, "path"), (0, "case"), (1, "exact")}
    raw = spark.createDataFrame([("{}",), ("",), ("{x",), ("[1]",)], "value string")
    assert tuple(logs.parse_counts(raw).first()) == (4, 1, 2, 1) and logs.record_count(raw) == 4
    assert logs.strict(raw.limit(1), "a int").count() == 1
    import pytest

    with pytest.raises(Exception, match="(?i)malformed|parse"):
        logs.strict(raw.where("value = '{x'"), "a int").collect()
