"""One model for raw audit records: four dialects as column expressions over a record that is parsed once.

A record goes to the first dialect that fits: DARPA, auditd, ETW, generic.  Each
gives subject, object and semantic relations (relation, src, dst).  DARPA events
name entities by uuid; their definitions are joined as of the event's place in the
total order, so a definition has to come before its use.

Null and broken records are dropped before (see logs.normalize); a field that is
missing, empty or of another type counts as absent.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lineagram.functions.scalars import BYTE_FIELDS, canonical_relation, entity, extract_bytes, first_text, normalize_text, parse_ts, truthy
from lineagram.session import cut
from lineagram.sources.logs import as_of

# Field names, calls and event types that inputs use.
TS = ("ts", "timestamp", "UtcTime", "EventTime")
READ_CALLS = ("open", "openat", "read", "pread64")
WRITE_CALLS = ("write", "writev", "pwrite64", "rename", "renameat", "unlink", "unlinkat", "truncate")
EXEC_CALLS, SPAWN_CALLS = ("execve", "execveat"), ("clone", "fork", "vfork")
MAP_CALLS, PROTECT_CALLS = ("mmap", "mmap2"), ("mprotect",)
PROTECTION_FIELDS = ("prot", "protection", "flags", "a2", "a3", "argv", "args")
DARPA_RELATIONS = {
    "event_execve": "execute", "execve": "execute", "event_clone": "spawn", "event_fork": "spawn", "clone": "spawn", "fork": "spawn", "event_open": "read", "event_read": "read", "read": "read",
    "event_write": "write", "write": "write", "event_connect": "connect", "connect": "connect", "event_sendmsg": "write", "event_recvmsg": "read", "event_execute": "execute", "event_accept": "accept", "accept": "accept",
    "event_mmap": "make_mem_exec", "event_mprotect": "protect_memory_exec", "event_sendto": "write", "event_recvfrom": "read",
}
TA1 = ("trace", "theia", "fivedirections", "cadets", "clearscope")
UNION_ARMS = ("string", "int", "long", "float", "double", "boolean", "bytes", "map", "array")

RELATIONS = "array<struct<relation:string,src:string,dst:string>>"
FIELDS = "map<string,string>"


def parsed(lines: DataFrame) -> DataFrame:
    """Adds ``r``, the record's fields as text by name (objects and lists as JSON)."""
    return lines.withColumn("r", F.from_json("value", FIELDS))


def get(name: str) -> Column:
    return F.try_element_at("r", F.lit(name))


def field(*names: str) -> Column:
    return first_text(*[get(n) for n in names])


def has(*names: str) -> Column:
    return reduce(lambda a, b: a | b, [get(n).isNotNull() for n in names])


def logsource(name: str) -> Column:
    return normalize_text(F.get_json_object(get("logsource"), f"$.{name}"))


def _no(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def unwrap(c: Column) -> Column:
    """A text, or the inner value of a one-key union such as {"string": ..}; each step looks at the text once."""
    named, arms = r'com\.bbn\.tc\.schema\.avro[^"]*', "|".join(UNION_ARMS)
    c = F.regexp_replace(c, rf'^\{{"{named}":(\{{.*\}})\}}$', "$1")
    c = F.regexp_replace(c, rf'^\{{"(?:{arms}|{named})":"((?:[^"\\]|\\.)*)"\}}$', "$1")
    return F.regexp_replace(c, rf'^\{{"(?:{arms}|{named})":([^"].*)\}}$', "$1")


def lookup(table: dict[str, str], c: Column) -> Column:
    """The table's value for a text; null if it has none."""
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), c)


def dialect() -> Column:
    """Which adapter a parsed record goes to; the first that fits."""
    darpa = logsource("dataset").isin("darpa_tc", "darpa_tc_e3", "darpa") | F.contains(F.lower("value"), F.lit("com.bbn.tc.schema.avro")) | has("hostId", "subject_uuid", "predicateObjectUuid", "datum")
    auditd = (logsource("product") == "linux") | (logsource("service") == "auditd") | has("syscall", "exe", "comm", "auditd")
    etw = (logsource("product") == "windows") | logsource("service").isin("sysmon", "etw") | has("Image", "ParentImage", "TargetFilename", "DestinationIp", "SourceProcessGuid")
    own = reduce(lambda acc, kv: acc.when(_no(kv[1]()), kv[0]), ADDED.items(), F.when(F.lit(False), F.lit("")))
    return own.when(_no(darpa), "darpa").when(_no(auditd), "auditd").when(_no(etw), "etw").otherwise("generic")


def process(guids: tuple[str, ...], pids: tuple[str, ...], ts: tuple[str, ...] = TS) -> Column:
    """proc_guid by a guid, else proc_pid by pid and time, else null."""
    pid = field(*pids)
    return F.coalesce(F.concat(F.lit("proc_guid:"), field(*guids)), F.concat(F.lit("proc_pid:"), pid, F.lit("@"), F.coalesce(field(*ts), F.lit("no-ts"))))


def relation(name: Column | str, src: Column, dst: Column) -> Column:
    """One relation, or null if an end is missing."""
    said = canonical_relation(F.lit(name) if isinstance(name, str) else name)
    return F.when(src.isNotNull() & dst.isNotNull() & (said != ""), F.struct(said.alias("relation"), src.alias("src"), dst.alias("dst")))


def relations(*found: Column) -> Column:
    return F.array_compact(F.array(*found)).cast(RELATIONS)


def generic_relations(op: Column, subject: Column, object_: Column) -> Column:
    """Relations by operation and entity prefixes; several rules may hold."""
    s, o = F.lower(F.substring_index(subject, ":", 1)), F.lower(F.substring_index(object_, ":", 1))
    rule = lambda when, name, a=subject, b=object_: F.when(_no(when), relation(name, a, b))
    forked = op.isin("proc_to_proc", "fork") & (s == "proc") & (o == "proc")
    return relations(
        rule(forked, "spawn"),
        rule(forked, "execute"),
        rule(op.isin("file_to_proc", "exec", "execute") & (o == "proc"), "execute", object_, subject),
        rule(op.isin("proc_to_file", "write", "modify") & (s == "proc") & (o == "file"), "write"),
        rule((op == "read") & (s == "proc") & (o == "file"), "read"),
        rule((op == "proc_to_registry") | ((s == "proc") & (o == "reg")), "write"),
        rule(op.isin("proc_to_ip", "file_to_ip", "connect", "send", "network_flow") | (o == "ip"), "connect"),
        rule((op == "dns_query") | (o == "dns"), "resolve"),
        rule(op.isin("web_request", "http_request", "proxy") | (o == "web"), "request"),
        rule(op.isin("cloud_api", "cloudtrail"), "invoke"),
        rule(F.contains(op, F.lit("inject")), "inject"),
    )


def _generic() -> dict[str, Column]:
    subject, object_ = get("subject"), get("object")
    given = F.filter(F.from_json(get("semantic_relations"), RELATIONS), lambda x: x["relation"].isNotNull() & x["src"].isNotNull() & x["dst"].isNotNull())
    said = F.transform(given, lambda x: F.struct(canonical_relation(x["relation"]).alias("relation"), x["src"].alias("src"), x["dst"].alias("dst")))
    op = F.coalesce(F.nullif(normalize_text(get("op")), F.lit("")), normalize_text(field("event_type", "type")))
    return {"subject": subject, "object": object_, "relations": F.coalesce(said, generic_relations(op, F.col("subject"), F.col("object"))), "event_type": field("event_type", "type"), "source_type": F.lower(F.trim(get("source_type")))}


def _auditd() -> dict[str, Column]:
    call = normalize_text(field("syscall", "event_type", "type"))
    subject = process(("process_guid",), ("pid",))
    child = process(("child_guid",), ("child_pid",), ("ts", "timestamp"))
    ip = entity("ip", field("addr", "remote_addr", "dest_ip", "saddr"))
    memory = F.concat_ws(":", F.lit("mem"), field("pid"), field("addr", "memory_addr", "vm_start", "start"), F.lit("0"))
    memory = F.when(field("addr", "memory_addr", "vm_start", "start").isNotNull(), memory)
    executable = F.contains(F.lower(F.concat_ws(" ", *[get(n) for n in PROTECTION_FIELDS])), F.lit("prot_exec"))
    object_ = (
        F.when(call.isin(*EXEC_CALLS), F.coalesce(child, entity("file", field("path", "exe"))))
        .when(call.isin(*SPAWN_CALLS), child).when(call.isin("connect", "accept", "accept4"), ip).when(call.isin(*MAP_CALLS, *PROTECT_CALLS), memory)
        .otherwise(entity("file", field("path", "name", "cwd")))
    )
    name = (
        F.when(call.isin(*EXEC_CALLS), "execute").when(call.isin(*SPAWN_CALLS), "spawn").when(call == "connect", "connect").when(call.isin("accept", "accept4"), "accept")
        .when(call.isin(*MAP_CALLS) & executable, "make_mem_exec").when(call.isin(*PROTECT_CALLS) & executable, "protect_memory_exec").when(call.isin(*READ_CALLS), "read").when(call.isin(*WRITE_CALLS), "write")
    )
    kind = F.coalesce(get("event_type"), F.nullif(call, F.lit("")), F.lit("auditd_event"))
    return {"subject": subject, "object": object_, "relations": relations(relation(name, F.col("subject"), F.col("object"))), "event_type": kind, "source_type": F.lit("linux/auditd"), "euid": F.trim(get("euid")).try_cast("int")}


def _etw() -> dict[str, Column]:
    kind = normalize_text(field("event_type", "type", "EventType"))
    own = process(("SourceProcessGuid", "ProcessGuid"), ("SourceProcessId", "ProcessId"))
    child = process(("ProcessGuid", "SourceProcessGuid"), ("ProcessId", "SourceProcessId"))
    created = kind.isin("process_creation", "createprocess", "sysmon_process_create")
    subject = F.when(created, F.coalesce(process(("ParentProcessGuid",), ("ParentProcessId",)), own)).otherwise(own)
    loaded, written = kind.isin("image_load", "module_load"), kind.isin("file_create", "file_write", "proc_to_file")
    net, injected = kind.isin("network_connect", "network_connection", "proc_to_ip"), kind.isin("remote_thread", "process_inject", "inject")
    object_ = (
        F.when(created, child).when(loaded, entity("file", field("ImageLoaded", "TargetFilename"))).when(net, entity("ip", field("DestinationIp", "DestIp", "RemoteAddress")))
        .when(injected, process(("TargetProcessGuid",), ("TargetProcessId",))).otherwise(entity("file", field("TargetFilename", "FileName")))
    )
    name = F.when(created, "execute").when(loaded, "read").when(written, "write").when(net, "connect").when(injected, "inject")
    level = normalize_text(field("IntegrityLevel", "MandatoryLabel", "ProcessIntegrityLevel"))
    known = reduce(lambda acc, x: acc.when(F.contains(level, F.lit(x)), x), ("system", "high", "medium", "low"), F.when(F.lit(False), F.lit("")))
    return {
        "subject": subject, "object": object_, "relations": relations(relation(name, F.col("subject"), F.col("object")), F.when(created, relation("spawn", F.col("subject"), F.col("object")))), "event_type": F.coalesce(get("event_type"), F.nullif(kind, F.lit(""))),
        "source_type": F.lit("windows/etw"), "integrity": known.otherwise(F.nullif(level, F.lit(""))), "elevated": F.coalesce(truthy(field("TokenElevation", "token_elevation")), F.lit(False)),
    }


def _record_entity(text: Column) -> Column:
    """Entity of an object record (JSON) or a plain text."""
    own = lambda *names: first_text(*[unwrap(F.get_json_object(text, f"$.{n}")) for n in names])
    kind = normalize_text(own("type", "objectType", "cdmType", "kind", "baseObjectType"))
    uuid, path, host = own("uuid", "UUID", "cid", "id", "subjectUuid", "predicateObjectUuid"), own("path", "predicateObjectPath", "name", "filename", "exe"), own("hostId", "hostname")
    memory = F.concat(F.lit("mem:"), own("pid", "processId", "tgid"), F.lit(":"), own("baseAddress", "address", "vm_start", "start"), F.lit(":0"))
    of_record = (
        F.when(kind.isin("subject", "process", "process_object"), entity("proc_guid", F.coalesce(uuid, path)))
        .when(kind.isin("file", "file_object"), entity("file", F.coalesce(path, uuid)))
        .when(kind.isin("netflow", "ip", "socket"), entity("ip", F.coalesce(own("remoteAddress", "address", "ip", "dst_ip", "src_ip"), uuid)))
        .when(kind.isin("memory", "memory_object") & memory.isNotNull(), memory)
        .when(host.isNotNull() & uuid.isNotNull(), F.concat(F.lit("entity:"), host, F.lit(":"), uuid))
        .otherwise(entity("entity", F.coalesce(uuid, path)))
    )
    plain = F.when(F.trim(text) == "", F.lit(None)).when(F.contains(text, F.lit(":")), F.trim(text)).otherwise(F.concat(F.lit("entity:"), F.trim(text)))
    return F.when(F.startswith(text, F.lit("{")), of_record).otherwise(plain)


def _inner(names: tuple[str, ...], *under: str) -> list[Column]:
    return [unwrap(F.get_json_object(get(under[0]), "$" + "".join(f".{u}" for u in (*under[1:], n)))) for n in names]


def darpa_payload(records: DataFrame) -> DataFrame:
    """DARPA records with their payload as ``r``, its namespace and the TA1 that made them."""
    datum = F.from_json(get("datum"), FIELDS)
    one = F.map_entries(datum)[0]
    inner = F.when(F.size(datum) == 1, one["value"])
    own = F.transform_values(F.from_json(F.coalesce(inner, F.col("value")), FIELDS), lambda k, v: unwrap(v))
    got = records.withColumns({"namespace": F.coalesce(F.lower(one["key"]), F.lit("")), "p": own})
    # what only the record around the payload says
    outer = F.map_filter("r", lambda k, v: k.isin("event_id", "event_type", "timestamp", "ts", "hostId", "logsource") & v.isNotNull() & ~F.map_contains_key("p", k))
    whole = F.when(F.col("namespace") != "", F.map_concat(outer, "p")).otherwise(F.col("p"))
    low = F.lower("value")
    ta1 = reduce(lambda acc, t: acc.when(F.contains(low, F.lit(t)), t), TA1, F.when(F.lit(False), F.lit(""))).otherwise("generic")
    return got.withColumns({"r": whole, "ta1": ta1}).drop("p")


def _command_line() -> Column:
    names = ("cmdLine", "commandLine", "command_line")
    listed = lambda c: F.array_join(F.filter(F.transform(F.from_json(c, "array<string>"), F.trim), lambda x: x != ""), " ")
    inner = [*_inner(names, "properties"), *[listed(c) for c in _inner(("args", "argv"), "properties")], *_inner((*names, "name"), "properties", "map")]
    return first_text(*inner, *[get(n) for n in names], *[listed(get(n)) for n in ("args", "argv")])


def _image() -> Column:
    return first_text(*[get(n) for n in ("path", "exe", "image", "program", "predicateObjectPath")], *_inner(("image", "exe", "path", "name"), "properties", "map"), *_inner(("path", "exe", "image", "name"), "predicateObject"))


def darpa_definitions(payload: DataFrame) -> DataFrame:
    """(kind, seq, uuid, known): what records say about subjects and objects; known has entity, image and command_line."""
    ns, uuid = F.col("namespace"), field("uuid")
    is_subject = F.contains(ns, F.lit("subject")) & ~F.contains(ns, F.lit("event"))
    base = lambda n: _inner((n,), "baseObject", "properties", "map")[0]
    path = first_text(get("path"), get("filename"), get("name"), base("path"))
    memory = F.concat(F.lit("mem:"), first_text(base("tgid"), get("tgid"), get("pid"), get("processId")), F.lit(":"), field("memoryAddress", "baseAddress", "address"), F.lit(":0"))
    of_object = F.when(F.contains(ns, F.lit("fileobject")), entity("file", path)).when(F.contains(ns, F.lit("netflowobject")), entity("ip", field("remoteAddress", "address", "ip"))).when(F.contains(ns, F.lit("memoryobject")), memory).when(F.contains(ns, F.lit("srcsinkobject")), entity("entity", uuid))
    line = F.when(is_subject, _command_line())
    image = F.when(is_subject, F.coalesce(_image(), F.try_element_at(F.split(line, r"\s+"), F.lit(1)))).when(F.contains(ns, F.lit("fileobject")), path)
    known = F.struct(F.when(is_subject, entity("proc_guid", uuid)).otherwise(of_object).alias("entity"), image.alias("image"), line.alias("command_line"))
    got = payload.select(F.when(is_subject, "subject").otherwise("object").alias("kind"), "seq", uuid.alias("uuid"), known.alias("known"))
    return got.where("uuid is not null and known.entity is not null")


def darpa(records: DataFrame) -> DataFrame:
    """The common model's columns for DARPA records (value, seq, r).

    Payloads and definitions are written down once: events read them, and so does each kind of definition."""
    payload = cut(darpa_payload(records))
    defined = cut(darpa_definitions(payload))
    subject_text = get("subject")
    subject_uuid = F.when(~F.startswith(subject_text, F.lit("{")), subject_text).otherwise(F.coalesce(*_inner(("uuid", "subjectUuid", "cid"), "subject")))
    subject_uuid = F.coalesce(subject_uuid, field("subject_uuid", "subjectUuid", "subjectId"))
    given = F.coalesce(*[F.when(~F.startswith(c, F.lit("{")), c) for c in (get("predicateObject"), get("predicateObject2"), get("object"))], field("predicateObjectUuid", "object_uuid", "objectUuid"))
    ev = payload.withColumns({"subject_uuid": subject_uuid, "object_uuid": given})
    for kind, key, name in (("subject", "subject_uuid", "as_subject"), ("object", "object_uuid", "as_object"), ("subject", "object_uuid", "as_other")):
        ev = as_of(ev, defined.where(F.col("kind") == kind).select("seq", F.col("uuid").alias(key), F.col("known").alias(name)), key, name)
    kind = normalize_text(field("event_type", "type", "typeName", "eventType", "datum", "predicateObjectType"))
    rel = F.coalesce(lookup(DARPA_RELATIONS, kind), F.lit("write"))
    by_name = F.col("ta1").isin("trace", "theia") & F.startswith(subject_text, F.lit("{"))
    subject = F.coalesce(
        F.when(~F.startswith(subject_text, F.lit("{")), F.coalesce(F.col("as_subject.entity"), entity("proc_guid", subject_text))),
        F.when(by_name, entity("proc_guid", F.coalesce(*_inner(("uuid", "subjectUuid", "cid"), "subject")))), F.when(F.startswith(subject_text, F.lit("{")), _record_entity(subject_text)),
        F.col("as_subject.entity"), entity("proc_guid", field("subject_uuid", "subjectUuid", "subjectId")),
    )
    direct = field("predicateObjectPath", "predicateObject2Path", "path", "name")
    known = F.coalesce(F.col("as_object.entity"), F.col("as_other.entity"))
    object_ = F.coalesce(
        F.when(F.startswith(direct, F.lit("/")), entity("file", direct)), known, *[_record_entity(get(n)) for n in ("predicateObject", "predicateObject2", "object")],
        entity("entity", F.coalesce(field("predicateObjectUuid", "object_uuid", "objectUuid"), direct)),
    )
    enriched = F.col("ta1").isin("trace", "theia")
    seen = F.coalesce(F.col("as_object.image"), F.col("as_other.image"))
    image = F.coalesce(F.when(enriched, _image()), get("Image"), F.col("as_subject.image"), F.when(rel == "execute", seen))
    event_type = F.coalesce(get("event_type"), F.nullif(normalize_text(field("typeName", "eventType", "type", "datum")), F.lit("")), F.lit("darpa_event"))
    return _finish(ev, {
        "subject": subject, "object": object_, "relations": relations(relation(rel, F.col("subject"), F.col("object"))), "event_type": event_type, "source_type": F.concat(F.lit("darpa/tc/"), "ta1"),
        "event_id": F.coalesce(get("event_id"), field("uuid", "event_uuid", "id", "sequence"), F.lit("darpa-event")), "ts": field("ts", "timestamp", "timestampNanos", "timestampMicros"),
        "image": image, "command_line": F.coalesce(F.when(enriched, _command_line()), get("CommandLine"), F.col("as_subject.command_line")), "target_image": seen,
    }, "darpa")


def _finish(df: DataFrame, given: dict[str, Column], name: str) -> DataFrame:
    text = lambda c: c.cast("string")
    df = df.withColumns({"subject": text(given["subject"]), "object": text(given["object"])})  # relations are made of these
    return df.select(
        "seq",
        F.coalesce(given.get("event_id", field("event_id", "id")), F.concat(F.lit("evt-"), F.col("seq"))).alias("event_id"),
        parse_ts(given.get("ts", field("ts", "timestamp"))).alias("ts"),
        F.coalesce(given["event_type"], F.lit("unknown")).alias("event_type"),
        "subject",
        "object",
        extract_bytes({n: get(n) for n in BYTE_FIELDS}).alias("bytes"),
        given["relations"].cast(RELATIONS).alias("relations"),
        text(given.get("source_type", F.lit(None))).alias("source_type"),
        given.get("euid", F.lit(None)).cast("int").alias("euid"),
        text(given.get("integrity", F.lit(None))).alias("integrity"),
        given.get("elevated", F.lit(False)).alias("elevated"),
        text(given.get("image", F.coalesce(field("Image"), field("exe")))).alias("image"),
        text(given.get("command_line", field("CommandLine", "commandLine", "cmdLine", "command_line"))).alias("command_line"),
        text(given.get("target_image", field("TargetImage"))).alias("target_image"),
        F.coalesce(truthy(get("subject_state_change")), F.lit(False)).alias("subject_state_change"),
        F.coalesce(truthy(get("object_state_change")), F.lit(False)).alias("object_state_change"),
        source_tokens().alias("source_tokens"),
        F.lit(name).alias("dialect"),
        F.col("value").alias("raw"),
    )


def source_tokens() -> Column:
    """What a record's top level says about its source: names, and product/category and product/service."""
    said = lambda n: F.nullif(logsource(n), F.lit(""))
    top = [F.nullif(normalize_text(get(n)), F.lit("")) for n in ("source_type", "log_type", "category", "service", "product")]
    both = [F.concat(said("product"), F.lit("/"), said(n)) for n in ("category", "service")]
    return F.array_distinct(F.array_compact(F.array(*top, said("product"), said("category"), said("service"), *both)))


#: Adapters by name, and tests of those that were added, which come first.
ADAPTERS = {"auditd": _auditd, "etw": _etw, "generic": _generic}
ADDED: dict[str, Callable[[], Column]] = {}


def register(name: str, test: Callable[[], Column], make: Callable[[], dict[str, Column]]) -> None:
    """Adds a dialect: test() says whether a parsed record (see get, field, has) is its; make() gives at least subject, object, relations and event_type."""
    if name in ADAPTERS:
        raise ValueError(f"there is an adapter {name!r}")
    ADAPTERS[name], ADDED[name] = make, test


def unregister(name: str) -> None:
    ADAPTERS.pop(name), ADDED.pop(name)


def to_events(lines: DataFrame) -> DataFrame:
    """The common model of JSON lines (value, seq): one parse and one projection a dialect; DARPA adds as-of joins."""
    records = parsed(lines.where(F.startswith(F.trim("value"), F.lit("{")) & F.expr("try_parse_json(value) is not null"))).withColumn("d", dialect())
    found = [_finish(records.where(F.col("d") == name), make(), name) for name, make in ADAPTERS.items()]
    if not lines.isStreaming:  # a stream's batches come here one by one
        found.append(darpa(records.where("d = 'darpa'").drop("d")))
    return reduce(DataFrame.unionByName, found)
