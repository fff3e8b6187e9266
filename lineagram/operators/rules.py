"""Detection rules: checking, and compiling their conditions to column expressions.

A condition is evaluated in whole-stage codegen; no row ever reaches Python.
Unknown selectors and selectors that don't compile are false, patterns that the
engine can't compile are skipped, and a rule without any predicate matches every event.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from lineagram.functions.scalars import windash

# Stages of an intrusion, in order; types that stand for entities; prefixes of bound entities.
STAGES = ("Initial Compromise", "Establish Foothold", "Internal Recon", "Privilege Escalation", "Move Laterally", "Exfiltration", "Cleanup")
DEFAULT_STAGE = 1
SIMPLE_TYPES = ("process", "file", "ip", "registry", "artifact")
BOUND_PREFIXES = {
    "process": "proc", "file": "file", "registrykey": "reg", "registry": "reg", "ipaddress": "ip", "networkendpoint": "net", "artifact": "artifact", "dnsquery": "dns", "webrequest": "web",
    "cloudapicall": "cloudapi", "cloudidentity": "cloudid", "application": "app", "useragent": "ua", "namedpipe": "pipe",
}
BOUND_TYPES = {"process": "process", "file": "file", "registrykey": "registry", "registry": "registry", "ipaddress": "ip"}
PROCESS_SYMBOLS, TARGET_SYMBOLS = ("$current_process", "$source_process"), ("$target_file", "$current_file", "$target_registry_key", "$remote_ip")
#: Rules that one number can tell apart.
MOST_RULES = 8192


@dataclass(frozen=True)
class Rule:
    rule_id: str
    name: str = ""
    stage: int | None = None
    severity: float = 1.0
    cvss: float | None = None
    source_types: tuple[str, ...] = ()
    target_types: tuple[str, ...] = ()
    event_predicate: dict | str | None = None
    match_logic: dict | None = None
    prerequisites: tuple[str, ...] = ()
    max_path_factor: int | None = None
    bypass_benign_filter: bool = False
    seeds_taint: bool = field(default=False)
    prerequisite_ast: dict | None = None
    entity_bindings: tuple[dict, ...] = ()
    apt_stage: str | None = None
    tactic: str | None = None
    technique: str | None = None


def check(rules: list[Rule]) -> list[Rule]:
    """Raises for rules that can't be used; gives them back otherwise."""
    seen: set[str] = set()
    if len(rules) > MOST_RULES:
        raise ValueError(f"more than {MOST_RULES} rules")
    for r in rules:
        if not r.rule_id or r.rule_id in seen:
            raise ValueError(f"rule ids must be there and differ: {r.rule_id!r}")
        seen.add(r.rule_id)
        if r.stage is not None and not 1 <= r.stage <= len(STAGES):
            raise ValueError(f"{r.rule_id}: stage must be 1 to {len(STAGES)}")
        if r.cvss is not None and not 0 <= r.cvss <= 10:
            raise ValueError(f"{r.rule_id}: cvss must be 0 to 10")
        if r.event_predicate and r.match_logic:
            raise ValueError(f"{r.rule_id}: one kind of predicate, not two")
        if r.max_path_factor is not None and (not isinstance(r.max_path_factor, int) or r.max_path_factor < 0):
            raise ValueError(f"{r.rule_id}: max_path_factor must be a whole number")
    return rules


def literals(spec) -> list[str]:
    """The strings that a value specification asks for."""
    if isinstance(spec, dict):
        if spec.get("type") == "literal":
            return [] if spec.get("value") is None else [str(spec["value"])]
        return [x for item in spec.get("items", []) for x in literals(item)] if spec.get("type") == "list" else ([] if not spec else [str(spec)])
    if isinstance(spec, list):
        return [x for item in spec for x in literals(item)]
    return [] if spec is None else [str(spec)]


def field_match(item: dict, lookup: Callable[[str], Column | None]) -> Column:
    """One predicate on a field; lookup gives an array of the field's strings, or None for a field that isn't there."""
    if item.get("value") == {}:
        return F.lit(True)
    values, wanted = lookup(item["field"]), literals(item.get("value"))
    if values is None or not wanted:
        return F.lit(False)
    how = {str(m).lower() for m in item.get("modifiers", []) if isinstance(m, str)}
    clean = windash if "windash" in how else (lambda c: c)
    test: Callable[[Column, str], Column]
    if how & {"re", "regex"}:
        wanted = [w for w in wanted if compiles(w)]
        test = lambda v, w: F.regexp_like(clean(v), F.lit(w))
    elif "contains" in how:
        test = lambda v, w: F.contains(clean(v), clean(F.lit(w)))
    elif "endswith" in how:
        test = lambda v, w: F.endswith(clean(v), clean(F.lit(w)))
    elif "startswith" in how:
        test = lambda v, w: F.startswith(clean(v), clean(F.lit(w)))
    else:
        test = lambda v, w: clean(v) == clean(F.lit(w))
    if not wanted:
        return F.lit(False)
    return F.coalesce(F.exists(values, lambda v: reduce(lambda a, b: a | b, [test(v, w) for w in wanted])), F.lit(False))


def compiles(pattern: str) -> bool:
    """Whether the engine that will run a pattern takes it; without one, whether Python does."""
    from pyspark import SparkContext

    jvm = getattr(SparkContext._active_spark_context, "_jvm", None)
    try:
        jvm.java.util.regex.Pattern.compile(pattern) if jvm else re.compile(pattern)
    except Exception:  # noqa: BLE001  the gateway wraps what the pattern raises
        return False
    return True


def selector(spec, lookup) -> Column:
    """All predicates of a selector; one that doesn't compile is false."""
    items = spec.get("items") if isinstance(spec, dict) and spec.get("type") == "object" else None
    if not isinstance(items, list) or any(not isinstance(i, dict) or i.get("type") != "field_match" or not i.get("field") for i in items):
        return F.lit(False)
    return reduce(lambda a, b: a & b, [field_match(i, lookup) for i in items], F.lit(True))


def condition(node, selectors: dict[str, Column]) -> Column:
    """References, counts of selectors, and, or, not."""
    kind = node.get("type") if isinstance(node, dict) else None
    no = F.lit(False)
    if kind == "selector_ref":
        return selectors.get(node.get("selector"), no)
    if kind == "selector_group":
        if str(node.get("quantifier", "COUNT")).upper() != "COUNT" or not isinstance(node.get("selectors", []), list):
            return no
        hits = [selectors.get(s, no).cast("int") for s in node.get("selectors", [])]
        return reduce(lambda a, b: a + b, hits, F.lit(0)) >= int(node.get("count", 1))
    if kind == "logical":
        parts, how = [condition(o, selectors) for o in node.get("operands", [])], str(node.get("operator", "AND")).upper()
        if how == "AND":
            return reduce(lambda a, b: a & b, parts, F.lit(True))
        if how == "OR":
            return reduce(lambda a, b: a | b, parts, no)
        if how == "NOT" and len(parts) == 1:
            return ~parts[0]
    return no


def predicate(rule: Rule, lookup: Callable[[str], Column | None], op: Column, subject_type: Column | None = None, object_type: Column | None = None, tokens: Column | None = None) -> Column:
    """Whether an event matches the rule."""
    out = F.lit(True)
    said = {"op": rule.event_predicate} if isinstance(rule.event_predicate, str) else rule.event_predicate
    if said is not None:
        kind = lookup("event_type") if "event_type" in said else None
        out = op == said["op"] if "op" in said else (F.array_contains(kind, said["event_type"]) if kind is not None else op == said["event_type"])
    elif rule.match_logic is not None:
        logic = rule.match_logic
        if logic.get("engine", "sigma") != "sigma" or not logic.get("selectors") or not logic.get("condition"):
            return F.lit(False)
        built = {name: selector(spec, lookup) for name, spec in logic["selectors"].items()}
        compiled = logic["condition"]
        out = condition(compiled.get("compiled", compiled) if isinstance(compiled, dict) else compiled, built)
    allowed = [t.lower() for t in rule.source_types]
    if rule.target_types or (allowed and all("/" not in t and t in SIMPLE_TYPES for t in allowed)):
        if allowed and subject_type is not None:
            out = out & F.coalesce(subject_type.isin(*allowed), F.lit(False))
        if rule.target_types and object_type is not None:
            out = out & F.coalesce(object_type.isin(*[t.lower() for t in rule.target_types]), F.lit(False))
    elif allowed and tokens is not None:
        # events that say nothing about their source pass
        out = out & (F.coalesce(F.size(tokens), F.lit(0)) <= 0) | (out & F.arrays_overlap(tokens, F.array(*[F.lit(t) for t in allowed])))
    return F.coalesce(out, F.lit(False))


def _bound(rule: Rule, item: dict, lookup, subject_type: Column, object_type: Column) -> Column:
    """(entity, raw): what one symbol stands for, and whether it comes from a raw field; entity is null if nothing does."""
    symbol, kind = item.get("symbol"), str(item.get("entity_type") or "").lower()
    ends = F.lit(None).cast("string")
    if (kind == "process" and symbol in PROCESS_SYMBOLS) or (kind in BOUND_TYPES and kind != "process" and symbol in TARGET_SYMBOLS):
        ends = F.when(subject_type == BOUND_TYPES[kind], F.col("subject")).when(object_type == BOUND_TYPES[kind], F.col("object"))
    fields = [f for f in item.get("fields") or [] if isinstance(f, str)]
    prefix = BOUND_PREFIXES.get(kind)
    found = [F.nullif(F.trim(F.try_element_at(F.filter(v, lambda x: F.trim(x) != ""), F.lit(1))), F.lit("")) for v in map(lookup, fields) if v is not None] if prefix else []
    raw = F.concat(F.lit(f"{prefix}:"), F.coalesce(*found)) if found else F.lit(None).cast("string")
    return F.struct(F.lit(symbol).alias("symbol"), F.coalesce(ends, raw).alias("entity"), (ends.isNull() & raw.isNotNull()).alias("raw"))


def bind(found, rules: list[Rule], lookup: Callable[[str], Column | None] | None = None, first_seen=None):
    """(matches with ``bindings``, matches dropped with ``symbol`` and ``reason``).

    Every match binds subject and object; a rule's symbols that start with ``$`` must stand for something.  An entity from
    a raw field must have been seen before or in the event: first_seen has (host, entity, first_seq)."""
    from lineagram.functions.scalars import entity_type

    lookup = lookup or column_lookup(found.columns)
    s, o = entity_type(F.col("subject")), entity_type(F.col("object"))
    symbols = F.array().cast("array<struct<symbol:string,entity:string,raw:boolean>>")
    for r in rules:
        if items := [b for b in r.entity_bindings if isinstance(b.get("symbol"), str) and b["symbol"]]:
            symbols = F.when(F.col("rule_id") == r.rule_id, F.array(*[_bound(r, b, lookup, s, o) for b in items])).otherwise(symbols)
    got = found.withColumn("__symbols", symbols)
    if first_seen is not None:
        # only entities from raw fields are looked up
        asked = got.select("host", "seq", F.explode("__symbols").alias("e")).where("e.raw").select("host", "seq", F.col("e.entity").alias("entity")).distinct()
        known = asked.join(first_seen, ["host", "entity"]).where("first_seq <= seq").groupBy("host", "seq").agg(F.collect_set("entity").alias("__known"))
        got = got.join(known, ["host", "seq"], "left")
        missing = lambda e: e["raw"] & ~F.coalesce(F.array_contains("__known", e["entity"]), F.lit(False))
    else:
        missing = lambda e: F.lit(False)
    bad = F.filter("__symbols", lambda e: F.startswith(e["symbol"], F.lit("$")) & (e["entity"].isNull() | missing(e)))
    reason = F.when(bad[0]["entity"].isNull(), "binding_symbol_unresolved").otherwise("binding_entity_missing_in_graph")
    ends = F.array(F.struct(F.lit("subject").alias("symbol"), F.col("subject").alias("entity")), F.struct(F.lit("object").alias("symbol"), F.col("object").alias("entity")))
    pairs = F.filter(F.concat(ends, F.transform("__symbols", lambda e: F.struct(e["symbol"].alias("symbol"), e["entity"].alias("entity")))), lambda e: e["entity"].isNotNull())
    got = got.withColumn("__bad", bad)
    kept = got.where(F.size("__bad") == 0).select(*found.columns, F.map_from_entries(pairs).alias("bindings"))
    dropped = got.where(F.size("__bad") > 0).select(*found.columns, F.col("__bad")[0]["symbol"].alias("symbol"), reason.alias("reason"))
    return kept, dropped


def column_lookup(columns: list[str]) -> Callable[[str], Column | None]:
    """Fields are columns, by their name, or by one that differs in case alone."""
    exact, low = set(columns), {c.lower(): c for c in reversed(columns)}

    def lookup(name: str) -> Column | None:
        at = name if name in exact else low.get(name.lower())
        return None if at is None else F.array_compact(F.array(F.col(at).cast("string")))

    return lookup


def raw_lookup(column: str = "raw") -> Callable[[str], Column]:
    """Fields are paths into a column of JSON text: ``a.b``, ``a{}.b`` for all entries of an array; a top-level name may differ in case."""
    from lineagram.functions.scalars import field_values, strings_of

    def lookup(name: str) -> Column:
        found = field_values(F.col(column), name)
        if "." in name or "{" in name:
            return found
        fields = F.from_json(column, "map<string,string>")
        alike = F.map_values(F.map_filter(fields, lambda k, v: F.lower(k) == name.lower()))
        return F.when(F.size(found) > 0, found).otherwise(strings_of(F.try_element_at(alike, F.lit(1))))

    return lookup


def matches(events, rules: list[Rule], lookup: Callable[[str], Column | None] | None = None):
    """(event columns, rule_id, rule_order): one scan for all rules, a row for each match."""
    from lineagram.functions.scalars import entity_type

    names = set(events.columns)
    lookup = lookup or column_lookup(events.columns)
    tests = [
        F.when(predicate(r, lookup, F.col("op"), entity_type(F.col("subject")), entity_type(F.col("object")), F.col("source_tokens") if "source_tokens" in names else None), F.struct(F.lit(i).alias("rule_order"), F.lit(r.rule_id).alias("rule_id")))
        for i, r in enumerate(check(rules))
    ]
    return events.withColumn("hit", F.explode(F.array_compact(F.array(*tests)))).select(*events.columns, "hit.rule_id", "hit.rule_order")


def rule_table(spark, rules: list[Rule]):
    """The rules as a dimension: id, stage, severity, cvss (0 to 10), whether they bypass the benign profile."""
    rows = [(r.rule_id, r.stage, float(r.severity), max(0.0, min(10.0, float(r.cvss if r.cvss is not None else r.severity))), r.bypass_benign_filter) for r in rules]
    return spark.createDataFrame(rows, "rule_id string, stage int, severity double, cvss double, bypass boolean")


def _item(name: str, value, *modifiers: str) -> dict:
    return {"type": "field_match", "field": name, "modifiers": list(modifiers), "value": value}


def _selector(*items: dict) -> dict:
    return {"type": "object", "items": list(items)}


#: Rules for the bridged events.
DEMO_RULES = [
    Rule("tmp_write", "Write to a temporary folder", 1, 6.0, 6.5, match_logic={"selectors": {"s": _selector(_item("op", "write"), _item("object", "file:/tmp/", "startswith"))}, "condition": {"type": "selector_ref", "selector": "s"}}, seeds_taint=True),
    Rule("odd_subnet", "Connection to a watched subnet", 2, 8.0, 8.8, match_logic={"selectors": {"s": _selector(_item("op", "connect"), _item("object", [".3.", ".5."], "contains"))}, "condition": {"type": "selector_ref", "selector": "s"}}, prerequisites=("shared_entity",)),
    Rule(
        "two_of_three", "Two of three weak signs", 4, 2.0, 3.1,
        match_logic={
            "selectors": {"a": _selector(_item("op", "read")), "b": _selector(_item("object", "5", "endswith")), "c": _selector(_item("subject", "^proc:u1", "re"))},
            "condition": {"type": "selector_group", "quantifier": "COUNT", "count": 2, "selectors": ["a", "b", "c"]},
        },
    ),
    Rule(
        "run_key", "Change of a run key", 3, 10.0, 9.8,
        match_logic={
            "selectors": {"m": _selector(_item("op", "modify")), "known": _selector(_item("object", "7", "endswith"))},
            "condition": {"type": "logical", "operator": "AND", "operands": [{"type": "selector_ref", "selector": "m"}, {"type": "logical", "operator": "NOT", "operands": [{"type": "selector_ref", "selector": "known"}]}]},
        },
        prerequisites=("shared_entity", "graph_path"), max_path_factor=3,
    ),
    Rule("fork", "New process", 5, 2.0, source_types=("process",), event_predicate="fork"),
]

#: The same matches for a SQL engine, over ``prov``.
MATCH_SQL = """
  select p.*, r.rule_id, r.rule_order, r.stage, r.severity, r.cvss, r.asks from prov p join (values
    ('tmp_write', 0, 1, 6.0::double, 6.5::double, false), ('odd_subnet', 1, 2, 8.0, 8.8, true), ('two_of_three', 2, 4, 2.0, 3.1, false), ('run_key', 3, 3, 10.0, 9.8, true), ('fork', 4, 5, 2.0, 2.0, false))
    r(rule_id, rule_order, stage, severity, cvss, asks)
  on case r.rule_id when 'tmp_write' then op = 'write' and starts_with(object, 'file:/tmp/')
    when 'odd_subnet' then op = 'connect' and (contains(object, '.3.') or contains(object, '.5.'))
    when 'two_of_three' then (op = 'read')::int + (suffix(object, '5'))::int + (starts_with(subject, 'proc:u1'))::int >= 2
    when 'run_key' then op = 'modify' and not suffix(object, '7')
    else op = 'fork' end
"""
