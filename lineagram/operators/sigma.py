"""Sigma detections: parsing conditions, translating rules, compiling them to column expressions.

A detection is a dictionary of named searches and a condition over their names.
``translate`` gives the engine's own rule form; ``compile_detection`` gives a
boolean column with the language's own meaning: values compare without case,
``*`` and ``?`` are wildcards, ``all`` asks for every value.
"""

from __future__ import annotations

import base64
import fnmatch
import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lineagram.operators.rules import STAGES, Rule, compiles

TOKEN = re.compile(r"\(|\)|\||[^\s()|]+")
# Tactics and other names of stages, by the stage they belong to.
TACTIC_STAGES = {
    "initial_compromise": 1, "initial_access": 1, "execution": 2, "establish_foothold": 2, "persistence": 2, "c&c_communication": 2, "c2": 2, "command_and_control": 2, "internal_recon": 3, "discovery": 3,
    "credential_access": 3, "collection": 3, "privilege_escalation": 4, "defense_evasion": 4, "lateral_movement": 5, "move_laterally": 5, "exfiltration": 6, "complete_mission": 7, "impact": 7, "cleanup": 7,
}
RELATIONS = {"SPAWN": "spawn", "EXECUTE": "execute", "READ": "read", "WRITE": "write", "CREATE": "create", "DELETE": "delete", "CONNECT": "connect"}
KNOWN_MODIFIERS = ("contains", "endswith", "startswith", "regex", "re", "windash")
CLOUDS = ("azure", "aws", "gcp", "m365", "okta", "google_workspace")
NODE_KEYS = {
    "NetFlow": ("DestinationIp", "DestinationPort", "DestinationHostname", "SourceIp", "dst_ip", "dst_port", "QueryName", "c-uri", "cs-host"),
    "Identity": ("TargetUserName", "SubjectUserName", "TargetUserSid", "MemberName"),
    "Process": ("Image", "OriginalFileName", "CommandLine", "ProcessId", "TargetImage", "GrantedAccess"),
    "Registry": ("TargetObject", "Details", "NewName"),
    "NamedPipe": ("PipeName",),
    "File": ("TargetFilename", "FileName", "ImageLoaded", "file_path", "path"),
}
PARENT_KEYS = ("ParentImage", "ParentCommandLine", "SourceImage", "ParentProcessId")


def stage_of(name: str | None) -> int:
    """The stage that a tactic or another name stands for; the first for anything else."""
    return TACTIC_STAGES.get(str(name or "").strip().lower().replace(" ", "_").replace("-", "_"), 1)


LEVELS = {"informational": 1.0, "low": 2.0, "medium": 6.0, "high": 8.0, "critical": 10.0}


def parse(text: str, names: list[str]) -> dict:
    """The condition's tree: ref, of, and, or, not.  Raises ValueError for what isn't a condition."""
    tokens = TOKEN.findall(text.split("|")[0])
    at = 0

    def peek() -> str:
        return tokens[at].lower() if at < len(tokens) else ""

    def take() -> str:
        nonlocal at
        if at >= len(tokens):
            raise ValueError(f"condition ends too early: {text!r}")
        at += 1
        return tokens[at - 1]

    def expand(pattern: str) -> list[str]:
        if pattern.lower() == "them":
            return [n for n in names if not n.startswith("_")]
        return [n for n in names if fnmatch.fnmatchcase(n, pattern)]

    def atom() -> dict:
        word = take()
        if word == "(":
            inner = either()
            if take() != ")":
                raise ValueError(f"missing bracket: {text!r}")
            return inner
        if word.lower() == "not":
            return {"not": atom()}
        if peek() == "of" and (word.isdigit() or word.lower() in ("all", "any")):
            take()
            group = expand(take())
            least = len(group) if word.lower() == "all" else 1 if word.lower() == "any" else int(word)
            return {"of": group, "least": max(1, least)}
        if word not in names:
            raise ValueError(f"no search named {word!r}")
        return {"ref": word}

    def both() -> dict:
        parts = [atom()]
        while peek() == "and":
            take()
            parts.append(atom())
        return parts[0] if len(parts) == 1 else {"and": parts}

    def either() -> dict:
        parts = [both()]
        while peek() == "or":
            take()
            parts.append(both())
        return parts[0] if len(parts) == 1 else {"or": parts}

    tree = either()
    if at < len(tokens):
        raise ValueError(f"not understood from {tokens[at]!r} on: {text!r}")
    return tree


def fold(tree: dict, ref: Callable[[str], Column]) -> Column:
    """The tree as a column."""
    if "ref" in tree:
        return ref(tree["ref"])
    if "not" in tree:
        return ~fold(tree["not"], ref)
    if "of" in tree:
        hits = reduce(lambda a, b: a + b, [ref(n).cast("int") for n in tree["of"]], F.lit(0))
        return hits >= tree["least"]
    how, parts = next(iter(tree.items()))
    return reduce((lambda a, b: a & b) if how == "and" else (lambda a, b: a | b), [fold(p, ref) for p in parts])


def _pattern(value: str, how: set[str]) -> str:
    """A regular expression for a value with wildcards and escapes."""
    out, i = [], 0
    while i < len(value):
        c = value[i]
        if c == "\\" and i + 1 < len(value) and value[i + 1] in "*?\\":
            out.append(re.escape(value[i + 1]))
            i += 2
            continue
        out.append(".*" if c == "*" else "." if c == "?" else re.escape(c))
        i += 1
    body = "".join(out)
    lead, tail = "" if how & {"contains", "endswith"} else "^", "" if how & {"contains", "startswith"} else "$"
    return f"(?is){lead}{body}{tail}"


def _cidr(c: Column, network: str) -> Column:
    """Whether an IPv4 address lies in a network."""
    address, _, bits = network.partition("/")
    number = lambda text: reduce(lambda a, b: a * 256 + b, [int(x) for x in text.split(".")])
    size = 1 << (32 - int(bits or 32))
    parts = F.split(c, "\\.")
    value = reduce(lambda a, b: a * 256 + b, [F.try_element_at(parts, F.lit(i)).try_cast("bigint") for i in range(1, 5)])
    low = number(address) // size * size
    return F.regexp_like(c, F.lit(r"^[0-9]{1,3}(\.[0-9]{1,3}){3}$")) & value.between(low, low + size - 1)


def encoded(value: str, offsets: bool, wide: bool) -> list[str]:
    """What a text looks like in base64: as it is, or, with offsets, what is sure of it at each of the three places it may begin."""
    raw = value.encode("utf-16-le" if wide else "utf-8")
    if not offsets:
        return [base64.b64encode(raw).decode()]
    out = []
    for i in range(3):
        text = base64.b64encode(b" " * i + raw).decode()
        out.append(text[(0, 2, 3)[i] : len(text) - (0, 3, 2)[(len(raw) + i) % 3]])
    return out


def field_test(key: str, wanted, lookup: Callable[[str], Column | None]) -> Column:
    """One ``field|modifier|...: value(s)``."""
    name, *mods = key.split("|")
    how = {m.lower() for m in mods}
    column = lookup(name)
    values = wanted if isinstance(wanted, list) else [wanted]
    if column is None:
        return F.lit(all(v is None for v in values))
    text = column.cast("string")

    def one(v) -> Column:
        if v is None:
            return F.coalesce(text == "", F.lit(True))
        if "exists" in how:
            return text.isNotNull() if v else text.isNull()
        if "fieldref" in how:
            other = lookup(str(v))
            return F.lit(False) if other is None else F.lower(text) == F.lower(other.cast("string"))
        if "cidr" in how:
            return _cidr(text, str(v))
        for mod, test in (("gt", text.try_cast("double") > F.lit(v)), ("gte", text.try_cast("double") >= F.lit(v)), ("lt", text.try_cast("double") < F.lit(v)), ("lte", text.try_cast("double") <= F.lit(v))):
            if mod in how:
                return test
        if "re" in how:
            return F.regexp_like(text, F.lit(str(v))) if compiles(str(v)) else F.lit(False)
        if how & {"base64", "base64offset"}:
            return reduce(lambda a, b: a | b, [F.contains(text, F.lit(x)) for x in encoded(str(v), "base64offset" in how, bool(how & {"wide", "utf16le"}))])
        shown = F.translate(text, "/–—", "---") if "windash" in how else text
        said = re.sub("[/–—]", "-", str(v)) if "windash" in how else str(v)
        return F.regexp_like(shown, F.lit(_pattern(said, how)))

    tests = [F.coalesce(one(v), F.lit(False)) for v in values]
    return reduce((lambda a, b: a & b) if "all" in how else (lambda a, b: a | b), tests)


def search(spec, lookup: Callable[[str], Column | None], line: Column) -> Column:
    """A named search: fields that must all hold, alternatives, or keywords in the raw line."""
    if isinstance(spec, dict):
        return reduce(lambda a, b: a & b, [field_test(k, v, lookup) for k, v in spec.items()], F.lit(True))
    if isinstance(spec, list):
        return reduce(lambda a, b: a | b, [search(s, lookup, line) for s in spec], F.lit(False))
    return F.coalesce(F.regexp_like(line, F.lit(_pattern(str(spec), {"contains"}))), F.lit(False))


def compile_detection(detection: dict, lookup: Callable[[str], Column | None], line: Column) -> Column:
    """The detection as a boolean column; several conditions are alternatives."""
    searches = {k: v for k, v in detection.items() if k not in ("condition", "timeframe")}
    said = detection["condition"]
    trees = [parse(c, list(searches)) for c in (said if isinstance(said, list) else [said])]
    return reduce(lambda a, b: a | b, [fold(t, lambda n: search(searches[n], lookup, line)) for t in trees])


def detect(events: DataFrame, detection: dict, line: str = "raw") -> DataFrame:
    """Events that a detection finds; fields are columns by their names."""
    names = {c.lower(): c for c in events.columns}
    lookup = lambda f: F.col(names[f.lower()]) if f.lower() in names else None
    return events.where(compile_detection(detection, lookup, F.col(line) if line in events.columns else F.lit("")))


def _node(tree: dict) -> dict:
    if "ref" in tree:
        return {"type": "selector_ref", "selector": tree["ref"]}
    if "of" in tree:
        return {"type": "selector_group", "quantifier": "COUNT", "count": tree["least"], "selectors": tree["of"]}
    if "not" in tree:
        return {"type": "logical", "operator": "NOT", "operands": [_node(tree["not"])]}
    how, parts = next(iter(tree.items()))
    return {"type": "logical", "operator": how.upper(), "operands": [_node(p) for p in parts]}


def translate(rule: dict) -> Rule:
    """A Sigma rule in the engine's own form, with stage and severity from its tags and level."""
    detection = rule["detection"]
    names = [k for k in detection if k not in ("condition", "timeframe")]
    selectors = {}
    for name in names:
        spec = detection[name]
        if not isinstance(spec, dict):
            raise ValueError(f"{rule.get('id')}: only searches by field have the engine's form; {name!r} is a list")
        items = [{"type": "field_match", "field": k.split("|")[0], "modifiers": k.split("|")[1:], "value": v} for k, v in spec.items()]
        selectors[name] = {"type": "object", "items": items}
    said = detection["condition"]
    trees = [_node(parse(c, names)) for c in (said if isinstance(said, list) else [said])]
    condition = trees[0] if len(trees) == 1 else {"type": "logical", "operator": "OR", "operands": trees}
    stage = min((TACTIC_STAGES[t] for t in _tactics(rule) if t in TACTIC_STAGES), default=None)
    level = LEVELS.get(str(rule.get("level", "medium")).lower(), 6.0)
    return Rule(str(rule["id"]), rule.get("title", ""), stage, level, level, match_logic={"engine": "sigma", "selectors": selectors, "condition": {"compiled": condition}}, seeds_taint=stage == 1)


def lint(rule: dict) -> list[str]:
    """What is wrong with a rule; empty if nothing is."""
    found = [f"{k} is missing" for k in ("id", "title", "logsource", "detection") if not rule.get(k)]
    detection = rule.get("detection") or {}
    names = [k for k in detection if k not in ("condition", "timeframe")]
    if "condition" not in detection:
        return [*found, "condition is missing"]
    said = detection["condition"]
    used: set[str] = set()

    def walk(tree: dict) -> None:
        if "ref" in tree:
            used.add(tree["ref"])
        elif "of" in tree:
            used.update(tree["of"])
            if not tree["of"]:
                found.append("a group names no search")
        else:
            for v in tree.values():
                for t in v if isinstance(v, list) else [v]:
                    walk(t)

    for c in said if isinstance(said, list) else [said]:
        try:
            walk(parse(c, names))
        except ValueError as e:
            found.append(str(e))
    found += [f"search {n!r} is never used" for n in names if n not in used]
    for n in names:
        for k, v in detection[n].items() if isinstance(detection[n], dict) else ():
            if "re" in k.split("|")[1:]:
                for p in v if isinstance(v, list) else [v]:
                    if not compiles(str(p)):
                        found.append(f"broken pattern in {n}.{k}")
    return found


def report(rules: list[dict]) -> dict:
    """(rules, clean, problems by rule): lint over many rules, and ids that several have."""
    found = {str(r.get("id")): lint(r) for r in rules}
    ids = [str(r.get("id")) for r in rules]
    for i in {x for x in ids if ids.count(x) > 1}:
        found[i] = [*found[i], "several rules have this id"]
    return {"rules": len(rules), "clean": sum(not v for v in found.values()), "problems": {k: v for k, v in found.items() if v}}


# ---- graph rules: subject, relation, object


def _tactics(rule: dict) -> list[str]:
    return [str(t).lower().removeprefix("attack.").replace("-", "_") for t in rule.get("tags") or []]


def _said(rule: dict) -> str:
    source = rule.get("logsource") or {}
    return " ".join(str(source.get(k, "")) for k in ("product", "category", "service")).lower()


def flattened(detection: dict) -> dict:
    """Field and values of all searches, values of one field together; what a condition negates is left out."""
    out: dict = {}
    said = detection.get("condition", "")
    negated = set(re.findall(r"not\s+(?:1 of |all of )?([\w*]+)", " ".join(said) if isinstance(said, list) else str(said)))

    def add(spec) -> None:
        if isinstance(spec, list):
            for x in spec:
                add(x)
        elif isinstance(spec, dict):
            for k, v in spec.items():
                have = out.setdefault(k, [])
                have += [x for x in (v if isinstance(v, list) else [v]) if x is not None and x not in have]

    for name, spec in detection.items():
        if name not in ("condition", "timeframe") and not any(fnmatch.fnmatchcase(name, n) for n in negated):
            add(spec)
    return {k: v[0] if len(v) == 1 else v for k, v in out.items()}


def relation_of(rule: dict, fields: dict) -> str:
    """What the events that a rule speaks of do."""
    said, names = _said(rule), {k.split("|")[0] for k in fields}
    for words, relation in ((("process_creation", "ps_script"), "EXECUTE"), (("network", "dns", "proxy", "firewall", "webserver"), "CONNECT"), (("file_event", "file_change", "registry"), "WRITE"), (("file_delete",), "DELETE"), (("file_access", "image_load"), "READ"), (("create_remote_thread", "process_access"), "EXECUTE")):
        if any(w in said for w in words):
            return relation
    return "CONNECT" if names & set(NODE_KEYS["NetFlow"]) else "EXECUTE"


def subject_type(rule: dict) -> str:
    said = _said(rule)
    return "CloudIdentity" if any(c in said for c in CLOUDS) else "Event" if any(w in said for w in ("security", "system", "application")) else "Process"


def object_type(names: set[str], rule: dict, relation: str) -> str:
    """By the fields of the object, the relation, and where the events come from."""
    if relation == "CONNECT":
        return "NetFlow"
    for kind in ("NetFlow", "Identity", "Process", "Registry", "NamedPipe"):
        if names & set(NODE_KEYS[kind]):
            return kind
    cloud = subject_type(rule) == "CloudIdentity"
    if any(n.startswith("objectRef.") for n in names):
        return "CloudResource" if cloud else "Resource"
    if cloud:
        return "CloudResource"
    return "File" if names & set(NODE_KEYS["File"]) or subject_type(rule) != "Event" else "Event"


def scrubbed(fields: dict) -> dict:
    """Fields without empty values and signs that no event has."""
    clean = lambda v: re.sub(r"[\u200b-\u200f\u2028\u2029\ufeff]", "", v).strip() if isinstance(v, str) else v
    out = {}
    for k, v in fields.items():
        kept = [x for x in map(clean, v if isinstance(v, list) else [v]) if x not in ("", None)]
        if kept:
            out[k] = kept[0] if len(kept) == 1 else kept
    return out


def too_broad(subject: dict, object_: dict) -> bool:
    """Whether a rule would say nothing: at most one field, with a value that holds everywhere."""
    every = [str(x).strip().lower() for f in (subject, object_) for v in f.values() for x in (v if isinstance(v, list) else [v])]
    return len(subject) + len(object_) <= 1 and all(len(v.strip("*")) < 3 or v in ("true", "false", "success", "failure", "unknown") for v in every)


def to_graph_rule(rule: dict, hops: int = 3) -> dict:
    """A Sigma rule as subject, relation and object, with the stages that must have been before."""
    fields = scrubbed(flattened(rule.get("detection") or {}))
    relation = relation_of(rule, fields)
    subject = {k: v for k, v in fields.items() if k.split("|")[0] in PARENT_KEYS}
    object_ = {k: v for k, v in fields.items() if k not in subject}
    stages = list(dict.fromkeys(TACTIC_STAGES[t] for t in _tactics(rule) if t in TACTIC_STAGES))
    stage = stages[0] if stages else 2
    before = sorted({s - 1 for s in stages or [stage] if s > 1})
    needs = [{"type": "stage_path", "quantifier": "EXISTS", "source_stage": STAGES[s - 1], "target_node": "$subject_node", "threshold": hops} for s in before]
    return {
        "name": rule.get("title", ""), "apt_stage": STAGES[stage - 1], "severity_score": LEVELS.get(str(rule.get("level", "medium")).lower(), 6.0), "prerequisites": {"operator": "OR" if len(needs) > 1 else "AND", "predicates": needs},
        "match_logic": {
            "relation": relation, "subject": {"type": subject_type(rule), "attributes": subject}, "object": {"type": object_type({k.split("|")[0] for k in object_}, rule, relation), "attributes": object_},
            "entity_bindings": {"subject": "$subject_node", "object": "$object_node"},
        },
    }


def check_graph_rule(rule: dict) -> list[str]:
    """What is wrong with a graph rule; empty if nothing is."""
    logic, found = rule.get("match_logic"), []
    if "attributes" in rule:
        found.append("attributes belong to match_logic")
    if not isinstance(logic, dict):
        return [*found, "match_logic must be a mapping"]
    ends = {k: logic.get(k) if isinstance(logic.get(k), dict) else {} for k in ("subject", "object")}
    fields = {k: {n.split("|")[0]: v for n, v in (e.get("attributes") or {}).items()} for k, e in ends.items()}
    kinds = {*NODE_KEYS, "Network", "CloudIdentity", "CloudResource", "Resource", "Event"}
    if logic.get("relation") not in RELATIONS:
        found.append(f"unknown relation {logic.get('relation')!r}")
    found += [f"unknown type of {k}: {e.get('type')!r}" for k, e in ends.items() if e.get("type") not in kinds]
    if not fields["subject"] and not fields["object"]:
        found.append("neither subject nor object has attributes")
    if logic.get("relation") == "SPAWN" and ends["object"].get("type") != "Process":
        found.append("what is spawned is a process")
    if logic.get("relation") == "CONNECT" and ends["object"].get("type") not in ("NetFlow", "Network"):
        found.append("what is connected to is a network flow")
    own = {*NODE_KEYS["Process"], *PARENT_KEYS} - {"Image"}
    for k in ends:
        if ends[k].get("type") != "Process" and (bad := sorted(own & set(fields[k]))):
            found.append(f"fields of processes at a {k} that is none: {', '.join(bad)}")
    if bad := sorted(set(fields["subject"]) & {*NODE_KEYS["Registry"], "TargetFilename", "DestinationIp"}):
        found.append(f"fields of objects at the subject: {', '.join(bad)}")
    if ends["subject"].get("type") == "CloudIdentity" and ends["object"].get("type") in ("Registry", "File"):
        found.append("a cloud identity has no files and no registry")
    if any(ord(ch) in range(0x200B, 0x2010) or ord(ch) == 0xFEFF for f in fields.values() for v in f.values() for x in (v if isinstance(v, list) else [v]) for ch in str(x)):
        found.append("signs that no event has")
    if (fields["subject"] or fields["object"]) and too_broad(fields["subject"], fields["object"]):
        found.append("too broad")
    needs = rule.get("prerequisites")
    if not isinstance(needs, dict) or needs.get("operator") not in ("AND", "OR"):
        return [*found, "prerequisites must have an operator, AND or OR"]
    bound = logic.get("entity_bindings")
    bound = {v for v in bound.values() if isinstance(v, str)} if isinstance(bound, dict) else set()
    if not bound:
        found.append("no variable is bound")
    predicates = needs.get("predicates")
    if not isinstance(predicates, list):
        return [*found, "predicates must be a list"]
    for p in predicates:
        if not isinstance(p, dict) or p.get("type") != "stage_path":
            found.append("a predicate that is no stage_path")
        elif p.get("target_node") not in bound:
            found.append(f"unbound variable {p.get('target_node')!r}")
    return found


def _spec(key: str, value) -> dict:
    """A field and value with wildcards as modifiers, or as a pattern where no modifier fits."""
    name, *mods = [p for p in key.split("|") if p]
    mods = [m.lower() for m in mods if m.lower() in KNOWN_MODIFIERS]
    if isinstance(value, str) and ("*" in value or "?" in value):
        inner = value.strip("*")
        plain = bool(inner) and "*" not in inner and "?" not in inner
        shape = (value.startswith("*"), value.endswith("*"))
        if not mods and plain and any(shape):
            mods, value = [{(True, True): "contains", (True, False): "endswith", (False, True): "startswith"}[shape]], inner
        elif not mods or {"regex", "re"} & set(mods):
            mods, value = mods or ["regex"], "^" + "".join({"*": ".*", "?": "."}.get(ch, re.escape(ch)) for ch in value) + "$"
    literal = lambda v: {"type": "literal", "value": str(v)}
    return {"type": "field_match", "field": name, "modifiers": mods, "value": {"type": "list", "items": [literal(v) for v in value]} if isinstance(value, list) else literal(value)}


def to_runtime(rule: dict, rule_id: str) -> dict:
    """A graph rule in the form that rule files have: a search for the relation and one for each end, all of which must hold."""
    logic = rule.get("match_logic") or {}
    said = str(logic.get("relation", "EXECUTE")).upper()
    searches = {"sel_relation": [_spec("cdr.semantic_relations{}.relation", RELATIONS.get(said, said.lower()))]}
    for k in ("subject", "object"):
        fields = (logic.get(k) or {}).get("attributes") or {}
        if items := [_spec(n, v) for n, v in fields.items() if str(n).strip() and v is not None]:
            searches[f"sel_{k}"] = items
    refs = [{"type": "selector_ref", "selector": n} for n in searches]
    points = rule.get("severity", rule.get("severity_score"))
    points = float(points) if isinstance(points, (int, float)) else 5.0
    return {
        "rule_id": rule_id, "name": rule.get("name") or rule_id, "source_types": ["sigma_adapter"], "apt_stage": STAGES[stage_of(rule.get("apt_stage")) - 1], "severity": points, "cvss": min(10.0, max(0.0, points)),
        "match_logic": {"engine": "sigma", "condition": {"compiled": refs[0] if len(refs) == 1 else {"type": "logical", "operator": "AND", "operands": refs}}, "selectors": {n: {"type": "object", "items": i} for n, i in searches.items()}},
        "prerequisites": rule["prerequisites"] if isinstance(rule.get("prerequisites"), dict) else {"operator": "AND", "predicates": []}, "entity_bindings": [],
    }


def bundle(rules: list[dict], prefix: str = "SIGMA") -> dict:
    """Graph rules as the content of a rule file."""
    return {"rules": [to_runtime(r, f"{prefix}_{i:06d}") for i, r in enumerate(rules, 1)]}


def translated(rules: list[dict]) -> tuple[list[dict], dict[str, list[str]]]:
    """(graph rules, problems by rule id): Sigma rules that translate to graph rules without a fault, and what keeps the others from it."""
    good, bad = [], {}
    for r in rules:
        try:
            got = to_graph_rule(r)
            faults = check_graph_rule(got)
        except (ValueError, TypeError, AttributeError) as e:
            got, faults = None, [str(e)]
        if faults:
            bad[str(r.get("id"))] = faults
        else:
            good.append(got)
    return good, bad


# ---- aggregations of a condition

AGGREGATION = re.compile(r"\|\s*(count|sum|min|max|avg)\s*\(\s*([\w.-]*)\s*\)\s*(?:by\s+([\w.,\s-]+?))?\s*(>=|<=|==|=|>|<)\s*([0-9.]+)\s*$", re.I)
SPANS = {"s": "seconds", "m": "minutes", "h": "hours", "d": "days"}


def timeframe(text: str) -> str:
    """``15m`` as an interval."""
    got = re.fullmatch(r"\s*([0-9]+)\s*([smhd])\s*", str(text))
    if not got:
        raise ValueError(f"not a timeframe: {text!r}")
    return f"{got[1]} {SPANS[got[2]]}"


def aggregate(events: DataFrame, detection: dict, ts: str = "ts", line: str = "raw") -> DataFrame:
    """(start, by.., value): windows of the detection's timeframe whose aggregate over the events found meets its limit.

    ``selection | count(field) by key > n``: count without a field counts events, with one its different values."""
    said = AGGREGATION.search(str(detection["condition"]))
    if not said:
        raise ValueError(f"no aggregation: {detection['condition']!r}")
    how, of, by, op, limit = said[1].lower(), said[2], [b.strip() for b in (said[3] or "").split(",") if b.strip()], said[4], float(said[5])
    found = detect(events, {**detection, "condition": str(detection["condition"]).split("|")[0].strip()}, line)
    frame = F.window(ts, timeframe(detection["timeframe"])).alias("w") if detection.get("timeframe") else F.struct(F.lit(None).cast("timestamp").alias("start")).alias("w")
    if how == "count" and of:
        rows = found.select(frame, *by, F.col(of).alias("__v")).where("__v is not null").distinct()
        value = F.count("*")
    else:
        rows = found.select(frame, *by, (F.col(of) if of else F.lit(1)).alias("__v"))
        value = F.count("*") if how == "count" else getattr(F, how)(F.col("__v").cast("double"))
    got = rows.groupBy("w", *by).agg(value.alias("value"))
    tests = {">": F.col("value") > limit, ">=": F.col("value") >= limit, "<": F.col("value") < limit, "<=": F.col("value") <= limit, "=": F.col("value") == limit, "==": F.col("value") == limit}
    return got.where(tests[op]).select(F.col("w.start").alias("start"), *by, "value")
