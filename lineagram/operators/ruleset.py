"""Rule files, configuration files and what rules say about each other.

Everything here is small and read on the driver before a plan is made; what plans
need of it becomes literals or a rule dimension.
"""

from __future__ import annotations

import json
from collections.abc import Iterable
from dataclasses import dataclass, field
from pathlib import Path

from lineagram.operators.rules import DEFAULT_STAGE, STAGES, Rule, check

# Other names of stages.
STAGE_ALIASES = {"Lateral Movement": "Move Laterally", "C&C Communication": "Establish Foothold"}
#: Which bindings a graph path runs between, by pair of rules, by right rule, or by default.
PATH_BINDINGS = {"default": {"from_binding": "object", "to_binding": "object", "max_path_factor": 0.0}, "by_right_rule_id": {}, "by_pair": {}}
POLICIES = ("union", "dst_only")


@dataclass(frozen=True)
class RuleSet:
    rules: tuple[Rule, ...] = ()
    alpha: float = 1.0
    says_alpha: bool = False


def _yaml(text: str):
    try:
        import yaml
    except ImportError as e:
        raise RuntimeError("YAML files need the yaml package; JSON files don't") from e
    return yaml.safe_load(text)


def read(path: str | Path):
    """The content of a YAML or JSON file; None if it is empty."""
    text = Path(path).read_text(encoding="utf-8")
    if not text.strip():
        return None
    return json.loads(text) if Path(path).suffix.lower() == ".json" else _yaml(text)


def _is(kind, value, what: str):
    ok = isinstance(value, kind) and not (isinstance(value, bool) and kind is not bool)
    if value is not None and not ok:
        raise ValueError(f"{what} has the wrong type: {value!r}")
    return value


def _names(value, what: str) -> tuple[str, ...]:
    if value is not None and (not isinstance(value, list) or any(not isinstance(x, str) for x in value)):
        raise ValueError(f"{what} must be a list of strings")
    return tuple(value or ())


def _needs(value, what: str) -> tuple[tuple, int | None]:
    """(kinds of links needed, largest path factor)."""
    kinds, most = [], None
    for item in _is(list, value, what) or []:
        if isinstance(item, str):
            kinds.append(item)
            continue
        if not isinstance(item, dict) or item.get("type") != "path_factor" or "op" in item:
            raise ValueError(f"{what}: neither a name nor a path_factor with max_path_factor alone: {item!r}")
        limit = item.get("max_path_factor")
        if isinstance(limit, bool) or not isinstance(limit, int) or limit < 0:
            raise ValueError(f"{what}: max_path_factor must be a whole number from 0: {limit!r}")
        most = limit if most is None else min(most, limit)
    return tuple(kinds), most


def build(item: dict, as_json: bool = False) -> Rule:
    """A rule from an entry of a rule file."""
    rule_id, name = item.get("rule_id"), item.get("name")
    if not isinstance(rule_id, str) or not isinstance(name, str):
        raise ValueError(f"a rule needs rule_id and name as strings: {item!r}")
    stage = _is(int, item.get("stage"), f"{rule_id}: stage")
    named = _is(str, item.get("apt_stage"), f"{rule_id}: apt_stage")
    named = STAGE_ALIASES.get(named, named)
    if named is not None and named not in STAGES:
        raise ValueError(f"{rule_id}: apt_stage must be one of {STAGES}")
    if named is None and stage is not None and 1 <= stage <= len(STAGES):
        named = STAGES[stage - 1]
    wanted, tree = item.get("prerequisites"), None
    if as_json and isinstance(wanted, dict):
        wanted, tree = None, wanted
    kinds, most = _needs(wanted, f"{rule_id}: prerequisites")
    points = item.get("severity_score") if as_json else None
    predicate = _is(dict, item.get("event_predicate"), f"{rule_id}: event_predicate") if not as_json else None
    if predicate is not None and (len(predicate) != 1 or next(iter(predicate)) not in ("op", "event_type") or not isinstance(next(iter(predicate.values())), str) or not next(iter(predicate.values()))):
        raise ValueError(f"{rule_id}: event_predicate has one key, op or event_type, and a text")
    bindings = _is(list, item.get("entity_bindings"), f"{rule_id}: entity_bindings") or []
    if any(not isinstance(b, dict) for b in bindings):
        raise ValueError(f"{rule_id}: entity_bindings must be mappings")
    severity, cvss = item.get("severity", points), item.get("cvss", points)
    return Rule(
        rule_id, name, stage, 1.0 if severity is None else float(_is((int, float), severity, f"{rule_id}: severity")), None if cvss is None else float(_is((int, float), cvss, f"{rule_id}: cvss")),
        _names(item.get("source_types"), f"{rule_id}: source_types"), _names(item.get("target_types"), f"{rule_id}: target_types"), predicate, _is(dict, item.get("match_logic"), f"{rule_id}: match_logic"),
        kinds, most, bool(_is(bool, item.get("bypass_benign_filter"), f"{rule_id}: bypass_benign_filter")), prerequisite_ast=tree, entity_bindings=tuple(bindings), apt_stage=named or STAGES[0],
        tactic=_is(str, item.get("tactic"), f"{rule_id}: tactic"), technique=_is(str, item.get("technique"), f"{rule_id}: technique"),
    )


def load_rules(path: str | Path) -> RuleSet:
    """Rules of a YAML file (a mapping with ``rules``) or a JSON file (the same, or a list)."""
    kind = Path(path).suffix.lower()
    if kind not in (".json", ".yaml", ".yml"):
        raise ValueError(f"neither a JSON nor a YAML file: {path}")
    got = read(path)
    if got is None:
        return RuleSet()
    if not isinstance(got, dict) and not (kind == ".json" and isinstance(got, list)):
        raise ValueError(f"{path}: the root must be a mapping with rules")
    items = got.get("rules") or [] if isinstance(got, dict) else got
    if not isinstance(items, list) or any(not isinstance(i, dict) for i in items):
        raise ValueError(f"{path}: rules must be a list of mappings")
    scoring = _is(dict, got.get("scoring"), "scoring") or {} if isinstance(got, dict) and kind != ".json" else {}
    rules = tuple(check([build(i, kind == ".json") for i in items]))
    return RuleSet(rules, float(_is((int, float), scoring.get("alpha", 1.0), "scoring.alpha")), "alpha" in scoring)


def infer_stage(rule: Rule) -> int:
    """The stage number: explicit, by the stage's name, or from what the rule says of events; else the first."""
    if rule.stage is not None and 1 <= rule.stage <= len(STAGES):
        return rule.stage
    if rule.apt_stage in STAGES:
        return STAGES.index(rule.apt_stage) + 1
    said = " ".join([(rule.event_predicate or {}).get("event_type", "") if isinstance(rule.event_predicate, dict) else "", rule.technique or "", rule.tactic or ""]).lower()
    for stage, words in ((2, ("proc_to_proc", "file_to_proc")), (3, ("proc_to_file", "proc_to_registry")), (5, ("file_to_ip", "proc_to_ip"))):
        if any(w in said for w in words):
            return stage
    return DEFAULT_STAGE


def infer_cvss(rule: Rule) -> float:
    return max(0.0, min(10.0, float(rule.severity if rule.cvss is None else rule.cvss)))


def link_kinds(left: Rule | None, right: Rule | None, policy: str = "union") -> frozenset[str]:
    """Kinds of links that a pair of rules asks for: the right one's, or both's."""
    if policy not in POLICIES:
        raise ValueError(f"unknown policy: {policy!r}")
    of = lambda r: set(r.prerequisites) if r else set()
    return frozenset(of(right) if policy == "dst_only" else of(left) | of(right))


def path_limit(left: Rule | None, right: Rule | None, policy: str = "union") -> int | None:
    """The smallest path factor limit that a pair of rules sets."""
    if policy not in POLICIES:
        raise ValueError(f"unknown policy: {policy!r}")
    limits = [r.max_path_factor for r in ((right,) if policy == "dst_only" else (left, right)) if r and r.max_path_factor is not None]
    return min(limits) if limits else None


def path_bindings(left: str, right: str, config: dict = PATH_BINDINGS) -> dict | None:
    """From and to which binding a pair's graph path runs: set directly, by pair, by right rule, by default."""
    if "from_binding" in config and "to_binding" in config:
        return config
    for found in (config.get("by_pair", {}).get(f"{left}->{right}"), config.get("by_right_rule_id", {}).get(right), config.get("default")):
        if isinstance(found, dict):
            return found
    return None


def load_allowlist(path: str | Path | None) -> set[tuple[str, str]] | None:
    """Pairs of rules whose graph paths count: ``a->b``, ``a,b``, [a, b] or a mapping; None allows all."""
    if path is None or str(path).strip().lower() in ("", "none"):
        return None
    got = read(path)
    got = got.get("allowlist", got.get("pairs", got)) if isinstance(got, dict) else got
    if got is not None and not isinstance(got, list):
        raise ValueError(f"{path}: the allowlist must be a list")
    out = set()
    for item in got or []:
        pair = None
        if isinstance(item, str):
            pair = item.split("->" if "->" in item else ",", 1)
        elif isinstance(item, list):
            pair = item
        elif isinstance(item, dict):
            pair = [next((item[k] for k in names if item.get(k)), None) for names in (("src", "left", "from"), ("dst", "right", "to"))]
        if pair and len(pair) == 2 and all(isinstance(x, str) for x in pair):
            out.add((pair[0].strip(), pair[1].strip()))
    return out


def allowed_pairs(rules: Iterable[Rule], kind: str, policy: str = "union", allowlist: set[tuple[str, str]] | None = None) -> list[tuple[str, str, int | None]]:
    """(left, right, path limit) of the rule pairs that can be linked by a kind; a table with at most a row a pair of rules."""
    rules = list(rules)
    return [(a.rule_id, b.rule_id, path_limit(a, b, policy)) for a in rules for b in rules if kind in link_kinds(a, b, policy) and (kind != "graph_path" or allowlist is None or (a.rule_id, b.rule_id) in allowlist)]


# ---- prefilter literals

# Words of rules that say nothing about a line.
PLAIN_WORDS = frozenset("sigma and or not count list literal object field_match selector_ref selector_group logical contains endswith startswith regex windash".split())


def _pieces(text: str, least: int) -> set[str]:
    out = {text}
    parts = [p for p in text.replace("\\", "/").split("/") if p] if "/" in text else []
    return out | set(parts[-1:])


def keywords(rules: Iterable[Rule], extra: Iterable[str] = ()) -> set[str]:
    """Texts of rules that a raw line may hold if it concerns them."""
    out = {x.lower() for x in extra}

    def walk(value) -> None:
        if isinstance(value, dict):
            for v in value.values():
                walk(v)
        elif isinstance(value, (list, tuple)):
            for v in value:
                walk(v)
        elif isinstance(value, str):
            text = value.strip().lower()
            if len(text) >= 3 and text not in PLAIN_WORDS:
                out.update(_pieces(text, 3))
                if ":" in text and len(rest := text.split(":", 1)[1].strip()) >= 3:
                    out.add(rest)

    for r in rules:
        walk([r.match_logic, r.event_predicate, list(r.entity_bindings), r.rule_id, r.name])
    return out


def markers(triplets: Iterable[tuple[str, str]]) -> set[str]:
    """Texts of a benign profile's subjects and objects that mark a raw line as benign."""
    out: set[str] = set()
    for ends in triplets:
        for e in ends:
            rest = e.split(":", 1)[-1].strip().lower()
            if len(rest) >= 4:
                out |= _pieces(rest, 4)
    return out


# ---- configuration


@dataclass(frozen=True)
class NoiseConfig:
    drop_rules: frozenset[str] = frozenset()
    drop_matches: frozenset[str] = frozenset()
    drop_links: frozenset[str] = frozenset()
    min_weight: float = 0.0
    min_path_factor: float = 0.0
    path_factor_op: str = "ge"
    model: str | None = None


def load_noise_config(path: str | Path | None) -> NoiseConfig:
    """What to drop, by a YAML or JSON file; nothing if there is none."""
    got = read(path) if path is not None and Path(path).exists() else None
    if got is None:
        return NoiseConfig()
    if not isinstance(got, dict) or not isinstance(got.get("drop", got), dict):
        raise ValueError("a noise configuration is a mapping, and so is its drop")
    drop = got.get("drop", got)

    def listed(name: str) -> frozenset[str]:
        found = next((drop[k] for k in (f"drop_{name}s", f"{name}s", name) if drop.get(k)), [])
        return frozenset(_names(found, name))

    def number(name: str) -> float:
        return float(_is((int, float), got.get(name, drop.get(name, 0.0)), name))

    op = str(got.get("path_factor_op", drop.get("path_factor_op", "ge"))).lower()
    if op not in ("ge", "le"):
        raise ValueError("path_factor_op is ge or le")
    return NoiseConfig(listed("rule_id"), listed("match_id"), listed("prerequisite_type"), number("min_graph_path_weight"), number("min_path_factor"), op, got.get("noise_model") or got.get("noise_model_path"))


def settings(defaults: dict, config: dict, given: dict, paths: dict[str, tuple[str, ...]]) -> dict:
    """Settings by name: what is given, unless it is the default and the configuration says otherwise."""
    out = dict(defaults) | given
    for name, keys in paths.items():
        at = config
        for k in keys:
            at = at.get(k) if isinstance(at, dict) else None
        if at is not None and (out.get(name) is None or out.get(name) == defaults.get(name)):
            out[name] = at
    return out


def check_sources(found: dict) -> dict:
    """A stream has exactly one source; Kafka needs its servers."""
    given = [n for n in ("events", "watch_dir", "kafka_topic") if found.get(n)]
    if len(given) != 1:
        raise ValueError(f"one source of events is needed, not {len(given)}")
    if given == ["kafka_topic"] and not found.get("kafka_bootstrap_servers"):
        raise ValueError("kafka_bootstrap_servers is missing")
    return found


@dataclass(frozen=True)
class Parameters:
    """Figures of an evaluation with where each comes from."""

    values: dict = field(default_factory=dict)
    sources: dict = field(default_factory=dict)


def load_parameters(paper: str | Path, assumed: str | Path | None = None, needed: Iterable[str] = ("stage_weights", "severity_map", "tau")) -> Parameters:
    """Published figures, and assumptions for those that aren't published; raises if one has neither."""
    published, other = read(paper) or {}, (read(assumed) or {}) if assumed else {}
    values, sources = {}, {}
    for name in needed:
        for said, where in ((published, "paper"), (other, "assumption")):
            if said.get(name) is not None and name not in values:
                values[name], sources[name] = said[name], where
    missing = [n for n in needed if n not in values]
    if missing:
        raise ValueError(f"no figure for {', '.join(missing)}")
    weights = values.get("stage_weights")
    if weights is not None and len(weights) != len(STAGES):
        raise ValueError(f"stage_weights has {len(weights)} entries, not {len(STAGES)}")
    return Parameters(values, sources)
