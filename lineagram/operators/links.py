"""Links between matches: prerequisites of rules over shared entities, graph paths and node states.

Matches with one rule, subject and object are a class: links between classes stand for
those between their matches, so what is emitted never grows with the square of a busy
entity.  Numbers of links are counted from the sizes of groups.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lineagram.functions.scalars import entity_payload, entity_prefix, path_factor_passes
from lineagram.operators import hosts, paths
from lineagram.operators.rules import Rule
from lineagram.operators.ruleset import allowed_pairs

# Prefixes of the outside, endings of programs, registry places that start programs.
EXTERNAL = ("ip", "web", "dns", "url", "cloudapi", "cloudid", "net")
EXECUTABLE = (".exe", ".dll", ".sys", ".bat", ".cmd", ".ps1", ".js", ".vbs", ".hta", ".com", ".scr")
ASEP = ("\\currentversion\\run", "\\currentversion\\runonce", "\\services\\", "\\image file execution options\\", "\\shell folders", "\\user shell folders", "\\specialaccounts\\userlist", "\\winlogon\\")
#: Symbols that stand for one of the match's own entities, by the prefix these must have.
OWN_SYMBOLS = {"$current_process": "proc", "$current_process_image": "file", "$current_file": "file", "$target_file": "file", "$target_registry_key": "reg", "$remote_ip": "ip", "External_IP_Node": "ip"}


def _asks(rules: Iterable[Rule], kind: str) -> list[str]:
    return [r.rule_id for r in rules if kind in r.prerequisites]


def shared_entity_edges(matches: DataFrame, rules: list[Rule]) -> DataFrame:
    """(host, role, entity, rule_a, rule_b, links): how many pairs of matches with the entity in one role are linked, by their rules in the order of names.

    A pair is linked if either rule asks for a shared entity."""
    asks = _asks(rules, "shared_entity")
    by = _held(matches).groupBy("host", "role", "entity", "rule_id").agg(F.count("*").alias("n"))
    side = lambda x: by.select("host", "role", "entity", F.col("rule_id").alias(f"rule_{x}"), F.col("n").alias(f"n_{x}"))
    both = side("a").join(side("b"), ["host", "role", "entity"]).where(F.col("rule_a") <= F.col("rule_b")).where(F.col("rule_a").isin(*asks) | F.col("rule_b").isin(*asks))
    n = F.when(F.col("rule_a") == F.col("rule_b"), F.col("n_a") * (F.col("n_a") - 1) / 2).otherwise(F.col("n_a") * F.col("n_b")).cast("long")
    return both.select("host", "role", "entity", "rule_a", "rule_b", n.alias("links")).where("links > 0")


def _held(matches: DataFrame) -> DataFrame:
    roles = F.array(*[F.struct(F.lit(r).alias("role"), F.col(r).alias("entity")) for r in ("subject", "object")])
    return matches.select("host", "node", "rule_id", F.explode(roles).alias("r")).select("host", "node", "rule_id", "r.role", "r.entity").where("entity is not null")


def link_counts(matches: DataFrame, rules: list[Rule], by: str) -> DataFrame:
    """(by, links): exact number of shared-entity links among the matches of each value of a column that linked matches share.

    Pairs that share both entities count once: those that share the subject, and the object, less those that share both."""
    asks = F.col("rule_id").isin(*_asks(rules, "shared_entity"))
    parts = []
    for keys, sign in ((["subject"], 1), (["object"], 1), (["subject", "object"], -1)):
        n = matches.where(" and ".join(f"{k} is not null" for k in keys)).groupBy(by, "host", *keys).agg(F.count("*").alias("n"), F.sum((~asks).cast("long")).alias("m"))
        pairs = (F.col("n") * (F.col("n") - 1) - F.col("m") * (F.col("m") - 1)) / 2
        parts.append(n.select(by, (pairs * sign).cast("long").alias("links")))
    return parts[0].union(parts[1]).union(parts[2]).groupBy(by).agg(F.sum("links").alias("links"))


def star_links(matches: DataFrame, rules: list[Rule] | None = None) -> DataFrame:
    """(a, b): the same components as all shared-entity links, one link a match and role.

    Matches of a group are linked to its first match whose rule asks for it; without rules, to its first match."""
    held = _held(matches)
    asks = F.lit(True) if rules is None else F.col("rule_id").isin(*_asks(rules, "shared_entity"))
    hub = held.where(asks).groupBy("host", "role", "entity").agg(F.min("node").alias("hub"))
    got = held.join(hub, ["host", "role", "entity"]).where("hub != node")
    return got.select(F.least("hub", "node").alias("a"), F.greatest("hub", "node").alias("b")).distinct()


def classes(matches: DataFrame) -> DataFrame:
    """(host, rule_id, subject, object, n, first, last): matches that are alike."""
    return matches.groupBy("host", "rule_id", "subject", "object").agg(F.count("*").alias("n"), F.min("node").alias("first"), F.max("node").alias("last"))


def with_first(some: DataFrame, matches: DataFrame) -> DataFrame:
    """Some of the matches with the ``first`` of their class; ends that are null are alike."""
    keys = ["host", "rule_id", "subject", "object"]
    c = classes(matches).select(*[F.col(k).alias(f"__{k}") for k in keys], "first")
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"__{k}"))
    return some.join(c, same).drop(*[f"__{k}" for k in keys])


def candidates(matches: DataFrame, rules: list[Rule], kind: str = "graph_path", most: int = 200, policy: str = "union", allowlist: set | None = None) -> DataFrame:
    """(host, left, right, place, ..): classes that may be linked by a kind: with an entity in common and rules that ask for it, the earlier one left.

    A class has at most ``most`` candidates an entity, the latest before it, and ``most`` in all, those with more
    entities in common first, then by the class's first match: the ranking keeps what the scenario graph asks for bounded."""
    pairs = allowed_pairs(rules, kind, policy, allowlist)
    spark = matches.sparkSession
    table = spark.createDataFrame(pairs, "rule_left string, rule_right string, path_limit int") if pairs else spark.createDataFrame([], "rule_left string, rule_right string, path_limit int")
    known = sorted({r for p in pairs for r in p[:2]})
    c = classes(matches.where(F.col("rule_id").isin(*known) if known else F.lit(False)))
    one = F.struct("rule_id", "subject", "object", "n", "first")
    held = c.select("host", one.alias("c"), F.explode(F.array_distinct(F.array_compact(F.array("subject", "object")))).alias("entity"))
    before = Window.partitionBy("host", "entity").orderBy("c.first", "c.rule_id", "c.subject", "c.object").rowsBetween(-most, -1)
    met = held.withColumn("lefts", F.collect_list("c").over(before)).withColumn("left", F.explode("lefts")).select("host", "left", F.col("c").alias("right"), "entity")
    met = met.groupBy("host", "left", "right").agg(F.count_distinct("entity").alias("common"))
    met = met.join(table, (F.col("left.rule_id") == F.col("rule_left")) & (F.col("right.rule_id") == F.col("rule_right")), "inner").drop("rule_left", "rule_right")
    rank = F.row_number().over(Window.partitionBy("host", "right").orderBy(F.desc("common"), "left.first", "left.rule_id", "left.subject", "left.object"))
    return met.withColumn("place", rank).where(F.col("place") <= most)


def ranked(matches: DataFrame, rules: list[Rule], kind: str = "graph_path", most: int = 200, policy: str = "union", allowlist: set | None = None) -> DataFrame:
    """(host, left_node, right_node, common, place): candidates as above, classes named by their first match.

    A host's classes are shuffled once and paired in a worker, which passes pairs on as they are made."""
    pairs = {(a, b) for a, b, _ in allowed_pairs(rules, kind, policy, allowlist)}
    known = sorted({r for p in pairs for r in p})
    code = {r: i for i, r in enumerate(known)}
    allowed = np.array([[(a, b) in pairs for a in known] for b in known], bool).reshape(len(known), len(known))
    fields = (("host", pa.string()), ("left_node", pa.int64()), ("right_node", pa.int64()), ("common", pa.int64()), ("place", pa.int32()))

    def of_host(host: str | None, rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        rows.sort(key=lambda r: (r[0], r[1], r[2] is not None, r[2] or "", r[3] is not None, r[3] or ""))
        first, rule = np.array([r[0] for r in rows], np.int64), np.array([code[r[1]] for r in rows], np.int64)
        ends = [[e for e in dict.fromkeys(r[2:]) if e is not None] for r in rows]
        of: dict[str, list[int]] = {}
        for i, some in enumerate(ends):
            for e in some:
                of.setdefault(e, []).append(i)
        held, seen = {e: np.array(x) for e, x in of.items()}, dict.fromkeys(of, 0)
        out: list[tuple[np.ndarray, np.ndarray, int]] = []
        size = 0

        def batch() -> pa.RecordBatch:
            left = np.concatenate([x for x, _, _ in out])
            n = [len(x) for x, _, _ in out]
            place = np.concatenate([np.arange(1, k + 1) for k in n])
            cols = [pa.array([host], pa.string()).take(pa.array(np.zeros(len(left), np.int64))), first[left], np.repeat(first[[i for _, _, i in out]], n), np.concatenate([c for _, c, _ in out]), place]
            return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, k) for c, (_, k) in zip(cols, fields, strict=True)], names=[f for f, _ in fields])

        for i, some in enumerate(ends):
            lefts = []
            for e in some:
                x = held[e][max(0, seen[e] - most) : seen[e]]
                lefts.append(x[allowed[rule[i]][rule[x]]])
                seen[e] += 1
            # classes are in the order of the ranking
            left = lefts[0] if lefts else np.zeros(0, np.int64)
            common = np.ones(len(left), np.int64)
            if len(lefts) == 2 and len(lefts[1]):
                left, common = np.unique(np.concatenate(lefts), return_counts=True)
                order = np.argsort(-common, kind="stable")
                left, common = left[order], common[order]
            if len(left):
                out.append((left[:most], common[:most], i))
                size += len(out[-1][0])
            if size > 1 << 19:
                yield batch()
                out, size = [], 0
        if out:
            yield batch()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        host, rows = None, []
        for b in batches:
            for h, *row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if h != host:
                    yield from of_host(host, rows)
                    host, rows = h, []
                rows.append(tuple(row))
        yield from of_host(host, rows)

    mine = matches.where("host is not null").where(F.col("rule_id").isin(*known) if known else F.lit(False)).select("host", "rule_id", "subject", "object", "node").repartition("host")
    c = classes(mine).select("host", "first", "rule_id", "subject", "object").sortWithinPartitions("host")
    return c.mapInArrow(run, "host string, left_node long, right_node long, common long, place int")


def graph_path_edges(events: DataFrame, matches: DataFrame, rules: list[Rule], most: int | None = 200, policy: str = "union", allowlist: set | None = None, from_binding: str = "object", to_binding: str = "object", limit: float = 0.0) -> DataFrame:
    """(host, src_node, dst_node, src_rule, dst_rule, relation, path_factor, weight, links): graph paths between classes, both ways.

    src_node and dst_node are the classes' first matches, links the number of pairs of matches.  Each pair of entities is
    asked about once; the weight and strength of a path are one over its factor.  most: candidates of a class as above,
    None for all.  A host's events and matches are shuffled once, and its paths passed on as they are made."""
    from lineagram.operators import classes as of_hosts

    known = of_hosts.ruled(allowed_pairs(rules, "graph_path", policy, allowlist))

    def answer(host: str, h: of_hosts.Host) -> Iterator[pa.RecordBatch]:
        p = of_hosts.Paths(h, rules, most, policy, allowlist, from_binding, to_binding, limit)
        first, n = p.classes.first, p.classes.n
        for a, b, factor in p.edges():
            at = pa.array([host], pa.string()).take(pa.array(np.zeros(len(a), np.int64)))
            cols = (first[a], first[b], p.rule[a].astype(np.int16), p.rule[b].astype(np.int16), factor, n[a] * n[b])
            yield pa.RecordBatch.from_arrays([at, *map(pa.array, cols)], names=["host", "src_node", "dst_node", "src", "dst", "path_factor", "links"])

    some = matches.where(F.col("rule_id").isin(*known) if known else F.lit(False))
    got = of_hosts.by_host(events, some, answer, "host string, src_node long, dst_node long, src short, dst short, path_factor long, links long")
    name = lambda c: F.element_at(F.array(*map(F.lit, known or [""])), F.col(c) + 1)
    return got.select("host", "src_node", "dst_node", name("src").alias("src_rule"), name("dst").alias("dst_rule"), F.lit("graph_path").alias("relation"), F.col("path_factor").cast("double").alias("path_factor"), (1.0 / F.col("path_factor")).alias("weight"), "links")


def cheap_candidates(met: DataFrame, reach: DataFrame) -> DataFrame:
    """Candidates whose entities share a prefix or of which one of the left reaches one of the right; reach: host, src, dst."""
    ends = lambda c: F.array_compact(F.array(f"{c}.subject", f"{c}.object"))
    alike = F.arrays_overlap(F.transform(ends("left"), entity_prefix), F.transform(ends("right"), entity_prefix))
    rest = met.where(~alike)
    asked = rest.withColumn("src", F.explode(ends("left"))).withColumn("dst", F.explode(ends("right")))
    linked = asked.join(reach.select("host", "src", "dst").distinct(), ["host", "src", "dst"], "left_semi").select(*met.columns).distinct()
    return met.where(alike).union(linked)


def active(matches: DataFrame, rules: list[Rule], path_edges: DataFrame | None = None) -> DataFrame:
    """Matches with ``active``: their rule asks for nothing, or a link begins at them or comes to them from an earlier match.

    The others are pending.  A link that only comes back to a match from a later one leaves it pending."""
    needy = [r.rule_id for r in rules if r.prerequisites or r.prerequisite_ast]
    linked = star_links(matches, rules).select(F.explode(F.array("a", "b")).alias("node")).distinct()
    if path_edges is not None:
        # a class stands for its matches: the later end, and the start of a forward link
        ends = path_edges.select("host", F.explode(F.array(F.struct(F.col("src_node").alias("first"), (F.col("src_node") < F.col("dst_node")).alias("ok")), F.struct(F.col("dst_node").alias("first"), (F.col("src_node") < F.col("dst_node")).alias("ok")))).alias("e")).where("e.ok").select("host", "e.first").distinct()
        more = with_first(matches, matches).join(ends, ["host", "first"], "left_semi").select("node")
        linked = linked.union(more).distinct()
    got = matches.join(linked.withColumn("__linked", F.lit(True)), "node", "left")
    return got.withColumn("active", ~F.col("rule_id").isin(*needy) | F.coalesce("__linked", F.lit(False))).drop("__linked")


# ---- conditions


def node_state(entity: Column, attribute: str, expected: bool, privileges: dict[str, Column] | None = None) -> Column:
    """Whether an entity is as expected: is_executable, is_asep_key, or one of the privileges given as columns."""
    prefix, payload = entity_prefix(entity), F.lower(F.when(F.contains(entity, F.lit(":")), entity_payload(entity)).otherwise(""))
    any_of = lambda tests: F.greatest(*[t.cast("int") for t in tests]) > 0
    if attribute == "is_executable":
        actual = (prefix == "proc") | any_of([F.endswith(payload, F.lit(x)) for x in EXECUTABLE])
    elif attribute == "is_asep_key":
        actual = (prefix == "reg") & any_of([F.contains(payload, F.lit(x)) for x in ASEP])
    elif privileges is not None and attribute in privileges:
        actual = F.coalesce(privileges[attribute], F.lit(False))
    elif attribute in ("has_elevated_privilege", "has_system_integrity", "has_root_euid", "has_high_integrity"):
        actual = F.lit(False)
    else:
        return F.lit(False)
    return F.coalesce((actual == F.lit(bool(expected))) & entity.isNotNull(), F.lit(False))


def own_symbol(symbol: str, bindings: Column) -> Column | None:
    """The entity of the match itself that a symbol stands for; None for symbols that stand for others'."""
    at = lambda k: F.try_element_at(bindings, F.lit(k))
    if symbol in OWN_SYMBOLS:
        order = (symbol, "subject", "object") if symbol == "$current_process" else (symbol, "object", "subject")
        fits = [F.when(entity_prefix(at(k)) == OWN_SYMBOLS[symbol], at(k)) for k in order]
        return F.coalesce(at(symbol), *fits)
    if symbol == "$current_event_source":
        return F.coalesce(at(symbol), at("subject"), at("object"))
    if symbol in ("Compromised_Process", "Untrusted_External_Node"):
        return None
    return at(symbol)


def _symbol_parts(matches: DataFrame, symbol: str, tainted: DataFrame | None, entities: DataFrame) -> tuple[DataFrame, DataFrame | None, DataFrame | None]:
    """(node, entity) of matches that have a candidate of a symbol of their own; matches without, and their hosts' candidates, if it stands for others."""
    own = own_symbol(symbol, F.col("bindings"))
    base = matches.select("host", "node", "seq", "bindings")
    if own is not None and symbol != "External_IP_Node":
        return base.select("host", "node", own.alias("entity")).where("entity is not null"), None, None
    given = base.select("host", "node", F.try_element_at("bindings", F.lit(symbol)).alias("entity")).where("entity is not null")
    if symbol == "Compromised_Process":
        if tainted is None:
            return given, None, None
        return given, base.join(given.select("node"), "node", "left_anti"), tainted.where(entity_prefix(F.col("entity")) == "proc").where("tainted_seq is not null").select("host", "entity", "tainted_seq")
    first = base.select("host", "node", own.alias("entity")).where("entity is not null") if own is not None else given
    wanted = ("ip",) if symbol == "External_IP_Node" else EXTERNAL
    theirs = entities.where(entity_prefix(F.col("entity")).isin(*wanted)).select("host", "entity", F.lit(None).cast("long").alias("tainted_seq"))
    return first, base.join(first.select("node"), "node", "left_anti"), theirs


def _symbol_table(matches: DataFrame, symbol: str, tainted: DataFrame | None, entities: DataFrame) -> DataFrame:
    """(host, node, entity): the candidates of a symbol for each match."""
    own, rest, theirs = _symbol_parts(matches, symbol, tainted, entities)
    if rest is None:
        return own
    return own.union(rest.join(theirs, "host").where("tainted_seq is null or tainted_seq <= seq").select("host", "node", "entity"))


def _candidates_met(matches: DataFrame, symbol: str, tainted: DataFrame | None, entities: DataFrame, test: Column) -> DataFrame:
    """(node): matches of which a symbol's candidate meets a test of it alone: of a host's candidates only the earliest counts, none is listed a match."""
    own, rest, theirs = _symbol_parts(matches, symbol, tainted, entities)
    met = own.where(test).select("node")
    if rest is not None:
        first = theirs.where(test).groupBy("host").agg(F.min("tainted_seq").alias("tainted_seq"))
        met = met.union(rest.join(first, "host").where("tainted_seq is null or tainted_seq <= seq").select("node"))
    return met.distinct()


def evaluate(matches: DataFrame, rules: list[Rule], events: DataFrame, tainted: DataFrame | None = None, settings: dict | None = None) -> DataFrame:
    """Matches (with ``bindings``) of rules with a prerequisite tree, with ``satisfied``; rules without one are satisfied.

    A tree is conditions under AND or OR.  Candidates of a symbol are the match's own entity, the tainted processes of its
    host up to then, or the host's outside entities; a condition holds if some pair of candidates meets it.  Each pair of
    entities is asked about once, over the whole graph."""
    from lineagram.session import cut

    settings = settings or {}
    entities = events.select("host", F.explode(F.array("subject", "object")).alias("entity")).where("entity is not null").distinct()
    flags = matches.sparkSession.createDataFrame([], "node long, condition int")
    trees = [(r, r.prerequisite_ast) for r in rules if isinstance(r.prerequisite_ast, dict)]
    for r, tree in trees:
        mine = matches.where(F.col("rule_id") == r.rule_id)
        for i, c in enumerate(x for x in tree.get("conditions") or [] if isinstance(x, dict)):
            met = _met(mine, c, events, tainted, entities, settings)
            if met is not None:
                flags = flags.union(met.select("node", F.lit(i).alias("condition")))
    held = cut(flags.distinct()).groupBy("node").agg(F.count("*").alias("__n"))
    ok = F.lit(True)
    for r, tree in trees:
        conditions = [x for x in tree.get("conditions") or [] if isinstance(x, dict)]
        how, n = str(tree.get("operator", "AND")).upper(), F.coalesce("__n", F.lit(0))
        test = {"AND": n == len(conditions), "OR": n > 0}.get(how, F.lit(False)) if tree.get("conditions") else F.lit(True)
        if how == "AND" and tree.get("conditions") and not conditions:
            test = F.lit(False)
        ok = F.when(F.col("rule_id") == r.rule_id, test).otherwise(ok)
    return matches.join(held, "node", "left").withColumn("satisfied", ok).drop("__n")


def _met(matches: DataFrame, c: dict, events: DataFrame, tainted, entities: DataFrame, settings: dict) -> DataFrame | None:
    """(node): matches that meet a condition; None for kinds that nothing meets."""
    kind, table = str(c.get("type") or "").lower(), lambda s: _symbol_table(matches, str(c.get(s, "")), tainted, entities)
    if kind == "event_existence":
        return _candidates_met(matches, str(c.get("target_node", "")), tainted, entities, F.lit(True))
    if kind == "node_state":
        test = node_state(F.col("entity"), str(c.get("attribute") or "").lower(), bool(c.get("expected_value")), settings.get("privileges"))
        return _candidates_met(matches, str(c.get("target_node", "")), tainted, entities, test)
    if kind not in ("path_factor", "relation_check"):
        return None
    both = table("source_node").withColumnRenamed("entity", "x").join(table("target_node").select("node", F.col("entity").alias("y")), "node")
    if kind == "path_factor":
        said = c.get("threshold")
        limit = float(settings.get("path_thres", 0.0)) if said == "path_thres" else float(said) if isinstance(said, (int, float)) or str(said).replace(".", "", 1).isdigit() else 0.0
        op = {">=": "ge", "<=": "le"}.get(str(c.get("op") or settings.get("path_factor_op", "ge")).lower(), str(c.get("op") or settings.get("path_factor_op", "ge")).lower())
        pf = paths.path_factors(events, both.select("host", "x", "y").distinct())
        good = pf.where(path_factor_passes(F.col("path_factor"), F.lit(limit), op))
    else:
        from lineagram.operators.state import with_relations

        said = str(c.get("relation") or "relation_check").strip().lower()
        back, told = said == "spawned_by", with_relations(events)
        pairs = both.select("host", *((F.col("y").alias("a"), F.col("x").alias("b")) if back else (F.col("x").alias("a"), F.col("y").alias("b")))).distinct()
        ask = lambda *columns: pairs.select("host", F.col("a").alias("start"), *columns)
        none = F.lit(None).cast("long").alias("seq")
        token = F.regexp_extract("a", "#v([0-9]+)$", 1).try_cast("int").alias("version")
        begin = ask(F.regexp_replace("a", "#v[0-9]+$", "").alias("entity"), token, none, F.lit(False).alias("goal")).distinct()
        goal = ask(F.col("b").alias("entity"), F.lit(None).cast("int").alias("version"), none, F.lit(True).alias("goal"))
        # only pairs that are asked about leave a host's worker
        reached = hosts.reached(told, begin.union(goal), [said]).select("host", F.col("start").alias("a"), F.col("entity").alias("b"))
        good = pairs.join(reached, ["host", "a", "b"]).select("host", *((F.col("b").alias("x"), F.col("a").alias("y")) if back else (F.col("a").alias("x"), F.col("b").alias("y"))))
    return both.join(good.select("host", "x", "y"), ["host", "x", "y"], "left_semi").select("node").distinct()

