"""Scenario graph: matches linked by prerequisites, scored by connected scenario."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lineagram.functions.scalars import cvss, stage_severity
from lineagram.operators import links as ln
from lineagram.operators.graph import components
from lineagram.operators.rules import MOST_RULES, STAGES, Rule


def with_ids(matches: DataFrame) -> DataFrame:
    """Adds ``match_id`` and ``node`` (a number that orders matches), from the event and the rule alone: no global sort."""
    return matches.withColumn("match_id", F.concat(F.lit("m"), "seq", F.lit("-"), "rule_id")).withColumn("node", F.col("seq") * MOST_RULES + F.col("rule_order"))


def numbered(rows: DataFrame, *order: str, name: str = "number") -> DataFrame:
    """Adds consecutive numbers from 1 in an order over all rows, without gathering them: ranges are sorted apart, and only their sizes meet on the driver."""
    from lineagram.session import cut

    ranged = cut(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id()))
    part, within = F.shiftright("__at", 33), F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = {r[0]: r[1] for r in ranged.groupBy(part.alias("p")).count().collect()}
    before, table = 0, []
    for p in sorted(sizes):
        table += [F.lit(p), F.lit(before).cast("long")]
        before += sizes[p]
    if not table:
        return rows.withColumn(name, F.lit(None).cast("long"))
    return ranged.withColumn(name, F.element_at(F.create_map(*table), part) + within + 1).drop("__at")


def scenarios(matches: DataFrame, links: DataFrame) -> DataFrame:
    """Matches with ``scenario``, the smallest node of their component."""
    found = components(links.select("a", "b"))
    return matches.join(found, "node", "left").withColumn("scenario", F.coalesce("label", "node")).drop("label")


def build(events: DataFrame, matches: DataFrame, rules: list[Rule], most: int = 200, allowlist: set | None = None) -> tuple[DataFrame, DataFrame]:
    """(active matches with ``scenario``, graph path edges with ``scenario``): the scenario graph on the final provenance graph.

    A class's matches are in one scenario where their class has a path; pending matches are left out."""
    from lineagram.session import cut

    edges = cut(ln.graph_path_edges(events, matches, rules, most, allowlist=allowlist))
    kept = cut(ln.active(matches, rules, edges).where("active").drop("active"))
    ends = kept.select(F.col("node").alias("first"))
    live = edges.join(ends.withColumnRenamed("first", "src_node"), "src_node", "left_semi").join(ends.withColumnRenamed("first", "dst_node"), "dst_node", "left_semi")
    of_class = ln.with_first(kept, matches)
    touched = live.select(F.explode(F.array("src_node", "dst_node")).alias("first")).distinct()
    members = of_class.join(touched, "first").where("first != node").select(F.col("first").alias("a"), F.col("node").alias("b"))
    both = ln.star_links(kept, rules).union(live.select(F.least("src_node", "dst_node").alias("a"), F.greatest("src_node", "dst_node").alias("b")).where("a < b")).union(members)
    found = cut(scenarios(kept, both))
    return found, live.join(found.select(F.col("node").alias("src_node"), "scenario"), "src_node")


def path_sums(path_edges: DataFrame) -> DataFrame:
    """(scenario, paths, strength, mean_strength, multiplier): of graph path edges with ``links`` as their number."""
    n = F.coalesce(F.col("links"), F.lit(1))
    ok = path_edges.where("path_factor > 0")
    return ok.groupBy("scenario").agg(
        F.sum(n).alias("paths"), F.sum(n / F.col("path_factor")).alias("strength"), (F.sum(n / F.col("path_factor")) / F.sum(n)).alias("mean_strength"),
        F.least(F.lit(2.0), 1 + F.sum(n * F.log1p(1 / F.col("path_factor")))).alias("multiplier"),
    )


def legacy_scores(in_scenarios: DataFrame, rules: list[Rule], path_edges: DataFrame | None = None, alpha: float = 1.0) -> DataFrame:
    """(scenario, nodes, edges, structure, severity_sum, weighted, connectivity, multiplier).

    structure: nodes and half the links; weighted: severities and alpha times the paths' strengths; connectivity: one and
    the paths' mean strength.  Links are counted, not listed."""
    by = in_scenarios.groupBy("scenario").agg(F.count("*").alias("nodes"), F.sum("severity").alias("severity_sum"))
    got = by.join(ln.link_counts(in_scenarios, rules, "scenario"), "scenario", "left")
    if path_edges is not None:
        got = got.join(path_sums(path_edges), "scenario", "left")
    else:
        got = got.withColumns({"paths": F.lit(0).cast("long"), "strength": F.lit(0.0), "mean_strength": F.lit(0.0), "multiplier": F.lit(1.0)})
    return _legacy(got, alpha)


def _legacy(got: DataFrame, alpha: float) -> DataFrame:
    got = got.withColumn("edges", F.coalesce("links", F.lit(0)) + F.coalesce("paths", F.lit(0)))
    z = lambda c, d: F.coalesce(F.col(c), F.lit(d))
    return got.select(
        "scenario", "nodes", "edges", (F.col("nodes") + 0.5 * F.col("edges")).alias("structure"), "severity_sum", F.round(F.col("severity_sum") + alpha * z("strength", 0.0), 6).alias("weighted"),
        F.round(1 + z("mean_strength", 0.0), 6).alias("connectivity"), F.round(z("multiplier", 1.0), 6).alias("multiplier"),
    )


def scored(events: DataFrame, matches: DataFrame, rules: list[Rule], most: int | None = 200, allowlist: set | None = None, alpha: float = 1.0) -> DataFrame:
    """The legacy scores of the scenario graph that ``build`` makes, a host at a time in a worker: links and paths are summed there, not listed."""
    from lineagram.operators import classes as of_hosts

    asking, needy = set(ln._asks(rules, "shared_entity")), {r.rule_id for r in rules if r.prerequisites or r.prerequisite_ast}
    fields = {"scenario": pa.int64(), "nodes": pa.int64(), "severity_sum": pa.float64(), "links": pa.int64(), "paths": pa.int64(), "strength": pa.float64(), "logs": pa.float64()}

    def answer(host: str, h: of_hosts.Host) -> Iterator[pa.RecordBatch]:
        if not len(h.node):
            return
        p = of_hosts.Paths(h, rules, most, "union", allowlist, "object", "object", 0.0)
        c, size = p.classes, len(p.classes.first)
        is_in = lambda known: np.array([x in known for x in h.names], bool)[c.rule]
        asks, active = is_in(asking), ~is_in(needy)
        active |= _grouped(c, asks, np.ones(size, bool))[0]
        for a, b, _ in p.edges():
            ahead = c.first[a] < c.first[b]
            active[a[ahead]] = active[b[ahead]] = True
        linked, ends = _grouped(c, asks, active)
        label, sums = np.arange(size), {}
        label = _joined(label, *ends)
        for a, b, factor in p.edges():
            live = active[a] & active[b]
            a, b, factor = a[live], b[live], factor[live]
            if len(a):
                linked[a] = linked[b] = True
                label = _joined(label, a, b)
                for k in np.unique(factor).tolist():
                    mine = factor == k
                    sums[k] = sums.get(k, 0) + np.bincount(a[mine], (c.n[a] * c.n[b])[mine], size)
        # classes that are joined to nothing are a scenario a match
        alone = active & ~linked
        single = alone[c.of]
        one = np.zeros(int(single.sum()))
        severity = lambda x: np.where(np.isnan(x), 0.0, x)
        some, at = np.unique(label[active & linked], return_inverse=True)
        place = np.full(size, -1)
        place[active & linked] = at
        total = lambda values: np.bincount(place[place >= 0], values[place >= 0], len(some))
        links = _pairs(c, place, asks, len(some))
        paths, strength, logs = np.zeros(len(some)), np.zeros(len(some)), np.zeros(len(some))
        for k, n in sums.items():
            n = total(n)
            paths, strength, logs = paths + n, strength + n / k, logs + n * np.log1p(1 / k)
        heavy = np.bincount(c.of, severity(h.severity), size)
        columns = (
            np.concatenate([c.first[some], h.node[single]]), np.concatenate([total(c.n), one + 1]), np.concatenate([total(heavy), severity(h.severity[single])]), np.concatenate([links, one]),
            np.concatenate([paths, one]), np.concatenate([strength, one]), np.concatenate([logs, one]),
        )
        yield pa.RecordBatch.from_arrays([pa.array(x.astype(k.to_pandas_dtype()), k) for x, k in zip(columns, fields.values(), strict=True)], names=list(fields))

    got = of_hosts.by_host(events, matches.where("node is not null"), answer, "scenario long, nodes long, severity_sum double, links long, paths long, strength double, logs double")
    got = got.withColumn("mean_strength", F.when(F.col("paths") > 0, F.col("strength") / F.col("paths"))).withColumn("multiplier", F.least(F.lit(2.0), 1 + F.col("logs")))
    return _legacy(got, alpha)


def _grouped(c, asks: np.ndarray, some: np.ndarray) -> tuple[np.ndarray, tuple[np.ndarray, np.ndarray]]:
    """(classes whose matches have a shared-entity link, links that join them): groups with two matches of which one's rule asks."""
    linked, ends = np.zeros(len(some), bool), []
    for entity in (c.subject, c.object):
        mine = np.flatnonzero(some & (entity >= 0))
        _, at = np.unique(entity[mine], return_inverse=True)
        n = len(mine)
        low, high, asked = np.full(n, 1 << 62), np.full(n, -(1 << 62)), np.zeros(n, bool)
        hub = np.full(n, len(some))
        np.minimum.at(low, at, c.first[mine])
        np.maximum.at(high, at, c.last[mine])
        np.logical_or.at(asked, at, asks[mine])
        np.minimum.at(hub, at, mine)
        ok = (asked & (low < high))[at]
        linked[mine[ok]] = True
        ends.append((hub[at[ok]], mine[ok]))
    return linked, (np.concatenate([a for a, _ in ends]), np.concatenate([b for _, b in ends]))


def _joined(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest places of components, after links are added to those that labels hold."""
    label = label.copy()
    while True:
        x, y = label[a], label[b]
        apart = x != y
        if not apart.any():
            return label
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while True:
            up = label[label]
            if (up == label).all():
                break
            label = up


def _pairs(c, place: np.ndarray, asks: np.ndarray, size: int) -> np.ndarray:
    """How many shared-entity links there are in each scenario (see links.link_counts)."""
    links, base = np.zeros(size, np.int64), 1 + max(c.subject.max(initial=0), c.object.max(initial=0))
    for key, ok, sign in ((c.subject, c.subject >= 0, 1), (c.object, c.object >= 0, 1), (c.subject * base + c.object, (c.subject >= 0) & (c.object >= 0), -1)):
        mine = np.flatnonzero(ok & (place >= 0))
        _, first, at = np.unique(key[mine], return_index=True, return_inverse=True)
        # matches with an entity in common that aren't linked may be in different scenarios
        both = np.unique(np.stack([at, place[mine]]), axis=1, return_inverse=True) if len(mine) else (np.zeros((2, 0), np.int64), np.zeros(0, np.int64))
        (_, where), at = both[0], both[1].reshape(-1)
        n, m = (np.bincount(at, w, len(where)).astype(np.int64) for w in (c.n[mine], (c.n * ~asks)[mine]))
        np.add.at(links, where, sign * (n * (n - 1) - m * (m - 1)) // 2)
    return links


def threat_tuple(in_scenarios: DataFrame) -> DataFrame:
    """(scenario, s1 .. s7): the largest CVSS of each stage; matches without a stage count to the first."""
    points = F.coalesce(cvss(F.col("cvss")) if "cvss" in in_scenarios.columns else F.col("severity"), F.col("severity"))
    stage = F.greatest(F.lit(1), F.least(F.lit(len(STAGES)), F.coalesce(F.col("stage"), F.lit(1))))
    return in_scenarios.withColumns({"__s": stage, "__p": points}).groupBy("scenario").agg(*[F.max(F.when(F.col("__s") == i, F.col("__p"))).alias(f"s{i}") for i in range(1, len(STAGES) + 1)])


def _multiplied(scores: DataFrame, name: str, path_edges: DataFrame | None) -> DataFrame:
    if path_edges is None:
        return scores
    got = scores.join(path_sums(path_edges).select("scenario", "multiplier"), "scenario", "left")
    return got.select("scenario", F.round(F.col(name) * F.coalesce("multiplier", F.lit(1.0)), 6).alias(name))


def paper_scores(in_scenarios: DataFrame, weights: tuple[float, ...] = (1.0,) * len(STAGES), path_edges: DataFrame | None = None) -> DataFrame:
    """(scenario, paper_score): the product over stages of (1 + S / 10) to the stage's weight, S between 0 and 10, times the paths' multiplier."""
    t = threat_tuple(in_scenarios)
    points = lambda i: F.greatest(F.lit(0.0), F.least(F.lit(10.0), F.coalesce(F.col(f"s{i}"), F.lit(0.0))))
    log = sum((w * F.log(1 + points(i + 1) / 10) for i, w in enumerate(weights)), F.lit(0.0))
    return _multiplied(t.select("scenario", F.round(F.exp(log), 6).alias("paper_score")), "paper_score", path_edges)


def exact_scores(in_scenarios: DataFrame, weights: tuple[float, ...] = (1.0,) * len(STAGES), path_edges: DataFrame | None = None) -> DataFrame:
    """(scenario, exact_score): the product of the stages' points (2, 6, 8 or 10 by their largest CVSS, 1 for stages not seen) to their weights, times the paths' multiplier."""
    t = threat_tuple(in_scenarios)
    log = sum((w * F.log(F.when(F.col(f"s{i + 1}").isNull(), 1.0).otherwise(stage_severity(F.col(f"s{i + 1}")))) for i, w in enumerate(weights)), F.lit(0.0))
    return _multiplied(t.select("scenario", F.round(F.exp(log), 6).alias("exact_score")), "exact_score", path_edges)


def first_detection(in_scenarios: DataFrame, tau: float) -> DataFrame:
    """(scenario, detect_seq, score): the first match at which the exact score so far reaches tau."""
    so_far = Window.partitionBy("scenario").orderBy("node").rowsBetween(Window.unboundedPreceding, 0)
    points = stage_severity(F.col("cvss") if "cvss" in in_scenarios.columns else F.col("severity"))
    log = sum((F.log(F.coalesce(F.max(F.when(F.coalesce("stage", F.lit(1)) == i, points)).over(so_far), F.lit(1.0))) for i in range(1, len(STAGES) + 1)), F.lit(0.0))
    hit = in_scenarios.withColumn("score", F.round(F.exp(log), 6)).where(F.col("score") >= tau)
    return hit.groupBy("scenario").agg(F.min("seq").alias("detect_seq"), F.min_by("score", "node").alias("score"))


def top(scores: DataFrame, score: str, k: int = 3, empty: float = 0.0) -> DataFrame:
    """(place, scenario, score, nodes, edges): the k highest, filled up to k with empty scenarios."""
    found = scores.orderBy(F.desc(score), F.desc("nodes"), F.desc("edges"), "scenario").limit(k)
    rows = found.select("scenario", F.col(score).cast("double").alias("score"), "nodes", "edges")
    fill = scores.sparkSession.range(k).select(F.lit(None).cast(scores.schema["scenario"].dataType).alias("scenario"), F.lit(float(empty)).alias("score"), F.lit(0).cast("long").alias("nodes"), F.lit(0).cast("long").alias("edges"))
    both = rows.withColumn("__fill", F.lit(0)).union(fill.withColumn("__fill", F.lit(1)))
    order = Window.orderBy("__fill", F.desc("score"), F.desc("nodes"), F.desc("edges"), "scenario")  # over at most 2 k rows
    return both.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k).select("place", "scenario", "score", "nodes", "edges")


def alerts(in_scenarios: DataFrame, threshold: float = 80.0, delta: float = 10.0) -> DataFrame:
    """(scenario, seq, node, total, stages): matches at which a scenario raises an alert.

    Its running severity is at the threshold or over, and it has risen by delta since its last alert, or a stage is there
    that wasn't at its last alert.  What counts is the last alert, so a scenario's matches stream through in order and
    only its last score and stages are held."""
    order = Window.partitionBy("scenario").orderBy("node").rowsBetween(Window.unboundedPreceding, 0)
    stage = F.greatest(F.lit(1), F.least(F.lit(len(STAGES)), F.coalesce(F.col("stage"), F.lit(1)))).cast("int")
    kind = dict(in_scenarios.dtypes)["scenario"]
    rows = in_scenarios.select("scenario", "seq", "node", F.sum("severity").over(order).alias("total"), stage.alias("stage")).repartition("scenario").sortWithinPartitions("scenario", "node")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, last, seen, told = None, None, set(), set()
        for batch in batches:
            out = []
            for scenario, seq, node, total, at in batch.itertuples(index=False):
                if scenario != now:
                    now, last, seen, told = scenario, None, set(), set()
                seen.add(at)
                if total >= threshold and (last is None or total - last >= delta or not seen <= told):
                    last, told = total, set(seen)
                    out.append((scenario, seq, node, total, len(seen)))
            yield pd.DataFrame(out, columns=["scenario", "seq", "node", "total", "stages"])

    return rows.mapInPandas(run, f"scenario {kind}, seq long, node long, total double, stages long")


def best_alerts(raised: DataFrame) -> DataFrame:
    """One alert of each scenario: the highest, then that with more stages, then the earliest."""
    order = Window.partitionBy("scenario").orderBy(F.desc("total"), F.desc("stages"), "node")
    return raised.withColumn("place", F.row_number().over(order)).where("place = 1").drop("place")


def dormant(in_scenarios: DataFrame, gap_seconds: int) -> DataFrame:
    """(scenario, last_seen): scenarios without a match for longer than the gap at the newest match of all."""
    last = in_scenarios.groupBy("scenario").agg(F.max("ts").alias("last_seen"))
    now = in_scenarios.agg(F.max("ts").alias("now"))
    return last.join(F.broadcast(now), F.unix_seconds(F.col("now").cast("timestamp")) - F.unix_seconds(F.col("last_seen").cast("timestamp")) > gap_seconds).select("scenario", "last_seen")


# ---- capacities


def over_capacity(rows: DataFrame, most: int, *order: F.Column | str, by: tuple[str, ...] = ("host",)) -> DataFrame:
    """Rows beyond a capacity, those that come first in the order; what isn't returned stays."""
    n = F.count("*").over(Window.partitionBy(*by))
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    return rows.withColumns({"__n": n, "__r": rank}).where(F.col("__r") <= F.col("__n") - most).drop("__n", "__r")


def evict_pending(pending: DataFrame, most: int) -> DataFrame:
    """Pending matches that go beyond a capacity: those of the lowest stage, then the longest without activity."""
    return over_capacity(pending, most, F.coalesce("stage", F.lit(1)), "ts", "node")


def evict_active(matches: DataFrame, degrees: DataFrame, most: int) -> DataFrame:
    """Active matches that go beyond a capacity: those with the fewest links, then of the lowest stage, then the oldest; degrees: node, degree."""
    return over_capacity(matches.join(degrees, "node", "left").fillna({"degree": 0}), most, "degree", F.coalesce("stage", F.lit(1)), "ts", "node").drop("degree")


def evict_edges(edges: DataFrame, most: int) -> tuple[DataFrame, DataFrame]:
    """(edges that go beyond a capacity, nodes that are closed with them): graph paths of the smallest weight first, then the oldest ends."""
    gone = over_capacity(edges, most, F.when(F.col("relation") == "graph_path", 0).otherwise(1), F.coalesce("weight", F.lit(0.0)), F.greatest("src_node", "dst_node"), "src_node", "dst_node")
    return gone, gone.select(F.explode(F.array("src_node", "dst_node")).alias("node")).distinct()


def evict_paths(edges: DataFrame, most: int) -> DataFrame:
    """Graph path edges that go beyond a capacity: the smallest weight, then the longest unseen (``last_seen``)."""
    return over_capacity(edges.where("relation = 'graph_path'"), most, F.coalesce("weight", F.lit(0.0)), "last_seen", "src_node", "dst_node")


def among(edges: DataFrame, kept: DataFrame) -> DataFrame:
    """Edges whose ends are both among kept nodes."""
    return edges.join(kept.select(F.col("node").alias("src_node")), "src_node", "left_semi").join(kept.select(F.col("node").alias("dst_node")), "dst_node", "left_semi")


def activated(pending: DataFrame, active: DataFrame, reach: DataFrame) -> DataFrame:
    """Pending matches of which an entity flows into an entity of an active one; reach: host, src, dst."""
    ends = lambda m: m.select("host", "node", F.explode(F.array_compact(F.array("subject", "object"))).alias("entity"))
    up = reach.join(ends(active).select("host", F.col("entity").alias("dst")).distinct(), ["host", "dst"], "left_semi").select("host", F.col("src").alias("entity")).distinct()
    return pending.join(ends(pending).join(up, ["host", "entity"], "left_semi").select("node").distinct(), "node", "left_semi")
