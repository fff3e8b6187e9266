"""Paths between entities: common ancestors, path factors, distances.

A host's newest reaches are held entity by entity (see graph.entity_reach), and for
path factors also those of every version, so a host's part of the graph must fit a
worker: at size, hosts are cut by day first (``host`` may be any such key).
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lineagram.operators.graph import flow, touches


def _steps(events: DataFrame) -> DataFrame:
    """(host, seq, src, dst, bumped): each event's flow and the entities that get new versions."""
    bumped = touches(events).where("bump = 1").groupBy("host", "seq").agg(F.array_sort(F.collect_set("entity")).alias("bumped"))
    return flow(events).select("host", "seq", "src", "dst").join(bumped, ["host", "seq"])


def _replay(rows: Iterator) -> tuple[dict, dict]:
    """(newest version of each entity, reach of each version: the newest version of every entity that flows into it, itself included)."""
    version: dict[str, int] = {}
    reach: dict[tuple[str, int], dict[str, int]] = {}
    for src, dst, bumped in rows:
        for e in (src, dst):
            if e not in version:
                version[e] = 1
                reach[e, 1] = {e: 1}
        came = reach[src, version[src]]
        for e in bumped:
            before = reach[e, version[e]]
            version[e] += 1
            reach[e, version[e]] = before | {e: version[e]}
        mine = reach[dst, version[dst]]
        for e, v in came.items():
            if mine.get(e, 0) < v:
                mine[e] = v
    return version, reach


def minimal_ancestors(x: dict[str, int], y: dict[str, int], reach: dict) -> list[tuple[str, int]]:
    """Common ancestors that are no ancestors of another one; of an entity only the newest common version can be."""
    common = {e: min(v, y[e]) for e, v in x.items() if e in y}
    return sorted((e, v) for e, v in common.items() if not any(f != e and reach[f, m].get(e, 0) >= v for f, m in common.items()))


def path_factors(events: DataFrame, pairs: DataFrame) -> DataFrame:
    """(host, x, y, path_factor, strength): the number of minimal common ancestors of pairs (host, x, y) where x flows into y; null and zero where it doesn't."""

    def run(steps: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        steps = steps.sort_values("seq")
        version, reach = _replay(steps[["src", "dst", "bumped"]].itertuples(index=False))
        out = []
        for host, x, y in asked[["at", "x", "y"]].itertuples(index=False):
            size = None
            if x in version and y in version and x in reach[y, version[y]]:
                size = len(minimal_ancestors(reach[x, version[x]], reach[y, version[y]], reach)) or None
            out.append((host, x, y, size, 1.0 / size if size else 0.0))
        return pd.DataFrame(out, columns=["host", "x", "y", "path_factor", "strength"]).astype({"path_factor": "Int64", "strength": float})

    # the pairs' key has a name of its own: both sides may come from one table
    asked = pairs.select(F.col("host").alias("at"), "x", "y")
    return _steps(events).groupBy("host").cogroup(asked.groupBy("at")).applyInPandas(run, "host string, x string, y string, path_factor long, strength double")


def distances(events: DataFrame, sources: DataFrame) -> DataFrame:
    """(host, source, entity, hops): the fewest flows by which information of a source's (host, entity) versions came to an entity.

    Staying in an entity costs nothing, so the newest version has the least of all; events
    stream through in order, and only the current distances are held."""
    given = sources.select("host", F.lit(-1).cast("long").alias("seq"), F.col("entity").alias("src"), F.col("entity").alias("dst"))
    rows = given.union(flow(events).select("host", "seq", "src", "dst")).repartition("host").sortWithinPartitions("host", "seq", "src", "dst")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        host, hops = None, {}

        def out() -> pd.DataFrame:
            return pd.DataFrame([(host, s, e, n) for e, known in hops.items() for s, n in known.items()], columns=["host", "source", "entity", "hops"])

        for batch in batches:
            for h, seq, src, dst in batch.itertuples(index=False):
                if h != host:
                    if host is not None:
                        yield out()
                    host, hops = h, {}
                if seq < 0:
                    hops.setdefault(src, {})[src] = 0
                    continue
                for s, n in list(hops.get(src, {}).items()):
                    mine = hops.setdefault(dst, {})
                    if src != dst and n + 1 < mine.get(s, 1 << 30):
                        mine[s] = n + 1
        if host is not None:
            yield out()

    return rows.mapInPandas(run, "host string, source string, entity string, hops int")


def common_ancestors(events: DataFrame, pairs: DataFrame) -> DataFrame:
    """(host, x, y, entity, version, minimal): what flows into both of a pair (host, x, y), the newest common version of each entity, and whether it flows into no other of them."""

    def run(steps: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        version, reach = _replay(steps.sort_values("seq")[["src", "dst", "bumped"]].itertuples(index=False))
        out = []
        for host, x, y in asked[["at", "x", "y"]].itertuples(index=False):
            if x in version and y in version:
                a, b = reach[x, version[x]], reach[y, version[y]]
                least = set(minimal_ancestors(a, b, reach))
                out += [(host, x, y, e, min(v, b[e]), (e, min(v, b[e])) in least) for e, v in a.items() if e in b]
        return pd.DataFrame(out, columns=["host", "x", "y", "entity", "version", "minimal"])

    asked = pairs.select(F.col("host").alias("at"), "x", "y")
    return _steps(events).groupBy("host").cogroup(asked.groupBy("at")).applyInPandas(run, "host string, x string, y string, entity string, version int, minimal boolean")


# ---- searches over version nodes: rounds of joins, each one written down


def resolve(nodes: DataFrame, tokens: DataFrame) -> DataFrame:
    """(host, token, entity, version): nodes that tokens (host, token) name: ``entity#vN`` one version, ``entity`` all."""
    at = tokens.select("host", "token", F.regexp_replace("token", "#v[0-9]+$", "").alias("entity"), F.regexp_extract("token", "#v([0-9]+)$", 1).try_cast("int").alias("only"))
    return at.join(nodes.select("host", "entity", "version"), ["host", "entity"]).where("only is null or only = version").select("host", "token", "entity", "version")


def search(edges: DataFrame, starts: DataFrame, forward: bool = True, most_hops: int | None = None, fan_out: int | None = None) -> DataFrame:
    """(host, start, entity, version, hops): version nodes that starts (host, start, entity, version) reach, with the fewest flows on the way.

    Staying in an entity costs nothing.  edges: host, kind, src, src_version, dst, dst_version; a round joins what is new
    with the edges and is written down.  most_hops ends the search there; nodes with more than fan_out edges aren't passed."""
    from lineagram.session import cut

    a, b = ("src", "dst") if forward else ("dst", "src")
    step = edges.select("host", F.col(a).alias("entity"), F.col(f"{a}_version").alias("version"), F.col(b).alias("to"), F.col(f"{b}_version").alias("to_version"), F.when(F.col("kind") == "VERSION_TRANSITION", 0).otherwise(1).alias("cost"))
    step = step.groupBy("host", "entity", "version", "to", "to_version").agg(F.min("cost").alias("cost"))
    if fan_out is not None:
        wide = step.groupBy("host", "entity", "version").agg(F.count("*").alias("n")).where(F.col("n") > fan_out)
        step = step.join(wide, ["host", "entity", "version"], "left_anti")
    step, key = cut(step), ["host", "start", "entity", "version"]
    known = cut(starts.select(*key).distinct().withColumn("hops", F.lit(0)))
    new = known
    while True:
        onward = new.join(step, ["host", "entity", "version"]).select("host", "start", F.col("to").alias("entity"), F.col("to_version").alias("version"), (F.col("hops") + F.col("cost")).alias("hops"))
        if most_hops is not None:
            onward = onward.where(F.col("hops") <= most_hops)
        onward = onward.groupBy(*key).agg(F.min("hops").alias("hops"))
        new = cut(onward.join(known.withColumnRenamed("hops", "was"), key, "left").where("was is null or hops < was").select(*key, "hops"))
        if new.isEmpty():
            return known
        known = cut(known.union(new).groupBy(*key).agg(F.min("hops").alias("hops")))


def connected(edges: DataFrame, pairs: DataFrame, nodes: DataFrame, most_hops: int | None = None) -> DataFrame:
    """(host, x, y, hops): pairs of tokens of which a node of y is reached from one of x, with the fewest flows."""
    ends = resolve(nodes, pairs.select("host", F.explode(F.array("x", "y")).alias("token")).distinct())
    reached = search(edges, pairs.select("host", F.col("x").alias("token")).distinct().join(ends, ["host", "token"]).select("host", F.col("token").alias("start"), "entity", "version"), most_hops=most_hops)
    goal = pairs.select("host", "x", "y").distinct().join(ends.select("host", F.col("token").alias("y"), "entity", "version"), ["host", "y"])
    return goal.join(reached.withColumnRenamed("start", "x"), ["host", "x", "entity", "version"]).groupBy("host", "x", "y").agg(F.min("hops").alias("hops"))


def capped(closure: DataFrame, most: int, by: str = "hops") -> DataFrame:
    """A closure (host, start, entity, version, hops) with at most so many starts a node, the nearest."""
    from pyspark.sql import Window

    rank = F.row_number().over(Window.partitionBy("host", "entity", "version").orderBy(by, "start"))
    return closure.withColumn("place", rank).where(F.col("place") <= most).drop("place")


def shortest_paths(edges: DataFrame, pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(host, x, y, hops, nodes): for connected pairs a path with the fewest flows, then edges, the first by name; as ``entity#vN`` texts.

    Walked back from the end: each round joins the ends with their nearest predecessor, so only paths travel."""
    from lineagram.session import cut

    ends = resolve(nodes, pairs.select("host", F.explode(F.array("x", "y")).alias("token")).distinct())
    starts = pairs.select("host", F.col("x").alias("token")).distinct().join(ends, ["host", "token"]).select("host", F.col("token").alias("start"), "entity", "version")
    known = _tree(edges, starts)
    name = lambda e, v: F.concat(F.col(e), F.lit("#v"), F.col(v))
    goal = pairs.select("host", F.col("x").alias("start"), "y").distinct().join(ends.select("host", F.col("token").alias("y"), "entity", "version"), ["host", "y"]).join(known, ["host", "start", "entity", "version"])
    best = goal.groupBy("host", "start", "y").agg(F.min(F.struct("hops", "steps", "entity", "version")).alias("b")).select("host", "start", "y", "b.hops", "b.entity", "b.version")
    state = cut(best.select("host", "start", "y", "hops", "entity", "version", F.array(name("entity", "version")).alias("nodes"), F.lit(False).alias("done")))
    done = None
    back = known.select("host", "start", "entity", "version", "via")
    while True:
        moved = state.join(back, ["host", "start", "entity", "version"])
        ended, moved = moved.where("via is null"), moved.where("via is not null")
        ended = ended.select("host", F.col("start").alias("x"), "y", "hops", "nodes")
        done = cut(ended if done is None else done.union(ended))
        state = cut(moved.select("host", "start", "y", "hops", F.col("via.entity").alias("entity"), F.col("via.version").alias("version"), F.concat(F.array(F.concat("via.entity", F.lit("#v"), "via.version")), "nodes").alias("nodes")))
        if state.isEmpty():
            return done


def _tree(edges: DataFrame, starts: DataFrame) -> DataFrame:
    """(host, start, entity, version, hops, steps, via): what starts reach with the fewest flows, then edges, and the node before."""
    from lineagram.session import cut

    step = edges.select("host", F.col("src").alias("entity"), F.col("src_version").alias("version"), F.col("dst").alias("to"), F.col("dst_version").alias("to_version"), F.when(F.col("kind") == "VERSION_TRANSITION", 0).otherwise(1).alias("cost"))
    step = cut(step.groupBy("host", "entity", "version", "to", "to_version").agg(F.min("cost").alias("cost")))
    key = ["host", "start", "entity", "version"]
    kind = "struct<entity:string,version:int>"
    known = cut(starts.select(*key).distinct().withColumns({"hops": F.lit(0), "steps": F.lit(0), "via": F.lit(None).cast(kind)}))
    new = known
    pick = F.min(F.struct("hops", "steps", "via")).alias("b")
    while True:
        onward = new.join(step, ["host", "entity", "version"]).select(
            "host", "start", F.col("to").alias("entity"), F.col("to_version").cast("int").alias("version"), (F.col("hops") + F.col("cost")).alias("hops"), (F.col("steps") + 1).alias("steps"),
            F.struct(F.col("entity").alias("entity"), F.col("version").cast("int").alias("version")).alias("via"),
        )
        onward = onward.groupBy(*key).agg(pick).select(*key, "b.*")
        was = known.select(*key, F.struct("hops", "steps", "via").alias("was"))
        new = cut(onward.join(was, key, "left").where(F.col("was").isNull() | (F.struct("hops", "steps", "via") < F.col("was"))).select(*key, "hops", "steps", "via"))
        if new.isEmpty():
            return known
        known = cut(known.unionByName(new).groupBy(*key).agg(pick).select(*key, "b.*"))


def semantic_reach(semantic: DataFrame, edges: DataFrame, starts: DataFrame, relations: list[str] | None = None) -> DataFrame:
    """(host, start, entity, version, hops): nodes reached over relations of the names given (all without), staying in an entity being free."""
    from lineagram.functions.scalars import RELATION_ALIASES, canonical_relation

    said = semantic
    if relations:
        names = [RELATION_ALIASES.get(r.strip().lower(), r.strip().lower()) for r in relations]
        said = said.where(canonical_relation(F.col("relation")).isin(*names))
    columns = ["host", "kind", "src", "src_version", "dst", "dst_version"]
    both = said.withColumn("kind", F.lit("DATA_FLOW")).select(*columns).union(edges.where("kind = 'VERSION_TRANSITION'").select(*columns))
    return search(both, starts)


def topological(nodes: DataFrame) -> DataFrame:
    """Nodes (host, entity, version, created_seq) with ``place``: their order in which every edge runs forward, by host.

    An event makes versions from older ones, first versions included, so creation gives the order."""
    from pyspark.sql import Window

    made = F.row_number().over(Window.partitionBy("host").orderBy("created_seq", F.when(F.col("version") == 1, 0).otherwise(1), "entity", "version"))
    return nodes.withColumn("place", made)


def legacy_factor(cut_size: F.Column) -> F.Column:
    """1 / (1 + the larger of the cut and one); null where there is no path."""
    return F.when(cut_size.isNotNull(), 1.0 / (1 + F.greatest(cut_size, F.lit(1))))


def common_process_ancestor(ancestors: DataFrame, pairs: DataFrame) -> DataFrame:
    """Pairs (host, x, y) of processes that descend from a common one, themselves included."""
    own = ancestors.select("host", "process", "ancestor").union(pairs.select("host", F.explode(F.array("x", "y")).alias("process")).distinct().select("host", "process", F.col("process").alias("ancestor")))
    a = pairs.select("host", "x", "y").distinct().join(own.select("host", F.col("process").alias("x"), "ancestor"), ["host", "x"])
    return a.join(own.select("host", F.col("process").alias("y"), "ancestor"), ["host", "y", "ancestor"]).select("host", "x", "y").distinct()
