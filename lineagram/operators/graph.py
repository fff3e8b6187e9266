"""Versioned provenance graph.

Every event moves information from one entity to another and makes a new version of
the receiver (and of whatever else it changes), so edges only run forward in time.
Versions, edges and their invariants are window functions by (host, entity) over
the total order ``seq``; nothing is replayed event by event.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Operations by the way information flows and by what they change.
TOWARDS_SUBJECT = ("read", "exec", "recv")
CHANGES_OBJECT = ("write", "modify", "send", "proc_to_file", "proc_to_registry", "proc_to_ip", "file_to_ip")
CHANGES_SUBJECT = ("read", "recv", "file_to_proc")
CHANGES_PROCESS = ("exec", "execute", "setuid", "setgid", "privilege_change", "privilege_escalation")


def flow(events: DataFrame) -> DataFrame:
    """Adds src and dst, the direction of the event's information flow."""
    back = F.lower("op").isin(*TOWARDS_SUBJECT)
    return events.withColumns({"src": F.when(back, F.col("object")).otherwise(F.col("subject")), "dst": F.when(back, F.col("subject")).otherwise(F.col("object"))})


def bumps(events: DataFrame) -> DataFrame:
    """Events with both ends, with src, dst and whether the subject (first) and the object (second) get a new version.

    What an operation changes, what the event's own flags say has changed, and whoever receives
    information gets one; if nothing else is known, the object does."""
    op = F.lower("op")
    flag = lambda c: F.coalesce(F.col(c), F.lit(False)) if c in events.columns else F.lit(False)
    process = F.col("subject").rlike("^proc(_guid|_pid)?:")
    subject = op.isin(*CHANGES_SUBJECT) | (op.isin(*CHANGES_PROCESS) & process) | flag("subject_state_change")
    object_ = op.isin(*CHANGES_OBJECT) | flag("object_state_change")
    got = flow(events.where("subject is not null and object is not null")).withColumns({"__s": subject, "__o": object_})
    first = F.col("__s") | (F.col("dst") == F.col("subject"))
    second = F.col("__o") | (F.col("dst") == F.col("object")) | ~(F.col("__s") | F.col("__o"))
    return got.withColumns({"first": first, "second": second})


def touches(events: DataFrame) -> DataFrame:
    """(host, seq, entity, bump, src, dst): each entity an event touches, and whether it gets a new version."""
    first, second = F.col("first"), F.col("second")
    end = lambda c, bump: F.struct(F.col(c).alias("entity"), bump.cast("int").alias("bump"))
    sides = F.when(F.col("subject") == F.col("object"), F.array(end("subject", first | second))).otherwise(F.array(end("subject", first), end("object", second)))
    return bumps(events).select("host", "seq", "src", "dst", F.explode(sides).alias("t")).select("host", "seq", "t.entity", "t.bump", "src", "dst")


def versions(events: DataFrame) -> DataFrame:
    """(host, seq, entity, bump, src, dst, before, after): an entity's version before and after each event that touches it."""
    earlier = Window.partitionBy("host", "entity").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    before = (1 + F.coalesce(F.sum("bump").over(earlier), F.lit(0))).cast("int")
    return touches(events).withColumn("before", before).withColumn("after", (F.col("before") + F.col("bump")).cast("int"))


def nodes(events: DataFrame) -> DataFrame:
    """(host, entity, version, created_seq)."""
    v = versions(events)
    first = v.groupBy("host", "entity").agg(F.min("seq").alias("created_seq")).select("host", "entity", F.lit(1).alias("version"), "created_seq")
    return first.union(v.where("bump = 1").select("host", "entity", "after", "seq"))


def edges(events: DataFrame) -> DataFrame:
    """(host, seq, kind, src, src_version, dst, dst_version): flows and version transitions, from one pass over versions."""
    at = lambda side, which: F.max(F.when(F.col("entity") == F.col(side), F.col(which)))
    both = versions(events).groupBy("host", "seq", "src", "dst").agg(
        at("src", "before").alias("src_version"), at("dst", "after").alias("dst_version"), F.collect_list(F.when(F.col("bump") == 1, F.struct("entity", "before", "after"))).alias("steps")
    )
    edge = lambda kind, src, v, dst, w: F.struct(F.lit(kind).alias("kind"), src.alias("src"), v.alias("src_version"), dst.alias("dst"), w.alias("dst_version"))
    moved = F.array(edge("DATA_FLOW", F.col("src"), F.col("src_version"), F.col("dst"), F.col("dst_version")))
    steps = F.transform("steps", lambda t: edge("VERSION_TRANSITION", t["entity"], t["before"], t["entity"], t["after"]))
    return both.select("host", "seq", F.explode(F.concat(moved, steps)).alias("e")).select("host", "seq", "e.*")


def violations(events: DataFrame) -> DataFrame:
    """(edges, backward): how many edges there are and how many don't run forward; the graph has no cycle if none."""
    made = nodes(events)
    name = lambda side: made.select("host", F.col("entity").alias(side), F.col("version").alias(f"{side}_version"), F.col("created_seq").alias(f"{side}_seq"))
    both = edges(events).join(name("src"), ["host", "src", "src_version"]).join(name("dst"), ["host", "dst", "dst_version"])
    # a version that its own event makes is newer than any that the event reads, first versions included
    back = (F.col("src_seq") > F.col("dst_seq")) | ((F.col("src") == F.col("dst")) & (F.col("src_version") >= F.col("dst_version")))
    return both.agg(F.count("*").alias("edges"), F.sum(back.cast("long")).alias("backward"))


def current(events: DataFrame) -> DataFrame:
    """(host, entity, version): each entity's newest version."""
    return versions(events).groupBy("host", "entity").agg(F.max("after").alias("version"))


def vma_versions(events: DataFrame) -> DataFrame:
    """Versions of memory areas: one more at every operation that makes them executable.

    events: host, seq, area, executable (boolean)."""
    order = Window.partitionBy("host", "area").orderBy("seq")
    first_plain = F.when(F.first("executable").over(order), 0).otherwise(1)
    return events.withColumn("version", (F.sum(F.col("executable").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)) + first_plain).cast("int"))


def vma_edges(events: DataFrame) -> DataFrame:
    """(host, seq, area, src_version, dst_version): an area's version before an operation that makes it executable, if it has one, and after."""
    before = F.lag("version").over(Window.partitionBy("host", "area").orderBy("seq"))
    got = vma_versions(events).withColumn("src_version", before)
    return got.where("executable and src_version is not null").select("host", "seq", "area", "src_version", F.col("version").alias("dst_version"))


def with_memory_versions(events: DataFrame) -> DataFrame:
    """Events whose memory objects (mem:pid:address:n) carry the area's version as n, in their relations too."""
    area = F.regexp_extract("object", "^(mem:[^:]*:[^:]*):", 1)
    executable = F.exists("relations", lambda r: r["relation"].isin("make_mem_exec", "protect_memory_exec"))
    marked = events.withColumns({"area": area, "executable": F.coalesce(executable, F.lit(False))})
    memory = vma_versions(marked.where("area != ''")).withColumn("__new", F.concat("area", F.lit(":"), "version"))
    moved = F.transform("relations", lambda r: F.struct(r["relation"].alias("relation"), r["src"].alias("src"), F.when(r["dst"] == F.col("object"), F.col("__new")).otherwise(r["dst"]).alias("dst")))
    memory = memory.withColumns({"relations": moved}).withColumn("object", F.col("__new"))
    return memory.select(*events.columns).unionByName(marked.where("coalesce(area, '') = ''").select(*events.columns))


def semantic_edges(events: DataFrame) -> DataFrame:
    """(host, seq, relation, src, src_version, dst, dst_version): relations between the versions that are current after their event.

    events has ``relations``; a relation to an entity that no event up to then has touched is left out."""
    said = events.select("host", "seq", F.posexplode("relations").alias("at", "r")).select("host", "seq", "at", "r.relation", "r.src", "r.dst")
    ends = said.select("host", "seq", F.explode(F.array_distinct(F.array("src", "dst"))).alias("entity")).distinct().withColumn("key", F.concat_ws("\u0000", "host", "entity"))
    from lineagram.sources.logs import as_of

    known = as_of(ends, versions(events).select("seq", F.concat_ws("\u0000", "host", "entity").alias("key"), F.col("after").alias("version")), "key", "version").where("version is not null")
    side = lambda c: known.select("host", "seq", F.col("entity").alias(c), F.col("version").alias(f"{c}_version"))
    got = said.join(side("src"), ["host", "seq", "src"]).join(side("dst"), ["host", "seq", "dst"])
    return got.select("host", "seq", "relation", "src", "src_version", "dst", "dst_version")


def adjacency(events: DataFrame) -> DataFrame:
    """(host, src, dst): entities that information flows between directly."""
    return flow(events).where("src != dst").select("host", "src", "dst").distinct()


def delta(before: DataFrame, after: DataFrame) -> DataFrame:
    """(change, ..): rows that came and rows that went between two states of a table, for whoever follows the graph."""
    return after.exceptAll(before).withColumn("change", F.lit("added")).union(before.exceptAll(after).withColumn("change", F.lit("removed")))


def lineage(events: DataFrame) -> DataFrame:
    """(host, parent, child) of forks between processes."""
    forks = events.where((F.lower("op").isin("fork", "proc_to_proc")) & F.startswith("subject", F.lit("proc")) & F.startswith("object", F.lit("proc")))
    return forks.select("host", F.col("subject").alias("parent"), F.col("object").alias("child")).where("parent != child").distinct()


def ancestors(events: DataFrame, most: int = 64) -> DataFrame:
    """(host, process, ancestor): all processes that a process descends from; rounds double the distance covered."""
    from lineagram.session import cut

    known = cut(lineage(events).select("host", F.col("child").alias("process"), F.col("parent").alias("ancestor")))
    size = known.count()
    for _ in range(most):
        further = known.alias("a").join(known.select("host", F.col("process").alias("ancestor"), F.col("ancestor").alias("beyond")), ["host", "ancestor"])
        known = cut(known.union(further.select("host", "process", F.col("beyond").alias("ancestor"))).distinct())
        if (now := known.count()) == size:
            break
        size = now
    return known


def entity_reach(events: DataFrame) -> DataFrame:
    """(host, dst, src, src_version): the newest version of src that flows into dst's newest version.

    An entity's versions are a chain, so what reaches a node is one version number for
    each entity.  Hosts are worked on apart; a host's events stream through in order,
    and only its current table of reaches is held."""
    steps = touches(events).where("bump = 1").groupBy("host", "seq").agg(F.collect_set("entity").alias("bumped"))
    rows = flow(events).select("host", "seq", "src", "dst").join(steps, ["host", "seq"]).repartition("host").sortWithinPartitions("host", "seq")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        host, version, reach = None, {}, {}

        def out() -> pd.DataFrame:
            return pd.DataFrame([(host, d, s, v) for d, known in reach.items() for s, v in known.items() if s != d], columns=["host", "dst", "src", "src_version"])

        for batch in batches:
            for h, _, src, dst, bumped in batch.itertuples(index=False):
                if h != host:
                    if host is not None:
                        yield out()
                    host, version, reach = h, {}, {}
                for e in (src, dst):
                    version.setdefault(e, 1)
                    reach.setdefault(e, {e: 1})
                came = dict(reach[src])
                for e in bumped:
                    version[e] += 1
                    reach[e][e] = version[e]
                mine = reach[dst]
                for e, v in came.items():
                    if mine.get(e, 0) < v:
                        mine[e] = v
        if host is not None:
            yield out()

    return rows.mapInPandas(run, "host string, dst string, src string, src_version int")


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, label): the smallest node reachable over links."""
    from lineagram.session import cut

    both = cut(links.select(F.col(a).alias("node"), F.col(b).alias("other")).union(links.select(F.col(b), F.col(a))).distinct())
    state = cut(both.groupBy("node").agg(F.min("other").alias("o")).select("node", F.least("node", "o").alias("label")))
    while True:
        around = both.join(state.select(F.col("node").alias("other"), "label"), "other").groupBy("node").agg(F.min("label").alias("near"))
        low = state.join(around, "node").select("node", F.col("label").alias("was"), F.least("label", "near").alias("label"))
        after = cut(low.join(state.select(F.col("node").alias("label"), F.col("label").alias("beyond")), "label", "left").select("node", "was", F.least("label", F.coalesce("beyond", "label")).alias("label")))
        if after.where("label < was").isEmpty():
            return after.select("node", "label")
        state = after.select("node", "label")


def prune_stale(events: DataFrame, keep_days: float) -> DataFrame:
    """Entities last seen within so many days of the newest event of all; (host, entity, last_seen)."""
    seen = events.select("host", "ts", F.explode(F.array("subject", "object")).alias("entity")).groupBy("host", "entity").agg(F.max("ts").alias("last_seen"))
    newest = events.agg(F.max("ts").alias("now"))
    return seen.join(F.broadcast(newest), F.col("last_seen") > F.col("now") - F.expr(f"interval {int(keep_days * 86400)} seconds")).select("host", "entity", "last_seen")


def prune_to(events: DataFrame, most: int) -> DataFrame:
    """A host's most recently seen entities, as many as a cap of the live graph lets stay."""
    seen = events.select("host", "seq", F.explode(F.array("subject", "object")).alias("entity")).groupBy("host", "entity").agg(F.max("seq").alias("last_seq"))
    rank = F.row_number().over(Window.partitionBy("host").orderBy(F.desc("last_seq"), "entity"))
    return seen.withColumn("place", rank).where(F.col("place") <= most).select("host", "entity", "last_seq")


def prunable(events: DataFrame, keep_seconds: int, protected: DataFrame | None = None, most_nodes: int = 0, most_edges: int = 0, low: float = 1.0) -> DataFrame:
    """(host, entity, version): version nodes of a host that go.

    Those last seen so long before the host's newest event go.  If more nodes, or edges, than the caps are left, the
    oldest go, too, until no more than the caps' ``low`` share is left.  The current version of an entity in
    protected (host, entity), or a version that it names, stays.  Edges go with either end."""
    made = versions(events.select("*", F.col("ts").alias("__ts"))).join(events.select("host", "seq", "ts"), ["host", "seq"])
    # an entity's version is last seen when it is made or touched without a change
    seen = made.select("host", "entity", F.explode(F.array_distinct(F.array("before", "after"))).alias("version"), "ts", "before").groupBy("host", "entity", "version").agg(F.max("ts").alias("seen"))
    now, newest = Window.partitionBy("host"), Window.partitionBy("host", "entity")
    seen = seen.withColumns({"now": F.max("seen").over(now), "current": F.col("version") == F.max("version").over(newest)})
    if protected is not None:
        kept = protected.select("host", "entity", (F.col("version") if "version" in protected.columns else F.lit(None).cast("int")).alias("__only")).distinct()
        stays = seen.join(kept, ["host", "entity"]).where("coalesce(__only = version, current)").select("host", "entity", "version").distinct()
        seen = seen.join(stays.withColumn("__kept", F.lit(True)), ["host", "entity", "version"], "left").withColumn("stays", F.coalesce("__kept", F.lit(False)))
    else:
        seen = seen.withColumn("stays", F.lit(False))
    ends = edges(events)
    ends = ends.select("host", F.explode(F.array_distinct(F.array(F.struct(F.col("src").alias("entity"), F.col("src_version").alias("version")), F.struct(F.col("dst").alias("entity"), F.col("dst_version").alias("version"))))).alias("n")).select("host", "n.*")
    touched = ends.groupBy("host", "entity", "version").agg(F.count("*").alias("incident"))
    total = edges(events).groupBy("host").agg(F.count("*").alias("edges"))
    seen = seen.join(touched, ["host", "entity", "version"], "left").join(total, "host", "left").fillna({"incident": 0, "edges": 0})
    stale = (F.unix_seconds(F.col("now").cast("timestamp")) - F.unix_seconds(F.col("seen").cast("timestamp")) >= keep_seconds) & ~F.col("stays")
    seen = seen.withColumn("stale", stale).withColumns({"nodes": F.count("*").over(now), "n_stale": F.sum(F.col("stale").cast("long")).over(now), "e_stale": F.sum(F.when(F.col("stale"), F.col("incident")).otherwise(0)).over(now)})
    # what else goes, the oldest first: as long as what is left before it is over a target
    order = now.orderBy("seen", "entity", "version").rowsBetween(Window.unboundedPreceding, -1)
    extra = ~F.col("stale") & ~F.col("stays")
    gone_n = F.coalesce(F.sum(extra.cast("long")).over(order), F.lit(0)) + F.col("n_stale")
    gone_e = F.coalesce(F.sum(F.when(extra, F.col("incident")).otherwise(0)).over(order), F.lit(0)) + F.col("e_stale")

    def target(most: int, have: str) -> F.Column:
        return F.when(F.col(have) > most, F.greatest(F.lit(1), F.ceil(F.lit(most * min(1.0, max(0.0, low)))))).otherwise(most)

    over = F.lit(False)
    if most_nodes > 0:
        over = over | (F.col("nodes") - gone_n > target(most_nodes, "nodes"))
    if most_edges > 0:
        over = over | (F.col("edges") - gone_e > target(most_edges, "edges"))
    return seen.withColumn("over", over).where(F.col("stale") | (extra & F.col("over"))).select("host", "entity", "version")


def without(edges_: DataFrame, gone: DataFrame) -> DataFrame:
    """Edges of which no end is among the nodes (host, entity, version) that went."""
    side = lambda c: gone.select("host", F.col("entity").alias(c), F.col("version").alias(f"{c}_version"))
    return edges_.join(side("src"), ["host", "src", "src_version"], "left_anti").join(side("dst"), ["host", "dst", "dst_version"], "left_anti")
