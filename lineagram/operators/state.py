"""State that follows events in order: taint, privilege, chains of techniques."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lineagram.functions.scalars import entity_prefix
from lineagram.sources.cdr import generic_relations

# Relations by the way that taint goes.
FORWARD = ("write", "execute", "spawn", "inject", "connect", "request", "invoke", "make_mem_exec", "protect_memory_exec")
REVERSE = ("read", "recv", "accept", "resolve")
INTEGRITY = {"low": 1, "medium": 2, "high": 3, "system": 4}


def with_relations(events: DataFrame) -> DataFrame:
    """Events with ``relations``; made from operation and entities where a log doesn't bring them."""
    return events if "relations" in events.columns else events.withColumn("relations", generic_relations(F.lower("op"), F.col("subject"), F.col("object")))


def _passes(events: DataFrame) -> DataFrame:
    """(host, seq, at, src, dst): what passes taint on, in the order of events and of their relations."""
    said = with_relations(events).select("host", "seq", F.posexplode("relations").alias("at", "r"))
    back, ahead = F.col("r.relation").isin(*REVERSE), F.col("r.relation").isin(*FORWARD)
    return said.where(back | ahead).select("host", "seq", "at", F.when(back, F.col("r.dst")).otherwise(F.col("r.src")).alias("src"), F.when(back, F.col("r.src")).otherwise(F.col("r.dst")).alias("dst"))


#: The place of a seed among an event's relations: after all of them.
_LAST = (1 << 31) - 1


def taint(events: DataFrame, seeds: DataFrame, rounds: bool = False) -> DataFrame:
    """(host, entity, tainted_seq): when taint from a seed first reached an entity.

    seeds: host, seq, entity.  An entity is tainted after its seed's event.  Relations pass taint on, thirteen kinds of
    them, some from source to destination and some back, in the order in which the event names them.  A host's
    relations stream through in order and only the set of tainted entities is held.  Where one host has a large part of
    all events, rounds spreads the work by entity: joins of what is newly tainted with later relations, until nothing is."""
    moved = _passes(events)
    if rounds:
        return _taint_rounds(moved, seeds)
    given = seeds.select("host", "seq", F.lit(_LAST).alias("at"), F.lit(None).cast("string").alias("src"), F.col("entity").alias("dst"))
    rows = moved.union(given).repartition("host").sortWithinPartitions("host", "seq", "at", "dst")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        host, tainted = None, set()
        for batch in batches:
            out = []
            for h, seq, _, src, dst in batch.itertuples(index=False):
                if h != host:
                    host, tainted = h, set()
                if (src is None or src in tainted) and dst not in tainted:
                    tainted.add(dst)
                    out.append((h, dst, seq))
            yield pd.DataFrame(out, columns=["host", "entity", "tainted_seq"])

    return rows.mapInPandas(run, "host string, entity string, tainted_seq long")


def _taint_rounds(moved: DataFrame, seeds_: DataFrame) -> DataFrame:
    from lineagram.session import cut

    moved = cut(moved)
    key = F.min(F.struct(F.col("seq").cast("long").alias("seq"), F.col("at").cast("int").alias("at"))).alias("k")
    known = cut(seeds_.withColumn("at", F.lit(_LAST)).groupBy("host", "entity").agg(key))
    new = known
    while True:
        onward = new.join(moved.withColumnRenamed("src", "entity"), ["host", "entity"]).where(F.struct(F.col("seq").cast("long"), F.col("at").cast("int")) > F.struct("k.seq", "k.at"))
        onward = onward.select("host", F.col("dst").alias("entity"), "seq", "at").groupBy("host", "entity").agg(key)
        new = cut(onward.join(known.withColumnRenamed("k", "was"), ["host", "entity"], "left").where("was is null or k < was").select("host", "entity", "k"))
        if new.isEmpty():
            return known.select("host", "entity", F.col("k.seq").alias("tainted_seq"))
        known = cut(known.union(new).groupBy("host", "entity").agg(F.min("k").alias("k")))


def seeds(matches: DataFrame, rules: list) -> DataFrame:
    """(host, seq, entity): what matches of a first compromise bind; only a rule's own symbols, if it has any.

    Rules without a stage count as first ones."""
    first = [r for r in rules if r.apt_stage == "Initial Compromise" or (r.stage or 0) in (0, 1)]
    bindings = F.col("bindings") if "bindings" in matches.columns else F.create_map(F.lit("subject"), F.col("subject"), F.lit("object"), F.col("object"))
    kept = bindings

    def named(symbols: list[str]):
        return lambda k, v: k.isin(*symbols)

    for r in first:
        if own := sorted({b["symbol"] for b in r.entity_bindings if isinstance(b.get("symbol"), str)}):
            kept = F.when(F.col("rule_id") == r.rule_id, F.map_filter(bindings, named(own))).otherwise(kept)
    return matches.where(F.col("rule_id").isin(*[r.rule_id for r in first])).select("host", "seq", F.explode(F.array_distinct(F.map_values(kept))).alias("entity")).where("entity is not null")


def last_tainted(events: DataFrame, tainted: DataFrame) -> DataFrame:
    """(host, entity, tainted_seq, last_ts): when a tainted entity was last touched while tainted."""
    seen = events.select("host", "seq", "ts", F.explode(F.array_distinct(F.array("subject", "object"))).alias("entity"))
    got = tainted.join(seen, ["host", "entity"], "left").where("seq is null or seq >= tainted_seq")
    return got.groupBy("host", "entity", "tainted_seq").agg(F.max("ts").alias("last_ts"))


def evict_taint(last: DataFrame, now: F.Column, keep_seconds: int, protected: DataFrame | None = None) -> DataFrame:
    """What stays of last_tainted(): entities touched after the cut, of unknown time, or protected (host, entity)."""
    old = F.unix_seconds(now.cast("timestamp")) - F.unix_seconds(F.col("last_ts").cast("timestamp")) >= keep_seconds
    marked = last.withColumn("old", F.coalesce(old, F.lit(False)))
    if protected is not None:
        marked = marked.join(protected.select("host", "entity").distinct().withColumn("kept", F.lit(True)), ["host", "entity"], "left").withColumn("old", F.col("old") & F.col("kept").isNull()).drop("kept")
    return marked.where("not old").drop("old")


def tainted_of(tainted: DataFrame, prefix: str) -> DataFrame:
    return tainted.where(entity_prefix(F.col("entity")) == prefix.lower())


def forget(state: DataFrame, gone: DataFrame) -> DataFrame:
    """State by (host, entity) without entities that were pruned."""
    return state.join(gone.select("host", "entity").distinct(), ["host", "entity"], "left_anti")


def privilege(events: DataFrame, level: F.Column) -> DataFrame:
    """Adds ``privilege``: the highest level that the subject has shown so far."""
    so_far = Window.partitionBy("host", "subject").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    return events.withColumn("privilege", F.max(level).over(so_far))


def privileges(events: DataFrame) -> DataFrame:
    """Adds what the subject has shown so far: ``level`` (1 low to 4 system), ``root``, ``high``, ``system``, ``elevated``.

    events has integrity (text), euid and elevated; any known level counts as elevated, and so does root."""
    so_far = Window.partitionBy("host", "subject").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    table = F.create_map(*[F.lit(x) for kv in INTEGRITY.items() for x in kv])
    got = events.withColumns({"level": F.max(F.try_element_at(table, F.lower("integrity"))).over(so_far), "root": F.coalesce(F.max((F.col("euid") == 0).cast("int")).over(so_far) > 0, F.lit(False)), "__e": F.coalesce(F.max(F.col("elevated").cast("int")).over(so_far) > 0, F.lit(False))})
    at_least = lambda n: F.coalesce(F.col("level") >= n, F.lit(False))
    return got.withColumns({"high": at_least(3), "system": at_least(4), "elevated": F.col("__e") | at_least(1) | F.col("root")}).drop("__e")


def technique_chain(matches: DataFrame, needs: dict[str, str | tuple[str, ...]]) -> DataFrame:
    """Matches of rules that need another: adds ``after_seq``, the nearest earlier match of a needed rule by the same subject."""
    earlier = Window.partitionBy("host", "subject").orderBy("seq").rangeBetween(Window.unboundedPreceding, -1)
    pick = F.lit(None).cast("long")
    for rule, needed in needs.items():
        wanted = [needed] if isinstance(needed, str) else list(needed)
        pick = F.when(F.col("rule_id") == rule, F.max(F.when(F.col("rule_id").isin(*wanted), F.col("seq"))).over(earlier)).otherwise(pick)
    return matches.withColumn("after_seq", pick)


def chains(events: DataFrame, found: DataFrame, needs: dict[str, tuple[str, ...]], most: int = 16) -> DataFrame:
    """(host, src, src_rule, dst, dst_rule, seq, src_seq, distance): a needed technique shown strictly earlier by the nearest ancestor.

    found: host, seq, subject, rule_id.  A process's first match of a rule counts.  Ancestors are the process itself, its
    parent at the time, and the last writers at the time of files that it had read; rounds of joins go one step
    further each, up to ``most``, and a process is left at its first round with an answer, ties by name."""
    from lineagram.session import cut

    first = cut(found.groupBy("host", F.col("subject").alias("node"), "rule_id").agg(F.min("seq").alias("seq")))
    rows = [(r, n) for r, wanted in needs.items() for n in ((wanted,) if isinstance(wanted, str) else wanted)]
    wanted = events.sparkSession.createDataFrame(rows, "rule_id string, need string")
    op = F.lower("op")
    parent = events.where(op.isin("fork", "proc_to_proc")).select("host", F.col("object").alias("node"), F.col("subject").alias("up"), F.col("seq").alias("at"))
    reads = events.where((op == "read") & F.startswith("object", F.lit("file"))).groupBy("host", F.col("subject").alias("node"), F.col("object").alias("file")).agg(F.min("seq").alias("at"))
    writes = events.where((op == "write") & F.startswith("object", F.lit("file"))).select("host", F.col("object").alias("file"), F.col("subject").alias("up"), F.col("seq").alias("written"))
    key = ["host", "dst", "dst_rule", "seq"]
    state = cut(first.join(wanted.select("rule_id").distinct(), "rule_id").select("host", F.col("node").alias("dst"), F.col("rule_id").alias("dst_rule"), "seq", "node"))
    seen, done = state.select(*key, "node"), None
    said = first.select("host", "node", F.col("rule_id").alias("need"), F.col("seq").alias("src_seq"))
    for distance in range(most + 1):
        hit = state.join(wanted.withColumnRenamed("rule_id", "dst_rule"), "dst_rule").join(said, ["host", "node", "need"]).where("src_seq < seq")
        best = hit.groupBy(*key).agg(F.min(F.struct("node", "need", "src_seq")).alias("b")).select("host", F.col("b.node").alias("src"), F.col("b.need").alias("src_rule"), "dst", "dst_rule", "seq", F.col("b.src_seq").alias("src_seq"), F.lit(distance).alias("distance"))
        best = cut(best)
        done = best if done is None else done.union(best)
        left = state.join(best.select(*key), key, "left_anti")
        up = left.join(parent, ["host", "node"]).where("at <= seq").groupBy(*key, "node").agg(F.max_by("up", "at").alias("up")).select(*key, "up")
        wrote = left.join(reads, ["host", "node"]).where("at <= seq").select(*key, "file").distinct().join(writes, ["host", "file"]).where("written <= seq").groupBy(*key, "file").agg(F.max_by("up", "written").alias("up")).select(*key, "up")
        state = cut(up.union(wrote).distinct().withColumnRenamed("up", "node").join(seen, [*key, "node"], "left_anti"))
        if state.isEmpty():
            break
        seen = cut(seen.union(state.select(*key, "node")))
    return done


def pending_expired(matches: DataFrame, ttl_seconds: int) -> DataFrame:
    """Per host, matches older than the time to live at the host's newest event."""
    newest = matches.groupBy("host").agg(F.max("ts").alias("now"))
    return matches.join(newest, "host").where(F.unix_seconds(F.col("now").cast("timestamp")) - F.unix_seconds(F.col("ts").cast("timestamp")) > ttl_seconds).drop("now")


def ended(events: DataFrame, now: F.Column, keep_seconds: int) -> DataFrame:
    """(host, entity): processes that have ended (op exit or terminate) and were last seen so long ago: their state goes."""
    seen = events.select("host", "ts", "op", F.explode(F.array_distinct(F.array("subject", "object"))).alias("entity"), "subject")
    by = seen.groupBy("host", "entity").agg(F.max("ts").alias("last"), F.max((F.lower("op").isin("exit", "terminate") & (F.col("entity") == F.col("subject"))).cast("int")).alias("over"))
    return by.where((F.col("over") == 1) & (F.unix_seconds(now.cast("timestamp")) - F.unix_seconds(F.col("last").cast("timestamp")) >= keep_seconds)).select("host", "entity")
