"""Which matches reach which version nodes: an index that grows with edges and matches.

A row says that a match's node flows into a version node: (host, entity, version,
match_id, rule_id, origin, hops, seq), with the fewest flows and the earliest place.
Depth and fan-out are bounded as the scenario gate asks for.  A batch of new edges or
matches is one round of joins for each hop it still has to go.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DEPTH, FAN_OUT = 5, 1000
NODE = ["host", "entity", "version"]
ROW = [*NODE, "match_id", "rule_id", "origin"]


def seeds(matches: DataFrame, versions: DataFrame) -> DataFrame:
    """Index rows of matches at the versions of their entities after their event."""
    ends = matches.select("host", "seq", "match_id", "rule_id", F.explode(F.array_distinct(F.array_compact(F.array("subject", "object")))).alias("entity"))
    at = versions.select("host", "seq", "entity", F.col("after").alias("version"))
    name = F.concat("entity", F.lit("#v"), "version")
    return ends.join(at, ["host", "seq", "entity"]).select(*NODE, "match_id", "rule_id", name.alias("origin"), F.lit(0).alias("hops"), "seq")


def merged(rows: DataFrame) -> DataFrame:
    return rows.groupBy(*ROW).agg(F.min("hops").alias("hops"), F.min("seq").alias("seq"))


def _steps(edges: DataFrame, fan_out: int) -> DataFrame:
    step = edges.select("host", F.col("src").alias("entity"), F.col("src_version").alias("version"), F.col("dst").alias("to"), F.col("dst_version").alias("to_version"), F.when(F.col("kind") == "VERSION_TRANSITION", 0).otherwise(1).alias("cost"))
    step = step.groupBy(*NODE, "to", "to_version").agg(F.min("cost").alias("cost"))
    wide = step.groupBy(*NODE).agg(F.count("*").alias("n")).where(F.col("n") > fan_out)
    return step.join(wide, NODE, "left_anti")


def extend(index: DataFrame | None, edges: DataFrame, new_edges: DataFrame | None = None, new_rows: DataFrame | None = None, depth: int = DEPTH, fan_out: int = FAN_OUT) -> DataFrame:
    """The index after new edges (already among edges) and new seeds: only what is new travels."""
    from lineagram.session import cut

    step = cut(_steps(edges, fan_out))
    parts = [p for p in (new_rows,) if p is not None]
    if index is not None and new_edges is not None:
        parts.append(_onward(index, _steps(new_edges, fan_out), depth))
    if not parts:
        return index
    new = parts[0]
    for p in parts[1:]:
        new = new.unionByName(p)
    new = cut(merged(new))
    known = index if index is not None else new.limit(0)
    while True:
        was = known.select(*ROW, F.col("hops").alias("h"), F.col("seq").alias("s"))
        new = cut(new.join(was, ROW, "left").where("h is null or hops < h or seq < s").select(*ROW, "hops", "seq"))
        if new.isEmpty():
            return known
        known = cut(merged(known.unionByName(new)))
        new = merged(_onward(new, step, depth))


def _onward(rows: DataFrame, step: DataFrame, depth: int) -> DataFrame:
    on = rows.join(step, NODE).select("host", F.col("to").alias("entity"), F.col("to_version").cast("int").alias("version"), "match_id", "rule_id", "origin", (F.col("hops") + F.col("cost")).alias("hops"), "seq")
    return on.where(F.col("hops") <= depth)


def remove(index: DataFrame, matches: DataFrame) -> DataFrame:
    """The index without matches (match_id): their rows go wherever they had come."""
    return index.join(matches.select("match_id").distinct(), "match_id", "left_anti")


def prune(index: DataFrame, gone: DataFrame) -> DataFrame:
    """The index without nodes (host, entity, version) that went, as places and as origins."""
    left = index.join(gone.select(*NODE), NODE, "left_anti")
    return left.join(gone.select("host", F.concat("entity", F.lit("#v"), "version").alias("origin")), ["host", "origin"], "left_anti")


def lookups(index: DataFrame) -> DataFrame:
    """(host, entity, version, rule_id, matches, hops, seq): per node and rule, how many matches reach it, the fewest hops, the earliest place."""
    return index.groupBy(*NODE, "rule_id").agg(F.count_distinct("match_id").alias("matches"), F.min("hops").alias("hops"), F.min("seq").alias("seq"))


def gate(matches: DataFrame, versions: DataFrame, index: DataFrame, needs: dict[str, tuple[str, ...]]) -> DataFrame:
    """Matches with ``passes``: their rule needs none, or an earlier match of a needed rule reaches one of their nodes."""
    rows = [(r, n) for r, wanted in needs.items() for n in wanted]
    wanted = matches.sparkSession.createDataFrame(rows, "asks string, rule_id string")
    own = seeds(matches, versions).select(*NODE, F.col("match_id").alias("mine"), F.col("rule_id").alias("asks"), F.col("seq").alias("at"))
    hit = own.join(wanted, "asks").join(index.select(*NODE, "rule_id", "match_id", "seq"), [*NODE, "rule_id"]).where("match_id != mine and seq < at").select(F.col("mine").alias("match_id")).distinct()
    got = matches.join(hit.withColumn("__hit", F.lit(True)), "match_id", "left")
    return got.withColumn("passes", ~F.col("rule_id").isin(*needs) | F.coalesce("__hit", F.lit(False))).drop("__hit")
