"""What comes out: snapshots, alerts, telemetry, artifacts, samples.

Tables are written by executors as JSON lines, CSV or Parquet; nulls are left out of
JSON.  Only single rows and one scenario's artifact pass through the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Elements of one scenario's artifact, which is one line of JSON.
MOST_ELEMENTS = 100_000


def match_rows(matches: DataFrame, legacy: bool = False) -> DataFrame:
    """The columns of matches that a snapshot shows: with those that were added later unless it is of the old form."""
    base = ["match_id", "rule_id", "seq", "subject", "object"]
    more = [] if legacy else [c for c in ("host", "stage", "severity", "bytes", "bindings") if c in matches.columns]
    return matches.select(*base, *more)


def lines(df: DataFrame, folder: str, append: bool = False) -> None:
    """JSON lines of a table; appended to what is there, or in its place."""
    df.write.mode("append" if append else "overwrite").json(folder)


def table_csv(df: DataFrame, folder: str) -> None:
    """CSV with a header; arrays, maps and structs as JSON."""
    flat = [F.to_json(F.col(f.name)).alias(f.name) if f.dataType.typeName() in ("array", "map", "struct") else F.col(f.name) for f in df.schema.fields]
    df.select(*flat).write.mode("overwrite").option("header", True).csv(folder)


def summary(events: DataFrame, matches: DataFrame, edges: DataFrame, scores: DataFrame) -> DataFrame:
    """One row: numbers of events, matches, links and scenarios, matches by rule, and the highest score."""
    n = lambda df, name: df.agg(F.count("*").alias(name))
    by_rule = matches.groupBy("rule_id").agg(F.count("*").alias("n")).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("rule_id", "n")))).alias("matches_by_rule"))
    best = scores.agg(F.max("score").alias("top_score"), F.count("*").alias("scenarios"))
    return n(events, "events").crossJoin(n(matches, "matches")).crossJoin(n(edges, "links")).crossJoin(by_rule).crossJoin(best)  # one row each


def snapshot(folder: str, events: DataFrame, matches: DataFrame, edges: DataFrame, scores: DataFrame, legacy: bool = False) -> None:
    """Writes matches, links, scenarios, and a summary of one line."""
    lines(match_rows(matches, legacy), f"{folder}/matches")
    lines(edges, f"{folder}/hsg")
    lines(scores, f"{folder}/result")
    lines(summary(events, matches, edges, scores).coalesce(1), f"{folder}/summary")


def scenario_graph(matches: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of the scenario graph among some matches, as elements with ``data``."""
    nodes = matches.select(F.struct(F.col("node").cast("string").alias("id"), F.lit("hsg_match").alias("kind"), "rule_id", F.array("subject", "object").alias("entities")).alias("data"))
    ends = matches.select("node")
    own = edges.join(ends.withColumnRenamed("node", "src_node"), "src_node", "left_semi").join(ends.withColumnRenamed("node", "dst_node"), "dst_node", "left_semi")
    name = F.concat("src_node", F.lit("->"), "dst_node", F.lit(":"), "relation")
    return nodes, own.select(F.struct(name.alias("id"), F.lit("hsg_edge").alias("kind"), F.col("src_node").cast("string").alias("source"), F.col("dst_node").cast("string").alias("target"), "relation", "weight", "path_factor").alias("data"))


def induced(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Provenance edges whose ends are both among nodes (host, entity, version)."""
    side = lambda c: nodes.select("host", F.col("entity").alias(c), F.col("version").alias(f"{c}_version")).distinct()
    return edges.join(side("src"), ["host", "src", "src_version"], "left_semi").join(side("dst"), ["host", "dst", "dst_version"], "left_semi")


def provenance_nodes(events: DataFrame, entities: DataFrame, tainted: DataFrame | None = None, privileged: DataFrame | None = None) -> DataFrame:
    """(host, entity, version): what an artifact shows: current versions of entities, tainted and privileged ones, minimal common ancestors
    of pairs of entities, and nodes of the shortest paths between them both ways.  entities: (host, entity) of one scenario, a bounded set."""
    from lineagram.operators import graph, paths

    named = entities.select("host", "entity").distinct()
    kept = named
    for more in (tainted, privileged):
        kept = kept if more is None else kept.union(more.select("host", "entity"))
    now = graph.current(events).join(kept.distinct(), ["host", "entity"], "left_semi")
    pairs = named.withColumnRenamed("entity", "x").join(named.withColumnRenamed("entity", "y"), "host").where("x < y")
    shared = paths.common_ancestors(events, pairs).where("minimal").select("host", "entity", "version")
    ways = pairs.union(pairs.select("host", F.col("y").alias("x"), F.col("x").alias("y")))
    walked = paths.shortest_paths(graph.edges(events), ways, graph.nodes(events)).select("host", F.explode("nodes").alias("n"))
    walked = walked.select("host", F.regexp_replace("n", "#v[0-9]+$", "").alias("entity"), F.regexp_extract("n", "#v([0-9]+)$", 1).cast("int").alias("version"))
    return now.union(shared).union(walked).distinct()


def provenance_elements(edges: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) as elements: entities and versions, and the edges between the versions."""
    own = induced(edges, nodes)
    at = lambda e, v: F.concat(F.col(e), F.lit("#v"), F.col(v))
    ends = nodes.select("entity").union(own.select(F.explode(F.array("src", "dst")))).distinct()
    none = F.lit(None)
    entity = ends.select(F.struct(F.col("entity").alias("id"), F.lit("entity").alias("kind"), F.col("entity").alias("label"), none.cast("string").alias("entity_id"), none.cast("int").alias("version")).alias("data"))
    version = nodes.select(F.struct(at("entity", "version").alias("id"), F.lit("version_node").alias("kind"), at("entity", "version").alias("label"), F.col("entity").alias("entity_id"), F.col("version").cast("int").alias("version")).alias("data"))
    name = F.concat("seq", F.lit(":"), at("src", "src_version"), F.lit("->"), at("dst", "dst_version"), F.lit(":"), "kind")
    return entity.union(version), own.select(F.struct(name.alias("id"), F.lit("provenance_edge").alias("kind"), at("src", "src_version").alias("source"), at("dst", "dst_version").alias("target"), F.col("seq"), F.col("kind").alias("edge_type"), F.col("src").alias("src_entity"), F.col("dst").alias("dst_entity")).alias("data"))


def artifact(folder: str, scenario: str, scenario_parts: tuple[DataFrame, DataFrame], provenance_parts: tuple[DataFrame, DataFrame]) -> None:
    """Writes one scenario as one line of JSON for graph viewers; raises if it has more elements than a line can bear."""
    sizes = [p.limit(MOST_ELEMENTS + 1).count() for p in (*scenario_parts, *provenance_parts)]
    if max(sizes) > MOST_ELEMENTS:
        raise ValueError(f"{scenario}: over {MOST_ELEMENTS} elements")
    packed = lambda parts: parts[0].agg(F.sort_array(F.collect_list(F.struct("data"))).alias("nodes")).crossJoin(parts[1].agg(F.sort_array(F.collect_list(F.struct("data"))).alias("edges"))).select(F.struct("nodes", "edges").alias("g"))
    row = packed(scenario_parts).withColumnRenamed("g", "hsg").crossJoin(packed(provenance_parts).withColumnRenamed("g", "provenance"))  # one row each
    row.select(F.lit(scenario).alias("scenario_id"), "hsg", "provenance").coalesce(1).write.mode("overwrite").json(f"{folder}/{scenario}")


def sample(raw: DataFrame, most: int | None = None, start: str | None = None, end: str | None = None) -> DataFrame:
    """Lines (value, seq) whose time, compared as text, lies between start and end, the first so many of them."""
    ts = F.coalesce(F.get_json_object("value", "$.ts"), F.get_json_object("value", "$.timestamp"))
    got = raw.where(F.expr("try_parse_json(value) is not null"))
    got = got if start is None else got.where(ts >= start)
    got = got if end is None else got.where(ts <= end)
    return got if most is None else got.orderBy("seq").limit(most)
