"""Noise models: what is common on benign hosts is no alarm."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lineagram.functions.scalars import basename, entity_prefix, entity_shape, entity_type, path_factor_passes


def canonical_entity(entity: F.Column, image: F.Column | None = None) -> F.Column:
    """An entity's stable name: a process by its image (null without one), others without blanks, none for bare ids."""
    prefix, value = entity_prefix(entity), F.trim(F.regexp_extract(entity, "^[^:]*:(.*)$", 1))
    process = F.when(basename(image) != "", F.concat(F.lit("process_image:"), basename(image))) if image is not None else F.concat(F.lit("proc:"), value)
    return F.when(prefix.isin("proc", "proc_guid", "proc_pid"), process).when((value != "") & ~prefix.isin("uuid", "pid"), F.concat(prefix, F.lit(":"), value))


def triplets(events: DataFrame) -> DataFrame:
    """(host, seq, subject, relation, object): an event's relations between stable names; processes by ``image`` and ``target_image``."""
    has = set(events.columns)
    image = lambda c: F.col(c) if c in has else None
    got = events.select("host", "seq", F.explode("relations").alias("r"), *[c for c in ("image", "target_image") if c in has])
    out = got.select("host", "seq", canonical_entity(F.col("r.src"), image("image")).alias("subject"), F.col("r.relation").alias("relation"), canonical_entity(F.col("r.dst"), image("target_image")).alias("object"))
    return out.where("subject is not null and object is not null")


def pattern_key(*columns: str) -> F.Column:
    """Columns as one line of JSON with its keys in order, for exchange with other tools; joins use the columns."""
    return F.to_json(F.struct(*sorted(columns)))


def relation_profile(events: DataFrame, min_count: int = 5) -> DataFrame:
    """(subject, relation, object, n): triplets of events' relations seen at least so often."""
    return triplets(events).groupBy("subject", "relation", "object").agg(F.count("*").alias("n")).where(F.col("n") >= max(1, min_count))


def benign_events(events: DataFrame, known: DataFrame) -> DataFrame:
    """(host, seq): events with relations of which every one is in the profile."""
    marked = triplets(events).join(known.select("subject", "relation", "object").withColumn("__in", F.lit(1)), ["subject", "relation", "object"], "left")
    return marked.groupBy("host", "seq").agg(F.count("__in").alias("hits"), F.count("*").alias("n")).where("hits = n").select("host", "seq")


def drop_benign_events(matches: DataFrame, benign_: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(matches that stay, matches dropped): those of benign events go unless their rule bypasses the profile."""
    marked = matches.join(benign_.withColumn("__benign", F.lit(True)), ["host", "seq"], "left")
    bypass = F.coalesce(F.col("bypass"), F.lit(False)) if "bypass" in matches.columns else F.lit(False)
    gone = F.coalesce("__benign", F.lit(False)) & ~bypass
    return marked.where(~gone).select(*matches.columns), marked.where(gone).select(*matches.columns, F.lit("benign_profile_drop").alias("reason"))


def profile(events: DataFrame, min_count: int = 5) -> DataFrame:
    """(subject, op, object, n): triplets seen at least so often."""
    return events.groupBy("subject", "op", "object").agg(F.count("*").alias("n")).where(F.col("n") >= min_count)


def drop_profiled(matches: DataFrame, known: DataFrame) -> DataFrame:
    """Matches whose triplet isn't in the profile, or whose rule bypasses it."""
    rest = matches.join(known.select("subject", "op", "object"), ["subject", "op", "object"], "left_anti")
    if "bypass" not in matches.columns:
        return rest
    spared = matches.where("bypass").join(known.select("subject", "op", "object"), ["subject", "op", "object"], "left_semi")
    return rest.unionByName(spared)


def with_signature(matches: DataFrame) -> DataFrame:
    """Adds the sorted distinct shapes of the match's entities, each with its role and type, with rule, stage and operation."""
    shaped = lambda c: F.when(F.col(c).isNotNull(), F.concat(F.lit(f"{c}/"), entity_type(F.col(c)), F.lit("/"), entity_shape(F.col(c))))
    shapes = F.array_join(F.array_sort(F.array_distinct(F.array_compact(F.array(shaped("subject"), shaped("object"))))), "+")
    stage = [F.coalesce(F.col("stage").cast("string"), F.lit(""))] if "stage" in matches.columns else []
    return matches.withColumn("signature", F.concat_ws("|", "rule_id", *stage, "op", shapes))


def signatures(matches: DataFrame) -> DataFrame:
    """(rule_id, signature, n, total): how often a signature and its rule match."""
    by = with_signature(matches).groupBy("rule_id", "signature").agg(F.count("*").alias("n"))
    return by.withColumn("total", F.sum("n").over(Window.partitionBy("rule_id")))


def benign(matches: DataFrame, model: DataFrame, volumes: DataFrame, min_count: int = 5, min_ratio: float = 0.1) -> DataFrame:
    """Matches that the models call benign: signature frequent enough, else bytes within the rule's limit."""
    marked = with_signature(matches).join(model, ["rule_id", "signature"], "left").join(volumes.select("rule_id", F.col("p95").alias("most")), "rule_id", "left")
    often = (F.col("n") >= min_count) & (F.col("n") >= min_ratio * F.col("total"))
    return marked.where(F.coalesce(often, F.lit(False)) | F.coalesce(F.col("bytes") <= F.col("most"), F.lit(False)))


def volumes(matches: DataFrame, min_samples: int = 20) -> DataFrame:
    """(rule_id, samples, p50, p95, p99, most): nearest-rank percentiles of bytes."""
    at = lambda p: F.expr(f"percentile_disc({p}) within group (order by bytes)").cast("double")
    got = matches.where("bytes is not null").groupBy("rule_id").agg(F.count("*").alias("samples"), at(0.5).alias("p50"), at(0.95).alias("p95"), at(0.99).alias("p99"), F.max("bytes").cast("double").alias("most"))
    return got.where(F.col("samples") >= min_samples)


def match_bytes(matches: DataFrame, events: DataFrame) -> DataFrame:
    """Matches (with ``seqs``, their events) with ``bytes``, the sum over events that have some; null if none has."""
    each = matches.select("host", "node", F.explode("seqs").alias("seq")).join(events.select("host", "seq", F.col("bytes").alias("b")), ["host", "seq"])
    return matches.drop("bytes").join(each.groupBy("node").agg(F.sum("b").alias("bytes")), "node", "left")


def in_order(matches: DataFrame) -> list[F.Column]:
    """The order that running sums follow: place, first event, id."""
    first = F.array_min("seqs") if "seqs" in matches.columns else F.col("seq")
    return [F.coalesce("seq", first), first, F.col("match_id") if "match_id" in matches.columns else F.col("rule_id")]


def _counted(matches: DataFrame) -> DataFrame:
    return matches.where("subject is not null and subject != '' and object is not null and object != '' and bytes > 0")


def running_bytes(matches: DataFrame) -> DataFrame:
    """Adds ``so_far``: bytes of the rule and pair up to and with the match."""
    so_far = Window.partitionBy("host", "rule_id", "subject", "object").orderBy(*in_order(matches)).rowsBetween(Window.unboundedPreceding, 0)
    return matches.withColumn("so_far", F.sum("bytes").over(so_far))


def _limit(most: F.Column, margin_ratio: float, min_margin: int) -> F.Column:
    return (most + F.greatest(F.lit(max(1, min_margin)), F.ceil(most * max(0.0, margin_ratio)))).cast("long")


def thresholds(matches: DataFrame, margin_ratio: float = 0.25, min_margin: int = 1) -> DataFrame:
    """(rule_id, threshold): the largest running sum of any pair, with a margin."""
    most = running_bytes(matches).groupBy("rule_id").agg(F.max("so_far").alias("largest"))
    return most.select("rule_id", _limit(F.col("largest"), margin_ratio, min_margin).alias("threshold"))


def dynamic_thresholds(matches: DataFrame, margin_ratio: float = 0.25, min_margin: int = 1, min_samples: int = 1) -> DataFrame:
    """(rule_id, subject, object, samples, largest, threshold): limits of pairs, and with null ends of whole rules.

    Bytes are positive, so the largest running sum of a pair or rule is its sum: no order is needed to learn it."""
    rows = _counted(matches)
    agg = [F.count("*").alias("samples"), F.sum("bytes").cast("long").alias("largest")]
    pairs = rows.groupBy("rule_id", "subject", "object").agg(*agg)
    none = F.lit(None).cast("string")
    whole = pairs.groupBy("rule_id").agg(F.sum("samples").alias("samples"), F.sum("largest").alias("largest")).select("rule_id", none.alias("subject"), none.alias("object"), "samples", "largest")
    return pairs.union(whole).where(F.col("samples") >= min_samples).withColumn("threshold", _limit(F.col("largest"), margin_ratio, min_margin))


def over_threshold(matches: DataFrame, limits: DataFrame) -> DataFrame:
    """Matches from the point on at which their pair's running sum is over the rule's threshold."""
    return running_bytes(matches).join(limits, "rule_id").where(F.col("so_far") > F.col("threshold"))


def dynamic_filter(matches: DataFrame, limits: DataFrame) -> DataFrame:
    """Matches with ``dropped``: whether the running sum of their pair, or of their rule's matches without a limit for their pair, is within the limit.

    Matches without bytes or a limit stay."""
    pair = limits.where("subject is not null").select("rule_id", "subject", "object", F.col("threshold").alias("pair_limit"))
    whole = limits.where("subject is null").select("rule_id", F.col("threshold").alias("rule_limit"))
    got = matches.join(pair, ["rule_id", "subject", "object"], "left").join(whole, "rule_id", "left")
    counts = F.col("bytes") > 0
    # a key of its own for rows that no limit sums up, so that they aren't gathered
    key = F.when(~F.coalesce(counts, F.lit(False)) | F.coalesce("pair_limit", "rule_limit").isNull(), F.concat(F.lit("-"), "seq")).when(F.col("pair_limit").isNotNull(), F.concat_ws("\u0000", F.lit("p"), "rule_id", "subject", "object")).otherwise(F.concat(F.lit("r"), "rule_id"))
    so_far = F.sum("bytes").over(Window.partitionBy(key).orderBy(*in_order(matches)).rowsBetween(Window.unboundedPreceding, 0))
    got = got.withColumn("so_far", so_far)
    return got.withColumn("dropped", F.coalesce(counts & (F.col("so_far") <= F.coalesce("pair_limit", "rule_limit")), F.lit(False))).select(*matches.columns, "so_far", "dropped")


def train(matches: DataFrame, min_count: int = 5, min_samples: int = 20, margin_ratio: float = 0.25) -> dict[str, DataFrame]:
    """All models of benign matches: signatures, volumes, limits."""
    return {"signatures": signatures(matches).where(F.col("n") >= 1), "volumes": volumes(matches, min_samples), "limits": dynamic_thresholds(matches, margin_ratio)}


def save(models: dict[str, DataFrame], folder: str) -> None:
    for name, df in models.items():
        df.write.mode("overwrite").parquet(f"{folder}/{name}")


def load(spark, folder: str, names: tuple[str, ...] = ("signatures", "volumes", "limits")) -> dict[str, DataFrame]:
    """Models that were saved; volumes of an old form, with ``threshold`` alone, get it as their p95."""
    out = {n: spark.read.parquet(f"{folder}/{n}") for n in names}
    if "volumes" in out and "p95" not in out["volumes"].columns:
        out["volumes"] = out["volumes"].withColumn("p95", F.col("threshold").cast("double"))
    return out


def static_drop(matches: DataFrame, rules: frozenset[str] = frozenset(), match_ids: frozenset[str] = frozenset()) -> DataFrame:
    """Matches without those of rules, or with ids, that are listed."""
    return matches.where(~(F.col("rule_id").isin(*rules) if rules else F.lit(False)) & ~(F.col("match_id").isin(*match_ids) if match_ids else F.lit(False)))


def filter_edges(edges: DataFrame, config) -> DataFrame:
    """Scenario edges without dropped kinds, and of graph paths those with the weight and the path factor asked for."""
    path = (F.coalesce("weight", F.lit(0.0)) >= config.min_weight) & path_factor_passes(F.col("path_factor"), F.lit(config.min_path_factor), config.path_factor_op)
    kept = edges.where(~F.col("relation").isin(*config.drop_links)) if config.drop_links else edges
    return kept.where((F.col("relation") != "graph_path") | path)


def apply(matches: DataFrame, edges: DataFrame, config, models: dict[str, DataFrame] | None = None) -> tuple[DataFrame, DataFrame]:
    """(matches, edges) that stay: listed ones go, then benign ones, then those within limits; edges between what is left, filtered."""
    kept = static_drop(matches, config.drop_rules, config.drop_matches)
    if models:
        kept = kept.join(benign(kept, models["signatures"], models["volumes"]).select("node"), "node", "left_anti")
        kept = dynamic_filter(kept, models["limits"]).where("not dropped").select(*matches.columns)
    ends = kept.select("node")
    left = edges.join(ends.withColumnRenamed("node", "src_node"), "src_node", "left_semi").join(ends.withColumnRenamed("node", "dst_node"), "dst_node", "left_semi")
    return kept, filter_edges(left, config)


def counts(before: tuple[DataFrame, DataFrame], after: tuple[DataFrame, DataFrame]) -> DataFrame:
    """(what, before, after, dropped): numbers of matches and edges."""
    n = lambda df, what, when: df.agg(F.count("*").alias("n")).select(F.lit(what).alias("what"), F.lit(when).alias("at"), "n")
    rows = n(before[0], "matches", "before").union(n(after[0], "matches", "after")).union(n(before[1], "edges", "before")).union(n(after[1], "edges", "after"))
    got = rows.groupBy("what").agg(F.max(F.when(F.col("at") == "before", F.col("n"))).alias("before"), F.max(F.when(F.col("at") == "after", F.col("n"))).alias("after"))
    return got.withColumn("dropped", F.col("before") - F.col("after"))
