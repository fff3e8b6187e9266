"""Evaluation: coverage of known scenarios, diverse alerts, campaigns, settings."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


#: Known scenarios that fit into a plan.
MOST_SCENARIOS = 10_000


def _known(truth: DataFrame) -> list:
    rows = truth.select("scenario_id", "stages", "exact", "contains").limit(MOST_SCENARIOS + 1).collect()
    if len(rows) > MOST_SCENARIOS:
        raise ValueError(f"more than {MOST_SCENARIOS} known scenarios")
    return rows


def found_scenarios(alerts: DataFrame, truth: DataFrame) -> DataFrame:
    """Alerts (alert_id, stages, entities) with ``matched`` and ``overlapping``, ids of known scenarios (scenario_id, stages, exact, contains).

    An alert matches a scenario if it has all of its stages and exact entities and, for each text, an entity that contains
    it; it overlaps if it has any.  Known scenarios are few, so they are part of the plan and nothing is joined."""
    text = lambda xs: F.array(*[F.lit(x) for x in xs or []]).cast("array<string>")
    stages, entities = F.coalesce("stages", text([])), F.coalesce("entities", text([]))
    holds = lambda t: F.exists(entities, lambda e: F.contains(e, F.lit(t)))
    matched, overlapping = [], []
    for r in _known(truth):
        every = (F.size(F.array_except(text(r.stages), stages)) == 0) & (F.size(F.array_except(text(r.exact), entities)) == 0)
        some = F.arrays_overlap(text(r.stages), stages) | F.arrays_overlap(text(r.exact), entities)
        for t in r.contains or []:
            every, some = every & holds(t), some | holds(t)
        matched.append(F.when(every, F.lit(r.scenario_id)))
        overlapping.append(F.when(some, F.lit(r.scenario_id)))
    array = lambda xs: F.array_compact(F.array(*xs)).cast("array<string>") if xs else text([])
    return alerts.withColumns({"matched": array(matched), "overlapping": array(overlapping)})


def coverage(alerts: DataFrame, truth: DataFrame) -> DataFrame:
    """(tp, fp, fn, precision, recall, f1, fragmentation) of alerts against known scenarios.

    tp: scenarios that an alert matches; fp: alerts that match none; a scenario is fragmented if several alerts overlap
    it and none matches it, and the figure is the share of such scenarios."""
    from lineagram.session import cut

    got = cut(found_scenarios(alerts, truth))
    hit = got.select("alert_id", F.explode("matched").alias("scenario_id")).groupBy("scenario_id").agg(F.count("*").alias("hits"))
    near = got.select("alert_id", F.explode("overlapping").alias("scenario_id")).groupBy("scenario_id").agg(F.count_distinct("alert_id").alias("near"))
    by = truth.select("scenario_id").join(hit, "scenario_id", "left").join(near, "scenario_id", "left")
    row = by.agg(F.count("*").alias("known"), F.count("hits").alias("tp"), F.sum((F.col("hits").isNull() & (F.coalesce("near", F.lit(0)) > 1)).cast("long")).alias("split"))
    row = row.crossJoin(got.agg(F.coalesce(F.sum((F.size("matched") == 0).cast("long")), F.lit(0)).alias("fp")))  # one row each
    z = lambda c: F.coalesce(c, F.lit(0.0))
    p, r = z(F.try_divide("tp", F.col("tp") + F.col("fp"))), z(F.try_divide("tp", "known"))
    return row.select("tp", "fp", (F.col("known") - F.col("tp")).alias("fn"), p.alias("precision"), r.alias("recall"), z(F.try_divide(2 * p * r, p + r)).alias("f1"), z(F.try_divide("split", "known")).alias("fragmentation"))


def best_by_scenario(alerts: DataFrame) -> DataFrame:
    """One alert of each scenario_id, the highest score, then the most stages, then the last by id; alerts without a scenario all stay."""
    order = Window.partitionBy("scenario_id").orderBy(F.desc("score"), F.desc(F.size("stages")), F.desc("alert_id"))
    named = alerts.where("scenario_id is not null and scenario_id != ''")
    return named.withColumn("__r", F.row_number().over(order)).where("__r = 1").drop("__r").union(alerts.where("coalesce(scenario_id, '') = ''"))


def jaccard(a: F.Column, b: F.Column) -> F.Column:
    both = F.size(F.array_union(a, b))
    return F.when(both == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / both)


def diverse(alerts: DataFrame, k: int, threshold: float = 0.8) -> list:
    """Up to k alerts (alert_id, score, entities), the highest first, none as similar as the threshold to one chosen before.

    Each choice is one pass that finds the best alert left; the k chosen ones are all that the driver holds."""
    left, chosen = alerts, []
    while len(chosen) < k:
        best = left.orderBy(F.desc("score"), "alert_id").first()
        if best is None:
            break
        chosen.append(best)
        own = F.array(*[F.lit(e) for e in best.entities]).cast("array<string>")
        left = left.where((F.col("alert_id") != best.alert_id) & (jaccard(F.col("entities"), own) < threshold))
    return chosen


def campaigns(events: DataFrame, windows: DataFrame, tau: float, stages: int = 7) -> DataFrame:
    """(campaign, detect_seq, stage, events_to_detect): where in each campaign (campaign, first, last, stage_ends) the exact score reaches tau.

    events: seq, stage, severity.  stage is the first that ends no earlier, the last if none does, one more than there are
    stages if nothing is detected, null without ends.  Campaigns don't overlap: an event belongs to the latest one that
    begins no later, found by one window over both."""
    begin = windows.select(F.col("first").alias("seq"), F.lit(0).alias("__e"), F.col("campaign").alias("__c"), F.col("last").alias("__l"), F.lit(None).cast("int").alias("stage"), F.lit(None).cast("double").alias("severity"))
    both = begin.unionByName(events.select("seq", F.lit(1).alias("__e"), F.lit(None).cast(windows.schema["campaign"].dataType).alias("__c"), F.lit(None).cast("long").alias("__l"), F.col("stage").cast("int").alias("stage"), F.col("severity").cast("double").alias("severity")))
    held = _latest(both).where("__e = 1 and campaign is not null and seq <= last")
    so_far = Window.partitionBy("campaign").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    log = sum((F.log(F.coalesce(F.max(F.when(F.col("stage") == i, F.col("severity"))).over(so_far), F.lit(1.0))) for i in range(1, stages + 1)), F.lit(0.0))
    hit = held.withColumn("log", log).where(F.col("log") >= F.log(F.lit(tau)) - 1e-12).groupBy("campaign").agg(F.min("seq").alias("detect_seq"))
    return stage_to_detect(windows.join(hit, "campaign", "left"), stages).select("campaign", "detect_seq", "stage", (F.col("detect_seq") - F.col("first")).alias("events_to_detect"))


def _latest(both: DataFrame) -> DataFrame:
    """Rows with the campaign that began last before them; ranges of the order are worked on apart, each with the campaign that reaches into it."""
    from lineagram.session import cut

    ranged = cut(both.repartitionByRange("seq").withColumn("__p", F.spark_partition_id()))
    known = F.when(F.col("__c").isNotNull(), F.struct("seq", F.col("__c").alias("campaign"), F.col("__l").alias("last")))
    # one row a range: what the ranges before it end with
    tail = ranged.groupBy("__p").agg(F.max(known).alias("k"))
    came = {r["__p"]: r.k for r in tail.collect()}
    rows, held = [], None
    for p in sorted(came):
        rows.append((p, held))
        held = came[p] if came[p] is not None else held
    kind = tail.schema["k"].dataType
    from pyspark.sql import types as T

    before = both.sparkSession.createDataFrame(rows, T.StructType([T.StructField("__p", T.IntegerType()), T.StructField("__before", kind)]))
    order = Window.partitionBy("__p").orderBy("seq", "__e").rowsBetween(Window.unboundedPreceding, 0)
    got = ranged.withColumn("__k", F.last(known, ignorenulls=True).over(order)).join(before, "__p")
    return got.withColumn("__k", F.coalesce("__k", "__before")).select("seq", "__e", "stage", "severity", "__k.campaign", "__k.last")


def stage_to_detect(results: DataFrame, stages: int = 7) -> DataFrame:
    """Adds ``stage``: at which stage (of stage_ends) detect_seq lies."""
    at = F.array_position(F.transform("stage_ends", lambda e: e >= F.col("detect_seq")), True)
    n = F.size("stage_ends")
    return results.withColumn("stage", F.when(F.col("detect_seq").isNull(), F.lit(stages + 1)).when(F.coalesce(n, F.lit(0)) <= 0, F.lit(None)).when(at > 0, at).otherwise(n).cast("int"))


def grid(limits: list[int], thresholds: list[float], run) -> list[dict]:
    """One result of run(limit, threshold), a mapping with f1, recall and fragmentation, for each pair of settings; the best first."""
    rows = [{"max_path_factor": m, "threshold": t, **run(m, t)} for m in limits for t in thresholds]
    return sorted(rows, key=lambda r: (-r["f1"], -r["recall"], r["fragmentation"]))


def experiment(train, tune, evaluate, limits: list[int], thresholds: list[float]) -> dict:
    """Trains on benign events, tunes settings on known ones, evaluates with the best; the three are functions over models and settings."""
    models = train()
    table = grid(limits, thresholds, lambda m, t: tune(models, m, t))
    best = table[0]
    return {"grid": table, "best": best, "result": evaluate(models, best["max_path_factor"], best["threshold"])}


def throughput(run, events: DataFrame, rounds: int = 3) -> dict:
    """(events, seconds of each round, events_per_second of the best, peak_mb of the driver): of run(events), a function to a DataFrame."""
    import resource
    import time

    n, took = events.count(), []
    for _ in range(rounds):
        began = time.perf_counter()
        run(events).write.format("noop").mode("overwrite").save()
        took.append(time.perf_counter() - began)
    return {"events": n, "seconds": took, "p50": sorted(took)[len(took) // 2], "events_per_second": n / min(took), "peak_mb": resource.getrusage(resource.RUSAGE_SELF).ru_maxrss / 1024}


def best_settings(results: DataFrame) -> DataFrame:
    """Grid results (.., f1, recall, fragmentation), the best first."""
    return results.orderBy(F.desc("f1"), F.desc("recall"), "fragmentation")


def synthetic_events(spark, n: int, attack_every: int = 100, seed: int = 7) -> DataFrame:
    """A stream to measure with: benign events and, now and then, one of an attack's stages; the same for a seed."""
    h = F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1 << 31))
    attack = h % attack_every == 0
    return spark.range(n).select(
        F.col("id").alias("seq"), F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id")).alias("ts"), F.concat(F.lit("h"), h % 16).alias("host"), F.concat(F.lit("proc:u"), h % 97).alias("subject"),
        F.when(attack, F.element_at(F.array(*[F.lit(o) for o in ("write", "connect", "modify", "fork")]), (h / attack_every % 4 + 1).cast("int"))).otherwise("read").alias("op"),
        F.concat(F.lit("file:/tmp/k"), h % 211).alias("object"), (h % 10_000).alias("bytes"),
    )


def min_vertex_cut(edges: DataFrame) -> DataFrame:
    """(pair, cut): the fewest inner nodes whose removal parts source from sink, by augmenting paths on the split graph.

    Ends with an edge between them, and a node with itself, can't be parted: 0; without a path there is no cut: null.

    edges: pair, source, sink, src, dst, the subgraph of each pair; a pair is one task, so its subgraph must be bounded."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        source, sink = rows["source"].iloc[0], rows["sink"].iloc[0]
        big, room = 1 << 30, {}

        def add(a, b, c):
            room.setdefault(a, {})[b] = room.get(a, {}).get(b, 0) + c
            room.setdefault(b, {}).setdefault(a, 0)

        for node in pd.unique(pd.concat([rows["src"], rows["dst"]])):
            add((node, 0), (node, 1), big if node in (source, sink) else 1)
        direct = False
        for a, b in zip(rows["src"], rows["dst"], strict=True):
            direct |= (a, b) == (source, sink)
            add((a, 1), (b, 0), big)
        cut = 0
        while not direct and source != sink and (path := _path(room, (source, 1), (sink, 0))):
            for a, b in zip(path, path[1:], strict=False):
                room[a][b] -= 1
                room[b][a] += 1
            cut += 1
        linked = direct or source == sink or cut > 0
        return pd.DataFrame({"pair": [rows["pair"].iloc[0]], "cut": pd.array([cut if linked else None], "Int64")})

    return edges.groupBy("pair").applyInPandas(run, "pair long, cut long")


def _path(room: dict, start, end) -> list:
    before, todo = {start: None}, [start]
    for at in todo:
        if at == end:
            out = []
            while at is not None:
                out.append(at)
                at = before[at]
            return out[::-1]
        for to, left in room.get(at, {}).items():
            if left > 0 and to not in before:
                before[to] = at
                todo.append(to)
    return []
