"""The detection job over a stream: state in tables, one batch at a time.

Each batch of events is written under its number, so a batch that is run again after a
failure replaces itself; nothing else is kept in memory.  A batch is matched, passed
through the noise models and written; every ``refresh`` batches the retained tables
give the scenario graph, scores and alerts.  What is older than the retention, by the
time of the latest event, is no longer read, and its batches can be deleted.

The watermark is the time of the batch's last event in the total order, as the engine's
users know it; Spark's own watermark (see job.py) only moves forward.  Events that come
late are processed when they come.
"""

from __future__ import annotations

import time
from collections import deque
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lineagram.operators import graph, hsg, noise, state
from lineagram.operators.rules import Rule, matches, rule_table
from lineagram.sources import cdr, logs


@dataclass
class Options:
    refresh: int = 1
    threshold: float = 80.0
    delta: float = 10.0
    retention_days: float = 60.0
    taint_days: float = 7.0
    pending_days: float = 30.0
    dormant_days: float = 60.0
    most_pending: int = 100_000
    most_candidates: int = 200
    rate_seconds: float = 300.0
    gc_every: int = 10
    noise: object | None = None
    models: dict[str, DataFrame] | None = None
    profile: DataFrame | None = None


@dataclass
class Engine:
    """State folder, rules and options of one job; ``folder`` is shared by the driver and the executors."""

    spark: SparkSession
    folder: str
    rules: list[Rule]
    options: Options = field(default_factory=Options)
    listeners: list[Callable[[str, DataFrame], None]] = field(default_factory=list)
    rates: deque = field(default_factory=lambda: deque(maxlen=10_000))

    def table(self, name: str) -> DataFrame | None:
        """All batches of a state table; None before the first."""
        try:
            got = self.spark.read.parquet(f"{self.folder}/{name}")
        except Exception as e:  # noqa: BLE001
            if "PATH_NOT_FOUND" in str(e):
                return None
            raise
        return got

    def put(self, name: str, df: DataFrame, batch: int) -> None:
        df.write.mode("overwrite").parquet(f"{self.folder}/{name}/batch={batch}")
        for tell in self.listeners:
            tell(name, df)

    def process(self, events: DataFrame, batch: int) -> None:
        """Works off one batch of events (host, seq, ts, subject, op, object, bytes, ..)."""
        began = time.time()
        self.put("events", events, batch)
        events = self.spark.read.parquet(f"{self.folder}/events/batch={batch}")
        found = matches(events, self.rules).join(rule_table(self.spark, self.rules), "rule_id")
        found = hsg.with_ids(found)
        dropped = found.limit(0).withColumn("reason", F.lit(""))
        if self.options.profile is not None:
            found, dropped = noise.drop_benign_events(found, noise.benign_events(state.with_relations(events), self.options.profile))
        if self.options.models:
            found = found.join(noise.benign(found, self.options.models["signatures"], self.options.models["volumes"]).select("node"), "node", "left_anti")
        self.put("matches", found, batch)
        self.put("dropped", dropped.select("match_id", "rule_id", "reason"), batch)
        if batch % max(1, self.options.refresh) == 0:
            self.refresh(batch)
        last = events.agg(F.max_by("ts", "seq").alias("t"), F.count("*").alias("n")).first()
        took = time.time() - began
        self.rates.append((time.time(), last.n))
        row = self.spark.createDataFrame([(batch, last.n, took, self.rate(), str(last.t))], "batch long, events long, seconds double, events_per_second double, watermark string")
        row.coalesce(1).write.mode("overwrite").json(f"{self.folder}/metrics/batch={batch}")
        if self.options.gc_every and batch % self.options.gc_every == 0:
            self.collect_garbage()

    def process_lines(self, lines: DataFrame, batch: int, keywords: tuple[list[str], list[str]] | None = None) -> None:
        """Works off a batch of raw lines (value, seq) of any dialect; keywords: benign markers and threat words of the prefilter."""
        kept = lines if keywords is None else logs.prefilter(lines, *keywords)
        host = F.coalesce(*[F.nullif(F.get_json_object("raw", f"$.{n}"), F.lit("")) for n in ("host", "hostname", "hostId")], F.lit(""))
        events = cdr.to_events(kept).withColumns({"host": host, "op": F.coalesce(F.get_json_object("raw", "$.op"), F.col("event_type"))})
        self.process(events.where("subject is not null and object is not null"), batch)

    def rate(self) -> float:
        """Events a second over the last ``rate_seconds``."""
        now = time.time()
        recent = [(t, n) for t, n in self.rates if now - t <= self.options.rate_seconds]
        return sum(n for _, n in recent) / max(now - recent[0][0], 1e-9) if len(recent) > 1 else 0.0

    def watermark(self) -> F.Column:
        events = self.table("events")
        last = events.agg(F.max_by("ts", "seq").alias("t")).first().t if events is not None else None
        return F.lit(last).cast("timestamp")

    def retained(self, name: str, days: float) -> DataFrame | None:
        """A state table without rows older than so many days before the watermark."""
        got = self.table(name)
        if got is None:
            return None
        return got.where(F.unix_seconds(self.watermark()) - F.unix_seconds(F.col("ts").cast("timestamp")) < days * 86400)

    def refresh(self, batch: int) -> None:
        """Scenario graph, scores and alerts from what is retained."""
        o = self.options
        events, found = self.retained("events", o.retention_days), self.retained("matches", o.retention_days)
        if events is None or found is None or found.isEmpty():
            return
        kept, paths = hsg.build(events, found, self.rules, o.most_candidates)
        pending = found.join(kept.select("node"), "node", "left_anti")
        old = state.pending_expired(pending, int(o.pending_days * 86400)).select("node")
        pending = pending.join(old, "node", "left_anti")
        pending = pending.join(hsg.evict_pending(pending, o.most_pending).select("node"), "node", "left_anti")
        asleep = hsg.dormant(kept, int(o.dormant_days * 86400)).select("scenario")
        kept = kept.join(asleep, "scenario", "left_anti")
        if o.noise is not None:
            paths = noise.filter_edges(paths, o.noise)
        scores = hsg.legacy_scores(kept, self.rules, paths).join(hsg.paper_scores(kept, path_edges=paths), "scenario").join(hsg.exact_scores(kept, path_edges=paths), "scenario")
        self.put("scores", scores, batch)
        self.put("pending", pending, batch)
        self.put("top", hsg.top(scores.withColumn("scenario", F.col("scenario").cast("string")), "weighted"), batch)
        # alerts are a function of the matches in order: only those not told yet are written
        raised = hsg.alerts(kept, o.threshold, o.delta)
        told = self.table("alerts")
        new = raised if told is None else raised.join(told.where(F.col("batch") < batch).select("scenario", "node"), ["scenario", "node"], "left_anti")
        self.put("alerts", new, batch)
        tainted = state.last_tainted(events, state.taint(events, state.seeds(found, self.rules)))
        self.put("tainted", state.evict_taint(tainted, self.watermark(), int(min(o.taint_days, o.retention_days) * 86400)), batch)

    def latest(self, name: str) -> DataFrame | None:
        """A table as its last batch left it."""
        got = self.table(name)
        if got is None:
            return None
        last = got.agg(F.max("batch").alias("b")).first().b
        return got.where(F.col("batch") == last)

    def protected(self) -> DataFrame:
        """(host, entity) that pruning spares: ends of matches, and tainted ones."""
        found, tainted = self.table("matches"), self.latest("tainted")
        ends = found.select("host", F.explode(F.array("subject", "object")).alias("entity"))
        return (ends if tainted is None else ends.union(tainted.select("host", "entity"))).distinct()

    def pruned(self, most_nodes: int = 0, most_edges: int = 0, low: float = 1.0) -> DataFrame:
        """Version nodes that the retention and the caps let go."""
        return graph.prunable(self.table("events"), int(self.options.retention_days * 86400), self.protected(), most_nodes, most_edges, low)

    def collect_garbage(self) -> list[str]:
        """Deletes batches whose events are all older than the retention; gives their folders back."""
        events = self.table("events")
        if events is None:
            return []
        last = events.groupBy("batch").agg(F.max("ts").alias("t")).where(F.unix_seconds(self.watermark()) - F.unix_seconds(F.col("t").cast("timestamp")) >= self.options.retention_days * 86400)
        jvm, gone = self.spark._jvm, []
        for r in last.collect():  # a row a batch that goes
            for name in ("events", "matches", "dropped"):
                path = jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}/batch={r.batch}")
                path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
                gone.append(f"{name}/batch={r.batch}")
        return gone

    def summary(self) -> DataFrame:
        """One row of numbers over the whole state."""
        n = lambda name: F.lit(0 if (t := self.table(name)) is None else t.count()).cast("long").alias(name)
        return self.spark.range(1).select(*[n(x) for x in ("events", "matches", "dropped", "alerts")])

    def run(self, stream: DataFrame, checkpoint: str, trigger: dict | None = None, raw: bool = False) -> StreamingQuery:
        """Works off a stream of events, or of raw lines; by default what has arrived, then it ends.  A rerun goes on from the checkpoint."""
        step = self.process_lines if raw else self.process
        query = stream.writeStream.foreachBatch(lambda df, batch: step(df, batch)).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
        if trigger is None:
            query.awaitTermination()
        return query
