"""Streaming detection: the batch operators as a query over arriving events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lineagram.operators.rules import Rule, matches
from lineagram.sources.logs import EVENT


def read_events(spark: SparkSession, folder: str) -> DataFrame:
    """Events from JSON files that arrive in a folder."""
    return spark.readStream.schema(EVENT).json(folder)


def detect(events: DataFrame, rules: list[Rule]) -> DataFrame:
    """Rule matches of a stream; a projection, so no state."""
    return matches(events, rules)


def counts_by_window(events: DataFrame, width: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Matches by host, rule and window; state is dropped when the watermark passes."""
    return events.withWatermark("ts", late).groupBy("host", "rule_id", F.window("ts", width)).agg(F.count("*").alias("n")).select("host", "rule_id", F.col("window.start").alias("start"), "n")


def once_per_entity(found: DataFrame, late: str = "1 hour") -> DataFrame:
    """The first match of a rule on an entity within the watermark; later ones are suppressed."""
    return found.withWatermark("ts", late).dropDuplicatesWithinWatermark(["host", "rule_id", "object"])


def run_available(stream: DataFrame, out: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Works off what has arrived, writes Parquet and ends; a rerun goes on from the checkpoint."""
    query = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
    return query
