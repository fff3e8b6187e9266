"""Audit logs: raw lines, normalization to one event model, dialects."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lineagram.functions.scalars import BYTE_FIELDS, extract_bytes, parse_ts, truthy

# Field names that inputs use.
ID_FIELDS = ("event_id", "id", "uuid")
TS_FIELDS = ("ts", "timestamp", "time")
TYPE_FIELDS = ("event_type", "op", "type")


def raw_lines(spark: SparkSession, path: str) -> DataFrame:
    """Non-empty lines of text files (gzip by their name) with file and offset-free line text.

    The total order has to be in the data: lines of many files have none of their own."""
    return spark.read.text(path).where(F.trim("value") != "").select("value", F.col("_metadata.file_path").alias("file"))


def record_count(lines: DataFrame) -> int:
    return lines.count()


def strict(lines: DataFrame, schema: str) -> DataFrame:
    """Records parsed by a schema; the first one that is broken ends the job."""
    return lines.select("*", F.from_json("value", schema, {"mode": "FAILFAST"}).alias("r"))


def parse_counts(lines: DataFrame) -> DataFrame:
    """(lines, objects, broken, blank): how many lines there are, and what becomes of them."""
    n = lambda c: F.sum(F.coalesce(c, F.lit(False)).cast("long"))
    good = F.expr("try_parse_json(value) is not null") & F.startswith(F.trim("value"), F.lit("{"))
    blank = F.trim("value") == ""
    return lines.agg(F.count("*").alias("lines"), n(good).alias("objects"), n(~good & ~blank).alias("broken"), n(blank).alias("blank"))


def follow_lines(spark: SparkSession, folder: str, pattern: str = "*.jsonl") -> DataFrame:
    """The same as a stream of files that arrive in a folder."""
    return spark.readStream.format("text").option("pathGlobFilter", pattern).load(folder).where(F.trim("value") != "")


def field(*names: str, of: str = "value") -> Column:
    """The first of the JSON fields that holds text."""
    return F.coalesce(*[F.nullif(F.get_json_object(of, f"$.{n}"), F.lit("")) for n in names])


def normalize(lines: DataFrame, seq: Column | None = None) -> DataFrame:
    """Events from JSON lines; broken lines are dropped, an id that is missing is made from the order."""
    order = seq if seq is not None else F.get_json_object("value", "$.seq").try_cast("bigint")
    ok = lines.where(F.expr("try_parse_json(value) is not null") & F.startswith(F.trim("value"), F.lit("{"))).withColumn("seq", order)
    fields = {n: F.get_json_object("value", f"$.{n}") for n in {*BYTE_FIELDS}}
    return ok.select(
        "seq",
        F.coalesce(field(*ID_FIELDS), F.concat(F.lit("evt-"), F.col("seq"))).alias("event_id"),
        parse_ts(field(*TS_FIELDS)).alias("ts"),
        F.coalesce(field(*TYPE_FIELDS), F.lit("unknown")).alias("event_type"),
        field("subject").alias("subject"),
        field("object").alias("object"),
        extract_bytes(fields).alias("bytes"),
        F.coalesce(truthy(field("subject_state_change")), F.lit(False)).alias("subject_state_change"),
        F.coalesce(truthy(field("object_state_change")), F.lit(False)).alias("object_state_change"),
        F.col("value").alias("raw"),
    )


def prefilter(lines: DataFrame, benign: list[str], threats: list[str], column: str = "value", spared: tuple[str, ...] = ("com.bbn.tc.schema.avro", '"datum"')) -> DataFrame:
    """Drops lines that hold a benign marker and neither a threat keyword nor a mark of DARPA records; case doesn't matter."""
    low = F.lower(column)
    has = lambda words: F.lit(False) if not words else F.regexp_like(low, F.lit("|".join(_literal(w.lower()) for w in words)))
    return lines.where(~F.coalesce(has(benign) & ~has([*threats, *spared]), F.lit(False)))


def _literal(word: str) -> str:
    return "\\Q" + word.replace("\\E", "\\E\\\\E\\Q") + "\\E"


def as_of(events: DataFrame, definitions: DataFrame, key: str, value: str) -> DataFrame:
    """Adds to each event the newest definition of its key at or before it (both have seq): one window over their union, no range join."""
    from pyspark.sql import Window

    names = events.columns
    none = lambda c: F.lit(None).cast(events.schema[c].dataType).alias(c)
    left = events.select(*names, F.lit(None).cast(definitions.schema[value].dataType).alias("__v"), F.lit(1).alias("__e"))
    right = definitions.select(*[F.col(c) if c in (key, "seq") else none(c) for c in names], F.col(value).alias("__v"), F.lit(0).alias("__e"))
    # events without a key have nothing to find: they are spread, not gathered in one task
    group = F.coalesce(F.col(key).cast("string"), F.concat(F.lit("\u0000"), F.pmod(F.xxhash64("seq"), F.lit(4096))))
    order = Window.partitionBy(group).orderBy("seq", "__e").rowsBetween(Window.unboundedPreceding, 0)
    return left.union(right).withColumn(value, F.last("__v", ignorenulls=True).over(order)).where("__e = 1").select(*names, value)


EVENT = T.StructType([T.StructField("seq", T.LongType()), T.StructField("ts", T.TimestampType()), T.StructField("host", T.StringType()), T.StructField("subject", T.StringType()), T.StructField("op", T.StringType()), T.StructField("object", T.StringType()), T.StructField("bytes", T.LongType())])
