"""Audit events derived from the generic ``events`` table.

An event has a total order ``seq``, a host, a subject, an operation, an object and
a byte count.  Entities live on hosts: all graph operators work by (host, entity).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def prov_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = spark.read.parquet(f"{sf_dir}/events.parquet")
    k = F.regexp_extract("props", "[0-9]+", 0).cast("int")
    kind = F.col("event_type")
    op = F.when(kind == "view", "read").when(kind == "purchase", "write").when(kind == "click", "connect").when(kind == "signup", "fork").otherwise("modify")
    target = (
        F.when(kind == "view", F.concat(F.lit("file:/var/k"), k))
        .when(kind == "purchase", F.concat(F.lit("file:/tmp/k"), k))
        .when(kind == "click", F.concat(F.lit("ip:10.0."), k % 8, F.lit("."), k))
        .when(kind == "signup", F.concat(F.lit("proc:u"), (F.col("user_id") * 7 + k) % 150))
        .otherwise(F.concat(F.lit("reg:HKLM/Run/k"), k))
    )
    return raw.select(
        F.col("event_id").alias("seq"),
        "ts",
        F.concat(F.lit("h"), F.col("user_id") % 50).alias("host"),
        F.concat(F.lit("proc:u"), F.col("user_id")).alias("subject"),
        op.alias("op"),
        target.alias("object"),
        F.round(F.col("value") * 100).cast("long").alias("bytes"),
    )


#: The same rows for a SQL engine, as the body of a common table expression.
PROV_SQL = """
  select event_id as seq, ts, 'h' || (user_id % 50) as host, 'proc:u' || user_id as subject,
    case event_type when 'view' then 'read' when 'purchase' then 'write' when 'click' then 'connect' when 'signup' then 'fork' else 'modify' end as op,
    case event_type when 'view' then 'file:/var/k' || k when 'purchase' then 'file:/tmp/k' || k
      when 'click' then 'ip:10.0.' || (k % 8) || '.' || k when 'signup' then 'proc:u' || ((user_id * 7 + k) % 150)
      else 'reg:HKLM/Run/k' || k end as object,
    cast(round(value * 100) as bigint) as bytes
  from (select *, cast(regexp_extract(props, '[0-9]+') as int) as k from events)
"""
