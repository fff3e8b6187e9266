"""Correlations over time: counts in windows, events near each other, rates, campaigns."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def count_by_window(events: DataFrame, by: list[str], width: str, least: int) -> DataFrame:
    """Groups with at least so many events in a tumbling window."""
    got = events.groupBy(*by, F.window("ts", width).alias("w")).agg(F.count("*").alias("n"))
    return got.where(F.col("n") >= least).select(*by, F.col("w.start").alias("start"), "n")


def distinct_by_window(events: DataFrame, by: list[str], of: str, width: str, least: int) -> DataFrame:
    """Groups with at least so many different values in a tumbling window; values are made distinct before they are counted."""
    one = events.select(*by, F.window("ts", width).alias("w"), of).distinct()
    got = one.groupBy(*by, "w").agg(F.count(of).alias("n"))
    return got.where(F.col("n") >= least).select(*by, F.col("w.start").alias("start"), "n")


def near(events: DataFrame, by: list[str], first: F.Column, second: F.Column, seconds: int) -> DataFrame:
    """Events of the second kind with the latest one of the first kind before them, if it is near: one window, no join of all pairs."""
    order = Window.partitionBy(*by).orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    got = events.withColumn("near_ts", F.max(F.when(first, F.col("ts"))).over(order)).where(second)
    return got.where(F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.col("near_ts").cast("timestamp")) <= seconds * 1_000_000)


def rates(events: DataFrame, width: str = "1 day", slide: str = "12 hours") -> DataFrame:
    """(start, n): events in sliding windows."""
    return events.groupBy(F.window("ts", width, slide).alias("w")).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "n")


def campaign_metrics(results: DataFrame, said: str, true: str) -> DataFrame:
    """(tp, fp, tn, fn, precision, recall, f1) of one row per campaign."""
    n = lambda c: F.sum(c.cast("long"))
    s, t = F.col(said), F.col(true)
    got = results.agg(n(s & t).alias("tp"), n(s & ~t).alias("fp"), n(~s & ~t).alias("tn"), n(~s & t).alias("fn"))
    p, r = F.try_divide("tp", F.col("tp") + F.col("fp")), F.try_divide("tp", F.col("tp") + F.col("fn"))
    f1 = F.try_divide(2 * p * r, p + r)
    z = lambda c: F.round(F.coalesce(c, F.lit(0.0)), 6)
    return got.select("tp", "fp", "tn", "fn", z(p).alias("precision"), z(r).alias("recall"), z(f1).alias("f1"))
