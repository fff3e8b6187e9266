"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

A source's documents are dealt by hash into blocks, several for each output shard, so
that a block is a small part of a shard at every size.  Its quota
of words is filled with whole passes over all its blocks and, for the rest, with
blocks in permuted order that still fit, so it is missed by less than the
smallest block not used up.  The numbers of blocks drawn from every
source are then split among the output shards: each node of a binary tree halves
its shards and draws, from a multivariate hypergeometric law, how many of its
blocks of each source go left.  A leaf is a shard; it takes the next ranks of
each source's permuted draws, so shards are disjoint, and is shuffled locally by
hash.  Everything is seeded, so reruns agree.

The driver holds a row per source (sizes, quotas, numbers per shard) and no row
per document; blocks and draws are tables, broadcast only if they are small.  A shard
is one partition of the mix.  Documents with equal id and text are in one block and
share its fate; equal sizes and sources need no order.  Null text has no words; a
null source is the last source.  An empty table gives an empty mix.  Extra columns
pass through; a column named like an added one is replaced.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lineagram.llm.common import partitions, written

#: Blocks of a source: so many at least, and so many for each output shard.
BLOCKS, BLOCKS_A_SHARD = 512, 8
#: Rows of the plan up to which it is broadcast (under 100 bytes each); beyond, it is joined by shuffle.
BROADCAST_ROWS = 200_000
WEIGHTS = (5.0, 2.0, 1.0)
MOST = 3.0
_SPACES = "' \\t\\n\\u000b\\f\\r'"


def words(col: str) -> F.Column:
    """Number of words, without Python: separators at the ends are trimmed, then the text is cut at runs of them."""
    trimmed = F.expr(f"trim(BOTH {_SPACES} FROM coalesce(cast(`{col}` as string), ''))")
    return F.when(trimmed == "", F.lit(0)).otherwise(F.size(F.split(trimmed, "[\\x20\\x09-\\x0D]+"))).cast("long")


def targets(sizes: list[tuple[str | None, int]], weights: Iterable[float] = WEIGHTS, most: float = MOST) -> dict[str | None, float]:
    """Words due from each source: shares by weight of all words, none above ``most`` times its own, the excess reshared by weight."""
    weights = tuple(weights)
    order = sorted(sizes, key=lambda x: (x[0] is None, x[0] or ""))
    weight = {s: weights[i % len(weights)] for i, (s, _) in enumerate(order)}
    total, own = float(sum(n for _, n in order)), dict(order)
    due: dict[str | None, float] = {}
    free = [s for s, _ in order]
    left = total
    while free:
        each = left / sum(weight[s] for s in free)
        over = [s for s in free if weight[s] * each > most * own[s]]
        if not over:
            due |= {s: weight[s] * each for s in free}
            break
        for s in over:
            due[s] = most * own[s]
            left -= due[s]
        free = [s for s in free if s not in due]
    return due


def split(counts: np.ndarray, shards: int, seed: int) -> np.ndarray:
    """(shards, sources): how many draws of each source go to each shard.  Shards get equal numbers but for one."""
    out = np.zeros((shards, len(counts)), np.int64)
    todo = [(0, shards, np.asarray(counts, np.int64))]
    while todo:
        lo, hi, mine = todo.pop()
        if hi - lo == 1:
            out[lo] = mine
            continue
        mid = (lo + hi) // 2
        n = int(mine.sum()) * (mid - lo) // (hi - lo)
        rng = np.random.default_rng([seed, lo, hi])
        left = rng.multivariate_hypergeometric(mine, n, method="marginals") if n else np.zeros_like(mine)
        todo += [(lo, mid, left), (mid, hi, mine - left)]
    return out


def _sized(docs: DataFrame, shards: int, seed: int) -> DataFrame:
    key = F.when(F.col("source").isNull(), F.lit("")).otherwise(F.concat(F.lit("="), F.col("source").cast("string")))
    block = F.pmod(F.xxhash64("doc_id", "text", F.lit(seed)), F.lit(max(BLOCKS, BLOCKS_A_SHARD * shards))).cast("int")
    return docs.withColumns({"size": words("text"), "__source": key, "__block": block})


def plan(docs: DataFrame, shards: int | None = None, seed: int = 7) -> tuple[DataFrame, DataFrame]:
    """(quotas, draws): per source key its size and target; per block drawn its shard, a row for each time."""
    spark = docs.sparkSession
    shards = shards or partitions(spark)
    blocks = written(_sized(docs, shards, seed).groupBy("__source", "__block").agg(F.sum("size").alias("n")))
    sizes = {r[0]: r[1] for r in blocks.groupBy("__source").agg(F.sum("n")).collect()}
    name = {k: k[1:] if k else None for k in sizes}
    due = targets([(name[k], n) for k, n in sizes.items()])
    quotas = spark.createDataFrame([(k, int(sizes[k]), float(due[name[k]])) for k in sorted(sizes)], "__source string, source_size long, target double")

    def draw(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("__block")
        key, size, due = rows["__source"].iloc[0], int(rows["source_size"].iloc[0]), float(rows["target"].iloc[0])
        rng = np.random.default_rng([seed, *key.encode()])
        ids, n = rows["__block"].to_numpy(), rows["n"].to_numpy()
        passes = min(int(due // size), int(MOST)) if size else 0
        got = [(int(b), p) for p in range(passes) for b in rng.permutation(ids)]
        rest = due - passes * size
        for again in range(passes, int(MOST)):  # what no block left fits into is filled with second copies of smaller ones
            for i in rng.permutation(len(ids)):
                if 0 < n[i] <= rest:
                    got.append((int(ids[i]), again))
                    rest -= n[i]
        return pd.DataFrame({"__source": key, "__block": [b for b, _ in got], "pass": [p for _, p in got], "rank": range(len(got))})

    draws = written(blocks.join(quotas, "__source").groupBy("__source").applyInPandas(draw, "__source string, __block int, pass int, rank long"))
    drawn = {r[0]: r[1] for r in draws.groupBy("__source").count().collect()}
    keys = sorted(drawn)
    upto = np.cumsum(split(np.array([drawn[k] for k in keys], np.int64), shards, seed), axis=0) if keys else np.zeros((shards, 0), np.int64)
    cuts = spark.createDataFrame([(k, [int(x) for x in upto[:, i]]) for i, k in enumerate(keys)], "__source string, upto array<long>")
    dealt = draws.join(cuts, "__source").select("__source", "__block", "pass", F.expr("size(filter(upto, x -> x <= rank))").alias("shard"))
    return quotas, dealt


def assign(docs: DataFrame, shards: int | None = None, seed: int = 7) -> DataFrame:
    """Adds ``size``, ``source_size``, ``target``, ``taken`` (words, repeats counted) and ``shards`` (where each copy goes)."""
    added = ("size", "source_size", "target", "taken", "shards")
    docs, shards = docs.drop(*added), shards or partitions(docs.sparkSession)
    quotas, dealt = plan(docs, shards, seed)
    where = written(dealt.groupBy("__source", "__block").agg(F.sort_array(F.collect_list(F.struct("pass", "shard"))).alias("shards")))
    small = where.count() <= BROADCAST_ROWS
    given = _sized(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"), *[c for c in ("doc_id", "text", "source")]), shards, seed)
    got = given.join(F.broadcast(quotas) if small else quotas, "__source", "left")
    got = got.join(F.broadcast(where) if small else where, ["__source", "__block"], "left")
    copies = F.coalesce(F.size("shards"), F.lit(0))
    got = got.withColumns({"taken": F.col("size") * F.when(copies > 0, copies).otherwise(0), "shards": F.coalesce("shards", F.expr("cast(array() as array<struct<pass:int,shard:int>>)"))})
    return got.select("__row.*", *added)


def mix(docs: DataFrame, shards: int | None = None, seed: int = 7) -> DataFrame:
    """The mix: a row for every copy taken, dealt into shards and shuffled within each; columns as given."""
    n = shards or partitions(docs.sparkSession)
    got = assign(docs, n, seed).select(*[F.col(c) for c in docs.columns if c not in ("size", "source_size", "target", "taken", "shards")], F.explode("shards").alias("__at"))
    order = F.xxhash64("doc_id", F.col("__at.pass"), F.lit(seed))
    return got.withColumn("__order", order).repartitionById(n, F.col("__at.shard").cast("int")).sortWithinPartitions(F.col("__at.shard"), "__order", "doc_id").drop("__at", "__order")


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the mix takes of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    return assign(docs).select("doc_id", "size", "source_size", "target", "taken", F.size("shards").alias("copies"))
