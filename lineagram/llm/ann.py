"""Approximate nearest neighbours: an NN-descent graph and greedy search on it.

Equal vectors are one node, named by their smallest id; a node keeps the few
smallest ids that a result can show, so a vector that a third of all rows share is
one row.  The first graph comes from blocks of rows that lie next to each other
under random splits (hyperplanes between pairs of a bounded sample).  Then every
round joins the neighbours of each node, in both directions, with each other:
pairs with a link that is new since the last round and better than a node's worst
neighbour are handed to it, and it keeps the best ``DEGREE``.  Rounds end when
under ``SETTLED`` of the links are new.  Reverse neighbours of a round are the
``DEGREE`` nearest ones; what a hub leaves out it meets from the other side in its
neighbours' groups.

A query starts at its own node and expands the best nodes among the ``BEAM`` best
found that aren't expanded yet, ``WIDTH`` at a time, until none is left; scores
are cosines in double precision on the original vectors.  All queries of a hop
are one join, and what a query meets depends on the beam, hardly on the number of rows.

Vectors that are null, empty, zero, or hold null or non-finite components take no
part, nor do vectors of another length than the most frequent one or of a null id.
Rows of one id and equal vectors count once, as candidates and as queries; those of
one id and other vectors are rows of their own, but no row finds its own id.  Equal
scores go to the smaller id.  An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lineagram.llm.common import partitions, written

DEGREE, ROUNDS, SETTLED = 48, 8, 0.02
SPLITS, BLOCK, SAMPLE = 4, 128, 512
#: Groups of neighbours that are compared in one task, at most.
LOT = 4096
BEAM, WIDTH = 32, 16
HALF = np.float16


def _matrix(column: pa.Array, kind=np.float32) -> np.ndarray:
    """Rows of a column of equally long lists."""
    n = len(column)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.astype(kind, copy=False).reshape(n, len(flat) // n if n else 1)


def _halves(column: pa.Array) -> np.ndarray:
    raw = b"".join(column.to_pylist())
    return np.frombuffer(raw, HALF).reshape(len(column), -1).astype(np.float32)


def nodes(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", show: int = 6) -> DataFrame:
    """(node, key, ids, vec, unit): the distinct vectors; unit is scaled to length one, in half precision."""
    kind = "float" if vectors.schema[vec_col].dataType.simpleString() == "array<float>" else "double"  # as given; sums are in double
    src = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast(f"array<{kind}>").alias("vec"))
    ok = F.col("vec").isNotNull() & (F.size("vec") > 0) & F.forall("vec", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))) & F.exists("vec", lambda c: c != 0)
    src = src.where(F.coalesce(ok, F.lit(False)) & F.col("id").isNotNull())
    size = src.groupBy(F.size("vec").alias("n")).count().orderBy(F.desc("count"), "n").first()
    src = src.where(F.size("vec") == (size.n if size else 0))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            vec, ids = _matrix(b.column("vec"), np.float64), b.column("id").to_numpy()
            best: dict[bytes, list[int]] = {}
            at: dict[bytes, int] = {}
            for i, row in enumerate(vec + 0.0):
                key = hashlib.md5(row.tobytes()).digest()
                best.setdefault(key, []).append(int(ids[i]))
                at.setdefault(key, i)
            rows = list(at.values())
            scaled = vec[rows] / np.abs(vec[rows]).max(1, keepdims=True)
            unit = scaled / np.linalg.norm(scaled, axis=1, keepdims=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(best), pa.binary()), pa.array([sorted(set(v))[:show] for v in best.values()], pa.list_(pa.int64())), b.column("vec").take(pa.array(rows)), pa.array([u.astype(HALF).tobytes() for u in unit], pa.binary())],
                ["key", "ids", "vec", "unit"],
            )

    got = src.mapInArrow(run, f"key binary, ids array<long>, vec array<{kind}>, unit binary")
    whole = got.groupBy("key").agg(F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))), 1, show).alias("ids"), F.first("vec").alias("vec"), F.first("unit").alias("unit"))
    return whole.select(F.col("ids")[0].alias("node"), "key", "ids", "vec", "unit")


def told_apart(points: DataFrame) -> DataFrame:
    """nodes() with names of their own: where an id has several vectors, the vectors' hashes stand for it."""
    several = points.groupBy("node").count().where(F.col("count") > 1).select("node", F.lit(True).alias("several"))
    if several.isEmpty():
        return points
    name = F.when(F.col("several"), F.xxhash64("key")).otherwise(F.col("node"))
    return written(points.join(several, "node", "left").withColumn("node", name).select(*points.columns))


def _top(pairs: DataFrame, k: int) -> DataFrame:
    """Each v's k rows with the largest sim; a partition's surplus goes before the shuffle."""
    return pairs.withColumn("place", F.row_number().over(Window.partitionBy("v").orderBy(F.desc("sim"), "u"))).where(F.col("place") <= k).drop("place")


def _lists(pairs: DataFrame, k: int) -> DataFrame:
    """(v, near): each node's k best distinct neighbours as structs (sim, u, fresh), best first; a link that was there before isn't fresh."""
    once = pairs.repartition(partitions(pairs.sparkSession), "v").groupBy("v", "u").agg(F.max("sim").alias("sim"), F.min("fresh").alias("fresh"))
    return once.groupBy("v").agg(F.slice(F.sort_array(F.collect_list(F.struct("sim", "u", "fresh")), asc=False), 1, k).alias("near"))


def _flat(graph: DataFrame) -> DataFrame:
    return graph.select("v", F.explode("near").alias("e")).select("v", "e.u", "e.sim", "e.fresh")


def _best_offers(v: np.ndarray, u: np.ndarray, sim: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best offers to each v, each u once."""
    order = np.lexsort((-sim, u, v))
    v, u, sim = v[order], u[order], sim[order]
    once = np.concatenate([[True], (v[1:] != v[:-1]) | (u[1:] != u[:-1])]) if len(v) else np.zeros(0, bool)
    v, u, sim = v[once], u[once], sim[once]
    order = np.lexsort((u, -sim, v))
    v, u, sim = v[order], u[order], sim[order]
    head = np.maximum.accumulate(np.where(np.concatenate([[True], v[1:] != v[:-1]]), np.arange(len(v)), 0)) if len(v) else np.zeros(0, np.int64)
    near = np.arange(len(v)) - head < k
    return v[near], u[near], sim[near]


def _first_graph(points: DataFrame, n: int, k: int, seed: int) -> DataFrame:
    sample = _halves(points.orderBy(F.xxhash64("node", F.lit(seed))).limit(SAMPLE).select("unit").toArrow()["unit"].combine_chunks())
    bits = max(1, int(np.ceil(np.log2(max(n / BLOCK, 2)))))
    rng = np.random.default_rng(seed)
    planes = []
    for _ in range(SPLITS):
        a, b = sample[rng.integers(len(sample), size=bits + 1)], sample[rng.integers(len(sample), size=bits + 1)]
        normal = a - b + rng.normal(0, 1e-3, a.shape).astype(np.float32)
        planes.append((normal, (normal * (a + b) / 2).sum(1)))

    def key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            unit = _halves(b.column("unit")) if b.num_rows else np.zeros((0, 1), np.float32)
            for split, (normal, offset) in enumerate(planes if b.num_rows else []):
                side = unit @ normal.T - offset
                cell = (side[:, :-1] > 0) @ (1 << np.arange(bits)[::-1])
                gray = cell.astype(np.int64)
                shift = 1
                while shift < bits:  # cells next to each other differ in one split
                    gray ^= gray >> shift
                    shift *= 2
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(unit), split, np.int32)), pa.array(gray), pa.array(side[:, -1].astype(np.float64)), b.column("node"), b.column("unit")], ["split", "cell", "at", "node", "unit"])

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            split = b.column("split").to_numpy()
            node, unit = b.column("node").to_numpy(), _halves(b.column("unit")) if b.num_rows else None
            for lo in range(0, b.num_rows, BLOCK):
                hi = min(b.num_rows, lo + 2 * BLOCK if b.num_rows - lo < 2 * BLOCK else lo + BLOCK)
                sim = unit[lo:hi] @ unit[lo:hi].T
                sim[split[lo:hi, None] != split[None, lo:hi]] = -2
                np.fill_diagonal(sim, -2)
                top = np.argsort(-sim, axis=1)[:, :k]
                v, u, s = np.repeat(node[lo:hi], top.shape[1]), node[lo:hi][top].ravel(), np.take_along_axis(sim, top, 1).ravel()
                good = s > -2
                yield pa.RecordBatch.from_arrays([pa.array(v[good]), pa.array(u[good]), pa.array(s[good].astype(np.float32))], ["v", "u", "sim"])
                if hi == b.num_rows:
                    break

    keyed = points.select("node", "unit").mapInArrow(key, "split int, cell long, at double, node long, unit binary")
    dealt = keyed.repartitionByRange(partitions(points.sparkSession), "split", "cell", "at", "node").sortWithinPartitions("split", "cell", "at", "node")
    return _lists(dealt.mapInArrow(near, "v long, u long, sim float").withColumn("fresh", F.lit(True)), k)


def graph(points: DataFrame, degree: int = DEGREE, rounds: int = ROUNDS, seed: int = 5) -> DataFrame:
    """(v, near): the neighbour graph of nodes()' rows."""
    n = points.count()
    if not n:
        return points.sparkSession.createDataFrame([], "v long, near array<struct<sim:float,u:long,fresh:boolean>>")
    state = written(_first_graph(points, n, degree, seed))
    units = points.select(F.col("node").alias("u"), "unit")

    lots = max(partitions(points.sparkSession), -(-n // LOT))

    def meet(groups: pa.Table, vectors: pa.Table) -> pa.Table:
        ids = vectors["u"].to_numpy()
        order = np.argsort(ids)
        ids, worst, unit = ids[order], vectors["worst"].to_numpy()[order], _halves(vectors["unit"].combine_chunks())[order]
        everyone, new = groups["all"].combine_chunks(), groups["new"].combine_chunks()
        place = np.searchsorted(ids, everyone.flatten().to_numpy())
        ends, new_ends = everyone.offsets.to_numpy() - everyone.offsets[0].as_py(), new.offsets.to_numpy() - new.offsets[0].as_py()
        group = lambda e: np.repeat(np.arange(len(e) - 1), np.diff(e)) * len(ids)
        fresh = np.isin(group(ends) + place, group(new_ends) + np.searchsorted(ids, new.flatten().to_numpy()))
        held, kept = [], []
        for k, (lo, hi) in enumerate(zip(ends[:-1], ends[1:], strict=True)):
            who, is_new = place[lo:hi], fresh[lo:hi]
            sim = unit[who] @ unit[who].T
            better = (sim > worst[who, None]) & (is_new[:, None] | is_new)
            np.fill_diagonal(better, False)
            i, j = np.nonzero(better)
            held.append((who[i], who[j], sim[i, j]))
            if k % 256 == 255 or hi == ends[-1]:
                kept.append(_best_offers(*(np.concatenate(x) for x in zip(*held, strict=True)), degree))
                held = []
        v, u, s = _best_offers(*(np.concatenate(x) for x in zip(*kept, strict=True)), degree)
        return pa.table({"v": ids[v], "u": ids[u], "sim": pa.array(s, pa.float32())})

    for _ in range(rounds):
        flat = _flat(state)
        back = _top(flat.select(F.col("u").alias("v"), F.col("v").alias("u"), "sim", "fresh"), degree)
        worst = F.when(F.size("near") < degree, F.lit(-2.0).cast("float")).otherwise(F.col("near")[F.size("near") - 1]["sim"])
        known = units.join(state.select(F.col("v").alias("u"), worst.alias("worst")), "u")
        both = flat.select("v", "u", "fresh").union(back.select("v", "u", "fresh")).groupBy("v").agg(F.collect_set("u").alias("all"), F.collect_set(F.when(F.col("fresh"), F.col("u"))).alias("new"))
        # links that have met before aren't compared again, and a group without a new link is done
        groups = both.where(F.size("new") > 0).select(F.pmod(F.xxhash64("v"), F.lit(lots)).alias("lot"), "all", "new")
        # a vector is sent once to each lot of groups
        vectors = groups.select("lot", F.explode("all").alias("u")).distinct().join(known, "u").select(F.col("lot").alias("at"), "u", "worst", "unit")
        offers = groups.groupBy("lot").cogroup(vectors.groupBy("at")).applyInArrow(meet, "v long, u long, sim float")
        # the node itself meets its reverse neighbours
        offers = offers.union(back.where("fresh").select("v", "u", "sim")).withColumn("fresh", F.lit(True))
        state = written(_lists(flat.withColumn("fresh", F.lit(False)).unionByName(offers), degree))
        fresh = state.agg(F.sum(F.size(F.filter("near", lambda e: e["fresh"]))).alias("n")).first().n
        if (fresh or 0) <= SETTLED * n * degree:
            break
    return state


def _cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosine of a and each row of b, in double precision."""
    a, b = a / np.abs(a).max(), b / np.abs(b).max(1, keepdims=True)
    return np.einsum("ij,j->i", b, a) / np.sqrt(np.einsum("ij,ij->i", b, b) * np.einsum("j,j->", a, a))


def search(points: DataFrame, links: DataFrame, starts: DataFrame, beam: int = BEAM, width: int = WIDTH) -> DataFrame:
    """(q, best, seen): for each node in starts' column q its best nodes found, as structs (score, u), itself included, and the nodes it has met.

    A search is one row: the query's vector, the ``beam`` best nodes and which of them are open, and the sorted ids met.  A hop
    takes the neighbours of the ``width`` best open nodes, leaves out those met, and scores the rest; searches
    without an open node are put aside."""
    kind = points.schema["vec"].dataType.elementType.simpleString()
    flat = _flat(links).select("v", "u", "sim")
    both = flat.union(_top(flat.select(F.col("u").alias("v"), F.col("v").alias("u"), "sim"), DEGREE))
    around = written(both.groupBy("v").agg(F.collect_set("u").alias("near")))
    vec = points.select(F.col("node").alias("u"), F.col("vec").alias("b"))
    row = f"q long, a array<{kind}>, best array<struct<score:double,u:long,open:boolean>>, seen array<long>"

    def start(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                one = b.slice(i, 1)
                a, q = _matrix(one.column("a"), np.float64), one.column("q").to_numpy()
                yield _search_rows(one.column("q"), one.column("a"), [(_cosines(a[0], a), q, np.ones(1, bool))], [q])

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            a = _matrix(b.column("a"), np.float64)
            found, seen = [], []
            for i in range(b.num_rows):
                was, news = b.column("best").slice(i, 1).flatten(), b.column("news").slice(i, 1).flatten()
                score, u, open_ = was.field("score").to_numpy(), was.field("u").to_numpy(), was.field("open").to_numpy(zero_copy_only=False).copy()
                open_[np.flatnonzero(open_)[:width]] = False
                met = b.column("seen").slice(i, 1).flatten().to_numpy()
                if len(news):
                    fresh = news.field("u").to_numpy()
                    score = np.concatenate([score, _cosines(a[i], _matrix(news.field("b"), np.float64))])
                    u, open_ = np.concatenate([u, fresh]), np.concatenate([open_, np.ones(len(fresh), bool)])
                    met = np.sort(np.concatenate([met, fresh]))
                order = np.lexsort((u, -score))[:beam]
                found.append((score[order], u[order], open_[order]))
                seen.append(met)
            yield _search_rows(b.column("q"), b.column("a"), found, seen)

    state = written(starts.join(points.select(F.col("node").alias("q"), F.col("vec").alias("a")), "q").select("q", "a").mapInArrow(start, row))
    ended = []
    while not state.isEmpty():
        now = F.slice(F.filter("best", lambda e: e["open"]), 1, width)
        front = state.select("q", F.explode(now).alias("e")).select("q", F.col("e.u").alias("v"))
        step = front.join(around, "v").select("q", F.explode("near").alias("u")).groupBy("q").agg(F.collect_set("u").alias("us"))
        step = step.join(state.select("q", "seen"), "q").select("q", F.explode(F.array_except("us", "seen")).alias("u"))
        news = step.join(vec, "u").groupBy("q").agg(F.collect_list(F.struct("u", "b")).alias("news"))
        after = written(state.join(news, "q", "left").select("q", "a", "best", "seen", "news").mapInArrow(take, row))
        is_open = F.exists("best", lambda e: e["open"])
        ended.append(after.where(~is_open).select("q", "best", "seen"))
        state = after.where(is_open)
    ended.append(state.select("q", "best", "seen"))
    whole = ended[0]
    for x in ended[1:]:
        whole = whole.union(x)
    return whole


def _search_rows(q: pa.Array, a: pa.Array, found: list[tuple[np.ndarray, np.ndarray, np.ndarray]], seen: list[np.ndarray]) -> pa.RecordBatch:
    ends = pa.array(np.concatenate([[0], np.cumsum([len(f[0]) for f in found])]).astype(np.int32))
    best = pa.StructArray.from_arrays([pa.array(np.concatenate([f[k] for f in found])) for k in range(3)], ["score", "u", "open"])
    met = pa.array(np.concatenate([[0], np.cumsum([len(x) for x in seen])]).astype(np.int32))
    return pa.RecordBatch.from_arrays([q, a, pa.ListArray.from_arrays(ends, best), pa.ListArray.from_arrays(met, pa.array(np.concatenate(seen)))], ["q", "a", "best", "seen"])


def nearest(vectors: DataFrame, queries: F.Column, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of every row where queries is true, the row itself left out."""
    points = told_apart(written(nodes(vectors, id_col, vec_col, k + 1)))
    asked = written(nodes_of(vectors.where(queries), points, id_col, vec_col))
    found = search(points, graph(points), asked.select(F.col("node").alias("q")).distinct())
    # k + 1 nodes show k rows besides the query's own
    shown = found.select("q", F.explode(F.slice("best", 1, k + 1)).alias("e")).select("q", "e.score", "e.u").join(points.select(F.col("node").alias("u"), "ids"), "u")
    order = F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("s"), F.col("vec_id"))))
    near = shown.select("q", "score", F.explode("ids").alias("vec_id")).groupBy("q").agg(F.slice(order, 1, k + 1).alias("near"))
    rows = asked.join(near.withColumnRenamed("q", "node"), "node")
    rows = rows.select("query_id", F.posexplode(F.slice(F.filter("near", lambda e: e["vec_id"] != F.col("query_id")), 1, k)).alias("at", "e"))
    return rows.select("query_id", (F.col("at") + 1).alias("rank"), F.col("e.vec_id").alias("vec_id"), (-F.col("e.s")).alias("score"))


def nodes_of(vectors: DataFrame, points: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(query_id, node): the node of each row's vector, each id and node once; rows that take no part have none."""
    src = vectors.select(F.col(id_col).cast("long").alias("query_id"), F.col(vec_col).cast("array<double>").alias("vec"))
    src = src.where(F.col("query_id").isNotNull() & F.col("vec").isNotNull() & ~F.exists("vec", F.isnull))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column("vec")
            flat, ends = lists.flatten().to_numpy(zero_copy_only=False) + 0.0, lists.offsets.to_numpy()
            ends = ends - ends[0] if len(ends) else ends
            keys = [hashlib.md5(flat[lo:hi].tobytes()).digest() for lo, hi in zip(ends[:-1], ends[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("query_id"), pa.array(keys, pa.binary())], ["query_id", "key"])

    return src.mapInArrow(run, "query_id long, key binary").join(points.select("key", "node"), "key").select("query_id", "node").distinct()


def op1_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 nearest found of every vector whose id is divisible by 50."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return nearest(vectors, F.col("vec_id") % 50 == 0)
