"""SimHash near-duplicates by tiled exact comparison.

A fingerprint has 64 bits; a bit is 1 if it is set in over half of the XXH64
hashes (seed 42) of the text's word shingles, repeats included.  Two documents
are linked if their fingerprints differ in at most ``radius`` bits; a document's
component is the smallest doc_id that links reach.

Equal fingerprints are one node.  Nodes are dealt into tiles by the population
counts of the fingerprint's ``PARTS`` equal parts: fingerprints within the radius
have counts that differ, summed over the parts, by no more than the radius, so
only tiles that near each other are compared, every pair of tiles in one place.
A tile with more than ``TILE`` nodes is cut into blocks; these meet one other block
at a time, so no task holds more than one block and the few tiles without blocks
that are next to it.  Fingerprints travel packed, by tile.  Within a task
numpy's exclusive-or and bit counts find all links; what leaves it is a spanning
forest of them, at most one row a node.  Components are found by passing on the
smallest label with shortcuts, each round written to the shared folder.

Null text has no words: fingerprint zero, linked like any other.  A null doc_id
never is a component's name unless all its members' are null.  Repeated rows get
one row each.  An empty table gives an empty result.

near_dedup() is for a wider notion: five-word shingles with a Jaccard similarity
of at least 0.8, which no radius of fingerprints takes in whole.  Nodes are dealt into
tiles by their number of shingles (similar sets have similar sizes, so tiles of other
size classes are never met), and tiles within reach compare parity maps of the shingle
sets, which never differ in more bits than the sets do in shingles.  The pairs that the
maps can't rule out say which nodes belong together; within these components all pairs
are judged by whole shingle sets, so links are exact but for equal 64-bit hashes of
shingles.  Comparisons grow with the square of a size class.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, product

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lineagram.llm.common import buffers, pieces, utf8, written

PARTS = 4
TILE = 131_072
#: Fingerprints that are packed together before they are shuffled.
HELD = 1 << 16
SEED = 42
#: Of near_dedup: words of a shingle, similarity, nodes of a tile, ratio of size classes.
WIDTH, SIMILAR, SIDE, RATIO = 5, 0.8, 8_192, 1.25
#: Shingles that are judged at once.
LOT = 1 << 20
_RAW = "__utf8"


def fingerprint_of(raw: bytes, width: int = 3) -> tuple[int, ...]:
    """The hashes of a text's shingles; bytes.lower() changes A-Z alone."""
    words = raw.lower().split()
    if not words:
        return ()
    joined = b" ".join(words)
    if len(words) < width:
        return (xxhash.xxh64_intdigest(joined, SEED),)
    ends = list(accumulate((len(w) + 1 for w in words), initial=0))
    digest = xxhash.xxh64_intdigest
    return tuple([digest(joined[a : b - 1], SEED) for a, b in zip(ends, ends[width:], strict=False)])


def majority(hashes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Fingerprints of consecutive groups of hashes; a group may be empty."""
    out = np.zeros(len(sizes), np.uint64)
    full = np.flatnonzero(sizes)
    if not len(full):
        return out
    bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    counts = np.add.reduceat(bits, (np.cumsum(sizes) - sizes)[full], axis=0, dtype=np.int64)
    ones = np.packbits(2 * counts > sizes[full, None], axis=1, bitorder="little")
    out[full] = np.ascontiguousarray(ones).view("<u8").ravel()
    return out


def fingerprints(docs: DataFrame, text_col: str = "text", out_col: str = "fingerprint_bits", width: int = 3) -> DataFrame:
    """Adds the fingerprint as a long (the 64 bits as a signed integer)."""
    keep = docs.drop(out_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = b.schema.get_field_index(_RAW)
            column = b.column(at)
            _, offsets = buffers(column)
            parts = []
            for lo, hi in pieces(offsets, 1 << 18):
                hashes, sizes = [], np.zeros(hi - lo, np.int64)
                for i in range(lo, hi):
                    got = fingerprint_of(column[i].as_py(), width)
                    sizes[i - lo] = len(got)
                    hashes.extend(got)
                parts.append(majority(np.array(hashes, np.uint64), sizes))
            bits = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
            cols = [b.column(i) for i in range(b.num_columns) if i != at]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(bits.view(np.int64))], [*[c for c in b.schema.names if c != _RAW], out_col])

    return keep.withColumn(_RAW, utf8(text_col)).mapInArrow(run, T.StructType([*[f for f in keep.schema.fields], T.StructField(out_col, T.LongType())]))


def _roots(n: int, links: Iterator[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Smallest index that each of n nodes reaches."""
    label = np.arange(n)
    for i, j in links:
        while True:
            a, b = label[i], label[j]
            open_ = a != b
            if not open_.any():
                break
            i, j, a, b = i[open_], j[open_], a[open_], b[open_]
            np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
            while (label[label] != label).any():
                label = label[label]
    return label


def _near(home: np.ndarray, guest: np.ndarray, radius: int, side: int = 2048, own: bool = True) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (home, guest), and with own (home, home), within the radius; guests count on after the homes."""
    everyone = np.concatenate([home, guest])
    for lo in range(0, len(home), side):
        mine = home[lo : lo + side, None]
        for at in range(lo if own else len(home), len(everyone), side):
            i, j = np.nonzero(np.bitwise_count(mine ^ everyone[None, at : at + side]) <= radius)
            ahead = i + lo < j + at
            if ahead.any():
                yield i[ahead] + lo, j[ahead] + at


def _blocks_of(cells: np.ndarray, many: np.ndarray, blocks: np.ndarray) -> np.ndarray:
    """Blocks of each cell; cells that aren't among many have one."""
    if not len(many):
        return np.ones(len(cells), np.int64)
    at = np.minimum(np.searchsorted(many, cells), len(many) - 1)
    return np.where(many[at] == cells, blocks[at], 1)


def _times(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index, number): each index as often as its count says, and which time it is."""
    index = np.repeat(np.arange(len(counts)), counts)
    return index, np.arange(len(index)) - np.repeat(np.cumsum(counts) - counts, counts)


def _meetings(fp: np.ndarray, radius: int, many: np.ndarray, blocks: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    """(index, cell, block, of, at, home): where fingerprints meet others.

    A cell's block is at home in (cell, block, -1, 0), where it meets itself and visitors from cells of one block, and in
    (cell, block, of, at) for each block ``at`` of a cell ``of`` that has several."""
    bits = 64 // PARTS
    side = bits + 1
    weight = np.array([side ** (PARTS - 1 - i) for i in range(PARTS)])
    p = np.stack([np.bitwise_count(fp >> np.uint64(bits * i) & np.uint64((1 << bits) - 1)) for i in range(PARTS)], axis=1).astype(np.int64)
    cell = p @ weight
    n = _blocks_of(cell, many, blocks)
    block = (fp * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64) % n
    alone = n == 1

    def row(index, to, i, of, at, home):
        return index, to, i, np.broadcast_to(of, index.shape), np.broadcast_to(at, index.shape), np.broadcast_to(home, index.shape)

    everyone = np.arange(len(fp))
    yield row(everyone, cell, block, -1, 0, True)
    k, j = _times(np.where(alone, 0, n))
    yield from (row(k[s], cell[k[s]], i[s], cell[k[s]], at[s], home) for s, i, at, home in ((j > block[k], block[k], j, True), (j < block[k], j, block[k], False)))
    for d in product(range(-radius, radius + 1), repeat=PARTS):
        if sum(map(abs, d)) > radius or d <= (0,) * PARTS:
            continue
        step = int(np.array(d) @ weight)
        idx = np.flatnonzero(((p + d >= 0) & (p + d < side)).all(1))
        to = cell[idx] + step
        k, i = _times(_blocks_of(to, many, blocks))
        idx, to = idx[k], to[k]
        yield row(idx, to, i, np.where(alone[idx], -1, cell[idx]), np.where(alone[idx], 0, block[idx]), False)
        if len(many):  # and is at home to the blocks of cells that visit its own
            idx = np.flatnonzero(((p - d >= 0) & (p - d < side)).all(1))
            k, at = _times((n_of := _blocks_of(cell[idx] - step, many, blocks)) * (n_of > 1))
            idx = idx[k]
            yield row(idx, cell[idx], block[idx], cell[idx] - step, at, True)


def links(nodes: DataFrame, radius: int) -> DataFrame:
    """(a, b): a spanning forest of the links among the distinct fingerprints in column ``fp``."""
    bits = 64 // PARTS
    counts = [F.bit_count(F.shiftrightunsigned("fp", bits * i).bitwiseAND(F.lit((1 << bits) - 1))).cast("int") for i in range(PARTS)]
    cell = sum((c * (bits + 1) ** (PARTS - 1 - i) for i, c in enumerate(counts)), F.lit(0))
    # at most (bits + 1) ** PARTS rows, whatever the input
    large = sorted((r[0], -(-r[1] // TILE)) for r in nodes.groupBy(cell.alias("cell")).count().where(F.col("count") > TILE).collect())
    many, blocks = np.array([c for c, _ in large], np.int64), np.array([b for _, b in large], np.int64)
    names = ["cell", "block", "of", "at", "home", "fps"]

    def packed(fp: np.ndarray) -> Iterator[pa.RecordBatch]:
        index, cell, block, of, at, home = (np.concatenate(x) for x in zip(*_meetings(fp, radius, many, blocks), strict=True))
        place, guest = cell << 40 | block << 1 | home, (of + 1) << 32 | at
        order = np.lexsort((place, guest)) if guest.any() else np.argsort(place, kind="stable")
        place, guest = place[order], guest[order]
        first = np.flatnonzero(np.concatenate([[True], (place[1:] != place[:-1]) | (guest[1:] != guest[:-1])]))
        body, ends = fp[index[order]].tobytes(), np.append(first, len(order)) * 8
        heads = order[first]
        yield pa.RecordBatch.from_arrays([*[pa.array(x[heads].astype(np.int32)) for x in (cell, block, of, at)], pa.array(home[heads]), pa.array([body[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)], pa.binary())], names)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for b in batches:
            held.append(b.column(0).to_numpy().view(np.uint64))
            n += b.num_rows
            if n >= HELD:
                yield from packed(np.concatenate(held))
                held, n = [], 0
        if n:
            yield from packed(np.concatenate(held))

    def compare(table: pa.Table) -> pa.Table:
        is_home = table["home"].to_numpy(zero_copy_only=False)
        bodies = table["fps"].to_pylist()
        home, guest = (np.sort(np.frombuffer(b"".join([b for b, h in zip(bodies, is_home, strict=True) if h == side]), np.uint64)) for side in (True, False))
        everyone = np.concatenate([home, guest])
        root = np.arange(len(everyone))
        if len(home):
            root = _roots(len(everyone), _near(home, guest, radius, own=table["of"][0].as_py() < 0))
        found = root != np.arange(len(root))
        return pa.table({"a": everyone[found].view(np.int64), "b": everyone[root[found]].view(np.int64)})

    dealt = nodes.select("fp").mapInArrow(deal, "cell int, block int, of int, at int, home boolean, fps binary")
    return dealt.groupBy("cell", "block", "of", "at").applyInArrow(compare, "a long, b long")


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, label): the smallest node reachable, for every node that has an edge.

    Each round takes the smallest label around a node and then its label's label;
    labels only fall, and the rounds end when none does.  Every round is written
    to the shared folder, so a lost executor costs no earlier round."""
    both = written(edges.select(F.col(a).alias("node"), F.col(b).alias("other")).union(edges.select(F.col(b), F.col(a))).distinct())
    state = written(both.groupBy("node").agg(F.min("other").alias("near")).select("node", F.least("node", "near").alias("label")))
    while True:
        around = both.join(state.select(F.col("node").alias("other"), "label"), "other").groupBy("node").agg(F.min("label").alias("near"))
        lower = state.join(around, "node").select("node", F.col("label").alias("was"), F.least("label", "near").alias("label"))
        jump = state.select(F.col("node").alias("label"), F.col("label").alias("beyond"))
        state_next = written(lower.join(jump, "label", "left").select("node", "was", F.least("label", F.coalesce("beyond", "label")).alias("label")))
        if state_next.where("label < was").isEmpty():
            return state_next.select("node", "label")
        state = state_next.select("node", "label")


def classes(docs: DataFrame, width: int = 3, radius: int = 2) -> DataFrame:
    """(doc_id, fp, component_id) for every row."""
    marked = written(fingerprints(docs.select("doc_id", "text"), out_col="fp", width=width).drop("text"))
    nodes = written(marked.groupBy("fp").agg(F.min("doc_id").alias("first")))
    found = components(links(nodes, radius))
    named = nodes.join(found.withColumnRenamed("node", "fp"), "fp", "left").withColumn("label", F.coalesce("label", "fp"))
    names = named.groupBy("label").agg(F.min("first").alias("component_id"))
    by_fp = named.join(names, "label").select("fp", "component_id")
    return marked.join(by_fp, "fp")


def parity_map(hashes: np.ndarray) -> bytes:
    """Which of the low values of some hashes are met an odd number of times; as many bits as hashes, in powers of two, 128 at least.

    Maps of two sets differ in at most as many bits as the sets have terms that aren't common, and so do their folded halves."""
    width = max(128, 1 << max(len(hashes) - 1, 0).bit_length())
    odd = np.bincount((hashes & np.uint64(width - 1)).astype(np.int64), minlength=width) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def _mapped(docs: DataFrame) -> DataFrame:
    """(id, raw, digest, size, map): of every row its id and text's digest, the digest of its words, and the shingle set's size and parity map."""
    src = _named(docs).select(F.col("__id").alias("id"), F.col("__raw").alias("raw"), utf8("text").alias(_RAW))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            digests, sizes, maps = [], [], []
            for raw in b.column(2):
                words = b" ".join(raw.as_py().lower().split())
                five = np.unique(np.array(fingerprint_of(words, WIDTH), np.uint64))
                digests.append(xxhash.xxh3_128_digest(words))
                sizes.append(len(five))
                maps.append(parity_map(five))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(digests, pa.binary()), pa.array(sizes, pa.int32()), pa.array(maps, pa.binary())], ["id", "raw", "digest", "size", "map"])

    return src.mapInArrow(run, "id long, raw binary, digest binary, size int, map binary")


def _folded(table: np.ndarray, words: int) -> np.ndarray:
    while table.shape[1] > words:
        half = table.shape[1] // 2
        table = table[:, :half] ^ table[:, half:]
    return table


def _apart(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Bits in which each row of x differs from each of y."""
    out = np.zeros((len(x), len(y)), np.int32)
    for k in range(x.shape[1]):
        out += np.bitwise_count(x[:, k, None] ^ y[None, :, k])
    return out


def _maybe(left: np.ndarray, right: np.ndarray, size: np.ndarray, maps: list[bytes], side: int = 1024) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs, of left and right, whose maps don't rule out a similarity of SIMILAR (0.8: no more than a ninth of both sizes isn't common)."""
    width = np.array([len(m) for m in maps]) // 8
    same = left is right

    def tables(idx: np.ndarray) -> list[tuple[int, np.ndarray, np.ndarray]]:
        return [(int(w), mine := idx[width[idx] == w], np.frombuffer(b"".join([maps[i] for i in mine]), "<u8").reshape(-1, w)) for w in np.unique(width[idx])]

    lefts = tables(left)
    for wl, i, x in lefts:
        for wr, j, y in lefts if same else tables(right):
            if same and wr < wl:
                continue
            words = min(wl, wr)
            xf, yf = _folded(x, words), _folded(y, words)
            few = max(2, words // 2)
            xh, yh = _folded(xf, few), _folded(yf, few)
            for lo in range(0, len(i), side):
                for at in range(lo if same and wl == wr else 0, len(j), side):
                    both = size[i[lo : lo + side], None] + size[None, j[at : at + side]]
                    a, b = np.nonzero(9 * _apart(xh[lo : lo + side], yh[at : at + side]) <= both)
                    if few < words:
                        parts = [np.zeros(0, bool)]
                        for k in range(0, len(a), 1 << 14):
                            p, q = a[k : k + (1 << 14)], b[k : k + (1 << 14)]
                            parts.append(9 * np.bitwise_count(xf[lo + p] ^ yf[at + q]).sum(1, dtype=np.int64) <= both[p, q])
                        good = np.concatenate(parts)
                        a, b = a[good], b[good]
                    if len(a):
                        yield i[lo + a], j[at + b]


def near_links(nodes: DataFrame) -> DataFrame:
    """(a, b): a spanning forest, tile by tile, of the pairs among nodes (node, size, map) that may be as similar as SIMILAR; no such pair is missed."""
    klass = F.when(F.col("size") < 1, F.lit(-9)).otherwise(F.floor(F.log(RATIO, F.col("size")) + F.lit(1e-9))).cast("int")
    sized = nodes.withColumn("klass", klass)
    # a row for each size class there is: under a hundred
    count = {r[0]: -(-r[1] // SIDE) for r in sized.groupBy("klass").count().collect()}
    if not count:
        return nodes.sparkSession.createDataFrame([], "a binary, b binary")
    blocks = F.create_map(*[F.lit(v) for k in count.items() for v in k])
    n = lambda k: F.coalesce(F.try_element_at(blocks, k), F.lit(0))
    sized = sized.withColumn("block", F.pmod(F.xxhash64("node"), n(F.col("klass"))).cast("int"))
    pair = lambda c, i, d, j, left: F.struct(c.alias("c"), i.alias("i"), d.alias("d"), j.alias("j"), F.lit(left).alias("left"))
    numbers = lambda upto: F.when(upto > 0, F.sequence(F.lit(0), (upto - 1).cast("int"))).otherwise(F.expr("cast(array() as array<int>)"))
    c, b = F.col("klass"), F.col("block")
    meets = F.concat(
        F.transform(F.filter(numbers(n(c)), lambda j: j >= b), lambda j: pair(c, b, c, j, True)),
        F.transform(F.filter(numbers(n(c)), lambda j: j < b), lambda j: pair(c, j, c, b, False)),
        F.transform(numbers(n(c + 1)), lambda j: pair(c, b, c + 1, j, True)),
        F.transform(numbers(n(c - 1)), lambda j: pair(c - 1, j, c, b, False)),
    )

    def compare(table: pa.Table) -> pa.Table:
        order = pc.sort_indices(table["node"])
        node, size, maps = table["node"].take(order), table["size"].take(order).to_numpy().astype(np.int32), table["map"].take(order).to_pylist()
        is_left = table["left"].take(order).to_numpy(zero_copy_only=False)
        left, right = np.flatnonzero(is_left), np.flatnonzero(~is_left)
        root = _roots(len(node), _maybe(left, right if len(right) else left, size, maps))
        found = root != np.arange(len(root))
        return pa.table({"a": node.filter(pa.array(found)), "b": node.take(pa.array(root[found]))})

    met = sized.select("node", "size", "map", F.explode(meets).alias("m")).select("node", "size", "map", "m.*")
    return met.groupBy("c", "i", "d", "j").applyInArrow(compare, "a binary, b binary")


def _named(docs: DataFrame) -> DataFrame:
    """Adds ``__id`` (a null doc_id as the largest) and ``__raw`` (a digest of the text as it is), which tell rows apart."""
    return docs.withColumn("__id", F.coalesce(F.col("doc_id").cast("long"), F.lit((1 << 63) - 1))).withColumn("__raw", F.unhex(F.md5(utf8("text"))))


def _forest(sets: list[np.ndarray]) -> tuple[list[int], list[int]]:
    """(reached, from): a spanning forest of the pairs of sets that are as similar as SIMILAR (0.8: nine times the common ones are four times both sizes).

    Breadth-first: each set is compared once, whole, with those that no other has reached yet."""
    sizes = np.array([len(x) for x in sets])
    terms, at = np.unique(np.concatenate(sets), return_inverse=True)
    own = np.split(at, np.cumsum(sizes)[:-1])
    mark, left, rest = np.zeros(len(terms), bool), np.arange(len(sets)), at
    reached, source, queue = [], [], []
    while len(left):
        now = queue.pop() if queue else -1
        gone = np.zeros(len(left), bool)
        if now < 0:
            gone[0] = True
            queue.append(int(left[0]))
        else:
            mark[own[now]] = True
            ends = np.cumsum(sizes[left])
            common = np.diff(np.concatenate([[0], np.cumsum(mark[rest])])[np.concatenate([[0], ends])])
            mark[own[now]] = False
            gone = 9 * common >= 4 * (sizes[left] + sizes[now])
            found = left[gone].tolist()
            reached += found
            source += [now] * len(found)
            queue += found
        if gone.any():
            rest, left = rest[np.repeat(~gone, sizes[left])], left[~gone]
    return reached, source


def judged(docs: DataFrame, members: DataFrame) -> DataFrame:
    """(a, b): links among members (node, label, size, top), found by whole shingle sets within each label.

    Labels of up to LOT shingles are dealt into lots; larger ones are cut into blocks that meet two by two."""
    weight = F.sum(F.col("size") + 1)
    large = members.groupBy("label").agg(F.ceil(weight / F.lit(LOT)).cast("int").alias("blocks")).where("blocks > 1")
    lots = max(1, -(-(members.agg(weight.alias("n")).first().n or 0) // LOT))
    dealt = members.select("node", "label", "top").join(large, "label", "left")
    block = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    meets = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda k: F.struct(F.col("label").alias("of"), F.least(k, block).alias("i"), F.greatest(k, block).alias("j")))
    lot = F.array(F.struct(F.lit(None).cast("binary").alias("of"), F.pmod(F.xxhash64("label"), F.lit(lots)).cast("int").alias("i"), F.lit(-1).alias("j")))
    dealt = dealt.select("node", "label", F.col("top.id").alias("__id"), F.col("top.raw").alias("__raw"), F.when(F.col("blocks").isNull(), lot).otherwise(meets).alias("meets"))
    texts = _named(docs.select("doc_id", "text")).join(dealt, ["__id", "__raw"]).select("node", "label", "meets", utf8("text").alias(_RAW)).dropDuplicates(["node"])

    def judge(table: pa.Table) -> pa.Table:
        order = pc.sort_indices(table["label"])
        node, label = table["node"].take(order), table["label"].take(order).to_pylist()
        raws = table[_RAW].take(order)
        cuts = [0, *[i for i in range(1, len(label)) if label[i] != label[i - 1]], len(label)]
        a, b = [], []
        for lo, hi in zip(cuts, cuts[1:], strict=False):
            reached, source = _forest([np.unique(np.array(fingerprint_of(r.as_py(), WIDTH), np.uint64)) for r in raws.slice(lo, hi - lo)])
            a += [lo + i for i in reached]
            b += [lo + i for i in source]
        return pa.table({"a": node.take(pa.array(a, pa.int64())), "b": node.take(pa.array(b, pa.int64()))})

    return texts.select("node", "label", _RAW, F.explode("meets").alias("m")).select("node", "label", _RAW, "m.*").groupBy("of", "i", "j").applyInArrow(judge, "a binary, b binary")


def near_dedup(docs: DataFrame) -> DataFrame:
    """The documents without those that link, over others if need be, to one with a smaller doc_id; all columns stay.

    Texts with the same words are one node, whatever their ids; a null doc_id counts as the largest, and equal
    ids are ordered by the words' digest.  A component keeps one row: of its first node, the smallest doc_id."""
    marked = written(_mapped(docs))
    # a node's name is its smallest id, in the order of unsigned bytes, and its words' digest
    nodes = marked.groupBy("digest").agg(F.min(F.struct("id", "raw")).alias("top"), F.first("size").alias("size"), F.first("map").alias("map"))
    nodes = written(nodes.select(F.concat(F.unhex(F.lpad(F.hex(F.col("top.id").bitwiseXOR(F.lit(-(1 << 63)))), 16, "0")), "digest").alias("node"), "top", "size", "map"))
    maybe = components(near_links(nodes.select("node", "size", "map")))
    found = components(judged(docs, written(nodes.select("node", "top", "size").join(maybe, "node"))))
    later = found.where("label < node").select("node")
    keep = nodes.join(later, "node", "left_anti").select(F.col("top.id").alias("__id"), F.col("top.raw").alias("__raw"))
    return _named(docs).join(keep, ["__id", "__raw"], "left_semi").dropDuplicates(["__id", "__raw"]).select(*docs.columns)


def dedup(docs: DataFrame, width: int = 3, radius: int = 2) -> DataFrame:
    """The documents without those that share a component with a smaller doc_id; all columns stay, repeated rows of one doc_id count once."""
    first = classes(docs, width, radius).where("doc_id <=> component_id").select("doc_id").distinct()
    kept = docs.join(first, docs["doc_id"].eqNullSafe(first["doc_id"]), "left_semi")
    return kept.dropDuplicates(["doc_id"])


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return classes(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
