"""Substring dedup on bytes by suffix arrays.

Documents are dealt into chunks by a hash.  Every ``window`` bytes have an anchor,
the smallest hash among the ``GRAM``-byte pieces in them; equal bytes have equal
anchors.  Chunks ask each other which anchors are in other chunks or documents too
(see exchange.py); windows whose anchor is in one document alone can't occur in
another and are left out.  Of what is left, each run of windows with one anchor is
a stretch of text; a chunk sends its distinct stretches, each once with its smallest
doc_id, to the part of the anchors' space that gathers them from all chunks.

A part takes a slice of its anchors at a time, so equal windows always meet in one
slice.  The stretches of a slice are dealt into shards of about ``SHARD`` bytes, and
each shard gets a suffix array by Larsson-Sadakane refinement: suffixes are ordered
by their first 8 bytes, then groups that are still equal are split by the ranks 8,
16 and 18 bytes on, until ``window`` bytes are ordered.  Common prefixes of
neighbours are taken in text order as Kasai's: where a suffix and its neighbour are
the next ones of a pair known to agree, only the new byte is compared.  Neighbours
that agree on the window form a class, whose smallest doc_id is known.  Shards are
merged two by two by binary search of one's classes among the other's.  Every
comparison is of the windows' bytes; hashes only say what need not be compared.

A byte is removed if it is in a window that a document with a smaller doc_id holds,
too; windows are judged on the input.  A stretch that a third of all documents hold
is one entry for each chunk, however many documents of the chunk hold it.

Null text counts as empty; a null doc_id, or one that is no whole number, counts as
the largest; rows of one doc_id are one document to each other (none is smaller).
Ties can't be: order is that of doc_ids alone.  An empty table gives an empty
result.  Extra columns pass through; a column of the name of an added one is
replaced.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lineagram.llm import exchange as x
from lineagram.llm.anchors import _planes, _values
from lineagram.llm.common import _BYTE, buffers, mix, pieces, rolling

WINDOW, GRAM = 50, 24
_SHIFT = np.uint64(18)
_SIX = slice(2, 8)
_PIECE = 1 << 20
#: Bytes of stretches under one suffix array, and those of one slice of anchors; a longer stretch, or an anchor with more text, stands alone.
SHARD, SLICE = 1 << 19, 1 << 21
#: A null doc_id.
_LAST = (1 << 63) - 1


def _smallest(g: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` consecutive entries."""
    k, out = 1, g
    while 2 * k <= width:
        out = np.minimum(out[: len(out) - k], out[k:])
        k *= 2
    return np.minimum(out[: len(g) - width + 1], out[width - k :]) if k < width else out


class _Chunk:
    """Runs of windows with one anchor, over a chunk's documents one after another."""

    def __init__(self, table: pa.Table, window: int):
        self.data, self.offsets = buffers(table[x.RAW])
        self.ids = table["__id"].fill_null(_LAST).to_numpy(zero_copy_only=False)
        self.window = window
        heads, sizes, anchors = [np.zeros(0, np.int64)], [np.zeros(0, np.int32)], [np.zeros(0, np.uint64)]
        for lo, hi in pieces(self.offsets, _PIECE):
            base = self.offsets[lo]
            data, cuts = self.data[base : self.offsets[hi]], self.offsets[lo : hi + 1] - base
            for at in range(0, max(len(data) - window + 1, 0), _PIECE):  # a long text takes several
                n = min(_PIECE, len(data) - window + 1 - at)
                # minima are small numbers; mixed, they spread evenly over the parts
                m = mix(_smallest(rolling(_BYTE[data[at : at + n + window - 1]], GRAM), window - GRAM + 1)) >> _SHIFT
                edge = np.zeros(n + 1, np.int32)  # valid starts
                fits = np.diff(cuts) >= window
                np.add.at(edge, np.clip(cuts[:-1][fits] - at, 0, n), 1)
                np.subtract.at(edge, np.clip(cuts[1:][fits] - window + 1 - at, 0, n), 1)
                valid = np.cumsum(edge[:-1]) > 0
                change = np.concatenate([[True], m[1:] != m[:-1]])
                begins = valid & (change | np.concatenate([[True], ~valid[:-1]]))
                ends = valid & np.concatenate([change[1:] | ~valid[1:], [True]])
                # where two texts meet, the windows across both aren't valid, so runs never cross
                head = np.flatnonzero(begins)
                heads.append(head + base + at)
                sizes.append((np.flatnonzero(ends) + 1 - head).astype(np.int32))
                anchors.append(m[head])
        self.heads, self.sizes, anchor = np.concatenate(heads), np.concatenate(sizes), np.concatenate(anchors)
        self.doc = (np.searchsorted(self.offsets, self.heads, "right") - 1).astype(np.int32)
        self.anchors, place = np.unique(anchor, return_inverse=True)
        self.place = place.astype(np.int32)
        owner = self.ids[self.doc]
        low, high = np.full(len(self.anchors), _LAST), np.full(len(self.anchors), -_LAST - 1)
        np.minimum.at(low, self.place, owner)
        np.maximum.at(high, self.place, owner)
        self.local = low < high

    def edges(self, parts: int) -> np.ndarray:
        return x.cuts(self.anchors << _SHIFT, parts)

    def stretches(self, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(runs of the wanted anchors, a representative run of each distinct stretch by anchor, each run's stretch).

        Equal stretches are found by hashes of their first and last window and compared byte by byte."""
        run = np.flatnonzero(wanted[self.place])
        if not len(run):
            return run, run, run
        heads, sizes = self.heads[run], self.sizes[run].astype(np.int64)
        key = mix(self._hash_at(heads) * np.uint64(0x9E3779B97F4A7C15) + self._hash_at(heads + sizes - 1) + sizes.astype(np.uint64))
        words, length = _words(self.data), sizes + self.window - 1
        while True:
            _, first, which = np.unique(key, return_index=True, return_inverse=True)
            other = heads[first[which]]
            unlike = length != length[first[which]]
            left = np.flatnonzero(~unlike & (other != heads))
            off = 0
            while len(left):
                at = np.minimum(off, length[left] - 8)
                same = words[heads[left] + at] == words[other[left] + at]
                unlike[left[~same]] = True
                left = left[same & (off < length[left] - 8)]
                off += 8
            if not unlike.any():
                break
            key[unlike] = mix(key[unlike] + np.uint64(1))
        order = np.argsort(self.place[run[first]], kind="stable")
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        return run, run[first[order]], rank[which]

    def _hash_at(self, at: np.ndarray) -> np.ndarray:
        out, lo = np.zeros(len(at), np.uint64), 0
        while lo < len(at):
            hi = int(np.searchsorted(at, at[lo] + _PIECE))
            h = rolling(_BYTE[self.data[at[lo] : at[hi - 1] + self.window]], self.window)
            out[lo:hi] = h[at[lo:hi] - at[lo]]
            lo = hi
        return out


def _words(data: np.ndarray) -> np.ndarray:
    """The 8 bytes from each place on, without a copy."""
    return np.ndarray((max(len(data) - 7, 0),), "<u8", np.ascontiguousarray(data), strides=(1,)) if len(data) > 7 else np.zeros(0, "<u8")


def _expand(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    total = int(sizes.sum())
    return np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(total)


def suffix_classes(text: np.ndarray, starts: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(starts in the order of their ``window`` bytes, number of each one's class in that order).

    text: bytes; starts: where ``window`` bytes are left; other suffixes only lend their ranks."""
    n = len(text)
    padded = np.concatenate([text, np.zeros(window + 8, np.uint8)])
    key = padded.astype(np.uint64)
    for k in (1, 2, 4):
        key = key[: len(key) - k] << np.uint64(8 * k) | key[k:]
    order = np.argsort(key[:n]).astype(np.int32)

    def ranks_of(differs: np.ndarray) -> np.ndarray:
        return np.maximum.accumulate(np.where(differs, np.arange(len(differs)), 0)).astype(np.int32)

    first = key[order]
    differs = np.concatenate([[True], first[1:] != first[:-1]])
    rank = np.zeros(n + window, np.int32)
    rank[order] = ranks_of(differs)
    done = 8
    while done < window:
        step = min(done, window - done)
        single = differs & np.concatenate([differs[1:], [True]])
        at = np.flatnonzero(~single)
        if not len(at):
            break
        who = order[at]
        pair = rank[who].astype(np.uint64) << np.uint64(32) | rank[who + step].astype(np.uint64)
        by = np.argsort(pair)
        order[at] = who[by]
        pair = pair[by]
        split = np.concatenate([[True], pair[1:] != pair[:-1]])
        differs[at] |= split
        rank = rank.copy()
        rank[order[at]] = ranks_of(differs)[at]
        done += step
    wanted = np.zeros(n, bool)
    wanted[starts] = True
    order = order[wanted[order]]
    # common prefixes in text order
    before = np.full(n, -1, np.int32)
    before[order[1:]] = order[:-1]
    j = before[starts]
    has = j >= 0
    follows = np.zeros(len(starts), bool)
    follows[1:] = has[1:] & has[:-1] & (starts[1:] == starts[:-1] + 1) & (j[1:] == j[:-1] + 1)
    full = np.zeros(len(starts), bool)
    irreducible = np.flatnonzero(has & ~follows)
    for off in [*range(0, window - 7, 8), window - 8]:
        a, b = starts[irreducible], j[irreducible]
        irreducible = irreducible[key[a + off] == key[b + off]]
    full[irreducible] = True
    # along a chain of pairs a prefix stays full while the new byte agrees, and is full again after ``window`` bytes that do
    chain = np.flatnonzero(follows)
    if len(chain):
        new = np.ones(len(starts), bool)
        new[chain] = padded[starts[chain] + window - 1] == padded[j[chain] + window - 1]
        head = np.maximum.accumulate(np.where(follows, 0, np.arange(len(starts))))
        miss = np.maximum.accumulate(np.where(follows & ~new, np.arange(len(starts)), -1))
        inside = follows & new
        whole = inside & (miss < head) & full[head]
        again = inside & ~whole
        full |= whole
        left = np.flatnonzero(again)
        for off in [*range(0, window - 7, 8), window - 8]:
            a, b = starts[left], j[left]
            left = left[key[a + off] == key[b + off]]
        full[left] = True
    same = np.zeros(n, bool)
    same[starts] = full
    return order, np.cumsum(~same[order]) - 1


def _bits(mask: np.ndarray) -> bytes:
    return zlib.compress(np.packbits(mask).tobytes(), 1)


def _unbits(body: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(zlib.decompress(body), np.uint8), count=n).astype(bool)


def _classes(text: np.ndarray, sizes: np.ndarray, owners: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first place of each class, in order; its smallest owner; class of every window in text order), by a suffix array of stretches one after another."""
    starts = _expand(np.cumsum(sizes + window - 1) - (sizes + window - 1), sizes)
    order, cls = suffix_classes(text, starts, window)
    back = np.zeros(len(text), np.int32)  # from places in the text to windows
    back[starts] = np.arange(len(starts), dtype=np.int32)
    begin = np.flatnonzero(np.concatenate([[True], cls[1:] != cls[:-1]]))
    window_class = np.empty(len(starts), np.int32)
    window_class[back[order]] = cls
    return order[begin], np.minimum.reduceat(np.repeat(owners, sizes)[back[order]], begin), window_class


def _below(words: np.ndarray, a: np.ndarray, b: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(whether the windows at a come before those at b, whether they are equal)."""
    less, equal, left = np.zeros(len(a), bool), np.zeros(len(a), bool), np.arange(len(a))
    for off in (*range(0, window - 7, 8), window - 8):
        p, q = words[a[left] + off].byteswap(), words[b[left] + off].byteswap()
        less[left] = p < q
        left = left[p == q]
        if not len(left):
            break
    equal[left] = True
    return less, equal


def _search(words: np.ndarray, sorted_heads: np.ndarray, wanted: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(place of each wanted window among sorted ones, whether it is there), by binary search."""
    first, key = words[sorted_heads].byteswap(), words[wanted].byteswap()
    lo, hi = np.searchsorted(first, key, "left"), np.searchsorted(first, key, "right")
    found, open_ = np.zeros(len(wanted), bool), np.flatnonzero(lo < hi)
    while len(open_):
        mid = (lo[open_] + hi[open_]) >> 1
        after, equal = _below(words, sorted_heads[mid], wanted[open_], window)
        lo[open_] = np.where(after, mid + 1, np.where(equal, mid, lo[open_]))
        hi[open_] = np.where(after, hi[open_], mid)
        found[open_[equal]] = True
        open_ = open_[~equal & (lo[open_] < hi[open_])]
    return lo, found


def first_owners(text: np.ndarray, sizes: np.ndarray, owners: np.ndarray, window: int) -> np.ndarray:
    """The smallest owner of every window of stretches one after another, among all stretches with that window."""
    length = sizes + window - 1
    ends = np.cumsum(length)
    lots, lo = [], 0
    while lo < len(sizes):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + SHARD, "right")))
        base = ends[lo] - length[lo]
        heads, least, at = _classes(text[base : ends[hi - 1]], sizes[lo:hi], owners[lo:hi], window)
        lots.append((heads + base, least, [at]))
        lo = hi
    words = _words(text)
    # two by two: the classes of one are looked up among the other's, and those not there join
    while len(lots) > 1:
        merged = []
        for (a, low_a, at_a), (b, low_b, at_b) in zip(lots[::2], lots[1::2], strict=False):
            place, there = _search(words, a, b, window)
            np.minimum.at(low_a, place[there], low_b[there])
            new = np.flatnonzero(~there)
            to_a = np.arange(len(a)) + np.searchsorted(place[new], np.arange(len(a)), "right")
            heads, least = np.empty(len(a) + len(new), a.dtype), np.empty(len(a) + len(new), low_a.dtype)
            to_b = np.empty(len(b), np.int64)
            to_b[new] = place[new] + np.arange(len(new))
            to_b[there] = to_a[place[there]]
            heads[to_a], least[to_a], heads[to_b[new]], least[to_b[new]] = a, low_a, b[new], low_b[new]
            merged.append((heads, least, [*(to_a[k] for k in at_a), *(to_b[k] for k in at_b)]))
        lots = merged + (lots[-1:] if len(lots) % 2 else [])
    return np.concatenate([lots[0][1][k] for k in lots[0][2]]) if lots else np.zeros(0, np.int64)


def _first(part: int, bodies: list[tuple[int, bytes]]) -> list[tuple[int, bytes]]:
    """Which anchors are in another shard."""
    got = [_values(b, _SIX) >> _SHIFT for _, b in bodies]
    _, place, n = np.unique(np.concatenate(got), return_inverse=True, return_counts=True)
    return [(c, np.packbits(f).tobytes()) for (c, _), f in zip(bodies, np.split(n[place] > 1, np.cumsum([len(g) for g in got])[:-1]), strict=True)]


def _judge(window: int):
    def combine(part: int, bodies: list[tuple[int, bytes]]) -> list[tuple[int, bytes]]:
        """Which windows of each chunk's stretches have a smaller owner; what a chunk sends to itself goes back as it is."""
        own = [(c, b) for c, b in bodies if b[:1] == b"L"]
        runs = [(c, *_unpacked(b, window)) for c, b in bodies if b[:1] == b"S"]
        if not runs:
            return own
        hits = [[] for _ in runs]
        # cuts between anchors, about SLICE bytes apart
        every = np.concatenate([r[1] for r in runs])
        order = np.argsort(every, kind="stable")
        upto = np.cumsum(np.concatenate([r[2] + window - 1 for r in runs])[order])
        cut = np.unique(every[order][np.searchsorted(upto, np.arange(SLICE, upto[-1], SLICE))])
        bounds = [np.concatenate([[0], np.searchsorted(r[1], cut), [len(r[1])]]) for r in runs]
        ends = [np.concatenate([[0], np.cumsum(r[2] + window - 1)]) for r in runs]
        for k in range(len(cut) + 1):
            spans = [(b[k], b[k + 1]) for b in bounds]
            text = np.concatenate([r[4][e[lo] : e[hi]] for r, e, (lo, hi) in zip(runs, ends, spans, strict=True)])
            if not len(text):
                continue
            sizes, owners = (np.concatenate([r[i][lo:hi] for r, (lo, hi) in zip(runs, spans, strict=True)]) for i in (2, 3))
            hit = first_owners(text, sizes, owners, window) < np.repeat(owners, sizes)
            for out, part_hit in zip(hits, np.split(hit, np.cumsum([int(r[2][lo:hi].sum()) for r, (lo, hi) in zip(runs, spans, strict=True)])[:-1]), strict=True):
                out.append(part_hit)
        return own + [(r[0], b"S" + _bits(np.concatenate(h) if h else np.zeros(0, bool))) for r, h in zip(runs, hits, strict=True)]

    return combine


def _packed(anchors: np.ndarray, sizes: np.ndarray, owners: np.ndarray, text: np.ndarray) -> bytes:
    head = struct.pack("<q", len(sizes)) + _planes(anchors << _SHIFT, _SIX) + x.planes32(sizes) + owners.astype("<i8").tobytes()
    return b"S" + head + text.tobytes()


def _unpacked(body: bytes, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(anchors, sizes, owners, text) of stretches."""
    (n,) = struct.unpack_from("<q", body, 1)
    sizes = x.from_planes32(body[9 + 6 * n : 9 + 10 * n]).astype(np.int64)
    return _values(body[9 : 9 + 6 * n], _SIX) >> _SHIFT, sizes, np.frombuffer(body, "<i8", n, 9 + 10 * n), np.frombuffer(body, np.uint8, offset=9 + 18 * n)


def remove(docs: DataFrame, window: int = WINDOW, text_col: str = "text") -> DataFrame:
    """Adds ``kept_bytes``, ``n_bytes``, ``n_removed`` and ``spans`` (byte ranges of the maximal removed runs)."""
    spans_type = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
    added = [T.StructField("kept_bytes", T.BinaryType()), T.StructField("n_bytes", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("spans", spans_type)]
    columns = [c for c in docs.columns if c not in {f.name for f in added}]
    parts = x.part_count(docs)
    dealt = x.chunked(docs.withColumn("__id", F.expr("try_cast(doc_id as long)")), [*columns, "__id"], text_col)

    def ask(chunk: int, table: pa.Table) -> list[tuple[int, bytes]]:
        got = _Chunk(table, window)
        sent, edges = got.anchors << _SHIFT, got.edges(parts)
        return [(p, _planes(sent[a:b], _SIX)) for p, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True)) if b > a]

    def send(table: pa.Table, bodies: list[tuple[int, bytes]]) -> pa.Table:
        got = _Chunk(table, window)
        edges, wanted = got.edges(parts), got.local.copy()
        for p, body in bodies:
            wanted[edges[p] : edges[p + 1]] |= np.unpackbits(np.frombuffer(body, np.uint8), count=edges[p + 1] - edges[p]).astype(bool)
        run, first, which = got.stretches(wanted)
        least = np.full(len(first), _LAST)
        np.minimum.at(least, which, got.ids[got.doc[run]])
        place, out = np.searchsorted(got.place[first], edges), []
        for p, (a, b) in enumerate(zip(place[:-1], place[1:], strict=True)):
            if b > a:
                sizes = got.sizes[first[a:b]].astype(np.int64)
                out.append((p, _packed(got.anchors[got.place[first[a:b]]], sizes, least[a:b], got.data[_expand(got.heads[first[a:b]], sizes + window - 1)])))
        chunk = table[x.CHUNK][0].as_py()
        return x.asks(chunk, [*out, (chunk % parts, b"L" + _bits(wanted))])

    def mark(table: pa.Table, bodies: list[tuple[int, bytes]]) -> pa.Table:
        got = _Chunk(table, window)
        run, first, which = got.stretches(_unbits(next(b for _, b in bodies if b[:1] == b"L")[1:], len(got.anchors)))
        gone = np.zeros(len(got.data) + 1, np.int32)  # +1 where a removed run begins, -1 after it
        if len(run):
            sizes = got.sizes[first].astype(np.int64)
            edges, base = np.searchsorted(got.place[first], got.edges(parts)), np.concatenate([[0], np.cumsum(sizes)])
            hit, least = np.zeros(base[-1], bool), np.full(len(first), _LAST)
            for p, body in bodies:
                if body[:1] == b"S":
                    lo, hi = base[edges[p]], base[edges[p + 1]]
                    hit[lo:hi] = _unbits(body[1:], hi - lo)
            owner = got.ids[got.doc[run]]
            np.minimum.at(least, which, owner)
            later = owner > least[which]
            for some in np.array_split(np.arange(len(run)), max(1, len(run) >> 16)):
                own = got.sizes[run[some]].astype(np.int64)
                at = _expand(got.heads[run[some]], own)
                bad = hit[_expand(base[which[some]], own)] | np.repeat(later[some], own)
                np.add.at(gone, at[bad], 1)
                np.subtract.at(gone, at[bad] + window, 1)
        removed_byte = np.cumsum(gone[:-1]) > 0
        kept, removed, spans = [], [], []
        for a, b in zip(got.offsets[:-1], got.offsets[1:], strict=True):
            own = removed_byte[a:b]
            n = int(own.sum())
            removed.append(n)
            kept.append((got.data[a:b][~own] if n else got.data[a:b]).tobytes())
            cut = np.flatnonzero(np.diff(np.concatenate([[0], own.astype(np.int8), [0]]))) if n else np.zeros(0, np.int64)
            spans.append([{"start": int(s), "end": int(e)} for s, e in zip(cut[::2], cut[1::2], strict=True)])
        cols = [table[c] for c in columns] + [pa.array(kept, pa.binary()), pa.array(np.diff(got.offsets)), pa.array(removed, pa.int64())]
        cols.append(pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))))
        return pa.table(dict(zip([*columns, *[f.name for f in added]], cols, strict=True)))

    asked = x.finish(dealt, x.reply(x.ask(dealt, ask), _first), send, x.ASK)
    return x.finish(dealt, x.reply(asked, _judge(window)), mark, T.StructType([*docs.select(*columns).schema.fields, *added]))


def op5_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes left of every document without the runs of 50 that an earlier document holds."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    got = remove(docs)
    return got.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept_bytes", 256).alias("kept_sha256"))
