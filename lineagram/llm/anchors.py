"""Substring dedup on words by fixed-block anchors.

Every document is cut into reference blocks of ``(window + 1) // 2`` words that
don't overlap; any run of ``window`` words holds one of them whole.  The blocks
are probed with every rolling block-sized window of all documents: a block whose
hash occurs again anywhere is an anchor.  Anchors are extended: each run of
``window`` words around an anchor is looked up among all such runs, and the runs
found again, joined where they overlap, are the maximal exact repeats.  All
occurrences of a repeat are removed, the first included; runs are judged on the
input, not on what is left.

Both lookups are exchanges of packed hashes by chunk (see exchange.py): a block
or run is one entry for each chunk that holds it, with a mark if the chunk holds
it twice.  A passage that a third of all documents share costs one entry a chunk.
Blocks are compared by 46 bits of their hash, which only says where to look; runs by
95 bits of two hashes: among n runs near anchors the expected number of false
pairs is n * n / 2 ** 96, one in a hundred thousand for 10 ** 12 of them.

Null and empty texts have no words, and texts shorter than the window are never
touched.  A null doc_id is as good as any: rows are told apart by their place.
Repeated rows count as documents of their own, so they remove each other.  Ties can't
be: all occurrences go.  An empty table gives an empty result.  Extra columns pass
through; a column of the name of an added one is replaced.
"""

from __future__ import annotations

from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lineagram.llm import exchange as x
from lineagram.llm.common import buffers, mix, pieces, rolling, word_hashes, word_spans

WINDOW = 35
#: Bits of a block's hash that travel, above two marks.
_KEY_SHIFT = np.uint64(18)
_TWICE, _ALIGNED = np.uint64(1 << 16), np.uint64(1 << 17)
SPANS = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))


class _Words:
    """Word hashes of a chunk's documents, one after another."""

    def __init__(self, table: pa.Table):
        self.data, self.offsets = buffers(table[x.RAW])
        hashes, counts = [], []
        for lo, hi in pieces(self.offsets):
            data, offsets = self.data[self.offsets[lo] : self.offsets[hi]], self.offsets[lo : hi + 1] - self.offsets[lo]
            starts, ends, first = word_spans(data, offsets)
            hashes.append(word_hashes(data, starts, ends))
            counts.append(np.diff(first))
        self.hashes = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
        self.counts = np.concatenate(counts) if counts else np.zeros(0, np.int64)
        self.first = np.concatenate([[0], np.cumsum(self.counts)]).astype(np.int64)
        self.doc = np.repeat(np.arange(len(self.counts), dtype=np.int32), self.counts)

    def windows(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(starts, hashes) of all runs of k words inside one document."""
        h = rolling(self.hashes, k)
        at = np.flatnonzero(self.doc[: len(h)] == self.doc[k - 1 :]) if len(h) else np.zeros(0, np.int64)
        return at, h[at]


    def seconds(self, k: int, at: np.ndarray) -> np.ndarray:
        """Second hashes, from other hashes of the words, of the runs of k words from each place on."""
        return (rolling(mix(self.hashes ^ _OTHER), k)[at] >> np.uint64(32)).astype(np.uint32) if len(at) else np.zeros(0, np.uint32)


_OTHER = np.uint64(0xA0761D6478BD642F)


def _distinct(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(places of the first of each distinct pair in order, whether each occurs twice, each pair's place among the distinct)."""
    order = np.lexsort((b, a))
    new = np.concatenate([[True], (a[order][1:] != a[order][:-1]) | (b[order][1:] != b[order][:-1])]) if len(a) else np.zeros(0, bool)
    first = np.flatnonzero(new)
    place = np.empty(len(a), np.int64)
    place[order] = np.cumsum(new) - 1
    return order[first], np.diff(np.append(first, len(a))) > 1, place


def _unique(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct keys in order, whether each occurs twice, each key's place among the distinct)."""
    distinct, place, n = np.unique(keys, return_inverse=True, return_counts=True)
    return distinct, n > 1, place


def _blocks(words: _Words, block: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(entries as sent, their 46-bit keys, positions of reference blocks, these blocks' entries)."""
    at, h = words.windows(block)
    keys, twice, place = _unique(h >> _KEY_SHIFT)
    is_reference = (at - words.first[words.doc[at]]) % block == 0
    aligned = np.zeros(len(keys), bool)
    aligned[place[is_reference]] = True
    sent = keys << _KEY_SHIFT
    sent[twice] |= _TWICE
    sent[aligned] |= _ALIGNED
    return sent, keys, at[is_reference], place[is_reference]


def _split(sent: np.ndarray, parts: int, planes: slice) -> list[tuple[int, bytes]]:
    edges = x.cuts(sent, parts)
    return [(p, _planes(sent[a:b], planes)) for p, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True)) if b > a]


def _planes(values: np.ndarray, planes: slice) -> bytes:
    return np.ascontiguousarray(np.ascontiguousarray(values).view(np.uint8).reshape(-1, 8)[:, planes].T).tobytes()


def _values(body: bytes, planes: slice) -> np.ndarray:
    width = len(range(8)[planes])
    out = np.zeros((len(body) // width, 8), np.uint8)
    out[:, planes] = np.frombuffer(body, np.uint8).reshape(width, -1).T
    return out.view("<u8").ravel()


_SIX, _EIGHT = slice(2, 8), slice(0, 8)


def _again(keys: list[np.ndarray], twice: list[np.ndarray]) -> list[np.ndarray]:
    """For each chunk's sorted distinct keys, which occur in another chunk too or twice in one."""
    distinct, place, n = np.unique(np.concatenate(keys), return_inverse=True, return_counts=True)
    often = n > 1
    often[place[np.concatenate(twice)]] = True
    return np.split(often[place], np.cumsum([len(k) for k in keys])[:-1])


def _anchors(parts: int):
    def combine(part: int, bodies: list[tuple[int, bytes]]) -> list[tuple[int, bytes]]:
        got = [_values(b, _SIX) for _, b in bodies]
        found = _again([v >> _KEY_SHIFT for v in got], [(v & _TWICE) != 0 for v in got])
        return [(c, np.packbits(f & ((v & _ALIGNED) != 0)).tobytes()) for (c, _), v, f in zip(bodies, got, found, strict=True)]

    return combine


def _body(first: np.ndarray, second: np.ndarray) -> bytes:
    """Both hashes of some runs, 12 bytes each."""
    return _planes(first, _EIGHT) + x.planes32(second)


def _hashes(body: bytes) -> tuple[np.ndarray, np.ndarray]:
    at = len(body) // 12 * 8
    return _values(body[:at], _EIGHT), x.from_planes32(body[at:])


def _runs(part: int, bodies: list[tuple[int, bytes]]) -> list[tuple[int, bytes]]:
    """Which runs occur in another chunk too or twice in one, of each chunk's own."""
    one = np.uint64(1)
    got = [_hashes(b) for _, b in bodies]
    marked, second = (np.concatenate([g[i] for g in got]) for i in (0, 1))
    _, often, place = _distinct(marked >> one, second)
    often[place[(marked & one) != 0]] = True
    found = np.split(often[place], np.cumsum([len(g[0]) for g in got])[:-1])
    return [(c, _body(h[f], h2[f])) for (c, _), (h, h2), f in zip(bodies, got, found, strict=True) if f.any()]


def repeats(docs: DataFrame, columns: list[str], added: list[T.StructField], use, window: int = WINDOW, text_col: str = "text") -> DataFrame:
    """use(columns, bytes, word numbers per document, mask of repeated words) gives the added columns."""
    block, parts = (window + 1) // 2, x.part_count(docs)
    dealt = x.chunked(docs, columns, text_col)

    def probe(chunk: int, table: pa.Table) -> list[tuple[int, bytes]]:
        return _split(_blocks(_Words(table), block)[0], parts, _SIX)

    def extend(table: pa.Table, bodies: list[tuple[int, bytes]]) -> pa.Table:
        words = _Words(table)
        sent, _, at, place = _blocks(words, block)
        edges, anchor = x.cuts(sent, parts), np.zeros(len(sent), bool)
        for p, body in bodies:
            n = edges[p + 1] - edges[p]
            anchor[edges[p] : edges[p + 1]] = np.unpackbits(np.frombuffer(body, np.uint8), count=n).astype(bool)
        at = at[anchor[place]]
        near = np.zeros(len(words.hashes) + 1, np.int32)
        np.add.at(near, np.maximum(at + block - window, 0), 1)
        np.subtract.at(near, at + 1, 1)
        starts, h = words.windows(window)
        close = np.cumsum(near[:-1])[starts] > 0 if len(starts) else np.zeros(0, bool)
        first, second = h[close] >> np.uint64(1), words.seconds(window, starts[close])
        own, twice, _ = _distinct(first, second)
        sent, second = first[own] << np.uint64(1) | twice.astype(np.uint64), second[own]
        edges = x.cuts(sent, parts)
        bodies = [(p, _body(sent[a:b], second[a:b])) for p, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True)) if b > a]
        return x.asks(table[x.CHUNK][0].as_py(), bodies)

    def mark(table: pa.Table, bodies: list[tuple[int, bytes]]) -> pa.Table:
        words = _Words(table)
        starts, h = words.windows(window)
        covered = np.zeros(len(words.hashes) + 1, np.int32)
        if bodies:
            known, check = (np.concatenate(v) for v in zip(*(_hashes(b) for _, b in bodies), strict=True))
            known, h = known >> np.uint64(1), h >> np.uint64(1)
            at = np.searchsorted(known, h)
            left = np.flatnonzero(at < len(known))
            left = left[known[at[left]] == h[left]]
            second, hit = words.seconds(window, starts[left]), np.zeros(len(h), bool)
            todo, at = np.arange(len(left)), at[left]
            while len(todo):  # runs whose first hashes are equal stand one after another
                same = check[at[todo]] == second[todo]
                hit[left[todo[same]]] = True
                todo = todo[~same]
                at[todo] += 1
                todo = todo[at[todo] < len(known)]
                todo = todo[known[at[todo]] == h[left[todo]]]
            starts = starts[hit]
            np.add.at(covered, starts, 1)
            np.subtract.at(covered, starts + window, 1)
        return use(table, words, np.cumsum(covered[:-1]) > 0)

    anchored = x.reply(x.ask(dealt, probe), _anchors(parts))
    asked = x.finish(dealt, anchored, extend, x.ASK)
    schema = T.StructType([*docs.select(*columns).schema.fields, *added])
    return x.finish(dealt, x.reply(asked, _runs), mark, schema)


def remove(docs: DataFrame, window: int = WINDOW, text_col: str = "text") -> DataFrame:
    """Adds ``kept_text`` (the words left, joined by one space), ``n_words``, ``n_removed`` and ``spans`` (word numbers of the maximal repeats)."""
    added = [T.StructField("kept_text", T.StringType()), T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("spans", SPANS)]
    columns = [c for c in docs.columns if c not in {f.name for f in added}]

    def use(table: pa.Table, words: _Words, gone: np.ndarray) -> pa.Table:
        texts, n_removed, spans = [], [], []
        for i, (a, b) in enumerate(zip(words.first[:-1], words.first[1:], strict=True)):
            own = words.data[words.offsets[i] : words.offsets[i + 1]].tobytes().split()
            mask = gone[a:b]
            n = int(mask.sum())
            n_removed.append(n)
            spans.append([])
            if n:
                own = compress(own, ~mask)
                edge = np.flatnonzero(np.diff(np.concatenate([[0], mask.astype(np.int8), [0]])))
                spans[-1] = [{"start": int(s), "end": int(e)} for s, e in zip(edge[::2], edge[1::2], strict=True)]
            texts.append(b" ".join(own))
        cols = [table[c] for c in columns]
        cols += [pa.array(texts, pa.binary()).cast(pa.string()), pa.array(words.counts, pa.int64()), pa.array(n_removed, pa.int64())]
        cols.append(pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))))
        return pa.table(dict(zip([*columns, *[f.name for f in added]], cols, strict=True)))

    return repeats(docs, columns, added, use, window, text_col)


def op2_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words left of every document without the runs of 35 that are found again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    got = remove(docs.select("doc_id", "text"))
    return got.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


#: The same by counting every run of 35 words.
OP2_SQL = r"""
  with d as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents)
  , runs as (select doc_id, s, array_to_string(w[s:s + 34], ' ') as g from (select doc_id, w, unnest(range(1, len(w) - 33)) as s from d where len(w) >= 35))
  , again as (select doc_id, s from (select doc_id, s, count(*) over (partition by g) as n from runs) where n > 1)
  , gone as (select distinct doc_id, s + o as i from again, range(35) t(o))
  , words as (select doc_id, unnest(w) as word, generate_subscripts(w, 1) as i from d)
  , kept as (select doc_id, string_agg(word, ' ' order by i) as t, count(*) as n from words anti join gone using (doc_id, i) group by 1)
  select d.doc_id, cast(len(w) as bigint) as n_words, cast(len(w) - coalesce(n, 0) as bigint) as n_removed, sha256(coalesce(t, '')) as kept_sha256
  from d left join kept using (doc_id)
"""
