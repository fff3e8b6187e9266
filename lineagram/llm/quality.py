"""Quality rules: divergence of a document from the languages of its corpus.

Every document has a histogram of character classes (space, lower case, upper
case, digits, sentence marks, other signs, control, letters by length in UTF-8)
and one of its language's common words.  A language's reference is the mean of
its documents' character histograms, and the shares of the words that make up at
least ``common`` of all its words.  A document is rejected if its smallest
Jensen-Shannon distance (root of the base-2 divergence) to the references is
over ``max_char`` or ``max_word``.  Short documents have noisy histograms, so
documents under ``min_chars`` characters are spared the one comparison and those
under ``min_words`` words the other, and the word distance may exceed its limit
by ``slack`` over the root of the word count.

Statistics cover all rows.  Words are counted in blocks; a block hands on the
words that make up ``common``/2 of it, which loses less than ``common``/2 of any
word, so at most 2/``common`` words a language are candidates, and a second pass
counts these exactly: what is collected is bounded by the number of languages,
and languages of under ``min_lang`` words have no reference.  Their documents are
spared the word comparison, since other languages' words say nothing about them.
All sums are of integers, so reruns agree whatever the partitioning.

Null text has no words; null lang is a language of its own.  Documents that fail
the base rules don't shape the references.  Repeated rows count each, in references
too, and get equal verdicts; ties between references don't matter, since only the
smallest distance counts.  An empty table gives an empty result.  Extra columns pass through; a column named like an added one is replaced.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lineagram.llm.common import buffers, mix, pieces, rolling, utf8, word_hashes, word_spans, written

CLASSES = ("space", "lower", "upper", "digit", "mark", "sign", "control", "two", "three", "four")
_CLASS = np.full(256, 6, np.int64)
_CLASS[[9, 10, 11, 12, 13, 32]] = 0
_CLASS[33:127] = 5
_CLASS[ord("a") : ord("z") + 1] = 1
_CLASS[ord("A") : ord("Z") + 1] = 2
_CLASS[ord("0") : ord("9") + 1] = 3
_CLASS[[ord(c) for c in ".,;:?'\"()-"]] = 4
_CLASS[0x80:0xC0] = -1
_CLASS[0xC0:0xE0] = 7
_CLASS[0xE0:0xF0] = 8
_CLASS[0xF0:] = 9
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
#: Histograms are carried as parts of so many.
PARTS = 1_000_000
WINDOW = 8
#: Bytes of text whose histograms are made at once.
STEP = 1 << 20
SIGNALS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
_RAW, _LANG = "__utf8", "__lang"


@dataclass(frozen=True)
class Rules:
    min_chars: int = 150
    min_words: int = 60
    common: float = 0.002
    min_lang: int = 5000
    max_char: float = 0.25
    max_word: float = 0.20
    slack: float = 2.0


@dataclass
class References:
    langs: list[str] = field(default_factory=list)
    chars: np.ndarray = field(default_factory=lambda: np.zeros((0, len(CLASSES))))
    words: list[tuple[np.ndarray, np.ndarray]] = field(default_factory=list)  # (hashes, shares) by language


class Block:
    """Histograms and base signals of some documents."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        n = len(offsets) - 1
        self.data, self.offsets = data, offsets
        self.starts, self.ends, self.first = word_spans(data, offsets)
        self.n_words = np.diff(self.first)
        self.doc = np.repeat(np.arange(n), self.n_words)
        kinds = _CLASS[data]
        own = np.repeat(np.arange(n), np.diff(offsets))
        self.chars = np.bincount(own[kinds >= 0] * len(CLASSES) + kinds[kinds >= 0], minlength=n * len(CLASSES)).reshape(n, len(CLASSES))
        self.word_chars = self.chars[:, 1:].sum(1)
        self.n_symbols = np.bincount(own[_SYMBOL[data]], minlength=n)
        self.hashes = word_hashes(data, self.starts, self.ends)
        self.n_repeat_words = self._repeats(n)
        self.n_dup_lines = np.array([self._dup_lines(data[a:b].tobytes()) for a, b in zip(offsets[:-1], offsets[1:], strict=True)], np.int64)
        self.base_failed = (self.n_words < 20) | (100 * self.n_repeat_words > 30 * self.n_words)

    def _repeats(self, n: int) -> np.ndarray:
        w = rolling(self.hashes, WINDOW)
        if not len(w):
            return np.zeros(n, np.int64)
        inside = self.doc[: len(w)] == self.doc[WINDOW - 1 :]
        at = np.flatnonzero(inside)
        key = mix(w[at] ^ mix(self.doc[at].astype(np.uint64) + np.uint64(1)))
        order = np.argsort(key)
        same = key[order][1:] == key[order][:-1]
        twice = np.zeros(len(at), bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        edges = np.zeros(len(self.hashes) + 1, np.int64)
        np.add.at(edges, at[twice], 1)
        np.subtract.at(edges, at[twice] + WINDOW, 1)
        return np.bincount(self.doc[np.cumsum(edges[:-1]) > 0], minlength=n)

    @staticmethod
    def _dup_lines(text: bytes) -> int:
        lines = text.split(b"\n")
        if len(set(lines)) == len(lines):
            return 0
        seen: set[bytes] = set()
        found = 0
        for line in lines:
            if line in seen:
                found += 1
            elif line.strip(b" \t\r\x0b\x0c"):
                seen.add(line)
        return found

    def lower_hashes(self) -> np.ndarray:
        return word_hashes(_LOWER[self.data], self.starts, self.ends)

    def word(self, i: int) -> bytes:
        return _LOWER[self.data[self.starts[i] : self.ends[i]]].tobytes()


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, Block]]:
    for whole in batches:
        data, offsets = buffers(whole.column(whole.schema.get_field_index(_RAW)))
        for lo, hi in pieces(offsets, STEP):
            yield whole.slice(lo, hi - lo), Block(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])


def _shares(counts: np.ndarray) -> np.ndarray:
    return counts * PARTS // np.maximum(counts.sum(1, keepdims=True), 1)


def _key(lang: str, h: int) -> tuple[str, int]:
    return lang, int(np.uint64(h).astype(np.int64))


def _counts(docs: DataFrame, rules: Rules, wanted: dict[str, np.ndarray] | None) -> DataFrame:
    """Rows (lang, h, n, chars): words by hash, and per language h null with all words and the sum of character shares.

    wanted: the words to count exactly, by language; None: those frequent in some block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: Counter = Counter()
        totals: dict[str, np.ndarray] = {}
        for b, block in _blocks(batches):
            langs = b.column(b.schema.get_field_index(_LANG)).to_pylist()
            names = sorted(set(langs))
            code = np.array([names.index(x) for x in langs])
            good = ~block.base_failed
            shares, hashes = _shares(block.chars), block.lower_hashes()
            for k, lang in enumerate(names):
                mine = good & (code == k)
                h = hashes[mine[block.doc]]
                row = np.concatenate([[len(h), mine.sum()], shares[mine].sum(0)])
                totals[lang] = totals.get(lang, 0) + row
                if wanted is None:
                    found, n = np.unique(h, return_counts=True)
                    often = n >= rules.common / 2 * len(h)
                    found, n = found[often], n[often]
                else:
                    at = np.searchsorted(look := wanted.get(lang, np.zeros(0, np.uint64)), h)
                    hit = at[(at < len(look)) & (look[np.minimum(at, len(look) - 1)] == h)] if len(look) else at[:0]
                    n = np.bincount(hit, minlength=len(look))
                    found, n = look[n > 0], n[n > 0]
                for x, c in zip(found, n, strict=True):
                    words[_key(lang, x)] += int(c)
        rows = [{"lang": a, "h": h, "n": n, "chars": None} for (a, h), n in words.items()]
        rows += [{"lang": a, "h": None, "n": int(v[0]), "chars": [int(x) for x in v[1:]]} for a, v in totals.items()]
        yield pa.RecordBatch.from_pylist(rows, pa.schema([("lang", pa.string()), ("h", pa.int64()), ("n", pa.int64()), ("chars", pa.list_(pa.int64()))]))

    src = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("")).alias(_LANG), utf8("text").alias(_RAW))
    got = src.mapInArrow(run, "lang string, h long, n long, chars array<long>")
    width = 1 + len(CLASSES)
    return got.groupBy("lang", "h").agg(F.sum("n").alias("n"), *[F.sum(F.col("chars")[i]).alias(f"c{i}") for i in range(width)])


def learn(docs: DataFrame, rules: Rules = Rules()) -> References:
    """The languages' references, from all documents that pass the base rules."""
    found = written(_counts(docs, rules, None))  # read twice: texts are parsed once
    # counts that can't reach the share stay on the executors: at most 2 / common words a language come back
    total = found.where("h is null").select("lang", F.col("n").alias("all"))
    kept = found.join(total, "lang").where((F.col("h").isNull()) | (F.col("n") >= F.lit(rules.common / 2) * F.col("all")))
    rows = kept.collect()
    totals = {r.lang: r for r in rows if r.h is None}
    langs = sorted(a for a, r in totals.items() if r.n and r.n >= rules.min_lang)
    wanted = {a: np.sort(np.array([r.h for r in rows if r.h is not None and r.lang == a], np.int64).astype(np.uint64)) for a in langs}
    exact = {(r.lang, r.h): r.n for r in _counts(docs.where(F.coalesce(F.col("lang").cast("string"), F.lit("")).isin(langs)), rules, wanted).where("h is not null").collect()} if langs else {}
    refs = References(langs)
    chars = []
    for a in langs:
        sums = np.array([getattr(totals[a], f"c{i}") for i in range(1, 1 + len(CLASSES))], float)
        chars.append(sums / max(sums.sum(), 1))
        n = np.array([exact.get(_key(a, x), 0) for x in wanted[a]], float) / totals[a].n
        refs.words.append((wanted[a][n >= rules.common], n[n >= rules.common]))
    refs.chars = np.array(chars).reshape(len(langs), len(CLASSES))
    return refs


def distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance of each row of p to q."""
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        a = np.where(p > 0, p * np.log2(p / m), 0).sum(1)
        b = np.where(q > 0, q * np.log2(q / m), 0).sum(1)
    return np.sqrt(np.maximum((a + b) / 2, 0))


def _distances(block: Block, refs: References) -> tuple[np.ndarray, np.ndarray]:
    """Smallest distances of the character and of the word histograms."""
    n = len(block.n_words)
    if not refs.langs:
        return np.zeros(n), np.zeros(n)
    chars = block.chars / np.maximum(block.chars.sum(1, keepdims=True), 1)
    by_char = np.min([distance(chars, q) for q in refs.chars], axis=0)
    look = np.unique(np.concatenate([h for h, _ in refs.words]))
    by_word = np.ones(n)
    size = np.maximum(block.n_words, 1)[:, None]
    at, doc = np.zeros(0, np.int64), np.zeros(0, np.int64)
    if len(look):
        h = block.lower_hashes()
        at = np.minimum(np.searchsorted(look, h), len(look) - 1)
        hit = look[at] == h
        at, doc = at[hit], block.doc[hit]
    for hashes, shares in refs.words:
        # a table for each language: all words of all languages at once would grow with their number
        column = np.full(len(look), -1)
        column[np.searchsorted(look, hashes)] = np.arange(len(hashes))
        mine = column[at]
        p = np.bincount(doc[mine >= 0] * len(hashes) + mine[mine >= 0], minlength=n * len(hashes)).reshape(n, len(hashes)) / size
        p = np.concatenate([p, np.maximum(1 - p.sum(1, keepdims=True), 0)], 1)
        by_word = np.minimum(by_word, distance(p, np.append(shares, max(0.0, 1 - shares.sum()))[None, :]))
    return by_char, by_word


def judge(docs: DataFrame, rules: Rules = Rules(), refs: References | None = None) -> DataFrame:
    """Adds the base signals, ``char_distance``, ``word_distance``, ``base_failed`` and ``kept``."""
    refs = learn(docs, rules) if refs is None else refs
    added = [*[(c, "long") for c in SIGNALS], ("char_distance", "double"), ("word_distance", "double"), ("base_failed", "boolean"), ("kept", "boolean")]
    keep = docs.drop(*[c for c, _ in added])
    known = set(refs.langs)
    schema = T.StructType([*keep.schema.fields, *[T.StructField(c, {"long": T.LongType(), "double": T.DoubleType(), "boolean": T.BooleanType()}[k]) for c, k in added]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, block in _blocks(batches):
            by_char, by_word = _distances(block, refs)
            limit = rules.max_word + rules.slack / np.sqrt(np.maximum(block.n_words, 1))
            good_chars = (by_char <= rules.max_char) | (block.chars.sum(1) < rules.min_chars)
            good_words = (by_word <= limit) | (block.n_words < rules.min_words)
            if _LANG in b.schema.names:
                good_words |= ~np.array([x in known for x in b.column(b.schema.get_field_index(_LANG)).to_pylist()], bool)
            kept = ~block.base_failed & good_chars & good_words
            cols = [b.column(i) for i, c in enumerate(b.schema.names) if c not in (_RAW, _LANG)]
            cols += [pa.array(getattr(block, c).astype(np.int64)) for c in SIGNALS]
            cols += [pa.array(x) for x in (by_char, by_word, block.base_failed, kept)]
            yield pa.RecordBatch.from_arrays(cols, [*[c for c in b.schema.names if c not in (_RAW, _LANG)], *[c for c, _ in added]])

    src = keep.withColumn(_RAW, utf8("text"))
    if "lang" in keep.columns:
        src = src.withColumn(_LANG, F.coalesce(F.col("lang").cast("string"), F.lit("")))
    return src.mapInArrow(run, schema)


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base signals and the verdict for every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = judge(docs.select("doc_id", "text", "lang"), refs=learn(docs))
    return got.select("doc_id", *SIGNALS, "base_failed", "kept", "char_distance", "word_distance")
