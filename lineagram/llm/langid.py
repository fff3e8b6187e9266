"""Language identification: averaged hashed subword embeddings and a linear softmax.

A text's subwords are the runs of 1 to ``LONGEST`` bytes of its letters (A-Z in
lower case; everything that isn't a letter is one space), hashed into ``BUCKETS``
rows of an embedding table.  Their mean goes through a linear layer and a softmax.
Table and layer are trained together in numpy by stochastic gradient descent,
on a bounded sample of the labelled rows: about ``SAMPLE`` texts a language,
chosen by a hash of the text, each text once however many rows it has, as a whole
and in short pieces, as counts of at most ``BUCKETS`` entries, so the driver's memory
is bounded whatever the texts' length and repeats.
A fifth of the sample is held back to fit the softmax's temperature and the score
under which a prediction counts as rejected.

To score, the table times the layer is one row of logits a bucket, which is all
the workers get; every whole text is scored.  Null text and text without a letter
are ``und`` with score 0.  Languages of equal probability go to the first by name;
repeated rows get equal predictions.  With nothing to learn from every text is ``und``.
Extra columns pass through; a column of the name of an added one is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lineagram.llm.common import buffers, pieces, utf8

LONGEST = 4
BUCKETS = 1 << 15
SAMPLE = 600
DIM = 16
UNKNOWN = "und"
_RAW = "__utf8"
_FOLD = np.full(256, 32, np.uint8)
_FOLD[0x80:] = np.arange(0x80, 256)
for _c in range(26):
    _FOLD[65 + _c] = _FOLD[97 + _c] = 97 + _c


@dataclass
class Model:
    langs: list[str]
    logits: np.ndarray  # (BUCKETS, languages), float32
    bias: np.ndarray
    temperature: float
    reject_under: float


def _letters(data: np.ndarray) -> np.ndarray:
    """The bytes with what mostly isn't letters made spaces: ASCII signs, characters of lead byte 0xC2, those from U+2000 to U+2BFF, and the two signs under 0xC3."""
    out = _FOLD[data]
    for lead, width in ((0xC2, 2), (0xE2, 3)):
        at = np.flatnonzero(data == lead)
        if lead == 0xE2:  # from U+2C00 on there are letters again
            at = at[data[np.minimum(at + 1, len(data) - 1)] < 0xB0]
        for k in range(width):
            out[np.minimum(at + k, len(out) - 1)] = 32
    if (data == 0xC3).any():
        at = np.flatnonzero((data[1:] == 0x97) | (data[1:] == 0xB7))
        at = at[data[at] == 0xC3]
        out[at] = out[at + 1] = 32
    return out


def _buckets(letters: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(bucket, row) of every subword of each length; a subword lies in one row and holds a letter and at most its word's borders."""
    n = len(letters)
    own = np.repeat(np.arange(len(offsets) - 1, dtype=np.int32), np.diff(offsets))
    space = letters == 32
    packed = letters.astype(np.uint64)
    inner = np.zeros(n, bool)  # a space between the first and the last byte
    any_letter = ~space
    for k in range(1, LONGEST + 1):
        if k > 1:
            m = n - k + 1
            if m <= 0:
                return
            packed = packed[:m] | letters[k - 1 :].astype(np.uint64) << np.uint64(8 * (k - 1))
            inner = (inner[:m] | space[k - 2 : k - 2 + m]) if k > 2 else np.zeros(m, bool)
            any_letter = any_letter[:m] | ~space[k - 1 :]
        good = np.flatnonzero(any_letter & ~inner & (own[: len(packed)] == own[k - 1 :]))
        key = (packed[good] + np.uint64(k) * np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xFF51AFD7ED558CCD)
        yield (key >> np.uint64(49)).astype(np.int64), own[good]


def _blocks(batches: Iterator[pa.RecordBatch], step: int = 1 << 19):
    for whole in batches:
        data, offsets = buffers(whole.column(whole.schema.get_field_index(_RAW)))
        for lo, hi in pieces(offsets, step):
            yield whole.slice(lo, hi - lo), data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]


def _shorter(raw: bytes, seed: int) -> list[bytes]:
    """The text and two short pieces of it."""
    words = raw.split()
    rng = np.random.default_rng(abs(seed))
    out = [raw]
    for size in (20, 5):
        if len(words) > size:
            at = int(rng.integers(len(words) - size))
            out.append(b" ".join(words[at : at + size]))
    return out


def _sampled(docs: DataFrame, lang_col: str, sample: int) -> list[tuple[str, int, np.ndarray, np.ndarray]]:
    """(lang, hash, buckets, counts) of the training texts."""
    labelled = docs.where(F.col(lang_col).isNotNull() & F.col("text").isNotNull())
    counts = {r[0]: r[1] for r in labelled.groupBy(F.col(lang_col).cast("string")).count().collect()}
    if not counts:
        return []
    share = F.create_map(*[x for a, n in counts.items() for x in (F.lit(a), F.lit(min(1.0, sample / n)))])
    key = F.xxhash64("text", F.lit(11))
    chosen = labelled.where(F.pmod(key, F.lit(1 << 30)) < share[F.col(lang_col).cast("string")] * (1 << 30))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for lang, key, raw in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                for piece in _shorter(raw, key):
                    data = np.frombuffer(b" " + piece + b" ", np.uint8)
                    found = [x for x, _ in _buckets(_letters(data), np.array([0, len(data)]))]
                    ids, n = np.unique(np.concatenate(found), return_counts=True) if found else (np.zeros(0, int),) * 2
                    if len(ids):
                        rows.append({"lang": lang, "key": key, "ids": ids.astype(np.int32), "n": n.astype(np.float32)})
            yield pa.RecordBatch.from_pylist(rows, pa.schema([("lang", pa.string()), ("key", pa.int64()), ("ids", pa.list_(pa.int32())), ("n", pa.list_(pa.float32()))]))

    # each text once, so that a text of many rows doesn't fill the sample
    once = chosen.select(F.col(lang_col).cast("string").alias("lang"), key.alias("key"), "text").groupBy("lang", "key").agg(F.first("text").alias("text"))
    got = once.select("lang", "key", utf8("text").alias(_RAW)).mapInArrow(run, "lang string, key long, ids array<int>, n array<float>")
    table = got.toArrow()
    rows = list(zip(table["lang"].to_pylist(), table["key"].to_pylist(), [np.asarray(x.values) for x in table["ids"]], [np.asarray(x.values) for x in table["n"]], strict=True))
    return sorted(rows, key=lambda r: (r[1], r[0], len(r[2]), r[3].tobytes()))


def _softmax(z: np.ndarray) -> np.ndarray:
    z = np.exp(z - z.max(1, keepdims=True))
    return z / z.sum(1, keepdims=True)


def fit(docs: DataFrame, lang_col: str = "lang", sample: int = SAMPLE, epochs: int = 6, rate: float = 20.0, seed: int = 3) -> Model:
    """Learns from the labelled rows of docs (text and lang, nothing else)."""
    rows = _sampled(docs, lang_col, sample)
    langs = sorted({r[0] for r in rows})
    if not langs:
        return Model([], np.zeros((BUCKETS, 0), np.float32), np.zeros(0), 1.0, 0.0)
    y = np.array([langs.index(r[0]) for r in rows])
    held = np.array([abs(r[1]) // 8 % 5 == 0 for r in rows]) if len(rows) >= 50 else np.zeros(len(rows), bool)
    rng = np.random.default_rng(seed)
    table = rng.normal(0, 0.1, (BUCKETS, DIM)).astype(np.float32)
    layer, bias = rng.normal(0, 0.1, (DIM, len(langs))).astype(np.float32), np.zeros(len(langs), np.float32)
    weight = [r[3] / r[3].sum() for r in rows]

    def batch(some: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        ids = np.concatenate([rows[i][2] for i in some])
        w = np.concatenate([weight[i] for i in some])
        starts = np.cumsum([0, *[len(rows[i][2]) for i in some[:-1]]])
        return ids, w, starts

    def means(ids: np.ndarray, w: np.ndarray, starts: np.ndarray) -> np.ndarray:
        return np.add.reduceat(table[ids] * w[:, None], starts, axis=0)

    train = np.flatnonzero(~held)
    frequency = np.bincount(y[train], minlength=len(langs))
    balance = (len(train) / np.maximum(frequency, 1) / len(langs)).astype(np.float32)
    for epoch in range(epochs):
        step = rate * (1 - epoch / epochs)
        order = rng.permutation(train)
        for lo in range(0, len(order), 32):
            some = order[lo : lo + 32]
            ids, w, starts = batch(some)
            mean = means(ids, w, starts)
            grad = _softmax(mean @ layer + bias)
            grad[np.arange(len(some)), y[some]] -= 1
            grad *= balance[y[some]][:, None] / len(some)
            back = grad @ layer.T
            sizes = np.diff(np.append(starts, len(ids)))
            layer -= 0.05 * step * mean.T @ grad
            bias -= 0.005 * step * grad.sum(0)
            np.subtract.at(table, ids, step * np.repeat(back, sizes, axis=0) * w[:, None])
    logits = table @ layer
    temperature, under = 1.0, 0.0
    if held.any():
        some = np.flatnonzero(held)
        raw = np.concatenate([means(*batch(some[i : i + 64])) for i in range(0, len(some), 64)]) @ layer + bias
        loss = lambda t: -np.log(np.maximum(_softmax(raw / t)[np.arange(len(some)), y[some]], 1e-12)).mean()
        temperature = float(min(np.geomspace(0.05, 5, 60), key=loss))
        best = _softmax(raw / temperature)
        wrong = best.max(1)[best.argmax(1) != y[some]]
        under = float(np.quantile(wrong, 0.5)) if len(wrong) else 0.5
    return Model(langs, logits.astype(np.float32), bias, temperature, under)


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """Adds ``lang_pred``, ``score`` (calibrated probability) and ``rejected``."""
    keep = docs.drop("lang_pred", "score", "rejected")
    schema = T.StructType([*keep.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("rejected", T.BooleanType())])
    shared = docs.sparkSession.sparkContext.broadcast((np.ascontiguousarray(model.logits.T), model.bias))
    langs, temperature, under = np.array([*model.langs, UNKNOWN], object), model.temperature, model.reject_under

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        logits, bias = shared.value
        for b, data, offsets in _blocks(batches):
            n = len(offsets) - 1
            sums, count = np.zeros((n, len(bias))), np.zeros(n)
            letters = _letters(data) if len(data) else data
            if len(data):
                plain = (letters >= 97) & (letters <= 122)
                has = np.bincount(np.repeat(np.arange(n), np.diff(offsets))[plain], minlength=n) > 0
                for i in np.flatnonzero(~has):
                    has[i] = any(map(str.isalpha, data[offsets[i] : offsets[i + 1]].tobytes().decode("utf-8", "replace")))
                for bucket, row in _buckets(letters, offsets):
                    count += np.bincount(row, minlength=n)
                    for k in range(len(bias)):
                        sums[:, k] += np.bincount(row, weights=logits[k][bucket], minlength=n)
            else:
                has = np.zeros(n, bool)
            has &= len(bias) > 0
            if len(bias):
                p = _softmax((sums / np.maximum(count, 1)[:, None] + bias) / temperature)
                pick, score = p.argmax(1), np.minimum(p.max(1), 1.0)
            else:
                pick, score = np.zeros(n, int), np.zeros(n)
            pick, score = np.where(has, pick, len(langs) - 1), np.where(has, score, 0.0)
            at = b.schema.get_field_index(_RAW)
            cols = [b.column(i) for i in range(b.num_columns) if i != at]
            cols += [pa.array(langs[pick], pa.string()), pa.array(score), pa.array(score < under)]
            yield pa.RecordBatch.from_arrays(cols, [*[c for c in b.schema.names if c != _RAW], "lang_pred", "score", "rejected"])

    return keep.withColumn(_RAW, utf8("text")).mapInArrow(run, schema)


def held_out(id_col: str = "doc_id", modulus: int = 4, rest: int = 2) -> F.Column:
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % modulus == rest


def op8_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every document, learnt from those whose remainder is not 2."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit(docs.where(~held_out()).select("text", "lang"))
    marked = docs.select("doc_id", held_out().alias("held_out"), "text")
    return predict(marked, model).select("doc_id", "held_out", "lang_pred", "score", "rejected")
