"""Helpers shared by the training-data operators.

Words are everywhere the maximal runs of bytes other than space and 0x09-0x0D
of the UTF-8 text, which is exactly what ``bytes.split()`` cuts at.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one vectorised step works on; bounds a worker's memory.
STEP_BYTES = 2 << 20

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def scratch(spark: SparkSession) -> str:
    """A fresh path in the folder that driver and executors share; a folder of our own only on one machine, and where none is named."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        top = spark.sparkContext.getCheckpointDir() if hasattr(spark.sparkContext, "getCheckpointDir") else None
    if not top:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        top = "file://" + tempfile.mkdtemp(prefix="lineagram-")
        spark.sparkContext.setCheckpointDir(top)
    return f"{top.rstrip('/')}/tables/{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """Cuts lineage: writes the rows as a Parquet table in the shared folder and reads it again."""
    spark, path = df.sparkSession, scratch(df.sparkSession)
    schema = df.schema
    df.write.parquet(path)
    return spark.read.schema(schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    """The session's shuffle width, which the cluster sets by the input's size."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def utf8(col: str) -> F.Column:
    """The column's bytes; null counts as empty."""
    return F.coalesce(F.col(col).cast("string"), F.lit("")).cast("binary")


def buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a binary column without a copy where Arrow allows it."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.binary())
    wide = pa.types.is_large_binary(column.type)
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, off, data = column.buffers()
    kind = np.int64 if wide else np.int32
    offsets = np.frombuffer(off, dtype=kind)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def pieces(offsets: np.ndarray, step: int = STEP_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges (lo, hi) of about ``step`` bytes each; a longer row stands alone."""
    n, lo = len(offsets) - 1, 0
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + step, "right")) - 1
        hi = min(n, max(hi, lo + 1))
        yield lo, hi
        lo = hi


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first) of all words; document d has words first[d] to first[d + 1]."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    word = ~_SPACE[data]
    begins, stops = word.copy(), word.copy()
    begins[1:] &= ~word[:-1]
    stops[:-1] &= ~word[1:]
    cuts = offsets[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(data))]
    begins[cuts] = word[cuts]
    stops[cuts - 1] = word[cuts - 1]
    starts = np.flatnonzero(begins)
    return starts, np.flatnonzero(stops) + 1, np.searchsorted(starts, offsets)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (shift, multiply), in place on unsigned integers."""
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


_P = np.uint64(0x9E3779B97F4A7C15)
_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * _P)
_POWERS = np.ones(1, np.uint64)


def _powers(n: int) -> np.ndarray:
    global _POWERS
    if len(_POWERS) < n:
        _POWERS = np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(max(n, 256), _P, np.uint64))])
    return _POWERS


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the words' bytes: a polynomial over mixed bytes, finalised with the length."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    sizes = ends - starts
    total = int(sizes.sum())
    # position inside its word, for the word bytes alone
    at = np.repeat(starts - (np.cumsum(sizes) - sizes), sizes)
    at += np.arange(total)
    inside = at - np.repeat(starts, sizes)
    terms = _BYTE[data[at]] * _powers(int(sizes.max()))[inside]
    out = np.add.reduceat(terms, np.cumsum(sizes) - sizes)
    return mix(out + sizes.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


_INVERSE = np.uint64(pow(int(_P), -1, 1 << 64))
_WORD_BYTE = np.where(_SPACE, np.uint64(0), _BYTE)
_RAISED = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """word_hashes of all words of the data, as word_spans gives them: powers run on over the data and are divided out at each word's start."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    n = len(data)
    if len(_RAISED[0]) < min(n, 2 * STEP_BYTES):
        for i, x in enumerate((_P, _INVERSE)):
            _RAISED[i] = np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(min(n, 2 * STEP_BYTES), x, np.uint64))])
    if len(_RAISED[0]) < n:
        return word_hashes(data, starts, ends)  # a text this long stands alone
    terms = _WORD_BYTE[data]
    terms *= _RAISED[0][:n]
    out = np.add.reduceat(terms, starts)
    out *= _RAISED[1][starts]
    return mix(out + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def rolling(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of every k consecutive entries, as a polynomial built by doubling; the caller drops windows that cross a document's end."""
    if len(h) < k:
        return np.zeros(0, np.uint64)
    out, width, power, have = h, 1, _P, None
    have_width = 0
    rest = k
    while True:
        if rest & 1:
            if have is None:
                have, have_width = out, width
            else:
                n = len(h) - (have_width + width) + 1
                have = have[:n] * power + out[have_width : have_width + n]
                have_width += width
        rest >>= 1
        if not rest:
            break
        n = len(h) - 2 * width + 1
        out = out[:n] * power + out[width : width + n]
        power = np.uint64(int(power) ** 2 & (1 << 64) - 1)
        width *= 2
    return mix(have.copy() if have is h else have)
