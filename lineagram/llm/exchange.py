"""Looking up corpus-wide facts about hashes, a chunk of documents at a time.

Documents are dealt into chunks by a function of their own columns, so a chunk is
the same whenever it is computed.  A chunk asks about its distinct hashes; the
questions go, as one packed row for each part of the hash space, to the part that
gathers the same hashes from all chunks, and the answers come back to the chunk.
A hash that a third of all documents hold is one entry for each chunk, not one
for each document, so no key makes a task large, and no row is dropped for that.

Numbers of chunks and parts follow spark.sql.shuffle.partitions, the session's
setting for the input's size.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lineagram.llm.common import partitions, utf8

CHUNK, RAW = "__chunk", "__utf8"
ASK = "__part int, __chunk int, body binary"
ANSWER = "__chunk int, __part int, body binary"


def chunk_count(docs: DataFrame) -> int:
    """Two chunks a shuffle partition, which halves what a Python worker holds at once."""
    return 2 * partitions(docs.sparkSession)


def part_count(docs: DataFrame) -> int:
    return partitions(docs.sparkSession)


def chunked(docs: DataFrame, columns: list[str], text_col: str = "text", chunks: int | None = None, key: F.Column | None = None) -> DataFrame:
    """docs' columns, the text's bytes and the chunk, which is the key given or a hash of id and text."""
    n = chunks or chunk_count(docs)
    chunk = F.pmod(F.xxhash64("doc_id", text_col), F.lit(n)).cast("int") if key is None else key
    return docs.select(*columns, utf8(text_col).alias(RAW), chunk.alias(CHUNK))


def pack(sorted_values: np.ndarray) -> bytes:
    """Sorted unsigned 64-bit values by byte plane, so that the planes that hardly change take little room when compressed."""
    planes = np.ascontiguousarray(sorted_values.astype("<u8", copy=False)).view(np.uint8).reshape(-1, 8)
    return planes.T.tobytes()


def unpack(body: bytes) -> np.ndarray:
    planes = np.frombuffer(body, np.uint8).reshape(8, -1)
    return np.ascontiguousarray(planes.T).view("<u8").ravel()


def planes32(values: np.ndarray) -> bytes:
    return np.ascontiguousarray(values.astype("<u4")).view(np.uint8).reshape(-1, 4).T.tobytes()


def from_planes32(body: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(body, np.uint8).reshape(4, -1).T).view("<u4").ravel()


def cuts(sorted_values: np.ndarray, parts: int) -> np.ndarray:
    """Where each part of the hash space begins in sorted hashes; parts + 1 entries."""
    edges = np.array([(i << 64) // parts for i in range(1, parts)], dtype=np.uint64)
    return np.concatenate([[0], np.searchsorted(sorted_values, edges), [len(sorted_values)]])


def asks(chunk: int, bodies: list[tuple[int, bytes]]) -> pa.Table:
    return pa.table({"__part": pa.array([p for p, _ in bodies], pa.int32()), "__chunk": pa.array([chunk] * len(bodies), pa.int32()), "body": pa.array([b for _, b in bodies], pa.binary())})


def answers(part: int, bodies: list[tuple[int, bytes]]) -> pa.Table:
    return pa.table({"__chunk": pa.array([c for c, _ in bodies], pa.int32()), "__part": pa.array([part] * len(bodies), pa.int32()), "body": pa.array([b for _, b in bodies], pa.binary())})


def ask(docs: DataFrame, question: Callable[[int, pa.Table], list[tuple[int, bytes]]]) -> DataFrame:
    """question(chunk, its documents) gives (part, body) pairs."""

    def run(table: pa.Table) -> pa.Table:
        chunk = table[CHUNK][0].as_py()
        return asks(chunk, question(chunk, table))

    return docs.groupBy(CHUNK).applyInArrow(run, ASK)


def reply(questions: DataFrame, combine: Callable[[int, list[tuple[int, bytes]]], list[tuple[int, bytes]]]) -> DataFrame:
    """combine(part, [(chunk, body)]) gives (chunk, body) pairs."""

    def run(table: pa.Table) -> pa.Table:
        part = table["__part"][0].as_py()
        table = table.sort_by("__chunk")
        return answers(part, combine(part, [(c.as_py(), b.as_py()) for c, b in zip(table["__chunk"], table["body"], strict=True)]))

    return questions.groupBy("__part").applyInArrow(run, ANSWER)


def finish(docs: DataFrame, answered: DataFrame, use: Callable[[pa.Table, list[tuple[int, bytes]]], pa.Table], schema) -> DataFrame:
    """use(a chunk's documents, its (part, body) answers in the order of parts) gives rows of the schema."""
    def run(table: pa.Table, got: pa.Table) -> pa.Table:
        bodies = sorted(((p.as_py(), b.as_py()) for p, b in zip(got["__part"], got["body"], strict=True)), key=lambda x: x[0]) if got.num_rows else []
        return use(table, bodies)

    return docs.groupBy(CHUNK).cogroup(answered.groupBy(CHUNK)).applyInArrow(run, schema)
