"""Lines of files that grow, as a stream: a data source of our own.

Spark's file stream takes whole files once.  This one keeps a byte offset for each
file of a folder, reads whole lines from there on, and starts over when a file has
become shorter.  The folder must be seen by the driver and by all executors.  Compressed
files can't be followed; read them with logs.raw_lines.
"""

from __future__ import annotations

import glob
import os
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

SCHEMA = "value string, file string, offset long"
#: Bytes of one task.
STEP = 32 << 20


class _Range(InputPartition):
    def __init__(self, path: str, start: int, end: int):
        self.path, self.start, self.end = path, start, end


class _Reader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.pattern = os.path.join(options["path"].removeprefix("file://"), options.get("pattern", "*.jsonl"))
        self.at_end = str(options.get("start_at_end", "false")).lower() == "true"

    def _ends(self) -> dict[str, int]:
        """Where the last whole line of each file ends."""
        out = {}
        for path in sorted(glob.glob(self.pattern)):
            if path.endswith(".gz"):
                continue
            with open(path, "rb") as f:
                at = f.seek(0, os.SEEK_END)
                while at > 0:
                    back = max(0, at - 65536)
                    f.seek(back)
                    cut = f.read(at - back).rfind(b"\n")
                    if cut >= 0:
                        at = back + cut + 1
                        break
                    at = back
                out[path] = at
        return out

    def initialOffset(self) -> dict:
        return self._ends() if self.at_end else {}

    def latestOffset(self) -> dict:
        return self._ends()

    def partitions(self, start: dict, end: dict) -> list[_Range]:
        out = []
        for path, upto in end.items():
            at = start.get(path, 0)
            at = 0 if upto < at else at  # the file is shorter than it was: it is read anew
            cuts = [at]
            while upto - cuts[-1] > STEP:
                cuts.append(self._next_line(path, cuts[-1] + STEP, upto))
            out += [_Range(path, a, b) for a, b in zip(cuts, [*cuts[1:], upto], strict=True) if b > a]
        return out or [_Range("", 0, 0)]

    @staticmethod
    def _next_line(path: str, at: int, upto: int) -> int:
        with open(path, "rb") as f:
            f.seek(at)
            f.readline()
            return min(f.tell(), upto)

    def read(self, partition: _Range) -> Iterator[tuple]:
        if not partition.path:
            return
        with open(partition.path, "rb") as f:
            f.seek(partition.start)
            while f.tell() < partition.end:
                at = f.tell()
                line = f.readline().rstrip(b"\r\n")
                if line.strip():
                    yield line.decode("utf-8", "replace"), partition.path, at

    def commit(self, end: dict) -> None:
        pass


class GrowingLines(DataSource):
    @classmethod
    def name(cls) -> str:
        return "growing_lines"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> _Reader:
        return _Reader(self.options)


def follow(spark: SparkSession, folder: str, pattern: str = "*.jsonl", start_at_end: bool = False) -> DataFrame:
    """(value, file, offset): lines that are and come in a folder's files."""
    spark.dataSource.register(GrowingLines)
    return spark.readStream.format("growing_lines").option("pattern", pattern).option("start_at_end", str(start_at_end).lower()).load(folder)


def kafka(spark: SparkSession, servers: str, topic: str, start: str = "latest") -> DataFrame:
    """(value, seq): a topic's messages; needs Spark's Kafka connector on the class path.  Offsets are the query's own, kept in its checkpoint."""
    raw = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic).option("startingOffsets", start).load()
    return raw.selectExpr("cast(value as string) as value", "partition", "offset as seq")


def from_rows(spark: SparkSession, rows: list[str], first: int = 1) -> DataFrame:
    """(seq, value): lines that are at hand, numbered in their order."""
    return spark.createDataFrame([(first + i, r) for i, r in enumerate(rows) if r.strip()], "seq long, value string")
