"""Raw captures: append-only text, a line `<ns> <hex byte> ...` per packet, `# key value` headers, a `# end ...` trailer.

`spark.read.format("capture")` reads complete lines; `spark.readStream.format("capture")` follows one growing file by byte offset. A line counts only once
its line feed is there, however little of it has been seen, and reading stops at the first torn line.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

#: byte_offset and byte_end: where a line begins, and where the next one does.
SCHEMA = "path string, byte_offset long, kind string, ns long, data binary, key string, value string, byte_end long"


def parse(path: str, chunk: bytes, base: int) -> tuple[list[tuple], int]:
    """Rows of the complete lines of a chunk that begins at byte `base`, and the offset after the last good one."""
    rows, at = [], 0
    while (end := chunk.find(b"\n", at)) >= 0:
        line = chunk[at:end].decode("ascii", "replace").strip()
        if line.startswith("#"):
            key, _, value = line[1:].strip().partition(" ")
            rows.append((path, base + at, "trailer" if key == "end" else "header", None, None, key, value.strip(), base + end + 1))
        elif line:
            stamp, *data = line.split()
            try:
                rows.append((path, base + at, "packet", int(stamp), bytes(int(b, 16) for b in data), None, None, base + end + 1))
                if not data:
                    raise ValueError("no bytes")
            except ValueError:
                if rows and rows[-1][1] == base + at:
                    rows.pop()
                break
        at = end + 1
    return rows, base + at


@dataclass
class Span(InputPartition):
    path: str
    start: int
    stop: int | None


class CaptureSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "capture"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return CaptureReader(self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:
        return CaptureStream(self.options)


def _rows(span: Span) -> Iterator[tuple]:
    with open(span.path, "rb") as f:
        f.seek(span.start)
        chunk = f.read() if span.stop is None else f.read(span.stop - span.start)
    yield from parse(span.path, chunk, span.start)[0]


class CaptureReader(DataSourceReader):
    """A partition per file; `paths` holds them, one per line, and `starts`, if given, the byte from which on each is read."""

    def __init__(self, options: dict):
        self.paths = [p for p in (options.get("paths") or options.get("path") or "").split("\n") if p]
        self.starts = [int(n) for n in (options.get("starts") or "").split("\n") if n] or [0] * len(self.paths)

    def partitions(self) -> list[Span]:
        return [Span(p, start, None) for p, start in zip(self.paths, self.starts, strict=True)]

    def read(self, partition: Span) -> Iterator[tuple]:
        return _rows(partition)


class CaptureStream(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.at = 0

    def initialOffset(self) -> dict:
        return {"byte": 0}

    def latestOffset(self) -> dict:
        with open(self.path, "rb") as f:
            f.seek(self.at)
            self.at = parse(self.path, f.read(), self.at)[1]
        return {"byte": self.at}

    def partitions(self, start: dict, end: dict) -> list[Span]:
        self.at = max(self.at, end["byte"])
        return [Span(self.path, start["byte"], end["byte"])] if end["byte"] > start["byte"] else []

    def read(self, partition: Span) -> Iterator[tuple]:
        return _rows(partition)

    def commit(self, end: dict) -> None:
        pass


def takes(rows: DataFrame) -> DataFrame:
    """path, header and trailer (maps), packets, first_ns, last_ns, seconds, complete, timing of the captures that rows were read from.

    complete: a trailer was read. timing: `hardware` if its trailer counts no packet without a stamp, `untrusted` if all are, `mixed` between, `unknown` without one.
    """
    fields = F.split("value", " ")
    end = F.when(F.col("kind") == "trailer", F.map_from_arrays(F.filter(fields, lambda x, i: i % 2 == 0), F.filter(fields, lambda x, i: i % 2 == 1)))
    found = rows.groupBy("path").agg(
        F.map_from_entries(F.array_distinct(F.collect_list(F.when(F.col("kind") == "header", F.struct("key", "value"))))).alias("header"), F.max_by(end, F.when(F.col("kind") == "trailer", F.col("byte_offset"))).alias("trailer"),
        F.count_if(F.col("kind") == "packet").alias("packets"), F.min("ns").alias("first_ns"), F.max("ns").alias("last_ns"),
    )
    unstamped = F.try_element_at("trailer", F.lit("ts_zero")).try_cast("long")
    timing = F.when(unstamped.isNull(), "unknown").when(unstamped == 0, "hardware").when(unstamped >= F.col("packets"), "untrusted").otherwise("mixed")
    return found.select("*", ((F.col("last_ns") - F.col("first_ns")) / 1e9).alias("seconds"), F.col("trailer").isNotNull().alias("complete"), timing.alias("timing"))


def wall_times(rows: DataFrame) -> DataFrame:
    """path, byte_offset, ns, unix_ns of packets, by the two anchors of their capture's header; null where it has none."""
    anchors = takes(rows).select("path", (F.try_element_at("header", F.lit("anchor_unix_ns")).try_cast("long") - F.try_element_at("header", F.lit("anchor_mach_ns")).try_cast("long")).alias("shift"))
    return rows.where("kind = 'packet'").join(anchors, "path").select("path", "byte_offset", "ns", (F.col("ns") + F.col("shift")).alias("unix_ns"))


def digest(path: str, size: int) -> str:
    """Digest of the first `size` bytes, read in pieces: a file whose consumed beginning has another one was rewritten, not appended to."""
    found = hashlib.sha256()
    with open(path, "rb") as f:
        while size > 0 and (piece := f.read(min(size, 1 << 20))):
            found.update(piece)
            size -= len(piece)
    return found.hexdigest()


def rewritten(path: str, consumed: int, known: str) -> str:
    """Why a file must be read again from its start, after `consumed` bytes with the digest `known` were read; empty if it was only appended to."""
    if os.path.getsize(path) < consumed:
        return "shrunk"
    return "" if digest(path, consumed) == known else "changed"


def register(spark) -> None:
    spark.dataSource.register(CaptureSource)
