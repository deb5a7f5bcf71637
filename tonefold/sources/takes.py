"""Stored takes: tables of messages, roles, intervals and defects that grow by commits, all or nothing.

`df.write.format("takes")` and `df.writeStream.format("takes")` write in two phases. Each task stages its rows as Parquet files of its own, a file per table,
and tells the driver their names; when all tasks are through, one manifest that names the files is moved into place. Readers go by manifests alone, so rows of
a task or a job that fails are never seen; their files are deleted where that is still possible, and by `Store.sweep`. A commit has a name; one whose name is there already is not
made again, so a job or a micro-batch that is repeated doesn't double its rows. A store has one writer at a time.

`spark.read.format("takes").option("path", ...).option("table", ...)` reads a table, a partition per file. Paths are any that Arrow's file systems open on driver and executors.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceStreamArrowWriter, InputPartition, WriterCommitMessage

#: Columns of the tables. `run` counts the readings of a take from its start; `version` is that of the commit.
TABLES = {
    "messages": "seq long, ns long, kind string, note int, velocity int",
    "roles": "seq long, role string",
    "intervals": "note int, on_seq long, off_seq long, ns_on long, ns_off long, velocity_on int, velocity_off int, closure string",
    "defects": "seq long, cls string",
    "held": "note int, on_seq long, ns_on long, velocity_on int",
    "progress": "path string, byte_offset long, digest string, messages long, last_ns long, complete boolean, reason string",
}
KEYS = "take long, run long, version long"
_KINDS = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "boolean": pa.bool_()}


def columns(table: str) -> dict[str, pa.DataType]:
    return {name: _KINDS[kind] for name, kind in (c.split() for c in f"{KEYS}, {TABLES[table]}".split(", "))}


#: All columns of all tables, with the table's name: the rows that are written.
ENTRY = {"table": pa.string(), **{name: kind for table in TABLES for name, kind in columns(table).items()}}


def schema(fields: dict[str, pa.DataType]) -> str:
    back = {v: k for k, v in _KINDS.items()}
    return ", ".join(f"`{name}` {back[kind]}" for name, kind in fields.items())


@dataclass
class Staged(WriterCommitMessage):
    files: dict[str, list[str]] = field(default_factory=dict)


@dataclass
class File(InputPartition):
    path: str


class Store:
    """A store's folder: `staged` holds files, `commits` manifests."""

    def __init__(self, path: str):
        self.files, self.root = fs.FileSystem.from_uri(path if "://" in path else "file://" + path.removeprefix("file:"))

    def commits(self) -> dict[str, str]:
        """Manifests by the names of their commits, in order."""
        found = self.files.get_file_info(fs.FileSelector(f"{self.root}/commits", allow_not_found=True))
        names = sorted(f.base_name for f in found if f.base_name.endswith(".json"))
        return {n.removesuffix(".json").partition("-")[2]: f"{self.root}/commits/{n}" for n in names}

    def staged(self, table: str) -> list[str]:
        out = []
        for manifest in self.commits().values():
            with self.files.open_input_stream(manifest) as f:
                out += json.loads(f.read())["files"].get(table, [])
        return out

    def stage(self, batches: Iterator[pa.RecordBatch]) -> Staged:
        self.files.create_dir(f"{self.root}/staged", recursive=True)
        writers: dict[str, pq.ParquetWriter] = {}
        done = Staged()
        try:
            for batch in batches:
                rows = pa.Table.from_batches([batch])
                for table in rows["table"].unique().to_pylist():
                    kept = columns(table)
                    part = rows.filter(pc.equal(rows["table"], table)).select(list(kept)).cast(pa.schema(kept))
                    if table not in writers:
                        name = f"{self.root}/staged/{table}-{uuid.uuid4().hex}.parquet"
                        done.files[table] = [name]
                        writers[table] = pq.ParquetWriter(name, part.schema, filesystem=self.files)
                    writers[table].write_table(part)
            for writer in writers.values():
                writer.close()
        except BaseException:
            self.delete([done])
            raise
        return done

    def publish(self, name: str, messages: list[Staged | None]) -> None:
        known = self.commits()
        if name in known:
            self.delete(messages)
            return
        files: dict[str, list[str]] = {}
        for message in messages:
            for table, paths in (message.files if message else {}).items():
                files.setdefault(table, []).extend(paths)
        self.files.create_dir(f"{self.root}/commits", recursive=True)
        draft = f"{self.root}/commits/.{uuid.uuid4().hex}"
        with self.files.open_output_stream(draft) as f:
            f.write(json.dumps({"name": name, "files": files}).encode())
        self.files.move(draft, f"{self.root}/commits/{len(known):012d}-{name}.json")

    def sweep(self) -> int:
        """Deletes staged files that no commit names, as tasks that were killed leave them, and says how many. Not while someone writes."""
        named = {p for table in TABLES for p in self.staged(table)}
        found = self.files.get_file_info(fs.FileSelector(f"{self.root}/staged", allow_not_found=True))
        lost = [f.path for f in found if f.is_file and f.path not in named]
        for path in lost:
            self.files.delete_file(path)
        return len(lost)

    def delete(self, messages: list[Staged | None]) -> None:
        for path in [p for m in messages if m for paths in m.files.values() for p in paths]:
            try:
                self.files.delete_file(path)
            except OSError:
                pass  # never seen by a reader, whether it goes or not


class TakesSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "takes"

    def schema(self) -> str:
        return schema(columns(self.options.get("table", "messages")))

    def reader(self, schema) -> DataSourceReader:
        return TakesReader(self.options["path"], self.options.get("table", "messages"))

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        if overwrite:
            raise ValueError("stored takes are appended to; a take that is read again gets another run")
        return TakesWriter(self.options["path"], self.options.get("commit") or uuid.uuid4().hex)

    def streamWriter(self, schema, overwrite: bool) -> DataSourceStreamArrowWriter:
        return TakesStreamWriter(self.options["path"], self.options.get("commit") or "stream")


class TakesReader(DataSourceReader):
    def __init__(self, path: str, table: str):
        self.path, self.table = path, table

    def partitions(self) -> list[File]:
        return [File(p) for p in Store(self.path).staged(self.table)] or [File("")]  # Spark asks for one at least

    def read(self, partition: File) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        with Store(self.path).files.open_input_file(partition.path) as f:
            yield from pq.ParquetFile(f).iter_batches()


class TakesWriter(DataSourceArrowWriter):
    def __init__(self, path: str, commit: str):
        self.path, self.name = path, commit

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Staged:
        return Store(self.path).stage(iterator)

    def commit(self, messages: list[Staged | None]) -> None:
        Store(self.path).publish(self.name, messages)

    def abort(self, messages: list[Staged | None]) -> None:
        Store(self.path).delete(messages)


class TakesStreamWriter(DataSourceStreamArrowWriter):
    """A micro-batch is a commit, named by its number."""

    def __init__(self, path: str, commit: str):
        self.path, self.name = path, commit

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Staged:
        return Store(self.path).stage(iterator)

    def commit(self, messages: list[Staged | None], batchId: int) -> None:
        Store(self.path).publish(f"{self.name}-{batchId}", messages)

    def abort(self, messages: list[Staged | None], batchId: int) -> None:
        Store(self.path).delete(messages)


def register(spark) -> None:
    spark.dataSource.register(TakesSource)
