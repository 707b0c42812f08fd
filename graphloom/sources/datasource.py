"""A folder of notes as a Spark data source: spark.read.format("notes"), df.write.format("notes").

The folder must be one that the driver and all executors see at the same place, such
as a mounted store; read_notes reads any store that Spark itself can open, but
knows no creation times.  Names and times are listed on the driver, as Spark's own file
sources do; texts are read by the tasks.  What a query asks of path and modified is
settled on that listing, before any text is read, and shows in the scan.
"""

from __future__ import annotations

import os
import shutil
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from pathlib import Path, PurePosixPath

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual, StringContains, StringEndsWith, StringStartsWith, WriterCommitMessage
from pyspark.sql.types import StructType

SCHEMA = "path string, content string, created long, modified long"
#: What a task reads, at most, but for a single larger note.
TASK_FILES, TASK_BYTES = 1_000, 32 << 20
#: Where a write gathers before it is complete; no reader looks into it.
_PARTIAL = ".notes-partial-"
_COMPARE = {EqualTo: lambda a, b: a == b, GreaterThan: lambda a, b: a > b, GreaterThanOrEqual: lambda a, b: a >= b, LessThan: lambda a, b: a < b, LessThanOrEqual: lambda a, b: a <= b, In: lambda a, b: a in b, StringStartsWith: str.startswith, StringEndsWith: str.endswith, StringContains: lambda a, b: b in a}


def created_ms(stat: os.stat_result) -> int:
    """When a file was made: its birth, where the system keeps that, else the earliest time that it has."""
    return int(1000 * getattr(stat, "st_birthtime", min(stat.st_ctime, stat.st_mtime)))


@dataclass
class Files(InputPartition):
    """Notes of one folder that a task reads: path, created, modified of each."""

    files: list[tuple[str, int, int]]


class NotesReader(DataSourceReader):
    def __init__(self, options: dict):
        self.root = options.get("path", "")
        if not self.root:
            raise ValueError("a folder is needed: load(folder)")
        self.root = self.root.removeprefix("file://")
        self.below = options.get("folder", "").strip("/")
        self.most = int(options.get("maxbytes", 1 << 62))
        self.content = options.get("content", "true").lower() == "true"
        self.asked: list[tuple[str, type, object]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:  # noqa: N802
        for f in filters:
            value = getattr(f, "value", None)
            if isinstance(f, IsNotNull) and f.attribute in (("path",), ("created",), ("modified",)):
                continue  # they never are null
            if type(f) in _COMPARE and f.attribute in (("path",), ("modified",), ("created",)) and value is not None and (type(f) is not In or None not in value):
                self.asked.append((f.attribute[0], type(f), value))
            else:
                yield f

    def wanted(self, path: str, created: int, modified: int) -> bool:
        own = {"path": path, "created": created, "modified": modified}
        return all(_COMPARE[kind](own[name], value) for name, kind, value in self.asked)

    def enters(self, folder: str) -> bool:
        """Whether paths in a folder can be asked for at all."""
        ahead = folder + "/"
        return all(value.startswith(ahead) or kind is StringStartsWith and ahead.startswith(value) for name, kind, value in self.asked if name == "path" and kind in (StringStartsWith, EqualTo))

    def partitions(self) -> list[Files]:
        out, top = [], Path(self.root, self.below)
        for folder, inner, names in os.walk(top):
            at = PurePosixPath(os.path.relpath(folder, self.root)).as_posix()
            at = "" if at == "." else at
            inner[:] = sorted(d for d in inner if not d.startswith(_PARTIAL) and self.enters(f"{at}/{d}".lstrip("/")))
            part, size = [], 0
            for name in sorted(n for n in names if n.lower().endswith(".md")):
                try:
                    stat = os.stat(os.path.join(folder, name))
                except OSError:
                    continue  # it went meanwhile
                row = (f"{at}/{name}".lstrip("/"), created_ms(stat), int(1000 * stat.st_mtime))
                if stat.st_size > self.most or not self.wanted(*row):
                    continue
                if part and (len(part) >= TASK_FILES or size + stat.st_size > TASK_BYTES):
                    out.append(Files(part))
                    part, size = [], 0
                part.append(row)
                size += stat.st_size
            if part:
                out.append(Files(part))
        return out or [Files([])]

    def read(self, partition: Files) -> Iterator[tuple]:
        for path, created, modified in partition.files:
            try:
                yield path, Path(self.root, path).read_text("utf-8", "replace") if self.content else None, created, modified
            except OSError:
                continue  # a note that can't be read is left out


@dataclass
class Written(WriterCommitMessage):
    paths: list[tuple[str, str]]


class NotesWriter(DataSourceWriter):
    """Notes (path, content) as files: folders are made, and a note that is there already is an error, unless mode is overwrite.

    Tasks write into a hidden folder beside the notes; only when all have ended do the
    files move to their places, so a task that runs twice or fails leaves nothing behind.
    """

    def __init__(self, options: dict, schema: StructType, overwrite: bool):
        self.root, self.overwrite = options.get("path", "").removeprefix("file://"), overwrite
        self.partial = f"{_PARTIAL}{uuid.uuid4().hex}"
        self.at = [schema.fieldNames().index(c) for c in ("path", "content")]

    def write(self, iterator: Iterator) -> Written:
        done = []
        for row in iterator:
            path, content = row[self.at[0]], row[self.at[1]]
            parts = PurePosixPath(path or "").parts
            if not parts or parts[0] == "/" or ".." in parts:
                raise ValueError(f"not a path below the folder: {path!r}")
            part = Path(self.root, self.partial, uuid.uuid4().hex)
            part.parent.mkdir(parents=True, exist_ok=True)
            part.write_text(content or "", "utf-8")
            done.append((str(part), PurePosixPath(path).as_posix()))
        return Written(done)

    def commit(self, messages: list[Written | None]) -> None:
        every = [x for m in messages if m for x in m.paths]
        try:
            named = [p for _, p in every]
            twice = sorted({p for p in named if named.count(p) > 1}) if len(set(named)) < len(named) else []
            there = sorted(p for p in named if Path(self.root, p).exists()) if not self.overwrite else []
            if twice or there:
                raise FileExistsError(f"notes that are there already, or twice: {', '.join((twice + there)[:10])}")
            for part, path in every:
                target = Path(self.root, path)
                target.parent.mkdir(parents=True, exist_ok=True)
                if self.overwrite:
                    os.replace(part, target)
                else:
                    os.link(part, target)  # fails if one came meanwhile
        finally:
            shutil.rmtree(Path(self.root, self.partial), ignore_errors=True)

    def abort(self, messages: list[Written | None]) -> None:
        shutil.rmtree(Path(self.root, self.partial), ignore_errors=True)


class NotesSource(DataSource):
    """Options: path, folder (only what is below it), maxBytes, content (false: names and times only)."""

    @classmethod
    def name(cls) -> str:
        return "notes"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> NotesReader:
        return NotesReader({k.lower(): v for k, v in self.options.items()})

    def writer(self, schema: StructType, overwrite: bool) -> NotesWriter:
        return NotesWriter({k.lower(): v for k, v in self.options.items()}, schema, overwrite)


def register(spark: SparkSession) -> None:
    """Make the source known to a session, and let it see what queries ask for."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(NotesSource)
