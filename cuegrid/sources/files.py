"""Subtitle files as a data source: `spark.read.format("timed_text")`, `readStream` and `write`.

Reading gives one row for each file: path (below the folder), format, size, modified,
content and reason, which tells why a file can't be scanned (its content is null then).
`subtitles.scan` makes cues of it.  Files are listed once, filtered by what the query
asks of path and format, and packed into partitions by size, small files together.  A stream takes files in the order
of their time of change and path; one that appears with an older time than what was
taken already is not seen.

Writing takes rows of track_id, kind, seq and block, those of a file together and in
order, as `arranged` has them.  A task writes one file after the other, whatever their
number, into a folder of its own; when all tasks are done, the driver gives the files
their names, else it deletes the folder.  A file that two tasks claim fails the write.

Options: path; recursive (true), partitionBytes and partitionFiles for reading; layouts
for writing: JSON, for each kind its head, separator, tail and whether blocks are
numbered.  Folders are reached through Arrow's file systems (local and mounted ones,
HDFS, S3, GCS), on driver and executors alike.
"""

from __future__ import annotations

import json
import os
import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import datetime, timezone

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceReader,
    DataSourceStreamReader,
    DataSourceWriter,
    EqualTo,
    In,
    InputPartition,
    StringContains,
    StringEndsWith,
    StringStartsWith,
    WriterCommitMessage,
)

from cuegrid.sources.subtitles import MAX_BYTES

NAME = "timed_text"
READ = "path string, format string, size long, modified timestamp, content string, reason string"
WRITE = "track_id string, kind string, seq long, block string"


def reach(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path, and the path there."""
    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else os.path.abspath(path))


def reachable(path: str) -> bool:
    try:
        reach(path)
    except Exception:  # noqa: BLE001  whatever the file system lacks
        return False
    return True


def format_of(path: str) -> str:
    """By the name's extension: vtt, ass (also ssa), else srt."""
    ext = path.rsplit("/", 1)[-1].rpartition(".")[2].lower()
    return {"vtt": "vtt", "ass": "ass", "ssa": "ass"}.get(ext, "srt")


def decoded(raw: bytes) -> str:
    """UTF-8 if it is that, else Latin-1."""
    try:
        return raw.decode("utf-8")
    except UnicodeDecodeError:
        return raw.decode("latin-1")


@dataclass(frozen=True)
class File:
    path: str
    size: int
    modified: int  # nanoseconds

    @property
    def place(self) -> tuple[int, str]:
        return self.modified, self.path


@dataclass
class Files(InputPartition):
    files: list[File]


def listed(root: str, recursive: bool = True) -> list[File]:
    """The files of a folder by path; hidden ones (a name that starts with a dot or underscore) aren't there."""
    system, top = reach(root)
    top = top.rstrip("/")
    found = []
    for info in system.get_file_info(fs.FileSelector(top, recursive=recursive)):
        below = info.path[len(top) + 1 :]
        if info.is_file and not any(part[0] in "._" for part in below.split("/")):
            found.append(File(below, info.size, int(info.mtime_ns or 0)))
    return sorted(found, key=lambda f: f.path)


def packed(files: list[File], most_bytes: int, most_files: int) -> list[Files]:
    """Partitions of at most so many bytes and files, one file at least."""
    out: list[Files] = []
    held = 0
    for f in files:
        if not out or held + f.size > most_bytes or len(out[-1].files) >= most_files:
            out.append(Files([]))
            held = 0
        out[-1].files.append(f)
        held += f.size
    return out


def rows_of(root: str, files: list[File]) -> Iterator[tuple]:
    system, top = reach(root)
    for f in files:
        content, reason = None, "empty" if f.size == 0 else "too large" if f.size > MAX_BYTES else None
        if reason is None:
            with system.open_input_stream(f"{top.rstrip('/')}/{f.path}") as stream:
                content = decoded(stream.read())
            if not content.strip(" \t\n\x0b\f\r"):
                content, reason = None, "blank"
        yield f.path, format_of(f.path), f.size, datetime.fromtimestamp(f.modified / 1e9, timezone.utc), content, reason


class _Asked:
    """Options, and the filters on path and format that files are chosen by."""

    def __init__(self, options: dict):
        self.root = options["path"]
        self.recursive = options.get("recursive", "true").lower() == "true"
        self.most_bytes = int(options.get("partitionbytes", 64 << 20))
        self.most_files = int(options.get("partitionfiles", 10_000))
        self.filters: list = []

    def takes(self, f) -> bool:
        return isinstance(f, (EqualTo, In, StringStartsWith, StringEndsWith, StringContains)) and f.attribute in (("path",), ("format",))

    def passes(self, file: File) -> bool:
        for f in self.filters:
            have = file.path if f.attribute == ("path",) else format_of(file.path)
            good = {
                EqualTo: lambda: have == f.value,
                In: lambda: have in f.value,
                StringStartsWith: lambda: have.startswith(f.value),
                StringEndsWith: lambda: have.endswith(f.value),
                StringContains: lambda: f.value in have,
            }[type(f)]()
            if not good:
                return False
        return True

    def files(self) -> list[File]:
        return [f for f in listed(self.root, self.recursive) if self.passes(f)]


class Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.asked = _Asked(options)

    def pushFilters(self, filters):
        for f in filters:
            if self.asked.takes(f):
                self.asked.filters.append(f)
            else:
                yield f

    def partitions(self):
        return packed(self.asked.files(), self.asked.most_bytes, self.asked.most_files) or [Files([])]

    def read(self, partition):
        yield from rows_of(self.asked.root, partition.files)


class StreamReader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.asked = _Asked(options)

    def initialOffset(self):
        return {"modified": -1, "path": ""}

    def latestOffset(self):
        last = max((f.place for f in self.asked.files()), default=(-1, ""))
        return {"modified": last[0], "path": last[1]}

    def partitions(self, start, end):
        low, high = ((o["modified"], o["path"]) for o in (start, end))
        new = [f for f in self.asked.files() if low < f.place <= high]
        return packed(new, self.asked.most_bytes, self.asked.most_files) or [Files([])]

    def read(self, partition):
        yield from rows_of(self.asked.root, partition.files)


@dataclass
class Written(WriterCommitMessage):
    folder: str
    files: list[tuple[str, str]]  # its name there, and below the path


def file_name(track_id: str, kind: str) -> str:
    """A file below the path: its kind's folder, the track's own folders, the kind as extension unless the name has it."""
    if track_id is None or any(p in ("", ".", "..") for p in track_id.split("/")):
        raise ValueError(f"a track of this name can't be a file: {track_id!r}")
    return f"{kind}/{track_id}" if track_id.lower().endswith(f".{kind}") else f"{kind}/{track_id}.{kind}"


class Writer(DataSourceWriter):
    def __init__(self, options: dict, overwrite: bool):
        self.root, self.overwrite = options["path"].rstrip("/"), overwrite
        self.layouts = json.loads(options["layouts"])
        self.drafts = f"_drafts-{uuid.uuid4().hex}"

    def write(self, iterator):
        system, top = reach(self.root)
        folder = f"{self.drafts}/{uuid.uuid4().hex}"
        system.create_dir(f"{top}/{folder}", recursive=True)
        files, now, stream, count, layout = [], None, None, 0, {}
        done = set()
        for row in iterator:
            at = (row["track_id"], row["kind"])
            if at != now:
                if stream:
                    stream.write(layout["tail"].encode())
                    stream.close()
                name = file_name(*at)
                if name in done:
                    raise ValueError(f"the rows of {name} are not together")
                done.add(name)
                now, count, layout = at, 0, self.layouts[row["kind"]]
                stream = system.open_output_stream(f"{top}/{folder}/{len(files)}")
                files.append((str(len(files)), name))
                stream.write(layout["head"].encode())
            count += 1
            number = f"{count}\n" if layout["numbered"] else ""
            stream.write(((layout["sep"] if count > 1 else "") + number + (row["block"] or "")).encode())
        if stream:
            stream.write(layout["tail"].encode())
            stream.close()
        return Written(folder, files)

    def commit(self, messages):
        system, top = reach(self.root)
        named = [name for m in messages if m for _, name in m.files]
        if len(named) != len(set(named)):
            self.abort(messages)
            twice = [n for n, times in Counter(named).items() if times > 1]
            raise ValueError(f"two tasks wrote {', '.join(sorted(twice)[:3])}")
        old = {f"{kind}/{f.path}" for kind in self.layouts for f in self._there(f"{self.root}/{kind}")} if self.overwrite else set()
        for folder in {n.rsplit("/", 1)[0] for n in named}:
            system.create_dir(f"{top}/{folder}", recursive=True)
        for m in messages:
            for draft, name in m.files if m else []:
                system.move(f"{top}/{m.folder}/{draft}", f"{top}/{name}")
        for name in old - set(named):
            system.delete_file(f"{top}/{name}")
        self._clean(system, top)

    def _there(self, folder: str) -> list[File]:
        system, at = reach(folder)
        return listed(folder) if system.get_file_info(at).type == fs.FileType.Directory else []

    def abort(self, messages):
        self._clean(*reach(self.root))

    def _clean(self, system: fs.FileSystem, top: str) -> None:
        if system.get_file_info(f"{top}/{self.drafts}").type == fs.FileType.Directory:
            system.delete_dir(f"{top}/{self.drafts}")


class TimedText(DataSource):
    @classmethod
    def name(cls):
        return NAME

    def schema(self):
        return READ

    def reader(self, schema):
        return Reader(dict(self.options))

    def streamReader(self, schema):
        return StreamReader(dict(self.options))

    def writer(self, schema, overwrite):
        return Writer(dict(self.options), overwrite)


def register(spark: SparkSession) -> None:
    """Makes the format known to the session, with filters pushed to it (Spark refuses a reader that takes filters where that is off)."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(TimedText)


def arranged(blocks: DataFrame) -> DataFrame:
    """Rows of a file together and in order; files over all tasks."""
    rows = blocks.select("track_id", "kind", F.col("seq").cast("long").alias("seq"), "block")
    return rows.repartition("track_id", "kind").sortWithinPartitions("track_id", "kind", "seq")


def save(blocks: DataFrame, path: str, layouts: dict[str, dict], overwrite: bool = False) -> None:
    """Writes files of track_id, kind, seq and block; overwrite: files of these kinds that aren't written go."""
    register(blocks.sparkSession)
    writer = arranged(blocks).write.format(NAME).mode("overwrite" if overwrite else "append")
    writer.option("path", path).option("layouts", json.dumps(layouts)).save()
