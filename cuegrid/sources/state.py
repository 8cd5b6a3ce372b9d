"""Versioned state tables: what a run leaves for later ones (scenes, answers, memory).

A table is a folder.  `data/` holds folders of Parquet files, each written once by one
write and never changed; `versions/` holds one small manifest for each version, the
list of those folders in order.  A write first lays down its files, then publishes the
next manifest under a name that only one writer can take; one that finds it taken reads
the newer manifest and publishes after it, so no write is lost, and files of a run that
was killed are in no manifest.  Reading takes one manifest and, for each key, the row of
the last folder that has it; a row that is marked as deleted hides the key.

Compaction writes the state of one version as one folder; folders published meanwhile
stay behind it.  `vacuum` deletes folders that none of the last versions names.

The name is taken by a hard link on a local file system and elsewhere by a rename that
fails where the name is there, as HDFS has it; a store without such a rename needs one
writer at a time.

Defined results: rows that share a key within one write count once, the largest by its
other columns; null keys are keys; an empty write publishes nothing; columns beyond the
schema are ignored, missing ones are null.
"""

from __future__ import annotations

import json
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType, _parse_datatype_string

def scratch(spark: SparkSession) -> str:
    """A new folder's path in the one that driver and executors share (spark.checkpoint.dir); a local master without it gets a temporary one.  It goes when the application ends."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = tempfile.mkdtemp(prefix="cuegrid-")
    path = f"{at}/scratch-{uuid.uuid4().hex}"
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(folder)
    return path


#: Folders in a manifest from which on a write compacts.
COMPACT_AT = 16


class StateTable:
    def __init__(self, spark: SparkSession, path: str, schema: str | StructType, keys: list[str]):
        self.spark, self.path, self.keys = spark, path.rstrip("/"), keys
        self.schema = _parse_datatype_string(schema) if isinstance(schema, str) else schema
        if missing := [k for k in keys if k not in self.schema.names]:
            raise ValueError(f"keys outside the schema: {missing}")

    # files

    def _at(self, name: str = ""):
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path + (f"/{name}" if name else ""))
        return at, at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _names(self, folder: str) -> list[str]:
        at, files = self._at(folder)
        return sorted(f.getPath().getName() for f in files.listStatus(at)) if files.exists(at) else []

    def _load(self, name: str) -> str:
        at, files = self._at(name)
        stream = files.open(at)
        try:
            return self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def _publish(self, version: int, folders: list[str]) -> bool:
        """Whether this writer got the version."""
        jvm = self.spark.sparkContext._jvm
        draft, files = self._at(f"drafts/{uuid.uuid4().hex}.json")
        stream = files.create(draft, False)
        try:
            stream.write(bytearray(json.dumps({"version": version, "folders": folders}).encode()))
        finally:
            stream.close()
        final, _ = self._at(f"versions/{version:012d}.json")
        files.mkdirs(final.getParent())
        try:
            if files.getScheme() == "file":
                path = lambda p: jvm.java.nio.file.Path.of(files.makeQualified(p).toUri())
                jvm.java.nio.file.Files.createLink(path(final), path(draft))
                return True
            return bool(files.rename(draft, final))
        except Exception as e:  # noqa: BLE001  whether the name was taken is asked of the file system
            if files.exists(final):
                return False
            raise e
        finally:
            files.delete(draft, False)

    # versions

    def version(self) -> int:
        """The newest version; 0 before the first write."""
        names = [n for n in self._names("versions") if n.endswith(".json") and not n.startswith(".")]
        return int(names[-1].split(".")[0]) if names else 0

    def folders(self, version: int | None = None) -> list[str]:
        version = self.version() if version is None else version
        return json.loads(self._load(f"versions/{version:012d}.json"))["folders"] if version else []

    def _commit(self, change: Callable[[list[str]], list[str]]) -> int:
        while True:
            before = self.version()
            if self._publish(before + 1, change(self.folders(before))):
                return before + 1

    # rows

    def _lay(self, rows: DataFrame, gone: bool) -> str | None:
        """Writes the rows as a new folder and returns its name; None if there are none."""
        name = uuid.uuid4().hex
        have = [F.col(f.name).cast(f.dataType).alias(f.name) if f.name in rows.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in self.schema]
        rest = [c for c in self.schema.names if c not in self.keys]
        one = rows.select(*have)
        if rest:
            one = one.groupBy(*self.keys).agg(F.max(F.struct(*rest)).alias("_rest")).select(*self.keys, "_rest.*")
        else:
            one = one.distinct()
        one.select(*self.schema.names, F.lit(gone).alias("_gone")).write.parquet(f"{self.path}/data/{name}")
        if self.spark.read.parquet(f"{self.path}/data/{name}").isEmpty():
            at, files = self._at(f"data/{name}")
            files.delete(at, True)
            return None
        return name

    def read(self, version: int | None = None) -> DataFrame:
        """The rows as of a version, the newest unless given: the last of each key."""
        folders = self.folders(version)
        if not folders:
            return self.spark.createDataFrame([], self.schema)
        stored = StructType(list(self.schema.fields)).add("_gone", "boolean")
        parts = [self.spark.read.schema(stored).parquet(f"{self.path}/data/{name}").withColumn("_order", F.lit(i)) for i, name in enumerate(folders)]
        every = parts[0]
        if len(parts) == 1:
            return every.where("NOT _gone").select(*self.schema.names)
        for p in parts[1:]:
            every = every.unionByName(p)
        rest = [c for c in self.schema.names if c not in self.keys]
        last = every.groupBy(*self.keys).agg(F.max_by(F.struct("_gone", *rest), "_order").alias("_last"))
        return last.where("NOT _last._gone").select(*[F.col(c) if c in self.keys else F.col(f"_last.{c}").alias(c) for c in self.schema.names])

    def upsert(self, rows: DataFrame) -> int:
        """Adds the rows, in place of those of the same keys; the version that holds them."""
        return self._append(rows, False)

    def delete(self, keys: DataFrame) -> int:
        """Removes the rows of these keys."""
        return self._append(keys, True)

    def _append(self, rows: DataFrame, gone: bool) -> int:
        name = self._lay(rows, gone)
        if name is None:
            return self.version()
        version = self._commit(lambda folders: [*folders, name])
        return self.compact() if len(self.folders(version)) >= COMPACT_AT else version

    def compact(self) -> int:
        """The newest state as one folder; what others publish meanwhile comes after it."""
        at = self.version()
        old = self.folders(at)
        if len(old) < 2:
            return at
        name = self._lay(self.read(at), False)

        def change(now: list[str]) -> list[str]:
            if now[: len(old)] != old:  # another compaction came first
                return now
            return [*([name] if name else []), *now[len(old) :]]

        return self._commit(change)

    def vacuum(self, keep: int = 2) -> None:
        """Deletes the manifests before the last `keep` versions and the folders that only those name.  Not while others write: their files aren't named yet."""
        last = self.version()
        kept = set()
        for v in range(max(1, last - keep + 1), last + 1):
            kept |= set(self.folders(v))
        for folder, stays in (("data", kept.__contains__), ("versions", lambda n: int(n.split(".")[0] or 0) > last - keep if n.endswith(".json") and not n.startswith(".") else True), ("drafts", lambda n: False)):
            for name in self._names(folder):
                if not stays(name):
                    at, files = self._at(f"{folder}/{name}")
                    files.delete(at, True)
