"""What the operators of this package share: reading tables, mapping text blocks, cutting lineage, folds."""

from __future__ import annotations

import gc
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string

from cuegrid.llm.textblock import TextBlock, chunks


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.  Where the session names none, a local master gets a temporary one, as in tests; on a cluster that is an error."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="cuegrid-"))
        at = spark.sparkContext.getCheckpointDir()
    return at


def _path(spark: SparkSession, at: str):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(at)
    return path, path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


#: Folders of tables that this process has written and not released.
_WRITTEN: set[str] = set()


def _kept(df: DataFrame, at: str) -> DataFrame:
    path, files = _path(df.sparkSession, at)
    files.deleteOnExit(path)
    _WRITTEN.add(at)
    df._kept_at = at
    return df


def materialise(df: DataFrame, codec: str = "zstd", by: str | None = None) -> DataFrame:
    """Write to the shared folder and read again: what follows has no lineage and survives lost executors.  The files go by release(), or when the application ends.  by: a column of few values, each in a folder of its own."""
    spark = df.sparkSession
    at = f"{shared_dir(spark)}/table-{uuid.uuid4().hex}"
    df.write.option("compression", codec).partitionBy(*[by] * bool(by)).parquet(at)
    return _kept(spark.read.schema(df.schema).parquet(at), at)


def bucketed(df: DataFrame, n: int, key: str) -> DataFrame:
    """As materialise, in n buckets by key: grouping by the key needs no shuffle."""
    spark = df.sparkSession
    name = f"cuegrid_{uuid.uuid4().hex}"
    at = f"{shared_dir(spark)}/table-{name}"
    df.write.format("parquet").option("compression", "zstd").option("path", at).bucketBy(min(n, 100_000), key).saveAsTable(name)
    return _kept(spark.table(name), at)


def release(*frames: DataFrame) -> None:
    """Delete what materialise() wrote for these frames; nothing may read them any more."""
    for df in frames:
        path, files = _path(df.sparkSession, df._kept_at)
        files.delete(path, True)
        _WRITTEN.discard(df._kept_at)


def materialise_only(make: Callable[[], DataFrame]) -> DataFrame:
    """Write what make() gives, and delete the tables that were written on the way to it."""
    before = set(_WRITTEN)
    out = materialise(make())
    for at in _WRITTEN - before - {out._kept_at}:
        path, files = _path(out.sparkSession, at)
        files.delete(path, True)
        _WRITTEN.discard(at)
    return out


def free_shuffles(spark: SparkSession) -> None:
    """Shuffle files go when the driver's JVM finds that no frame refers to them; else they stay until it happens to collect its garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def schema_of(ddl: str) -> tuple[StructType, pa.Schema]:
    kind = _parse_datatype_string(ddl)
    return kind, to_arrow_schema(kind)


def map_texts(df: DataFrame, fn: Callable[[TextBlock, pa.RecordBatch], dict], ddl: str, text: str = "text") -> DataFrame:
    """fn(block, the block's rows) gives a column for each name in ddl; names that fn leaves out are the rows' own columns."""
    kind, arrow = schema_of(ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, block in chunks(batch.column(batch.schema.get_field_index(text))):
                rows = batch.slice(i, j - i)
                made = fn(block, rows)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(made[f.name], f.type) if f.name in made else rows.column(rows.schema.get_field_index(f.name)).cast(f.type) for f in arrow],
                    schema=arrow,
                )

    return df.mapInArrow(run, kind)


def scored(df: DataFrame, fn: Callable[[TextBlock], np.ndarray], name: str = "score", text: str = "text", limit: int = 1 << 19) -> DataFrame:
    """The rows with one more column of doubles, fn(block) of their texts.  Only the texts go to the Python workers, in blocks of `limit` bytes, and only the numbers come back; what follows, filters included, reads the number and doesn't find it again."""

    def run(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in columns:
            made = [np.asarray(fn(block), np.float64) for _, _, block in chunks(column, limit)]
            yield pa.array(np.concatenate(made) if made else np.zeros(0))

    run.__annotations__ = {"columns": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return df.withColumn(name, F.arrow_udf(run, "double").asNondeterministic()(F.col(text)))


def carried(docs: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """doc_id, text and the named columns."""
    more = [n for n in names if n not in ("doc_id", "text")]
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *more)


def emit_rows(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[dict]], ddl: str) -> DataFrame:
    """fn turns a partition's batches into dicts of columns."""
    kind, arrow = schema_of(ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for made in fn(batches):
            yield pa.RecordBatch.from_arrays([pa.array(made[f.name], f.type) for f in arrow], schema=arrow)

    return df.mapInArrow(run, kind)


def fold(doc_id: str, mod: int) -> Column:
    """crc32 of the id as text, modulo mod; a null id counts as the empty text."""
    return (F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))) % mod).cast("int")


def one_label(labels: DataFrame, label: str) -> DataFrame:
    """doc_id, y: one row per id; the larger label where rows disagree; null ids and labels don't count."""
    return labels.select(
        "doc_id",
        F.col(label).cast("int").alias("y"),
    ).where("doc_id IS NOT NULL AND y IS NOT NULL").groupBy("doc_id").agg(F.max("y").alias("y"))


def labelled_sample(labels: DataFrame, label: str, per_class: int, mod: int = 5, out: int = 0) -> DataFrame:
    """At most per_class ids of each of the labels 0 and 1, by a seeded order, none of them in fold `out`."""
    one = one_label(labels, label).where(fold("doc_id", mod) != out).withColumn("h", F.xxhash64(F.lit(label), F.col("doc_id")))
    parts = [one.where(F.col("y") == y).orderBy("h", "doc_id").limit(per_class).select("doc_id", "y") for y in (0, 1)]
    return parts[0].unionByName(parts[1])


def one_text(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The chosen ids (of a proven number, so they are broadcast) with one text each, the one of the least hash where an id stands in several rows: as many rows as ids at most."""
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(ids), "doc_id")
    return rows.groupBy(*ids.columns).agg(F.min_by("text", F.xxhash64("text")).alias("text")).select("doc_id", "text", *[c for c in ids.columns if c != "doc_id"])


def gather(df: DataFrame) -> pa.Table:
    """A result of a proven size bound, to the driver."""
    return df.toArrow()


def ragged(values: np.ndarray, ptr: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(ptr, pa.int32()), pa.array(values))
