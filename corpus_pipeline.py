"""From raw documents to a training mix: toxicity, quality, near copies, benchmark leaks, source weights.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which run() writes
as Parquet and reads again as the next stage's docs.  A document without labels
or with a null text is judged by its text like any other (null: empty), a very long
one by its whole text.  Empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cuegrid.llm.decontaminate import leaks
from cuegrid.llm.mixing import mix_documents
from cuegrid.llm.ngram_join import ngram_join
from cuegrid.llm.quality_classifier import quality_classifier
from cuegrid.llm.stages import materialise, materialise_only, release, table
from cuegrid.llm.toxicity import toxicity

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _without(docs: DataFrame, found: DataFrame) -> DataFrame:
    """Documents whose id and text aren't among `found` (doc_id, text_hash): rows are told by both, ids may be shared or null."""
    gone = materialise(found.select(F.col("doc_id").alias("gone_id"), F.col("text_hash").alias("gone_hash")).distinct())
    hashed = docs.withColumn("_hash", F.xxhash64("text"))
    return hashed.join(gone, hashed["doc_id"].eqNullSafe(gone["gone_id"]) & (hashed["_hash"] == gone["gone_hash"]), "left_anti").select(*COLUMNS)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text is predicted to be toxic go, where they are judged: no join.  Without toxic labels all stay; null and empty texts are judged as texts without features; an empty table stays empty."""
    return toxicity(docs, table(spark, sf_dir, "labels"), carry=COLUMNS).where("predicted = 0").select(*COLUMNS)


def drop_poor(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text is predicted to be of poor quality go, where they are judged.  With labels of one kind only all are judged alike; null and empty texts are judged as texts without words; an empty table stays empty."""
    return quality_classifier(docs, table(spark, sf_dir, "labels"), carry=COLUMNS).where("predicted = 1").select(*COLUMNS)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the row with the smallest id stays (those without an id come last, then the text's hash decides); equal rows of id and text are one.  Texts without words are no copies; rows that share an id but not their text are judged by their texts."""
    found = materialise(ngram_join(docs).where("class_key IS NOT NULL").groupBy("class_key", "doc_id", "text_hash").agg(F.count("*").alias("rows")))
    row = F.struct(F.col("doc_id").isNull(), "doc_id", "text_hash")
    first = found.groupBy("class_key").agg(F.min(row).alias("first"))
    out = _without(docs, found.join(first, "class_key").where(row != F.col("first")))
    again = found.where("rows > 1").select(F.col("doc_id").alias("again_id"), F.col("text_hash").alias("again_hash"))
    if again.isEmpty():
        return out
    hashed = out.withColumn("_hash", F.xxhash64("text"))
    same = hashed["doc_id"].eqNullSafe(again["again_id"]) & (hashed["_hash"] == again["again_hash"])
    once = hashed.join(again, same, "left_semi").dropDuplicates(["doc_id", "_hash"])
    return hashed.join(again, same, "left_anti").unionByName(once).select(*COLUMNS)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text holds a passage of the benchmark go, repeated rows all or none.  An empty benchmark takes none; null, empty and very short texts stay."""
    return _without(docs, leaks(docs, table(spark, sf_dir, "benchmark")))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, its size, its source's size and target, and the words taken of it.  A null text has size 0 and a null source is one of its own; repeated rows are numbered and taken one by one; ties of the seeded order are broken by id, number and size; an empty table gives no rows."""
    return mix_documents(docs).select("doc_id", "size", "source_size", "target", "taken")


STAGES = [
    ("toxicity", drop_toxic),
    ("quality classifier", drop_poor),
    ("n-gram jaccard join", drop_copies),
    ("benchmark decontamination", drop_leaks),
    ("mixing", mix_sources),
]

#: Classifiers, fingerprints and seeded choices have no SQL: tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(*COLUMNS)
    before = None
    for _, stage in STAGES:
        docs = materialise_only(lambda stage=stage, docs=docs: stage(spark, docs, sf_dir))
        if before is not None:
            release(before)
        before = docs
    return docs
