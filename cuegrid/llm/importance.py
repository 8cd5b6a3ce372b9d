"""Importance resampling towards a target distribution, on hashed n-grams over an integer word dictionary.

A task keeps a dictionary of the distinct words it has met, each with an integer id, so
a text is a row of integers and an n-gram a tuple of them.  The distinct tuples of a
block of texts are found as integers; each is hashed once, over the bytes that its
words make, and its bucket is remembered with it; counts are joined back by the tuple's
place.  Dictionary and remembered tuples are bounded and start anew beyond that.

The corpus and the target give one count for each bucket; a bucket's gain is the log
ratio of its smoothed shares.  A document's weight is the mean gain of its features,
and its score the weight plus seeded Gumbel noise, so the highest scores are a draw
without replacement.  Two counts of scores (coarse, then one coarse class) find the
score at which the draw ends; only documents that reach it are ordered, by range, and
numbered within their range.

Defined results: a null text has no words; a document without features weighs 0;
texts are counted whole; repeated rows are documents each; a null id counts as the
empty text in the noise and comes last among ties, rows that tie in all else are drawn
in any order; an empty corpus gives no rows, an empty target weighs only by the corpus;
other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cuegrid.llm.stages import emit_rows, gather, materialise, schema_of, table
from cuegrid.llm.textblock import TextBlock, chunks, ngrams

#: Words, and tuples, that a task remembers; a block adds its own before it is checked.
KEPT = 1 << 20
COARSE = 8


class _Known:
    """Integer values for 64-bit keys, sorted by key."""

    def __init__(self):
        self.key, self.value = np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def get(self, key: np.ndarray) -> np.ndarray:
        """The values; -1 for keys that aren't here."""
        if not len(self.key):
            return np.full(len(key), -1, np.int64)
        at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
        return np.where(self.key[at] == key, self.value[at], -1)

    def add(self, key: np.ndarray, value: np.ndarray) -> None:
        key, value = np.concatenate((self.key, key)), np.concatenate((self.value, value))
        order = np.argsort(key, kind="stable")
        self.key, self.value = key[order], value[order]


class Features:
    """Buckets of the n-grams of texts; holds a task's dictionary."""

    def __init__(self, longest: int, buckets: int):
        self.longest, self.buckets = longest, buckets
        self._anew()

    def _anew(self) -> None:
        self.ids, self.words, self.tuples = _Known(), [], _Known()

    def word_ids(self, text: TextBlock) -> np.ndarray:
        kinds, at, back = np.unique(text.word_hash(), return_index=True, return_inverse=True)
        ids = self.ids.get(kinds)
        new = np.flatnonzero(ids < 0)
        if len(new):
            raw = text.data.tobytes()
            ids[new] = len(self.words) + np.arange(len(new))
            self.words += [raw[s:e] for s, e in zip(text.start[at[new]].tolist(), text.end[at[new]].tolist())]
            self.ids.add(kinds[new], ids[new])
        return ids[back]

    def of(self, text: TextBlock) -> tuple[np.ndarray, np.ndarray]:
        """(text, bucket) of every feature; text: already in lower case and cut into words."""
        if len(self.words) > KEPT or len(self.tuples.key) > KEPT:
            self._anew()
        ids = self.word_ids(text)
        rows, found = [], []
        for k in range(1, self.longest + 1):
            key, ptr = ngrams(ids.astype(np.uint64) + np.uint64(1), text.word_ptr, k)
            n = np.diff(ptr)
            at = np.arange(ptr[-1]) + np.repeat(text.word_ptr[:-1] - ptr[:-1], n)
            kinds, first, back = np.unique(key, return_index=True, return_inverse=True)
            bucket = self.tuples.get(kinds)
            new = np.flatnonzero(bucket < 0)
            if len(new):
                tuples = ids[at[first[new]][:, None] + np.arange(k)].tolist()
                bucket[new] = [zlib.crc32(b" ".join([self.words[i] for i in t])) % self.buckets for t in tuples]
                self.tuples.add(kinds[new], bucket[new])
            rows.append(np.repeat(np.arange(text.n), n))
            found.append(bucket[back])
        return np.concatenate(rows), np.concatenate(found)


def bucket_counts(texts: DataFrame, longest: int, buckets: int, text: str = "text") -> np.ndarray:
    """Features of all texts in each bucket; a row for each bucket reaches the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        features, total = Features(longest, buckets), np.zeros(buckets, np.int64)
        for batch in batches:
            for _, _, block in chunks(batch.column(0)):
                total += np.bincount(features.of(block.letters())[1], minlength=buckets)
        at = np.flatnonzero(total)
        if len(at):
            yield {"bucket": at, "n": total[at]}

    parts = emit_rows(texts.select(F.col(text).cast("string").alias("text")), run, "bucket int, n long")
    got = gather(parts.groupBy("bucket").agg(F.sum("n").alias("n")))
    out = np.zeros(buckets, np.int64)
    out[got["bucket"].to_numpy()] = got["n"].to_numpy()
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of the smoothed shares of each bucket."""
    size, s, t = len(corpus), corpus.astype(np.float64), target.astype(np.float64)
    return np.floor(1000 * np.log((t + 1) * (s.sum() + size) / ((s + 1) * (t.sum() + size)))).astype(np.int64)


def weighted(docs: DataFrame, gain: np.ndarray, longest: int) -> DataFrame:
    """doc_id, n_words, n_features and weight: the floored mean gain."""
    ddl = "doc_id long, n_words long, n_features long, weight long"
    kind, arrow = schema_of(ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features(longest, len(gain))
        for batch in batches:
            for i, j, block in chunks(batch.column(1)):
                words = block.letters()
                at, bucket = features.of(words)
                n, total = np.bincount(at, minlength=words.n), np.zeros(words.n, np.int64)
                np.add.at(total, at, gain[bucket])
                weight = np.where(n > 0, total // np.maximum(n, 1), 0)
                made = [pa.array(words.n_words.astype(np.int64)), pa.array(n.astype(np.int64)), pa.array(weight)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), *made], schema=arrow)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, kind)


def noisy(weight: str, doc_id: str, seed: int) -> Column:
    """weight and a Gumbel value, in thousandths, from the first 32 bits of a hash of seed and id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(doc_id).cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")
    return (F.col(weight) + F.floor(F.lit(-1000.0) * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0))))).cast("long")


def _last_score(scored: DataFrame, n: int) -> int:
    """The score of the n-th of the rows that may be drawn.  Two counts: by 2^COARSE scores, then within one such class."""

    def find(counts: list, n: int) -> tuple[int, int]:
        for key, rows in sorted(counts, reverse=True):
            if n <= rows:
                return key, n
            n -= rows
        raise AssertionError("fewer rows than are drawn")

    coarse = F.shiftright("score", COARSE)
    key, n = find([tuple(r) for r in scored.groupBy(coarse.alias("k")).count().collect()], n)
    return find([tuple(r) for r in scored.where(coarse == key).groupBy("score").count().collect()], n)[0]


def _numbered(rows: DataFrame, order: list[Column]) -> DataFrame:
    """Rows with their rank in a total order: dealt by range, numbered within their range behind the sizes of those before."""
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    number = F.monotonically_increasing_id()
    dealt = materialise(dealt.withColumn("_part", F.shiftright(number, 33)).withColumn("_at", number.bitwiseAND((1 << 33) - 1)))
    sizes = dealt.groupBy("_part").agg(F.count(F.lit(1)).alias("n"))  # a row for each task
    sizes = sizes.select(F.col("_part").alias("_of"), (F.sum("n").over(Window.orderBy("_part")) - F.col("n")).alias("_before"))
    return dealt.join(sizes, F.col("_part") == F.col("_of")).withColumn("rank", F.col("_before") + F.col("_at") + 1).drop("_part", "_of", "_at", "_before")


def resample(
    docs: DataFrame,
    target: DataFrame,
    longest: int = 1,
    buckets: int = 10_000,
    seed: int = 2024,
    least_words: int = 20,
    percent: int = 10,
) -> DataFrame:
    """Every row's doc_id, n_features, weight, score and rank; rank is null for rows that are not drawn.  target: a table with `text`."""
    gain = gains(bucket_counts(docs, longest, buckets), bucket_counts(target, longest, buckets))
    scored = materialise(weighted(docs, gain, longest).withColumn("score", noisy("weight", "doc_id", seed)))
    open_ = scored.where(F.col("n_words") >= least_words)
    draw = open_.count() * percent // 100
    kept = ["doc_id", "n_features", "weight", "score"]
    if not draw:
        return scored.select(*kept, F.lit(None).cast("long").alias("rank"))
    reaches = (F.col("n_words") >= least_words) & (F.col("score") >= _last_score(open_, draw))
    ranked = _numbered(scored.where(reaches).select(*kept), [F.col("score").desc(), F.col("doc_id").asc_nulls_last()])
    ranked = ranked.withColumn("rank", F.when(F.col("rank") <= draw, F.col("rank")).cast("long"))
    return ranked.unionByName(scored.where(~reaches).select(*kept, F.lit(None).cast("long").alias("rank")))


def op11_importance(spark, sf_dir: str) -> DataFrame:
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


#: crc32 from a word's bytes in hexadecimal; its table is made by the rule of the polynomial 0xEDB88320.
OP11_SQL = r"""
WITH crc AS MATERIALIZED (
  SELECT list(list_reduce(range(1, 9), lambda c, step: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i) ORDER BY i) AS t
  FROM range(0, 256) AS bytes(i)
), texts AS MATERIALIZED (
  SELECT 0 AS side, row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents
  UNION ALL SELECT 1, row_number() OVER (), NULL, coalesce(text, '') FROM benchmark
), cut AS MATERIALIZED (
  SELECT side, r, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM texts
), counted AS MATERIALIZED (
  SELECT side, r, word, count(*) AS n FROM (SELECT side, r, unnest(w) AS word FROM cut) GROUP BY side, r, word
), buckets AS MATERIALIZED (
  SELECT word, xor(list_reduce(list_transform(range(1, CAST(length(h) AS BIGINT), 2), lambda i: CAST('0x' || substr(h, i, 2) AS BIGINT)),
      lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295), 4294967295) % 10000 AS bucket
  FROM (SELECT word, hex(encode(word)) AS h FROM (SELECT DISTINCT word FROM counted)), crc
), sums AS (
  SELECT bucket, CAST(coalesce(sum(n) FILTER (side = 0), 0) AS DOUBLE) AS s, CAST(coalesce(sum(n) FILTER (side = 1), 0) AS DOUBLE) AS t FROM counted JOIN buckets USING (word) GROUP BY bucket
), gains AS MATERIALIZED (
  SELECT bucket, CAST(floor(1000 * ln((t + 1) * ((SELECT sum(s) FROM sums) + 10000) / ((s + 1) * ((SELECT sum(t) FROM sums) + 10000)))) AS BIGINT) AS gain FROM sums
), weights AS (
  SELECT r, CAST(sum(n * gain) AS BIGINT) AS total FROM counted JOIN buckets USING (word) JOIN gains USING (bucket) WHERE side = 0 GROUP BY r
), scored AS MATERIALIZED (
  SELECT doc_id, n_features, weight,
    CAST(weight + floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('2024:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) + 0.5) / CAST(4294967296 AS DOUBLE)))) AS BIGINT) AS score
  FROM (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_features,
      CASE WHEN len(w) = 0 THEN 0 ELSE (total - ((total % len(w)) + len(w)) % len(w)) // len(w) END AS weight
    FROM cut LEFT JOIN weights USING (r) WHERE side = 0)
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id NULLS LAST) AS place, count(*) FILTER (n_features >= 20) OVER () AS many FROM scored
)
SELECT doc_id, n_features, CAST(weight AS BIGINT) AS weight, score, CASE WHEN n_features >= 20 AND place <= 10 * many // 100 THEN place END AS rank FROM ranked"""
