"""Translation memory: exact and fuzzy lookup, upsert.

The fuzzy lookup is exact in its results.  A ratio of t or more means that M, the
characters in blocks that both texts have, is at least t / 2 of the lengths together.
What both texts hold of each character is at least M; and as the difference, what is
left of both, is at most (1 - t) of the lengths, there is at most one block more than
that, so what they hold of each run of n characters is at least M less n - 1 for each
block.  In texts of POPULAR_FROM characters or more, the ratio starts its blocks at rare
characters only, which bounds their number too.

Texts are dealt into blocks by length.  Blocks whose lengths allow the threshold meet,
and a task compares what two blocks hold, in classes, by products of 0 and 1 matrices.
Few pairs are left, which are compared as they are, the likeliest first, until the
bound falls below the best ratio.
"""

from __future__ import annotations

import bisect
from collections import Counter
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cuegrid.functions import text as T
from cuegrid.operators.scoring import ratio

#: Entries of this length or more are met by pairs of characters, shorter ones by characters.
LONG = 200
#: Texts and characters of a block.
ROWS, CHARS = 4096, 1 << 21
#: Classes of characters and of pairs of characters; characters of the runs that are counted as they are.
SINGLE, PAIR, GRAM = 61, 256, 5
#: From so many characters on, difflib doesn't start a block at a character of which there are more than 1 % + 1.
POPULAR_FROM = 200
#: Texts that are compared at once, pairs that are looked at at once, levels of all classes together, texts of which runs are kept.
CHUNK, AT_ONCE, LEVELS, KEPT = 512, 1 << 14, 2048, 2048
EPS = 1e-9


def key(x: Column) -> Column:
    return F.lower(T.strip(x))


def exact(cues: DataFrame, memory: DataFrame, text: str = "source_text") -> DataFrame:
    """cue columns and the entry of the same text (case and outer blanks aside), the oldest of equals."""
    best = memory.withColumn("k", key(F.col("source_text"))).groupBy("k").agg(F.min_by(F.struct("tm_id", "target_text"), "tm_id").alias("hit"))
    return cues.withColumn("k", key(F.col(text))).join(best, "k").drop("k").select("*", "hit.tm_id", F.col("hit.target_text").alias("tm_target")).drop("hit")


def _counts(texts: list[str], n: int) -> np.ndarray:
    """For each text, how many of its characters (n = 1) or pairs of characters (n = 2) are of each class."""
    code = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.int64)
    row = np.repeat(np.arange(len(texts)), [len(x) for x in texts])
    classes = SINGLE if n == 1 else PAIR
    if n == 1:
        of = code % SINGLE
    else:
        inside = row[:-1] == row[1:]
        row, of = row[:-1][inside], ((code[:-1] * 37 + code[1:]) % PAIR)[inside]
    return np.bincount(row * classes + of, minlength=len(texts) * classes).reshape(-1, classes).astype(np.int32)


def _starts(x: str) -> int:
    """At how many characters of an entry a block can start."""
    return len(x) if len(x) < POPULAR_FROM else sum(n for n in Counter(x).values() if n <= len(x) // 100 + 1)


class _Levels:
    """The levels of each class on which most texts differ; a text is 1 on those below its count.  What two texts hold of a class is at most the lowest level, the levels that both are 1 on, and the less of what they have above."""

    def __init__(self, counts: np.ndarray):
        some = np.sort(counts[:: max(1, len(counts) // 512)], axis=0)
        self.low, self.high = some[len(some) // 100], some[-1 - len(some) // 100]
        wide = self.high - self.low
        if wide.sum() > LEVELS:
            wide = wide * LEVELS // wide.sum()
            self.high = self.low + wide
        self.of = np.repeat(np.arange(counts.shape[1]), wide)
        self.level = np.arange(len(self.of)) - np.repeat(np.cumsum(wide) - wide, wide) + self.low[self.of]

    def bits(self, counts: np.ndarray) -> np.ndarray:
        return (counts[:, self.of] > self.level).astype(np.float32)

    def above(self, counts: np.ndarray) -> np.ndarray:
        return np.maximum(counts - self.high, 0).sum(1).astype(np.float32)


def _met(la: np.ndarray, lb: np.ndarray, starts: np.ndarray, one: tuple, two: tuple, threshold: float, long: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Numbers of texts and entries, both in the order of lengths, and a bound of the ratio: all pairs that can reach the threshold, the likeliest of each text first, and all of a text at once."""
    if not len(la) or not len(lb):
        return
    n, (ca, cb) = (2, two) if lb[0] >= long else (1, one)
    levels = _Levels(cb)
    bits, above, always = levels.bits(cb), levels.above(cb), float(levels.low.sum())
    for i in range(0, len(la), CHUNK):
        own = slice(i, i + CHUNK)
        least, most = la[own][0] * threshold / (2 - threshold) - EPS, la[own][-1] * (2 - threshold) / threshold + EPS
        k, end = np.searchsorted(lb, least), np.searchsorted(lb, most, "right")
        if k >= end:
            continue
        held = levels.bits(ca[own]) @ bits[k:end].T + always
        held += np.minimum(levels.above(ca[own])[:, None], above[None, k:end])
        total = np.add.outer(la[own], lb[k:end]).astype(np.float32)
        needed = total * (threshold / 2 - 1e-6) - 0.01
        if n == 2:
            needed -= np.minimum(total * (1 - threshold + 1e-6) + 1.01, starts[None, k:end].astype(np.float32) + 1)
        x, y = np.nonzero(held >= needed)
        found = []
        for at in range(0, len(x), AT_ONCE):
            xs, ys = x[at : at + AT_ONCE] + i, y[at : at + AT_ONCE] + k
            both = la[xs] + lb[ys]
            m1 = np.minimum(one[0][xs], one[1][ys]).sum(1)
            m2 = np.minimum(two[0][xs], two[1][ys]).sum(1)
            bound = 2 * np.minimum(m1, np.minimum((m2 + both + 1) / 3, m2 + starts[ys] + 1)) / both
            kept = (bound >= threshold - EPS) & (2 * np.minimum(la[xs], lb[ys]) >= (threshold - EPS) * both)
            found.append((xs[kept], ys[kept], bound[kept]))
        if found:
            xs, ys, bound = (np.concatenate(c) for c in zip(*found))
            order = np.lexsort((-bound, xs))
            yield xs[order], ys[order], bound[order]


def _best(texts: list[str], entries: list[str], threshold: float, long: int) -> list[tuple[str, str, float]]:
    """text, entry, ratio: the best entries of these for each text, all of equals."""
    texts, entries = sorted(texts, key=len), sorted(entries, key=len)
    la, lb = np.array([len(x) for x in texts]), np.array([len(x) for x in entries])
    starts = np.array([_starts(x) for x in entries])
    one, two = [(_counts(texts, n), _counts(entries, n)) for n in (1, 2)]
    grams = lru_cache(KEPT)(lambda x: Counter(x[j : j + GRAM] for j in range(len(x) - GRAM + 1)))
    out = []
    for xs, ys, bounds in _met(la, lb, starts, one, two, threshold, long):
        at = None
        for i, k, bound in zip(xs, ys, bounds):
            if i != at:
                at, best, done, a = i, threshold, False, texts[i]
            if done or (done := bool(bound < best - EPS)):
                continue
            b, both = entries[k], int(la[i] + lb[k])
            shared = (grams(a) & grams(b)).total()
            # the runs of a block are GRAM - 1 less than its characters; there are at most both - 2 M + 1 blocks, and at most starts + 1
            m = min((shared + (GRAM - 1) * (both + 1)) / (2 * GRAM - 1), shared + (GRAM - 1) * (int(starts[k]) + 1))
            if 2 * m / both >= best - EPS and (r := ratio(a, b)) >= best:
                best = r
                out.append((a, b, r))
    top: dict[str, float] = {}
    for a, _, r in out:
        top[a] = max(r, top.get(a, r))
    return [x for x in out if x[2] == top[x[0]]]


def _blocks(rows: list) -> tuple[list, list]:
    """bucket, first block, number of blocks; and least and greatest length of each block, both in the order of lengths.  rows: bucket, texts, characters, least and greatest length."""
    dealt, blocks, open_ = [], [], None
    for bucket, n, chars, least, most in sorted(rows):
        parts = max(-(-n // ROWS), -(-chars // CHARS))
        if open_ and parts == 1 and open_[0] + n <= ROWS and open_[1] + chars <= CHARS and open_[2] == (bucket >= 0):
            blocks[-1][1] = most
            open_ = (open_[0] + n, open_[1] + chars, open_[2])
        else:
            blocks += [[least, most] for _ in range(parts)]
            open_ = (n, chars, bucket >= 0) if parts == 1 else None
        dealt.append((bucket, len(blocks) - parts, parts))
    return dealt, blocks


def _dealt(texts: DataFrame, dealt: list, spans: list, names: tuple[str, str]) -> DataFrame:
    """texts with the numbers of their own block and of each that it meets."""
    rows = [(bucket, first, parts, *spans[first]) for bucket, first, parts in dealt]
    # a row for each 2 % of length
    where = texts.sparkSession.createDataFrame(rows, "bucket int, first long, parts long, least long, most long").where("least <= most")
    own = (F.col("first") + F.pmod(F.xxhash64("text"), F.col("parts"))).alias(names[0])
    return texts.join(F.broadcast(where), "bucket").select("text", own, F.explode(F.sequence("least", "most")).alias(names[1]))


def candidates(wanted: DataFrame, entries: DataFrame, threshold: float) -> DataFrame:
    """a, b, ratio: the pairs at or above the threshold that can be the best of a.  wanted: distinct texts a; entries: distinct texts b; none is empty."""
    spark, long = wanted.sparkSession, LONG
    sized = lambda df, x: df.select(F.col(x).alias("text"), F.length(x).alias("n")).withColumn("bucket", F.floor(F.log(F.col("n") / max(1, long)) * 50).cast("int"))
    a, b = sized(wanted, "a"), sized(entries, "b")
    found = a.withColumn("side", F.lit(0)).unionByName(b.withColumn("side", F.lit(1))).groupBy("side", "bucket").agg(F.count("*"), F.sum("n"), F.min("n"), F.max("n")).collect()
    (dealt_a, of_a), (dealt_b, of_b) = (_blocks([tuple(r)[1:] for r in found if r["side"] == k]) for k in (0, 1))
    # the blocks that one meets stand in a row
    least, most = [x for x, _ in of_b], [x for _, x in of_b]
    to_b = [(bisect.bisect_left(most, x * threshold / (2 - threshold) - EPS), bisect.bisect_right(least, y * (2 - threshold) / threshold + EPS) - 1) for x, y in of_a]
    first, last = [x for x, _ in to_b], [x for _, x in to_b]
    to_a = [(bisect.bisect_left(last, k), bisect.bisect_right(first, k) - 1) for k in range(len(of_b))]
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # few rows, but each costs time: a number of tasks that stays
    left = _dealt(a, dealt_a, to_b, ("i", "k")).repartition(tasks, "i", "k").groupBy("i", "k")
    right = _dealt(b, dealt_b, to_a, ("k", "i")).repartition(tasks, "i", "k").groupBy("i", "k")
    return left.cogroup(right).applyInPandas(_rated(threshold, long), "a string, b string, ratio double")


def _rated(threshold: float, long: int) -> Callable:
    def rated(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(_best(a["text"].tolist(), b["text"].tolist(), threshold, long), columns=["a", "b", "ratio"])

    return rated


def fuzzy(cues: DataFrame, memory: DataFrame, ids: list[str], text: str = "source_text", threshold: float = 0.92) -> DataFrame:
    """ids, tm_id, tm_target, ratio_e3: the best entry at or above the threshold (above 0 and at most 1), the oldest of equals.  Distinct texts are looked up once; null and blank ones find nothing."""
    if not 0 < threshold <= 1:
        raise ValueError("a threshold is above 0 and at most 1")
    wanted = cues.select(key(F.col(text)).alias("a")).where("a <> ''").distinct()
    entries = memory.select(key(F.col("source_text")).alias("b"), F.struct("tm_id", "target_text").alias("entry")).where("b <> ''")
    # texts that are there as they are have a ratio of 1 and need no index
    entries = entries.groupBy("b").agg(F.min_by("entry", F.col("entry.tm_id")).alias("entry"))
    same = wanted.join(entries, F.col("a") == F.col("b")).select("a", F.lit(1.0).alias("ratio"), "entry")
    near = candidates(wanted.join(entries.select(F.col("b").alias("a")), "a", "left_anti"), entries.select("b"), threshold)
    rated = near.join(entries, "b")
    best = same.unionByName(rated.select("a", "ratio", "entry")).groupBy("a").agg(F.max(F.struct("ratio", (-F.col("entry.tm_id")).alias("o"), F.col("entry.target_text").alias("t"))).alias("m")).where(
        F.col("m.ratio") >= threshold,
    )
    return cues.select(*ids, key(F.col(text)).alias("a")).join(best, "a").select(
        *ids,
        (-F.col("m.o")).alias("tm_id"),
        F.col("m.t").alias("tm_target"),
        F.round(F.col("m.ratio") * 1000).cast("int").alias("ratio_e3"),
    )


def upsert(memory: DataFrame, new: DataFrame) -> DataFrame:
    """The latest version of each source text."""
    w = Window.partitionBy("source_text").orderBy(F.desc("version"), F.desc("tm_id"))
    return memory.unionByName(new).withColumn("r", F.row_number().over(w)).where("r = 1").drop("r")
