"""Toxicity by non-negative positive-unlabelled learning.

Positives are documents labelled toxic, the rest is text whose labels are not
looked at.  The features of a text are its words in lower case and their first
four and five bytes, by presence.  Those whose share among positives differs most
from that among the unlabelled are kept, found by one distributed count over the
sample.  A linear numpy classifier then minimises the class-prior-corrected risk

    pi * E_P[loss(+)] + max(0, E_U[loss(-)] - pi * E_P[loss(-)])

where a step goes up the second term's gradient while it is negative.

Only ids outside the held-out fold are learned from: at most ``positives`` toxic
ones and ``unlabelled`` others, both in a seeded order, with one text each; pi is the
toxic share of all labelled ids outside the fold.  At most ``features`` (2,048) features
are kept, of those that four texts of the sample hold and whose z is above 3: a bound of
the model's size, which does not depend on the corpus.  Defined results: null or empty texts get the
score of a text without features; very long texts are read whole; equal texts get
equal scores; features of equal z are ordered by their hash; without any toxic label
every score is 0; an empty table gives no rows; extra columns are ignored; repeated
ids are scored row by row and learned from once, by the text of the least hash.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuegrid.llm.stages import carried, fold, gather, labelled_sample, map_texts, materialise, one_label, one_text, ragged, scored, table
from cuegrid.llm.textblock import TextBlock

FOLDS, HELD_OUT = 5, 0


def _features(block: TextBlock) -> tuple[np.ndarray, np.ndarray]:
    """(text, feature), not yet distinct."""
    low = block.letters()
    text, size = low.text_of(low.word_ptr), low.end - low.start
    keys, texts = [low.word_hash()], [text]
    for k in (4, 5):
        long = size > k
        keys.append(low.span_hash(low.start[long], low.start[long] + k) ^ np.uint64(k))
        texts.append(text[long])
    return np.concatenate(texts), np.concatenate(keys)


class Lookup:
    """Numbers of chosen features; a bitmap spares the search for most others."""

    def __init__(self, keys: np.ndarray):
        self.keys = np.sort(keys)
        self.seen = np.zeros(1 << 20, bool)
        self.seen[(self.keys >> np.uint64(44)).astype(np.int64)] = True

    def of(self, block: TextBlock) -> tuple[np.ndarray, np.ndarray]:
        """(text, number), distinct."""
        text, key = _features(block)
        near = np.flatnonzero(self.seen[(key >> np.uint64(44)).astype(np.int64)])
        text, key = text[near], key[near]
        at = np.minimum(np.searchsorted(self.keys, key), max(len(self.keys) - 1, 0))
        hit = self.keys[at] == key if len(self.keys) else np.zeros(len(key), bool)
        pair = np.unique(text[hit] * (1 << 20) + at[hit])
        return pair >> 20, pair & ((1 << 20) - 1)


def choose_features(sample: DataFrame, n_pos: int, n_unl: int, most: int) -> np.ndarray:
    """The features whose shares differ most, by a two-sample z score."""

    def count(block: TextBlock, rows: pa.RecordBatch) -> dict:
        text, key = _features(block)
        pos = np.asarray(rows.column(rows.schema.get_field_index("positive")))
        order = np.lexsort((text, key))
        text, key = text[order], key[order]
        one = np.flatnonzero(np.concatenate(([True], (key[1:] != key[:-1]) | (text[1:] != text[:-1]))))[: len(key)]
        text, key = text[one], key[one]
        head = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))[: len(key)]
        p = np.add.reduceat(pos[text].astype(np.int64), head) if len(head) else np.zeros(0, np.int64)
        n = np.diff(np.append(head, len(key)))
        # a list in each chunk's first row
        pad = np.concatenate(([0], np.full(block.n, len(head))))
        return {"key": ragged(key[head].view(np.int64), pad), "p": ragged(p, pad), "u": ragged(n - p, pad)}

    lists = map_texts(sample, count, "key array<long>, p array<long>, u array<long>").where("size(key) > 0")
    flat = lists.select(
        F.explode(F.arrays_zip("key", "p", "u")).alias("x"),
    ).groupBy("x.key").agg(F.sum("x.p").alias("p"), F.sum("x.u").alias("u")).where("p + u >= 4")
    a, b = F.col("p") / n_pos, F.col("u") / n_unl
    mid = (F.col("p") + F.col("u")) / (n_pos + n_unl)
    z = F.abs(a - b) / F.sqrt(F.greatest(mid * (1 - mid), F.lit(1e-9)) * (1.0 / n_pos + 1.0 / n_unl))
    top = flat.withColumn("z", z).orderBy(F.desc("z"), "key").limit(most).where("z > 3").select("key")
    return np.asarray(gather(top)["key"]).astype(np.int64).view(np.uint64)


def train(
    ptr: np.ndarray,
    feature: np.ndarray,
    positive: np.ndarray,
    n_features: int,
    prior: float,
    steps: int = 400,
    rate: float = 0.05,
    decay: float = 1e-4,
) -> tuple[np.ndarray, float]:
    """Weights and bias under the non-negative risk, by full-batch Adam."""
    n = len(positive)
    row = np.repeat(np.arange(n), np.diff(ptr))
    share = np.where(positive, 1 / max(1, positive.sum()), 1 / max(1, (~positive).sum()))
    w = np.zeros(n_features + 1)
    w[-1] = np.log(prior / (1 - prior))
    m, v = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, steps + 1):
        score = np.bincount(row, w[feature], minlength=n) + w[-1]
        up = 1 / (1 + np.exp(-np.clip(score, -30, 30)))
        soft = np.logaddexp(0, score)  # loss of the label -
        rest = (share * soft)[~positive].sum() - prior * (share * soft)[positive].sum()
        g = np.where(positive, -prior * up * share, up * share)  # of E_U[-] - pi E_P[-]
        if rest < 0:
            g = -g
        else:
            g = g + np.where(positive, prior * (up - 1) * share, 0)
        grad = np.append(np.bincount(feature, g[row], minlength=n_features), g.sum())
        grad[:-1] += decay * w[:-1]
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w[:-1], float(w[-1])


def fit(docs: DataFrame, labels: DataFrame, positives: int = 3000, unlabelled: int = 9000, features: int = 2048) -> tuple[np.ndarray, np.ndarray, float]:
    """Keys, weights and bias."""
    known = one_label(labels, "toxic").where(fold("doc_id", FOLDS) != HELD_OUT)
    total, toxic = known.agg(F.count("*"), F.sum(F.when(F.col("y") == 1, 1).otherwise(0))).first()
    if not toxic:
        return np.zeros(0, np.uint64), np.zeros(0), -np.inf
    prior = min(0.9, max(1e-3, toxic / total))
    pos = labelled_sample(labels, "toxic", positives, FOLDS, HELD_OUT).where("y = 1").select("doc_id", F.lit(True).alias("positive"))
    ids = docs.select("doc_id").where((fold("doc_id", FOLDS) != HELD_OUT) & F.col("doc_id").isNotNull()).distinct()
    unl = ids.withColumn(
        "h",
        F.xxhash64(F.lit("unlabelled"), "doc_id"),
    ).orderBy("h", "doc_id").limit(unlabelled).select("doc_id", F.lit(False).alias("positive"))
    # at most positives + unlabelled ids and rows; a fixed number of tasks for that many
    sample = materialise(one_text(docs, pos.unionByName(unl)).repartition(24, "doc_id"))
    sizes = {r["positive"]: r["n"] for r in sample.groupBy("positive").agg(F.count("*").alias("n")).collect()}
    n_pos, n_unl = sizes.get(True, 0), sizes.get(False, 0)
    if not n_pos or not n_unl:
        return np.zeros(0, np.uint64), np.zeros(0), -np.inf
    keys = np.sort(choose_features(sample, n_pos, n_unl, features))
    look = Lookup(keys)

    def rows(block: TextBlock, batch: pa.RecordBatch) -> dict:
        text, number = look.of(block)
        return {"f": ragged(number.astype(np.int32), np.searchsorted(text, np.arange(block.n + 1)))}

    got = gather(map_texts(sample, rows, "doc_id long, positive boolean, f array<int>").select("positive", "f", "doc_id"))
    order = np.lexsort((np.asarray(got["positive"]), np.asarray(got["doc_id"])))  # the same sums in any run
    got = got.take(pa.array(order))
    lists = got["f"].combine_chunks()
    ptr = np.concatenate(([0], np.cumsum(np.asarray(pa.compute.list_value_length(lists)))))
    weight, bias = train(ptr, np.asarray(lists.flatten()), np.asarray(got["positive"]), len(keys), prior)
    return keys, weight, bias


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, carry: tuple[str, ...] = (), **bounds: int) -> DataFrame:
    """doc_id, held_out, score, predicted, and the rows' own columns named by `carry`."""
    keys, weight, bias = fit(docs, labels, **bounds)
    look = Lookup(keys)

    def score(block: TextBlock) -> np.ndarray:
        text, number = look.of(block)
        s = np.bincount(text, weight[number], minlength=block.n) + bias if len(keys) else np.full(block.n, bias)
        with np.errstate(over="ignore"):
            return 1 / (1 + np.exp(-s))

    out = scored(carried(docs, carry), score)
    held_out = (fold("doc_id", FOLDS) == HELD_OUT).alias("held_out")
    predicted = (F.col("score") >= threshold).cast("int").alias("predicted")
    return out.select("doc_id", held_out, "score", predicted, *[c for c in carry if c != "doc_id"])


def op9_toxicity(spark, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
