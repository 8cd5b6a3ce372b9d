"""Quality classifier: random-indexing vectors pooled per document, a two-layer network, calibrated by temperature.

Every word, whatever it is, has an index vector: sparse, ternary and fixed by its
hash.  The vocabulary is the ``WORDS`` words that most documents of the labelled
sample hold; each of them has a context vector of its own, and so has each shape
(kinds of a word's first, second and last byte, and its length), which stands for
all words, known or not.  A context vector is the sum, over all documents, of the
index vectors of the neighbours up to two words away.  The sums are integers, so
they do not depend on the order of tasks; what they need is bounded by the
vocabulary, not by the corpus.  A document pools the context vectors, scaled to unit
length, of its words and of its shapes (means, deviations and the lengths of the
means) and its words' index vectors, which rare words have too (the length of their
mean, and how many are equal to a neighbour).  The network is trained by numpy on at most ``per_class``
documents of each label outside the held-out fold, weighted to the label shares of
all; a fifth of them sets the temperature.

Defined results: a null or empty text pools to zeros and gets the network's score
for them; a very long text is pooled whole; equal texts get equal scores; words that
occur in equally many documents are ordered by their hash; without labels of both
kinds every score is the share of label 1 (1 if there is none); an empty table gives
no rows; extra columns are ignored; repeated ids are scored row by row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuegrid.llm.stages import carried, emit_rows, fold, gather, labelled_sample, map_texts, materialise, one_label, one_text, ragged, scored, table
from cuegrid.llm.textblock import TextBlock, chunks

FOLDS, HELD_OUT = 5, 0
DIM, WORDS, SHAPES = 32, 1 << 16, 6 * 6 * 6 * 8
PATTERNS = 1 << 14  # index vectors to choose from
PARTS = 64  # the context matrix travels in so many pieces


def _kinds() -> np.ndarray:
    def kind(b: int) -> int:
        c = chr(b)
        return 5 if b >= 128 else 0 if c.islower() else 1 if c.isupper() else 2 if c.isdigit() else 3 if c in ".,;:'" else 4

    return np.array([kind(b) for b in range(256)])


_KIND = _kinds()


def index_vectors() -> np.ndarray:
    """Two entries of +1 and two of -1 in each pattern, at seeded places."""
    rng = np.random.default_rng(5)
    place = rng.random((PATTERNS, DIM)).argsort(axis=1)[:, :4]
    out = np.zeros((PATTERNS, DIM), np.int16)
    for k, sign in enumerate((1, 1, -1, -1)):
        out[np.arange(PATTERNS), place[:, k]] = sign
    return out


class Vocabulary:
    """Hashes of the known words, sorted, and a table of where those of the first 20 bits begin."""

    def __init__(self, keys: np.ndarray):
        self.keys = np.sort(keys)
        self.first = np.searchsorted(self.keys >> np.uint64(44), np.arange((1 << 20) + 1, dtype=np.uint64)).astype(np.int32)
        self.size = len(self.keys)

    def slots(self, words: np.ndarray) -> np.ndarray:
        """The number of each word; `size` for those that aren't known."""
        top = (words >> np.uint64(44)).astype(np.int64)
        at, stop = self.first[top], self.first[top + 1]
        out = np.full(len(words), self.size, np.int64)
        open_ = np.flatnonzero(at < stop)
        while len(open_):
            hit = self.keys[at[open_]] == words[open_]
            out[open_[hit]] = at[open_[hit]]
            open_ = open_[~hit]
            at[open_] += 1
            open_ = open_[at[open_] < stop[open_]]
        return out


def shapes(block: TextBlock) -> np.ndarray:
    size = block.end - block.start
    first, last = _KIND[block.data[block.start]], _KIND[block.data[block.end - 1]]
    second = _KIND[block.data[np.minimum(block.start + 1, block.end - 1)]]
    return ((first * 6 + second) * 6 + last) * 8 + np.minimum(size, 8) - 1


def _contexts(block: TextBlock, known: Vocabulary, index: np.ndarray, total: np.ndarray) -> None:
    """Add to total what the neighbours in the block give."""
    hashes = block.word_hash()
    n = len(hashes)
    if n < 2:
        return
    own = index[(hashes & np.uint64(PATTERNS - 1)).astype(np.int64)]
    text = block.text_of(block.word_ptr)
    near = np.zeros((n, DIM), np.int16)
    for k in (1, 2):
        if n > k:
            a, b = own[:-k], own[k:]
            if (other := np.flatnonzero(text[k:] != text[:-k])).size:
                a, b = a.copy(), b.copy()
                a[other] = b[other] = 0
            near[k:] += a
            near[:-k] += b
    word, shape = known.slots(hashes), known.size + 1 + shapes(block)
    for slot, keep in ((word, word < known.size), (shape, None)):
        at = np.argsort(slot, kind="stable") if keep is None else np.flatnonzero(keep)[np.argsort(slot[keep], kind="stable")]
        if not len(at):
            continue
        ids = slot[at]
        head = np.flatnonzero(np.concatenate(([True], ids[1:] != ids[:-1])))
        total[ids[head]] += np.add.reduceat(near[at], head, axis=0, dtype=np.int64)


def vocabulary(sample: DataFrame, most: int = WORDS) -> Vocabulary:
    """The words that most documents of the sample hold, two at least."""

    def count(block: TextBlock, _: pa.RecordBatch) -> dict:
        hashes, text = block.word_hash(), block.text_of(block.word_ptr)
        order = np.lexsort((text, hashes))
        hashes, text = hashes[order], text[order]
        one = np.ones(len(hashes), bool)
        one[1:] = (hashes[1:] != hashes[:-1]) | (text[1:] != text[:-1])
        words, n = np.unique(hashes[one], return_counts=True)
        pad = np.concatenate(([0], np.full(block.n, len(words))))  # a list in each chunk's first row
        return {"key": ragged(words.view(np.int64), pad), "n": ragged(n, pad)}

    lists = map_texts(sample, count, "key array<long>, n array<long>").where("size(key) > 0")
    top = lists.select(
        F.explode(F.arrays_zip("key", "n")).alias("x"),
    ).groupBy("x.key").agg(F.sum("x.n").alias("n")).where("n > 1").orderBy(F.desc("n"), "key").limit(most)
    return Vocabulary(np.asarray(gather(top.select("key"))["key"]).astype(np.int64).view(np.uint64))


def word_vectors(docs: DataFrame, known: Vocabulary) -> np.ndarray:
    """Unit context vectors of all known words (then a row of zeros) and shapes, over all documents."""
    n = known.size + 1 + SHAPES

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        total, index, any_row = np.zeros((n, DIM), np.int64), index_vectors(), False
        for batch in batches:
            for _, _, block in chunks(batch.column(0)):
                _contexts(block, known, index, total)
                any_row = True
        if any_row:
            kind = np.int32 if abs(total).max() < 1 << 31 else np.int64
            yield {"part": np.arange(PARTS, dtype=np.int32), "sums": [x.astype(kind).tobytes() for x in np.array_split(total, PARTS)]}

    rows_of = [len(x) for x in np.array_split(np.arange(n), PARTS)]

    def read(part: int, sums: bytes) -> np.ndarray:
        size = rows_of[part] * DIM
        return np.frombuffer(sums, np.int64 if len(sums) == 8 * size else np.int32).astype(np.int64)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, sums in zip(batch.column(0).to_pylist(), batch.column(1)):
                x = read(part, sums.as_buffer())
                held[part] = held[part] + x if part in held else x
        if held:
            yield {"part": list(held), "sums": [x.tobytes() for x in held.values()]}

    ddl = "part int, sums binary"
    # PARTS rows of fixed size reach the driver: (WORDS + SHAPES) * DIM numbers, 17 MB at most
    rows = gather(emit_rows(emit_rows(docs.select("text"), emit, ddl).repartition(PARTS, "part"), merge, ddl)).to_pylist()
    if not rows:
        return np.zeros((n, DIM), np.float32)
    total = np.concatenate([read(r["part"], r["sums"]) for r in sorted(rows, key=lambda r: r["part"])]).reshape(n, DIM).astype(np.float64)
    norm = np.sqrt((total**2).sum(axis=1, keepdims=True))
    return (total / np.maximum(norm, 1)).astype(np.float32)


WIDTH = 4 * DIM + 5


def pooled(block: TextBlock, known: Vocabulary, vectors: np.ndarray, index: np.ndarray) -> np.ndarray:
    """Of each text: means, deviations and the length of the mean (long where few words repeat) of its words' and of its shapes' context vectors; the length of the mean of its words' index vectors, and how many of them stand one and two words before an equal one."""
    out = np.zeros((block.n, WIDTH), np.float32)
    full = np.flatnonzero(block.n_words)
    if len(full):
        head, n = block.word_ptr[:-1][full], block.n_words[full, None]
        hashes = block.word_hash()
        for k, slot in enumerate((known.slots(hashes), known.size + 1 + shapes(block))):
            v = vectors[slot]
            mean = np.add.reduceat(v, head, axis=0) / n
            out[full, 2 * k * DIM : (2 * k + 1) * DIM] = mean
            out[full, (2 * k + 1) * DIM : (2 * k + 2) * DIM] = np.sqrt(np.maximum(np.add.reduceat(v * v, head, axis=0) / n - mean**2, 0))
            out[full, 4 * DIM + k] = np.sqrt((mean**2).sum(axis=1))
        pattern = (hashes & np.uint64(PATTERNS - 1)).astype(np.int64)
        mean = np.add.reduceat(index[pattern], head, axis=0, dtype=np.int64) / n
        out[full, 4 * DIM + 2] = np.sqrt((mean**2).sum(axis=1))
        text = block.text_of(block.word_ptr)
        for k in (1, 2):
            same = (pattern[k:] == pattern[:-k]) & (text[k:] == text[:-k])
            out[:, 4 * DIM + 2 + k] = np.bincount(text[k:][same], minlength=block.n) / np.maximum(block.n_words, 1)
    return out


class Network:
    """Two layers; score = sigmoid(output / temperature)."""

    def __init__(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray, hidden: int = 32, epochs: int = 60, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.mid, self.scale = x.mean(axis=0), x.std(axis=0) + 1e-6
        x = (x - self.mid) / self.scale
        held = rng.random(len(x)) < 0.2
        if held.all() or not held.any() or len(set(y[~held])) < 2:
            held[:] = False
        p = [rng.normal(0, x.shape[1] ** -0.5, (x.shape[1], hidden)), np.zeros(hidden), rng.normal(0, hidden**-0.5, hidden), np.zeros(1)]
        m, v = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p]
        rows, t = np.flatnonzero(~held), 0
        for _ in range(epochs):
            rng.shuffle(rows)
            for i in range(0, len(rows), 256):
                b = rows[i : i + 256]
                h = np.tanh(x[b] @ p[0] + p[1])
                d = (1 / (1 + np.exp(-np.clip(h @ p[2] + p[3], -30, 30))) - y[b]) * weight[b] / len(b)
                back = np.outer(d, p[2]) * (1 - h * h)
                g = [x[b].T @ back + 1e-4 * p[0], back.sum(axis=0), h.T @ d + 1e-4 * p[2], np.array([d.sum()])]
                t += 1
                for k in range(4):
                    m[k] = 0.9 * m[k] + 0.1 * g[k]
                    v[k] = 0.999 * v[k] + 0.001 * g[k] ** 2
                    p[k] -= 0.003 * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
        self.p, self.temperature = p, 1.0
        if held.any():
            z, yy, ww = self._raw(x[held]), y[held], weight[held]
            grid = np.exp(np.linspace(-1.5, 2.5, 81))
            self.temperature = float(min(grid, key=lambda g: (ww * (np.logaddexp(0, z / g) - yy * z / g)).sum()))

    def _raw(self, x: np.ndarray) -> np.ndarray:
        return np.tanh(x @ self.p[0] + self.p[1]) @ self.p[2] + self.p[3]

    def score(self, x: np.ndarray) -> np.ndarray:
        z = self._raw((x - self.mid) / self.scale) / self.temperature
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def fit(docs: DataFrame, labels: DataFrame, per_class: int = 5000) -> tuple[Vocabulary, np.ndarray, Network | float]:
    known = one_label(labels, "quality").where((fold("doc_id", FOLDS) != HELD_OUT) & F.col("y").isin(0, 1))
    sizes = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    none = Vocabulary(np.zeros(0, np.uint64))
    blank = np.zeros((1 + SHAPES, DIM), np.float32)
    if len(sizes) < 2:
        return none, blank, float(0 not in sizes)
    # at most 2 * per_class ids and rows; a fixed number of tasks for that many
    sample = materialise(one_text(docs, labelled_sample(labels, "quality", per_class, FOLDS, HELD_OUT)).repartition(24, "doc_id"))
    words = vocabulary(sample)
    vectors = word_vectors(docs, words)
    index = index_vectors()

    def rows(block: TextBlock, _: pa.RecordBatch) -> dict:
        return {"x": ragged(pooled(block, words, vectors, index).ravel(), np.arange(block.n + 1) * WIDTH)}

    got = gather(map_texts(sample, rows, "doc_id long, y int, x array<float>"))
    if not len(got):
        return words, vectors, float(sizes[1] / (sizes[0] + sizes[1]))
    y = np.asarray(got["y"])
    x = np.asarray(got["x"].combine_chunks().flatten()).reshape(len(y), WIDTH).astype(np.float64)
    order = np.lexsort((*x.T[:3], np.asarray(got["doc_id"])))  # the same training in any run
    x, y = x[order], y[order]
    n = np.maximum(np.bincount(y, minlength=2), 1)
    weight = np.array([sizes[0] / n[0], sizes[1] / n[1]])
    weight *= len(y) / weight[y].sum()
    if len(set(y)) < 2:
        return words, vectors, float(y[0])
    return words, vectors, Network(x, y.astype(np.float64), weight[y])


def quality_classifier(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, per_class: int = 5000, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, held_out, score, predicted, and the rows' own columns named by `carry`."""
    rows = carried(docs, carry)
    words, vectors, model = fit(rows, labels, per_class)
    index = index_vectors()

    def score(block: TextBlock) -> np.ndarray:
        return np.full(block.n, model) if isinstance(model, float) else model.score(pooled(block, words, vectors, index).astype(np.float64))

    out = scored(rows, score)
    held_out = (fold("doc_id", FOLDS) == HELD_OUT).alias("held_out")
    predicted = (F.col("score") >= threshold).cast("int").alias("predicted")
    return out.select("doc_id", held_out, "score", predicted, *[c for c in carry if c != "doc_id"])


def op5_quality_classifier(spark, sf_dir: str) -> DataFrame:
    return quality_classifier(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
