"""Hierarchical Pitman-Yor language model over the whole corpus, and the log probability of every text.

Tokens are a text's words (blanks separate, A-Z in lower case) and one end.  The
root restaurant serves words over a base that is uniform over the known words,
with ``UNKNOWN_SHARE`` of it for the one outcome "any unknown word".  Context
restaurants, all children of the root, belong to the text's start and to each
word that stands before, whatever it is; they share the root as their parent.  A
table of a context restaurant is a customer of the root.

Seating is sampled by Gibbs sweeps: each dish's party gets up and is seated again
customer by customer (the last ones of large parties in small groups), given all
other parties as the sweep before left them: its own tables are out of its
restaurant's sum, and its customers and tables out of the root.  A sweep serves all parties at once, then every restaurant's sums are added up
anew.  Random numbers come from the hashes of word, context and sweep, so neither
the number of tasks nor the order of rows changes a score.  The score uses
predictive probabilities averaged over the seatings of the last sweeps.  Discounts
come from the counts of ones and twos, the strengths are fixed.

What moves: blocks of ``BLOCK_TOKENS`` tokens send their distinct words and pairs,
with counts, to owners of words, one for each ``OWNER_BYTES`` of text.  A word that
a sample shows to be frequent is split over several owners by its contexts; the
sample decides where pairs are kept, not what is computed.  Owners merge what they
get into a table that is bucketed by owner, so each sweep reads it without a
shuffle; between sweeps the sums of contexts, and of split words, are added up by
key and sent back.  Last, each owner returns the probabilities of what each block
holds, and the blocks, made again from the texts, add them up.  The texts must
therefore come in the same order twice, as a table's do; if not, an error is raised.

Defined results: a null or empty text is its end alone; without training texts
every token is unknown, and with no known word its probability is 1; repeated rows
count, and are scored, each; a very long text is one block, whole; equal texts of
one fold get equal scores; an empty table gives no rows; other columns are ignored;
a null id is of the fold of the empty text.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cuegrid.llm.stages import bucketed, emit_rows, fold, free_shuffles, gather, materialise, release, schema_of, table
from cuegrid.llm.textblock import chunks, crc_fold, mix

FOLDS, HELD_OUT = 7, 2
BLOCK_TOKENS, OWNER_BYTES = 3_000_000, 16_000_000
STRENGTH, UNKNOWN_SHARE = 1.0, 0.5
BURN_IN, SAMPLES = 1, 2
SINGLY = 64  # customers of a party up to twice this come one by one, then in groups of this part of those seated
SAMPLE = 64  # one of so many documents tells which words are frequent
END, START = np.uint64(0xE7D0F7E7D0F7), np.uint64(0x57A2757A2757A275)
SALT = np.uint64(0x9E3779B97F4A7C15)


def _pack(x: np.ndarray) -> bytes:
    """Non-negative integers in the width that the largest needs, which the first byte tells."""
    top = int(x.max()) if len(x) else 0
    width = next(w for w in (1, 2, 4, 8) if top < 1 << 8 * w)
    return bytes([width]) + x.astype(f"u{width}").tobytes()


def _unpack(b: bytes) -> np.ndarray:
    return np.frombuffer(b, f"u{b[0]}", offset=1).astype(np.int64)


def _pack_rising(x: np.ndarray) -> bytes:
    return _pack(np.diff(x, prepend=0))


def _unpack_rising(b: bytes) -> np.ndarray:
    return np.cumsum(_unpack(b))


def _context(h: np.ndarray) -> np.ndarray:
    """A context is known by 48 bits of its word's hash."""
    return h >> np.uint64(16)


def _pack_contexts(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(x.view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()


def _unpack_contexts(b: bytes) -> np.ndarray:
    out = np.zeros((len(b) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(b, np.uint8).reshape(-1, 6)
    return out.view(np.uint64).ravel()


def uniform(key: np.ndarray, seed: int, sweep: int, step: int | np.ndarray) -> np.ndarray:
    """A number in (0, 1) for a dish's key in a step of a sweep."""
    salt = mix(np.array([(seed << 20) + sweep + 1], np.uint64))
    x = mix(mix(key ^ salt) + np.atleast_1d(step).astype(np.uint64) * SALT)
    return ((x >> np.uint64(11)).astype(np.float64) + 0.5) / (1 << 53)


def pair_key(word: np.ndarray, context: np.ndarray) -> np.ndarray:
    return mix(word + mix(context + np.uint64(1)))


def _tokens(block) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each token, and the tokens of each text."""
    low = block.lowered()
    words, ptr = low.word_hash(), low.word_ptr
    return np.insert(words, ptr[1:], END), np.diff(ptr) + 1


class Layout:
    """Where pairs are kept: owners of words, and into how many shards frequent words are split.  keys: a number for each owner, so that hashing by it gives every partition one owner."""

    def __init__(self, owners: int, hot: dict[int, int], keys: list[int] | None = None):
        self.owners = owners
        self.keys = keys or [0] * owners
        self.words = np.array(sorted(hot), np.uint64)
        self.shards = np.array([hot[w] for w in sorted(hot)], np.int64)

    def home(self, words: np.ndarray) -> np.ndarray:
        return ((words >> np.uint64(33)).astype(np.int64) * self.owners) >> 31

    def split(self, words: np.ndarray) -> np.ndarray:
        """Shards of each word."""
        out = np.ones(len(words), np.int64)
        if len(self.words):
            at = np.minimum(np.searchsorted(self.words, words), len(self.words) - 1)
            out = np.where(self.words[at] == words, self.shards[at], 1)
        return out

    def place_of_contexts(self, contexts: np.ndarray) -> np.ndarray:
        return ((contexts >> np.uint64(17)).astype(np.int64) * self.owners) >> 31


def _blocks(layout: Layout, home: bool):
    """Rows of blocks: what their texts refer to (home), or what each owner of words gets of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        held: list[tuple] = []
        n = made = 0

        def flush() -> Iterator[dict]:
            nonlocal made
            ids = [x for h in held for x in h[0]]
            token, size, train = (np.concatenate([h[k] for h in held]) for k in (1, 2, 3))
            held.clear()
            words, word = np.unique(token, return_inverse=True)
            # the number of the block, by its place and what it holds
            held_hash = int(np.bitwise_xor.reduce(mix(token + np.arange(len(token), dtype=np.uint64))))
            number = mix(np.array([held_hash ^ (TaskContext.get().partitionId() << 24) + made], np.uint64)).view(np.int64)[0]
            made += 1
            at = np.searchsorted(words, START)
            names = np.insert(words, at, START)
            before = np.empty_like(word)
            before[1:] = word[:-1] + (word[:-1] >= at)
            before[np.cumsum(size) - size] = at  # each text's first token
            pairs, pair = np.unique(word * len(names) + before, return_inverse=True)
            of, ctx = pairs // len(names), _context(names[pairs % len(names)])
            owner, shards = layout.home(words)[of], layout.split(words)[of]
            if (shards > 1).any():
                owner = (owner + (ctx % shards.astype(np.uint64)).astype(np.int64)) % layout.owners
                order = np.argsort(owner, kind="stable")
                rank = np.empty_like(order)
                rank[order] = np.arange(len(order))
                of, ctx, owner, pair = of[order], ctx[order], owner[order], rank[pair]
            # an entry is a word with one owner
            first = np.flatnonzero(np.concatenate(([True], (of[1:] != of[:-1]) | (owner[1:] != owner[:-1]))))
            fan = np.diff(np.append(first, len(of)))
            if home:
                yield {"block": [number], "ids": [ids], "size": [size], "refs": [_pack(pair)], "fan": [_pack(fan)]}
                return
            count = np.bincount(pair, np.repeat(train, size), minlength=len(of)).astype(np.int64)
            cut = np.concatenate((np.flatnonzero(np.diff(owner[first], prepend=-1)), [len(first)]))
            p_cut = np.append(first, len(of))[cut]
            for a, b, c, d in zip(cut[:-1].tolist(), cut[1:].tolist(), p_cut[:-1].tolist(), p_cut[1:].tolist()):
                yield {
                    "key": [layout.keys[owner[c]]],
                    "owner": [owner[c]],
                    "block": [number],
                    "words": [words[of[first[a:b]]].tobytes()],
                    "fan": [_pack(fan[a:b])],
                    "ctx": [_pack_contexts(ctx[c:d])],
                    "cnt": [_pack(count[c:d])],
                }

        for batch in batches:
            train = crc_fold(batch.column(0), FOLDS) != HELD_OUT
            ids = batch.column(0).to_pylist()
            for i, j, block in chunks(batch.column(1)):
                held.append((ids[i:j], *_tokens(block), train[i:j]))
                n += len(held[-1][1])
                if n >= BLOCK_TOKENS:
                    yield from flush()
                    n = 0
        if held:
            yield from flush()

    return run


def _grouped(fn, key: str):
    """Call fn(key's value, rows) for the rows of each key, which follow each other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        rows: list[dict] = []
        for batch in batches:
            for r in batch.to_pylist():
                if rows and r[key] != rows[0][key]:
                    yield from fn(rows[0][key], rows)
                    rows = []
                rows.append(r)
        if rows:
            yield from fn(rows[0][key], rows)

    return run


def _merge(owner: int, rows: list[dict]) -> Iterator[dict]:
    """The messages of all blocks to an owner as one row."""
    words = [np.frombuffer(r["words"], np.uint64) for r in rows]
    ctx = [_unpack_contexts(r["ctx"]) for r in rows]
    names, word = np.unique(np.concatenate(words), return_inverse=True)
    contexts, c = np.unique(np.concatenate(ctx), return_inverse=True)
    code = np.repeat(word, np.concatenate([_unpack(r["fan"]) for r in rows])) * len(contexts) + c
    pairs, pair = np.unique(code, return_inverse=True)
    count = np.bincount(pair, np.concatenate([_unpack(r["cnt"]) for r in rows]), minlength=len(pairs)).astype(np.int64)
    w_cut, p_cut = np.cumsum([len(x) for x in words])[:-1], np.cumsum([len(x) for x in ctx])[:-1]
    yield {
        "key": [rows[0]["key"]], "owner": [owner], "words": [names.tobytes()], "fan": [
            _pack(np.bincount(pairs // len(contexts), minlength=len(names)))
        ], "contexts": [_pack_contexts(contexts)], "ctx": [_pack(pairs % len(contexts))], "cnt": [_pack(count)],
        "blocks": [[r["block"] for r in rows]], "word_of": [
            [_pack_rising(x) for x in np.split(word, w_cut)]
        ], "pair_of": [[_pack_rising(x) for x in np.split(pair, p_cut)]],
    }


STATE = "key int, owner int, words binary, fan binary, contexts binary, ctx binary, cnt binary, blocks array<long>, word_of array<binary>, pair_of array<binary>"


def binomial(n: np.ndarray, p: np.ndarray, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Successes of n trials for two uniform numbers: by inversion up to a mean of 16, above it by the normal law."""
    turned = p > 0.5
    q = np.where(turned, 1 - p, p)
    mean = n * q
    out = np.rint(mean + np.sqrt(mean * (1 - q) * -2 * np.log(u)) * np.cos(2 * np.pi * v))
    few = np.flatnonzero(mean <= 16)
    k, m, x, odds = np.zeros(len(few)), n[few], u[few], q[few] / (1 - q[few])
    mass = np.exp(m * np.log1p(-q[few]))
    upto, at = mass.copy(), 0
    while (more := (x > upto) & (k < m)).any() and at < 200:
        at += 1
        mass = mass * (m - at + 1) / at * odds
        upto = upto + mass
        k[more] = at
    out[few] = k
    out = np.clip(out, 0, n)
    return np.where(turned, n - out, out)


def seat(count: np.ndarray, others: np.ndarray, strength: float, discount: float, parent: np.ndarray, key: np.ndarray, seed: int, sweep: int) -> np.ndarray:
    """Tables of each party after its customers are seated: a new table weighs (strength + discount * all tables of the restaurant) * parent, the old ones the seated customers less a discount for each.  others: the tables of the other parties.

    The first customers come one by one; behind them come groups of a SINGLY-th of those
    seated, each with the weights that hold in its middle, so a party of any size takes
    a number of steps that grows with its logarithm only.
    """
    out = (count > 0).astype(np.int64)
    many = np.flatnonzero(count > 1)
    order = many[np.argsort(-count[many], kind="stable")]
    c, o, p, k = count[order], others[order], parent[order], key[order]
    t = np.ones(len(order))
    s = 1
    while n := int(np.searchsorted(-c, -s, "left")):  # parties with more than s customers
        group = max(1, s // SINGLY)
        take = np.minimum(group, c[:n] - s).astype(np.float64)
        x = s + (take - 1) / 2

        def opens(tables: np.ndarray, n: int = n, x: np.ndarray = x) -> np.ndarray:
            a = (strength + discount * (o[:n] + tables)) * p[:n]
            return a / (a + x - discount * tables)

        if group == 1:
            t[:n] += uniform(k[:n], seed, sweep, 2 * s) < opens(t[:n])
        else:
            middle = t[:n] + take * opens(t[:n]) / 2
            t[:n] += binomial(take, opens(middle), uniform(k[:n], seed, sweep, 2 * s), uniform(k[:n], seed, sweep, 2 * s + 1))
        s += group
    out[order] = t.astype(np.int64)
    return out


class Owner:
    """The pairs that one task owns, through the sweeps.  sums[k]: contexts' tables and split words' customers after sweep k; whole[k]: the root's customers and tables."""

    def __init__(self, row: dict, layout: Layout, model: dict):
        self.m, self.number = model, row["owner"]
        self.words, self.contexts = np.frombuffer(row["words"], np.uint64), _unpack_contexts(row["contexts"])
        self.of = np.repeat(np.arange(len(self.words)), _unpack(row["fan"]))
        self.ctx, self.count = _unpack(row["ctx"]), _unpack(row["cnt"])
        self.split = np.flatnonzero(layout.split(self.words) > 1)
        self.total = self.by_word(self.count)
        self.t = (self.count > 0).astype(np.int64)
        self.layout = layout

    def by_word(self, x: np.ndarray) -> np.ndarray:
        return np.bincount(self.of, x, minlength=len(self.words)).astype(np.int64)

    def by_context(self, x: np.ndarray) -> np.ndarray:
        return np.bincount(self.ctx, x, minlength=len(self.contexts)).astype(np.int64)

    def whole(self, *values: np.ndarray) -> np.ndarray:
        """Sums over pairs and over the words that aren't split."""
        return np.array([int(v.sum()) for v in values], np.int64)

    def unsplit(self, x: np.ndarray) -> np.ndarray:
        return np.delete(x, self.split)

    def learn(self, first: dict) -> None:
        """Take in the first sums: customers of contexts, all tables being one for each dish, and totals of split words."""
        self.customers, self.tables = first["ctx"]
        self.total[self.split] = first["word"][0]
        self.known = self.total > 0
        self.base = np.where(self.known, (1 - self.m["unknown"]) / max(1, self.m["V"]), self.m["unknown"])
        self.c0 = self.by_word(self.t)
        self.c0[self.split] = first["word"][1]
        self.t0 = self.known.astype(np.int64)
        self.key = pair_key(self.words[self.of], self.contexts[self.ctx])

    def sweep(self, k: int, whole: np.ndarray) -> None:
        """Sweep number k over the pairs, given the sums of the sweep before."""
        m, own = self.m, self.t
        c0 = self.c0[self.of] - own
        t0 = np.minimum(self.t0[self.of], c0)
        tables = whole[1] - (self.t0[self.of] - t0)
        parent = (c0 - m["d0"] * t0 + (STRENGTH + m["d0"] * tables) * self.base[self.of]) / (STRENGTH + whole[0] - own)
        self.t = seat(self.count, self.tables[self.ctx] - own, STRENGTH, m["d1"], parent, self.key, m["seed"], k)
        self.c0 = self.by_word(self.t)

    def root(self, k: int, whole: np.ndarray) -> None:
        self.t0 = seat(self.c0, whole[1] - self.t0, STRENGTH, self.m["d0"], self.base, self.words, self.m["seed"], k)

    def after(self, sums: dict, k: int, whole: np.ndarray) -> None:
        """Take in the sums of sweep k; whole: of the sweep before."""
        self.tables = sums["ctx"][0]
        self.c0[self.split] = sums["word"][0]
        self.root(k, whole)

    def predict(self, whole: np.ndarray) -> np.ndarray:
        m = self.m
        root = (self.c0 - m["d0"] * self.t0 + (STRENGTH + m["d0"] * whole[1]) * self.base) / (STRENGTH + whole[0])
        return (self.count - m["d1"] * self.t + (STRENGTH + m["d1"] * self.tables[self.ctx]) * root[self.of]) / (STRENGTH + self.customers[self.ctx])

    def asks(self, ctx: list[np.ndarray], word: list[np.ndarray], whole: np.ndarray) -> Iterator[dict]:
        """What goes to the places where sums are made: values by context and by split word; the whole goes to the driver."""
        none = {"key": [None], "place": [None], "contexts": [None], "ctx": [None], "words": [None], "word": [None]}
        yield none | {"owner": [self.number], "whole": [whole.tobytes()]}
        cut = np.searchsorted(self.layout.place_of_contexts(self.contexts), np.arange(self.layout.owners + 1))
        names = self.words[self.split]
        w_cut = np.searchsorted(self.layout.home(names), np.arange(self.layout.owners + 1))
        for g in np.flatnonzero((np.diff(cut) > 0) | (np.diff(w_cut) > 0)).tolist():
            a, b, c, d = cut[g], cut[g + 1], w_cut[g], w_cut[g + 1]
            yield {
                "key": [self.layout.keys[g]],
                "place": [g],
                "owner": [self.number],
                "whole": [None],
                "contexts": [_pack_contexts(self.contexts[a:b])],
                "ctx": [_pack(np.concatenate([v[a:b] for v in ctx]))],
                "words": [names[c:d].tobytes()],
                "word": [_pack(np.concatenate([v[self.split][c:d] for v in word]))],
            }


ASKS = "key int, place int, owner int, whole binary, contexts binary, ctx binary, words binary, word binary"
REPLIES = "key int, owner int, k int, place int, whole binary, ctx binary, word binary"


def _add(k: int, wholes, keys: list[int]):
    """Values added up over all owners, to each those it asked for, in its order; wholes(words, sums, last): the split words' share of the whole."""

    def add(place: int, rows: list[dict]) -> Iterator[dict]:
        out, names = {}, {}
        for key, kind, read in (("contexts", "ctx", _unpack_contexts), ("words", "word", lambda b: np.frombuffer(b, np.uint64))):
            asked = [read(r[key]) for r in rows]
            names[kind], at = np.unique(np.concatenate(asked), return_inverse=True)
            cut = np.cumsum([0, *map(len, asked)])
            n = max((len(_unpack(r[kind])) // len(x) for r, x in zip(rows, asked) if len(x)), default=0)
            sums, last = np.zeros((n, len(names[kind])), np.int64), np.zeros((n, len(names[kind])), np.int64)
            for r, x, a, b in zip(rows, asked, cut, cut[1:]):
                if len(x):
                    v = _unpack(r[kind]).reshape(n, -1)
                    sums[:, at[a:b]] += v  # a key once in each row
                    last[:, at[a:b]] = v
            out[kind] = sums, last, at, cut
        whole = wholes(names["word"], *out["word"][:2]).tobytes() if len(names["word"]) else None
        for i, r in enumerate(rows):
            # of split words the tables go back once only
            packed = {kind: [_pack(sums[: 1 if k else 2, at[cut[i] : cut[i + 1]]].ravel())] for kind, (sums, _, at, cut) in out.items()}
            yield {"key": [keys[r["owner"]]], "owner": [r["owner"]], "k": [k], "place": [place], "whole": [whole if not i else None]} | packed

    return _grouped(add, "place")


def _sums(replies: list[dict], k: int, rows: int) -> dict[str, list[np.ndarray]]:
    """The replies after sweep k, in the order of the keys."""
    mine = sorted((r for r in replies if r["k"] == k), key=lambda r: r["place"])
    return {
        kind: np.concatenate(
            [np.zeros((rows, 0), np.int64), *[_unpack(r[kind]).reshape(rows, -1) for r in mine if len(r[kind]) > 1]],
            axis=1,
        ) for kind in ("ctx", "word")
    }


def _total(*frames: DataFrame) -> np.ndarray:
    """The sums of the whole: a row for each owner and place reaches the driver."""
    out = np.zeros(8, np.int64)
    for f in frames:
        for x in gather(f.where("whole IS NOT NULL").select("whole")).column(0).to_pylist():
            v = np.frombuffer(x, np.int64)
            out[: len(v)] += v
    return out


def _even_keys(spark: SparkSession, n: int) -> list[int]:
    """For each of n partitions a number that Spark's hash deals to it; n rows reach the driver."""
    found: dict[int, int] = {}
    size = 16 * n + 64
    while len(found) < n:
        numbers = spark.range(size).select(F.col("id").cast("int").alias("key"))
        found = {r["p"]: r["key"] for r in numbers.groupBy(F.pmod(F.hash("key"), F.lit(n)).alias("p")).agg(F.min("key").alias("key")).collect()}
        size *= 2
    return [found[p] for p in range(n)]


def _discount(ones: int, twos: int) -> float:
    return min(0.95, max(0.05, ones / max(1, ones + 2 * twos)))


def _layout(docs: DataFrame, owner_bytes: int) -> Layout:
    """One owner for each `owner_bytes` of text; words that a sample shows to have more than a quarter of an owner's share are split.  4 words for each owner reach the driver at most."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    owners = max(1, math.ceil(size / owner_bytes))
    if owners == 1:
        return Layout(1, {})

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            for _, _, block in chunks(batch.column(1)):
                words, n = np.unique(_tokens(block)[0], return_counts=True)
                yield {"word": np.append(words.view(np.int64), 0), "n": np.append(n, n.sum())}

    sample = docs.where(fold("doc_id", SAMPLE) == 0)
    counted = materialise(emit_rows(sample, count, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")))
    total = (counted.where("word = 0").agg(F.sum("n")).first()[0]) or 0
    hot = {}
    if total:
        for r in counted.where((F.col("word") != 0) & (F.col("n") * 4 * owners > total)).collect():
            if (k := min(owners, math.ceil(2 * owners * r["n"] / total))) > 1:
                hot[r["word"] & ((1 << 64) - 1)] = k
    release(counted)
    return Layout(owners, hot, _even_keys(docs.sparkSession, owners))


def score(docs: DataFrame, seed: int = 17, owner_bytes: int = OWNER_BYTES) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity."""
    spark = docs.sparkSession
    docs = docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text")
    layout = _layout(docs, owner_bytes)
    n = layout.owners
    keys = emit_rows(docs, _blocks(layout, False), "key int, owner int, block long, words binary, fan binary, ctx binary, cnt binary")
    state = bucketed(emit_rows(keys.repartition(n, "key").sortWithinPartitions("owner", "block"), _grouped(_merge, "owner"), STATE), n, "key")
    del keys
    free_shuffles(spark)
    sweeps = BURN_IN + SAMPLES
    model = {"seed": seed, "d0": 0.5, "d1": 0.5, "V": 0, "unknown": 1.0}
    whole: list[np.ndarray] = []
    replies: list[DataFrame] = []

    def exchange(asked: DataFrame, k: int, wholes) -> np.ndarray:
        asked = materialise(asked)
        dealt = asked.where("place IS NOT NULL").drop("whole").repartition(n, "key").sortWithinPartitions("place", "owner")
        replies.append(materialise(emit_rows(dealt, _add(k, wholes, layout.keys), REPLIES)))
        out = _total(asked, replies[-1])
        release(asked)
        return out

    def ones_twos(x: np.ndarray) -> list[np.ndarray]:
        return [x == 1, x == 2]

    def begin(_, rows: list[dict]) -> Iterator[dict]:
        for row in rows:
            o = Owner(row, layout, model)
            dishes = o.by_word(o.t)
            totals = o.unsplit(o.total)
            sums = o.whole(o.t, totals > 0, o.count, totals > 0, *ones_twos(totals), *ones_twos(o.count))
            yield from o.asks([o.by_context(o.count), o.by_context(o.t)], [o.total, dishes], sums)

    def begin_split(_: np.ndarray, sums: np.ndarray, __: np.ndarray) -> np.ndarray:
        total = sums[0]
        return np.array([0, (total > 0).sum(), 0, (total > 0).sum(), (total == 1).sum(), (total == 2).sum()], np.int64)

    got = exchange(emit_rows(state.select("key", "owner", "words", "fan", "contexts", "ctx", "cnt"), _grouped(begin, "owner"), ASKS), 0, begin_split)
    n_train, v, w1, w2, p1, p2 = got[2:].tolist()
    whole.append(got[:2])
    model |= {"V": v, "d0": _discount(w1, w2), "d1": _discount(p1, p2), "unknown": UNKNOWN_SHARE if v else 1.0}

    def replay(rows: list[dict], got: list[dict], upto: int) -> Iterator[Owner]:
        """An owner after each of the sweeps, from 0, with its sums; the last one as it is before they are made, if they aren't known."""
        o = Owner(rows[0], layout, model)
        o.learn(_sums(got, 0, 2))
        yield o
        for k in range(1, upto + 1):
            o.sweep(k, whole[k - 1])
            if k < len(whole):
                o.after(_sums(got, k, 1), k, whole[k - 1])
            yield o

    def both(fn, ddl: str, columns: list[str]) -> DataFrame:
        """fn(owner's row, its replies) for each owner: the state isn't shuffled."""
        kind, arrow = schema_of(ddl)

        def call(left: pa.Table, right: pa.Table) -> pa.Table:
            made = [pa.table([pa.array(r[f.name], f.type) for f in arrow], schema=arrow) for r in fn(left.to_pylist(), right.to_pylist())] if len(left) else []
            return pa.concat_tables(made) if made else arrow.empty_table()

        got = replies[0]
        for r in replies[1:]:
            got = got.unionByName(r)
        return state.select(*columns).groupBy("key").cogroup(got.drop("whole").groupBy("key")).applyInArrow(call, kind)

    for k in range(1, sweeps + 1):

        def sweep(rows: list[dict], got: list[dict], k: int = k) -> Iterator[dict]:
            o = list(replay(rows, got, k))[-1]
            last = o.t0.copy()
            own = o.c0.copy()  # the root's customers from here
            o.root(k, whole[k - 1])
            yield from o.asks([o.by_context(o.t)], [own, last], o.whole(o.t, o.unsplit(o.t0)))

        def split(words: np.ndarray, sums: np.ndarray, last: np.ndarray, k: int = k) -> np.ndarray:
            base = np.full(len(words), (1 - model["unknown"]) / max(1, model["V"]))
            t0 = seat(sums[0], whole[k - 1][1] - last[1], STRENGTH, model["d0"], base, words, seed, k)
            return np.array([0, t0.sum()], np.int64)

        whole.append(exchange(both(sweep, ASKS, ["key", "owner", "words", "fan", "contexts", "ctx", "cnt"]), k, split)[:2])
    free_shuffles(spark)

    def answer(rows: list[dict], got: list[dict]) -> Iterator[dict]:
        pair = 0
        for k, o in enumerate(replay(rows, got, sweeps)):
            if k > BURN_IN:
                pair = pair + o.predict(whole[k]) / SAMPLES
        pair = np.log10(pair).astype(np.float32)
        for block, w, p in zip(rows[0]["blocks"], rows[0]["word_of"], rows[0]["pair_of"]):
            yield {"block": [block], "owner": [rows[0]["owner"]], "total": [_pack(o.total[_unpack_rising(w)])], "pair": [pair[_unpack_rising(p)].tobytes()]}

    answers = both(answer, "block long, owner int, total binary, pair binary", [f.split()[0] for f in STATE.split(", ")])
    kind, arrow = schema_of("doc_id long, n_tokens long, n_known long, base_score double, score double")

    def finish(home: pa.Table, got: pa.Table) -> pa.Table:
        if len(home) != 1 or not len(got):
            raise ValueError("the documents came in another order when they were read again; write them to a table first")
        h = home.to_pylist()[0]
        got = sorted(got.to_pylist(), key=lambda x: x["owner"])
        total = np.concatenate([_unpack(x["total"]) for x in got])
        pair = np.concatenate([np.frombuffer(x["pair"], np.float32) for x in got])
        ref, size = _unpack(h["refs"]), np.array(h["size"], np.int64)
        c = np.repeat(total, _unpack(h["fan"]))
        head = np.cumsum(size) - size
        base = np.log10((c + 1) / (n_train + v + 1))
        cols = [
            h["ids"],
            size,
            np.add.reduceat((c > 0)[ref].astype(np.int64), head),
            np.add.reduceat(base[ref], head),
            np.add.reduceat(pair.astype(np.float64)[ref], head),
        ]
        return pa.table([pa.array(x, f.type) for x, f in zip(cols, arrow)], schema=arrow)

    home = emit_rows(docs, _blocks(layout, True), "block long, ids array<long>, size array<long>, refs binary, fan binary")
    done = home.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(finish, kind)
    return done.select(
        "doc_id",
        (fold("doc_id", FOLDS) == HELD_OUT).alias("held_out"),
        "n_tokens",
        "n_known",
        F.lit(n_train).cast("long").alias("train_tokens"),
        "base_score",
        "score",
        F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")).alias("perplexity"),
    )


def op6_language_model(spark, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"))
