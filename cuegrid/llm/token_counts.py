"""Token counts of a piece BPE by rank-synchronous merging of ragged arrays.

A text is cut before each run of blanks (0x20, the word mark); no piece of the
vocabulary crosses such a cut, so the counts of the cut pre-tokens add up to
that of the text.  Distinct pre-tokens of a batch become one ragged array of
symbols.  Each round finds the lowest rank among the adjacent pairs of every
sequence and merges that pair in all sequences at once, leftmost first; a
sequence is done when none of its pairs has a rank.  What survives is counted:
one for a symbol of the vocabulary, its UTF-8 bytes for a character outside it.

Counts of pre-tokens are kept in a table of bounded size, so repeated words are
merged once per worker.  The settings of the model that this relies on are checked.
Defined results: a null or empty text has 0 tokens; very long texts are counted
whole; equal texts have equal counts, repeated rows one each; an empty table gives
no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from cuegrid.llm.stages import schema_of, table
from cuegrid.llm.textblock import TextBlock, chunks, mix

MARK = "▁"
KEPT = 1 << 21  # pre-tokens remembered by a worker: 8 + 4 bytes each


class PieceRanks:
    """Ranks of the merges of a piece vocabulary: symbols are numbered, `pairs` is sorted by (left, right)."""

    def __init__(self, pieces: list[tuple[str, float]]):
        self.number = {p: i for i, (p, _) in enumerate(pieces)}
        scores = np.array([s for _, s in pieces])
        # equal scores share a rank, so that ties are settled by position
        rank = np.unique(-scores, return_inverse=True)[1]
        left, right, made = [], [], []
        for p, i in self.number.items():
            for k in range(1, len(p)):
                a, b = self.number.get(p[:k]), self.number.get(p[k:])
                if a is not None and b is not None:
                    left.append(a), right.append(b), made.append(i)
        # characters outside the vocabulary never merge
        self.size = len(pieces)
        key = np.array(left, np.int64) * self.size + np.array(right, np.int64)
        order = np.argsort(key)
        self.key, self.made = key[order], np.array(made, np.int32)[order]
        self.rank = rank[self.made].astype(np.int32)
        # direct table for lookups: open addressing on a power of two
        self.bits = int(2 * len(key)).bit_length()
        self.slot = np.full(1 << self.bits, -1, np.int32)
        left_over = np.arange(len(key))
        at = self._hash(self.key)
        while len(left_over):
            free = self.slot[at] < 0
            self.slot[at[free]] = left_over[free]
            stay = self.slot[at] != left_over
            left_over, at = left_over[stay], (at[stay] + 1) & ((1 << self.bits) - 1)

    def _hash(self, key: np.ndarray) -> np.ndarray:
        return (mix(key.astype(np.uint64)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The merge of each pair of symbols; -1 where there is none."""
        out = np.full(len(left), -1, np.int32)
        todo = np.flatnonzero((left >= 0) & (right >= 0))
        key = left[todo].astype(np.int64) * self.size + right[todo]
        at = self._hash(key)
        while len(todo):
            got = self.slot[at]
            hit = (got >= 0) & (self.key[got] == key)
            out[todo[hit]] = got[hit]
            go = ~hit & (got >= 0)
            todo, key, at = todo[go], key[go], (at[go] + 1) & ((1 << self.bits) - 1)
        return out

    def counts(self, words: list[str]) -> np.ndarray:
        """Symbols that survive of each word."""
        n = np.array([len(w) for w in words], np.int64)
        text = "".join(words)
        points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        kinds, back = np.unique(points, return_inverse=True)
        of = np.array([self.number.get(chr(c), -1) for c in kinds], np.int32)
        width = np.array([len(chr(c).encode()) for c in kinds], np.int64)
        symbol, owner = of[back], np.repeat(np.arange(len(words)), n)
        total = np.bincount(owner, np.where(symbol < 0, width[back], 0), minlength=len(words)).astype(np.int64)
        done = np.zeros(len(words), np.int64)
        pair = self.find(symbol[:-1], symbol[1:]) if len(symbol) > 1 else np.zeros(0, np.int32)
        pair[owner[:-1] != owner[1:]] = -1
        none = np.iinfo(np.int32).max
        while len(symbol):
            rank = np.append(np.where(pair >= 0, self.rank[pair], none), none).astype(np.int32)
            start = np.flatnonzero(np.diff(owner, prepend=-1))
            low = np.minimum.reduceat(rank, start)
            length = np.diff(np.append(start, len(symbol)))
            over = low == none
            if over.any():  # these sequences are merged out: count and drop them
                gone = np.repeat(over, length)
                done += np.bincount(owner[gone & (symbol >= 0)], minlength=len(words))
                keep = ~gone
                symbol, owner, rank = symbol[keep], owner[keep], rank[keep]
                pair = pair[keep[:-1]] if len(keep) == len(pair) + 1 else pair
                pair = pair[: max(len(symbol) - 1, 0)]
                low, length = low[~over], length[~over]
                start = np.concatenate(([0], np.cumsum(length)[:-1])) if len(length) else length
                if not len(symbol):
                    break
            # the leftmost pair of the lowest rank, and all equal pairs that don't touch one taken before
            hot = np.flatnonzero(rank == np.repeat(low, length))
            lead = hot[np.searchsorted(hot, start)]
            which = np.full(len(symbol), -1, np.int32)
            which[: len(pair)] = pair
            take = hot[which[hot] == np.repeat(which[lead], length)[hot]]
            run = np.flatnonzero(np.diff(take, prepend=-2) != 1)
            place = np.arange(len(take)) - np.repeat(run, np.diff(np.append(run, len(take))))
            take = take[place % 2 == 0]
            symbol = symbol.copy()
            symbol[take] = self.made[which[take]]
            keep = np.ones(len(symbol), bool)
            keep[take + 1] = False
            changed = np.zeros(len(symbol), bool)
            changed[take] = True
            symbol, owner, changed, which = symbol[keep], owner[keep], changed[keep], which[keep]
            pair = which[:-1]
            again = np.flatnonzero((changed[:-1] | changed[1:]))
            if len(again):
                made = self.find(symbol[again], symbol[again + 1])
                made[owner[again] != owner[again + 1]] = -1
                pair = pair.copy()
                pair[again] = made
        return total + done


@lru_cache(2)
def load(path: str) -> PieceRanks:
    from sentencepiece import sentencepiece_model_pb2

    model = sentencepiece_model_pb2.ModelProto()
    with open(path, "rb") as f:
        model.ParseFromString(f.read())
    kinds = model.SentencePiece
    how, normal = model.trainer_spec, model.normalizer_spec
    expected = {
        "a BPE model": how.model_type == how.BPE,
        "byte fallback": how.byte_fallback,
        "blanks as a prefix": not how.treat_whitespace_as_suffix,
        "no normalisation": not normal.precompiled_charsmap,
        "a mark before the text": normal.add_dummy_prefix,
        "all blanks kept": not normal.remove_extra_whitespaces,
        "blanks as marks": normal.escape_whitespaces,
    }
    expected["no piece across a blank"] = all(MARK not in p.piece.lstrip(MARK) for p in model.pieces if p.type in (kinds.NORMAL, kinds.USER_DEFINED))
    if missing := [k for k, v in expected.items() if not v]:
        raise ValueError(f"{path}: the counts rely on {', '.join(missing)}")
    return PieceRanks([(p.piece, p.score) for p in model.pieces if p.type in (kinds.NORMAL, kinds.USER_DEFINED)])


class Counter:
    """Counts of texts, with the counts of pre-tokens seen before."""

    def __init__(self, ranks: PieceRanks):
        self.ranks = ranks
        self.key, self.value = np.zeros(0, np.uint64), np.zeros(0, np.int32)

    def of(self, texts: TextBlock) -> np.ndarray:
        blank = texts.data == 0x20
        # a pre-token starts at a blank behind a non-blank, and where a text starts
        first = np.zeros(len(blank), bool)
        first[1:] = blank[1:] & ~blank[:-1]
        size = np.diff(texts.text_ptr)
        heads = texts.text_ptr[:-1][size > 0]
        first[heads] = True
        start = np.flatnonzero(first)
        if not len(start):
            return np.zeros(texts.n, np.int64)
        end = np.append(start[1:], len(texts.data))
        key = texts.span_hash(start, end)
        lead = np.zeros(len(first), bool)
        lead[heads] = True
        key[lead[start]] ^= np.uint64(1)  # a text's first pre-token gets one mark more
        kinds, at, back = np.unique(key, return_index=True, return_inverse=True)
        value = np.full(len(kinds), -1, np.int32)
        if len(self.key):
            pos = np.minimum(np.searchsorted(self.key, kinds), len(self.key) - 1)
            hit = self.key[pos] == kinds
            value[hit] = self.value[pos[hit]]
        new = np.flatnonzero(value < 0)
        if len(new):
            raw = texts.data.tobytes()
            words = [(MARK if lead[s] else "") + raw[s:e].decode().replace(" ", MARK) for s, e in zip(start[at[new]].tolist(), end[at[new]].tolist())]
            value[new] = self.ranks.counts(words)
            if len(self.key) > KEPT:
                self.key, self.value = self.key[:0], self.value[:0]
            key_, value_ = np.concatenate((self.key, kinds[new])), np.concatenate((self.value, value[new]))
            order = np.argsort(key_, kind="stable")
            self.key, self.value = key_[order], value_[order]
        upto = np.concatenate(([0], np.cumsum(value[back], dtype=np.int64)))
        ptr = np.searchsorted(start, texts.text_ptr)
        return upto[ptr[1:]] - upto[ptr[:-1]]


def token_counts(docs: DataFrame, model: str, limit: int = 4096) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit.  model: path of the vocabulary file, present on every executor."""
    kind, arrow = schema_of("doc_id long, n_bytes long, n_tokens long, over_limit boolean")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(load(model))
        for batch in batches:
            text = batch.column(1)
            n_bytes = pc.fill_null(pc.binary_length(text), 0).cast(pa.int64())
            if pc.any(pc.match_substring(text, MARK)).as_py():  # the mark itself is read as a blank
                text = pc.replace_substring(text, MARK, " ")
            got = [counter.of(block) for _, _, block in chunks(text)]
            n = np.concatenate(got) if got else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), n_bytes, pa.array(n), pa.array(n > limit)], schema=arrow)

    return docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text").mapInArrow(run, kind)


def op7_token_counts(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
