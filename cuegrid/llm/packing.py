"""Best-two-fit packing of documents into sequences of a fixed number of tokens.

A document is its tokens and one end token; a longer one is cut into pieces of the
capacity, the first of which may be shorter.  Which lengths share a sequence is
decided on the number of pieces of each length, at most one number for each length
up to the capacity, whatever the size of the corpus: a bin is filled greedily, the
longest piece that fits first; then its shortest piece makes room for two unpacked
ones, where a pair fits the gap that this leaves more tightly.  A bin so found is
repeated as often as the lengths suffice, so at least one of them runs short each
time, and the bins number at most capacity times its logarithm.

Pieces are numbered within task and length as they are made; the counts of tasks and
lengths are added up, and a piece's number tells its sequence and its place there.
No piece is sorted, and none is shuffled while those counts are small enough for a
broadcast, which Spark decides by their size; beyond it they are joined by a shuffle.

Tokens are those of the `tokenizers` library for the given file.  They are found by
the quicker library of the same byte pairs, built from that file, whose settings are
checked; both agree on every code point (tests).

Defined results: a null or empty text is its end token alone; special strings inside
a text are their tokens, the library's default; texts are tokenised whole; repeated
rows are packed each; rows without an id are packed like others; an empty table gives
no rows; other columns are ignored.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cuegrid.llm.stages import emit_rows, gather, materialise, table

END = 0
FLUSH = 1 << 18  # tokens of one record batch
NAMES = ["doc_id", "piece", "start", "length", "ids", "part", "nth"]


@lru_cache(2)
def encoder(path: str):
    """The tokens of a byte-level vocabulary file, as its own library gives them without added special tokens."""
    import tiktoken

    with open(path, encoding="utf-8") as f:
        said = json.load(f)
    model, cut = said["model"], said["pre_tokenizer"]
    number = model["vocab"]
    merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
    specials = {t["content"]: t["id"] for t in said["added_tokens"]}
    made = [number[a + b] for a, b in merges]
    expected = {
        "a BPE model": model["type"] == "BPE" and not model["dropout"] and not model["unk_token"],
        "whole words without marks": not model["continuing_subword_prefix"] and not model["end_of_word_suffix"],
        "no normalisation": said["normalizer"] is None,
        "the byte-level cut": cut["type"] == "ByteLevel" and cut["use_regex"] and not cut["add_prefix_space"],
        "ids in the order of the merges": all(a < b for a, b in zip(made, made[1:])),
        "plain special tokens": not any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] for t in said["added_tokens"]),
    }
    if missing := [k for k, v in expected.items() if not v]:
        raise ValueError(f"{path}: the tokens rely on {', '.join(missing)}")
    # the characters that stand for bytes in such files: printable ones for themselves, the others from 256 on
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(plain))}
    ranks = {bytes(byte[c] for c in piece): i for piece, i in number.items() if piece not in specials}
    pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"  # fixed value: the byte-level cut
    own = tiktoken.Encoding(path, pat_str=pattern, mergeable_ranks=ranks, special_tokens=specials)
    return lambda text: own.encode_to_numpy(text, allowed_special="all")


def cut_pieces(docs: DataFrame, path: str, capacity: int) -> DataFrame:
    """doc_id, piece, start, length, ids (little-endian unsigned 32-bit), and part and nth: the task, and the piece's number among those of its length there."""
    if capacity < 1:
        raise ValueError("a sequence holds one token at least")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        encode, seen = encoder(path), np.zeros(capacity + 1, np.int64)
        part = TaskContext.get().partitionId()
        rows: list[tuple] = []
        held = 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0), batch.column(1)):
                ids = np.append(encode(text.as_py() or ""), END).astype("<u4")
                start = 0
                for piece in range(-(-len(ids) // capacity)):
                    stop = (len(ids) - 1) % capacity + 1 + piece * capacity
                    rows.append((doc_id.as_py(), piece, start, stop - start, ids[start:stop].tobytes(), part, int(seen[stop - start])))
                    seen[stop - start] += 1
                    start = stop
                held += len(ids)
                if held >= FLUSH:
                    yield dict(zip(NAMES, zip(*rows)))
                    rows, held = [], 0
        if rows:
            yield dict(zip(NAMES, zip(*rows)))

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return emit_rows(rows, run, "doc_id long, piece int, start long, length long, ids binary, part int, nth long")


def _pair(free: np.ndarray, room: int) -> tuple[int, int]:
    """The two lengths, the longer first, that fill most of the room; free: how many pieces of each length are left.  (0, 0): no pair fits."""
    lengths = np.flatnonzero(free[: room + 1])
    if not len(lengths):
        return 0, 0
    below = np.zeros(room + 1, np.int64)
    below[lengths] = lengths
    below = np.maximum.accumulate(below)  # the longest that is no longer than this
    longest = np.minimum(room - lengths, lengths)
    other = below[longest]
    alone = (other == lengths) & (free[lengths] < 2)
    other[alone] = below[lengths[alone] - 1]
    total = np.where(other > 0, lengths + other, 0)
    k = len(total) - 1 - int(np.argmax(total[::-1]))
    return (int(lengths[k]), int(other[k])) if total[k] else (0, 0)


def best_two_fit(counts: np.ndarray, capacity: int) -> list[tuple[dict[int, int], int]]:
    """counts[length]: pieces of that length.  Bins as ({length: pieces}, how many such bins); every piece is in one."""
    free, out = np.asarray(counts, np.int64).copy(), []
    while free.any():
        left, used, gap = free.copy(), {}, capacity
        while gap and len(fits := np.flatnonzero(left[: gap + 1])):
            length = int(fits[-1])
            n = min(int(left[length]), gap // length)
            used[length] = n
            left[length] -= n
            gap -= n * length
        if gap and sum(used.values()) > 1:
            least = min(used)
            a, b = _pair(left, gap + least)
            if a + b > least:
                used[least] -= 1
                for length in (a, b):
                    used[length] = used.get(length, 0) + 1
                used = {length: n for length, n in used.items() if n}
        times = min(int(free[length]) // n for length, n in used.items())
        for length, n in used.items():
            free[length] -= times * n
        out.append((dict(sorted(used.items(), reverse=True)), times))
    return out


def _segments(bins: list[tuple[dict[int, int], int]]) -> dict[int, np.ndarray]:
    """For each length the rows (first piece's number, first sequence, pieces in a sequence, place of the first there), by number."""
    out: dict[int, list[tuple[int, int, int, int]]] = {}
    given: dict[int, int] = {}
    sequence = 0
    for used, times in bins:
        base = 0
        for length, n in used.items():
            out.setdefault(length, []).append((given.get(length, 0), sequence, n, base))
            given[length] = given.get(length, 0) + n * times
            base += n * length
        sequence += times
    return {length: np.array(rows, np.int64) for length, rows in out.items()}


def pack(docs: DataFrame, path: str, capacity: int = 2048) -> DataFrame:
    """doc_id, piece, start, length, ids (little-endian unsigned 32-bit), sequence_id and offset.  path: the vocabulary file, present on every executor."""
    pieces = materialise(cut_pieces(docs, path, capacity))
    counts = materialise(pieces.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n")))
    total = np.zeros(capacity + 1, np.int64)
    by_length = gather(counts.groupBy("length").agg(F.sum("n").alias("n")))  # capacity rows at most
    total[by_length["length"].to_numpy()] = by_length["n"].to_numpy()
    places = _segments(best_two_fit(total, capacity))

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        """Runs of a task's pieces of one length, cut where a segment ends: nth in [a, b), whose sequences and offsets follow one rule."""
        for batch in batches:
            rows = []
            for part, length, n, before in zip(*(c.to_pylist() for c in batch.columns)):
                at = places[length]
                first = int(np.searchsorted(at[:, 0], before, "right")) - 1
                last = int(np.searchsorted(at[:, 0], before + n, "left"))
                for k in range(first, last):
                    low = int(at[k, 0])
                    high = int(at[k + 1, 0]) if k + 1 < len(at) else before + n
                    rows.append((part, length, max(low - before, 0), min(high - before, n), before - low, *at[k, 1:].tolist()))
            if rows:
                yield dict(zip(["in_part", "of_length", "a", "b", "shift", "first", "each", "base"], zip(*rows)))

    before = F.sum("n").over(Window.partitionBy("length").orderBy("part")) - F.col("n")
    runs = materialise(
        emit_rows(
            counts.select("part", "length", "n", before.alias("before")),
            spread,
            "in_part int, of_length long, a long, b long, shift long, first long, each long, base long",
        ),
    )
    mine = (F.col("part") == F.col("in_part")) & (F.col("length") == F.col("of_length")) & (F.col("nth") >= F.col("a")) & (F.col("nth") < F.col("b"))
    number = F.col("nth") + F.col("shift")
    return pieces.join(runs, mine).select(
        "doc_id",
        "piece",
        "start",
        "length",
        "ids",
        (F.col("first") + F.expr("(nth + shift) div each")).cast("long").alias("sequence_id"),
        (F.col("base") + number % F.col("each") * F.col("length")).cast("long").alias("offset"),
    )


def sequences(packed: DataFrame) -> DataFrame:
    """The training rows: sequence_id, ids of the whole sequence, and its documents as (offset, length, doc_id, piece).  One shuffle; a sequence is bounded by the capacity."""
    parts = packed.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "length", "doc_id", "piece", "ids"))).alias("p"))
    joined = F.aggregate("p", F.lit(b""), lambda out, x: F.concat(out, x["ids"]))
    return parts.select("sequence_id", joined.alias("ids"), F.transform("p", lambda x: x.dropFields("ids")).alias("documents"))


def op13_packing(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    packed = pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return packed.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "sequence_id", "offset")
