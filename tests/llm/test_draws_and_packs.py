"""Importance resampling, clustering to centroids and packing against plain versions."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from cuegrid.llm import centroids as C
from cuegrid.llm import importance as I
from cuegrid.llm import packing as P
from tests.llm.conftest import lower

FILE = public_tokenizers.path("byte_bpe_50k.json")
VECTORS = "vec_id long, embedding array<float>, label int, v int, cluster int, x string, sums boolean"


def features(text, longest):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text or ""))
    return words, [" ".join(words[i : i + k]) for k in range(1, longest + 1) for i in range(len(words) - k + 1)]


def plain_resample(docs, target, longest, buckets, seed, least, percent):
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    made = [(d, *features(t, longest)) for d, t in docs]
    s = Counter(bucket(f) for _, _, fs in made for f in fs)
    t = Counter(bucket(f) for text in target for f in features(text, longest)[1])
    S, T = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (S + buckets) / ((s[b] + 1) * (T + buckets))))
    out = []
    for d, words, fs in made:
        weight = sum(gain(bucket(f)) for f in fs) // len(fs) if fs else 0
        h = int(hashlib.sha256(f"{seed}:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        out.append((d, len(words), len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    able = sorted((r for r in out if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    drawn = able[: len(able) * percent // 100]
    return out, drawn


@pytest.mark.parametrize("longest,least,percent", [(1, 20, 10), (3, 1, 60), (2, 20, 100), (1, 20, 0)])
def test_resampling_equals_the_plain_version(spark, docs, texts, longest, least, percent):
    target = [t for d, t in texts[10:14]] + [None, ""]
    got = I.resample(docs, spark.createDataFrame([(t,) for t in target], "text string"), longest, 500, 7, least, percent).collect()
    want, drawn = plain_resample(texts, target, longest, 500, 7, least, percent)
    key = lambda r: tuple(-1 if x is None else x for x in r)
    assert sorted(key(tuple(r)[:4]) for r in got) == sorted(key((r[0], *r[2:])) for r in want)
    ranked = sorted((r for r in got if r["rank"] is not None), key=lambda r: r["rank"])
    assert [r["rank"] for r in ranked] == list(range(1, len(drawn) + 1))
    assert [(r["doc_id"], r["score"]) for r in ranked] == [(r[0], r[4]) for r in drawn]


def test_resampling_of_empty_tables(spark, empty, docs):
    none = spark.createDataFrame([], "text string")
    assert I.resample(empty, none).count() == 0
    assert I.resample(docs, none).count() == docs.count()


def test_a_dictionary_that_starts_anew_gives_the_same(texts, monkeypatch):
    import pyarrow as pa

    from cuegrid.llm.textblock import chunks

    def run():
        f = I.Features(2, 1000)
        return [tuple(x.tolist() for x in f.of(b.letters())) for _, _, b in chunks(pa.array([t for _, t in texts]), 2000)]

    whole = run()
    monkeypatch.setattr(I, "KEPT", 50)
    assert run() == whole


def plain_lloyd(rows, dim, k, rounds, seed, scale):
    kept = [(i, np.array([math.floor(float(np.float32(x)) * scale) for x in e], object)) for i, e in rows if e and len(e) == dim and all(x is not None and math.isfinite(x) for x in e)]
    order = sorted(kept, key=lambda r: (hashlib.sha256(f"{seed}:{'' if r[0] is None else r[0]}".encode()).hexdigest(), list(r[1])))
    cents = [v for _, v in order[:k]]
    near = lambda v: min((int(((v - c) ** 2).sum()), j) for j, c in enumerate(cents))
    for _ in range(rounds):
        of = defaultdict(list)
        for _, v in kept:
            of[near(v)[1]].append(v)
        cents = [np.array([sum(x) // len(of[j]) for x in zip(*of[j])], object) if j in of else c for j, c in enumerate(cents)]
    return sorted(((i is None, i or 0), near(v)[1], near(v)[0], tuple(cents[near(v)[1]])) for i, v in kept)


def made_vectors(rng, n, dim, spread):
    centres = [[rng.gauss(0, 3) for _ in range(dim)] for _ in range(9)]
    rows = [(i, [c + rng.gauss(0, spread) for c in rng.choice(centres)]) for i in range(n)]
    rows += [(n + i, rows[0][1]) for i in range(30)] + [(3, rows[5][1]), (3, rows[5][1]), (None, rows[7][1]), (None, rows[8][1])]
    rows += [(5000, None), (5001, []), (5002, [1.0] * (dim - 1)), (5003, [float("nan")] * dim), (5004, [None] * dim), (5005, [float("inf")] + [0.0] * (dim - 1))]
    return rows


@pytest.mark.parametrize("k,groups,spread", [(8, None, 0.5), (12, 4, 3.0), (1, None, 1.0), (500, 30, 1.0)])
def test_clusters_equal_plain_rounds(spark, k, groups, spread):
    rows = made_vectors(random.Random(k), 300, 6, spread)
    frame = spark.createDataFrame([(i, e, 1, 2, 3, "x", True) for i, e in rows], VECTORS).repartition(5)
    got = C.yinyang(frame, 6, k, 5, 3, 64, groups).collect()
    have = sorted(((r["vec_id"] is None, r["vec_id"] or 0), r["cluster"], r["distance"], tuple(r["centroid"])) for r in got)
    assert have == plain_lloyd(rows, 6, k, 5, 3, 64)
    total = Counter()
    for r in got:
        total[r["cluster"]] += r["distance"]
    assert all(r["cluster_inertia"] == total[r["cluster"]] and r["inertia"] == sum(total.values()) for r in got)


def test_no_vectors_and_too_large_ones(spark):
    assert C.yinyang(spark.createDataFrame([], VECTORS), 6).count() == 0
    big = spark.createDataFrame([(1, [1e30], 1, 2, 3, "x", True), (2, [0.0], 1, 2, 3, "x", True)], VECTORS)
    with pytest.raises(Exception, match="too large"):
        C.yinyang(big, 1, 2, 1).collect()


def test_bounds_spare_distances():
    rng = np.random.default_rng(1)
    centres = rng.integers(-9000, 9000, (40, 16))
    x = (centres[rng.integers(0, 40, 4000)] + rng.integers(-300, 300, (4000, 16))).astype(np.int64)
    cents = x[:40].copy()
    group = C.group_centroids(cents, 5)
    assert len(set(group)) <= 5
    moved, state, found = np.zeros(40), None, []
    for _ in range(8):
        y = C.Yinyang(cents, group, moved)
        state = y.again(x, *state) if state else y.first(x)
        assert (state[0] == C.squared(x, cents).argmin(1)).all()
        exact = np.sqrt(C.squared(x, cents).astype(float))
        assert (state[1] * (1 + 1e-9) + 1e-9 >= exact[np.arange(len(x)), state[0]]).all()
        exact[np.arange(len(x)), state[0]] = np.inf
        for g in range(y.n_groups):
            assert (state[2][:, g] <= exact[:, group == g].min(1) * (1 + 1e-9) + 1e-9).all()
        found.append(y.scanned)
        new = np.stack([x[state[0] == j].mean(0) if (state[0] == j).any() else cents[j] for j in range(40)]).astype(np.int64)
        moved, cents = np.sqrt(((new - cents) ** 2).sum(1)), new
    assert found[0] == 160_000 and found[-1] < 40_000


def test_distances_are_exact_beyond_doubles():
    x = np.array([[(1 << 26) + 1, -(1 << 26)]], np.int64)
    c = np.array([[-(1 << 26), 1 << 26], [0, 3]], np.int64)
    assert C.squared(x, c).tolist() == [[sum((int(a) - int(b)) ** 2 for a, b in zip(x[0], y)) for y in c]]


def check_packed(rows, texts, capacity):
    tokens = Tokenizer.from_file(FILE)
    want = Counter()
    for (d, t), e in zip(texts, tokens.encode_batch([t or "" for _, t in texts], add_special_tokens=False)):
        ids = [*e.ids, 0]
        n, start = -(-len(ids) // capacity), 0
        for p in range(n):
            stop = len(ids) - (n - 1 - p) * capacity
            want[d, p, start, np.array(ids[start:stop], "<u4").tobytes()] += 1
            start = stop
    assert Counter((r["doc_id"], r["piece"], r["start"], bytes(r["ids"])) for r in rows) == want
    at = Counter()
    for r in sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["length"] == len(r["ids"]) // 4 and r["offset"] == at[r["sequence_id"]]
        at[r["sequence_id"]] += r["length"]
    assert max(at.values()) <= capacity
    return len(at), -(-sum(at.values()) // capacity)


@pytest.mark.parametrize("capacity", [2048, 64, 7, 1])
def test_pieces_and_places(spark, docs, texts, capacity):
    texts = [(d, t) for d, t in texts if capacity > 1 or len(t) < 2000]
    frame = docs if capacity > 1 else docs.where("text IS NULL OR length(text) < 2000")
    packed = P.pack(frame, FILE, capacity)
    rows = packed.collect()
    n, least = check_packed(rows, texts, capacity)
    assert n <= least * 1.02 + 1
    if capacity == 64:
        got = {r["sequence_id"]: (bytes(r["ids"]), r["documents"]) for r in P.sequences(packed).collect()}
        for r in rows:
            ids, parts = got[r["sequence_id"]]
            assert ids[4 * r["offset"] : 4 * (r["offset"] + r["length"])] == bytes(r["ids"]) and len(ids) == 4 * sum(p["length"] for p in parts)


def test_packing_joins_by_a_shuffle_where_counts_are_large(spark, docs, texts):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        check_packed(P.pack(docs, FILE, 100).collect(), texts, 100)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_packing_an_empty_table(spark, empty):
    assert P.pack(empty, FILE).count() == 0


def plain_two_fit(lengths, capacity):
    """One bin at a time, one piece at a time."""
    left, bins = sorted(lengths, reverse=True), 0
    while left:
        used, gap = [], capacity
        for x in list(left):
            if x <= gap:
                used.append(x), left.remove(x)
                gap -= x
        if gap and len(used) > 1:
            least = used[-1]
            pairs = [(left[i] + left[j], i, j) for i in range(len(left)) for j in range(i + 1, len(left)) if least < left[i] + left[j] <= gap + least]
            if pairs:
                _, i, j = max(pairs, key=lambda p: p[0])
                pair = [left[i], left[j]]
                left.remove(pair[0]), left.remove(pair[1])
                left.append(least), left.sort(reverse=True)
                used = used[:-1] + pair
        assert sum(used) <= capacity
        bins += 1
    return bins


@pytest.mark.parametrize("seed", range(12))
def test_bins_hold_all_and_as_few_as_one_by_one(seed):
    rng = random.Random(seed)
    capacity = rng.choice([10, 64, 200])
    lengths = [min(capacity, max(1, int(rng.lognormvariate(math.log(capacity / rng.choice([2, 3, 8])), 0.6)))) for _ in range(rng.randint(1, 300))]
    counts = np.bincount(lengths, minlength=capacity + 1)
    bins = P.best_two_fit(counts, capacity)
    held = Counter()
    for used, times in bins:
        assert times > 0 and sum(x * n for x, n in used.items()) <= capacity
        for x, n in used.items():
            held[x] += n * times
    assert held == Counter(lengths)
    assert sum(t for _, t in bins) <= plain_two_fit(lengths, capacity) + 1


def test_two_take_the_place_of_one():
    # 6 and 3 leave 1; 2 and 2 fit the gap of 4 that 3 leaves
    counts = np.bincount([6, 3, 2, 2], minlength=11)
    assert P.best_two_fit(counts, 10)[0] == ({6: 1, 2: 2}, 1) or P.best_two_fit(counts, 10)[0][0] == {6: 1, 3: 1}
    assert P._pair(np.bincount([2, 2], minlength=11), 4) == (2, 2) and P._pair(np.bincount([2], minlength=11), 4) == (0, 0)
    assert P._pair(np.bincount([5, 4, 1], minlength=11), 8) == (5, 1)


def test_the_plan_does_not_grow_with_the_pieces():
    counts = np.random.default_rng(2).integers(0, 9, 513) * 10**9
    counts[0] = 0
    assert len(P.best_two_fit(counts, 512)) < 512 * math.log(512)


def test_tokens_of_every_code_point_and_of_special_strings():
    tokens, own = Tokenizer.from_file(FILE), P.encoder(FILE)
    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    texts = [f"a{c}b 1{c}2 !{c}?  {c}  x{c}{c} '{c}" for c in points[::37] + points[:3000]]
    texts += ["<|endoftext|>", "a<|endoftext|> b", "<|endoftext|", "it's\r\n\tx  \n\n y", "", "   ", " a\n", "x" * 20000, " " * 5000]
    for t, e in zip(texts, tokens.encode_batch(texts, add_special_tokens=False)):
        assert own(t).tolist() == e.ids, t[:40]


def test_unknown_settings_are_refused(tmp_path):
    import json

    said = json.load(open(FILE, encoding="utf-8"))
    said["pre_tokenizer"]["add_prefix_space"] = True
    at = tmp_path / "other.json"
    at.write_text(json.dumps(said), encoding="utf-8")
    with pytest.raises(ValueError, match="byte-level cut"):
        P.encoder(str(at))


def test_noise_and_weights_are_whole_numbers(spark):
    got = spark.createDataFrame([(5, 1)], "doc_id long, weight long").select(I.noisy("weight", "doc_id", 2024).alias("s"))
    assert got.schema["s"].dataType.simpleString() == "bigint" and got.where(F.col("s").isNotNull()).count() == 1
