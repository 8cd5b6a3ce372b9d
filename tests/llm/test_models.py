import math
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import sentencepiece

from cuegrid.llm import language_model as M
from cuegrid.llm import quality_classifier as C
from cuegrid.llm import token_counts as TC
from cuegrid.llm import toxicity as X
from cuegrid.llm.stages import one_text
from tests.llm.conftest import DOCS, WORDS, lower, prose, row

MODEL = public_tokenizers.path("piece_bpe_32k.model")


def crc(i, mod):
    return zlib.crc32(b"" if i is None else str(i).encode()) % mod


def test_token_counts_equal_the_library(spark, docs, texts, empty):
    rng = random.Random(1)
    odd = [
        "▁▁ ▁a",
        "<s></s><0x0A>",
        "東京 tower 😀",
        " " * 70 + "x",
        "aaaaabaaab" * 30,
        "\x00\x07",
        "".join(rng.choice("ab tehi  \n▁é東😀<0A>") for _ in range(400)),
    ]
    df = docs.unionByName(spark.createDataFrame([row(5000 + i, t) for i, t in enumerate(odd)], DOCS))
    lib = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    want = Counter((d, len(t.encode()), len(lib.encode(t))) for d, t in [*texts, *((5000 + i, t) for i, t in enumerate(odd))])
    got = TC.token_counts(df, MODEL, limit=50).collect()
    assert Counter((r["doc_id"], r["n_bytes"], r["n_tokens"]) for r in got) == want
    assert all(r["over_limit"] == (r["n_tokens"] > 50) for r in got)
    assert TC.token_counts(empty, MODEL).count() == 0


def labelled(spark, n=900):
    rng = random.Random(7)
    rows, labels = [], []
    for i in range(n):
        toxic, poor = i % 7 == 0, i % 5 == 0
        t = prose(rng, rng.randint(5, 60))
        if poor:
            t = t.upper().replace(" ", "!! ")
        if toxic:
            t += rng.choice([" you idiotling", " idiotisch bist", " SCUMBAG x", " scumlike"])
        rows.append(row(i, t))
        labels.append((i, int(not poor), int(toxic)))
    return spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def accuracy(out, truth):
    rows = [r for r in out.collect() if r["doc_id"] in truth]
    assert all(r["held_out"] == (crc(r["doc_id"], 5) == 0) and 0 <= r["score"] <= 1 for r in rows)
    held = [r for r in rows if r["held_out"]]
    return sum(r["predicted"] == truth[r["doc_id"]] for r in held) / len(held)


def test_toxicity_on_held_out_documents(spark, docs, empty):
    df, labels = labelled(spark)
    both = df.unionByName(docs.withColumn("doc_id", docs.doc_id + 10_000))
    assert accuracy(X.toxicity(both, labels), {r["doc_id"]: r["toxic"] for r in labels.collect()}) > 0.95
    assert X.toxicity(both, labels).count() == both.count()
    assert X.toxicity(empty, labels).count() == 0
    assert {r["score"] for r in X.toxicity(docs, labels.where("toxic = 0")).collect()} == {0.0}
    assert X.toxicity(docs, labels.limit(0)).where("predicted = 1").count() == 0


def test_held_out_labels_teach_nothing(spark):
    df, labels = labelled(spark, 300)
    flipped = spark.createDataFrame(
        [(r["doc_id"], 1 - r["quality"], 1 - r["toxic"]) if crc(r["doc_id"], 5) == 0 else tuple(r) for r in labels.collect()],
        labels.schema,
    )
    for f in (X.toxicity, C.quality_classifier):
        a, b = ({r["doc_id"]: round(r["score"], 9) for r in f(df, x).collect()} for x in (labels, flipped))
        assert a == b


def test_quality_on_held_out_documents(spark, docs, empty):
    df, labels = labelled(spark)
    truth = {r["doc_id"]: r["quality"] for r in labels.collect()}
    assert accuracy(C.quality_classifier(df, labels), truth) > 0.95
    assert C.quality_classifier(empty, labels).count() == 0
    assert C.quality_classifier(docs, labels).count() == docs.count()
    assert {r["score"] for r in C.quality_classifier(docs, labels.where("quality = 1")).collect()} == {1.0}


def test_context_vectors_equal_brute_force(spark, docs, texts):
    """Each known word has a vector of its own: the sum of the index vectors of its neighbours, of all texts."""
    known = C.vocabulary(docs.select("text"), 40)
    index = C.index_vectors()
    toks = [WORDS.findall(t) for _, t in texts]
    hashes = {w: int(h) for w in {w for t in toks for w in t} for h in [word_hash_as_is(w)]}
    df = Counter(w for t in toks for w in set(t))
    top = sorted((w for w in df if df[w] > 1), key=lambda w: (-df[w], np.uint64(hashes[w]).astype(np.int64)))[:40]
    assert sorted(hashes[w] for w in top) == known.keys.tolist()
    want = {w: np.zeros(C.DIM) for w in top}
    for t in toks:
        for i, w in enumerate(t):
            for j in (i - 2, i - 1, i + 1, i + 2):
                if w in want and 0 <= j < len(t):
                    want[w] += index[hashes[t[j]] & (C.PATTERNS - 1)]
    got = C.word_vectors(docs, known)
    slot = dict(zip(known.keys.tolist(), range(known.size)))
    for w in top:
        assert np.allclose(got[slot[hashes[w]]], want[w] / max(1, np.linalg.norm(want[w])), atol=1e-6)
    assert not got[known.size].any()
    assert known.slots(np.array([hashes[top[0]], 12345], np.uint64)).tolist() == [slot[hashes[top[0]]], known.size]


def test_toxicity_scores_equal_brute_force(spark, docs, texts):
    """Weights of the features that a text has, told by plain string operations."""
    import re

    df, labels = labelled(spark, 400)
    both = df.unionByName(docs.withColumn("doc_id", docs.doc_id + 10_000))
    keys, weight, bias = X.fit(both, labels)
    number = {int(k): w for k, w in zip(keys, weight)}

    def score(t):
        feats = set()
        for w in re.findall(r"[a-z0-9\x80-\U0010ffff]+", lower(t)):
            raw = w.encode()
            feats.add(int(hash_of(raw)))
            feats |= {int(hash_of(raw[:k])) ^ k for k in (4, 5) if len(raw) > k}
        return 1 / (1 + math.exp(-(sum(number.get(f, 0.0) for f in feats) + bias)))

    want = Counter((None if d is None else d + 10_000, round(score(t), 6)) for d, t in texts)
    got = Counter((r["doc_id"], round(r["score"], 6)) for r in X.toxicity(both, labels).collect() if r["doc_id"] is None or r["doc_id"] >= 10_000)
    assert got == want


def test_pooling_equals_brute_force(spark, docs, texts):
    known = C.vocabulary(docs.select("text"), 60)
    index, vectors = C.index_vectors(), C.word_vectors(docs, known)
    slot = dict(zip(known.keys.tolist(), range(known.size)))
    import pyarrow as pa

    from cuegrid.llm.textblock import chunks

    kind = lambda b: 5 if b >= 128 else 0 if chr(b).islower() else 1 if chr(b).isupper() else 2 if chr(b).isdigit() else 3 if chr(b) in ".,;:'" else 4
    some = [t for _, t in texts if len(t) < 4000]
    got = np.concatenate([C.pooled(b, known, vectors, index) for _, _, b in chunks(pa.array(some))])
    for t, x in zip(some, got):
        ws = WORDS.findall(t)
        if not ws:
            assert not x.any()
            continue
        h = [int(word_hash_as_is(w)) for w in ws]
        raw = [w.encode() for w in ws]
        own = np.array([vectors[slot.get(k, known.size)] for k in h])
        shape = np.array([vectors[known.size + 1 + ((kind(r[0]) * 6 + kind(r[min(1, len(r) - 1)])) * 6 + kind(r[-1])) * 8 + min(len(r), 8) - 1] for r in raw])
        idx = np.array([index[k & (C.PATTERNS - 1)] for k in h], float)
        want = [
            *own.mean(0),
            *own.std(0),
            *shape.mean(0),
            *shape.std(0),
            np.linalg.norm(own.mean(0)),
            np.linalg.norm(shape.mean(0)),
            np.linalg.norm(idx.mean(0)),
        ]
        want += [sum((a & (C.PATTERNS - 1)) == (b & (C.PATTERNS - 1)) for a, b in zip(h, h[k:])) / len(h) for k in (1, 2)]
        assert np.allclose(x, want, atol=2e-3)


def test_non_negative_risk_turns_back():
    ptr, feature = np.arange(101), np.array([0] * 50 + [0] * 15 + [1] * 35)  # 30 % of the unlabelled are positive
    positive = np.arange(100) < 50
    w, b = X.train(ptr, feature, positive, 2, 0.3)
    assert w[0] + b > 0 > w[1] + b


def test_language_model(spark, docs, texts, empty):
    got = M.score(docs).collect()
    toks = [(d, WORDS.findall(lower(t)) + ["\0"]) for d, t in texts]
    c = Counter(w for d, t in toks for w in t if crc(d, 7) != 2)
    n, v = sum(c.values()), len(c)
    base = lambda t: sum(math.log10((c[w] + 1) / (n + v + 1)) for w in t)
    want = Counter((d, len(t), sum(c[w] > 0 for w in t), round(base(t), 4)) for d, t in toks)
    assert Counter((r["doc_id"], r["n_tokens"], r["n_known"], round(r["base_score"], 4)) for r in got) == want
    assert all(r["train_tokens"] == n and r["held_out"] == (crc(r["doc_id"], 7) == 2) for r in got)
    held = [r for r in got if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)
    assert [tuple(r) for r in M.score(docs.orderBy("doc_id")).orderBy("doc_id", "score").limit(5).collect()]
    assert M.score(empty).count() == 0


def word_hashes(spark, words):
    """Token hashes as the model makes them."""
    import pyarrow as pa

    from cuegrid.llm.textblock import chunks

    out = []
    for _, _, block in chunks(pa.array(words)):
        out += M._tokens(block)[0][::2].tolist()
    return dict(zip(words, out))


def word_hash_as_is(word):
    import pyarrow as pa

    from cuegrid.llm.textblock import chunks

    return next(b for _, _, b in chunks(pa.array([word]))).word_hash()[0]


def hash_of(raw: bytes):
    from cuegrid.llm.textblock import TextBlock

    return TextBlock(np.frombuffer(raw, np.uint8), np.array([0, len(raw)])).span_hash(np.array([0]), np.array([len(raw)]))[0]


class BruteModel:
    """The same model in dicts, one customer after the other."""

    def __init__(self, toks, hashes, seed=17):
        self.hash = {w: np.uint64(h) for w, h in hashes.items()} | {"\0end": M.END, "\0start": M.START}
        pairs = Counter((p, w) for t in toks for p, w in zip(["\0start", *t], t))
        total = Counter(w for t in toks for w in t)
        self.v, self.seed, self.pairs, self.total = len(total), seed, pairs, total
        self.unknown = M.UNKNOWN_SHARE if total else 1.0
        ones = lambda c: (sum(x == 1 for x in c.values()), sum(x == 2 for x in c.values()))
        self.d0, self.d1 = M._discount(*ones(total)), M._discount(*ones(pairs))
        self.customers = Counter()
        for (p, _), n in pairs.items():
            self.customers[p] += n
        self.states = []
        t, t0 = {x: 1 for x in pairs}, {w: 1 for w in total}
        self._sums(t, t0)
        for k in range(1, M.BURN_IN + M.SAMPLES + 1):
            new = {}
            for p, w in pairs:
                own = t[p, w]
                c0, r0 = self.c0[w] - own, min(t0[w], self.c0[w] - own)
                parent = (c0 - self.d0 * r0 + (M.STRENGTH + self.d0 * (self.t0_all - t0[w] + r0)) * self.base(w)) / (M.STRENGTH + self.c0_all - own)
                key = M.pair_key(np.array([self.hash[w]]), M._context(np.array([self.hash[p]])))
                new[p, w] = self.seat(pairs[p, w], self.tables[p] - own, self.d1, parent, key, k)
            t = new
            all_before = self.t0_all
            self._sums(t, t0)
            t0 = {w: self.seat(self.c0[w], all_before - t0[w], self.d0, self.base(w), np.array([self.hash[w]]), k) for w in total}
            self._sums(t, t0)
            if k > M.BURN_IN:
                self.states.append((t, t0, self.tables, self.c0, self.c0_all, self.t0_all))

    def _sums(self, t, t0):
        self.tables, self.c0 = Counter(), Counter()
        for (p, w), n in t.items():
            self.tables[p] += n
            self.c0[w] += n
        self.c0_all, self.t0_all = sum(t.values()), sum(t0.values())

    def base(self, w):
        return (1 - self.unknown) / max(1, self.v) if self.total[w] else self.unknown

    def seat(self, n, others, d, parent, key, sweep):
        t, s = 1, 1
        opens = lambda t, x: (a := (M.STRENGTH + d * (others + t)) * parent) / (a + x - d * t)
        u = lambda k: M.uniform(key, self.seed, sweep, k)
        while s < n:
            group = max(1, s // M.SINGLY)
            take = min(group, n - s)
            x = s + (take - 1) / 2
            if group == 1:
                t += int(u(2 * s)[0] < opens(t, x))
            else:
                t += int(M.binomial(np.array([float(take)]), np.array([opens(t + take * opens(t, x) / 2, x)]), u(2 * s), u(2 * s + 1))[0])
            s += group
        return t

    def prob(self, p, w):
        out = 0
        for t, t0, tables, c0, c0_all, t0_all in self.states:
            root = (c0[w] - self.d0 * t0.get(w, 0) + (M.STRENGTH + self.d0 * t0_all) * self.base(w)) / (M.STRENGTH + c0_all)
            out += (self.pairs[p, w] - self.d1 * t.get((p, w), 0) + (M.STRENGTH + self.d1 * tables[p]) * root) / (M.STRENGTH + self.customers[p])
        return out / len(self.states)


def test_score_equals_brute_force_at_any_number_of_tasks(spark):
    rng = random.Random(6)
    words = [f"w{i}" for i in range(50)]
    texts = [(i, " ".join(rng.choice(words[: rng.choice([8, 50])]) for _ in range(rng.randint(0, 16)))) for i in range(260)]
    texts += [(1000 + i, t) for i, t in enumerate(["w1 niegesehen w2", "", "w1 w1", "fremd fremd"] * 4)]
    toks = {i: WORDS.findall(t) + ["\0end"] for i, t in texts}
    hashes = word_hashes(spark, sorted({w for t in toks.values() for w in t} - {"\0end"}))
    brute = BruteModel([t for i, t in toks.items() if crc(i, 7) != 2], hashes)
    assert max(n for x in brute.states for n in x[3].values()) > 2 * M.SINGLY
    known = [*brute.total]
    for p in ("\0start", "w1", "w39", "fremd"):  # every restaurant's probabilities add up to one, with the outcome "unknown"
        assert abs(sum(brute.prob(p, w) for w in known) + brute.prob(p, "unbekannt") - 1) < 1e-9
    want = {i: sum(math.log10(brute.prob(p, w)) for p, w in zip(["\0start", *t], t)) for i, t in toks.items()}
    df = spark.createDataFrame([row(*r) for r in texts], DOCS).repartition(3)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    for partitions, owner_bytes in (("4", M.OWNER_BYTES), ("7", 900), ("211", 4000)):  # one owner; many, with split words; a few
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        got = {r["doc_id"]: r for r in M.score(df, owner_bytes=owner_bytes).collect()}
        assert got.keys() == want.keys()
        assert max(abs(got[i]["score"] - want[i]) for i in want) < 1e-4, owner_bytes
        assert all(abs(math.log10(r["perplexity"]) + r["score"] / r["n_tokens"]) < 1e-9 for r in got.values())
    spark.conf.set("spark.sql.shuffle.partitions", before)
    assert len(M._layout(df, 900).words) > 3


def test_words_are_split_where_they_are_frequent(spark):
    texts = [row(i, "und " * 50 + f"a{i} b{i}") for i in range(2000)]
    layout = M._layout(spark.createDataFrame(texts, DOCS), 20_000)
    h = word_hashes(spark, ["und", "a1"])
    assert layout.owners > 10 and layout.split(np.array([h["und"]], np.uint64))[0] == layout.owners and layout.split(np.array([h["a1"]], np.uint64))[0] == 1


def test_large_parties_are_seated_like_customers_one_by_one():
    n, c, others, parent, d = 4000, 3000, 3, 0.3, 0.4
    rng = np.random.default_rng(2)
    t = M.seat(np.full(n, c), np.full(n, others), 1.0, d, np.full(n, parent), rng.integers(1, 1 << 60, n, dtype=np.uint64), 1, 1)
    slow = np.ones(n)
    for s in range(1, c):
        a = (1 + d * (others + slow)) * parent
        slow += rng.random(n) < a / (a + s - d * slow)
    assert abs(t.mean() - slow.mean()) < 4 * slow.std() * (2 / n) ** 0.5 and abs(t.std() / slow.std() - 1) < 0.1


def test_binomial():
    rng = np.random.default_rng(1)
    for n, p in ((1, 0.3), (7, 0.9), (40, 0.2), (1000, 0.4), (1000, 0.003), (50, 1.0)):
        got = M.binomial(np.full(40_000, float(n)), np.full(40_000, p), rng.random(40_000), rng.random(40_000))
        want = rng.binomial(n, p, 40_000)
        assert abs(got.mean() - n * p) < 5 * (n * p * (1 - p) / 40_000) ** 0.5 + 1e-9 and abs(got.var() - want.var()) < 0.05 * want.var() + 1e-9 and got.min() >= 0 and got.max() <= n


def test_every_word_before_has_its_own_restaurant(spark):
    rng = random.Random(11)
    follows = {f"langeswort{i:02d}": f"nachfolger{i:02d}" for i in range(40)} | {f"предыдущее{i}": f"следующее{i}" for i in range(40)}

    def text(n):
        return " ".join(f"{a} {follows[a]}" for a in rng.choices(list(follows), k=n))

    df = spark.createDataFrame([row(i, text(40)) for i in range(300)], DOCS).repartition(5)
    held = [r for r in M.score(df).collect() if r["held_out"]]
    per_token = sum(r["score"] for r in held) / sum(r["n_tokens"] for r in held)
    # half of the tokens are sure, the others one of 80; without contexts all are one of 160
    assert per_token > -1.1 and sum(r["base_score"] for r in held) / sum(r["n_tokens"] for r in held) < -2


def test_one_id_in_many_rows_is_learned_from_once(spark):
    """5,000 rows of one id beside 400 others: no product of rows, and the same model as without the repeats."""
    import time

    rng = random.Random(6)
    rows = [row(i, prose(rng, 30) + (" vile filth" if i % 3 == 0 else " fine words")) for i in range(400)]
    labels = spark.createDataFrame([(i, int(i % 3 != 0), int(i % 3 == 0)) for i in range(300)], "doc_id long, quality int, toxic int")
    hot = next(i for i in range(400) if zlib.crc32(str(i).encode()) % 5 and i % 3 == 0)
    once = spark.createDataFrame(rows, DOCS)
    many = once.unionByName(spark.createDataFrame([rows[hot]] * 5000, DOCS)).repartition(4)
    began = time.time()
    for module, label in ((X.toxicity, "toxic"), (C.quality_classifier, "quality")):
        a = {r["doc_id"]: r["score"] for r in module(once, labels).collect()}
        b = module(many, labels).collect()
        assert len(b) == 5400 and {r["doc_id"] for r in b} == set(a)
        if label == "toxic":  # the context sums of the other count every row of the corpus
            assert all(abs(a[r["doc_id"]] - r["score"]) < 1e-9 for r in b)
    assert time.time() - began < 90
    # two texts of one id: one row, by the text's hash
    two = spark.createDataFrame([(1, "a"), (1, "b"), (1, None), (2, None)], "doc_id long, text string")
    ids = spark.createDataFrame([(1, 0), (2, 1)], "doc_id long, y int")
    assert sorted((r["doc_id"], r["y"]) for r in one_text(two, ids).collect()) == [(1, 0), (2, 1)]
