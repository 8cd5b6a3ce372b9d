import random
from collections import Counter
from math import comb

import numpy as np
import pyarrow as pa

from cuegrid.llm import quality_rules as Q
from cuegrid.llm.textblock import chunks, shingles
from tests.llm.conftest import WORDS, prose

SYMBOLS = set("#*$%&|<>")


def brute(t):
    w = WORDS.findall(t)
    lines = [x for x in t.split("\n") if WORDS.search(x)]
    seen = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    hit = {i + k for i in range(len(w) - 7) if seen[tuple(w[i : i + 8])] > 1 for k in range(8)}
    return len(w), sum(map(len, w)), sum(c in SYMBOLS for c in t), len(lines) - len(set(lines)), len(hit)


def test_blocks_split_words_like_the_pattern():
    texts = ["a b  c\n", "", None, "é x\ty", "\x0b\x0c a\x1cb", "  ", "x" * 5000]
    got = {}
    for i, j, b in chunks(pa.array(texts), 16):
        h, ptr = b.word_hash(), b.word_ptr
        for k in range(b.n):
            got[i + k] = [bytes(b.data[s:e]).decode() for s, e in zip(b.start[ptr[k] : ptr[k + 1]], b.end[ptr[k] : ptr[k + 1]])]
            assert len(h) == len(b.start)
    assert got == {i: WORDS.findall(t or "") for i, t in enumerate(texts)}


def test_short_texts_have_one_shingle():
    ((_, _, b),) = chunks(pa.array(["a b", "", "a b c d e f", "a b"]))
    grams, ptr = shingles(b.word_hash(), b.word_ptr, 5)
    assert np.diff(ptr).tolist() == [1, 0, 2, 1] and grams[0] == grams[3]


def test_measures_equal_brute_force():
    rng = random.Random(2)
    texts = ["\n".join(rng.choice(["a b c d e f g h", "x # $ | y", "", " ", prose(rng, 9)]) for _ in range(rng.randint(0, 9))) for _ in range(120)]
    for i, j, b in chunks(pa.array(texts), 300):
        m = Q.measures(b)
        got = list(zip(*[m[k].tolist() for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]))
        assert got == [brute(t) for t in texts[i:j]]


def test_binomial_cdf_is_exact():
    for n, p in ((10, 0.3), (400, 0.01), (57, 0.9)):
        for k in (0, 1, n // 2, n - 1, n):
            want = sum(comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1))
            assert abs(Q.binomial_cdf(k, n, p) - want) < 1e-9


def test_cutoffs_keep_their_promise():
    good, bad = np.zeros(Q.BINS + 1, int), np.zeros(Q.BINS + 1, int)
    good[0], bad[150] = 5000, 100
    cut = Q.certified_cutoff(good, bad, 0.01, 0.01)
    assert cut == 149  # all bad ones go, no good one, as high as can be
    good[160] = 200  # 4 % of the good would be lost
    assert Q.certified_cutoff(good, bad, 0.01, 0.01) == Q.BINS
    assert Q.certified_cutoff(good[:] * 0, bad, 0.01, 0.01) == Q.BINS


def test_rules_over_documents(spark, docs, texts, empty):
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(60)] + [(1, 0, 0), (None, 1, 1), (2, None, None)], "doc_id long, quality int, toxic int")
    got = Q.quality_rules(docs, labels).collect()
    want = Counter((d, *brute(t)) for d, t in texts)
    assert Counter((r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) for r in got) == want
    for r in got:
        assert r["base_failed"] == (r["n_words"] < 20 or 100 * r["n_repeat_words"] > 30 * r["n_words"])
        assert not (r["base_failed"] and r["kept"])
    assert Q.quality_rules(empty, labels).count() == 0
    assert Q.quality_rules(docs, labels.limit(0)).where("kept = base_failed").count() == 0


def test_a_certified_rule_rejects(spark):
    rng = random.Random(1)
    rows = [(i, (("# " * 40) if i % 5 == 0 else "") + prose(rng, 40), "en", "s") for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    labels = spark.createDataFrame([(i, int(i % 5 != 0)) for i in range(3000)], "doc_id long, quality int")
    out = {r["doc_id"]: r["kept"] for r in Q.quality_rules(docs, labels, alpha=0.05, delta=0.05).collect()}
    assert not any(out[i] for i in range(0, 3000, 5)) and sum(out.values()) >= 2390


def test_kept_equals_brute_force(spark):
    """Cutoffs by exact binomial sums over all candidates, then every document judged."""
    rng = random.Random(14)
    alpha, delta, rows, labels = 0.2, 0.2, [], []
    for i in range(3000):
        t = prose(rng, rng.randint(5, 60))
        kind = rng.randrange(6)
        t = {0: t.upper(), 1: t + " #" * rng.randint(1, 40), 2: "\n".join([t] * 3), 3: t + "!" * rng.randint(1, 30)}.get(kind, t)
        rows.append((i, t, rng.choice(["en", "fr", None]), "s"))
        if rng.random() < 0.8:
            labels.append((i, int(rng.random() < (0.003 if kind < 4 else 0.97))))
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = {
        r["doc_id"]: (r["base_failed"], r["failed_rule"], r["kept"]) for r in Q.quality_rules(
            df,
            spark.createDataFrame(labels, "doc_id long, quality int"),
            alpha=alpha,
            delta=delta,
        ).collect()
    }
    label = dict(labels)

    def shares(t):
        n, chars, symbols, dup, repeats = brute(t)
        lines = sum(bool(WORDS.search(x)) for x in t.split("\n"))
        part = {
            "symbols": (symbols, chars),
            "dup_lines": (dup, lines),
            "repeats": (repeats, n),
            "capitals": (sum("A" <= c <= "Z" for c in t), chars),
            "exclaims": (t.count("!"), n),
        }
        return n < 20 or 100 * repeats > 30 * n, {k: min(Q.BINS, Q.BINS * a // max(1, b)) for k, (a, b) in part.items()}

    facts = {i: (s, *shares(t)) for i, t, s, _ in rows}
    strata = {s for s, failed, _ in facts.values()}
    tail = lambda k, n: sum(comb(n, i) * alpha_r**i * (1 - alpha_r) ** (n - i) for i in range(k + 1))
    alpha_r = alpha / len(Q.RULES)
    cut = {}
    for s in strata:
        known = [(bins, label[i]) for i, (x, failed, bins) in facts.items() if x == s and not failed and i in label]
        for rule in Q.RULES:
            best, gain = Q.BINS, 0
            for b in range(Q.BINS - 1, -1, -1):
                lost, won = (sum(bins[rule] > b and y == k for bins, y in known) for k in (1, 0))
                if tail(lost, sum(y for _, y in known)) > delta / (len(Q.RULES) * len(strata)):
                    break
                if won - 10 * lost > gain:
                    best, gain = b, won - 10 * lost
            cut[s, rule] = best
    want = {}
    for i, (s, failed, bins) in facts.items():
        rule = "base" if failed else next((r for r in Q.RULES if bins[r] > cut[s, r]), None)
        want[i] = (failed, rule, rule is None)
    assert got == want and len({v[1] for v in want.values()}) >= 4
