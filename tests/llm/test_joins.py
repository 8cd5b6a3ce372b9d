import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from cuegrid.llm import decontaminate as D
from cuegrid.llm import licenses as L
from cuegrid.llm import ngram_join as N
from tests.llm.conftest import DOCS, WORDS, lower, prose, row


def sets(texts):
    out = {}
    for k, (_, t) in enumerate(texts):
        w = WORDS.findall(lower(t))
        if w:
            out[k] = frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)])
    return out


def brute_links(texts, t=0.8):
    s = sets(texts)
    links = defaultdict(set)
    for a in s:
        for b in s:
            if a < b and len(s[a] & s[b]) >= t * len(s[a] | s[b]) - 1e-9:
                links[a].add(b), links[b].add(a)
    return links


def check_join(found, texts):
    links = brute_links(texts)
    got = defaultdict(list)
    for r in found:
        got[r["doc_id"]].append((r["n_links"], r["class_id"]))
    want = defaultdict(list)
    for k, (d, _) in enumerate(texts):
        group, todo = {k}, [k]
        while todo:
            todo += [x for x in links[todo.pop()] if x not in group and not group.add(x)]
        ids = [texts[x][0] for x in group if texts[x][0] is not None]
        want[d].append((len(links[k]), min(ids) if ids else None))
    key = lambda x: (x[0], x[1] is None, x[1] or 0)
    assert {d: sorted(x, key=key) for d, x in got.items()} == {d: sorted(x, key=key) for d, x in want.items()}


def test_join_equals_brute_force(docs, texts):
    check_join(N.ngram_join(docs).collect(), texts)  # rows without an id too


@pytest.mark.parametrize("block", [7, 1000])
def test_large_groups_are_cut_into_blocks(spark, monkeypatch, block):
    rng = random.Random(9)
    base = prose(rng, 60).split()
    rows = []
    for i in range(60):
        w = list(base)
        w[rng.randrange(60)] = f"w{i}"
        rows.append((i, " ".join(w)))
    monkeypatch.setattr(N, "BLOCK_CLASSES", block)
    df = spark.createDataFrame([row(*r) for r in rows], DOCS)
    check_join(N.ngram_join(df).collect(), rows)


def test_recall_at_the_threshold(spark):
    """Pairs at 0.8 to 0.82 only, the hardest the join has to find, with the registered parameters."""
    rng = random.Random(33)
    rows, n = [], 0
    while n < 1000:
        w = [f"w{rng.randrange(10**9)}" for _ in range(rng.randint(49, 120))]
        v = list(w)
        for at in rng.sample(range(0, len(w), 6), max(1, round(len(w) * 0.022))):
            v[at] = "anders"
        a, b = ({tuple(x[i : i + 5]) for i in range(len(x) - 4)} for x in (w, v))
        if 0.8 <= len(a & b) / len(a | b) <= 0.82:
            rows += [(2 * n, " ".join(w)), (2 * n + 1, " ".join(v))]
            n += 1
    out = N.ngram_join(spark.createDataFrame([row(*r) for r in rows], DOCS)).collect()
    missed = sum(r["class_id"] != r["doc_id"] // 2 * 2 for r in out)
    assert missed <= 1, missed


def test_near_copies_do_not_hide_pairs_at_the_threshold(spark):
    """600 pairs at 0.80 to 0.82 beside 30 families of 100 nearly equal texts, with the registered parameters."""
    rng = random.Random(34)
    rows, n = [], 0
    while n < 600:
        w = [f"w{rng.randrange(10**9)}" for _ in range(rng.randint(49, 120))]
        v = list(w)
        for at in rng.sample(range(0, len(w), 6), max(1, round(len(w) * 0.022))):
            v[at] = "anders"
        a, b = ({tuple(x[i : i + 5]) for i in range(len(x) - 4)} for x in (w, v))
        if 0.8 <= len(a & b) / len(a | b) <= 0.82:
            rows += [(2 * n, " ".join(w)), (2 * n + 1, " ".join(v))]
            n += 1
    for f in range(30):
        w = [f"f{rng.randrange(10**9)}" for _ in range(400)]
        rows += [(10_000 + 100 * f + i, " ".join([*w, f"x{i}"])) for i in range(100)]
    out = N.ngram_join(spark.createDataFrame([row(*r) for r in rows], DOCS)).collect()
    missed = sum(r["class_id"] != r["doc_id"] // 2 * 2 for r in out if r["doc_id"] < 10_000)
    assert missed <= 1, missed
    assert all(r["class_id"] == r["doc_id"] // 100 * 100 and r["n_links"] == 99 for r in out if r["doc_id"] >= 10_000)


def test_prefixes_are_shortened_as_far_as_the_links_need(spark):
    assert N.least_depth(0.8, 0.9999) < N.DEPTH and N.met(0.8, N.least_depth(0.8, 0.9999)) >= 0.9999
    like, unlike = np.zeros(N.BINS, int), np.zeros(N.BINS, int)
    like[-1], unlike[0] = 10**6, 10**6
    assert N.estimated_recall(like, 0.8, N.DEPTH, N.DEPTH) > 0.9999  # nearly equal texts: the full depth does
    assert N.estimated_recall(unlike, 0.8, N.DEPTH, N.DEPTH) < 0.99 < N.estimated_recall(unlike, 0.8, N.DEPTH, 5)
    assert N.estimated_recall(np.zeros(N.BINS, int), 0.8, N.DEPTH, N.DEPTH) < 0.99  # nothing found is no proof
    both = like.copy()
    both[3] = 1  # one pair of less likeness asks for its own recall, however many others there are
    assert N.estimated_recall(both, 0.8, N.DEPTH, N.DEPTH) < 0.999 < 0.9999 <= N.estimated_recall(both, 0.8, N.DEPTH, 4)


def test_tries_keep_matched_keys_only(spark):
    rng = random.Random(2)
    sigs = [bytes(rng.randrange(256) for _ in range(N.TREES * N.DEPTH * N.VALUE)) for _ in range(40)]
    sigs += [s[:10] + bytes(310) for s in sigs[:10]]  # five values of the first tree
    df = spark.createDataFrame([(i, i, 1, 3, bytearray(s)) for i, s in enumerate(sigs)], "set_hash long, copy_id long, copies long, n long, sig binary")
    rows = N.forest(df, 4).collect()
    first = {r["set_hash"]: r["deep"] for r in rows if r["tree"] == 0}
    assert first == {i: 5 for i in [*range(10), *range(40, 50)]}
    # the zero keys of the other trees: ten equal ones in each
    assert all(r["set_hash"] >= 40 and r["deep"] == N.DEPTH for r in rows if r["tree"])


def test_join_of_nothing(empty):
    assert N.ngram_join(empty).count() == 0


def test_components_reach_far(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "a long, b long")
    assert {r["root"] for r in N.connected(chain).collect()} == {0, 100}


def dwords(t):
    return re.sub(r"[\W_]+", " ", t.lower()).split()


def brute_leaks(texts, items):
    out = {}
    for d, t in texts:
        w = dwords(t)
        for i, it in items:
            x = dwords(it)
            if len(x) < 5:
                continue
            b = Counter(tuple(x[k : k + 5]) for k in range(len(x) - 4))
            for s in range(5 - len(x), max(1, len(w) - 4)):  # cut at both ends of the text
                v = w[max(0, s) : s + len(x)]
                a = Counter(tuple(v[k : k + 5]) for k in range(len(v) - 4))
                if a and (sim := sum((a & b).values()) / sum((a | b).values())) >= 0.8:
                    out[d, i] = max(out.get((d, i), 0), sim)
    return out


def test_leaks_equal_brute_force(spark, docs, texts):
    rng = random.Random(5)
    items = [(i, prose(rng, rng.randint(14, 59)).capitalize() + ".") for i in range(25)] + [(90, None), (91, ""), (92, "a b c")]
    extra = []
    for i in range(25):
        w = items[i][1].split()
        if i % 3 == 1:
            w[len(w) // 2] = "geändert"
        if i % 3 == 2:
            w = w[: len(w) - 1]
        extra.append((1000 + i, f"{prose(rng, rng.randint(0, 50))} {' '.join(w).upper()} {prose(rng, 20)}"))
    extra += [(2000, items[3][1]), (2001, items[3][1]), (2001, items[3][1]), (2002, items[1][1] + " " + items[2][1])]
    df = docs.unionByName(spark.createDataFrame([row(*e) for e in extra], DOCS))
    bench = spark.createDataFrame([(i, t, 0, 0) for i, t in [*items, items[0]]], "item_id long, text string, distance int, similarity int")
    got = {(r["doc_id"], r["item_id"]): r["similarity"] for r in D.leaks(df, bench).collect()}
    want = brute_leaks(texts + extra, [(i, t or "") for i, t in items])
    assert set(got) == set(want) and len(got) >= 20
    assert all(abs(got[k] - want[k]) < 1e-9 for k in got)


def test_windows_at_the_threshold_are_within_the_radius(spark):
    """Passages whose edge words are replaced until the similarity is just above 0.8, all words distinct: the farthest a match can be."""
    rng = random.Random(40)
    words = lambda n: [f"w{rng.randrange(10**9)}" for _ in range(n)]
    items, rows = [], []
    for i in range(1500):
        x = words(rng.randint(30, 60))
        n = len(x) - 4
        gone = max(k for k in range(n) if (n - k) / (n + k) >= 0.8)  # so many shingles may go
        items.append((i, " ".join(x)))
        rows.append((i, " ".join([*words(20), *x[gone // 2 : len(x) - (gone - gone // 2)], *words(20)])))
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {r["doc_id"] for r in D.leaks(spark.createDataFrame([row(*r) for r in rows], DOCS), bench).collect() if r["doc_id"] == r["item_id"]}
    assert len(got) >= 1499, len(got)


def test_long_items_take_linear_work(spark):
    rng = random.Random(41)
    long = " ".join(f"w{rng.randrange(3000)}" for _ in range(8000))
    bench = spark.createDataFrame([(1, long), (2, prose(rng, 20))], "item_id long, text string")
    df = spark.createDataFrame([row(i, f"{prose(rng, 30)} {long} {i}") for i in range(8)], DOCS)
    assert sorted((r["doc_id"], r["item_id"], r["similarity"], r["n_words"]) for r in D.leaks(df, bench).collect()) == [(i, 1, 1.0, 8000) for i in range(8)]


def test_leaks_of_nothing(spark, docs, empty):
    bench = spark.createDataFrame([], "item_id long, text string")
    assert D.leaks(docs, bench).count() == 0
    assert D.leaks(empty, spark.createDataFrame([(1, "a b c d e f g")], "item_id long, text string")).count() == 0


def test_hamming_blocks_find_all_pairs_within_the_radius(spark):
    rng = random.Random(3)
    left = [rng.getrandbits(64) - (1 << 63) for _ in range(40)]
    right = [x ^ sum(1 << b for b in rng.sample(range(63), rng.randint(0, 20))) for x in left]
    a = spark.createDataFrame(list(enumerate(left)), "wh long, fp long")
    b = spark.createDataFrame(list(enumerate(right)), "item_id long, item_fp long")
    got = Counter((r["wh"], r["item_id"], r["distance"]) for r in D.hamming_pairs(a, b).collect())
    dist = lambda x, y: bin((x ^ y) & ((1 << 64) - 1)).count("1")
    want = Counter((i, j, dist(x, y)) for i, x in enumerate(left) for j, y in enumerate(right) if dist(x, y) <= D.RADIUS)
    assert got == want


def brute_spans(t, template, threshold=0.8):
    """The best value over all spans of all lengths."""
    cut = lambda x: re.findall(r"[a-z0-9\x80-\U0010ffff]+", lower(x))
    pairs = lambda w: list(zip(w, w[1:]))
    w, b = pairs(cut(t)), Counter(pairs(cut(template)))
    size, best = sum(b.values()), 0
    for s in range(len(w)):
        a, common = Counter(), 0
        for e in range(s, len(w)):
            a[w[e]] += 1
            common += a[w[e]] <= b[w[e]]
            best = max(best, 2 * common / (e - s + 1 + size))
    return best if best >= threshold else None


def test_licenses_equal_brute_force(spark, docs, empty):
    rng = random.Random(8)
    names = list(L.TEMPLATES)
    rows = [
        (1, L.TEMPLATES["mit"]),
        (2, "x " + L.TEMPLATES["apache-2.0-notice"].upper() + " y"),
        (3, None),
        (4, ""),
        (5, "released under the mit"),
        (6, "released under the bsd license"),
    ]
    for i in range(20):
        w = L.TEMPLATES[rng.choice(names)].split()
        for _ in range(rng.randint(0, 1 + len(w) // 12)):
            w[rng.randrange(len(w))] = "anders"
        rows.append((10 + i, prose(rng, rng.randint(0, 30)) + " " + "\n".join(w) + " " + prose(rng, 10)))
    df = spark.createDataFrame([row(*r) for r in rows], DOCS)
    got = {(r["doc_id"], r["license"]): r["dice"] for r in L.license_scan(df).collect()}
    want = {(d, n): v for d, t in rows for n, x in L.TEMPLATES.items() if (v := brute_spans(t or "", x))}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in got) and len(got) >= 15
    assert L.license_scan(empty).count() == 0
    assert L.license_scan(docs).count() == 0


def test_licenses_of_any_span_length_equal_brute_force(spark):
    rng = random.Random(9)
    names = ["mit", "isc", "zlib", "mpl-2.0-notice", "gpl-3.0-header", "cc-by-4.0-notice"]
    known, rows = {n: L.TEMPLATES[n] for n in names}, []
    for i in range(24):
        w = known[names[i % 6]].split()
        if i % 4 == 0:
            w = w[: len(w) - int(len(w) * rng.uniform(0.2, 0.36))]
        elif i % 4 == 1:
            del w[len(w) // 3 : len(w) // 3 + int(len(w) * rng.uniform(0.15, 0.3))]
        else:
            for j in sorted(rng.sample(range(4, len(w) - 1), min(3, len(w) - 5)), reverse=True):
                w[j:j] = ["zusatz"] * int(len(w) * rng.uniform(0.05, 0.2))
        rows.append((i, prose(rng, 40) + " " + " ".join(w) + " " + prose(rng, 80)))
    rows.append((99, "x " + " ".join(known["mit"].split()[:115]) + " " + prose(rng, 200)))
    df = spark.createDataFrame([row(*r) for r in rows], DOCS)
    got = {(r["doc_id"], r["license"]): r["dice"] for r in L.license_scan(df, known).collect()}
    want = {(d, n): v for d, t in rows for n, x in known.items() if (v := brute_spans(t, x))}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in got) and (99, "mit") in got and len(got) >= 12


def test_related_licenses_are_told_apart(spark):
    rng = random.Random(10)
    names = [
        "bsd-2-clause",
        "bsd-3-clause",
        "mit",
        "mit-0",
        "isc",
        "0bsd",
        "gpl-2.0-header",
        "gpl-3.0-header",
        "agpl-3.0-header",
        "gpl-2.0-opening",
        "gpl-3.0-opening",
        "mpl-2.0-opening",
    ]
    rows = [row(i, f"{prose(rng, 30)} {L.TEMPLATES[n].lower()} {prose(rng, 40)}") for i, n in enumerate(names)]
    rows.append(row(99, L.TEMPLATES["mit"] + " " + prose(rng, 50) + " " + L.TEMPLATES["bsd-3-clause"]))
    found = L.license_scan(spark.createDataFrame(rows, DOCS)).collect()
    best = defaultdict(set)
    for r in found:
        if r["best"]:
            best[r["doc_id"]].add(r["license"])
    assert {k: v for k, v in best.items() if k != 99} == {i: {n} for i, n in enumerate(names)} and best[99] == {"mit", "bsd-3-clause"}
    assert any(r["license"] == "bsd-2-clause" and not r["best"] for r in found if r["doc_id"] == 1)


def test_a_shingle_repeated_through_a_long_text(spark):
    """The words of the item's shingle fill a long text; the passage itself stands in it once."""
    from cuegrid.llm.decontaminate import leaks

    rng = random.Random(5)
    item = ["la"] * 12 + [f"q{rng.randrange(10**6)}" for _ in range(28)]
    filler = ["la"] * 6000
    long = " ".join(filler[:3000] + item + filler[3000:])
    docs = spark.createDataFrame([row(1, long), row(2, " ".join(filler)), row(3, " ".join(item))], DOCS)
    bench = spark.createDataFrame([(7, " ".join(item)), (8, " ".join(f"z{i}" for i in range(30)))], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): (r["similarity"], r["n_words"]) for r in leaks(docs, bench).collect()}
    assert got == {(1, 7): (1.0, 40), (3, 7): (1.0, 40)}
