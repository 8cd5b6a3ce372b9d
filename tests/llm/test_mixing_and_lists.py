import itertools
import random
from collections import defaultdict

from pyspark.sql import functions as F

from cuegrid.llm import mixing as X
from cuegrid.llm import url_filter as U
from tests.llm.conftest import DOCS, WORDS, prose, row


def test_targets_stop_at_three_times_the_size():
    assert X.capped_targets([100, 100, 100], [1, 2, 3]) == [50, 100, 150]
    got = X.capped_targets([1000, 10, 10], [1, 2, 3])
    assert got == [960, 30, 30] and X.capped_targets([], []) == [] and X.capped_targets([0, 5], [1, 2]) == [0, 5]


def test_flow_is_the_cheapest():
    capacity, members, demand = [4, 3, 5], [[0], [0, 1], [1, 2]], [5, 4, 6]
    flow = X.cheapest_flow(capacity, members, demand, 2)
    cost = lambda f: sum(max(0, sum(x) - c) for x, c in zip(f, capacity))
    filled = [sum(f[k] for f, m in zip(flow, members) for k, s in enumerate(m) if s == j) for j in range(3)]
    assert filled == demand and all(sum(f) <= 2 * c for f, c in zip(flow, capacity))
    best = min(
        cost(((a,), (b, c), (d, e))) for a, b, c, d, e in itertools.product(
            range(9),
            range(7),
            range(7),
            range(11),
            range(11),
        ) if (a + b, c + d, e) == (5, 4, 6) and a <= 8 and b + c <= 6 and d + e <= 10
    )
    assert cost(flow) == best


def test_mix_reaches_its_targets(spark, docs, texts, empty):
    out = X.mix_documents(docs).collect()
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["size"]) for r in out) == sorted((d is None, d or 0, len(WORDS.findall(t))) for d, t in texts)
    by = defaultdict(lambda: [0, 0.0, 0])
    for r in out:
        assert 0 <= r["taken"] <= 3 * r["size"] and (r["size"] == 0 or r["taken"] % r["size"] == 0)
        k = r["pattern"][0]
        by[k] = [by[k][0] + r["size"], r["target"], by[k][2] + r["taken"]]
    names = sorted(by, key=lambda s: (s is None, s or ""))
    want = X.capped_targets([by[s][0] for s in names], [1 + i % 3 for i in range(len(names))])
    for s, t in zip(names, want):
        assert abs(by[s][1] - t) < 1e-9
    key = lambda rows: sorted((r["doc_id"] is None, r["doc_id"] or 0, r["size"], r["taken"]) for r in rows)
    assert key(out) == key(X.mix_documents(docs.orderBy("text")).collect())
    assert X.mix_documents(empty).count() == 0


def test_taken_words_come_near(spark):
    rng = random.Random(3)
    rows = [row(i, prose(rng, rng.choice([1, 5, 30, 200])), "en", rng.choice(["a", "a", "a", "b", "c", None])) for i in range(800)]
    out = X.mix_documents(spark.createDataFrame(rows, DOCS))
    for r in out.groupBy("pattern").agg(F.sum("taken").alias("t"), F.first("target").alias("g")).collect():
        assert abs(r["t"] - r["g"]) <= 0.005 * r["g"]


def test_a_giant_document_blocks_no_others(spark):
    giant = {"a": 1, "b": 1, "c": 1}
    for seed in range(6):
        # each source's rest is 55 to 90 % of its words and not much more than its giant
        rows = [(1000 * k + i, [s], 9000 if i < giant[s] else 40 + i % 7) for k, s in enumerate("abc") for i in range(280)]
        out = X.mix(spark.createDataFrame(rows, "doc_id long, sources array<string>, size long").repartition(3), seed=seed).collect()
        for s in "abc":
            mine = [r for r in out if r["pattern"] == [s]]
            room = round(mine[0]["target"]) - sum(r["taken"] for r in mine)
            assert 0 <= room < min((r["size"] for r in mine if not r["picked"]), default=1 << 40) and room < 47, (seed, s, room)


def check_filled(out, short=lambda target, least: least):
    """Each pattern's taken words are below the target by less than the smallest row left."""
    by = defaultdict(list)
    for r in out:
        by[tuple(r["pattern"])].append(r)
    for p, mine in by.items():
        room = round(mine[0]["target"]) - sum(r["taken"] for r in mine)
        least = min((r["size"] for r in mine if r["size"] and not r["picked"]), default=1)
        assert 0 <= room < short(mine[0]["target"], least), (p, room, least)


def test_repeated_rows_are_taken_one_by_one(spark):
    # nine documents of 100 words and one of 33 (31) words that stands in 30 rows
    rows = [(1000 * k + i, [s], 100) for k, s in enumerate("ab") for i in range(9)] + [(500, ["a"], 33)] * 30 + [(1500, ["b"], 31)] * 30
    rows += [(1, ["a"], 10)] * 7 + [(51, ["b"], 0), (None, ["b"], 5), (None, ["b"], 5)]
    for seed in range(4):
        out = X.mix(spark.createDataFrame(rows, "doc_id long, sources array<string>, size long"), seed=seed).collect()
        assert len(out) == len(rows)
        check_filled(out)


def test_tiny_sources_whole_epochs_and_one_document(spark):
    # source c is taken three times over; d holds one document, e none with a word
    rows = [(i, ["a"], 50 + i % 11) for i in range(200)] + [(300 + i, ["b"], 1) for i in range(400)] + [
        (800, ["c"], 7),
        (801, ["d"], 5000),
        (802, ["e"], 0),
        (803, [None], 3),
    ]
    out = X.mix(spark.createDataFrame(rows, "doc_id long, sources array<string>, size long")).collect()
    check_filled(out)
    assert {r["doc_id"]: r["epochs"] for r in out}[800] == 3


def test_choice_equals_brute_force(spark):
    """The hash order up to the first row that doesn't fit, then from large classes to small, told by the rows' hashes."""
    rng = random.Random(21)
    rows = [(i, rng.choice("abc"), int(rng.paretovariate(0.7)) % 5000) for i in range(900)]
    df = spark.createDataFrame([(i, [s], n) for i, s, n in rows], "doc_id long, sources array<string>, size long")
    out = {r["doc_id"]: r for r in X.mix(df).collect()}
    hashes = {r["doc_id"]: r["h"] for r in df.select("doc_id", F.xxhash64(F.lit(11), "doc_id", F.lit(1).cast("long")).alias("h")).collect()}
    for s in "abc":
        mine = sorted(((hashes[i] & (1 << 64) - 1, i, n) for i, x, n in rows if x == s and n))
        room = round(out[mine[0][1]]["target"]) - sum(n for _, _, n in mine) * out[mine[0][1]]["epochs"]
        want = set()
        while mine and mine[0][2] <= room:
            room -= mine[0][2]
            want.add(mine.pop(0)[1])
        while fits := [x for x in mine if x[2] <= room]:
            top = max(x[2].bit_length() for x in fits)
            h, i, n = min(x for x in fits if x[2].bit_length() == top)
            room -= n
            want.add(i)
            mine.remove((h, i, n))
        assert want == {i for i, x, _ in rows if x == s and out[i]["picked"]}


def test_overlapping_sources_share_documents(spark):
    rows = [(i, ["a"] if i < 50 else ["a", "b"] if i < 100 else ["b", None], 10) for i in range(150)]
    out = X.mix(spark.createDataFrame(rows, "doc_id long, sources array<string>, size long"))
    assert out.agg(F.sum("taken")).first()[0] == 1500 and out.where("taken > 3 * size").count() == 0


def entries(spark, rows):
    return spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "key string, action string, day long, seq long")


def test_lists_are_read_as_of_the_fetch(spark):
    e = entries(
        spark,
        [
            ("Bad.org", "block", 10),
            ("bad.org", "remove", 20),
            ("bad.org", "block", 30),
            ("bad.org/ok", "allow", 30),
            ("x.bad.org", "allow", 40),
            ("tie.org", "block", 5),
            ("tie.org", "allow", 5),
            (None, "block", 1),
            ("n.org", None, 1),
            ("n.org", "block", None),
            ("deep.org/a/b/c/d/e", "block", 1),
            ("b.c.d.e.long.tld", "block", 1),
            ("single", "block", 1),
        ],
    )
    urls = [
        ("http://bad.org/", 9, None, True),
        ("https://user@www.bad.org:80/a?b#c", 10, "bad.org", False),
        ("http://bad.org", 20, None, True),
        ("bad.org/ok/page", 35, "bad.org/ok", True),
        ("http://bad.org/okay", 35, "bad.org", False),
        ("http://x.bad.org./z", 45, "x.bad.org", True),
        ("http://notbad.org", 15, None, True),
        ("http://tie.org", 7, "tie.org", True),
        ("http://BAD.org/OK/x", 35, "bad.org", False),
        ("http://deep.org/a/b/c/d/e/f", 5, "deep.org/a/b/c/d/e", False),
        ("http://deep.org/a/b/c/d/E", 5, None, True),
        ("http://a.b.c.d.e.long.tld/x", 5, "b.c.d.e.long.tld", False),
        ("http://any.single", 5, "single", False),
        ("http://x.org/" + "p/" * 20000, 5, None, True),
        ("http://bad.org/", 10, "bad.org", False),
        ("http://bad.org/", 10, "bad.org", False),
        (None, 15, None, True),
        ("", 15, None, True),
        ("http://bad.org", None, None, True),
        ("http://n.org", 9, None, True),
    ]
    df = spark.createDataFrame(
        [(i, u, d, "x", "y") for i, (u, d, _, _) in enumerate(urls)],
        "page_id long, url string, fetch_day long, key string, action string",
    )
    got = {r["page_id"]: (r["matched_key"], r["allowed"]) for r in U.url_filter(df, e).collect()}
    assert got == {i: (k, a) for i, (_, _, k, a) in enumerate(urls)}
    assert U.url_filter(df.limit(0), e).count() == 0 and U.url_filter(df, e.limit(0)).where("NOT allowed").count() == 0
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    assert {r["page_id"]: (r["matched_key"], r["allowed"]) for r in U.url_filter(df, e).collect()} == got
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_equal_captures_are_looked_up_once(spark):
    captures = spark.range(2000).selectExpr("id page_id", "concat('http://a', id % 3, '.example.net/x/y') url", "5 + id % 2 fetch_day")
    entries = spark.createDataFrame([("example.net", "block", 1, 0)], "key string, action string, day long, seq long")
    out = U.url_filter(captures, entries)
    assert out.where("NOT allowed").count() == 2000
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    at = plan.index("Generate")
    assert "Aggregate [url" in plan[at:]  # distinct before the keys are exploded
