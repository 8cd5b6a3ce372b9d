"""The pipeline over planted documents, stage by stage, against brute force."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from cuegrid.llm import queries
from tests.llm.conftest import WORDS, prose
from tests.llm.test_joins import brute_leaks, brute_links


@pytest.fixture(scope="module")
def planted(spark, tmp_path_factory):
    """A folder of tables, and the ids planted in documents."""
    rng = random.Random(12)
    items = [(i, prose(rng, 30)) for i in range(6)]
    rows, labels, ids = [], [], {"toxic": set(), "poor": set(), "copies": set(), "leaks": set()}
    for i in range(700):
        t, toxic, poor = prose(rng, rng.randint(8, 60)), i % 9 == 0, i % 6 == 1
        if poor:
            t = t.upper().replace(" ", "!! ")
        if toxic:
            t += " idiotling"
        ids["toxic"] |= {i} if toxic else set()
        ids["poor"] |= {i} if poor else set()
        rows.append((i, t, "en", f"s{i % 4}", len(t)))
        labels.append((i, int(not poor), int(toxic)))
    clean = [r for r in rows if r[0] not in ids["toxic"] | ids["poor"]]
    for k, r in enumerate(clean[:20]):
        rows.append((1000 + k, r[1] if k % 2 else r[1].capitalize() + " zusatz" * (len(r[1].split()) > 30), "en", "s1", 1))
        ids["copies"].add(1000 + k)
    for k in range(6):
        rows.append((2000 + k, f"{prose(rng, 20)} {items[k][1]} {prose(rng, 15)}", "fr", None, 1))
        ids["leaks"].add(2000 + k)
    rows += [(3000, clean[30][1], "en", "s0", 1), (3000, clean[30][1], "en", "s0", 1), (3001, None, None, None, None), (None, prose(rng, 40), "en", "s2", 1)]
    at = tmp_path_factory.mktemp("tables")
    spark.createDataFrame(
        rows,
        "doc_id long, text string, lang string, source string, n_chars long",
    ).withColumn("extra", F.lit(1)).repartition(3).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return str(at), ids, items


def test_stages(spark, planted):
    d, ids, items = planted
    docs = P.table(spark, d, "documents").select(*P.COLUMNS)
    seen = [docs]
    for name, stage in P.STAGES:
        seen.append(P.materialise(stage(spark, seen[-1], d)))
        if name != "mixing":
            assert seen[-1].columns == P.COLUMNS
    kept = [{r["doc_id"] for r in x.select("doc_id").collect()} for x in seen]
    gone = [a - b for a, b in zip(kept, kept[1:])]
    rows = [[(r["doc_id"], r["text"] or "") for r in x.collect()] for x in seen[:4]]
    # toxicity and quality: what was planted goes, almost nothing else does
    assert len(ids["toxic"] - gone[0]) <= 2 and len(gone[0] - ids["toxic"]) <= 7
    poor = ids["poor"] - gone[0]
    assert len(poor - gone[1]) <= 3 and len(gone[1] - poor) <= 10
    # near copies: of each group the smallest id stays, and one of rows that share it
    links = brute_links(rows[2])
    parent = list(range(len(rows[2])))

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a, bs in links.items():
        for b in bs:
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    groups = {}
    for k, (i, _) in enumerate(rows[2]):
        if i is not None:
            groups.setdefault(root(k), set()).add(i)
    assert kept[3] == {min(g) for g in groups.values()} | ({None} & kept[2])
    assert seen[3].count() == len(kept[3])
    assert len(ids["copies"] & gone[2]) >= 10
    # leaks
    want = {i for i, _ in brute_leaks([r for r in rows[3] if r[0] is not None], items)}
    assert gone[3] == want and ids["leaks"] & kept[3] <= want
    # the mix keeps all rows and comes near its targets
    assert kept[5] == kept[4]
    sizes = {i: len(WORDS.findall(t)) for i, t in ((r["doc_id"], r["text"] or "") for r in seen[4].collect())}
    out = seen[5].collect()
    assert all(r["size"] == sizes[r["doc_id"]] and 0 <= r["taken"] <= 3 * r["size"] for r in out)
    total = {}
    for r in out:
        total.setdefault((r["source_size"], r["target"]), []).append(r["taken"])
    assert all(abs(sum(v) - t) <= max(20, 0.02 * t) for (_, t), v in total.items())


def test_run_equals_its_stages_and_queries_are_named(spark, planted):
    d = planted[0]
    out = P.run(spark, d)
    assert out.columns == ["doc_id", "size", "source_size", "target", "taken"] and out.count() > 400
    assert sorted(queries.queries()) == sorted(f.__name__ for f in queries.QUERIES) and len(P.STAGES) == 5 and P.ORACLE_SQL is None


def test_pipeline_of_empty_tables_and_odd_rows(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("odd"))
    rng = random.Random(3)
    base, other, third = prose(rng, 80), prose(rng, 70), prose(rng, 60)
    kinds = "doc_id long, text string, lang string, source string, n_chars long"
    rows = [
        (1, base, "en", "a", 1),
        (5, base + " mehr", "en", "a", 1),
        (5, other, "en", None, 1),
        (None, base, None, "b", 1),
        (None, third, None, "b", 1),
        (None, third + " x", None, "b", 1),
        (7, prose(rng, 30000), "en", "a", 1),
        (8, None, None, None, None),
        (9, "", "en", "a", 0),
    ]
    for name, data, kind in (("documents", rows, kinds), ("labels", [], "doc_id long, quality int, toxic int"), ("benchmark", [], "item_id long, text string")):
        spark.createDataFrame(data, kind).write.parquet(f"{at}/{name}.parquet")
    kept = P.drop_copies(spark, P.table(spark, at, "documents"), at)
    # of the rows that share the id 5 only the copy goes; rows without an id are copies too
    assert sorted(
        (r["doc_id"] or 0, (r["text"] or "")[:20]) for r in kept.collect() if r["doc_id"] != 7
    ) == sorted([(1, base[:20]), (5, other[:20]), (0, third[:20]), (8, ""), (9, "")])
    assert P.drop_leaks(spark, P.table(spark, at, "documents"), at).count() == len(rows)
    assert P.drop_toxic(spark, P.table(spark, at, "documents"), at).count() == len(rows)
    none = str(tmp_path_factory.mktemp("none"))
    for name, kind in (("documents", kinds), ("labels", "doc_id long, quality int, toxic int"), ("benchmark", "item_id long, text string")):
        spark.createDataFrame([], kind).write.parquet(f"{none}/{name}.parquet")
    assert P.run(spark, none).count() == 0
