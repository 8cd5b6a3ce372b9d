import __spark_entry__ as entry
from cuegrid.plans import oracle, queries


def test_every_sql_has_a_query():
    assert set(oracle.SQL) <= set(queries.QUERIES)
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_ten_operators_and_the_pipeline_where_they_exist():
    names = entry.queries()
    if entry.HAS_LLM:
        assert all(sum(n.startswith(f"op{i}_") for n in names) == 1 for i in range(1, 11)) and "pipeline" in names
    else:
        assert not any(n.startswith("op") and n[2:3].isdigit() for n in names)


def test_flagship(spark):
    df = entry.entry(spark)
    assert df.columns == ["track_id", "scene_no", "cues", "passed", "for_review", "critical_issues", "points"] and df.count() > 0


def test_queries_equal_their_sql_on_the_smallest_tables(spark):
    import os

    import duckdb
    import pytest

    d = "/root/testdata/sf0.001"
    if not os.path.isdir(d):
        pytest.skip("no tables here")
    con = duckdb.connect()
    for f in os.listdir(d):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{d}/{f}'")
    for name in ("cue_metrics", "scene_segments", "qc_eval", "retime", "chrf_pairs", "category_rollup", "srt_roundtrip", "cost_scene"):
        got = queries.QUERIES[name](spark, d)
        cols = sorted(got.columns)
        want = con.execute(f"SELECT {', '.join(cols)} FROM ({oracle.SQL[name]})").fetchall()
        key = lambda r: tuple(map(str, r))
        assert sorted(map(tuple, got.select(*cols).collect()), key=key) == sorted(want, key=key), name
