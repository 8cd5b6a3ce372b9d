"""Versioned state tables: versions, racing writers, killed runs, compaction."""

import threading

import pytest
from pyspark.sql import functions as F

from cuegrid.sources.state import StateTable

SCHEMA = "k string, n long, v string, xs array<string>"


def rows(spark, *values):
    return spark.createDataFrame([(*v, None) if len(v) == 3 else v for v in values], SCHEMA)


def content(df):
    return {(r["k"], r["n"]): r["v"] for r in df.collect()}


def test_versions_and_last_rows(spark, tmp_path):
    t = StateTable(spark, str(tmp_path / "t"), SCHEMA, ["k", "n"])
    assert t.version() == 0 and t.read().count() == 0 and t.read().schema.names == ["k", "n", "v", "xs"]
    assert t.upsert(rows(spark, ("a", 1, "x"), ("b", 1, "y"), (None, 1, "z"), ("a", 1, "w"))) == 1
    assert content(t.read()) == {("a", 1): "x", ("b", 1): "y", (None, 1): "z"}
    assert t.upsert(rows(spark, ("a", 1, None), ("c", 2, "q")).withColumn("more", F.lit(1))) == 2
    assert t.delete(rows(spark, ("b", 1, None), (None, 1, None), ("no", 9, None)).select("k", "n")) == 3
    assert content(t.read()) == {("a", 1): None, ("c", 2): "q"}
    assert content(t.read(1)) == {("a", 1): "x", ("b", 1): "y", (None, 1): "z"}
    assert t.upsert(rows(spark).limit(0)) == 3 and t.delete(t.read().limit(0)) == 3
    assert t.upsert(rows(spark, ("b", 1, "back", ["u"]))) == 4 and content(t.read())["b", 1] == "back"
    again = StateTable(spark, str(tmp_path / "t"), SCHEMA, ["k", "n"])
    assert again.compact() == 5 and len(again.folders()) == 1 and content(again.read()) == content(t.read(4))
    again.vacuum(1)
    assert len(list((tmp_path / "t" / "data").iterdir())) == 1 and content(t.read()) == {("a", 1): None, ("b", 1): "back", ("c", 2): "q"}
    with pytest.raises(ValueError, match="outside"):
        StateTable(spark, "x", SCHEMA, ["none"])


def test_writers_at_once_lose_nothing(spark, tmp_path):
    path, failed = str(tmp_path / "t"), []

    def write(i):
        try:
            t = StateTable(spark, path, SCHEMA, ["k", "n"])
            for j in range(2):
                t.upsert(rows(spark, (f"w{i}", j, "v"), ("shared", 0, f"{i}{j}")))
        except Exception as e:  # noqa: BLE001
            failed.append(e)

    threads = [threading.Thread(target=write, args=(i,)) for i in range(4)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    t = StateTable(spark, path, SCHEMA, ["k", "n"])
    assert not failed and t.version() == 8 and len(set(t.folders())) == 8
    assert set(content(t.read())) == {(f"w{i}", j) for i in range(4) for j in range(2)} | {("shared", 0)}


def test_a_name_is_taken_once(spark, tmp_path):
    t = StateTable(spark, str(tmp_path / "t"), SCHEMA, ["k"])
    t.upsert(rows(spark, ("a", 1, "x")))
    assert not t._publish(1, []) and t.folders(1) != []
    # the newer manifest is read and followed
    seen = []

    def change(folders):
        if not seen:
            t._publish(2, [*folders, "other"])
        seen.append(list(folders))
        return folders

    assert t._commit(change) == 3 and seen[1][-1] == "other"


def test_compaction_keeps_what_comes_meanwhile(spark, tmp_path, monkeypatch):
    t = StateTable(spark, str(tmp_path / "t"), SCHEMA, ["k", "n"])
    for i in range(3):
        t.upsert(rows(spark, ("a", i, str(i)), ("b", 0, str(i))))
    lay = t._lay

    def slow(frame, gone):
        name = lay(frame, gone)
        monkeypatch.setattr(t, "_lay", lay)
        t.upsert(rows(spark, ("late", 0, "l"), ("b", 0, "late")))
        return name

    monkeypatch.setattr(t, "_lay", slow)
    t.compact()
    assert len(t.folders()) == 2 and content(t.read()) == {("a", 0): "0", ("a", 1): "1", ("a", 2): "2", ("late", 0): "l", ("b", 0): "late"}


def test_a_killed_run_leaves_no_half_state(spark, tmp_path):
    t = StateTable(spark, str(tmp_path / "t"), SCHEMA, ["k", "n"])
    t.upsert(rows(spark, ("a", 1, "x")))
    bad = rows(spark, ("a", 1, "half"), ("b", 2, "half")).withColumn("v", F.when(F.col("n") == 2, F.raise_error(F.lit("killed"))).otherwise(F.col("v")))
    with pytest.raises(Exception, match="killed"):
        t.upsert(bad)
    t._lay(rows(spark, ("c", 1, "unpublished")), False)
    assert t.version() == 1 and content(t.read()) == {("a", 1): "x"}
    t.vacuum()
    assert len(list((tmp_path / "t" / "data").iterdir())) == 1


def test_many_writes_are_compacted(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("cuegrid.sources.state.COMPACT_AT", 3)
    t = StateTable(spark, str(tmp_path / "t"), SCHEMA, ["k"])
    for i in range(4):
        t.upsert(rows(spark, (f"k{i}", i, "v")))
    assert len(t.folders()) == 2 and t.read().count() == 4
    for i in range(4):
        t.delete(rows(spark, (f"k{i}", i, None)).select("k"))
    assert t.read().count() == 0
