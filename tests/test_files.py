"""The data source of subtitle files: packing, pushed filters, streams, committed and aborted writes."""

import json
import re

import pytest
from pyspark.sql import functions as F

from cuegrid.sources import files, subtitles, writers

ONE = "1\n00:00:01,000 --> 00:00:02,000\n{}\n"
LAYOUT = {"srt": {"head": "H\n", "sep": "\n", "tail": "T\n", "numbered": True}}


@pytest.fixture
def folder(tmp_path):
    at = tmp_path / "in"
    for name, text in (
        ("s1/film.srt", ONE.format("hello")),
        ("s2/film.srt", ONE.format("other") + "\n2\nnonsense --> x\nbad\n"),
        ("s2/deep/a.vtt", "WEBVTT\n\n00:01.000 --> 00:02.000\nvee\n"),
        ("b.ass", "[Events]\nDialogue: 0,0:00:01.00,0:00:02.00,D,,0,0,0,,ay, bee\n"),
        ("none.srt", ""),
        ("blank.srt", " \n "),
        ("_hidden.srt", ONE.format("no")),
    ):
        (at / name).parent.mkdir(parents=True, exist_ok=True)
        (at / name).write_text(text, encoding="utf-8")
    (at / "latin.srt").write_bytes(ONE.format("caf\xe9").encode("latin-1"))
    return at


def cue_set(df):
    return sorted(tuple(r) for r in df.select("track_id", "cue_id", "start_ms", "end_ms", "source_text", "speaker").collect())


def plain(spark, folder):
    read = subtitles.read_files(spark, str(folder))
    return read.withColumn("path", subtitles.below(spark, str(folder), F.col("path")))


def test_the_format_gives_the_cues_of_a_scan(spark, folder):
    files.register(spark)
    df = spark.read.format("timed_text").option("partitionBytes", 100).load(str(folder))
    cues, bad = subtitles.scan(df)
    want, want_bad = subtitles.scan(plain(spark, folder))
    assert cue_set(cues) == cue_set(want) and len(cue_set(cues)) == 5 and bad.collect() == want_bad.collect()
    assert {r["track_id"] for r in cues.collect()} == {"s1/film.srt", "s2/film.srt", "s2/deep/a.vtt", "b.ass", "latin.srt"}
    refused = {r["path"]: r["reason"] for r in df.where("reason IS NOT NULL").collect()}
    assert refused == {"none.srt": "empty", "blank.srt": "blank"} == {r["path"]: r["reason"] for r in subtitles.guard(plain(spark, folder)).collect()}
    assert {r["format"] for r in df.collect()} == {"srt", "vtt", "ass"}
    flat = spark.read.format("timed_text").option("recursive", "false").load(str(folder))
    assert {r["path"] for r in flat.collect()} == {"b.ass", "none.srt", "blank.srt", "latin.srt"}


def test_filters_reach_the_listing(spark, folder):
    files.register(spark)
    df = spark.read.format("timed_text").load(str(folder))
    for asked, names in (
        ("format = 'vtt'", {"s2/deep/a.vtt"}),
        ("format IN ('ass', 'vtt')", {"s2/deep/a.vtt", "b.ass"}),
        ("path LIKE 's2/%' AND size > 50", {"s2/film.srt"}),
        ("path LIKE '%film%' AND format = 'srt'", {"s1/film.srt", "s2/film.srt"}),
        ("path = 'b.ass'", {"b.ass"}),
        ("path LIKE '%.vtt'", {"s2/deep/a.vtt"}),
    ):
        assert {r["path"] for r in df.where(asked).collect()} == names, asked
    plan = df.where("format = 'vtt' AND size > 1")._jdf.queryExecution().executedPlan().toString()
    assert "= vtt" not in re.findall(r"Filter \(?(.*)", plan)[0] and "> 1" in re.findall(r"Filter \(?(.*)", plan)[0]
    reader = files.Reader({"path": str(folder)})
    left = list(reader.pushFilters([files.EqualTo(("format",), "vtt"), files.EqualTo(("size",), 3)]))
    assert left == [files.EqualTo(("size",), 3)] and [f.path for p in reader.partitions() for f in p.files] == ["s2/deep/a.vtt"]


def test_files_are_packed_by_size():
    made = [files.File(str(i), size, 0) for i, size in enumerate([5, 5, 5, 50, 1, 1, 1])]
    assert [[f.size for f in p.files] for p in files.packed(made, 10, 100)] == [[5, 5], [5], [50], [1, 1, 1]]
    assert [len(p.files) for p in files.packed(made, 1000, 3)] == [3, 3, 1] and files.packed([], 10, 10) == []


def test_a_stream_takes_each_file_once(spark, folder, tmp_path):
    files.register(spark)
    df = spark.readStream.format("timed_text").load(str(folder))
    at = {"checkpointLocation": str(tmp_path / "cp")}

    def run():
        cues, _ = subtitles.scan(df)
        q = cues.writeStream.format("parquet").options(path=str(tmp_path / "out"), **at).trigger(availableNow=True).start()
        assert q.awaitTermination(120)
        return cue_set(spark.read.parquet(str(tmp_path / "out")))

    want, _ = subtitles.scan(plain(spark, folder))
    first = cue_set(want)
    assert run() == first and run() == first
    (folder / "new.srt").write_text(ONE.format("new"), encoding="utf-8")
    assert run() == sorted([*first, ("new.srt", 1, 1000, 2000, "new", None)])


def blocks(spark, rows):
    return spark.createDataFrame(rows, "track_id string, kind string, seq long, block string")


def test_writes_are_whole_and_replaced(spark, tmp_path):
    out = str(tmp_path / "out")
    files.save(blocks(spark, [("a/x", "srt", 2, "two"), ("a/x", "srt", 1, "one"), ("b/x", "srt", 1, None), ("y.SRT", "srt", 1, "y")]).repartition(3), out, LAYOUT)
    have = lambda: {str(f.relative_to(tmp_path / "out")): f.read_text() for f in sorted((tmp_path / "out").rglob("*")) if f.is_file()}
    assert have() == {"srt/a/x.srt": "H\n1\none\n2\ntwoT\n", "srt/b/x.srt": "H\n1\nT\n", "srt/y.SRT": "H\n1\nyT\n"}
    files.save(blocks(spark, [("n", "srt", 1, "n")]), out, LAYOUT)
    assert len(have()) == 4
    files.save(blocks(spark, [("n", "srt", 1, "m")]), out, LAYOUT, overwrite=True)
    assert have() == {"srt/n.srt": "H\n1\nmT\n"}
    files.save(blocks(spark, []), out, LAYOUT, overwrite=True)
    assert have() == {}


def test_an_aborted_write_leaves_no_file(spark, tmp_path):
    out = tmp_path / "out"
    files.save(blocks(spark, [("kept", "srt", 1, "k")]), str(out), LAYOUT)
    rows = blocks(spark, [(f"t{i}", "srt", 1, str(i)) for i in range(40)])
    bad = rows.withColumn("block", F.when(F.col("track_id") == "t39", F.raise_error(F.lit("killed")).cast("string")).otherwise(F.col("block")))
    with pytest.raises(Exception):
        files.save(bad, str(out), LAYOUT, overwrite=True)
    for name in ("../up", "", "a//b", "."):
        with pytest.raises(Exception, match="can't be a file"):
            files.save(blocks(spark, [(name, "srt", 1, "x")]), str(out), LAYOUT)
    assert [str(f.relative_to(out)) for f in out.rglob("*") if f.is_file()] == ["srt/kept.srt"] and not list(out.glob("_drafts*"))
    w = files.Writer({"path": str(out), "layouts": json.dumps(LAYOUT)}, False)
    with pytest.raises(ValueError, match="two tasks"):
        w.commit([files.Written("x", [("0", "srt/a.srt")]), files.Written("y", [("0", "srt/a.srt")])])


def test_many_tracks_need_few_tasks(spark, tmp_path):
    n = 3000
    rows = spark.range(2 * n).selectExpr("concat('d', id % 7, '/t', id div 2) track_id", "'srt' kind", "id seq", "cast(id as string) block")
    arranged = files.arranged(rows)
    assert arranged.rdd.getNumPartitions() <= 8
    files.save(rows, str(tmp_path / "out"), LAYOUT)
    assert sum(1 for _ in (tmp_path / "out").rglob("*.srt")) == rows.select("track_id").distinct().count()


def test_all_outputs_equal_the_texts(spark, tmp_path):
    from cuegrid.plans import queries

    judged = queries.evaluated(spark, "/root/testdata/sf0.001")
    writers.save_all(judged, str(tmp_path / "out"))
    for kind, texts in (("srt", writers.to_srt(judged)), ("vtt", writers.to_vtt(judged)), ("ass", writers.to_ass(judged)), ("html", writers.to_html(judged, writers._judgements(judged)))):
        for r in texts.collect():
            assert (tmp_path / "out" / kind / f"{r['track_id']}.{kind}").read_text(encoding="utf-8") == r["content"]
    reports = {r["track_id"]: json.loads(r["content"]) for r in writers.to_qc_report(judged).collect()}
    assert reports == {t: json.loads((tmp_path / "out" / "qc" / f"{t}.qc").read_text(encoding="utf-8")) for t in reports}
