"""The whole way of files, its parts, and the shape of the plans."""

import random
import re
from dataclasses import replace

import pandas as pd
import pytest
from pyspark.sql import functions as F

from cuegrid import constants as K
from cuegrid.operators import provider, quality, review, scenes, scoring
from cuegrid.plans import process as P
from cuegrid.plans import queries
from cuegrid.profiles import HOUSE, Profile, load_profile
from cuegrid.sources import subtitles
from tests.test_operators import CUE, cue_rows

FILM = """1
00:00:01,000 --> 00:00:03,000
CAPTAIN: You're pushing your luck.

2
00:00:04,000 --> 00:00:06,000
[Speaking Spanish]

9
00:00:07,000 --> 00:00:07,300
hello my friend
"""


@pytest.fixture
def folder(tmp_path):
    at = tmp_path / "in"
    at.mkdir()
    (at / "film.srt").write_text(FILM, encoding="utf-8")
    (at / "long.srt").write_text(
        "\n\n".join(f"{i + 1}\n00:{i // 60:02d}:{i % 60:02d},000 --> 00:{i // 60:02d}:{i % 60:02d},900\nyes, number {i}" for i in range(45)),
        encoding="utf-8",
    )
    (at / "none.srt").write_text("", encoding="utf-8")
    return at


def outputs(at):
    return {f"{k}/{f.relative_to(at / k)}": f.read_text(encoding="utf-8") for k in ("srt", "vtt", "ass", "html", "qc") for f in sorted((at / k).rglob("*")) if f.is_file()}


def test_files_to_five_outputs_and_back_from_the_state(spark, folder, tmp_path):
    calls = spark.sparkContext.accumulator(0)

    def say(texts):
        calls.add(len(texts))
        return texts.str.lower().str.replace("4", "")

    out, terms = tmp_path / "out", {"luck": ("بەخت", "honorific")}
    run = P.process(spark, str(folder), str(out), provider.BatchProvider(say), terms=terms)
    made = outputs(out)
    assert sorted(made) == sorted(["srt/film.srt", "srt/long.srt"] + [f"{k}/{t}.srt.{k}" for k in ("vtt", "ass", "html", "qc") for t in ("film", "long")])
    assert made["srt/film.srt"].startswith("1\n00:00:01,000 --> 00:00:03,000\nبەخت") and "\n3\n00:00:07,000" in made["srt/film.srt"]
    assert f"[{K.LANGUAGES['spanish']} {K.SPEAKS}]" in made["vtt/film.srt.vtt"] and made["vtt/film.srt.vtt"].startswith("WEBVTT\n") and "[Events]" in made["ass/film.srt.ass"]
    page = made["html/film.srt.html"]
    assert page.startswith("<!DOCTYPE html>") and page.count("<tr>") == 4 and "English left" in page and '"total_cues":3' in made["qc/film.srt.qc"]
    summary = run.summary.first().asDict()
    assert (summary["cues"], summary["lookups"], summary["failed_scenes"]) == (48, 47, 0) and summary["queue"] == run.queue.count() > 0
    assert [(r["path"], r["reason"]) for r in run.refused.collect()] == [("none.srt", "empty")]
    assert run.cues.where("track_id = 'film.srt' AND seq = 2").first()["origin"] == "routed"
    asked = calls.value
    assert asked == 47
    # a second run takes everything from the state
    again = P.process(spark, str(folder), str(out), provider.BatchProvider(say), terms=terms)
    assert calls.value == asked and again.version == run.version and again.summary.first().asDict() == summary and outputs(out) == made
    # a new file is the only thing that is worked on
    (folder / "new.srt").write_text(FILM, encoding="utf-8")
    third = P.process(spark, str(folder), str(out), provider.BatchProvider(say), terms=terms)
    assert calls.value == asked + 2 and third.summary.first()["cues"] == 51
    # other terms, another provider or profile: all scenes are worked on
    P.process(spark, str(folder), str(out), provider.BatchProvider(say))
    assert calls.value > asked + 40
    before = calls.value
    P.process(spark, str(folder), str(out), provider.BatchProvider(say, name="other"))
    assert calls.value > before + 40


def test_equal_names_changed_and_deleted_files(spark, tmp_path):
    at, out = tmp_path / "in", tmp_path / "out"
    cue = "{0}\n00:00:0{0},000 --> 00:00:0{0},900\n{1}\n"
    for name, words in (("a/x.srt", ["hello", "goodbye"]), ("b/x.srt", ["thanks"]), ("season=1/x.srt", ["yes"])):
        (at / name).parent.mkdir(parents=True, exist_ok=True)
        (at / name).write_text("\n".join(cue.format(i + 1, w) for i, w in enumerate(words)), encoding="utf-8")
    say = provider.BatchProvider(lambda texts: "<" + texts + ">")
    texts = lambda run: {(r["track_id"], r["seq"]): (r["source_text"], r["target_text"], r["start_ms"]) for r in run.cues.collect()}
    got = texts(P.process(spark, str(at), str(out), say))
    assert got == {
        ("a/x.srt", 1): ("hello", "<hello>", 1000),
        ("a/x.srt", 2): ("goodbye", "<goodbye>", 2000),
        ("b/x.srt", 1): ("thanks", "<thanks>", 1000),
        ("season=1/x.srt", 1): ("yes", "<yes>", 1000),
    }
    assert (out / "srt/a/x.srt").read_text().count("-->") == 2 and (out / "srt/b/x.srt").read_text().count("-->") == 1
    # by a pattern the tracks are named below its fixed part
    assert set(texts(P.process(spark, str(at / "*"), str(tmp_path / "other"), say))) == set(got)
    (at / "a/x.srt").write_text(cue.format(3, "changed"), encoding="utf-8")
    (at / "b/x.srt").unlink()
    now = texts(P.process(spark, str(at), str(out), say))
    assert now == {("a/x.srt", 1): ("changed", "<changed>", 3000), ("season=1/x.srt", 1): ("yes", "<yes>", 1000)}
    assert sorted(k for k in outputs(out) if k.startswith("srt")) == ["srt/a/x.srt", "srt/season=1/x.srt"]
    assert sorted(f.name for f in out.iterdir()) == ["ass", "html", "qc", "srt", "state", "vtt"]


def test_memory_of_earlier_runs(spark, tmp_path):
    at, out = tmp_path / "in", str(tmp_path / "out")
    at.mkdir()
    (at / "one.srt").write_text("1\n00:00:01,000 --> 00:00:03,000\nyes\n", encoding="utf-8")
    first = P.process(spark, str(at), out, remember=True)
    assert [r["origin"] for r in first.cues.collect()] == ["provider"] and first.memory.count() == 1
    (at / "two.srt").write_text("1\n00:00:01,000 --> 00:00:03,000\nYes\n", encoding="utf-8")
    second = P.process(spark, str(at), out, remember=True)
    assert {r["track_id"]: (r["origin"], r["target_text"]) for r in second.cues.collect()} == {"one.srt": ("provider", "بەڵێ"), "two.srt": ("memory", "بەڵێ")}


def test_one_bad_text_falls_back_alone(spark):
    tries = spark.sparkContext.accumulator(0)

    def say(texts):
        tries.add(1)
        if (texts == "bad 17").any():
            raise provider.ProviderError(400)
        return texts.str.upper()

    c = cue_rows(spark, *[(i * 1000, i * 1000 + 900, f"bad {i}", None) for i in range(40)]).coalesce(1).select("track_id", "seq", "source_text")
    got = {r["seq"]: r["translation"] for r in provider.BatchProvider(say, fallback=None, backoff=0).translate(c).collect()}
    assert got == {i + 1: None if i == 17 else f"BAD {i}" for i in range(40)} and tries.value < 60

    def short(texts):
        return texts.iloc[:-1]

    assert set(r["translation"] for r in provider.BatchProvider(short, backoff=0, retries=1).translate(c).collect()) == {f"bad {i}" for i in range(40)}


def test_failed_scenes_are_tried_again(spark, folder, tmp_path):
    def fail(texts):
        raise provider.ProviderError(503)

    out = str(tmp_path / "out")
    first = P.process(spark, str(folder), out, provider.BatchProvider(fail, retries=2, fallback=None, backoff=0))
    s = first.summary.first()
    assert s["failed_scenes"] == 3 and s["passed"] == 0 and s["queue"] == s["cues"] == 48
    assert P.process(spark, str(folder), out).summary.first()["failed_scenes"] == 0


def test_memory_comes_before_the_provider_and_grows(spark):
    c = scenes.segment(cue_rows(spark, (0, 2000, "hello my friends", None), (2500, 4000, "yes", None)))
    mem = spark.createDataFrame(
        [(1, "hello my friend", "سڵاو هاوڕێیان", None, 1)],
        "tm_id long, source_text string, target_text string, context_notes string, version long",
    )
    out = P.localize(c, memory=mem)
    assert [r["origin"] for r in out.orderBy("seq").collect()] == ["memory", "provider"]
    kept = {r["source_text"]: r["target_text"] for r in P.new_memory(out).collect()}
    assert kept["yes"] == "بەڵێ"


def test_scenes_are_analyzed_translated_and_verified(spark):
    """A provider that fails now and then: whole calls pass on a retry, one bad cue falls back alone, and the second opinion is asked for what awaits review only."""
    tries, sizes, asked = spark.sparkContext.accumulator(0), spark.sparkContext.accumulator(0), spark.sparkContext.accumulator(0)

    def flaky(cues):
        """Fails with a code that may pass at the first call for each scene, and for good where the cue `bad` is in it."""
        tries.add(1)
        if (cues["source_text"] == "bad").any():
            raise provider.ProviderError(500)

    def analyze(cues):
        flaky(cues)
        sizes.add(len(cues))
        return ["means " + t for t in cues["source_text"]]

    def translate(cues):
        flaky(cues)
        return [f"{m}!" for m in cues["meaning"]]

    def verify(cues):
        asked.add(len(cues))
        return [("disagree", "major", "other") if "3" in t else ("agree", "none", None) for t in cues["source_text"]]

    rows = [("t", i, i * 1000, i * 1000 + 950, "bad" if i == 7 else f"line {i}", None, None) for i in range(40)] + [("u", 1, 0, 5000, "hi there", "سڵاو", None)]
    segmented = scenes.segment(spark.createDataFrame(rows, CUE))
    made = provider.SceneProvider(translate, analyze, verify, retries=2, backoff=0, calls=3, fallback=lambda cues: cues["source_text"])
    out = {(r["track_id"], r["seq"]): r for r in P.localize(segmented, made, profile=replace(HOUSE, review_below=100)).collect()}
    assert len(out) == 41
    assert out["t", 7]["meaning"] == "bad" and out["t", 7]["target_text"].startswith("bad")
    assert all(out["t", i]["meaning"] == f"means line {i}" and out["t", i]["target_text"].replace("\n", " ") == f"means line {i}!" for i in range(40) if i != 7)
    reviewed = {k for k, r in out.items() if r["requires_review"]}
    assert asked.value >= len(reviewed) > 0
    for k, r in out.items():
        doubted = k in reviewed and "3" in r["source_text"]
        assert (r["decision"], r["escalated"], r["alternative"]) == (("disagree", True, "other") if doubted else ("agree", False, None)), k
    # without a fallback a cue that fails leaves its scene failed, and only its scene
    none = P.localize(segmented, provider.SceneProvider(translate, analyze, retries=1, backoff=0))
    assert {(r["track_id"], r["scene_no"]) for r in none.where("failed").collect()} == {("t", 1)}


def test_calls_keep_their_rate():
    import time

    asker = provider.Asker(lambda items: items, rate=50)
    began = time.monotonic()
    for _ in range(11):
        asker.ask(pd.Series(["x"]))
    assert time.monotonic() - began >= 0.19


def test_strict_scans_fail(spark, folder):
    files = subtitles.read_files(spark, str(folder))
    with pytest.raises(Exception, match="empty file"):
        subtitles.scan(files, strict=True)[0].collect()
    with pytest.raises(Exception, match="no cues"):
        subtitles.scan(spark.createDataFrame([("a.srt", "words only")], "path string, content string"), strict=True)[0].collect()
    assert subtitles.scan(files.where("size > 0"), strict=True)[0].count() == 48


def test_tracks_of_other_origins(spark):
    probes = spark.createDataFrame(
        [
            ("a", '{"streams":[{"codec_type":"audio"},{"codec_type":"subtitle","codec_name":"ass","tags":{"language":"ger","title":"Forced"}}]}'),
            ("b", "{"),
            ("c", None),
        ],
        "media string, probe string",
    )
    got = subtitles.embedded_candidates(probes).collect()
    assert [tuple(r) for r in got] == [("a", "a#1", "ger", "ass", "forced", 50)]
    master = subtitles.master_track(subtitles.embedded_candidates(probes), files=probes).collect()
    assert {r["media"]: (r["format"], r["score"]) for r in master} == {"a": ("ass", 50), "b": ("asr", 70), "c": ("asr", 70)}


def test_large_dictionaries_are_joined_on_their_first_characters(spark, monkeypatch):
    texts = spark.createDataFrame([(1, "Under the Weather"), (2, "a b"), (3, ""), (4, None), (5, "THE")], "id long, text string")
    terms = spark.createDataFrame(
        [("the", False), ("The", True), ("weather", False), ("b", False), ("er", None), ("", False), (None, False), ("nowhere", False)],
        "term string, case_sensitive boolean",
    )
    join = lambda: sorted((r["id"], r["term"]) for r in review.contains_join(texts, terms, "text", case_sensitive="case_sensitive").collect())
    small = join()
    monkeypatch.setattr(review, "FOLD_BYTES", 10)
    assert join() == small and (1, "er") in small and (1, "The") not in small and (5, "the") in small


def test_large_dictionaries_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(review, "FOLD_BYTES", 10)
    rng = random.Random(12)
    word = lambda n: "".join(rng.choice("abcdé ΣσςİA") for _ in range(n))
    texts = [(i, word(rng.randint(0, 60))) for i in range(200)] + [(200, None), (201, ""), (0, "twice"), (0, "twice"), (202, "x" * 5000 + "ΟΔΟΣa")]
    terms = [(word(rng.randint(1, 5)), rng.random() < 0.3) for _ in range(800)] + [("", False), (None, True), ("twi", False), ("twi", False), ("ΟΔΟΣ", True), ("xxxxx", False)]
    frame = spark.createDataFrame([(*t, "own") for t in texts], "id long, t string, gram string").repartition(3)
    entries = spark.createDataFrame([(*t, "e") for t in terms], "term string, case_sensitive boolean, note string").repartition(3)
    got = review.contains_join(frame, entries, "t", case_sensitive="case_sensitive")
    assert got.columns == ["id", "t", "gram", "term", "case_sensitive", "note"]
    monkeypatch.setattr(review, "FOLD_BYTES", 1 << 30)
    want = review.contains_join(frame, entries, "t", case_sensitive="case_sensitive")
    rows = lambda df: sorted((r["id"], r["t"], r["term"], r["case_sensitive"]) for r in df.collect())
    assert rows(got) == rows(want) and len(rows(got)) > 1000
    brute = sum(1 for _, t in texts if t is not None for x, exact in terms if x is not None and (x in t if exact else x == ""))
    assert sum(1 for r in rows(got) if r[3] or r[2] == "") == brute


def test_a_hundred_thousand_terms(spark):
    n = 100_000
    terms = spark.range(n).selectExpr("concat('term ', lpad(cast(id as string), 6, '0')) term")
    texts = spark.range(300).selectExpr("id", "concat('a long line with term ', lpad(cast(id * 331 as string), 6, '0'), ' in it') t")
    got = review.contains_join(texts, terms, "t")
    assert got.where("contains(t, term)").count() == got.count() == 300
    # what is dealt by grams are numbers and grams; the texts move with their pairs alone
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate explode") >= 2


def _joined(plan) -> list[int]:
    """Rows of each join of a plan that has run."""
    kind = plan.getClass().getSimpleName()
    if kind == "AdaptiveSparkPlanExec":
        return _joined(plan.executedPlan())
    below = [plan.plan()] if kind.endswith("QueryStageExec") else [plan.children().apply(i) for i in range(plan.children().size())]
    own = [plan.longMetric("numOutputRows").value()] if kind.endswith("JoinExec") else []
    return own + [n for x in below for n in _joined(x)]


def test_words_of_the_same_characters_meet_few_terms(spark):
    # three letters: each term's runs of three characters stand in nearly every text
    rng = random.Random(4)
    words = ["".join(rng.choice("abc") for _ in range(14)) for _ in range(3000)]
    texts = spark.createDataFrame([(i, " ".join(rng.choice(words) + "x" for _ in range(8))) for i in range(1000)], "id long, t string")
    terms = spark.createDataFrame([(w[2:],) for w in words] + [(f"{w[4:]}x {words[0]}",) for w in words], "term string")
    got = review.contains_join(texts, terms, "t")
    n = len(got.collect())
    assert n >= 7000 and max(_joined(got._jdf.queryExecution().executedPlan())) <= 4 * n


def test_large_dictionaries_of_blanks_and_long_words(spark, monkeypatch):
    rng = random.Random(5)
    word = lambda n: "".join(rng.choice("ab") for _ in range(n))
    long = [word(200) for _ in range(4)]
    texts = [f"{x}{y}{z}" for x in long for y in (" ", "\t", " \n ", "\u00a0", "") for z in long] + ["", "   ", " x", "Aa bB"]
    terms = [x[i : i + n] for x in long for i in (0, 3, 90) for n in (1, 31, 32, 33, 63, 64, 65, 110)] + ["", " ", "  ", "\t", " \n", "\u00a0", "a ", " b", "a b", "b \n a", "aA Bb", long[0] + " " + long[1][:40]]
    frame = spark.createDataFrame(list(enumerate(texts)), "id long, t string")
    entries = spark.createDataFrame([(x, i % 2 == 0) for i, x in enumerate(terms)], "term string, exact boolean")
    monkeypatch.setattr(review, "FOLD_BYTES", 10)
    got = sorted((r["id"], r["term"], r["exact"]) for r in review.contains_join(frame, entries, "t", case_sensitive="exact").collect())
    assert got == sorted((i, x, k % 2 == 0) for i, t in enumerate(texts) for k, x in enumerate(terms) if (x in t if k % 2 == 0 else x.lower() in t.lower()))


def test_providers_by_name_and_their_cache(spark, tmp_path):
    assert isinstance(
        provider.get_provider(" Dictionary "),
        provider.DictionaryProvider,
    ) and isinstance(provider.get_provider("x"), provider.DictionaryProvider)
    with pytest.raises(ValueError, match="unknown"):
        provider.get_provider("x", fallback=False)
    calls = spark.sparkContext.accumulator(0)

    def say(texts):
        calls.add(len(texts))
        return texts.str.upper()

    c = cue_rows(spark, (0, 900, "hello", None), (1000, 1900, "hello", None), (2000, 2900, "x", None)).select("track_id", "seq", "source_text")
    cached = provider.CachedProvider(provider.BatchProvider(say), str(tmp_path / "answers"))
    for _ in range(2):
        assert sorted(r["translation"] for r in cached.translate(c).collect()) == ["HELLO", "HELLO", "X"]
    assert calls.value == 2
    tries = spark.sparkContext.accumulator(0)

    def refuse(texts):
        tries.add(1)
        raise provider.ProviderError(401)

    assert {r["translation"] for r in provider.BatchProvider(refuse, fallback=None).translate(c.limit(1)).collect()} == {None} and tries.value == 1


def test_profiles(spark, tmp_path):
    at = tmp_path / "p.json"
    at.write_text('{"profiles": {"kids": {"hard_max_cps": 12, "max_lines": "1", "other": 3}}, "qc": {"linguistic": false}}')
    kids = load_profile(at, "kids")
    assert (kids.hard_max_cps, kids.max_lines, kids.linguistic, kids.hard_max_cpl) == (12, 1, False, K.HARD_MAX_CPL)
    at.write_text("{")
    assert load_profile(at) == load_profile(tmp_path / "no") == load_profile(None) == HOUSE
    c = cue_rows(spark, (0, 1000, "x", "ا" * 15 + "ê"))
    rules = lambda p: {r["rule"] for r in quality.issues_long(quality.evaluate(c, profile=p)).collect()}
    assert rules(HOUSE) == {"kurmanji_contamination"} and rules(kids) == {"hard_max_cps"}
    assert rules(Profile(technical=False, linguistic=False, semantic=False)) == set()


def test_messages_and_records(spark):
    c = cue_rows(spark, (0, 700, "Is Mary in 5?", "movie"), (1000, 9000, "[speaking Thai]", "x"))
    said = {r["rule"]: r["message"] for r in quality.issues_long(quality.evaluate(c)).where("seq = 1").collect()}
    assert said["min_duration"] == "shown for 700 ms, less than 800" and said["untranslated_english"] == "English left: movie" and said["number_inconsistency"] == "numbers lost: 5"
    heard = spark.createDataFrame([("t", 1, "is mary in 6?")], "track_id string, seq long, transcript string")
    r = quality.cue_records(c, heard).orderBy("seq").collect()
    assert r[0]["mismatch"] > 0 and r[0]["suspicious_names"] and r[0]["note"] == "possible names: 1" and r[1]["foreign_speech"] and r[1]["mismatch"] == 0 and r[1]["transcript"] is None


def test_ensemble_keeps_what_the_second_lacks(spark):
    a = spark.createDataFrame([("t", 1, "سڵاو"), ("t", 2, "باش")], "track_id string, seq long, translation string")
    out = {r["seq"]: (r["second"], r["score"]) for r in scoring.ensemble(a, a.where("seq = 1")).collect()}
    assert out == {1: ("سڵاو", 100), 2: ("", 0)}


def test_scenes_cut_neighbours(spark):
    rows = [("t", i, i * 1000, i * 1000 + 500, "x", f"t{i}", None) for i in range(65)]
    got = scenes.segment(spark.createDataFrame(rows, CUE).repartition(3)).orderBy("seq").collect()
    for a, b in zip(got, got[1:]):
        same = a["scene_no"] == b["scene_no"]
        assert a["next_start_ms"] == (b["start_ms"] if same else None) and b["prev_target"] == (a["target_text"] if same else None)
    assert got[0]["prev_target"] is None and got[-1]["next_start_ms"] is None and got[-1]["scene_no"] == 3


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_findings_are_made_once(spark):
    optimized = lambda name: queries.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    long, short = optimized("qc_issues"), optimized("qc_summary")
    for what in ("regexp_extract_all", "regexp_replace"):
        assert 0 < long.count(what) <= short.count(what) + 1, what


def test_plans(spark):
    """One exchange brings the cues of a track together; files are read once and no rows of theirs are moved."""
    d = "/root/testdata/sf0.001"
    qc = plan_of(queries.QUERIES["qc_issues"](spark, d))
    assert len(re.findall(r"Exchange hash", qc)) == 1 and qc.count("FileScan") == 1 and qc.count("MapInArrow") == 1
    files = spark.createDataFrame([("a.srt", FILM)], "path string, content string")
    cues, bad = subtitles.scan(files)
    assert "Exchange" not in plan_of(cues) and "Exchange" not in plan_of(bad) and plan_of(cues).count("Scan ExistingRDD") == 1
    assert cues.select(F.max("cue_id")).first()[0] == 3


def test_gold_sets(spark, tmp_path):
    at = tmp_path / "gold.json"
    at.write_text(
        '[{"id": 1, "category": "idiom", "source": "yes", "gold_sorani": "بەڵێ", "acceptable_alternatives": ["ئا"], "unacceptable_literal_examples": []},\n {"id": 2, "category": "idiom", "source": "wait"}]',
        encoding="utf-8",
    )
    got = subtitles.gold_items(spark, str(at)).orderBy("id").collect()
    assert [(r["id"], r["source"], r["acceptable_alternatives"]) for r in got] == [(1, "yes", ["ئا"]), (2, "wait", None)]
    items = subtitles.gold_items(spark, str(at)).selectExpr(
        "id",
        "category",
        "source",
        "coalesce(gold_sorani, '') gold",
        "coalesce(acceptable_alternatives, array()) alternatives",
        "coalesce(unacceptable_literal_examples, array()) literals",
    )
    total = {r["category"]: r for r in scoring.benchmark(items, provider.DictionaryProvider()).collect()}
    assert total["idiom"]["items"] == 2 and total["idiom"]["passed"] == 1
