"""Hand-computed cases of the subtitle operators."""

import difflib
import random

import pytest
from pyspark.sql import functions as F

from cuegrid import constants as K
from cuegrid.functions import responses as R
from cuegrid.functions import text as T
from cuegrid.functions import timecode as C
from cuegrid.operators import cost, memory, provider, quality, review, scenes, scoring, timing
from cuegrid.plans import queries
from cuegrid.sources import subtitles, writers


def one(spark, fn, *values):
    df = spark.createDataFrame([values], ", ".join(f"c{i} {'long' if isinstance(v, int) else 'string'}" for i, v in enumerate(values)))
    return df.select(fn(*[F.col(c) for c in df.columns]).alias("x")).first()["x"]


def test_timecodes(spark):
    for text, ms in (("00:01:20,000", 80000), ("01:30:15.500", 5415500), ("0:0:1,5", 1500), ("0:0:1,25", 1250), ("x", None)):
        assert one(spark, C.srt_ms, text) == ms
    for text, ms in (("01:02.5", 62500), ("1:00:00.1239", 3600123), ("00:00:01", 1000)):
        assert one(spark, C.vtt_ms, text) == ms
    assert one(spark, C.ass_ms, "1:01:01.50") == 3661500
    assert [one(spark, f, 3661500) for f in (C.srt_stamp, C.ass_stamp, C.vtt_stamp)] == ["01:01:01,500", "1:01:01.50", "01:01:01.500"]


def test_cleaning(spark):
    assert one(spark, T.clean_source, "JOHN: <i>Hi</i> {\\b1}you ", "JOHN") == "Hi you"
    assert one(spark, T.speaker_label, "JOHN: You're pushing your luck.") == "JOHN"
    assert one(spark, T.speaker_label, "12:30 train") == "12"  # digits count as a label
    assert one(spark, T.speaker_label, "A" * 31 + ": x") is None
    assert one(spark, T.speaker_label, "Hello") is None


def test_normalization(spark):
    assert one(spark, T.normalize, "سڵاو   ؟") == "سڵاو؟"
    assert one(spark, T.normalize, "كيى ـ a,b;c????? …!!!") == "کیی a، b؛ c؟ ...!"
    assert one(spark, T.normalize, "plain, text?") == "plain, text?"
    assert one(spark, T.normalize_digits, "٤۵6") == "456"
    assert one(spark, T.rtl_marks, "a") == K.RLM + "a" + K.RLM and one(spark, T.rtl_marks, "") == ""


def test_detectors(spark):
    assert one(spark, T.untranslated, "ئەمە <i>movie</i> ok Hello élan") == ["movie", "Hello"]
    assert sorted(one(spark, T.kurmanji, "ê تە تە، î")) == sorted(["ê", "î", "تە"])
    assert one(spark, T.ezafe_chains, "ی ی ی ی نا ی ی") == [4]
    assert one(spark, T.ezafe_chains, "نا ی ی ی ی ی") == [5]
    assert sorted(one(spark, T.llm_errors, "1. كی ي no no no (abc) **")) == ["arabic_yeh", "markdown", "mixed_script", "note", "numbered_list", "triple_word"]
    assert one(spark, T.suspicious_names, "Who is Erin, (NASA) Bob?") == ["Bob", "Erin"]


def test_line_breaks(spark):
    text = "one two three four five six seven eight nine ten"
    top, low = one(spark, T.line_breaks, text).split("\n")
    assert f"{top} {low}" == text and abs(len(top) - len(text) // 2) <= 4
    assert one(spark, T.line_breaks, "short") == "short" and one(spark, T.line_breaks, "x" * 50 + " y") == "x" * 50 + " y"
    # as near as the next word end, thanks to the full stop; the earliest of equals wins
    assert one(spark, T.line_breaks, "aaaaaaaaaaaaaaaa. bbbbbbbb cccccccccccccccccc dddd") == "aaaaaaaaaaaaaaaa.\nbbbbbbbb cccccccccccccccccc dddd"


def test_routing_and_honorifics(spark):
    r = one(spark, T.route, "[Speaking Spanish]")
    assert (r["case_type"], r["opaque"], r["indicator"]) == ("B", True, "[ئیسپانی دەدوێت]")
    assert one(spark, T.route, "[speaks klingon]")["indicator"] == "[klingon دەدوێت]"
    assert one(spark, T.route, "[in Spanish] Hello")["case_type"] == "A"
    assert one(spark, T.enforce_honorifics, "Captain and Detective", "x") == "پشکنەر کاپتن x"
    assert one(spark, T.enforce_honorifics, "Captain", "کاپتن x") == "کاپتن x" and one(spark, T.enforce_honorifics, "Captain", "") == ""
    assert one(spark, T.dictionary_translation, "We need to leave right now.") == "نەخێر"
    assert one(spark, T.dictionary_translation, "Zebra") == "تەرجەمەی: Zebra"


SRT = "﻿1\n00:00:01,000 --> 00:00:02,500 X1:0\nCAPTAIN: Go\n\n\nno arrow\n\n7\n00:00:03,000 --> 00:00:04,000\nline one\n line two \n\n8\nbad --> 00:00:05,000\nx\n"
VTT = "WEBVTT\n\nNOTE hi\n\nid\n00:01.000 --> 00:02.000 align:start\nHello\nthere\n\n00:03.000 --> 00:04.000\n"
ASS = "[Script Info]\nTitle: x\n[Events]\nFormat: Start, End, Text\nDialogue: 0:00:01.00,0:00:02.50,{\\i1}a, b\\Nc\nDialogue: 0:00:03.00,0:00:04.00,{x}\n[Fonts]\nDialogue: 0:00:05.00,0:00:06.00,no\n"


def test_scans(spark):
    files = spark.createDataFrame([("a.srt", SRT), ("b.vtt", VTT), ("c.ass", ASS), ("d.txt", "")], "path string, content string")
    cues, bad = subtitles.scan(files)
    got = [tuple(r) for r in cues.orderBy("track_id", "cue_id").collect()]
    assert got == [
        ("a.srt", 1, 1000, 2500, "CAPTAIN: Go", "CAPTAIN"),
        ("a.srt", 2, 3000, 4000, "line one\nline two", None),
        ("b.vtt", 1, 1000, 2000, "Hello\nthere", None),
        ("b.vtt", 2, 3000, 4000, "", None),
        ("c.ass", 1, 1000, 2500, "a, b\nc", None),
    ]
    assert [r["track_id"] for r in bad.collect()] == ["a.srt"]
    with pytest.raises(Exception, match="bad timestamp"):
        subtitles.scan(files.where("path = 'a.srt'"), strict=True)[0].collect()


def test_files_and_guards(spark, tmp_path):
    (tmp_path / "a.srt").write_text(SRT, encoding="utf-8")
    (tmp_path / "b.srt").write_bytes("1\n00:00:01,000 --> 00:00:02,000\né".encode("latin-1"))
    (tmp_path / "c.srt").write_text("")
    (tmp_path / "d.srt").write_text("  \n")
    files = subtitles.read_files(spark, str(tmp_path))
    cues, _ = subtitles.scan(files)
    assert "é" in {r["source_text"] for r in cues.collect()}
    assert {r["path"][-5:]: r["reason"] for r in subtitles.guard(files).collect()} == {"c.srt": "empty", "d.srt": "blank"}
    assert subtitles.gold_items(spark, str(tmp_path / "none.json")).count() == 0


def test_tracks(spark):
    paths = spark.createDataFrame(
        [("/m/film.mkv", p) for p in ("/m/film.french.srt", "/m/other.vtt", "/m/film.forced.ass", "/m/x.txt")],
        "media string, path string",
    )
    c = {r["path"][3:]: (r["language"], r["track_type"], r["score"]) for r in subtitles.track_candidates(paths).collect()}
    assert c == {"film.french.srt": ("en", "full", 100), "other.vtt": ("unknown", "full", 90), "film.forced.ass": ("unknown", "forced", 95)}
    master = lambda o=None: subtitles.master_track(subtitles.track_candidates(paths), o).first()["path"]
    assert master() == "/m/film.french.srt" and master(spark.createDataFrame([("/m/film.mkv", "/m/other.vtt")], "media string, path string")) == "/m/other.vtt"


CUE = "track_id string, seq long, start_ms long, end_ms long, source_text string, target_text string, speaker string"


def cue_rows(spark, *rows):
    return spark.createDataFrame([("t", i + 1, s, e, src, tgt, None) for i, (s, e, src, tgt) in enumerate(rows)], CUE)


def test_metrics_and_retiming(spark):
    c = cue_rows(spark, (0, 1000, "x" * 34, None), (1500, 1550, "ab\n cd ", ""), (9000, 10000, "y" * 60, "y" * 60))
    m = timing.metrics(c).orderBy("seq").collect()
    assert [
        (r["char_count"], r["line_count"], r["max_cpl"], r["cps_x100"], r["gap_ms"]) for r in m
    ] == [(34, 1, 34, 3400, 500), (4, 2, 2, 4000, 7450), (60, 1, 60, 6000, None)]
    assert [r["new_end_ms"] for r in timing.retime(c).orderBy("seq").collect()] == [1420, 1735, 12529]


def test_sync(spark):
    c = cue_rows(spark, (1000, 3000, "a", None), (10000, 12000, "b", None), (50000, 51000, "c", None))
    at = lambda d: [(r["start_ms"], r["end_ms"]) for r in d.orderBy("seq").collect()]
    assert at(timing.shift(c, 500))[0] == (1500, 3500) and at(timing.shift(c, -500))[0] == (500, 2500) and at(timing.shift(c, -9000))[0] == (0, 100)
    assert [s for s, _ in at(timing.two_point_sync(c, (10000, 11000), (50000, 55000)))][1:] == [11000, 55000]
    assert at(timing.convert_rate(c, 25, 25)) == at(c) and at(timing.convert_rate(c, 0, 25)) == at(c)


def brute_scenes(rows, low=10, high=30, gap=3500):
    out, n, scene, last = [], 0, 1, None
    for s, e in rows:
        if n and (n >= high or (n >= low and s - last >= gap)):
            n, scene = 0, scene + 1
        n, last = n + 1, e
        out.append(scene)
    return out


def test_scenes_equal_the_rule(spark):
    rng = random.Random(1)
    rows, want = [], {}
    for t in ("a", "b", "c"):
        at, times = 0, []
        for i in range(rng.randint(50, 400)):
            times.append((at, at + 500))
            rows.append((t, i, at, at + 500, "x", None, None))
            at += 500 + rng.choice([0, 100, 4000])
        want[t] = brute_scenes(times)
    df = spark.createDataFrame(rows, CUE).repartition(5)
    got = scenes.segment(df)
    for t, w in want.items():
        assert [r["scene_no"] for r in got.where(F.col("track_id") == t).orderBy("seq").collect()] == w
    b = scenes.bounds(got).where("track_id = 'a'").orderBy("scene_no").collect()
    assert b[0]["previous_id"] is None and b[0]["next_id"] == "S002" and sum(r["cues"] for r in b) == len(want["a"]) and b[-1]["next_id"] is None


def test_every_rule(spark):
    letters = "سڵاو هاوڕێ"
    cases = {
        "hard_max_cps": (0, 500, "x", "ا" * 30), "hard_max_cpl": (0, 9000, "x", "ا" * 43), "max_lines": (0, 9000, "x", "ا\nا\nا"), "min_duration": (0, 700, "x", "ا"),
        "kurmanji_contamination": (0, 9000, "x", "ê"), "untranslated_english": (0, 9000, "x", "سڵاو movie"), "llm_error_pattern": (0, 9000, "x", "سڵاو **"), "excessive_ezafe_chain": (0, 9000, "x", "ی ی ی ی"),
        "number_inconsistency": (0, 9000, "x 5", "٦"), "negation_reversal": (0, 9000, "do not go", "بڕۆ"), "question_mark_missing": (0, 9000, "go?", "بڕۆن"), "mock_fallback_detected": (0, 9000, "x", "تەرجەمەی: x"),
        "length_ratio_too_short": (0, 9000, "x" * 40, "بڕۆن"), "length_ratio_too_long": (0, 9000, "xxxx", letters * 3),
    }
    rows = [(r, 1, s, e, src, tgt, None) for r, (s, e, src, tgt) in cases.items()] + [
        ("duplicate_translation", 1, 0, 9000, "x y", letters, None),
        ("duplicate_translation", 2, 9500, 19000, "z", letters, None),
    ]
    ev = quality.evaluate(spark.createDataFrame(rows, CUE))
    fired = {}
    for r in quality.issues_long(ev).collect():
        fired.setdefault(r["track_id"], set()).add(r["rule"])
    assert all(rule in fired[rule] for rule, *_ in K.RULES)
    r = {x["track_id"]: x for x in ev.where("seq = 1").collect()}
    assert (r["number_inconsistency"]["semantic"], r["number_inconsistency"]["overall"], r["number_inconsistency"]["passed"]) == (65, 86, False)
    assert not any("negation_reversal" in x["rule"] for x in quality.issues_long(quality.evaluate(cue_rows(spark, (0, 9000, "I don't", "بڕۆ")))).collect())
    named = quality.evaluate(cue_rows(spark, (0, 9000, "John and Mary", "")), names=["John", "Mary", "xy"]).first()
    assert named["semantic"] == 70


def test_scores(spark):
    pairs = spark.createDataFrame(
        [(1, "the cat sat", "the cat sat"), (2, "", "x"), (3, " ", ""), (4, "abc", "xyz")],
        "id int, reference string, hypothesis string",
    )
    got = {r["id"]: r["chrf_e4"] for r in scoring.chrf(pairs, ["id"]).collect()}
    assert got[1] == 10000 and got[2] == 0 and got[3] == 10000 and 0 < got[4] < 2000  # the blanks around words match
    d = scoring.compare(spark.createDataFrame([("a b c", "a x c"), ("s", "s")], "original string, revised string")).orderBy("original").collect()
    assert [(r["has_changes"], r["wer"]) for r in d] == [(True, 0.333), (False, 0.0)] and "<del" in d[0]["diff_html"]
    ratio = spark.createDataFrame([("tide", "diet"), ("diet", "tide")], "a string, b string").select(scoring.match_ratio("a", "b").alias("r")).collect()
    assert sorted(r["r"] for r in ratio) == [0.25, 0.5]


def test_memory(spark):

    rng = random.Random(6)
    base = ["".join(rng.choice("abcd ") for _ in range(rng.randint(5, 60))).strip() for _ in range(40)]
    mem = spark.createDataFrame(
        [(i, b, f"t{i}", None, 1) for i, b in enumerate(base)],
        "tm_id long, source_text string, target_text string, context_notes string, version long",
    )
    cues = [(i, b[:3] + "X" + b[3:] if i % 2 else b.upper()) for i, b in enumerate(base)]
    got = {
        r["seq"]: (r["tm_id"], r["ratio_e3"]) for r in memory.fuzzy(
            spark.createDataFrame(cues, "seq long, source_text string"),
            mem,
            ["seq"],
            threshold=0.85,
        ).collect()
    }
    want = {}
    for i, c in cues:
        best = max(((difflib.SequenceMatcher(None, c.strip().lower(), b.strip().lower()).ratio(), -j) for j, b in enumerate(base)), default=(0, 0))
        if best[0] >= 0.85:
            want[i] = (-best[1], round(best[0] * 1000))
    assert {k: v[0] for k, v in got.items()} == {k: v[0] for k, v in want.items()} and len(want) > 20
    up = memory.upsert(mem, mem.limit(1).selectExpr("tm_id + 100 tm_id", "source_text", "'new' target_text", "context_notes", "version + 1 version"))
    assert up.count() == mem.select("source_text").distinct().count() and up.where("target_text = 'new'").count() == 1


def test_fuzzy_memory_equals_all_pairs(spark, monkeypatch):
    rng = random.Random(8)
    words = ["".join(rng.choice("abcdeé ") for _ in range(rng.randint(1, 7))) for _ in range(60)]
    base = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 25))) for _ in range(120)]

    def spoilt(t):
        t = list(t)
        for _ in range(rng.randint(0, max(1, len(t) // 8))):
            k = rng.randrange(len(t) + 1)
            if rng.random() < 0.5:
                t.insert(k, rng.choice("xab"))
            elif k < len(t):
                del t[k]
        return "".join(t)

    asked = [spoilt(b) for b in base] + ["", " ", None, "a", "ab", base[0].upper(), "zz" + base[1], base[2] + "zz"]
    mem = spark.createDataFrame(
        [(i % 100, b, f"t{i}", None, 1) for i, b in enumerate([*base, base[3], None, "", "ab"])],
        "tm_id long, source_text string, target_text string, context_notes string, version long",
    )
    frame = spark.createDataFrame(list(enumerate(asked)), "seq long, source_text string")
    entries = [(r["tm_id"], r["source_text"].strip().lower()) for r in mem.collect() if r["source_text"] and r["source_text"].strip()]
    ratio = {}
    for i, c in enumerate(asked):
        if c and c.strip():
            ratio[i] = [(difflib.SequenceMatcher(None, c.strip().lower(), b).ratio(), -j) for j, b in entries]
    for threshold, long in ((0.92, 1024), (0.8, 1024), (1.0, 1024), (0.85, 40), (0.92, 0)):
        monkeypatch.setattr(memory, "LONG", long)
        want = {i: (-best[1], round(best[0] * 1000)) for i, all_ in ratio.items() if (best := max(all_))[0] >= threshold}
        got = {r["seq"]: (r["tm_id"], r["ratio_e3"]) for r in memory.fuzzy(frame, mem, ["seq"], threshold=threshold).collect()}
        assert got == want and (len(want) > 25 or threshold == 1.0)
    assert memory.fuzzy(frame, mem.limit(0), ["seq"]).count() == 0 and memory.fuzzy(frame.limit(0), mem, ["seq"]).count() == 0
    with pytest.raises(ValueError):
        memory.fuzzy(frame, mem, ["seq"], threshold=0)


def test_fuzzy_memory_rates_few_pairs(spark):
    c = queries.lines(spark, "/root/testdata/sf0.001")
    asked = c.select(memory.key(F.regexp_replace("line", "and", "nd")).alias("a")).distinct()
    known = c.select(memory.key(F.col("line")).alias("b")).distinct()
    n = memory.candidates(asked, known, 0.92).count()
    matches = memory.candidates(asked, known, 0.92).select(scoring.match_ratio("a", "b").alias("r")).where("r >= 0.92").count()
    assert 0 < n <= 10 * matches


def test_best_entries_equal_brute_force(monkeypatch):
    """Few letters and long texts, in which difflib leaves popular characters out; small chunks and few levels."""
    rng = random.Random(16)
    for k, letters in enumerate(("ab", "abcdefgh ", "etaoin shrdlu,.é", "xyz\U0001f600 ")):
        monkeypatch.setattr(memory, "CHUNK", 7)
        monkeypatch.setattr(memory, "AT_ONCE", 50)
        monkeypatch.setattr(memory, "LEVELS", (2048, 20)[k % 2])
        entries = ["".join(rng.choice(letters) for _ in range(rng.choice((1, 2, 5, 30, 150, 199, 200, 201, 420)))) for _ in range(40)]
        texts = []
        for b in entries * 2:
            t = list(b)
            for _ in range(rng.randint(0, max(1, len(t) // 9))):
                i = rng.randrange(len(t) + 1)
                if rng.random() < 0.5:
                    t.insert(i, rng.choice(letters + "Q"))
                elif i < len(t):
                    del t[i]
            if t:
                i = rng.randrange(len(t))
                texts += ["".join(t), "".join(t[i:] + t[:i])]
        texts, entries = sorted({*texts}), sorted({*entries, *texts[::9]})
        rated = {x: [(difflib.SequenceMatcher(None, x, b).ratio(), b) for b in entries] for x in texts}
        for threshold in (0.92, 0.8, 0.5):
            want = sorted((x, b, r) for x, all_ in rated.items() for r, b in all_ if r == max(all_)[0] >= threshold)
            assert want and all(sorted(memory._best(texts, entries, threshold, long)) == want for long in (0, 200, 10_000))


def test_fuzzy_memory_meets_by_blocks(spark, monkeypatch):
    c = queries.lines(spark, "/root/testdata/sf0.01")
    asked = c.select(memory.key(F.regexp_replace("line", "and", "nd")).alias("a")).distinct()
    known = c.select(memory.key(F.col("line")).alias("b")).distinct()
    found = memory.candidates(asked, known, 0.92)
    rows = found.collect()

    def made(plan) -> list[int]:
        kind = plan.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            return made(plan.executedPlan())
        below = [plan.plan()] if kind.endswith("QueryStageExec") else [plan.children().apply(i) for i in range(plan.children().size())]
        own = [plan.longMetric("numOutputRows").value()] if plan.metrics().contains("numOutputRows") else []
        return own + [n for x in below for n in made(x)]

    assert max(made(found._jdf.queryExecution().executedPlan())) <= 10 * known.count()
    best = {(r["a"], r["ratio"]) for r in rows}
    # blocks of any size find the same
    monkeypatch.setattr(memory, "ROWS", 100)
    top = {}
    for r in memory.candidates(asked, known, 0.92).collect():
        top[r["a"]] = max(r["ratio"], top.get(r["a"], 0))
    assert {*top.items()} == best and len(best) > 400


def test_provider_and_review(spark):
    c = cue_rows(spark, (0, 900, "hello", None), (1000, 1900, "hello", ""), (2000, 2900, "x", "given"))
    calls = spark.sparkContext.accumulator(0)

    def shout(s):
        calls.add(len(s))
        return s.str.upper()

    out = {r["seq"]: (r["origin"], r["target_text"]) for r in provider.translate_missing(c, provider.BatchProvider(shout)).collect()}
    assert out == {1: ("provider", "HELLO"), 2: ("provider", "HELLO"), 3: ("given", "given")} and calls.value == 1

    def fail(s):
        raise OSError

    assert {r["target_text"] for r in provider.translate_missing(c, provider.BatchProvider(fail, backoff=0)).collect()} == {"hello", "given"}
    made = spark.createDataFrame(
        [("t", 1, "accept", "n", None), ("t", 2, "choose_alternative", None, "alt"), ("t", 3, "edit", "new", None)],
        "track_id string, seq long, action string, approved string, alternative string",
    )
    assert [(r["final_text"], r["status"]) for r in review.decide(c, made).orderBy("seq").collect()] == [("", "accepted"), ("alt", "edited"), ("new", "edited")]


def test_costs(spark):
    rows = [("t", i, 0, 1, "x" * 40, None, None, 1) for i in range(20)]
    c = spark.createDataFrame(rows, CUE + ", scene_no int")
    r = cost.scene_cost(c, "gpt-4o").first()
    assert (r["input_tokens"], r["output_tokens"]) == (950, 530) and r["usd_e6"] == round((950 * 0.0025 + 530 * 0.01) * 1000)
    assert cost.priced(spark.createDataFrame([("nobody",)], "model string")).first()["price_in"] == 0.001
    led = cost.ledger(spark.createDataFrame([("p", 1, 600), ("p", 2, 600)], "project_id string, call_id long, usd_e6 long"), 1000).orderBy("call_id").collect()
    assert [(r["remaining_e6"], r["fits"]) for r in led] == [(400, True), (0, False)]


def test_responses(spark):
    said = ['```json\n{"a": 1}\n```', "x [1, 2] y", 'pre {"b": [1]} post', "[1] and {", "none", ""]
    df = spark.createDataFrame([(s,) for s in said], "s string")
    assert [r["x"] for r in df.select(R.lenient_json("s").alias("x")).collect()] == [
        '{"a": 1}',
        '{"items": [1, 2], "translations": [1, 2]}',
        '{"b": [1]}',
        '{"items": [1], "translations": [1]}',
        "{}",
        "{}",
    ]
    for item, ids in (
        ('{"cue_ids":[1,"2","x"]}', [1, 2]),
        ('{"cue_id":"7"}', [7]),
        ('{"id":3.9}', [3]),
        ('{"id":"x"}', [1]),
        ("{}", [1]),
        ('{"cue_ids":[]}', [1]),
        ('{"cue_ids":[-1.5]}', [-1]),
        ('{"cue_ids":["2.5"]}', [1]),
        ('{"id":" +5 "}', [5]),
        ('{"cue_ids":null,"id":4}', [4]),
        ('{"cue_ids":{"a":1}}', [1]),
        ("no", [1]),
    ):
        assert one(spark, R.cue_ids, item) == ids


def test_sinks(spark):
    c = cue_rows(spark, (3661500, 3662000, "<a> & 'b'", None), (3663000, 3664000, "x", "دوو\nهێڵ"))
    assert writers.to_srt(c).first()["content"] == "1\n01:01:01,500 --> 01:01:02,000\n<a> & 'b'\n\n2\n01:01:03,000 --> 01:01:04,000\nدوو\nهێڵ\n"
    assert writers.to_vtt(c).first()["content"].startswith("WEBVTT\n\n1\n01:01:01.500 --> 01:01:02.000\n")
    assert "Dialogue: 0,1:01:03.00,1:01:04.00,Default,,0,0,0,,دوو\\Nهێڵ" in writers.to_ass(c).first()["content"]
    qc = spark.createDataFrame(
        [("t", 2, 1, 40, False, ["old"]), ("t", 2, 2, 97, True, ["m"])],
        "track_id string, seq long, version int, confidence int, passed boolean, messages array<string>",
    )
    html = {r["seq"]: r["html"] for r in writers.to_html_rows(c, qc).collect()}
    assert "&amp; &#x27;b&#x27;" in html[1] and "N/A" in html[1] and "0.97" in html[2] and "#28a745" in html[2]
    rep = writers.to_qc_report(quality.evaluate(c)).first()["content"]
    assert '"total_cues":2' in rep
